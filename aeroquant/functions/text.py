"""Text expressions: carrier codes, labels, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------

# characters trimmed from both ends of a callsign
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

CARRIER_PATTERN = "^([A-Z]{2,4})"

CARRIER_NAMES = {
    "AEE": "Aegean Airlines",
    "OAL": "Olympic Air",
    "THY": "Turkish Airlines",
    "PGT": "Pegasus Airlines",
    "SXS": "SunExpress",
    "DLH": "Lufthansa",
    "CFG": "Condor",
    "EWG": "Eurowings",
    "BAW": "British Airways",
    "SHT": "British Airways (Shuttle)",
    "AFR": "Air France",
    "EZY": "easyJet",
    "EJU": "easyJet Europe",
    "RYR": "Ryanair",
    "WZZ": "Wizz Air",
    "VLG": "Vueling",
    "TAP": "TAP Air Portugal",
    "KLM": "KLM",
    "SWR": "Swiss International Air Lines",
    "AUA": "Austrian Airlines",
    "IBE": "Iberia",
    "AZA": "ITA Airways",
    "TVF": "Transavia France",
    "TRA": "Transavia",
    "VOE": "Volotea",
}

UNKNOWN_CARRIER = "Unknown carrier"
UNMAPPED_CARRIER = "Unmapped carrier"


def airline_code(callsign: Column) -> Column:
    """Leading 2 to 4 letters of a callsign; null where there are none."""
    code = F.upper(F.btrim(callsign, F.lit(BLANKS)))
    letters = F.regexp_extract(F.nullif(code, F.lit("NAN")), CARRIER_PATTERN, 1)
    return F.nullif(letters, F.lit(""))


def airline_prefix3(callsign: Column) -> Column:
    return F.substring(callsign, 1, 3)


def airline_label(code: Column, names: dict[str, str] | None = None) -> Column:
    """Carrier name; a fixed map of a few dozen entries, so no join."""
    table = F.create_map(*[F.lit(x) for pair in (names or CARRIER_NAMES).items() for x in pair])
    unmapped = F.concat(F.lit(f"{UNMAPPED_CARRIER} ("), code, F.lit(")"))
    return (
        F.when(code.isNull(), F.lit(UNKNOWN_CARRIER))
        .otherwise(F.coalesce(F.try_element_at(table, code), unmapped))
    )


def route_name(origin: Column, destination: Column) -> Column:
    return F.concat_ws("->", origin, destination)


def route_key(origin: Column, destination: Column) -> Column:
    return F.concat_ws("_", origin, destination)


def route_to_key(route: Column) -> Column:
    return F.replace(route, F.lit("->"), F.lit("_"))


def safe_key(key: Column) -> Column:
    """Make a key usable in a file name."""
    return F.translate(key, "/:", "--")

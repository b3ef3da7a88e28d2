"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton holds all strict and soft terms and finds their
occurrences in one pass over a URL. An occurrence counts only where no letter or
digit touches it on either side. One strict term rejects, and so do several
distinct soft ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroquant.llm.common import with_fields

# (verdict, host, path start): fixed values
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

# vocabulary of unwanted pages
STRICT_TERMS = ["adult", "casino", "escort", "gambling", "jackpot", "porn", "sex", "xxx"]
SOFT_TERMS = ["bet", "bets", "bonus", "cam", "cheap", "dating", "free", "hot", "live", "loan", "pills", "poker", "slots", "win"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def automaton(strict: list[str], soft: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):  # a term on both lists is strict
        for term in terms:
            found.add_word(term.translate(FOLD), (term.translate(FOLD), weight))
    found.make_automaton()
    return found


def term_hits(found: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """Distinct strict and distinct soft terms that stand free in the URL."""
    text = url.translate(FOLD)
    strict, soft = set(), set()
    for end, (term, weight) in found.iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1] in INNER) or (end + 1 < len(text) and text[end + 1] in INNER):
            continue
        (strict if weight == 2 else soft).add(term)
    return len(strict), len(soft)


def _count(url_col: str, strict: list[str], soft: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft) if strict or soft else None
        for batch in batches:
            counts = [
                term_hits(found, u) if u and found else (0, 0) for u in batch.column(url_col).to_pylist()
            ]
            made = {
                "n_strict": pa.array([c[0] for c in counts], pa.int64()),
                "n_soft": pa.array([c[1] for c in counts], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)

    return run


def url_parts(url) -> tuple:
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def filter_urls(
    pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] | None = None,
    strict: list[str] | None = None, soft: list[str] | None = None, min_soft: int = 2,
) -> DataFrame:
    """Judge every URL; adds ``host path n_strict n_soft rule verdict``.

    ``rules`` are (verdict, host, path start). A rule fits its host and all
    subdomains if the URL's path starts with the rule's path; the longest rule wins
    and its verdict holds. Elsewhere a URL is blocked by one strict term or by
    ``min_soft`` distinct soft ones.

    - A null URL, or one without ``://``: host and path are empty, no rule fits; the
      vocabulary still reads what there is (a null URL has no term, so it is allowed).
    - Repeated rows are judged alike; an empty table gives an empty one.
    - Input columns named like an added one are replaced, all others pass through.
    """
    rules = RULES if rules is None else rules
    strict = STRICT_TERMS if strict is None else strict
    soft = SOFT_TERMS if soft is None else soft
    added = ["host", "path", "n_strict", "n_soft", "rule", "verdict"]
    base = pages.drop(*[c for c in added if c in pages.columns and c != url_col])
    schema = with_fields(base.schema, T.StructField("n_strict", T.LongType()), T.StructField("n_soft", T.LongType()))
    counted = base.mapInArrow(_count(url_col, strict, soft, schema.names), schema)
    with_url = counted.withColumn("__url", F.coalesce(F.col(url_col), F.lit("")))
    host, path = url_parts(F.col("__url"))
    out = with_url.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = (
            ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host))
            & F.col("path").startswith(rule_path)
        )
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    by_terms = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= min_soft), "block").otherwise("allow")
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_terms)).drop("__url")


def _terms_sql(terms: list[str]) -> str:
    return " + ".join(
        f"cast(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as bigint)" for t in terms
    )


def oracle() -> str:
    cases_rule = cases_verdict = ""
    for kind, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
        cases_rule += f" when {fits} then '{host}{path}'"
        cases_verdict += f" when {fits} then '{kind}'"
    return f"""
with cut as (
  select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') u,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest
  from pages),
parts as (
  select *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from cut),
hits as (
  select *, {_terms_sql(STRICT_TERMS)} n_strict, {_terms_sql(SOFT_TERMS)} n_soft from parts)
select page_id, host, path, n_strict, n_soft, case{cases_rule} end "rule",
  case{cases_verdict} when n_strict >= 1 or n_soft >= 2 then 'block' else 'allow' end verdict
from hits
"""

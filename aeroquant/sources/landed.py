"""Files as the fetchers leave them: JSON payloads and parquet chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroquant.functions import numbers
from aeroquant.schemas import FLIGHT_SCHEMA, WEATHER
from aeroquant.session import cut_lineage

# the first date in the name of an arrival chunk (fixed pattern)
FIRST_DATE = r"arrivals_[A-Z0-9]+_(\d{4}-\d{2}-\d{2})"

# arrival records as they land: times are epoch seconds
ARRIVAL_SCHEMA = T.StructType([
    T.StructField(f.name, T.LongType() if f.name in ("firstSeen", "lastSeen") else f.dataType)
    for f in FLIGHT_SCHEMA.fields
    if f.name not in ("destination_airport", "route")
])


def read_landed(spark: SparkSession, paths, schema: T.StructType | str, pattern: str | None = None) -> DataFrame:
    """Landed files below a folder; NaN becomes null on the way in.

    ``pattern`` prunes files by name before any is opened. Folder names are not
    read as partitions; see ``read_table`` for stored tables.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return numbers.clean_nan(reader.parquet(*([paths] if isinstance(paths, str) else paths)))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, where: Column | None = None) -> DataFrame:
    """A stored table, whose partition columns come from its folders; see ``clean_where``."""
    return numbers.clean_where(spark.read.schema(schema).parquet(path), where)


def read_or_none(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """None where nothing is stored. A damaged file is an error: the caller rewrites
    what it reads, so a skipped file would be lost for good."""
    try:
        return numbers.clean_nan(spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def file_list(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file: path and length. File contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def hollow_files(files: DataFrame) -> DataFrame:
    """``path`` of the files of no bytes in a ``binaryFile`` source, whose scan leaves them out.

    The driver holds the list of all files anyway; it is compared with what the scan has.
    """
    listed = [(re.sub(r"^(\w+):///", r"\1:/", unquote(uri)),) for uri in files.inputFiles()]
    return files.sparkSession.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")


# a file up to this size is read as one value, which a task holds some five times; a larger one by a scan of its own
PROBED_BYTES = 32 << 20
PROBED_ROWS = 8192  # rows decoded at a time
_PROBE = "path string, length long, status string, n_rows long, columns array<string>"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Footer and a full read of each file, a bounded number of rows in memory at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            path, length, content = (batch.column(c)[i] for c in ("path", "length", "content"))
            status, n_rows, columns = "unreadable", 0, []
            try:
                file = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                for part in file.iter_batches(PROBED_ROWS, use_threads=False):
                    n_rows += part.num_rows
                status, columns = "with_data" if n_rows else "empty", file.schema_arrow.names
            except (pa.ArrowException, OSError, ValueError, EOFError):
                n_rows = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.as_py()]), pa.array([length.as_py()], pa.int64()), pa.array([status]),
                 pa.array([n_rows], pa.int64()), pa.array([columns], pa.list_(pa.string()))],
                ["path", "length", "status", "n_rows", "columns"],
            )


def _probe_by_scan(spark: SparkSession, path: str, length: int) -> tuple:
    """As ``_probe``, by a scan that splits the file among the tasks."""
    own = spark.newSession()
    own.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")  # such a file is readable, whatever its times mean
    own.conf.set("spark.sql.caseSensitive", "true")  # names that differ in case only are columns of their own
    try:
        rows = own.read.option("ignoreCorruptFiles", "false").parquet(path)
        seen = Observation()
        # every column is decoded, as a count alone would read the footer only
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        n = seen.get["n"]
        return path, length, "with_data" if n else "empty", n, rows.columns
    except (PySparkException, Py4JError):
        return path, length, "unreadable", 0, []


def probe_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """One row per file: ``status`` (``with_data``, ``empty`` or ``unreadable``), ``n_rows`` and ``columns``.

    Each file is opened in a task, its footer read and all its pages decoded, so a damaged
    file is told apart and the others go on. Nothing is skipped silently.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )
    small = files.where(F.col("length") <= PROBED_BYTES).select("path", "length", "content").mapInArrow(_probe, _PROBE)
    large = files.where(F.col("length") > PROBED_BYTES).select("path", "length")
    found = [_probe_by_scan(spark, r["path"], r["length"]) for r in large.toLocalIterator()]
    none = hollow_files(files).select(
        "path", F.lit(0).cast("long").alias("length"), F.lit("unreadable").alias("status"), F.lit(0).cast("long").alias("n_rows"),
        F.array().cast("array<string>").alias("columns"),
    )
    probed = small.unionByName(none)
    return probed.unionByName(spark.createDataFrame(found, _PROBE)) if found else probed


def chunk_inventory(
    spark: SparkSession, path: str, pattern: str = "*.parquet", required: Iterable[str] = ()
) -> DataFrame:
    """``probe_files`` with ``has_schema``: does the file itself have every required column?

    A column counts by the file's footer, so one that is null in every row is there.
    """
    named = F.array(*[F.lit(c) for c in required]).cast("array<string>")
    return probe_files(spark, path, pattern).withColumn("has_schema", F.size(F.array_except(named, "columns")) == 0)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """(rows of all readable files, the inventory); an unreadable file is reported, not skipped unseen."""
    inventory = cut_lineage(chunk_inventory(spark, path, pattern))
    if not inventory.where("status = 'unreadable'").take(1):
        return read_landed(spark, path, schema, pattern), inventory
    good = [r["path"] for r in inventory.where("status = 'with_data'").select("path").toLocalIterator()]
    if not good:
        return spark.createDataFrame([], schema), inventory
    return numbers.clean_nan(spark.read.schema(schema).parquet(*good)), inventory


def valid_chunks(inventory: DataFrame, kind: str) -> DataFrame:
    """Readable arrival chunks count even when empty; weather chunks need rows and all columns."""
    readable = inventory.where("status <> 'unreadable'")
    if kind == "arrivals":
        return readable
    return readable.where((F.col("n_rows") > 0) & F.col("has_schema"))


def inspect_chunks(inventory: DataFrame) -> DataFrame:
    """Files matched, empty, unreadable and filled, in one row."""
    return inventory.agg(
        F.count("*").alias("n_matched"),
        F.count_if(F.col("status") == "empty").alias("n_empty"),
        F.count_if(F.col("status") == "unreadable").alias("n_unreadable"),
        F.count_if(F.col("status") == "with_data").alias("n_with_data"),
        F.sum("n_rows").alias("n_rows"),
    )


def with_file_date(df: DataFrame, pattern: str = FIRST_DATE) -> DataFrame:
    """Add ``flight_date``, the date in the path of the source file."""
    found = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit(""))
    return df.withColumn("flight_date", found).where(F.col("flight_date").isNotNull())


def flight_records(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """JSON list of flight records to rows; an empty list gives no row."""
    records = F.from_json(F.col(payload), T.ArrayType(ARRIVAL_SCHEMA))
    return df.select(*keep, F.inline(records))


def hourly_struct() -> T.StructType:
    fields = [T.StructField("time", T.ArrayType(T.StringType()))]
    fields += [T.StructField(n, T.ArrayType(T.DoubleType())) for n in WEATHER]
    return T.StructType([T.StructField("hourly", T.StructType(fields))])


def parse_weather_payload(df: DataFrame, payload: str) -> DataFrame:
    return df.withColumn("hourly", F.from_json(F.col(payload), hourly_struct())["hourly"])


def inline_hourly(df: DataFrame, variables: Iterable[str], *keep: str) -> DataFrame:
    """Struct of parallel arrays to one row per hour.

    A payload without ``hourly`` or ``time`` is an error, not an empty result.
    """
    times = F.col("hourly.time")
    checked = F.when(
        F.coalesce(F.size(times), F.lit(0)) > 0, times
    ).otherwise(F.raise_error(F.lit("weather payload without hourly time")).cast("array<string>"))
    # a variable the payload lacks becomes null in every hour
    values = [F.coalesce(F.col(f"hourly.{v}"), F.array().cast("array<double>")).alias(v) for v in variables]
    arrays = F.arrays_zip(checked.alias("time"), *values)
    rows = df.select(*keep, F.inline(arrays))
    return rows.withColumn("time", F.to_timestamp("time"))

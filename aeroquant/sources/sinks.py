"""Writing tables and the stage log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroquant.schemas import STAGE_STATS_SCHEMA
from aeroquant.session import cut_lineage
from aeroquant.sources.landed import hollow_files


def write_partitions(
    df: DataFrame, path: str, by: list[str], rows_per_file: int = 20_000_000, order: list[str] | None = None
) -> None:
    """Replace only the partitions present in ``df``; others stay as stored.

    An empty frame therefore changes nothing. Rows are dealt out by partition value at
    write time with measured sizes: a value that holds most rows is split over tasks,
    small ones share a task, so files are few and none is huge. ``order`` sorts the
    rows of a file.
    """
    dealt = df.hint("rebalance", *by)
    if order:
        dealt = dealt.sortWithinPartitions(*by, *order)
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*by)
        .parquet(path)
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a whole unpartitioned table."""
    df.write.mode("overwrite").parquet(path)


def stage_stats(df: DataFrame, name: str, order: list[str], extra: str | None = None) -> DataFrame:
    """One row describing a stage: size, columns, null rates, three sample rows.

    The sample is the first three rows in ``order``, a bounded top-k.
    """
    columns = df.columns
    nulls = df.agg(
        F.count("*").alias("n_rows"),
        *[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 1).alias(c) for c in columns],
    )
    rates = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in columns]))
    as_text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], as_text.alias("row"))
    as_map = lambda r: F.from_json(r["row"], "map<string,string>")
    sample = df.orderBy(*order).limit(3).agg(F.transform(F.array_sort(F.collect_list(row)), as_map)).scalar()
    return nulls.select(
        F.lit(name).alias("stage"),
        F.current_timestamp().alias("timestamp_utc"),
        "n_rows",
        F.lit(len(columns)).alias("n_cols"),
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
        F.map_filter(rates, lambda _, pct: pct > 0).alias("null_rates_pct"),
        sample.alias("sample_rows"),
        F.lit(extra).cast("string").alias("extra"),
    )


def newest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed upsert: the newest row of each key, reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert_stage_stats(log: DataFrame, entry: DataFrame) -> DataFrame:
    both = log.unionByName(entry)
    return newest_by(both, ["stage"], ["timestamp_utc"]).select(*log.columns).orderBy("stage")


def load_stage_stats(spark: SparkSession, path: str) -> DataFrame:
    """The stage log; no rows where none was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(STAGE_STATS_SCHEMA).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STAGE_STATS_SCHEMA)


def record_stage_stats(df: DataFrame, name: str, path: str, order: list[str], extra: str | None = None) -> None:
    """Upsert one stage into the log at ``path``."""
    spark = df.sparkSession
    merged = cut_lineage(upsert_stage_stats(load_stage_stats(spark, path), stage_stats(df, name, order, extra)))
    merged.coalesce(1).write.mode("overwrite").json(path)


BLOCK_BYTES = 8 << 20
_DIGEST = "path string, sha256 string, size_bytes long"


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read each file block by block; where Python cannot open the store, the digest is null."""
    for batch in batches:
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            digest, size = hashlib.sha256(), 0
            try:
                store, name = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
                with store.open_input_stream(name) as stream:
                    while block := stream.read(BLOCK_BYTES):
                        digest.update(block)
                        size += len(block)
                found = digest.hexdigest() if size == length else None
            except (pa.ArrowException, OSError, ValueError):
                found = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([found], pa.string()), pa.array([length], pa.int64())], ["path", "sha256", "size_bytes"]
            )


def file_manifest(spark: SparkSession, root: str, exclude: str = "manifest.json") -> DataFrame:
    """sha256 and size of every file below ``root`` except the manifest.

    Files are hashed in tasks, a block at a time, so their length does not matter. Only
    files in a store that Python cannot open are read by Spark, as one value each.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    other = F.element_at(F.split("path", "/"), -1) != exclude
    files = source.where(other)
    hollow = hollow_files(source).where(other).select("path", F.lit(0).cast("long").alias("length"))
    listed = cut_lineage(files.select("path", "length").unionByName(hollow))
    tasks = spark.sparkContext.defaultParallelism * 4
    hashed = cut_lineage(listed.repartition(tasks, "path").mapInArrow(_hash_files, _DIGEST))
    left = hashed.where("sha256 is null").select("path")
    whole = files.join(left, "path", "left_semi").select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes")
    )
    done = hashed.where("sha256 is not null")
    return done.unionByName(whole) if left.take(1) else done


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested tier manifest to one row per trained route, tier and quantile."""
    production = "struct<model_path:string,preprocessing_path:string>"
    quantile = f"struct<production:{production},n_rows:bigint>"
    tier = f"struct<trained:boolean,n_rows:bigint,reason:string,quantiles:map<string,{quantile}>>"
    schema = f"route string, all_carriers {tier}, by_carrier struct<carriers:map<string,{tier}>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    return flatten_manifest(raw)


def flatten_manifest(raw: DataFrame) -> DataFrame:
    """Tier to quantile to artifact, skipping untrained and incomplete ones."""
    carriers = F.coalesce("by_carrier.carriers", F.create_map().cast(raw.schema["by_carrier"].dataType["carriers"].dataType))
    tiers = F.map_concat(F.create_map(F.lit("all_carriers"), F.col("all_carriers")), carriers)
    return (
        raw.select("route", F.explode(tiers).alias("tier", "entry"))
        .where(F.col("entry.trained"))
        .select("route", "tier", F.explode("entry.quantiles").alias("q", "artifact"))
        .select(
            "route", "tier", F.expr("try_cast(q as double)").alias("quantile"),
            F.col("artifact.production.model_path").alias("model_path"),
            F.col("artifact.production.preprocessing_path").alias("preprocessing_path"),
        )
        .where(
            F.col("quantile").isNotNull()
            & (F.length("model_path") > 0)
            & (F.length("preprocessing_path") > 0)
        )
    )

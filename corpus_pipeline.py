"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows the one before it kept and is stored before the next
one reads it, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroquant.llm import jaccard, lines, mixing, packing, toxicity
from aeroquant.llm.common import NO_ID, Scratch
from aeroquant.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half.

    A row without a text, or without an id, has a score like others; only the labelled
    sample depends on ids. An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines an earlier one holds; ``n_chars`` follows the text.

    Every row stays, also one that has lost all its lines; a null text becomes empty.
    Rows that share an id are one document, rows without one come last.
    """
    kept = lines.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8: the least by id, then by a hash of the row.

    Groups are of rows, not of ids: rows that share an id, or have none, stay together
    only where their own texts are linked. Null ids count after all others. Of equal
    rows one stays. Documents without words are in no group and stay.
    """
    docs = docs.select(*COLUMNS)
    # nulls leave a hash as it is, so it also takes where they are
    marked = docs.withColumn("__row", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))
    classes, _ = jaccard.jaccard_classes(marked.select("doc_id", "text", "__row"), words=5, percent=80, row_col="__row")
    order = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), "__row")
    stays = (
        classes.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("__least"))
        .select("__least.__id", "__least.__row")
    )
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # equal rows collapse before they are joined, on the map side first
    different = marked.where(worded).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    chosen = different.dropDuplicates(["__id", "__row"]).join(stays, ["__id", "__row"], "left_semi").select(*COLUMNS)
    return chosen.unionByName(docs.where(~worded))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole time, in the mix's order.

    Rows are told apart by themselves, not by their ids: null and shared ids change
    nothing. A copy stands where its pass over the row's source first reaches it. Rows
    without words, and those of which the mix takes less than half, go.
    """
    scratch = Scratch(spark, "pipeline-mix")
    rows = scratch.stage(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    taken, mix = mixing.mix_documents(rows.select("doc_id", "text", "source", "__row"))
    times = taken.where("size > 0").select(
        "_row", "__row", F.round(F.col("taken") / F.col("size")).cast("int").alias("__times")
    ).where("__times > 0")
    passes = mix.groupBy("_row", "epoch").agg(F.min("slot").alias("__slot"))
    copies = times.join(passes, "_row").where("epoch < __times").select("__row", "__slot")
    placed = rows.join(copies, "__row")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(parts, "__slot").sortWithinPartitions("__slot", "__row").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of at most 1024 tokens, neighbours in the mix together.

    An empty text is its closing token; ids are passed through as they are.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("n-gram jaccard", drop_near_copies),
    ("source mix", mix_sources),
    ("packing", pack),
]

# the scores, the links and the packing are no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.stage(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs

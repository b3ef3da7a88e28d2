"""Driver queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroquant.llm import (
    codes, collocations, decontaminate, jaccard, lines, mixing, neighbours, packing, passages, repetition, sharding,
    toxicity, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_url_filter", urls.oracle())
def op2(spark, sf_dir):
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "n_strict", "n_soft", "rule", "verdict")


LINES_SQL = r"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) i
  from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from split),
owners as (
  select k, min(doc_id) lo from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
judged as (
  select keyed.*, lo is not null and lo <> doc_id gone from keyed left join owners using (k))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
from judged group by doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op10_repetition_rules", repetition.oracle())
def op10(spark, sf_dir):
    return repetition.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op9_toxicity")
def op9(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(documents, table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(documents, model).select("doc_id", toxicity.held_out(), "score", "predicted")


@query("op4_sharding")
def op4(spark, sf_dir):
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_source_mix")
def op7(spark, sf_dir):
    rows, _ = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_ngram_jaccard")
def op5(spark, sf_dir):
    rows, _ = jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)
    return rows


@query("op1_near_vectors", neighbours.ORACLE)
def op1(spark, sf_dir):
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select(
        "vec_id", "n_links", "component_id", "kept"
    )


@query("op6_repeated_passages")
def op6(spark, sf_dir):
    kept = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op11_decontamination", decontaminate.ORACLE)
def op11(spark, sf_dir):
    judged = decontaminate.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


@query("op12_vector_codes", codes.ORACLE)
def op12(spark, sf_dir):
    rows, _ = codes.compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op13_collocations", collocations.ORACLE)
def op13(spark, sf_dir):
    ranked = collocations.mine_collocations(table(spark, sf_dir, "documents").select("text", "lang"))
    return ranked.drop("words")

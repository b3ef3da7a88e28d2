"""The stages one after the other, each against what it has to do to its own input."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from aeroquant.llm import mixing
from llm.cases import Union, awkward, shingles, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage."""
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(root / name))
        after = spark.read.parquet(str(root / name))
        out.append((name, docs, after))
        docs = after
    return out


def test_stage_names_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "line dedup", "n-gram jaccard", "source mix", "packing"]
    assert all(after.columns == pipeline.COLUMNS for _, _, after in stages[:-1])


def test_toxicity_keeps_clean_documents(spark, stages):
    _, before, after = stages[0]
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").join(before, "doc_id")
    lost = clean.join(after, "doc_id", "left_anti").count()
    assert lost <= 0.05 * clean.count()
    assert after.count() < before.count()


def test_line_stage_keeps_all_documents(stages):
    _, before, after = stages[1]
    assert after.count() == before.count()
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_near_copies_leave_one_of_each_group(spark):
    """On the raw documents, as the line stage leaves no copies in so small a table."""
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in raw.collect()}
    up = Union(sets)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up.join(a, b)
    got = pipeline.drop_near_copies(spark, raw, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted({up.find(i) for i in sets})
    assert len(got) < len(sets)


def _rows(spark, rows):
    full = [(i, t, "en", "web", len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def _text(name):
    return " ".join(f"{name}{i}" for i in range(60))


def test_near_copies_of_null_ids(spark):
    """Unrelated texts without an id all stay; a copy among them goes, as does one of a row with an id."""
    a, b, c, d = map(_text, "abcd")
    docs = _rows(spark, [(None, a), (None, b), (None, c), (None, c + " tail"), (None, c), (9, d), (None, d + " tail"), (None, "")])
    got = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert len(got) == 5 and {(None, a), (None, b), (9, d), (None, "")} <= set(got)
    assert sum(t.startswith(c) for _, t in got) == 1


def test_near_copies_of_shared_ids(spark):
    """Rows of one id are groups by their own texts, and the copy of another document goes, not the clean row."""
    a, b, c = map(_text, "abc")
    rows = [(5, a), (5, b), (3, c), (5, c + " tail"), (7, a + " tail"), (5, a)]
    for order in (rows, rows[::-1]):
        got = pipeline.drop_near_copies(spark, _rows(spark, order).repartition(4), SF).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(3, c), (5, a), (5, b)])


def test_mix_repeats_no_document_more_than_three_times(stages):
    _, before, after = stages[3]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert after.join(before, "doc_id", "left_anti").count() == 0


def _source_words(spark, ids):
    """Words per source that the stage keeps, with the source's target, for given ids of the rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS).withColumn("doc_id", ids)
    got = pipeline.mix_sources(spark, docs, SF).collect()
    rows, _ = mixing.mix_documents(docs.select("doc_id", "text", "source"))
    target = {r["source"]: r["target"] for r in rows.select("source", "target").distinct().collect()}
    words = collections.Counter()
    for r in got:
        words[r["source"]] += len(words_of(r["text"]))
    return words, target, docs, got


@pytest.mark.parametrize("ids", ["null", "shared", "some"])
def test_mix_goes_by_row_not_by_id(spark, ids):
    """Null and shared ids leave every source near its target, like unique ones."""
    column = {"null": F.lit(None).cast("long"), "shared": F.col("doc_id") % 3,
              "some": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))}[ids]
    words, target, docs, got = _source_words(spark, column)
    longest = max(len(words_of(r["text"])) for r in docs.collect())
    plain, _, _, _ = _source_words(spark, F.col("doc_id"))
    for source, goal in target.items():
        # whole rows only, so a source may be off by halves of its rows
        assert abs(words[source] - goal) <= max(0.15 * goal, longest)
    assert abs(sum(words.values()) - sum(plain.values())) <= 0.05 * sum(plain.values())
    copies = collections.Counter((r["doc_id"], r["text"]) for r in got)
    have = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert set(copies) <= set(have) and all(n <= 3 * have[k] for k, n in copies.items())


def test_mix_is_laid_out_in_its_own_order(spark, stages):
    """Any long stretch of the stage's output holds the sources in their shares."""
    _, before, _ = stages[3]
    rows = pipeline.mix_sources(spark, before, SF).select("source", "text", F.spark_partition_id().alias("p")).collect()
    size = [(r["source"], len(words_of(r["text"]))) for r in rows]
    total, share = sum(n for _, n in size), collections.Counter()
    for source, n in size:
        share[source] += n / total
    half, seen = collections.Counter(), 0
    for source, n in size:
        if seen > total / 2:
            break
        half[source] += n
        seen += n
    for source, part in share.items():
        if part > 0.1:
            assert abs(half[source] / seen - part) < 0.5 * part


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, name, tmp_path):
    """Nulls in any column, empty and very long texts, shared ids and copies: no stage stops, and what it keeps it was given."""
    stage = dict(pipeline.STAGES)[name]
    docs = awkward(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source",
                                 F.char_length("text").cast("long").alias("n_chars"))
    stage(spark, docs, SF).write.parquet(str(tmp_path / "out"))
    after = spark.read.parquet(str(tmp_path / "out"))
    assert stage(spark, docs.where("false"), SF).count() == 0
    if name in ("toxicity", "n-gram jaccard", "source mix"):
        given = {(r["doc_id"], r["text"]) for r in docs.collect()}
        assert {(r["doc_id"], r["text"]) for r in after.collect()} <= given
    if name == "line dedup":
        assert after.count() == docs.count()
    if name == "packing":
        assert after.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()


def test_packing_takes_every_document(stages):
    _, before, after = stages[4]
    whole = after.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where(F.col("n") % F.col("doc_tokens") != 0)
    assert whole.count() == 0
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_run_equals_the_stages(spark, stages):
    got = pipeline.run(spark, SF).groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()
    want = stages[-1][2].groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))

import json
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from aeroquant.schemas import CONTROL_SCHEMA, FEATURE_SCHEMA, WEATHER, SchemaError, check_model_columns, conform, drop_leakage, model_features
from aeroquant.schemas import MODEL_NUMERIC, MODEL_POOLED
from aeroquant.sources import landed, sinks
from helpers import column


def test_read_or_none(spark, tmp_path):
    assert landed.read_or_none(spark, str(tmp_path / "absent"), "a int") is None
    spark.range(3).selectExpr("cast(id as int) a", "double('NaN') x").write.parquet(str(tmp_path / "t"))
    df = landed.read_or_none(spark, str(tmp_path / "t"), "a int, x double")
    assert df.count() == 3 and df.where("x is null").count() == 3


def test_damaged_file_is_an_error(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(3).coalesce(1).write.parquet(str(path))
    (path / "part-bad.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        landed.read_or_none(spark, str(path), "id bigint").count()
    assert landed.read_or_none(spark, str(tmp_path / "none"), "id bigint") is None


def test_chunk_names_with_blanks_and_signs(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "a b%.parquet"))
    found = landed.chunk_inventory(spark, str(tmp_path), "*.parquet", ["id"]).collect()
    assert [(r.n_rows, r.has_schema, "a b%" in r.path) for r in found] == [(5, True, True)]


def test_chunk_inventory(spark, tmp_path):
    one = lambda df, name: df.coalesce(1).write.parquet(str(tmp_path / name))
    one(spark.range(4).withColumn("airport", F.lit("A")), "full.parquet")
    one(spark.range(0).withColumn("airport", F.lit("A")), "empty.parquet")
    one(spark.range(2), "narrow.parquet")
    chunks = landed.chunk_inventory(spark, str(tmp_path), "*.parquet", ["id", "airport"])
    rows = {r.path.split("/")[-2]: (r.n_rows, r.has_schema) for r in chunks.collect()}
    assert rows == {"full.parquet": (4, True), "empty.parquet": (0, True), "narrow.parquet": (2, False)}
    assert landed.valid_chunks(chunks, "arrivals").count() == 3
    assert landed.valid_chunks(chunks, "weather").count() == 1
    assert tuple(landed.inspect_chunks(chunks).first()) == (3, 1, 0, 2, 6)


@pytest.mark.parametrize("probed", [landed.PROBED_BYTES, 0])
def test_damaged_files_are_counted_and_the_rest_is_read(spark, tmp_path, monkeypatch, probed):
    """Also where every file is too large to be read as one value."""
    monkeypatch.setattr(landed, "PROBED_BYTES", probed)
    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "good.parquet"))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not parquet at all PAR1")
    part = next((tmp_path / "good.parquet").glob("part-*.parquet"))
    whole = part.read_bytes()
    (tmp_path / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "zero.parquet").write_bytes(b"")
    (tmp_path / "page.parquet").write_bytes(whole[:4] + b"\xff" * 24 + whole[28:])
    rows, inventory = landed.read_tolerant(spark, str(tmp_path), "id bigint")
    status = {r.path.rsplit("/", 1)[1] if "part-" not in r.path else r.path.split("/")[-2]: r.status for r in inventory.collect()}
    assert status == {"good.parquet": "with_data", "none.parquet": "empty", "bad.parquet": "unreadable",
                      "cut.parquet": "unreadable", "page.parquet": "unreadable", "zero.parquet": "unreadable"}
    assert landed.inspect_chunks(inventory).first().n_unreadable == 4
    assert sorted(column(rows, "id")) == list(range(6))


@pytest.mark.parametrize("probed", [landed.PROBED_BYTES, 0])
def test_files_of_maps_and_fine_times_are_readable(spark, tmp_path, monkeypatch, probed):
    """Either way of reading decodes every kind of column."""
    monkeypatch.setattr(landed, "PROBED_BYTES", probed)
    table = pa.table({"at": pa.array([1, 2], pa.timestamp("ns")), "m": pa.array([[("a", 1)], []], pa.map_(pa.string(), pa.int64()))})
    pq.write_table(table, tmp_path / "odd.parquet")
    (found,) = landed.probe_files(spark, str(tmp_path)).collect()
    assert (found.status, found.n_rows, found.columns) == ("with_data", 2, ["at", "m"])


PROBE = """
import sys, pyarrow as pa, pyarrow.parquet as pq
from aeroquant.sources import landed
content = open(sys.argv[1], "rb").read()
batch = pa.RecordBatch.from_pydict({"path": ["p"], "length": pa.array([len(content)], pa.int64()), "content": [content]})
(found,) = landed._probe(iter([batch]))
print(found.to_pylist()[0]["n_rows"], pa.default_memory_pool().max_memory() >> 20)
"""


def test_a_probe_holds_few_rows_at_a_time(tmp_path):
    """A row group that is large once decoded is read piece by piece."""
    pq.write_table(pa.table({"t": ["x" * 1000] * 200_000}), tmp_path / "t.parquet", row_group_size=200_000, store_schema=False)
    told = subprocess.run([sys.executable, "-c", PROBE, str(tmp_path / "t.parquet")], capture_output=True, text=True, check=True,
                          cwd=Path(landed.__file__).parents[2])
    n_rows, most = map(int, told.stdout.split())
    assert n_rows == 200_000 and most < 50
    assert landed.PROBED_BYTES <= 64 << 20  # the tasks of an executor hold such files at once


def test_a_chunk_is_valid_by_its_own_columns(spark, tmp_path):
    """A column that is null in every row is there, one that the file lacks is not."""
    hours = spark.range(6).selectExpr("id", "cast(null as double) as cape")
    hours.coalesce(1).write.parquet(str(tmp_path / "nulls.parquet"))
    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "lacks.parquet"))
    chunks = landed.valid_chunks(landed.chunk_inventory(spark, str(tmp_path), "*.parquet", ["id", "cape"]), "weather")
    assert [r.path.split("/")[-2] for r in chunks.collect()] == ["nulls.parquet"]


def test_date_from_file_path(spark, tmp_path):
    for d in ("2025-01-02", "2025-01-03"):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / f"arrivals_LGTS_{d}_{d}.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "notes.parquet"))
    out = landed.with_file_date(landed.read_landed(spark, str(tmp_path), "id bigint"))
    assert sorted(column(out, "flight_date")) == ["2025-01-02"] * 2 + ["2025-01-03"] * 2


def test_pattern_prunes_files(spark, tmp_path):
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "a"))
    assert landed.read_landed(spark, str(tmp_path), "id bigint", "*.nothing").count() == 0


def test_flight_records(spark):
    payload = json.dumps([{"icao24": "a", "firstSeen": 1, "lastSeen": 2, "extra": True}, {"icao24": "b"}])
    df = spark.createDataFrame([(payload,), ("[]",)], "p string")
    out = landed.flight_records(df, "p").collect()
    assert [(r.icao24, r.firstSeen, r.lastSeen) for r in out] == [("a", 1, 2), ("b", None, None)]


def test_hourly_payload(spark):
    good = json.dumps({"hourly": {"time": ["2026-01-01T00:00", "2026-01-01T01:00"], "temperature_2m": [1.0, None]}})
    df = spark.createDataFrame([("A", good)], "airport string, p string")
    out = landed.inline_hourly(landed.parse_weather_payload(df, "p"), WEATHER, "airport").collect()
    assert [(str(r.time), r.temperature_2m, r.cape) for r in out] == [("2026-01-01 00:00:00", 1.0, None), ("2026-01-01 01:00:00", None, None)]


@pytest.mark.parametrize("bad", ["{}", '{"hourly": {}}', '{"hourly": {"time": []}}'])
def test_payload_without_hours_fails(spark, bad):
    df = spark.createDataFrame([("A", bad)], "airport string, p string")
    with pytest.raises(Exception, match="without hourly time"):
        landed.inline_hourly(landed.parse_weather_payload(df, "p"), WEATHER, "airport").collect()


def test_only_new_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(rows, "route string, v int")
    sinks.write_partitions(frame(("a", 1), ("b", 1)), path, ["route"])
    sinks.write_partitions(frame(("b", 2)), path, ["route"])
    sinks.write_partitions(frame(("b", 3)).limit(0), path, ["route"])
    assert {r.route: r.v for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 2}


def test_stage_log_upsert(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.load_stage_stats(spark, path).count() == 0
    df = spark.createDataFrame([(2, "x"), (1, None), (3, "z"), (4, "w")], "a int, b string")
    sinks.record_stage_stats(df.limit(1), "1_first", path, ["a"])
    sinks.record_stage_stats(df, "2_second", path, ["a"])
    sinks.record_stage_stats(df, "1_first", path, ["a"], extra="{}")
    rows = sinks.load_stage_stats(spark, path).orderBy("stage").collect()
    assert [(r.stage, r.n_rows, r.n_cols, r.extra) for r in rows] == [("1_first", 4, 2, "{}"), ("2_second", 4, 2, None)]
    assert rows[0].null_rates_pct == {"b": 25.0} and rows[0].columns == ["a", "b"]
    assert [s["a"] for s in rows[0].sample_rows] == ["1", "2", "3"]


def test_manifest_of_files(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.bin").write_bytes(b"abc")
    (tmp_path / "sub" / "a b%.bin").write_bytes(b"z" * 100_001)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "manifest.json").write_text("{}")
    monkeypatch.setattr(sinks, "BLOCK_BYTES", 1000)
    want = sorted((hashlib.sha256(x).hexdigest(), len(x)) for x in (b"abc", b"z" * 100_001, b""))
    rows = sinks.file_manifest(spark, str(tmp_path)).collect()
    assert sorted((r.sha256, r.size_bytes) for r in rows) == want
    # a store that Python cannot open
    (tmp_path / "empty.bin").unlink()
    want = [w for w in want if w[1]]
    monkeypatch.setattr(sinks, "_hash_files", lambda batches: (b.drop_columns(["length"]).append_column(
        "sha256", pa.nulls(b.num_rows, pa.string())).append_column("size_bytes", b.column("length")) for b in batches))
    rows = sinks.file_manifest(spark, str(tmp_path)).collect()
    assert sorted((r.sha256, r.size_bytes) for r in rows) == want


def test_partitions_are_rebalanced(spark, tmp_path):
    """One hot date is split into several files, small dates are one file each."""
    path = str(tmp_path / "t")
    rows = spark.range(0, 200_000, numPartitions=16).select(
        F.when(F.col("id") % 20 < 17, "2024-01-01").otherwise(F.concat(F.lit("2024-02-0"), F.col("id") % 20 - 16)).alias("d"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"), "id",
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.write_partitions(rows, path, ["d"], order=["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    hot = files.pop("d=2024-01-01")
    assert hot > 3 and max(files.values()) <= 2 and spark.read.parquet(path).count() == 200_000


def test_tier_manifest_document(spark, tmp_path):
    good = {"production": {"model_path": "m", "preprocessing_path": "p"}}
    doc = {"route": "r", "all_carriers": {"trained": True, "quantiles": {"0.5": good, "0.9": {"production": {"model_path": "m"}}, "bad": good}},
           "by_carrier": {"carriers": {"AEE": {"trained": False, "quantiles": {"0.5": good}}, "DLH": {"trained": True, "quantiles": {"0.95": good}}}}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    rows = sinks.read_manifest_json(spark, str(tmp_path / "m.json")).collect()
    assert sorted((r.tier, r.quantile) for r in rows) == [("DLH", 0.95), ("all_carriers", 0.5)]


def test_conform_and_model_columns(spark):
    out = conform(spark.createDataFrame([("a", 1)], "icao24 string, extra int"), FEATURE_SCHEMA)
    assert out.schema == FEATURE_SCHEMA and out.first().icao24 == "a"
    assert sorted(model_features(out)) == sorted(MODEL_NUMERIC)
    assert "route" not in drop_leakage(out).columns
    check_model_columns(MODEL_POOLED, True)
    with pytest.raises(SchemaError):
        check_model_columns(MODEL_POOLED, False)
    with pytest.raises(SchemaError):
        check_model_columns(list(reversed(MODEL_NUMERIC)), False)
    with pytest.raises(SchemaError, match="dep_cape"):
        model_features(out.drop("dep_cape"))
    assert [f.name for f in CONTROL_SCHEMA] == ["route", "stage", "status", "updated_utc", "error"]

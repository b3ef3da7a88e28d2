"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a generated method above 8000 bytes is never compiled by the JVM; wide
    # stages run two to three times faster as separate operators
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator here relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "aeroquant", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="aeroquant-"))
        current = context.getCheckpointDir()
    return current


_scope: ContextVar[str] = ContextVar("scope", default="shared")


def staging_root(spark: SparkSession) -> str:
    """Where staged tables of the current scope lie."""
    return f"{checkpoint_dir(spark)}/aeroquant/{_scope.get()}"


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Staged tables of a job lie in a folder of their own, which is removed when the job ends.

    What the job returns must be written, or read to its end, inside.
    """
    token = _scope.set(f"run-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _scope.reset(token)


def cut_lineage(df: DataFrame, slot: str | None = None) -> DataFrame:
    """Write to the shared folder and read back.

    A lost executor then costs no recompute, and the plan that follows knows the
    true size of the table, which decides its joins. A loop passes alternating
    ``slot`` names, so that it keeps two copies and not one per step.
    """
    path = f"{staging_root(df.sparkSession)}/{slot or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(small: DataFrame) -> DataFrame:
    """Store a small derived table before joining a large one with it.

    Spark cannot tell the size of an aggregate in advance, so it would shuffle the
    large side too. Once stored, the size is known: below the broadcast threshold
    of the session the table is broadcast, above it the join shuffles.
    """
    return cut_lineage(small)

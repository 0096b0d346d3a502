"""Session helper and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", *, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallymark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        # Plans are built from many expressions; skip a stack trace for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting falls back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


#: Bytes beyond which HotSpot compiles no method (its flag DontCompileHugeMethods).
HUGE_METHOD = 8_000


def keep_methods_compiled(spark: SparkSession) -> None:
    """Have Spark run a stage operator by operator where its generated method would be interpreted.

    Rules and metrics are long expressions; fused into one method they pass HotSpot's
    limit, Spark's own stands at 65,535, and every row then goes through the interpreter.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > HUGE_METHOD:
        spark.conf.set(name, str(HUGE_METHOD))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files behind: Spark removes them as each write ends.

    Otherwise they stay until the driver collects garbage, which a long run of writes need
    not live to see, and the disk holds what all of them shuffled.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stage(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``frame`` as a Parquet table in the shared folder and read it back.

    For results read several times: unlike a cache it survives lost executors, and
    each reader still prunes columns and pushes filters into the scan. Also for small
    results of large shuffles, which a write frees. ``options`` are those of the writer.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        frame.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

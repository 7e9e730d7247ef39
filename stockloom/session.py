"""Session helpers: tuning, checkpoints, scratch space and size-checked broadcasts.

Nothing here hides Spark.  The helpers answer three questions that recur in every
operator: where may intermediate data be written, how is a long lineage cut so
that a lost executor does not replay it, and is a side small enough to broadcast.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes above which a join side is left to the shuffle join.
SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20


def build_session(app: str = "stockloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master without that
    setting (tests, a laptop) gets a private temporary folder: executors elsewhere
    could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="stockloom-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path beside the checkpoints, for tables handed between jobs."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_setting = threading.Lock()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written rows.

    The shuffles that led to them are not read again, so Spark is told to drop their files at once
    and not when the driver happens to collect garbage.  Only this plan is: the setting is taken
    over when a frame is made.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    with _setting:
        before = spark.conf.get(_CLEAN, None)
        spark.conf.set(_CLEAN, "true")
        try:
            own = df.select("*")
        finally:
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return own.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its measured rows and bytes are within bounds.

    The rows are kept while they are counted, so the check does not run the
    upstream plan twice.  Beyond the limit the frame comes back without a hint
    and Spark uses a shuffle join.
    """
    kept = df.persist()
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(0))
    size = kept.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
    if size["rows"] <= max_rows and (size["bytes"] or 0) <= SMALL_BYTES:
        return F.broadcast(kept)
    return kept

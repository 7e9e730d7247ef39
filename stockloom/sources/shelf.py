"""Results kept by the content of their inputs, so that a broken run goes on where it stopped.

A shelf is a folder beside the checkpoints, named by a fingerprint of the rows that went in.
Tables and fitted models are put on it under a name once; whoever asks again, in this run or a
later one over the same rows, reads what is there.  Changed rows make another shelf.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.session import checkpoint_dir

T = TypeVar("T")
U = TypeVar("U")


def fingerprint(df: DataFrame) -> str:
    """Digest of all rows whatever their order: their number and the sum of their hashes."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("h")).first()
    text = json.dumps([df.schema.simpleString(), row["n"], str(row["h"])])
    return hashlib.sha256(text.encode()).hexdigest()[:24]


class Shelf:
    """Named tables and models over one input."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def of(cls, df: DataFrame, folder: str | None = None, about: str = "") -> "Shelf":
        """The shelf of these rows, in ``folder`` or beside the checkpoints.

        ``about`` names what else the results depend on: settings, a release of the code, a session.
        """
        spark = df.sparkSession
        name = "-".join(["shelf", fingerprint(df), *([hashlib.sha256(about.encode()).hexdigest()[:12]] if about else [])])
        return cls(spark, f"{(folder or checkpoint_dir(spark)).rstrip('/')}/{name}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        """Whether ``name`` was written to its end; Spark marks that when a write is committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name``, made and written when it is not there yet."""
        if not self.has(name):
            make().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def model(self, name: str, fit: Callable[[], T], load: Callable[[SparkSession, str], T]) -> T:
        """The model ``name``; ``fit`` gives something with ``save(path)`` when it is not there yet.

        The contract is written after the model, so a half-saved one is not taken for a whole.
        """
        if not self.has(f"{name}/contract"):
            fit().save(self.path(name))
        return load(self.spark, self.path(name))


def side_by_side(work: Callable[[T], U], items: Iterable[T], spark: SparkSession, at_once: int = 3) -> list[U]:
    """``work`` of every item, a few at a time, each in a scheduler pool of its own.

    Iterative fits are many short jobs that leave a cluster idle in between; a few of them fill
    the gaps.  The rows stay in Spark; a thread only submits jobs.
    """

    def run(numbered: tuple[int, T]) -> U:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{numbered[0] % at_once}")
        return work(numbered[1])

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), enumerate(items)))


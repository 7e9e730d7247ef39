"""Staged publication: readers see a whole run or the one before, never a part of either (PNL-6, QRY-4).

A run writes its tables into a folder of its own, checks the rows that were written against
their contracts, and only then appends one row file to the manifest.  Spark commits that file
by a rename, so the switch is one step; a run that fails before it leaves nothing that a reader
could find.  A run may name tables of an earlier version instead of writing them again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.contracts import Contract, validate

MANIFEST = "version long, run string, name string, path string, rows long, inputs string, published_at timestamp"


class Publication:
    """The versions of a set of tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        """One row for each table of each version; empty before the first."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def entries(self, version: int | None = None) -> dict[str, dict]:
        """Manifest rows of one version (the last) by table name: a dozen rows.

        If two runs published the same version at once, the one with the greater run id counts.
        """
        rows = self.manifest()
        if version is not None:
            rows = rows.where(F.col("version") == version)
        last = rows.agg(F.max(F.struct("version", "run")).alias("k")).first()["k"]
        if last is None:
            return {}
        of = rows.where((F.col("version") == last["version"]) & (F.col("run") == last["run"]))
        return {r["name"]: r.asDict() for r in of.collect()}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.entries(version).get(name)
        if entry is None:
            raise FileNotFoundError(f"'{name}' is not published under {self.folder}")
        return self.spark.read.parquet(entry["path"])

    def stage(self) -> "Stage":
        return Stage(self)


class Stage:
    """A run in the making; nothing of it is visible before :meth:`publish`."""

    def __init__(self, publication: Publication):
        self.to, self.run = publication, uuid.uuid4().hex
        self.paths: dict[str, tuple[str, int]] = {}

    def put(self, name: str, df: DataFrame, contract: Contract | None = None, partition: str | None = None) -> DataFrame:
        """Write ``df`` to the stage, check the written rows, and go on from them."""
        path = f"{self.to.folder}/versions/{self.run}/{name}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        back = self.to.spark.read.schema(df.schema).parquet(path)
        if contract is not None:
            validate(back, contract)
        self.paths[name] = (path, back.count())
        return back

    def reuse(self, entries: dict[str, dict]) -> None:
        """Name tables of an earlier version in this one."""
        self.paths.update({n: (e["path"], e["rows"]) for n, e in entries.items()})

    def path(self, name: str) -> str:
        """Where something that is not a table, such as a model, may be put; see :meth:`note`."""
        return f"{self.to.folder}/versions/{self.run}/{name}"

    def note(self, name: str, path: str) -> None:
        self.paths[name] = (path, 0)

    def publish(self, inputs: str = "") -> int:
        """Make the stage the current version; ``inputs`` says what it was made from."""
        before = self.to.entries()
        version = 1 + max((e["version"] for e in before.values()), default=0)
        rows = [(version, self.run, n, p, c, inputs) for n, (p, c) in sorted(self.paths.items())]
        frame = self.to.spark.createDataFrame(rows, "version long, run string, name string, path string, rows long, inputs string")
        frame.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.to.folder}/manifest")
        return version

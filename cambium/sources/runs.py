"""Transactional store of a long run: parts by step, checkpoints, and manifests that make them count.

A part (merges, records, evaluations, states) is a Parquet folder for each
step. Nothing counts until a manifest names its step: a small JSON file with
the run's state, written under another name and renamed last, which is atomic
on the cluster's file systems. After a failure, whatever is later than the
last manifest is deleted and computed again, also in the middle of a step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunStore:
    """The folder ``root`` of one run; it must be one that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        where = self._path(f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def put(self, name: str, step: int, df: DataFrame) -> DataFrame:
        """Write a part and read it back; one left by a failed attempt is replaced."""
        path = f"{self.root}/{name}/step={step:08d}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def part(self, name: str, step: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/step={step:08d}")

    def parts(self, name: str) -> DataFrame | None:
        """All committed rows of a part, with their step; None if there are none."""
        last = self.latest()
        steps = [] if last is None else [s for s in self.steps(name) if s <= last[0]]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/step={s:08d}" for s in steps]) if steps else None

    def steps(self, name: str) -> list[int]:
        return [int(x.removeprefix("step=")) for x in self._list(name) if x.startswith("step=")]

    def commit(self, step: int, state: dict) -> None:
        """Make everything up to ``step`` count."""
        made = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps({"step": step, "state": state}, sort_keys=True).encode()))
        out.close()
        if not self._fs.rename(made, self._path(f"{self.root}/manifests/{step:08d}.json")):
            raise OSError(f"step {step} of {self.root} is committed already")

    def latest(self) -> tuple[int, dict] | None:
        """The last committed step and the run's state then."""
        names = [n for n in self._list("manifests") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return None
        text = self.spark.read.text(f"{self.root}/manifests/{names[-1]}", wholetext=True).first()[0]
        read = json.loads(text)
        return int(read["step"]), read["state"]

    def drop(self, name: str, step: int) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}/step={step:08d}"), True)

    def resume(self, names: list[str]) -> tuple[int, dict] | None:
        """The last committed step, after deleting what later attempts left of the named parts."""
        last = self.latest()
        for name in names:
            for s in self.steps(name):
                if last is None or s > last[0]:
                    self.drop(name, s)
        return last

    def delete(self) -> None:
        self._fs.delete(self._path(self.root), True)


def committed_ledger(store: RunStore) -> DataFrame | None:
    """(microstep, survivor, removed) of a run's committed merges."""
    merges = store.parts("merges")
    return None if merges is None else merges.select(F.col("step").cast("int").alias("microstep"), "survivor", "removed")

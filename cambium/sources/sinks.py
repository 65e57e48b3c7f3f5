"""Sinks: tables, append-only ledgers with resume, graph text, content digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with zstd; a failed write leaves no table."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_text_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", "true").option("sep", sep).csv(path)


class Ledger:
    """An append-only record of a flow: steps, merges, and label checkpoints, by sample.

    Every step's rows carry the step, so a step that was written twice after a
    failure shows and is read once; a checkpoint counts once its write is
    committed.
    """

    def __init__(self, spark: SparkSession, path: str, sample: str):
        self.spark, self.path, self.sample = spark, path.rstrip("/"), sample

    def _append(self, df: DataFrame, part: str) -> None:
        df.withColumn("sample", F.lit(self.sample)).write.mode("append").partitionBy("sample").option("compression", "zstd").parquet(f"{self.path}/{part}")

    def step(self, record: dict, merges: DataFrame) -> None:
        self._append(merges, "merges")
        row = json.dumps(record, sort_keys=True)
        self._append(self.spark.range(1).select(F.lit(int(record["step"])).alias("step"), F.lit(row).alias("record")), "steps")

    def checkpoint(self, step: int, labels: DataFrame) -> None:
        labels.withColumns({"step": F.lit(step), "sample": F.lit(self.sample)}).write.mode("append").partitionBy("sample", "step").option("compression", "zstd").parquet(f"{self.path}/labels")

    def latest(self) -> tuple[int, DataFrame] | None:
        """The last checkpoint of this sample."""
        try:
            all_ = self.spark.read.parquet(f"{self.path}/labels").where(F.col("sample") == self.sample)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        step = all_.agg(F.max("step")).first()[0]
        return None if step is None else (int(step), all_.where(F.col("step") == step).select("cell", "node"))

    def merges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/merges").where(F.col("sample") == self.sample).drop("sample").distinct()

    def steps(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/steps").where(F.col("sample") == self.sample).select("step", "record").distinct()


def graph_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document of nodes (id, label) and edges (src, dst), in order."""
    esc = lambda x: F.replace(F.replace(F.replace(x.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="UTF-8"?>'), (1, "", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><graph edgedefault="directed">'), (4, "", "</graph></graphml>")], "part int, k string, line string")
    n = nodes.select(F.lit(2).alias("part"), F.col("id").cast("string").alias("k"), F.format_string('<node id="%s"><data key="label">%s</data></node>', esc(F.col("id")), esc(F.col("label"))).alias("line"))
    e = edges.select(F.lit(3).alias("part"), F.concat_ws("|", "src", "dst").alias("k"), F.format_string('<edge source="%s" target="%s"/>', esc(F.col("src")), esc(F.col("dst"))).alias("line"))
    return head.unionByName(n).unionByName(e).orderBy("part", "k").select("line")


def row_digest(columns: list[str]) -> Column:
    """sha-256 of a row's values in order; NULL differs from every value."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in columns]), 256)


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: number of rows and a digest of the table as a multiset of rows.

    Row digests are added up modulo 2^128 in two halves, so no order and no
    gathering of rows is needed.
    """
    d = df.select(row_digest(columns or sorted(df.columns)).alias("d"))
    part = lambda a: F.sum(F.conv(F.substring("d", a, 15), 16, 10).cast("decimal(38,0)")) % F.lit(1 << 60).cast("decimal(38,0)")
    s = d.agg(F.count("*").alias("rows"), *[F.coalesce(part(1 + 15 * k), F.lit(0)).alias(f"s{k}") for k in range(4)])
    return s.select("rows", F.sha2(F.concat_ws("-", F.col("rows").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("digest"))


def json_digest(obj) -> str:
    """sha-256 of an object's canonical JSON."""
    return hashlib.sha256(json.dumps(obj, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))

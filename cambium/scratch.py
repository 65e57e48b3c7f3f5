"""Tables written once to the folder that the whole cluster shares.

Lineage is cut by writing a table and reading it back. The folder is
``spark.checkpoint.dir``. Where the session names none, a session on one
machine gets a temporary folder of its own; a cluster gets an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that the innermost ``temporary`` block has written so far.
_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="checkpoints-")
        _OWN[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable where no folder was set."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def written(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` are the Parquet writer's.

    The copy is plain Parquet, so a lost executor costs a reread and never a
    recomputation of what made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cambium/{tag}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    with _shuffles_deleted(spark):
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def written_in_turn(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """Write tables of one schema one after the other and read them back as one; the shuffles of each are gone before the next runs."""
    path = None
    for df in parts:
        if path is None:
            spark, schema, path = df.sparkSession, df.schema, f"{shared_dir(df.sparkSession)}/cambium/{tag}-{uuid.uuid4().hex}"
            if (made := _MADE.get()) is not None:
                made.append(path)
        with _shuffles_deleted(spark):
            df.write.mode("append").options(compression="zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` returned; nothing may read it any more."""
    _delete(df.sparkSession, df._scratch)
    if (made := _MADE.get()) is not None and df._scratch in made:
        made.remove(df._scratch)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the tables written inside the block at its end, but those put into the list it gives.

    Whatever is built on other tables must itself be written by then.
    """
    made: list[str] = []
    stay: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield stay
    finally:
        _MADE.reset(token)
        keep = {df._scratch for df in stay}
        for path in made:
            if path not in keep:
                _delete(spark, path)
        if (outer := _MADE.get()) is not None:
            outer.extend(keep)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files at their end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

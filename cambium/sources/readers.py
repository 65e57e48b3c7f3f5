"""Readers by format, schema inventory, gene sets, ledgers, ordered shards, outlines, sparse matrices."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions.scalars import finite_columns, resolve_columns

#: File endings and how they are read.
FORMATS = {"parquet": ("parquet", {}), "csv": ("csv", {"header": "true"}), "csv.gz": ("csv", {"header": "true"}), "tsv": ("csv", {"header": "true", "sep": "\t"}), "tsv.gz": ("csv", {"header": "true", "sep": "\t"}), "json": ("json", {"multiLine": "true"}), "jsonl": ("json", {}), "orc": ("orc", {}), "txt": ("text", {})}


def read_any(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Read a table by its ending, a projection of it if asked for; NaN and infinities become NULL.

    Text formats need a schema unless all columns may stay strings.
    """
    ending = next((e for e in sorted(FORMATS, key=len, reverse=True) if path.lower().rstrip("/").endswith("." + e)), None)
    if ending is None:
        raise ValueError(f"no reader for {path}")
    kind, options = FORMATS[ending]
    reader = spark.read.format(kind).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return finite_columns(df.select(*columns) if columns else df)


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Columns of a table, from its footer alone."""
    return spark.read.parquet(path).columns


def files_under(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, by the file system Spark uses, in order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []))


def exactly_one(spark: SparkSession, pattern: str) -> str:
    """The one path that matches; none or several is an error."""
    found = files_under(spark, pattern)
    if len(found) != 1:
        raise FileNotFoundError(f"{pattern}: {len(found)} matches")
    return found[0]


def column_inventory(spark: SparkSession, pattern: str, groups: dict[str, list[str]]) -> list[dict]:
    """For each table that matches: which groups of column prefixes it carries."""
    out = []
    for path in files_under(spark, pattern):
        names = column_names(spark, path)
        out.append({"path": path, "columns": len(names)} | {g: sum(any(n.startswith(p) for p in prefixes) for n in names) for g, prefixes in groups.items()})
    return out


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set, member) of a tab-separated gene-set file: name, description, members; shorter lines are left out."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    members = F.explode(F.filter(F.transform(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), lambda m: F.upper(F.trim(m))), lambda m: m != ""))
    return parts.select(F.trim(F.col("p")[0]).alias("set"), members.alias("member")).distinct()


def read_steps(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A ledger of JSON lines."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_landmarks(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """One JSON document a file, with the file's number as landmark_index if it has none."""
    df = (spark.read.schema(schema) if schema else spark.read).option("multiLine", "true").json(folder)
    if "landmark_index" not in df.columns:
        df = df.withColumn("landmark_index", F.regexp_extract(F.input_file_name(), r"(\d+)\.json", 1).cast("int"))
    return df


def read_shards(spark: SparkSession, glob: str, column: str = "microstep") -> DataFrame:
    """Numbered Parquet shards as one table with each row's shard number."""
    df = spark.read.parquet(glob)
    number = F.regexp_extract(F.input_file_name(), r"_(\d+)(?:\.parquet|/)", 1)
    return df if column in df.columns else df.withColumn(column, number.cast("long"))


def read_outlines(df: DataFrame) -> DataFrame:
    """Vertices under standard names (cell_id, x, y), whatever they are called."""
    return resolve_columns(df, {"cell_id": ["cell_id", "cell", "barcode"], "x": ["vertex_x", "x", "x_location"], "y": ["vertex_y", "y", "y_location"]})


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, part, ring order, x, y) of the outer rings of polygons and of every part of multipolygons; other kinds are an error."""
    schema = "features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("features").alias("feature", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(text, "array<array<array<double>>>"))
    many = F.from_json(text, "array<array<array<array<double>>>>")
    bad = F.raise_error(F.concat(F.lit("neither Polygon nor MultiPolygon: "), kind)).cast("array<array<array<array<double>>>>")
    parts = f.select("feature", F.posexplode(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).otherwise(bad)).alias("part", "rings"))
    ring = parts.select("feature", "part", F.posexplode(F.col("rings")[0]).alias("o", "p"))
    return ring.select("feature", "part", "o", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def sampled_rows(df: DataFrame, most: int, total: int, seed: int = 1729) -> DataFrame:
    """A seeded sample of about ``most`` of ``total`` rows: a description of large inputs."""
    return df.sample(min(1.0, most / max(total, 1)), seed)


def sparse_matrix(entries: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Long (row, column, value) with the indices checked against the shape; repeated entries are summed."""
    bad = (F.col("row") < 0) | (F.col("row") >= shape[0]) | (F.col("column") < 0) | (F.col("column") >= shape[1])
    checked = entries.withColumn("row", F.when(bad, F.raise_error(F.lit("index outside the shape")).cast("long")).otherwise(F.col("row")))
    return checked.groupBy("row", "column").agg(F.sum("value").alias("value"))


def specimen_of(path: str, known: dict[str, list[str]]) -> str | None:
    """Specimen whose words all occur in a path; several are an error."""
    low = re.sub(r"[^a-z0-9]+", " ", path.lower())
    found = [s for s, words in known.items() if all(w.lower() in low for w in words)]
    if len(found) > 1:
        raise ValueError(f"{path}: {', '.join(found)}")
    return found[0] if found else None


def specimen_column(path: Column, known: dict[str, list[str]]) -> Column:
    """Specimen whose words all occur in a path, as an expression; several are an error, none is NULL."""
    low = F.regexp_replace(F.lower(path), "[^a-z0-9]+", " ")
    found = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [low.contains(w.lower()) for w in words]), F.lit(s)) for s, words in known.items()]))
    return F.when(F.size(found) > 1, F.raise_error(F.concat(path, F.lit(": "), F.array_join(found, ", "))).cast("string")).otherwise(F.get(found, F.lit(0)))

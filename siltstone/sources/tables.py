"""Scans and sinks. Nothing but Spark's readers and writers touches a path, so every store Spark knows works."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors see; a temporary folder serves only where all runs on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that the driver and all executors see is needed")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh name in the shared folder."""
    return f"{shared_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], keep_bad: bool = False) -> DataFrame:
    """All columns as strings; malformed records are dropped, or kept in the column _bad."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BAD]])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path)
    return rows if keep_bad else rows.filter(F.col(BAD).isNull()).drop(BAD)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = True, missing_ok: bool = False) -> DataFrame:
    """JSON lines (blank ones skipped), or one array of records a file; with missing_ok a path that is not there is an empty table."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def first_value(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the named columns that df has and that is not blank, trimmed."""
    found = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def open_graph(df: DataFrame, prop: str, prefix: str = "metadata/openGraph", n: int = 50) -> Column:
    """The content of the first of n (property, content) column pairs with the property; blank contents count."""
    pairs = [F.struct(F.col(f"`{prefix}/{i}/property`").alias("p"), F.col(f"`{prefix}/{i}/content`").alias("c")) for i in range(n) if f"{prefix}/{i}/property" in df.columns]
    if not pairs:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.array(*pairs), lambda x: x["p"] == prop), F.lit(0))["c"]


def validate_rows(df: DataFrame, url: str = "url", bodies: Sequence[str] = ("html", "text")) -> DataFrame:
    """df with `error`: a missing URL, or no body; null for good rows."""
    body = F.coalesce(*[F.nullif(F.trim(F.col(b)), F.lit("")) for b in bodies if b in df.columns])
    return df.withColumn("error", F.when(F.coalesce(F.trim(F.col(url)), F.lit("")) == "", "missing_url").when(body.isNull(), "missing_body"))


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        rows = batch.column("r").to_pylist()
        if rows:
            lines = [("[" if held is None and i == 0 else "") + r for i, r in enumerate(rows)]
            out = ([held + ","] if held is not None else []) + [x + "," for x in lines[:-1]]
            held = lines[-1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array([held + "]"] if held is not None else [], pa.string())], ["value"])


def write_json(df: DataFrame, path: str, lines: bool = True) -> None:
    """JSON lines, or one JSON array a file, as many as df has partitions; a row is held at a time."""
    if lines:
        df.write.mode("overwrite").json(path)
    else:
        df.select(F.to_json(F.struct(*df.columns)).alias("r")).mapInArrow(_array_lines, "value string").write.mode("overwrite").text(path)


def write_reports(reports: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Each report, a few rows, as one JSON file in a folder of its name; returns the folders."""
    for name, df in reports.items():
        df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in reports]


def embedded(chunks: DataFrame, vectors: DataFrame, key: str, model: str, at: Column, vector: str = "vector") -> DataFrame:
    """The chunks that have a vector, with embedding, dimension, embedded_at and embedding_model."""
    rows = chunks.join(vectors.select(key, F.col(vector).alias("embedding")), key)
    return rows.withColumns({"dimension": F.size("embedding"), "embedded_at": at, "embedding_model": F.lit(model)})


#: The cache's table; by section, so that what is asked or purged by section reads and writes that section's files alone.
CACHE_SCHEMA = "cache_key string, query string, answer string, section string, version string, created_at timestamp, last_used_at timestamp, hit_count long"
CACHE_PARTITIONS = ("section",)


def create_cache(spark: SparkSession, path: str) -> DataFrame:
    """An empty cache table at path, if there is none, and the table as it is."""
    if not _exists(spark, path):
        spark.createDataFrame([], CACHE_SCHEMA).write.partitionBy(*CACHE_PARTITIONS).parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.exists(at)


def recover(spark: SparkSession, path: str) -> None:
    """Puts back the table that a swap_in which was cut off had set aside."""
    (at, fs), (old, _) = _hadoop(spark, path), _hadoop(spark, f"{path.rstrip('/')}.old")
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            fs.rename(old, at)


def swap_in(df: DataFrame, path: str) -> None:
    """Rewrites a table that df may read: to a staging folder first, which then takes its place.

    The old table is set aside, not deleted, until the new one is there: whenever this is cut off, one of the two is whole,
    and recover(), which the next swap_in calls, brings it back.
    """
    spark = df.sparkSession
    recover(spark, path)
    staging = f"{path.rstrip('/')}.staging"
    df.write.mode("overwrite").parquet(staging)
    (at, fs), (new, _), (old, _) = _hadoop(spark, path), _hadoop(spark, staging), _hadoop(spark, f"{path.rstrip('/')}.old")
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, at):
        raise OSError(f"{staging} could not take the place of {path}")
    fs.delete(old, True)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Rows of old with those of new in their place; the columns in keep stay as they were. Of equal keys in new, the last in order wins."""
    if order:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    hit = F.col(f"b.{key}").isNotNull()
    out = []
    for c in old.columns:
        theirs = F.col(f"b.{c}") if c in new.columns else F.lit(None)
        out.append((F.coalesce(F.col(f"a.{c}"), theirs) if c in keep else F.when(hit, theirs).otherwise(F.col(f"a.{c}"))).alias(c))
    return joined.select(*out)


def delete_where(df: DataFrame, *conditions: Column) -> DataFrame:
    """df without the rows for which all conditions hold; none given deletes nothing."""
    if not conditions:
        return df
    both = conditions[0]
    for c in conditions[1:]:
        both = both & c
    return df.filter(~F.coalesce(both, F.lit(False)))


def payload(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields of a vector store's payload; those that df lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])

"""Event tables: idempotent appends, retention, databases, structured files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.files import file_type


def new_rows(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `incoming` whose key is not there yet, one per key."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


#: Up to so many days of incoming rows are named to the scan one by one, beyond it their range is; up to so many keys are held
#: against the files' Bloom filters.
MAX_DAYS, MAX_KEYS = 1000, 100


def _existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        existing = spark.read.schema(schema).parquet(path)
        existing.take(0)
        return existing
    except Exception as e:  # the table doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def append_idempotent(spark: SparkSession, path: str, incoming: DataFrame, key: str = "id", ts: str | None = None) -> None:
    """Append to a Parquet table what it doesn't hold; appending the same rows again changes nothing. Null keys are not
    there yet, ever; of them one row comes in each time.

    With `ts`, a timestamp, the table is kept by day (column `day`): a row is there if its key is there on its day, and only
    the days of the incoming rows are read (`candidates`). `incoming` is evaluated anew for its days, its keys and its rows.
    """
    rows = incoming if ts is None else incoming.withColumn("day", F.to_date(ts))
    existing = _existing(spark, path, rows.schema)
    if ts is None:
        new = incoming.dropDuplicates([key]) if existing is None else new_rows(existing, incoming, key)
        new.write.mode("append").parquet(path)
        return
    new = rows.dropDuplicates([key, "day"])
    if existing is not None:
        same = (F.col("n." + key) == F.col("e." + key)) & F.col("n.day").eqNullSafe(F.col("e.day"))
        new = new.alias("n").join(candidates(existing, rows, key).alias("e"), same, "left_anti")
    # A task writes a file for each of its days; together in a task, a day's rows of an ordinary batch make one file.
    new.repartition("day").write.partitionBy("day").option(f"parquet.bloom.filter.enabled#{key}", "true").mode("append").parquet(path)


def candidates(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """(key, day) of the rows of a table kept by day that incoming rows may repeat. Days are pruned by name or range. Of a small
    batch the keys are pushed to the scan, where files' Bloom filters refuse them; else a semi join leaves what the batch
    names, for which Spark makes a Bloom filter of its own where the table is large."""
    days = [r[0] for r in incoming.select("day").distinct().limit(MAX_DAYS + 1).collect()]
    if len(days) > MAX_DAYS:
        low, high, nulls = incoming.agg(F.min("day"), F.max("day"), F.count_if(F.col("day").isNull())).first()
        within = F.col("day").between(low, high) | (F.col("day").isNull() if nulls else F.lit(False))
    else:
        within = F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False))
    found = existing.where(within).select(key, "day")
    keys = [r[0] for r in incoming.select(key).where(F.col(key).isNotNull()).distinct().limit(MAX_KEYS + 1).collect()]
    if len(keys) > MAX_KEYS:
        return found.join(incoming.select(key).distinct(), key, "left_semi")
    some = F.lit(False)
    for k in keys:
        some = some | (F.col(key) == F.lit(k))
    return found.where(some)


def retained(events: DataFrame, days: int, now, ts: str = "timestamp") -> DataFrame:
    """Rows not older than `days`."""
    return events.where(F.col(ts) >= F.lit(now) - F.expr(f"interval {int(days)} days"))


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; filters and columns are pushed down. `partition` is (column, low, high, parts):
    reads run side by side over its ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def _head(path: str, size: int) -> bytes:
    """The first bytes of a file, wherever pyarrow finds it."""
    from pyarrow import fs

    if path.startswith("file:"):
        files, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        return f.read_at(size, 0)


def read_heads(spark: SparkSession, path: str, size: int = 512, opener: Callable[[str, int], bytes] = _head) -> DataFrame:
    """(path, length, head) of files: Spark lists them, and each task reads `size` bytes of its own, so that memory doesn't
    depend on their lengths. Spark lists no empty files. `opener` reads from stores that pyarrow doesn't know."""

    @F.pandas_udf("binary")
    def heads(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: opener(p, size))

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return listed.withColumn("head", heads("path"))


def read_typed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, file_type) of binary files by their first bytes."""
    return read_heads(spark, path).select("path", "length", file_type(F.col("head")).alias("file_type"))


def read_format(spark: SparkSession, path: str, kind: str, schema: T.StructType, row_tag: str = "row") -> DataFrame:
    """Structured files: json (lines), xml (rows by tag) or yaml (documents, parsed in Arrow)."""
    if kind == "json":
        return spark.read.schema(schema).json(path)
    if kind == "xml":
        return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    if kind != "yaml":
        raise ValueError(f"no format {kind!r}; there are json, xml and yaml")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def documents(s: pd.Series) -> pd.Series:
        import json

        import yaml

        return s.map(lambda t: [json.dumps(d, default=str) for d in yaml.safe_load_all(t) if d is not None], na_action="ignore")

    texts = spark.read.option("wholetext", True).text(path)
    return texts.select(F.explode(documents("value")).alias("j")).select(F.from_json("j", schema).alias("r")).select("r.*")


def memory_source(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def send_lines(lines: DataFrame, send: Callable[[list[str]], None], batch: int = 500) -> None:
    """Hand the lines of each partition to `send`, `batch` at a time, on the executors."""

    def run(rows) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r[0])
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    lines.foreachPartition(run)

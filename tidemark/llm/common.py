"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A lambda variable cannot be inlined again by the optimizer, unlike a
    projected column.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it. Only a session on one
    machine, as in tests, may go without: it gets a folder under the warehouse.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it."""
    return written(df, name)[0]


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that no later job reads."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def repeatable(df: DataFrame) -> bool:
    """Whether ``df`` gives the same rows in the same order whenever it is evaluated.

    True of deterministic projections and filters of files. Shuffles, Python
    functions and other sources may give another order when a task runs again.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    if not node.deterministic():
        return False
    while node.getClass().getSimpleName() in ("Project", "Filter"):
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation"


class Scratch:
    """Intermediate tables of one operator; ``clear`` removes them.

    ``last`` writes what the operator returns and removes all the others.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append(path)
        return out

    def last(self, df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        self.clear()
        return out

    def clear(self) -> None:
        drop_paths(self.spark, *self.paths)
        self.paths = []


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, key: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 among the rows of their key, and ``n``, the key's rows.

    The rows are dealt by ranges of key and order and counted range by range, so
    a key of any size is spread over tasks. Nulls come first; rows that are equal
    in key and order stand in any order.
    """
    ranges = scratch.table(rows.repartitionByRange(partitions(rows), *key, *order).withColumn("part", F.spark_partition_id()), "ranges")
    held = ranges.groupBy(*key, "part").agg(F.count("*").alias("held"))
    whole = Window.partitionBy(*key)
    before = F.coalesce(F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*(F.col(k).alias(f"{k}_of") for k in key), F.col("part").alias("part_of"), before.alias("before"), F.sum("held").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy(*order)) - 1
    match = F.col("part") == F.col("part_of")
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    joined = ranges.withColumn("inside", inside).join(held, match)
    return joined.select(*rows.columns, (F.col("inside") + F.col("before")).alias("pos"), "n")


def crc32_sql(column: str) -> str:
    """DuckDB SQL of the crc32 of a number's decimal text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda r, c: xor(r >> 8, list_reduce(list_prepend(xor(r, c) & 255, CAST(range(8) AS BIGINT[])), lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END))))"""

"""What several operators need."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the folder the cluster names, and read it.

    Unlike a checkpoint of the RDD, the rows are computed once.  A lost executor costs nothing:
    what is read again is on the shared store.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share; in a
    temporary one only where none is named and Spark runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a table that is broadcast; beyond, it is joined by a shuffle.
FEW = 262_144


def few_or_merged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join by equal keys: broadcast if its rows (or what stands for them) are counted as few, else
    joined by a sorted merge.  Spark's own guess takes a row that is exploded for one row, and would send
    the other side, however long it is, to the driver and to all."""
    return F.broadcast(df) if (df.limit(FEW + 1).count() if rows is None else rows) <= FEW else df.hint("merge")


def by_distinct(df: DataFrame, column: str, name: str, rule) -> DataFrame:
    """Rows with ``name``, a rule's answer to a column that is costly and often the same: asked once for each value; null for null."""
    told = checkpointed(df.filter(F.col(column).isNotNull()).select(column).distinct().withColumn(name, rule(F.col(column))))
    return df.join(few_or_merged(told), column, "left")


def numbered(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 over the whole table, sorted in parallel.

    Rows are dealt by ranges of the order; the first number of a range is the count of rows
    before it.  Ranges are cut first, so that both passes see the same ones.
    """
    dealt = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at") - F.shiftleft("__part", 33))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")

"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between these six bytes, which is also what ``bytes.split()`` does.
BLANKS = " \t\n\r\x0b\f"


#: Spark's setting to drop an execution's shuffle files when it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a folder in its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that later steps read more than once to the shared folder, and read it back.

    The files outlive lost executors, give the planner true sizes, and go when the session ends.  The shuffle
    files behind them go at once, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a sieve: 1 MB, whatever the number of ids.
SIEVE_BITS = 1 << 23


def sieve(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` less most of those whose ``column`` isn't among ``ids``; none of the others is lost.

    A hashed bitmap of fixed size goes to all tasks, so that rows nobody asks for stay out of the join that
    follows.  If very many ids are asked for it lets everything pass.
    """
    spark, slot = rows.sparkSession, F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))
    words = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("bits"))
    bits = np.zeros(SIEVE_BITS // 64, dtype=np.int64)
    for r in words.toLocalIterator():
        bits[r["w"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    @F.arrow_udf("boolean")
    def asked(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return rows.where(asked(slot))


def native_sieve(ids: DataFrame) -> Callable[[Column], Column]:
    """A condition that holds for all values of the one column of ``ids``, and for few others.

    The same bitmap as ``sieve``'s, in SQL functions only: its words are one row's array, which reaches the
    tasks as the result of a scalar subquery.
    """
    bits = SIEVE_BITS // 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = ids.select(slot(F.col(ids.columns[0])).alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("bits"))
    every = ids.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left")
    one = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("a"))
    array = written(one.select(F.transform("a", lambda x: x["bits"]).alias("words")), "sieve").scalar()
    word = lambda c: F.get(array, F.floor(slot(c) / 64).cast("int"))
    return lambda c: F.call_function("shiftrightunsigned", word(c), (slot(c) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, the component's smallest node.

    Alternates large-star and small-star steps until the edges stand still; the rounds grow with the
    logarithm of the longest path.  Isolated nodes aren't in the result.  A hub is pre-aggregated
    before its shuffle, and its rows join one row, which adaptive execution may split.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    print_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    before = None
    while (mark := print_of(now)) != before:
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.where("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())

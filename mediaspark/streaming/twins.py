"""Streaming forms: the folds with kept state, and windows, sessions and joins.

A fold keeps one small state per stream in the state store and runs the same
function as the batch operator.  Rows are put in order per stream (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.operators.fold import Fold
from mediaspark.streaming.ordered import fold_ordered

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_reset(fold: Fold, column: str = "disc") -> Fold:
    """A fold whose state is dropped at every row where ``column`` is true."""

    def run(state, cols):
        cuts = [i for i, d in enumerate(cols[column]) if d]
        edges = [0, *[c for c in cuts if c > 0], len(cols[column])]
        total: dict[str, list] = {}
        for a, b in zip(edges, edges[1:]):
            if a in cuts:
                state = None
            state, out = fold(state, {k: v[a:b] for k, v in cols.items()})
            for k, v in out.items():
                total.setdefault(k, []).extend(v)
        return state, total

    return run


def fold_live(df: DataFrame, keys: Sequence[str], order: str, inputs: Sequence[str], fold: Fold, outputs: str, **options) -> DataFrame:
    """The streaming twin of ``fold_stream``: one state per key, kept between batches.

    Frames are folded as they come, in order within a batch; ``options`` make rows wait across batches, see
    ``ordered.fold_ordered``.  Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return fold_ordered(df, keys, order, inputs, fold, outputs, **options)


def progress(df: DataFrame, ts: str, *, every: str = "500 milliseconds", late: str = "10 seconds", keys: Sequence[str] = ()) -> DataFrame:
    """Packets and bytes per half second."""
    w = F.window(ts, every)
    g = df.withWatermark(ts, late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))
    return g.select(*keys, F.col("window.start").alias("start"), "packets", "bytes")


def sliding_rate(df: DataFrame, ts: str, *, span: str = "10 seconds", step: str = "5 seconds", late: str = "10 seconds", keys: Sequence[str] = ()) -> DataFrame:
    """Bytes per second over overlapping spans."""
    g = df.withWatermark(ts, late).groupBy(*keys, F.window(ts, span, step)).agg(F.sum("size").alias("bytes"))
    secs = F.unix_micros("window.end") - F.unix_micros("window.start")
    return g.select(*keys, F.col("window.start").alias("start"), (F.col("bytes") * 1e6 / secs).alias("rate"))


def sessions(df: DataFrame, ts: str, *, gap: str, late: str = "10 seconds", keys: Sequence[str] = ()) -> DataFrame:
    """Runs of packets without a pause of ``gap``."""
    g = df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("packets"))
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "packets")


def skip_preroll(df: DataFrame, *, stop: str = "rt_stop", preroll: str = "preroll") -> DataFrame:
    """Samples that end at or before 0, or are preroll, are never delivered."""
    return df.filter((F.col(stop) > 0) & ~F.col(preroll))


def merge_inputs(parts: Sequence[DataFrame], ts: str, *, late: str = "10 seconds") -> DataFrame:
    """Several live inputs as one; output waits for the slowest input.

    Spark's default policy takes the smallest watermark of all inputs.
    """
    out = None
    for p in parts:
        p = p.withWatermark(ts, late)
        out = p if out is None else out.unionByName(p)
    return out


def live_cues(frames: DataFrame, cues: DataFrame, *, key: str = "stream_id", late: str = "10 seconds", longest: str | None = None) -> DataFrame:
    """Frames with the cues that are shown; a frame is forgotten once no new cue can match.

    ``frames`` has ``t``, ``cues`` has ``start`` and ``stop`` (timestamps); a cue
    without ``stop`` is shown from its start on.  Cues stay in the state as long as
    a frame may come; give ``longest`` where cues are known to last no longer, and
    they are forgotten after that time.
    """
    f = frames.withWatermark("t", late).alias("f")
    c = cues.withColumnRenamed(key, "__k").withWatermark("start", late).alias("c")
    on = (
        (F.col(f"f.{key}") == F.col("c.__k")) & (F.col("f.t") >= F.col("c.start"))
        & (F.col("c.stop").isNull() | (F.col("f.t") < F.col("c.stop")))
    )
    if longest is not None:
        on = on & (F.col("f.t") <= F.col("c.start") + F.expr(f"INTERVAL {longest}"))
    return f.join(c, on).drop("__k")


def warm_up(full: Column, single: Column) -> Column:
    """The many-field result where there is one, else the single-field result."""
    return F.coalesce(full, single)


def drain(df: DataFrame, out: str, checkpoint: str) -> None:
    """Take in all that is there, write it out and stop."""
    q = (
        df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


#: The time of the mark that ends a feed; no window of it ever closes, and pandas can still hold it.
END = "2250-01-01 00:00:00"


def with_end(df: DataFrame, marks: str) -> DataFrame:
    """A feed and the marks that a folder gets when it has ended; see ``end_feed``."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(marks)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(there)
    return df.unionByName(spark.readStream.schema(df.schema).parquet(marks))


def end_feed(df: DataFrame, marks: str, ts: str) -> None:
    """Mark the end of a feed whose rows are all taken in.

    The mark is one row far in the future, with nulls for the rest: the next run's
    watermark passes all windows and sessions, which so come out to the last.
    """
    row = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    df.sparkSession.range(1).select(*row).write.mode("append").parquet(marks)

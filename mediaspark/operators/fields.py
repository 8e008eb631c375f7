"""Fields of interlaced video: splitting, film cadence and output plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from mediaspark.operators.scan import CHUNK_ROWS, anchored_sum, chunk_id, neighbours, running

HINTS = ("AFTERNEXT_32", "NEXT_32", "PREV_32", "NEXT_22", "PREV_22")


def field_split(frames: DataFrame, *, key: str = "stream_id", rows: int = CHUNK_ROWS) -> DataFrame:
    """Two or three fields per frame, parity alternating from the first one.

    Frames have ``rt_start, rt_stop, nb_fields, tff, progressive``; only
    progressive frames carry a hint.  Fields are numbered from 0 per stream.
    """
    numbered = running(frames, [key], "frame_no", {"__n": ("sum", F.col("nb_fields").cast("bigint"))}, include_current=False, rows=rows)
    k = F.col("__k")
    three = F.col("nb_fields") == 3
    hint3 = F.when(k == 0, "AFTERNEXT_32").when(k == 1, "NEXT_32").otherwise("PREV_32")
    hint2 = F.when(k == 0, "NEXT_22").otherwise("PREV_22")
    span = F.col("rt_stop") - F.col("rt_start")
    n = F.when(three, 3).otherwise(2)
    end = F.when(k == n - 1, F.col("rt_stop")).otherwise(
        F.col("rt_start") + F.call_function("div", (k + 1) * span, n)
    )
    out = numbered.withColumn("__k", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.select(
        key, "frame_no", (F.coalesce("__n", F.lit(0)) + k).alias("field_no"),
        (F.col("tff") == (k % 2 == 0)).alias("is_top"),
        F.when(F.col("progressive"), F.when(three, hint3).otherwise(hint2)).alias("hint"),
        end.alias("end_time"),
    )


class SplitFields:
    """Table function: the fields of a stretch of frames that comes in order, numbered from the first row's ``field_no``.

    Rows are ``(stream_id, frame_no, rt_start, rt_stop, nb_fields, tff, progressive, field_no)``.
    """

    def __init__(self):
        self.next = None

    def eval(self, row: Row):
        n = 3 if row["nb_fields"] == 3 else 2
        self.next = row["field_no"] if self.next is None else self.next
        hints = HINTS[:3] if n == 3 else HINTS[3:]
        span = row["rt_stop"] - row["rt_start"]
        for k in range(n):
            # Whole numbers are cut towards 0, as SQL does.
            end = row["rt_stop"] if k == n - 1 else row["rt_start"] + int(math.copysign(abs((k + 1) * span) // n, span))
            yield row["stream_id"], row["frame_no"], self.next + k, row["tff"] == (k % 2 == 0), hints[k] if row["progressive"] else None, end
        self.next += row["nb_fields"]


FIELDS = "stream_id bigint, frame_no bigint, field_no bigint, is_top boolean, hint string, end_time bigint"


def split_fields(frames: DataFrame, *, rows: int = CHUNK_ROWS) -> DataFrame:
    """``field_split`` as the table function ``split_fields`` over a partitioned and ordered table argument.

    A partition is a chunk of a stream, not a stream; its first row brings the number of fields in earlier chunks.
    The function stays registered for SQL: ``SELECT * FROM split_fields(TABLE(t) PARTITION BY ... ORDER BY ...)``.
    """
    spark = frames.sparkSession
    spark.udtf.register("split_fields", F.udtf(SplitFields, returnType=FIELDS))
    chunked = frames.withColumn("chunk", chunk_id("frame_no", rows))
    w = Window.partitionBy("stream_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunked.groupBy("stream_id", "chunk").agg(F.sum(F.col("nb_fields").cast("bigint")).alias("n"))
    counts = counts.select("stream_id", "chunk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("field_no"))
    table = chunked.join(counts, ["stream_id", "chunk"]).select(
        "stream_id", "frame_no", "rt_start", "rt_stop", "nb_fields", "tff", "progressive", "field_no", "chunk"
    )
    return spark.sql("SELECT * FROM split_fields(TABLE(SELECT * FROM {t}) PARTITION BY (stream_id, chunk) ORDER BY frame_no)", t=table)


def cadence_flag(
    frames: DataFrame, *, progressive_sequence: Column | None = None, key: str = "stream_id", order: str = "frame_no",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Film on or off, from the progressive flag and pictures of three fields.

    Whether a row switches depends on it and the row before only, so the state is
    the last switch seen.
    """
    out = neighbours(
        frames, [key], order, 1, 0,
        {"__nf": lambda w: F.lag("nb_fields").over(w), "__pf": lambda w: F.lag("progressive").over(w)}, rows=rows,
    )
    has_last = F.col("__nf").isNotNull()
    three, last3 = F.col("nb_fields") == 3, F.col("__nf") == 3
    whole = F.lit(False) if progressive_sequence is None else progressive_sequence
    event = (
        F.when(whole, True)
        .when(~has_last, F.lit(None))
        .when(F.col("progressive") & three & ~last3, True)
        .when(F.col("progressive") & ~three & ~last3, False)
        .when(~F.col("progressive") & (~last3 | ~F.col("__pf") | (F.col("nb_fields") > 2)), False)
    )
    out = running(out, [key], order, {"film": ("last", event)}, rows=rows)
    return out.withColumn("film", F.coalesce("film", F.lit(False))).drop("__nf", "__pf")


def detect_film(
    fields: DataFrame, *, keys: Sequence[str] = ("stream_id",), order: str = "field_no", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Pulldown state after each field: type and phase index.

    Lock-on and mismatch leave a state that the last five hints determine: 3:2 runs
    AFTERNEXT, NEXT, PREV, then one 2:2 frame, and everything else re-tests at
    once.  So five rows decide and no state is carried.  Needs consecutive numbers.
    """
    cols = {f"__h{i}": (lambda w, i=i: F.lag("hint", i).over(w)) for i in range(1, 5)}
    out = neighbours(fields, keys, order, 4, 0, cols, rows=rows)

    def run(*names: str) -> Column:
        """Hints from this row backwards."""
        c = F.lit(True)
        for i, n in enumerate(names):
            c = c & F.coalesce((F.col("hint") if i == 0 else F.col(f"__h{i}")) == n, F.lit(False))
        return c

    a, n3, p3, n2, p2 = HINTS
    depth = (
        F.when(run(a), 0).when(run(n3, a), 1).when(run(p3, n3, a), 2).when(run(n2, p3, n3, a), 3).when(run(p2, n2, p3, n3, a), 4)
    )
    o = F.col(order)
    out = out.withColumn("__d", depth)
    index = (
        F.when(F.col("__d").isNotNull(), (F.lit(7) - F.pmod(o - F.col("__d"), F.lit(5))) % 5)
        .when(run(n2), F.pmod(o, F.lit(2)))
        .when(run(p2, n2), F.pmod(o - 1, F.lit(2)))
        .otherwise(0)
    )
    kind = F.when(F.col("__d").isNotNull(), "PULLDOWN_32").when(run(n2) | run(p2, n2), "PULLDOWN_22").otherwise("FULLRATE")
    return out.withColumn("cadence", kind).withColumn("cadence_index", index.cast("int")).drop("__d", *cols)


def plan_output(fields: DataFrame, *, order: str = "field_no", delay: int = 1, first: int = 0) -> DataFrame:
    """Weave, deinterlace or skip each field, from its pulldown state."""
    n = F.col(order)
    phase = F.pmod(n + F.col("cadence_index"), F.lit(5))
    kind = F.col("cadence")
    action = (
        F.when(n - first < delay, "IGNORE")
        .when(kind == "PULLDOWN_32", F.when(phase.isin(1, 4), "WEAVE").otherwise("IGNORE"))
        .when(kind == "PULLDOWN_22", F.when(F.pmod(n + F.col("cadence_index"), F.lit(2)) == 1, "WEAVE").otherwise("IGNORE"))
        .when(kind == "HALFRATE", F.when(F.pmod(n, F.lit(2)) == 0, "DEINTERLACE").otherwise("IGNORE"))
        .otherwise("DEINTERLACE")
    )
    return fields.withColumn("action", action)


def frame_method(frames: DataFrame, *, mode: str = "auto") -> DataFrame:
    """Weave progressive or film pictures, bob the others (or as forced)."""
    if mode not in ("auto", "weave", "bob"):
        raise ValueError("mode must be auto, weave or bob")
    auto = F.when(F.col("film") | F.col("progressive"), "weave").otherwise("bob")
    return frames.withColumn("method", auto if mode == "auto" else F.lit(mode))


def fill_frame_times(
    frames: DataFrame, *, avg_time: int, key: str = "stream_id", order: str = "frame_no", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Missing starts continue from the stop before; stop = start + avg * fields / 2."""
    length = F.call_function("div", F.lit(avg_time).cast("bigint") * F.col("nb_fields"), F.lit(2))
    out = anchored_sum(frames, [key], order, "__start", F.col("rt_start"), length, rows=rows)
    return out.withColumn("rt_start", F.col("__start")).withColumn("rt_stop", F.col("__start") + length).drop("__start")

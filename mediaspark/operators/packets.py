"""Packet selection, timestamp repair and packet-level statistics."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions.text import format_value, sexagesimal
from mediaspark.functions.timebase import rescale
from mediaspark.operators.scan import CHUNK_ROWS, anchored_sum, number_sorted, previous, running

STREAM = ("stream_id", "stream_index")
DISCARD_LEVELS = ("none", "nonref", "bidir", "nonkey", "all")


def map_streams(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Choose and renumber streams by ``mapping(stream_index, out_index)``."""
    return df.join(mapping, "stream_index").drop("stream_index").withColumnRenamed("out_index", "stream_index")


def time_slice(
    df: DataFrame, start: int, duration: int, *, ts: str = "dts", order: str = "seq",
    keys: Sequence[str] = STREAM, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows from ``start`` until the first row at or after ``start + duration``.

    Times are re-based to the start.  Rows behind that first late row are dropped
    even when their own time is earlier.
    """
    seen = running(df, keys, order, {"__top": ("max", F.col(ts))}, rows=rows)
    kept = seen.filter((F.col("__top") < start + duration) & (F.col(ts) >= start))
    return kept.drop("__top").withColumn(ts, F.col(ts) - start)


def shift_scale_ts(
    df: DataFrame, offsets: DataFrame, scales: DataFrame, *, columns: Sequence[str] = ("pts", "dts")
) -> DataFrame:
    """``(ts + offset of the file) * scale of the stream``; nulls stay null."""
    out = df.join(offsets, "stream_id", "left").join(scales, "stream_index", "left")
    for c in columns:
        out = out.withColumn(
            c, (F.col(c) + F.coalesce("ts_offset", F.lit(0))) * F.coalesce("ts_scale", F.lit(1))
        )
    return out.drop("ts_offset", "ts_scale")


def discard(df: DataFrame, level: str, *, pict_type: str = "pict_type") -> DataFrame:
    """Drop pictures by type: nonref and bidir drop B, nonkey keeps only I."""
    if level not in DISCARD_LEVELS:
        raise ValueError(f"level must be one of {DISCARD_LEVELS}")
    if level == "none":
        return df
    if level == "all":
        return df.filter(F.lit(False))
    if level == "nonkey":
        return df.filter(F.col(pict_type) == "I")
    return df.filter(F.col(pict_type) != "B")


def wait_for_key(
    df: DataFrame, *, keys: Sequence[str] = ("stream_id",), order: str = "seq", rows: int = CHUNK_ROWS
) -> DataFrame:
    """After the start and after each discontinuity drop rows until a key row."""
    o = F.col(order)
    marks = running(
        df,
        keys,
        order,
        {"__key": ("max", F.when(F.col("is_key"), o)), "__cut": ("max", F.when(F.col("disc"), o))},
        rows=rows,
    )
    ok = F.col("__key").isNotNull() & (F.col("__cut").isNull() | (F.col("__key") >= F.col("__cut")))
    return marks.filter(ok).drop("__key", "__cut")


def cap(
    df: DataFrame, *, max_frames: int | None = None, max_bytes: int | None = None, shortest: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Stop at N packets per stream, at a file size, or with the shortest stream."""
    if max_frames is not None:
        df = running(df, STREAM, "seq", {"__n": ("count", F.lit(1))}, rows=rows)
        df = df.filter(F.col("__n") <= max_frames).drop("__n")
    if max_bytes is not None:
        df = running(df, ["stream_id"], "seq", {"__b": ("sum", F.col("size"))}, include_current=False, rows=rows)
        df = df.filter(F.coalesce("__b", F.lit(0)) < max_bytes).drop("__b")
    if shortest:
        ends = df.groupBy(*STREAM).agg(F.max("dts").alias("__e"))
        ends = ends.groupBy("stream_id").agg(F.min("__e").alias("__e"))
        df = df.join(ends, "stream_id").filter(F.col("dts") <= F.col("__e")).drop("__e")
    return df


def default_stream(streams: DataFrame) -> DataFrame:
    """First video stream, else first audio, else the first one."""
    t = F.col("codec_type")
    rank = F.when(t == "video", 0).when(t == "audio", 1).otherwise(2)
    return streams.groupBy("stream_id").agg(
        F.min_by("stream_index", F.struct(rank.alias("r"), F.col("stream_index").alias("i"))).alias("stream_index")
    )


def skip_empty_audio(df: DataFrame, streams: DataFrame) -> DataFrame:
    """Drop audio packets without payload."""
    audio = streams.select(*STREAM, (F.col("codec_type") == "audio").alias("__a"))
    joined = df.join(audio, list(STREAM), "left")
    return joined.filter(~(F.coalesce("__a", F.lit(False)) & (F.col("size") == 0))).drop("__a")


def repair_timestamps(
    df: DataFrame, *, duration: str = "duration", wrap_bits: int = 33, order: str = "seq",
    keys: Sequence[str] = STREAM, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Timestamps of streams without reordering.

    A decode time later than its presentation time is one wrap too high.  A row
    without any time continues from the last known one by the durations between;
    rows before the first known time start at 0.  Both times are then equal.
    """
    pts, dts = F.col("pts"), F.col("dts")
    fixed = df.withColumn("dts", F.when(dts > pts, dts - F.lit(1 << wrap_bits)).otherwise(dts))
    fixed = fixed.withColumn("__known", F.coalesce(pts, F.col("dts")))
    timed = anchored_sum(fixed, keys, order, "__time", F.col("__known"), F.col(duration), rows=rows)
    return timed.withColumn("pts", F.col("__time")).withColumn("dts", F.col("__time")).drop("__known", "__time")


def backfill_initial(
    df: DataFrame, *, duration: str = "duration", order: str = "seq", keys: Sequence[str] = STREAM,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Give packets ahead of the first known decode time a time counted back from it."""
    d = F.col("dts")
    summed = running(
        df,
        keys,
        order,
        {"__sum": ("sum", F.col(duration)), "__seen": ("max", F.when(d.isNotNull(), 1))},
        include_current=False,
        rows=rows,
    ).withColumn("__sum", F.coalesce("__sum", F.lit(0)))
    ahead = running(
        summed, keys, order, {"__base": ("first", F.when(d.isNotNull(), d - F.col("__sum")))}, reverse=True, rows=rows
    )
    back = F.when(d.isNull() & F.col("__seen").isNull(), F.col("__base") + F.col("__sum")).otherwise(d)
    return ahead.withColumn("dts", back).drop("__sum", "__seen", "__base")


def validate_mux(
    df: DataFrame, *, keys: Sequence[str] = STREAM, order: str = "seq", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Flag packets a muxer refuses: decode time not rising, or pts before dts.

    A refused row does not move the comparison value, so the value is the running
    maximum over rows with ``pts >= dts`` (a row below it cannot raise it).
    """
    valid = F.col("pts").isNull() | (F.col("pts") >= F.col("dts"))
    out = running(
        df, keys, order, {"__top": ("max", F.when(valid, F.col("dts")))}, include_current=False, rows=rows
    )
    falling = F.coalesce((F.col("__top") != 0) & (F.col("__top") >= F.col("dts")), F.lit(False))
    return out.withColumn("non_monotone", falling).withColumn("pts_before_dts", ~valid).drop("__top")


def fix_discontinuity(
    df: DataFrame, threshold: int, *, duration: Column, may_jump: Column | None = None, order: str = "seq",
    keys: Sequence[str] = STREAM, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Shift a packet and all later ones when the decode time jumps.

    The jump is the raw difference to the previous packet less its duration: the
    shift already applied is in both terms and cancels out.
    """
    may = F.lit(True) if may_jump is None else may_jump
    prev = previous(df, keys, order, {"__p": F.col("dts"), "__d": duration}, rows=rows)
    delta = F.col("dts") - F.col("__p") - F.col("__d")
    jump = F.coalesce(may & ((F.abs(delta) > threshold) | (F.col("dts") + 1 < F.col("__p"))), F.lit(False))
    marked = prev.withColumn("jumped", jump).withColumn("__x", F.when(jump, -delta).otherwise(0))
    out = running(marked, keys, order, {"ts_shift": ("sum", F.col("__x"))}, rows=rows)
    return out.withColumn("dts", F.col("dts") + F.col("ts_shift")).drop("__p", "__d", "__x")


def interleave(df: DataFrame, *, time: Column | None = None, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Write order of a multi-stream file: by decode time, stable per stream.

    ``time`` brings all streams to one time base.  Packets without a time come last.
    """
    timed = df.withColumn("__t", F.col("dts") if time is None else time)
    order = [F.col("__t").asc_nulls_last(), F.col("stream_index"), F.col("seq")]
    return number_sorted(timed, keys, order, "pos").drop("__t")


def next_input(heads: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """The input to read next: the one whose waiting packet has the smallest time."""
    return heads.groupBy(*keys).agg(
        F.min_by("stream_index", F.struct("pts", "stream_index")).alias("stream_index"),
        F.min("pts").alias("pts"),
    )


# ---------------------------------------------------------------- statistics


def stream_report(streams: DataFrame, *, num: int = 1, den: int = 1_000_000) -> DataFrame:
    """Probe output per stream: type, times and rate as text, tags as rows of text."""
    secs = lambda c: sexagesimal(F.col(c) * F.lit(num / den))
    known = F.col("codec_type").isin("video", "audio", "data", "subtitle", "attachment")
    out = streams.withColumns({
        "codec_type": F.when(known, F.col("codec_type")).otherwise("unknown"),
        "start_time": secs("start_time"), "duration": secs("duration"),
        "bit_rate": format_value(F.col("bit_rate"), "bit/s", prefix=True),
    })
    if "tags" in streams.columns:
        lines = F.transform(F.map_entries("tags"), lambda e: F.concat(F.lit("TAG:"), e["key"], F.lit("="), e["value"]))
        out = out.withColumn("tags", F.array_join(F.array_sort(lines), "\n"))
    return out


def format_report(containers: DataFrame, streams: DataFrame) -> DataFrame:
    """Probe output per file: stream count, times, size and rate as text."""
    n = streams.groupBy("stream_id").agg(F.count(F.lit(1)).alias("nb_streams"))
    out = containers.join(n, "stream_id", "left")
    return out.select(
        "stream_id", F.coalesce("nb_streams", F.lit(0)).alias("nb_streams"),
        sexagesimal(F.col("start_time") / F.lit(1e6)).alias("start_time"), sexagesimal(F.col("duration") / F.lit(1e6)).alias("duration"),
        format_value(F.col("file_size"), "byte", prefix=True, binary=True).alias("size"),
        format_value(F.col("bit_rate"), "bit/s", prefix=True).alias("bit_rate"),
    )


def container_timings(streams: DataFrame, containers: DataFrame) -> DataFrame:
    """Start, duration and bit rate of a file from its streams (microseconds)."""
    end = F.col("start_time") + F.col("duration")
    g = streams.groupBy("stream_id").agg(
        F.min("start_time").alias("start_time"),
        F.max(end).alias("__end"),
        F.max("duration").alias("__dur"),
    )
    span = F.greatest(F.col("__dur"), F.col("__end") - F.col("start_time"))
    out = g.join(containers, "stream_id", "left").withColumn("duration", span)
    rate = F.when(
        (F.col("file_size") > 0) & (F.col("duration") != 0),
        F.floor(F.col("file_size") * F.lit(8000000.0) / F.col("duration")),
    )
    return out.withColumn("bit_rate", rate).select("stream_id", "start_time", "duration", "bit_rate")


def fill_stream_timings(streams: DataFrame, timings: DataFrame) -> DataFrame:
    """Streams without a start time take start and duration of the file."""
    t = timings.select(
        "stream_id", F.col("start_time").alias("__s"), F.col("duration").alias("__d")
    )
    lacks = F.col("start_time").isNull()
    out = streams.join(t, "stream_id", "left")
    out = out.withColumn("duration", F.when(lacks, F.coalesce("__d", "duration")).otherwise(F.col("duration")))
    return out.withColumn("start_time", F.coalesce("start_time", "__s")).drop("__s", "__d")


def duration_from_bitrate(streams: DataFrame, containers: DataFrame) -> DataFrame:
    """File bit rate (sum of streams unless set) and the durations it implies."""
    total = streams.groupBy("stream_id").agg(F.sum("bit_rate").alias("__total"))
    c = containers.join(total, "stream_id", "left")
    c = c.select(
        "stream_id", "file_size",
        F.when(F.coalesce("bit_rate", F.lit(0)) != 0, F.col("bit_rate")).otherwise(F.col("__total")).alias("file_bit_rate"),
    )
    out = streams.join(c, "stream_id", "left")
    usable = (F.col("file_bit_rate") > 0) & (F.col("file_size") > 0)
    est = F.when(usable, rescale(F.col("file_size") * 8, 1000000, F.when(usable, F.col("file_bit_rate"))))
    return out.withColumn("duration", F.coalesce("duration", est)).drop("file_size")


def duration_from_pts(df: DataFrame, *, wrap_bits: int = 33) -> DataFrame:
    """Longest distance of a presentation time from the stream's first decode time."""
    first = df.groupBy(*STREAM).agg(F.min_by("dts", "seq").alias("start_time"))
    d = F.col("pts") - F.col("start_time")
    d = F.when(d < 0, d + F.lit(1 << wrap_bits)).otherwise(d)
    out = df.join(first, list(STREAM)).groupBy(*STREAM, "start_time").agg(F.max(F.when(d > 0, d)).alias("duration"))
    return out


def stream_bandwidth(streams: DataFrame) -> DataFrame:
    """Audio plus video bit rate per file in kbit/s, rounded up."""
    av = F.col("codec_type").isin("audio", "video")
    total = F.coalesce(F.sum(F.when(av, F.col("bit_rate"))), F.lit(0))
    return streams.groupBy("stream_id").agg(F.expr("CAST(1 AS BIGINT)").alias("__one"), total.alias("__t")).select(
        "stream_id", F.expr("(__t + 999) div 1000").alias("kbits")
    )


def frame_stats(df: DataFrame, *, fps: float, origin: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Per frame: size so far, bit rate and average bit rate (time floor 0.01 s)."""
    out = running(df, ["stream_id"], "seq", {"total_size": ("sum", F.col("size"))}, rows=rows)
    t = F.greatest(F.lit(0.01), (F.col("dts") - F.col(origin)) / F.lit(1e6))
    return out.withColumn("time", t).withColumn(
        "bitrate", F.col("size") * 8 * F.lit(fps) / 1000.0
    ).withColumn("avg_bitrate", F.col("total_size") * 8.0 / F.col("time") / 1000.0)


def qp_histogram(df: DataFrame, q: str = "q", keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Frames per rounded quantiser and the log2 digit used to draw them."""
    g = df.groupBy(*keys, F.round(q).cast("int").alias("qp")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("digit", F.rint(F.log2(F.col("n") + 1)).cast("int"))


def transcode_report(df: DataFrame, streams: DataFrame, *, extra_size: int = 0) -> DataFrame:
    """Totals by media type, earliest output time, bit rate and muxing overhead."""
    kinds = streams.select(*STREAM, "codec_type")
    t = F.col("codec_type")
    g = df.join(kinds, list(STREAM), "left").groupBy("stream_id").agg(
        F.coalesce(F.sum(F.when(t == "video", F.col("size"))), F.lit(0)).alias("video_size"),
        F.coalesce(F.sum(F.when(t == "audio", F.col("size"))), F.lit(0)).alias("audio_size"),
        F.sum("size").alias("total_size"),
        F.max("pts").alias("__top"),
        F.min(F.when(F.col("pts") > 0, F.col("pts"))).alias("__low"),
    )
    raw = F.col("video_size") + F.col("audio_size") + F.lit(extra_size)
    secs = F.greatest(F.coalesce(F.col("__top") - F.col("__low"), F.lit(0)) / F.lit(1e6), F.lit(0.01))
    return g.select(
        "stream_id", "video_size", "audio_size", "total_size",
        secs.alias("seconds"),
        (F.col("total_size") * 8.0 / secs / 1000.0).alias("kbits"),
        F.try_divide(F.lit(100.0) * (F.col("total_size") - raw), raw).alias("overhead_pct"),
    )


def adler32(
    df: DataFrame, keys: Sequence[str], order: str, byte: str, *, init: int = 1, size_hint: int | None = None
) -> DataFrame:
    """Adler-32 of bytes spread over rows, as mergeable sums.

    ``a = init + sum(b)`` and ``b = n*init + sum((n-i) * b_i)`` with i from 0; the
    second sum is split into ``n*sum(b) - sum(i*b)``, each reduced modulo 65521 on
    the way in so that the sums stay in 64 bits for 10^13 bytes.
    """
    m = 65521
    b = F.col(byte).cast("bigint")
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(b).alias("__s"),
        F.sum((F.col(order).cast("bigint") % m) * b % m).alias("__w"),
    )
    n, s, w = F.col("__n"), F.col("__s"), F.col("__w")
    low = (s + (init & 0xFFFF)) % m
    high = ((n % m) * F.lit(init & 0xFFFF) + (n % m) * (s % m) - w % m + F.lit(init >> 16) + m) % m
    return g.select(*keys, n.alias("n"), (high * 65536 + low).alias("adler32"))


def frame_manifest(df: DataFrame, *, data: str = "data") -> DataFrame:
    """One row per packet: stream, time, size and the checksum of its payload.

    The checksum starts at 0 and runs over the payload where it stands; no rows are
    exploded or shuffled.  A missing payload has checksum 0 and no size.
    """
    size = F.octet_length(F.col(data)).cast("bigint")
    return df.select("stream_id", "stream_index", "dts", size.alias("size"), checksum(F.col(data), init=0).alias("checksum"))


def checksum(data: Column, *, init: int = 1) -> Column:
    """Adler-32 of a binary column, whole batches at a time."""

    @F.arrow_udf("bigint")
    def run(raw: pa.Array) -> pa.Array:
        return pa.array([zlib.adler32(b or b"", init) for b in raw.to_pylist()], pa.int64())

    return run(data)

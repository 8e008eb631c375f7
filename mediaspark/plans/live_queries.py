"""Live runs that need rows in order, across many files and micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.operators import fold as G
from mediaspark.operators.scan import chunk_id, cut_lineage, number_rows
from mediaspark.plans import fixtures as X
from mediaspark.plans import stat_queries as Q
from mediaspark.plans.registry import ORACLES, query
from mediaspark.plans.source_queries import finished, folder, stateful, to_the_end
from mediaspark.streaming import ordered as O
from mediaspark.streaming import twins


def feed(spark: SparkSession, df: DataFrame, order: str, parts: int = 6) -> DataFrame:
    """A table as a feed of many files, dealt by ranges of its order, two files a micro-batch.

    The files of different ranges are written by different tasks, so they come in any order.
    """
    path = folder(spark, "feed")
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def twin(name: str, of: str):
    """Register a live query whose rows are those of a batch query."""

    def add(fn):
        query(name)(fn)
        ORACLES[name] = ORACLES[of]
        return fn

    return add


def run_live(spark, d, frame, order, inputs, fold, outputs, state, first, name):
    stateful(spark)
    out = O.fold_ordered(feed(spark, frame, order), ["stream_id"], order, inputs, fold, outputs, first=first, depth=1 << 20, state=state)
    return finished(spark, out, name).drop("late")


@twin("live_dts", "dts_from_pts")
def live_dts(spark, d):
    """Decode times by a buffer that stays in the state store."""
    return run_live(spark, d, Q.untimed(spark, d), "seq", ["pts", "duration"], G.reorder_fold(3), "dts_out bigint", "array<bigint>", 1, "dts")


@twin("live_video_sync", "video_sync")
def live_video_sync(spark, d):
    return run_live(spark, d, Q.timed(spark, d), "seq", ["pts"], G.video_sync_fold(25.0, "cfr"), "nb_frames int, out_no bigint", "count bigint", 1, "video")


@twin("live_audio_sync", "audio_sync")
def live_audio_sync(spark, d):
    outputs = "dropped bigint, silence bigint, compensation int, out_samples bigint"
    return run_live(spark, d, Q.timed(spark, d), "seq", ["pts", "samples"], G.audio_sync_fold(48000, 0.1, 2), outputs, "count bigint, starting boolean", 1, "audio")


@twin("live_vbv", "vbv_audit")
def live_vbv(spark, d):
    b = X.v_packets_n(spark, d).select("stream_id", "seq", (F.col("size") * 8).alias("bits"))
    out = run_live(spark, d, b, "seq", ["bits"], G.vbv_fold(200000, 0, 80000, 0, 150000.0), "level double, underflow boolean, stuffing int", "level double", 1, "vbv")
    return out.drop("stuffing")


@twin("live_data_rate", "data_rate")
def live_data_rate(spark, d):
    t = X.v_packets_n(spark, d).select(
        "stream_id", "seq", F.expr("dts div 1000").alias("t_ms"), (F.col("seq") * 1400 + F.col("event_id") % 100).alias("bytes_total")
    )
    return run_live(spark, d, t, "seq", ["t_ms", "bytes_total"], G.data_rate_fold(), "rate bigint", "array<struct<t:bigint,n:bigint>>", 1, "rate")


@twin("live_iir", "iir_lowpass")
def live_iir(spark, d):
    s = X.v_samples(spark, d).select(
        F.expr("block div 100").alias("stream_id"), (F.col("block") % 100 * 64 + F.col("i")).alias("sample_no"), F.floor(F.col("x") * 20000).alias("x")
    )
    return run_live(spark, d, s, "sample_no", ["x"], G.iir_fold(4, 0.3), "y int", "array<double>", 0, "iir")


@query(
    "live_late",
    """WITH e AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
       m AS (SELECT *, coalesce(seq % 23 = 7 AND seq < max(CASE WHEN seq % 23 <> 7 THEN seq END) OVER (PARTITION BY stream_id), false) AS late FROM e)
       SELECT stream_id, seq, late, CASE WHEN NOT late THEN count(*) FILTER (NOT late) OVER (PARTITION BY stream_id ORDER BY seq) END AS place FROM m""",
)
def live_late(spark, d):
    """Every 23rd row of a stream comes in a later run of the feed: what others have overtaken by then is marked."""
    stateful(spark)
    e = number_rows(X.events(spark, d).select(F.col("user_id").alias("stream_id"), "event_id"), ["stream_id"], ["event_id"], [chunk_id("event_id")], "seq")
    e, path, out = e.select("stream_id", "seq"), folder(spark, "feed"), folder(spark, "late")

    def fold(state, cols):
        n = state[0] if state else 0
        return [n + len(cols["seq"])], {"place": list(range(n + 1, n + 1 + len(cols["seq"])))}

    for part in ("seq % 23 <> 7", "seq % 23 = 7"):
        e.where(part).write.mode("append").parquet(path)
        found = O.fold_ordered(spark.readStream.schema(e.schema).parquet(path), ["stream_id"], "seq", ["seq"], fold, "place bigint", state="n bigint")
        twins.drain(found, f"{out}/data", f"{out}/progress")
    return spark.read.schema(found.schema).parquet(f"{out}/data")


def by_days(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table as a feed of spans of five days; within a span the files come in any order.

    The table is made once, and a span has four files at any size: the number of micro-batches, each of which costs
    the state store a commit a partition, doesn't grow with the tasks that made the table.
    """
    path, df = folder(spark, "feed"), cut_lineage(df)
    for day in range(0, 30, 5):
        span = df.where(F.expr(f"ts >= timestamp'2024-01-01' + interval {day} days AND ts < timestamp'2024-01-01' + interval {day + 5} days"))
        span.repartition(4).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


#: Longer than a span of the feed, far shorter than the feed.
LATE = "6 days"


@query(
    "live_fields",
    """WITH e AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS field_no, CAST(floor(value * 100) AS BIGINT) AS v FROM events),
       n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY field_no))
       SELECT stream_id, field_no, CASE WHEN a IS NULL OR b IS NULL THEN v ELSE (a + 2 * v + b) // 4 END AS level FROM n""",
)
def live_fields(spark, d):
    """A three-field low pass over a live feed: each stream's first and last field come out by themselves."""
    stateful(spark)
    e = X.events(spark, d).select(F.col("user_id").alias("stream_id"), "event_id", F.floor(F.col("value") * 100).alias("v"), F.col("ts").cast("timestamp").alias("ts"))
    e = number_rows(e, ["stream_id"], ["event_id"], [chunk_id("event_id")], "field_no").select("stream_id", "field_no", "v", "ts")

    def low_pass(f):
        return O.look_around(
            f.withWatermark("ts", LATE), ["stream_id"], "field_no", "v", "ts", before=1, after=1, full=lambda w: (w[0] + 2 * w[1] + w[2]) // 4,
            single=lambda v: v, output="level bigint", first=1,
        )

    return to_the_end(spark, by_days(spark, e), low_pass, "fields").drop("late")


@query(
    "live_captions",
    """WITH e AS (SELECT *, epoch_us(ts) AS t FROM events),
       c AS (SELECT user_id, event_id, t AS start, coalesce(CASE WHEN event_id % 4 <> 0 THEN t + event_id % 5 * 21600000000 END, lead(t) OVER (PARTITION BY user_id ORDER BY t)) AS stop FROM e WHERE event_type = 'signup')
       SELECT e.user_id AS stream_id, e.event_id AS frame, c.event_id AS cue FROM e JOIN c ON e.user_id = c.user_id AND e.event_type = 'view' AND e.t >= c.start AND (c.stop IS NULL OR e.t < c.stop - 1000000)""",
)
def live_captions(spark, d):
    """Captions that last some hours or until the next one; they leave the state a second before their end."""
    stateful(spark)
    e = X.events(spark, d).select(F.col("user_id").alias("stream_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))

    def shown(f):
        # The mark that ends the feed has no type and goes with the frames.
        frames = f.where("event_type = 'view' OR event_type IS NULL").select("stream_id", F.col("event_id").alias("frame"), F.col("ts").alias("t"))
        stop = F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.expr("make_dt_interval(0, int(event_id % 5 * 6))"))
        cues = f.where("event_type = 'signup'").select("stream_id", F.col("event_id").alias("cue"), F.col("ts").alias("start"), stop.alias("stop"))
        return O.live_captions(frames, cues, late=LATE, slack_us=1_000_000)

    return to_the_end(spark, by_days(spark, e), shown, "captions")

"""Queries that write derived files and read them back, and streaming runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mediaspark.functions import picture as Pic
from mediaspark.operators import fold as G
from mediaspark.operators import lines as L
from mediaspark.operators import packets as P
from mediaspark.operators.cues import caption_events
from mediaspark.operators.scan import shared_folder
from mediaspark.operators.fields import HINTS
from mediaspark.plans import fixtures as X
from mediaspark.plans.line_queries import FILM
from mediaspark.plans.registry import query
from mediaspark.plans.stat_queries import RTP_RULES
from mediaspark.sources import files as Fi
from mediaspark.sources import raw as R
from mediaspark.sources import sinks as W
from mediaspark.streaming import twins as S


LIVE_RTP = """SELECT event_id % 100 AS ssrc, event_id, row_number() OVER (PARTITION BY event_id % 100 ORDER BY event_id) AS arrival_no,
    (event_id // 100 + 65500 + CASE WHEN event_id > 4000 THEN 20000 ELSE 0 END
      + CASE WHEN event_id % 1700 >= 1200 THEN 3 ELSE 0 END) % 65536 AS seq FROM events"""


def folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "scan_ts",
    """SELECT event_id AS packet_no, CAST(user_id % 8191 AS INTEGER) AS pid, event_type = 'signup' AS pusi, CAST(event_id % 16 AS INTEGER) AS cc, 1 AS afc,
         md5(CAST(event_id AS VARCHAR)) AS digest FROM events""",
)
def scan_ts(spark, d):
    e = F.col("event_id")
    h = lambda v, n: F.lpad(F.hex(v.cast("bigint")), n, "0")
    word = F.col("user_id") % 8191 + F.when(F.col("event_type") == "signup", 0x4000).otherwise(0)
    body = F.md5(e.cast("string"))
    data = F.unhex(F.concat(F.lit("47"), h(word, 4), h(e % 16 + 16, 2), F.rpad(body, 368, "0")))
    p = X.events(spark, d).select(e.alias("packet_no"), data.alias("data"))
    path = folder(spark, "ts")
    W.write_raw(p, path)
    out = R.scan_ts(spark, path, range_bytes=188 * 1000, one_stream=True)
    return out.select("packet_no", "pid", "pusi", "cc", "afc", F.lower(F.hex(F.substring("payload", 1, 16))).alias("digest"))


@query(
    "scan_pcm",
    """SELECT block * 64 + i AS sample_no, CAST(floor(x * 20000) AS DOUBLE) AS l, CAST(floor(x * -9000) AS DOUBLE) AS r FROM v_samples""",
)
def scan_pcm(spark, d):
    s = X.v_samples(spark, d).select(
        (F.col("block") * 64 + F.col("i")).alias("sample_no"), F.floor(F.col("x") * 20000).alias("l"), F.floor(F.col("x") * -9000).alias("r")
    )
    h = lambda v: F.lpad(F.hex((v + 65536) % 65536), 4, "0")
    path = folder(spark, "pcm")
    W.write_raw(s.withColumn("data", F.unhex(F.concat(h(F.col("l")), h(F.col("r"))))), path, order="sample_no")
    out = R.scan_pcm(spark, path, "s16be", 2, 44100, range_bytes=40000, one_stream=True)
    return out.select("sample_no", F.col("ch")[0].alias("l"), F.col("ch")[1].alias("r"))


@query(
    "scan_media",
    """SELECT user_id AS stream_id, CAST(sum(length(props)) + count(*) AS BIGINT) AS file_size FROM events GROUP BY user_id""",
)
def scan_media(spark, d):
    path, parts = folder(spark, "media"), max(4, 4 * spark.sparkContext.defaultParallelism)
    e = X.events(spark, d).select("user_id", "props").repartitionByRange(parts, "user_id").sortWithinPartitions("user_id")
    # A file per stream: tasks move their own files into place, as the driver would do it one by one.
    e.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("user_id").text(path)
    f = Fi.scan_media(spark, path, glob="*.txt", payload=False)
    sid = F.regexp_extract("filename", "user_id=(\\d+)", 1).cast("bigint")
    return f.groupBy(sid.alias("stream_id")).agg(F.sum("file_size").alias("file_size"))


@query(
    "numbered_run",
    """WITH f AS (SELECT n_nationkey % 5 AS grp, n_nationkey // 5 + CASE WHEN n_nationkey = 13 THEN 9 ELSE 0 END + CASE WHEN n_nationkey % 5 = 4 THEN 5 ELSE 0 END AS idx FROM nation),
       i AS (SELECT grp, idx, idx - row_number() OVER (PARTITION BY grp ORDER BY idx) AS isl, min(idx) OVER (PARTITION BY grp) AS lo FROM f)
       SELECT CAST(grp AS BIGINT) AS grp, CAST(idx AS BIGINT) AS idx FROM i WHERE lo < 5 AND isl = lo - 1""",
)
def numbered_run(spark, d):
    k = F.col("n_nationkey")
    idx = F.expr("n_nationkey div 5") + F.when(k == 13, 9).otherwise(0) + F.when(k % 5 == 4, 5).otherwise(0)
    f = X.table(spark, d, "nation").select((k % 5).cast("bigint").alias("grp"), F.format_string("/in/img%03d.pgm", idx).alias("filename"))
    return Fi.numbered_run(f, "img%03d.pgm", keys=["grp"]).select("grp", "idx")


@query(
    "concat_sources",
    """SELECT 0 AS part_no, seq, seq * 10 AS pos FROM v_packets WHERE stream_index = 0 UNION ALL
       SELECT 1, seq, seq * 10 + (SELECT sum(size) FROM v_packets WHERE stream_index = 0) FROM v_packets WHERE stream_index = 1 UNION ALL
       SELECT 2, seq, seq * 10 + (SELECT sum(size) FROM v_packets WHERE stream_index < 2) FROM v_packets WHERE stream_index = 2""".replace("(SELECT sum(size)", "(SELECT CAST(sum(size) AS BIGINT)"),
)
def concat_sources(spark, d):
    p = X.v_packets(spark, d).select("stream_index", "seq", "size", (F.col("seq") * 10).alias("pos"))
    return Fi.concat_sources([p.filter(F.col("stream_index") == i) for i in range(3)]).select("part_no", "seq", "pos")


@query(
    "caption_events",
    """WITH e AS (SELECT user_id % 20 AS file_id, event_id, event_id % 7 AS hh, event_id % 60 AS mm, event_id * 7 % 60 AS ss, event_id % 100 AS cs FROM events WHERE event_id % 10 <> 3),
       p AS (SELECT *, ((hh * 60 + mm) * 60 + ss) * 100 + cs AS pts FROM e)
       SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY pts, event_id) AS event_no, pts, event_id FROM p""",
)
def caption_script(spark, d):
    e = F.col("event_id")
    line = F.when(e % 10 == 3, F.concat(F.lit("Comment without time "), e.cast("string"))).otherwise(
        F.format_string("Dialogue: 0,%d:%02d:%02d.%02d,0:00:00.00,%d", e % 7, e % 60, e * 7 % 60, e % 100, e)
    )
    lines = X.events(spark, d).select((F.col("user_id") % 20).alias("file_id"), (e + 10).alias("line_no"), line.alias("line"))
    head = spark.range(20).select(
        F.col("id").alias("file_id"),
        F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("line_no"), F.lit(t).alias("line")) for i, t in enumerate(
            ("[Script Info]", "Title: 0,1:00:00.00,x", "[Events]", "Format: Layer, Start, End, Text"))])),
    )
    out = caption_events(lines.unionByName(head))
    return out.select("file_id", "event_no", "pts", F.regexp_extract("line", r"(\d+)$", 1).cast("bigint").alias("event_id"))


@query(
    "frame_manifest",
    """WITH b AS (SELECT event_id, user_id, event_type || props AS t FROM events),
       c AS (SELECT event_id, unnest(range(1, length(t) + 1)) AS i, length(t) AS n, t FROM b),
       a AS (SELECT event_id, n, CAST(sum(ascii(t[i])) % 65521 AS BIGINT) AS lo, CAST(sum((n - i + 1) * ascii(t[i])) % 65521 AS BIGINT) AS hi FROM c GROUP BY event_id, n)
       SELECT event_id AS dts, printf('0, %d, %d, 0x%08x', event_id, n, hi * 65536 + lo) AS line FROM a""",
)
def frame_manifest(spark, d):
    p = X.events(spark, d).select(
        F.col("user_id").alias("stream_id"), F.lit(0).alias("stream_index"), F.col("event_id").alias("dts"),
        F.encode(F.concat("event_type", "props"), "utf-8").alias("data"),
    )
    return W.manifest_lines(p).select("dts", "line")


@query(
    "packet_names",
    """SELECT event_id, printf('%05d_%02d_%d_%d_%s.bin', seq, stream_index, coalesce(pts, -9223372036854775808), size, CASE WHEN is_key THEN 'K' ELSE '_' END) AS name FROM v_packets""",
)
def packet_names(spark, d):
    return W.packet_names(X.v_packets(spark, d)).select("event_id", "name")


@query(
    "vstats",
    """SELECT stream_id, seq AS frame_no, printf('frame= %5d q= %2.1f f_size= %6d s_size= %8.0fkB time= %.3f br= %7.1fkbits/s avg_br= %7.1fkbits/s type= %s', seq,
         event_id % 31 + 0.0::DOUBLE, size, floor(tot / 1024.0::DOUBLE), t, size * 0.2::DOUBLE, floor(tot * 8 / t / 1000), CASE WHEN is_key THEN 'I' ELSE 'P' END) AS line
       FROM (SELECT *, sum(size) OVER (PARTITION BY stream_id ORDER BY seq) AS tot, greatest(0.01::DOUBLE, (dts // 1000 * 1000 - 1704067200000000) / 1e6) AS t FROM v_packets)""",
)
def vstats(spark, d):
    p = X.v_packets(spark, d).withColumns({"origin": F.lit(1704067200000000), "dts": F.expr("dts div 1000 * 1000")})
    s = P.frame_stats(p, fps=25.0, origin="origin").withColumns({
        "frame_no": F.col("seq"), "q": F.col("event_id") % 31, "pict_type": F.when(F.col("is_key"), "I").otherwise("P"),
        "avg_bitrate": F.floor("avg_bitrate").cast("double"), "total_size": (F.floor(F.col("total_size") / 1024) * 1024),
    })
    return W.vstats_lines(s)


def _axis_sql(source: int, target: int) -> str:
    rows = ", ".join(f"({t}, {i}, {w}::BIGINT)" for t, i, w in L.axis_weights(source, target))
    return f"(SELECT * FROM (VALUES {rows}) AS w(t, i, w))"


@query(
    "scale",
    f"""SELECT stream_id, frame_no, plane, CAST(b.t AS BIGINT) AS line_no, a.t AS x,
          CAST(CAST(sum(p * a.w * b.w) + 134217728 AS BIGINT) >> 28 AS INTEGER) AS p
        FROM v_px JOIN {_axis_sql(64, 40)} a ON a.i = x JOIN {_axis_sql(10, 15)} b ON b.i = line_no GROUP BY ALL""",
)
def scale(spark, d):
    out = L.scale(X.v_lines(spark, d), 64, 10, 40, 15)
    return out.select("stream_id", "frame_no", "plane", "line_no", F.posexplode("px").alias("x", "p"))


def _kernel_sql(source: int, target: int) -> str:
    """Weights of the cubic kernel along one axis."""
    ratio, wide = f"(CAST({source} AS DOUBLE) / {target})", max(source / target, 1.0)
    return f"""(WITH c AS (SELECT t, (t + 0.5::DOUBLE) * {ratio} - 0.5::DOUBLE AS c FROM range({target}) r(t)),
        p AS (SELECT t, c, unnest(range(CAST(floor(c - {2 * wide}::DOUBLE) AS BIGINT), CAST(ceil(c + {2 * wide}::DOUBLE) AS BIGINT) + 1)) AS p FROM c),
        d AS (SELECT t, greatest(0, least({source - 1}, p)) AS i, abs(p - c) / {wide}::DOUBLE AS d FROM p),
        k AS (SELECT t, i, CAST(sum(CAST(round(1048576 * CASE WHEN d <= 1 THEN (1.5::DOUBLE * d - 2.5::DOUBLE) * d * d + 1
            ELSE ((2.5::DOUBLE - 0.5::DOUBLE * d) * d - 4) * d + 2 END) AS BIGINT)) AS BIGINT) AS k FROM d WHERE d < 2 GROUP BY t, i),
        a AS (SELECT *, CAST(sum(k) OVER (PARTITION BY t) AS BIGINT) AS a FROM k),
        f AS (SELECT t, i, CAST(floor((k * 32768 + a) / (2.0::DOUBLE * a)) AS BIGINT) AS f FROM a)
        SELECT t, i, f + CASE WHEN row_number() OVER (PARTITION BY t ORDER BY f DESC, i) = 1 THEN 16384 - sum(f) OVER (PARTITION BY t) ELSE 0 END AS w FROM f)"""


def _cubic(d):
    """Through the points, with the slopes of the neighbours' chords; reaches 2."""
    return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).otherwise(((2.5 - 0.5 * d) * d - 4) * d + 2)


@query(
    "scale_by_kernel",
    f"""SELECT stream_id, frame_no, plane, CAST(b.t AS BIGINT) AS line_no, CAST(a.t AS INTEGER) AS x,
          CAST(greatest(0, least(255, CAST(sum(p * a.w * b.w) + 134217728 AS BIGINT) >> 28)) AS INTEGER) AS p
        FROM v_px JOIN {_kernel_sql(64, 40)} a ON a.i = x JOIN {_kernel_sql(10, 15)} b ON b.i = line_no GROUP BY ALL""",
)
def scale_by_kernel(spark, d):
    out = L.scale_by_kernel(X.v_lines(spark, d), 64, 10, 40, 15, _cubic, 2)
    return out.select("stream_id", "frame_no", "plane", "line_no", F.posexplode("px").alias("x", "p"))


@query(
    "scaled_size",
    """SELECT event_id, CAST((w * 480 + h // 2) // h AS INTEGER) AS w, 480 AS h FROM (SELECT event_id, event_id % 1900 + 20 AS w, event_id % 1000 + 20 AS h FROM events)""",
)
def scaled_size(spark, d):
    e = F.col("event_id")
    w, h = Pic.scaled_size(e % 1900 + 20, e % 1000 + 20, -1, 480)
    return X.events(spark, d).select("event_id", w.alias("w"), h.alias("h"))


@query("temporal_denoise")
def temporal_denoise(spark, d):
    out = L.temporal_denoise(X.v_lines16(spark, d))
    return out.select("stream_id", "plane", "frame_no", "line_no", F.posexplode("px").alias("x", "p"))


# --------------------------------------------------------------- streaming


def live(spark, d, name: str):
    """A driver table as a stream; one run takes in all there is."""
    schema = X.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def finished(spark, df, name: str):
    out = folder(spark, name)
    S.drain(df, f"{out}/data", f"{out}/progress")
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def live_packets(spark, d):
    e = live(spark, d, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("stream_id"), F.floor(F.col("value") * 100).alias("size"),
    )


def to_the_end(spark, feed, result, name: str):
    """All windows of a feed: its rows first, then the mark of its end."""
    out = folder(spark, name)
    df = result(S.with_end(feed, f"{out}/marks"))
    S.drain(df, f"{out}/data", f"{out}/progress")
    S.end_feed(feed, f"{out}/marks", "ts")
    S.drain(df, f"{out}/data", f"{out}/progress")
    return spark.read.schema(df.schema).parquet(f"{out}/data")


@query(
    "live_progress",
    """SELECT stream_id, epoch_us(ts) // 500000 * 500000 AS start, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes
       FROM (SELECT user_id AS stream_id, ts, CAST(floor(value * 100) AS BIGINT) AS size FROM events) GROUP BY ALL""",
)
def live_progress(spark, d):
    out = to_the_end(spark, live_packets(spark, d), lambda p: S.progress(p, "ts", keys=["stream_id"]), "progress")
    return out.select("stream_id", F.unix_micros("start").alias("start"), "packets", "bytes")


@query(
    "live_rate",
    """WITH e AS (SELECT user_id AS stream_id, epoch_us(ts) AS t, CAST(floor(value * 100) AS BIGINT) AS size FROM events),
       w AS (SELECT stream_id, t // 5000000 * 5000000 - k * 5000000 AS start, size FROM e, (SELECT unnest([0, 1]) AS k))
       SELECT stream_id, start, round(sum(size) / 10.0::DOUBLE, 4) AS rate FROM w GROUP BY ALL""",
)
def live_rate(spark, d):
    out = to_the_end(spark, live_packets(spark, d), lambda p: S.sliding_rate(p, "ts", keys=["stream_id"]), "rate")
    return out.select("stream_id", F.unix_micros("start").alias("start"), F.round("rate", 4).alias("rate"))


@query(
    "live_sessions",
    """WITH e AS (SELECT user_id AS stream_id, epoch_us(ts) AS t FROM events),
       b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY stream_id ORDER BY t) <= 14400000000 THEN 0 ELSE 1 END AS n FROM e),
       s AS (SELECT *, sum(n) OVER (PARTITION BY stream_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b),
       g AS (SELECT stream_id, k, min(t) AS start, max(t) + 14400000000 AS "end", count(*) AS packets FROM s GROUP BY ALL)
       SELECT stream_id, start, "end", packets FROM g""",
)
def live_sessions(spark, d):
    out = to_the_end(spark, live_packets(spark, d), lambda p: S.sessions(p, "ts", gap="4 hours", keys=["stream_id"]), "sessions")
    return out.select("stream_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "packets")


def stateful(spark):
    """The state store the folds need."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != S.PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)


@query(
    "live_rtp",
    RTP_RULES.replace("SELECT ssrc, arrival_no, seq FROM v_rtp", LIVE_RTP)
    + "SELECT r.ssrc, n.event_id AS arrival_no, valid, cycles + top AS ext_seq, received FROM r JOIN p n USING (ssrc, arrival_no)",
)
def live_rtp(spark, d):
    """Sequence check of a live feed with gaps, steps back and one jump in its numbers."""
    stateful(spark)
    e = F.col("event_id")
    seq = F.expr("event_id div 100") + 65500 + F.when(e > 4000, 20000).otherwise(0) + F.when(e % 1700 >= 1200, 3).otherwise(0)
    rtp = live(spark, d, "events").select(
        (e % 100).alias("ssrc"), e.alias("arrival_no"), (seq % 65536).cast("int").alias("seq")
    )
    out = finished(spark, S.fold_live(rtp, ["ssrc"], "arrival_no", ["seq"], G.rtp_fold(), G.RTP_OUT), "rtp")
    return out.select("ssrc", "arrival_no", "valid", "ext_seq", "received")


@query(
    "live_film",
    FILM + """SELECT stream_id, field_no, CASE k WHEN 3 THEN 'PULLDOWN_32' WHEN 2 THEN 'PULLDOWN_22' ELSE 'FULLRATE' END AS cadence,
      CAST(idx AS INTEGER) AS cadence_index FROM r""",
)
def live_film(spark, d):
    """Film detection of a live feed."""
    stateful(spark)
    e = live(spark, d, "events").select(
        F.expr("event_id div 50").alias("stream_id"), (F.col("event_id") % 50).alias("field_no"), "event_type"
    )
    random_hint = F.when(F.col("event_type") == "view", "AFTERNEXT_32").when(F.col("event_type") == "click", "NEXT_32").when(
        F.col("event_type") == "purchase", "PREV_32").when(F.col("event_type") == "signup", "NEXT_22").otherwise("PREV_22")
    clean = F.element_at(F.array(*[F.lit(h) for h in HINTS]), ((F.col("field_no") + F.col("stream_id")) % 5 + 1).cast("int"))
    e = e.withColumn("hint", F.when(F.col("stream_id") % 2 == 0, random_hint).otherwise(clean))
    out = S.fold_live(e, ["stream_id"], "field_no", ["field_no", "hint"], G.film_fold(), "cadence string, cadence_index int")
    return finished(spark, out, "film").drop("late")


@query(
    "live_clock",
    """WITH RECURSIVE p AS (SELECT user_id AS stream_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
           CAST(event_id * 1000 + event_id % 7 AS DOUBLE) AS t, event_type = 'error' AS disc FROM events),
       r AS (SELECT stream_id, event_id, n, t AS cyc, 150000.0::DOUBLE AS clk, 1 AS k FROM p WHERE n = 1
         UNION ALL SELECT p.stream_id, p.event_id, p.n, CASE WHEN p.disc THEN p.t ELSE r.cyc + r.clk + greatest(0.1::DOUBLE, 1.0::DOUBLE / (r.k + 1)) * (p.t - (r.cyc + r.clk)) END,
             CASE WHEN p.disc THEN 150000.0::DOUBLE ELSE r.clk + 0.01::DOUBLE * (p.t - (r.cyc + r.clk)) END, CASE WHEN p.disc THEN 1 ELSE r.k + 1 END
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.n = r.n + 1)
       SELECT stream_id, event_id AS seq, CAST(floor(cyc * 1000) AS BIGINT) AS smooth_milli FROM r""",
)
def live_clock(spark, d):
    """Clock filter of a live feed that starts over at each error event."""
    stateful(spark)
    e = live(spark, d, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 1000 + F.col("event_id") % 7).cast("double").alias("time"),
        F.lit(1.0).alias("step"), (F.col("event_type") == "error").alias("disc"),
    )
    fold = S.with_reset(G.clock_fold(150000.0, 0.1, 0.01))
    out = finished(spark, S.fold_live(e, ["stream_id"], "seq", ["time", "step", "disc"], fold, "smooth_time double"), "clock")
    return out.select("stream_id", "seq", F.floor(F.col("smooth_time") * 1000).alias("smooth_milli"))

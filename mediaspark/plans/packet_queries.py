"""Queries over packets and stream tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaspark.operators import packets as P
from mediaspark.plans import fixtures as X
from mediaspark.plans.registry import query, values

DAY = 86_400_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01


@query(
    "stream_health",
    """SELECT stream_id, min(dts) AS start_time, max(dts) AS end_time, max(dts) - min(dts) AS duration,
         CAST(sum(size) AS BIGINT) AS bytes,
         CAST(floor(sum(size) * 8000000.0 / greatest(1, max(dts) - min(dts))) AS BIGINT) AS bit_rate,
         CAST(sum(CASE WHEN top >= dts THEN 1 ELSE 0 END) AS BIGINT) AS non_monotone,
         CAST(sum(CASE WHEN pts < dts THEN 1 ELSE 0 END) AS BIGINT) AS pts_before_dts
       FROM (SELECT *, max(CASE WHEN pts IS NULL OR pts >= dts THEN dts END) OVER (PARTITION BY stream_id
               ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
             FROM (SELECT stream_id, seq, size, dts - CASE WHEN event_id % 11 = 0 THEN 259200000000 ELSE 0 END AS dts,
                          pts - CASE WHEN event_id % 13 = 0 THEN 90000 ELSE 0 END AS pts FROM v_packets)) GROUP BY stream_id""",
)
def stream_health(spark, d):
    p = X.v_packets(spark, d).withColumn(
        "dts", F.col("dts") - F.when(F.col("event_id") % 11 == 0, 3 * DAY).otherwise(0)
    ).withColumn("pts", F.col("pts") - F.when(F.col("event_id") % 13 == 0, 90000).otherwise(0))
    v = P.validate_mux(p, keys=["stream_id"])
    span = F.max("dts") - F.min("dts")
    return v.groupBy("stream_id").agg(
        F.min("dts").alias("start_time"),
        F.max("dts").alias("end_time"),
        span.alias("duration"),
        F.sum("size").alias("bytes"),
        F.floor(F.sum("size") * 8000000.0 / F.greatest(F.lit(1), span)).alias("bit_rate"),
        F.count_if("non_monotone").alias("non_monotone"),
        F.count_if("pts_before_dts").alias("pts_before_dts"),
    )


@query(
    "validate_mux",
    """SELECT stream_id, stream_index, seq, coalesce(top <> 0 AND top >= dts, false) AS non_monotone,
         coalesce(pts < dts, false) AS pts_before_dts
       FROM (SELECT *, max(CASE WHEN pts IS NULL OR pts >= dts THEN dts END) OVER (PARTITION BY stream_id, stream_index
               ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
             FROM (SELECT stream_id, stream_index, seq, dts - CASE WHEN event_id % 11 = 0 THEN 259200000000 ELSE 0 END AS dts,
                   pts - CASE WHEN event_id % 13 = 0 THEN 90000 ELSE 0 END AS pts FROM v_packets))""",
)
def validate_mux(spark, d):
    p = X.v_packets(spark, d).withColumn(
        "dts", F.col("dts") - F.when(F.col("event_id") % 11 == 0, 3 * DAY).otherwise(0)
    ).withColumn("pts", F.col("pts") - F.when(F.col("event_id") % 13 == 0, 90000).otherwise(0))
    return P.validate_mux(p).select("stream_id", "stream_index", "seq", "non_monotone", "pts_before_dts")


@query(
    "map_streams",
    """SELECT stream_id, CASE stream_index WHEN 0 THEN 1 ELSE 0 END AS stream_index, seq, dts, size
       FROM v_packets WHERE stream_index IN (0, 2)""",
)
def map_streams(spark, d):
    mapping = values(spark, [(0, 1), (2, 0)], "stream_index, out_index")
    return P.map_streams(X.v_packets(spark, d), mapping).select("stream_id", "stream_index", "seq", "dts", "size")


@query(
    "time_slice",
    f"""SELECT stream_id, stream_index, seq, dts - {T0 + 5 * DAY} AS dts FROM (
         SELECT *, max(dts) OVER (PARTITION BY stream_id, stream_index ORDER BY seq) AS top FROM (
           SELECT stream_id, stream_index, seq, dts - CASE WHEN event_id % 11 = 0 THEN {3 * DAY} ELSE 0 END AS dts
           FROM v_packets)) WHERE top < {T0 + 12 * DAY} AND dts >= {T0 + 5 * DAY}""",
)
def time_slice(spark, d):
    p = X.v_packets(spark, d).withColumn(
        "dts", F.col("dts") - F.when(F.col("event_id") % 11 == 0, 3 * DAY).otherwise(0)
    )
    return P.time_slice(p, T0 + 5 * DAY, 7 * DAY).select("stream_id", "stream_index", "seq", "dts")


@query(
    "shift_scale_ts",
    """SELECT stream_id, stream_index, seq, (pts + CASE WHEN stream_id % 3 = 0 THEN stream_id * 1000 ELSE 0 END)
         * CASE stream_index WHEN 1 THEN 2 ELSE 1 END AS pts,
         (dts + CASE WHEN stream_id % 3 = 0 THEN stream_id * 1000 ELSE 0 END)
         * CASE stream_index WHEN 1 THEN 2 ELSE 1 END AS dts FROM v_packets""",
)
def shift_scale_ts(spark, d):
    p = X.v_packets(spark, d)
    offsets = (
        X.events(spark, d).select(F.col("user_id").alias("stream_id")).filter("stream_id % 3 = 0").distinct()
        .withColumn("ts_offset", F.col("stream_id") * 1000)
    )
    scales = values(spark, [(1, 2)], "stream_index, ts_scale")
    return P.shift_scale_ts(p, offsets, scales).select("stream_id", "stream_index", "seq", "pts", "dts")


@query(
    "discard_bidir",
    """SELECT stream_id, frame_no, CASE pict_type WHEN 'N' THEN 'I' ELSE 'P' END AS pict_type, q, tex_bits
       FROM v_pass1 WHERE pict_type <> 'R'""",
)
def discard_bidir(spark, d):
    kind = F.when(F.col("pict_type") == "N", "I").when(F.col("pict_type") == "A", "P").otherwise("B")
    p = X.v_pass1(spark, d).withColumn("pict_type", kind)
    return P.discard(p, "bidir").select("stream_id", "frame_no", "pict_type", "q", "tex_bits")


@query(
    "wait_for_key",
    """SELECT stream_id, seq, is_key, disc FROM (SELECT *,
         max(CASE WHEN is_key THEN seq END) OVER w AS k, max(CASE WHEN disc THEN seq END) OVER w AS c
         FROM v_packets WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
       WHERE k IS NOT NULL AND (c IS NULL OR k >= c)""",
)
def wait_for_key(spark, d):
    return P.wait_for_key(X.v_packets(spark, d)).select("stream_id", "seq", "is_key", "disc")


@query(
    "cap_packets",
    """WITH a AS (SELECT *, count(*) OVER (PARTITION BY stream_id, stream_index ORDER BY seq) AS n FROM v_packets),
       b AS (SELECT *, sum(size) OVER (PARTITION BY stream_id ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a WHERE n <= 12),
       c AS (SELECT * FROM b WHERE coalesce(before, 0) < 200000),
       e AS (SELECT stream_id, min(m) AS m FROM (SELECT stream_id, stream_index, max(dts) AS m FROM c GROUP BY ALL) GROUP BY 1)
       SELECT stream_id, stream_index, seq, dts, size FROM c JOIN e USING (stream_id) WHERE dts <= m""",
)
def cap_packets(spark, d):
    p = P.cap(X.v_packets(spark, d), max_frames=12, max_bytes=200000, shortest=True)
    return p.select("stream_id", "stream_index", "seq", "dts", "size")


@query(
    "default_stream",
    """SELECT stream_id, arg_min(stream_index, CASE codec_type WHEN 'video' THEN 0 WHEN 'audio' THEN 1000 ELSE 2000 END
         + stream_index) AS stream_index FROM (SELECT stream_id, stream_index, CASE WHEN stream_index <= stream_id % 5 THEN 'data' ELSE codec_type END AS codec_type
         FROM v_streams) GROUP BY stream_id""",
)
def default_stream(spark, d):
    kind = F.when(F.expr("stream_index <= stream_id % 5"), "data").otherwise(F.col("codec_type"))
    return P.default_stream(X.v_streams(spark, d).withColumn("codec_type", kind))


@query(
    "skip_empty_audio",
    """SELECT stream_id, stream_index, seq, size FROM
         (SELECT stream_id, stream_index, seq, CASE WHEN event_id % 4 = 0 THEN 0 ELSE size END AS size FROM v_packets)
       WHERE NOT (stream_index = 1 AND size = 0)""",
)
def skip_empty_audio(spark, d):
    p = X.v_packets(spark, d).withColumn("size", F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("size")))
    kinds = X.events(spark, d).select(F.col("user_id").alias("stream_id")).distinct().select(
        "stream_id", F.lit(1).alias("stream_index"), F.lit("audio").alias("codec_type")
    )
    return P.skip_empty_audio(p, kinds).select("stream_id", "stream_index", "seq", "size")


@query(
    "repair_timestamps",
    """WITH p AS (SELECT stream_id, stream_index, seq, 20000 + (seq % 5) * 10 AS duration,
           CASE WHEN event_id % 3 = 0 THEN pts END AS pts,
           CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN dts + 100000 END AS dts FROM v_packets),
       k AS (SELECT *, coalesce(pts, CASE WHEN dts > pts THEN dts - 8589934592 ELSE dts END) AS known,
           coalesce(sum(duration) OVER (PARTITION BY stream_id, stream_index ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p)
       SELECT stream_id, stream_index, seq, CAST(coalesce(last_value(known - s IGNORE NULLS) OVER
           (PARTITION BY stream_id, stream_index ORDER BY seq), 0) + s AS BIGINT) AS pts FROM k""",
)
def repair_timestamps(spark, d):
    e = F.col("event_id")
    p = X.v_packets(spark, d).withColumn("duration", F.lit(20000) + (F.col("seq") % 5) * 10)
    p = p.withColumn("dts", F.when((e % 3 == 0) & (e % 2 == 0), F.col("dts") + 100000))
    p = p.withColumn("pts", F.when(e % 3 == 0, F.col("pts")))
    return P.repair_timestamps(p).select("stream_id", "stream_index", "seq", "pts")


@query(
    "backfill_initial",
    """WITH p AS (SELECT stream_id, stream_index, seq, 20000 + (seq % 5) * 10 AS duration,
           CASE WHEN seq > 9 AND seq % 4 <> 0 THEN dts END AS dts FROM v_packets),
       k AS (SELECT *, coalesce(sum(duration) OVER w, 0) AS s, max(CASE WHEN dts IS NOT NULL THEN 1 END) OVER w AS seen
           FROM p WINDOW w AS (PARTITION BY stream_id, stream_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT stream_id, stream_index, seq, CAST(CASE WHEN dts IS NULL AND seen IS NULL THEN
           first_value(dts - s IGNORE NULLS) OVER (PARTITION BY stream_id, stream_index ORDER BY seq
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + s ELSE dts END AS BIGINT) AS dts FROM k""",
)
def backfill_initial(spark, d):
    p = X.v_packets(spark, d).withColumn("duration", F.lit(20000) + (F.col("seq") % 5) * 10)
    p = p.withColumn("dts", F.when((F.col("seq") > 9) & (F.col("seq") % 4 != 0), F.col("dts")))
    return P.backfill_initial(p).select("stream_id", "stream_index", "seq", "dts")


@query(
    "fix_discontinuity",
    f"""WITH p AS (SELECT stream_id, stream_index, seq, dts, dts - lag(dts) OVER w - 30000 AS delta, lag(dts) OVER w AS prev
           FROM (SELECT stream_id, stream_index, seq, dts - CASE WHEN event_id % 29 = 0 THEN {DAY} ELSE 0 END AS dts FROM v_packets)
           WINDOW w AS (PARTITION BY stream_id, stream_index ORDER BY seq)),
       j AS (SELECT *, coalesce(abs(delta) > {3 * DAY} OR dts + 1 < prev, false) AS jumped FROM p)
       SELECT stream_id, stream_index, seq, jumped, CAST(sum(CASE WHEN jumped THEN -delta ELSE 0 END) OVER w AS BIGINT) AS ts_shift,
         CAST(dts + sum(CASE WHEN jumped THEN -delta ELSE 0 END) OVER w AS BIGINT) AS dts FROM j
       WINDOW w AS (PARTITION BY stream_id, stream_index ORDER BY seq)""",
)
def fix_discontinuity(spark, d):
    p = X.v_packets(spark, d).withColumn("dts", F.col("dts") - F.when(F.col("event_id") % 29 == 0, DAY).otherwise(0))
    out = P.fix_discontinuity(p, 3 * DAY, duration=F.lit(30000))
    return out.select("stream_id", "stream_index", "seq", "jumped", "ts_shift", "dts")


@query(
    "interleave",
    """SELECT stream_id, stream_index, seq, t AS dts, row_number() OVER (PARTITION BY stream_id ORDER BY t, stream_index, seq) AS pos
       FROM (SELECT stream_id, stream_index, seq, dts + stream_index * 7200000000 AS t FROM v_packets)""",
)
def interleave(spark, d):
    p = X.v_packets(spark, d).withColumn("dts", F.col("dts") + F.col("stream_index") * F.lit(7200000000))
    return P.interleave(p).select("stream_id", "stream_index", "seq", "dts", "pos")


@query(
    "next_input",
    """SELECT stream_id, arg_min(stream_index, pts * 4 + stream_index) AS stream_index, min(pts) AS pts FROM
         (SELECT stream_id, stream_index, min(pts) AS pts FROM v_packets WHERE pts IS NOT NULL GROUP BY ALL) GROUP BY stream_id""",
)
def next_input(spark, d):
    heads = X.v_packets(spark, d).filter("pts IS NOT NULL").groupBy("stream_id", "stream_index").agg(F.min("pts").alias("pts"))
    return P.next_input(heads)


V_CONTAINERS = """SELECT s_suppkey AS stream_id, CAST(floor(s_acctbal * 1000) AS BIGINT) + 20000000 AS file_size FROM supplier"""


def containers(spark, d):
    return X.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("stream_id"), (F.floor(F.col("s_acctbal") * 1000) + 20000000).alias("file_size")
    )


@query(
    "container_timings",
    f"""SELECT stream_id, start_time, duration, CASE WHEN file_size > 0 AND duration <> 0 THEN
          CAST(floor(file_size * 8000000.0::DOUBLE / duration) AS BIGINT) END AS bit_rate
        FROM (SELECT stream_id, min(start_time) AS start_time,
                greatest(max(duration), max(start_time + duration) - min(start_time)) AS duration
              FROM v_streams GROUP BY stream_id) JOIN ({V_CONTAINERS}) USING (stream_id)""",
)
def container_timings(spark, d):
    return P.container_timings(X.v_streams(spark, d), containers(spark, d))


@query(
    "fill_stream_timings",
    """WITH s AS (SELECT stream_id, stream_index, CASE WHEN stream_index % 3 = 0 THEN NULL ELSE start_time END AS start_time,
              duration FROM v_streams),
       t AS (SELECT stream_id, min(start_time) AS st, greatest(max(duration), max(start_time + duration) - min(start_time)) AS du
             FROM s GROUP BY 1)
       SELECT stream_id, stream_index, coalesce(start_time, st) AS start_time,
         CASE WHEN start_time IS NULL THEN coalesce(du, duration) ELSE duration END AS duration FROM s JOIN t USING (stream_id)""",
)
def fill_stream_timings(spark, d):
    s = X.v_streams(spark, d).withColumn("start_time", F.when(F.col("stream_index") % 3 != 0, F.col("start_time")))
    s = s.select("stream_id", "stream_index", "start_time", "duration")
    return P.fill_stream_timings(s, P.container_timings(s, containers(spark, d)))


@query(
    "duration_from_bitrate",
    f"""WITH s AS (SELECT stream_id, stream_index, bit_rate, CASE WHEN stream_index % 2 = 0 THEN duration END AS duration FROM v_streams),
       t AS (SELECT stream_id, CAST(sum(bit_rate) AS BIGINT) AS total FROM s GROUP BY 1)
       SELECT stream_id, stream_index, total AS file_bit_rate, coalesce(duration,
         CAST((file_size::HUGEINT * 8 * 1000000 + total // 2) // total AS BIGINT)) AS duration
       FROM s JOIN t USING (stream_id) JOIN ({V_CONTAINERS}) USING (stream_id)""",
)
def duration_from_bitrate(spark, d):
    s = X.v_streams(spark, d).withColumn("duration", F.when(F.col("stream_index") % 2 == 0, F.col("duration")))
    s = s.select("stream_id", "stream_index", "bit_rate", "duration")
    c = containers(spark, d).withColumn("bit_rate", F.lit(0).cast("bigint"))
    out = P.duration_from_bitrate(s, c)
    return out.select("stream_id", "stream_index", "file_bit_rate", "duration")


@query(
    "duration_from_pts",
    """WITH f AS (SELECT stream_id, stream_index, arg_min(dts, seq) AS start_time FROM v_packets GROUP BY ALL)
       SELECT stream_id, stream_index, start_time, max(CASE WHEN x > 0 THEN x END) AS duration FROM
         (SELECT p.stream_id, p.stream_index, f.start_time, CASE WHEN pts < f.start_time THEN pts - f.start_time + 8589934592
            ELSE pts - f.start_time END AS x FROM v_packets p JOIN f USING (stream_id, stream_index)) GROUP BY ALL""",
)
def duration_from_pts(spark, d):
    return P.duration_from_pts(X.v_packets(spark, d))


@query(
    "stream_bandwidth",
    """SELECT stream_id, CAST((coalesce(sum(CASE WHEN codec_type <> 'data' THEN bit_rate END), 0) + 999) // 1000 AS BIGINT) AS kbits
       FROM (SELECT stream_id, codec_type, bit_rate + 37 * stream_index AS bit_rate FROM v_streams) GROUP BY stream_id""",
)
def stream_bandwidth(spark, d):
    s = X.v_streams(spark, d).withColumn("bit_rate", F.col("bit_rate") + F.col("stream_index") * 37)
    return P.stream_bandwidth(s)


@query(
    "frame_stats",
    """SELECT stream_id, seq, total_size, round(t, 6) AS time, round(size * 8 * 25.0::DOUBLE / 1000.0, 4) AS bitrate,
         round(total_size * 8.0::DOUBLE / t / 1000.0, 4) AS avg_bitrate FROM
         (SELECT stream_id, seq, size, CAST(sum(size) OVER (PARTITION BY stream_id ORDER BY seq) AS BIGINT) AS total_size,
            greatest(0.01::DOUBLE, (dts - min(dts) OVER (PARTITION BY stream_id)) / 1e6) AS t FROM v_packets)""",
)
def frame_stats(spark, d):
    p = X.v_packets(spark, d)
    o = p.groupBy("stream_id").agg(F.min("dts").alias("origin"))
    s = P.frame_stats(p.join(o, "stream_id"), fps=25.0, origin="origin")
    return s.select(
        "stream_id", "seq", "total_size", F.round("time", 6).alias("time"),
        F.round("bitrate", 4).alias("bitrate"), F.round("avg_bitrate", 4).alias("avg_bitrate"),
    )


@query(
    "qp_histogram",
    """SELECT stream_id, q AS qp, count(*) AS n, CAST(round_even(log2(count(*) + 1), 0) AS INTEGER) AS digit
       FROM v_pass1 GROUP BY ALL""",
)
def qp_histogram(spark, d):
    return P.qp_histogram(X.v_pass1(spark, d))


@query(
    "transcode_report",
    """SELECT stream_id, video_size, audio_size, total_size, round(secs, 6) AS seconds,
         round(total_size * 8.0::DOUBLE / secs / 1000.0, 4) AS kbits,
         round(100.0::DOUBLE * (total_size - video_size - audio_size) / nullif(video_size + audio_size, 0), 6) AS overhead_pct
       FROM (SELECT stream_id, CAST(coalesce(sum(size) FILTER (stream_index = 0), 0) AS BIGINT) AS video_size,
           CAST(coalesce(sum(size) FILTER (stream_index = 1), 0) AS BIGINT) AS audio_size, CAST(sum(size) AS BIGINT) AS total_size,
           greatest(0.01::DOUBLE, coalesce(max(pts) - min(pts), 0) / 1e6) AS secs FROM v_packets GROUP BY stream_id)""",
)
def transcode_report(spark, d):
    p = X.v_packets(spark, d)
    users = X.events(spark, d).select(F.col("user_id").alias("stream_id")).distinct()
    kind = [F.struct(F.lit(i).alias("stream_index"), F.lit(k).alias("codec_type")) for i, k in enumerate(("video", "audio", "data"))]
    kinds = users.select("stream_id", F.inline(F.array(*kind)))
    r = P.transcode_report(p, kinds)
    return r.select(
        "stream_id", "video_size", "audio_size", "total_size", F.round("seconds", 6).alias("seconds"),
        F.round("kbits", 4).alias("kbits"), F.round("overhead_pct", 6).alias("overhead_pct"),
    )


@query(
    "adler32_document",
    """WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''),
       c AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x, unnest(range(length(h) // 2)) AS i FROM h),
       b AS (SELECT doc_id, i, CAST('0x' || x AS INTEGER) AS v FROM c),
       s AS (SELECT doc_id, count(*) AS n, sum(v) AS sv, sum(i * v) AS wv FROM b GROUP BY doc_id)
       SELECT doc_id, n, CAST(((n + n * sv - wv) % 65521) * 65536 + (1 + sv) % 65521 AS BIGINT) AS adler32 FROM s""",
)
def adler32_document(spark, d):
    t = X.table(spark, d, "documents").filter("text <> ''")
    return t.select("doc_id", F.octet_length("text").cast("bigint").alias("n"), P.checksum(F.encode("text", "utf-8")).alias("adler32"))

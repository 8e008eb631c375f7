"""Queries for rate estimation, rate control, indexes, numerics and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaspark.operators import fold as G
from mediaspark.operators import stats as S
from mediaspark.plans import fixtures as X
from mediaspark.plans.registry import query


def grid_packets(spark, d):
    """Packets whose times sit near a 25 Hz grid, one lattice per stream."""
    p = X.v_packets_n(spark, d)
    t = F.col("seq") * 40000 + (F.col("event_id") % 3 - 1) * 2000
    return p.select("stream_id", "stream_index", "seq", t.alias("dts"), F.lit(40000).alias("duration"))


GRID = """WITH g AS (SELECT stream_id, stream_index, seq, seq * 40000 + (event_id % 3 - 1) * 2000 AS dts FROM v_packets_n),
  r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, stream_index ORDER BY seq) AS k FROM g),
  f AS (SELECT stream_id, stream_index, max(dts) FILTER (k = 1) AS p0, max(dts) FILTER (k = 2) AS p1 FROM r GROUP BY ALL),
  d AS (SELECT r.stream_id, r.stream_index, r.seq, CASE WHEN k = 2 THEN dts - p0 ELSE dts - p1 END AS gap FROM r JOIN f USING (stream_id, stream_index)
    WHERE k >= 2 AND CASE WHEN k = 2 THEN dts - p0 ELSE dts - p1 END > 0)
"""


@query(
    "frame_rate",
    GRID + """, u AS (SELECT unnest(list_concat(list_transform(range(1, 720), lambda i: i * 1001), [288000, 360000, 720000, 144000, 180000])) AS unit),
      e AS (SELECT stream_id, stream_index, unit, sum(pow(gap / 1e6 - round_even(gap / 1e6 / (12012.0::DOUBLE / unit), 0) * (12012.0::DOUBLE / unit), 2)) * max(unit) AS fit,
           count(*) AS n FROM d, u GROUP BY stream_id, stream_index, unit),
      b AS (SELECT stream_id, stream_index, arg_min(unit, fit) AS unit, min(fit) AS fit, max(n) AS n FROM e GROUP BY ALL),
      c AS (SELECT stream_id, stream_index, count(*) AS frames FROM g GROUP BY ALL)
      SELECT stream_id, stream_index, frames, round(CASE WHEN frames > 2 THEN (frames - 2) * 1e6 / (frames * 40000) END, 6) AS avg_rate,
        CASE WHEN fit < 4e-12 * 360000 * n THEN unit END AS r_num FROM c LEFT JOIN b USING (stream_id, stream_index)""",
)
def frame_rate(spark, d):
    r = S.estimate_frame_rate(grid_packets(spark, d))
    return r.select("stream_id", "stream_index", "frames", F.round("avg_rate", 6).alias("avg_rate"), "r_num")


@query(
    "delta_gcd",
    GRID + """SELECT stream_id, stream_index, list_reduce(list(gap ORDER BY gap), lambda a, b: gcd(a, b)) AS gap_gcd FROM
      (SELECT *, row_number() OVER (PARTITION BY stream_id, stream_index ORDER BY seq) AS j FROM d) WHERE j > 3 GROUP BY ALL""",
)
def delta_gcd(spark, d):
    return S.delta_gcd(grid_packets(spark, d))


@query(
    "bit_budget",
    """WITH g AS (SELECT stream_id, pict_type, CAST(sum(tex_bits * q) AS BIGINT) AS complexity, CAST(sum(misc_bits) AS BIGINT) AS const_bits,
         count(*) AS frames FROM v_pass1 GROUP BY ALL)
       SELECT *, floor(10000.0::DOUBLE * sum(frames) OVER w / 25.0::DOUBLE) >= sum(const_bits) OVER w AS feasible FROM g WINDOW w AS (PARTITION BY stream_id)""",
)
def bit_budget(spark, d):
    return S.bit_budget(X.v_pass1(spark, d), bit_rate=10000.0, fps=25.0)


@query(
    "bit_budget_wide",
    """SELECT stream_id, count(*) FILTER (pict_type = 'A') AS "A_frames", CAST(sum(tex_bits * q) FILTER (pict_type = 'A') AS BIGINT) AS "A_complexity",
         count(*) FILTER (pict_type = 'N') AS "N_frames", CAST(sum(tex_bits * q) FILTER (pict_type = 'N') AS BIGINT) AS "N_complexity",
         count(*) FILTER (pict_type = 'R') AS "R_frames", CAST(sum(tex_bits * q) FILTER (pict_type = 'R') AS BIGINT) AS "R_complexity"
       FROM v_pass1 GROUP BY stream_id""",
)
def bit_budget_wide(spark, d):
    return S.bit_budget_wide(X.v_pass1(spark, d), ["A", "N", "R"])


def sized_packets(spark, d):
    return X.v_packets(spark, d).select(
        "stream_id", F.col("seq").alias("frame_no"), "size", (F.col("event_id") % 31 + 1).alias("q"), (F.col("event_id") % 97).alias("variance")
    )


@query(
    "size_predictor",
    """WITH p AS (SELECT stream_id, seq, size, event_id % 31 + 1 AS q, event_id % 97 AS var FROM v_packets WHERE event_id % 97 >= 10),
       k AS (SELECT *, pow(0.4::DOUBLE, row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) - 1) AS w FROM p)
       SELECT stream_id, round(sum(w * size * q / (var + 1)) + pow(0.4::DOUBLE, count(*)) * 826.0::DOUBLE, 4) AS coeff,
         round(sum(w) + pow(0.4::DOUBLE, count(*)), 6) AS count FROM k GROUP BY stream_id""",
)
def size_predictor(spark, d):
    m = S.size_predictor(sized_packets(spark, d))
    return m.select("stream_id", F.round("coeff", 4).alias("coeff"), F.round("count", 6).alias("count"))


@query(
    "smooth_same_type",
    """WITH f AS (SELECT stream_id, seq, event_id % 31 + 1 AS q, stream_index AS t FROM v_packets_n)
       SELECT a.stream_id, a.seq, round(sum(b.q * exp(-((b.seq - a.seq) * (b.seq - a.seq)) / 2.25::DOUBLE)) / sum(exp(-((b.seq - a.seq) * (b.seq - a.seq)) / 2.25::DOUBLE)), 6) AS blurred
       FROM f a JOIN f b ON a.stream_id = b.stream_id AND a.t = b.t AND b.seq BETWEEN a.seq - 3 AND a.seq + 3 GROUP BY a.stream_id, a.seq""",
)
def smooth_same_type(spark, d):
    p = X.v_packets_n(spark, d).select("stream_id", "seq", (F.col("event_id") % 31 + 1).alias("q"), F.col("stream_index").alias("pict_type"))
    out = S.smooth_same_type(p, blur=1.5, half=3, order="seq")
    return out.select("stream_id", "seq", F.round("blurred", 6).alias("blurred"))


@query(
    "build_seek_index",
    """WITH p AS (SELECT stream_id, stream_index, dts - dts % 86400000000 AS ts, event_id % 2 AS pos, size, is_key, event_id % 10 AS md, seq FROM v_packets),
       f AS (SELECT *, CASE WHEN pos = lag(pos) OVER w THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY stream_id, stream_index, ts ORDER BY seq)),
       g AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id, stream_index, ts ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM f),
       z AS (SELECT *, max(run) OVER (PARTITION BY stream_id, stream_index, ts) AS final FROM g)
       SELECT stream_id, stream_index, ts, max(pos) AS pos, max(md) AS min_distance, arg_max(size, seq) AS size, arg_max(is_key, seq) AS is_key
       FROM z WHERE run = final GROUP BY stream_id, stream_index, ts""",
)
def build_seek_index(spark, d):
    p = X.v_packets(spark, d).select(
        "stream_id", "stream_index", (F.col("dts") - F.col("dts") % 86400000000).alias("ts"), (F.col("event_id") % 2).alias("pos"),
        "size", "is_key", (F.col("event_id") % 10).alias("min_distance"), "seq",
    )
    return S.build_seek_index(p)


@query(
    "thin_index",
    """SELECT stream_id, stream_index, seq, dts FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, stream_index ORDER BY seq) AS rn,
         count(*) OVER (PARTITION BY stream_id, stream_index) AS n FROM v_packets) WHERE n < 15 OR (rn - 1) % 2 = 0""",
)
def thin_index(spark, d):
    return S.halve_index(X.v_packets(spark, d), 15).select("stream_id", "stream_index", "seq", "dts")


@query(
    "split_index",
    """WITH i AS (SELECT p_partkey AS stream_id, p_partkey * 10 AS ts, p_partkey * 100 AS pos, CAST(floor(p_retailprice * 10) AS BIGINT) AS size,
         CAST(p_size * pow(2, ceil(greatest(0, log2(1024.0::DOUBLE / p_size)))) AS BIGINT) AS b FROM part)
       SELECT stream_id, ts + off AS ts, pos + off AS pos, least(b, size - off) AS size FROM i, LATERAL (SELECT unnest(range(0, size, b)) AS off)""",
)
def split_index(spark, d):
    i = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("stream_id"), (F.col("p_partkey") * 10).alias("ts"), (F.col("p_partkey") * 100).alias("pos"),
        F.floor(F.col("p_retailprice") * 10).alias("size"), F.col("p_size").alias("sample_size"),
    )
    return S.split_index(i).select("stream_id", "ts", "pos", "size")


@query(
    "is_interleaved",
    """WITH i AS (SELECT stream_id, stream_index, seq * 1000 + CASE WHEN stream_id % 3 = 0 THEN stream_index * 900000 ELSE 0 END AS pos,
           CASE WHEN stream_id % 5 = 1 THEN 900000 ELSE 10 END AS size FROM v_packets),
       r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, stream_index ORDER BY pos) AS rn, lead(pos) OVER (PARTITION BY stream_id, stream_index ORDER BY pos) AS nx FROM i),
       s AS (SELECT stream_id, stream_index, min(pos) AS a, max(pos) AS z, coalesce(bool_or(rn = 1 AND pos + size > nx), false) AS o FROM r GROUP BY ALL)
       SELECT stream_id, NOT (bool_or(o) OR max(a) > min(z)) AS interleaved FROM s GROUP BY stream_id""",
)
def is_interleaved(spark, d):
    extra = F.when(F.col("stream_id") % 3 == 0, F.col("stream_index") * 900000).otherwise(0)
    i = X.v_packets(spark, d).select(
        "stream_id", "stream_index", (F.col("seq") * 1000 + extra).alias("pos"),
        F.when(F.col("stream_id") % 5 == 1, 900000).otherwise(10).alias("size"),
    )
    return S.is_interleaved(i).select("stream_id", "interleaved")


@query(
    "least_squares",
    """SELECT l_suppkey AS stream_id, round(covar_pop(y, x) / var_pop(x), 6) AS slope, round(avg(y) - covar_pop(y, x) / var_pop(x) * avg(x), 4) AS intercept
       FROM (SELECT l_suppkey, l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem) GROUP BY l_suppkey""",
)
def least_squares(spark, d):
    p = X.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("stream_id"), (F.col("l_extendedprice") / 1000).alias("y"), F.lit(1.0).alias("one"), F.col("l_quantity").alias("x")
    )
    out = S.least_squares(p, "y", ["one", "x"]).filter("order = 2")
    return out.select("stream_id", F.round(F.col("coeff")[1], 6).alias("slope"), F.round(F.col("coeff")[0], 4).alias("intercept"))


@query("pca")
def pca(spark, d):
    return S.pca(X.table(spark, d, "embeddings"), "embedding", 64).select("rank", F.round("eigenvalue", 9).alias("eigenvalue"))


@query(
    "vq_assign",
    """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
       c AS (SELECT * FROM (VALUES (0, -0.1::DOUBLE, -0.1::DOUBLE), (1, 0.1::DOUBLE, -0.1::DOUBLE), (2, -0.1::DOUBLE, 0.1::DOUBLE), (3, 0.1::DOUBLE, 0.1::DOUBLE)) AS t(cell, ca, cb))
       SELECT vec_id, CAST(arg_min(cell, pow(a - ca, 2) + pow(b - cb, 2)) AS INTEGER) AS cell, round(min(pow(a - ca, 2) + pow(b - cb, 2)), 9) AS error FROM p, c GROUP BY vec_id""",
)
def vq_assign(spark, d):
    p = X.table(spark, d, "embeddings").select(
        "vec_id", F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("v")
    )
    out = S.vq_assign(p, [[-0.1, -0.1], [0.1, -0.1], [-0.1, 0.1], [0.1, 0.1]])
    return out.select("vec_id", "cell", F.round("error", 9).alias("error"))


@query("vq_codebook")
def vq_codebook(spark, d):
    p = X.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    codes, _ = S.vq_codebook(p, 8, steps=5)
    return S.vq_assign(p, codes).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("error"), 6).alias("error"))


@query(
    "autocorr",
    """WITH w AS (SELECT block, i, x * (1 - pow(2.0::DOUBLE / 63 - 32 + CASE WHEN i >= 32 THEN i - 32 ELSE 31 - i END, 2)) AS d FROM v_samples)
       SELECT a.block, CAST(a.i - b.i AS INTEGER) AS lag, round(1.0::DOUBLE + sum(a.d * b.d), 3) AS autoc FROM w a JOIN w b
         ON a.block = b.block AND a.i - b.i BETWEEN 0 AND 4 GROUP BY ALL""",
)
def autocorr(spark, d):
    blocks = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("block"), F.col("embedding").alias("x"))
    out = S.autocorr(blocks, 4).select("block", F.posexplode("autoc").alias("lag", "autoc"))
    return out.withColumn("autoc", F.round("autoc", 3))


@query("lpc_order")
def lpc_order(spark, d):
    blocks = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("block"), F.col("embedding").alias("x"))
    return S.lpc_order(S.autocorr(blocks, 8)).select("block", "lpc_order")


@query(
    "bandwidth_in_use",
    """WITH e AS (SELECT t, bytes % 1000 AS d FROM v_conns UNION ALL SELECT t + 86400000000 * (1 + conn_id % 40), -(bytes % 1000) FROM v_conns)
       SELECT t, CAST(sum(sum(d)) OVER (ORDER BY t) AS BIGINT) AS in_use, sum(sum(d)) OVER (ORDER BY t) > 60000 AS over FROM e GROUP BY t""",
)
def bandwidth_in_use(spark, d):
    c = X.v_conns(spark, d).select(
        F.col("t").alias("opened"), (F.col("t") + F.lit(86400000000) * (F.col("conn_id") % 40 + 1)).alias("closed"),
        (F.col("bytes") % 1000).alias("bandwidth"),
    )
    return S.bandwidth_in_use(c, 60000)


@query(
    "connection_status",
    """SELECT conn_id, stream_id, bit_rate AS target_rate, round(bytes * 8.0::DOUBLE / (86400.0::DOUBLE * (1 + conn_id % 40)), 6) AS actual_rate, bytes
       FROM (SELECT *, src_addr % 100 AS stream_id FROM v_conns) LEFT JOIN (SELECT stream_id, bit_rate FROM v_streams WHERE stream_index = 1) USING (stream_id)""",
)
def connection_status(spark, d):
    c = X.v_conns(spark, d).select(
        "conn_id", (F.col("src_addr") % 100).alias("stream_id"), F.col("t").alias("opened"),
        (F.col("t") + F.lit(86400000000) * (F.col("conn_id") % 40 + 1)).alias("closed"), "bytes",
    )
    out = S.connection_status(c, X.v_streams(spark, d).filter("stream_index = 1"))
    return out.select("conn_id", "stream_id", "target_rate", F.round("actual_rate", 6).alias("actual_rate"), "bytes")


# --------------------------------------------------------- sequential folds


def untimed(spark, d):
    """Packets with one presentation time each, out of order within four."""
    p = X.v_packets_n(spark, d)
    pts = F.col("seq") * 40000 + F.element_at(F.array(*[F.lit(v) for v in (0, 120000, -40000, -80000)]), (F.col("seq") % 4 + 1).cast("int"))
    return p.select("stream_id", F.lit(0).alias("stream_index"), "seq", pts.cast("bigint").alias("pts"), F.lit(40000).alias("duration"))


@query(
    "dts_from_pts",
    """WITH RECURSIVE p AS (SELECT stream_id, seq, seq * 40000 + [0, 120000, -40000, -80000][seq % 4 + 1] AS pts FROM v_packets_n),
       r AS (SELECT stream_id, seq, list_sort([pts - 120000, pts - 80000, pts - 40000, pts]) AS b FROM
               (SELECT stream_id, seq, pts FROM p WHERE seq = 1)
             UNION ALL SELECT p.stream_id, p.seq, list_sort(list_append(r.b[2:4], p.pts)) FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1)
       SELECT stream_id, seq, b[1] AS dts_out FROM r""",
)
def dts_from_pts(spark, d):
    return G.dts_from_pts(untimed(spark, d), 3).select("stream_id", "seq", "dts_out")


def timed(spark, d):
    return X.v_packets_n(spark, d).select(
        "stream_id", "stream_index", "seq",
        (F.col("seq") * 40000 + F.col("event_id") % 11 * 9000 + F.when(F.col("event_id") % 50 == 0, 300000).otherwise(0)).cast("bigint").alias("pts"),
        (F.col("size") % 2000 + 200).alias("samples"), (F.col("size") * 8).alias("bits"), "size", "disc",
    )


_VS = """WITH RECURSIVE p AS (SELECT stream_id, seq, (seq * 40000 + event_id % 11 * 9000 + CASE WHEN event_id % 50 = 0 THEN 300000 ELSE 0 END) / 1e6 * 25.0::DOUBLE AS ideal FROM v_packets_n),
  r AS (SELECT stream_id, seq, {first} AS nb, {at0} AS out_at FROM p WHERE seq = 1
        UNION ALL SELECT p.stream_id, p.seq, {nb}, {pos} FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1)
  SELECT stream_id, seq, CAST(nb AS INTEGER) AS nb_frames, CAST(out_at AS BIGINT) AS out_no FROM r"""
_CFR = "CASE WHEN {l} < -1.1 THEN 0 WHEN {l} > 1.1 THEN round_even({l}, 0) ELSE 1 END"


@query(
    "video_sync",
    _VS.format(first=_CFR.format(l="ideal"), at0="0.0::DOUBLE", nb=_CFR.format(l="(ideal - (r.out_at + r.nb))"), pos="r.out_at + r.nb"),
)
def video_sync(spark, d):
    t = timed(spark, d).withColumn("stream_index", F.lit(0))
    return G.video_sync(t, fps=25.0).select("stream_id", "seq", "nb_frames", "out_no")


@query(
    "audio_sync",
    """WITH RECURSIVE p AS (SELECT stream_id, seq, (seq * 40000 + event_id % 11 * 9000 + CASE WHEN event_id % 50 = 0 THEN 300000 ELSE 0 END) / 1e6 * 48000.0::DOUBLE AS t, size % 2000 + 200 AS n FROM v_packets_n),
       r AS (SELECT stream_id, 0::BIGINT AS seq, 0::BIGINT AS total, true AS starting, 0::BIGINT AS dropped, 0::BIGINT AS silence, 0 AS compensation, 0::BIGINT AS out_samples FROM (SELECT DISTINCT stream_id FROM p)
         UNION ALL SELECT stream_id, seq, total + n - cut + fill, starting AND NOT (big AND n - cut > 0), cut, fill, CASE WHEN off AND NOT big THEN CAST(trunc(greatest(-2, least(2, delta))) AS INTEGER) ELSE 0 END, n - cut + fill FROM (
           SELECT *, CASE WHEN big AND delta < 0 THEN least(CAST(trunc(-delta) AS BIGINT), n) ELSE 0 END AS cut, CASE WHEN big AND delta >= 0 THEN CAST(trunc(delta) AS BIGINT) ELSE 0 END AS fill FROM (
             SELECT *, abs(delta) > 50 AS off, abs(delta) > 50 AND (starting OR abs(delta) > 4800) AS big FROM (
               SELECT p.stream_id, p.seq, p.n, r.total, r.starting, p.t - r.total AS delta FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1))))
       SELECT stream_id, seq, dropped, silence, compensation, out_samples FROM r WHERE seq > 0""",
)
def audio_sync(spark, d):
    t = timed(spark, d).withColumn("stream_index", F.lit(0))
    return G.audio_sync(t, rate=48000, method=2).select("stream_id", "seq", "dropped", "silence", "compensation", "out_samples")


@query(
    "monotone_output",
    """WITH RECURSIVE p AS (SELECT stream_id, seq, seq * 40000 + event_id % 11 * 9000 AS a, seq * 40000 + event_id % 11 * 9000 + 30000 AS z, disc FROM v_packets_n),
       r AS (SELECT stream_id, seq, s AS out_start, CASE WHEN z <= s THEN s + 100 ELSE z END AS out_stop FROM (SELECT *, CASE WHEN disc THEN a ELSE 0 END AS s FROM p WHERE seq = 1)
         UNION ALL SELECT p.stream_id, p.seq, CASE WHEN p.disc THEN greatest(p.a, r.out_stop) ELSE r.out_stop END,
            CASE WHEN p.z <= CASE WHEN p.disc THEN greatest(p.a, r.out_stop) ELSE r.out_stop END
                 THEN CASE WHEN p.disc THEN greatest(p.a, r.out_stop) ELSE r.out_stop END + 100 ELSE p.z END
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1)
       SELECT stream_id, seq, out_start, out_stop FROM r""",
)
def monotone_output(spark, d):
    start = F.col("seq") * 40000 + F.col("event_id") % 11 * 9000
    f = X.v_packets_n(spark, d).select("stream_id", "seq", start.alias("rt_start"), (start + 30000).alias("rt_stop"), "disc")
    return G.monotone_output(f, order="seq").select("stream_id", "seq", "out_start", "out_stop")


RTP_RULES = """WITH RECURSIVE p AS (SELECT ssrc, arrival_no, seq FROM v_rtp),
       r AS (SELECT ssrc, 0::BIGINT AS arrival_no, 0::BIGINT AS top, 0::BIGINT AS cycles, 0::BIGINT AS base, 0::BIGINT AS bad, 1 AS waits, 0::BIGINT AS received, false AS valid
             FROM (SELECT DISTINCT ssrc FROM p)
         UNION ALL SELECT ssrc, arrival_no,
             CASE WHEN kind IN ('begin', 'wait', 'next', 'again') THEN seq ELSE top END, CASE kind WHEN 'begin' THEN 0 WHEN 'again' THEN 0 WHEN 'next' THEN cycles + CASE WHEN seq < top THEN 65536 ELSE 0 END ELSE cycles END,
             CASE WHEN kind IN ('begin', 'again') THEN seq - 1 ELSE base END, CASE WHEN kind IN ('begin', 'again') THEN 65537 WHEN kind = 'jump' THEN (seq + 1) % 65536 ELSE bad END,
             CASE kind WHEN 'begin' THEN 0 WHEN 'wait' THEN 1 ELSE waits END, CASE WHEN kind IN ('begin', 'again') THEN 1 WHEN kind IN ('next', 'late') THEN received + 1 ELSE received END, kind NOT IN ('wait', 'jump')
           FROM (SELECT r.* EXCLUDE (arrival_no), p.arrival_no, p.seq, CASE WHEN waits > 0 THEN CASE WHEN p.seq = top + 1 THEN 'begin' ELSE 'wait' END
               WHEN (p.seq - top + 65536) % 65536 < 3000 THEN 'next' WHEN (p.seq - top + 65536) % 65536 <= 65436 THEN CASE WHEN p.seq = bad THEN 'again' ELSE 'jump' END ELSE 'late' END AS kind
             FROM r JOIN p ON p.ssrc = r.ssrc AND p.arrival_no = r.arrival_no + 1))
       """


@query("rtp_sequence", RTP_RULES + "SELECT ssrc, arrival_no, valid, cycles + top AS ext_seq, received FROM r WHERE arrival_no > 0")
def rtp_sequence(spark, d):
    return G.rtp_sequence(X.v_rtp(spark, d)).select("ssrc", "arrival_no", "valid", "ext_seq", "received")


@query(
    "reception_report",
    RTP_RULES + """SELECT ssrc, "interval", ext_max, expected, received, least(expected - received, 16777215) AS lost,
         CASE WHEN de = 0 OR de - dr <= 0 THEN 0 ELSE (de - dr) * 256 // de END AS fraction FROM (
         SELECT *, expected - coalesce(lag(expected) OVER w, 0) AS de, received - coalesce(lag(received) OVER w, 0) AS dr FROM (
           SELECT r.ssrc, v.arrival_us // 86400000000 AS "interval", arg_max(cycles + top, r.arrival_no) AS ext_max, arg_max(cycles + top - base + 1, r.arrival_no) AS expected, arg_max(received, r.arrival_no) AS received
           FROM r JOIN v_rtp v ON v.ssrc = r.ssrc AND v.arrival_no = r.arrival_no WHERE valid GROUP BY ALL) WINDOW w AS (PARTITION BY ssrc ORDER BY "interval"))""",
)
def reception_report(spark, d):
    r = G.rtp_sequence(X.v_rtp(spark, d)).withColumn("interval", F.expr("arrival_us div 86400000000"))
    return S.reception_report(r)


@query(
    "clock_filter",
    """WITH RECURSIVE p AS (SELECT stream_id, seq, CAST(seq * 1000 + event_id % 7 AS DOUBLE) AS t FROM v_packets_n),
       r AS (SELECT stream_id, seq, t AS cyc, 1000.0::DOUBLE AS clk FROM p WHERE seq = 1
         UNION ALL SELECT p.stream_id, p.seq, r.cyc + r.clk + greatest(0.1::DOUBLE, 1.0::DOUBLE / p.seq) * (p.t - (r.cyc + r.clk)), r.clk + 0.01::DOUBLE * (p.t - (r.cyc + r.clk))
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1)
       SELECT stream_id, seq, round(cyc, 6) AS smooth_time FROM r""",
)
def clock_filter(spark, d):
    t = X.v_packets_n(spark, d).select(
        "stream_id", "seq", (F.col("seq") * 1000 + F.col("event_id") % 7).cast("double").alias("time"), F.lit(1.0).alias("step")
    )
    out = G.clock_filter(t, period=1000.0, factor2=0.1, factor3=0.01)
    return out.select("stream_id", "seq", F.round("smooth_time", 6).alias("smooth_time"))


@query(
    "vbv_audit",
    """WITH RECURSIVE p AS (SELECT stream_id, seq, size * 8 AS bits FROM v_packets_n),
       f AS (SELECT stream_id, seq, bits, 0 AS k FROM p),
       r AS (SELECT stream_id, 0::BIGINT AS seq, 150000::BIGINT AS level, false AS underflow FROM (SELECT DISTINCT stream_id FROM p)
         UNION ALL SELECT p.stream_id, p.seq, greatest(r.level - p.bits, 0) + greatest(0, least(80000, 200000 - greatest(r.level - p.bits, 0) - 1)), r.level - p.bits < 0
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1)
       SELECT stream_id, seq, CAST(level AS DOUBLE) AS level, underflow FROM r WHERE seq > 0""",
)
def vbv_audit(spark, d):
    b = X.v_packets_n(spark, d).select("stream_id", "seq", (F.col("size") * 8).alias("bits"))
    out = G.vbv_audit(b, size=200000, min_rate=0, max_rate=2_000_000, fps=25.0, order="seq")
    return out.select("stream_id", "seq", "level", "underflow")


@query(
    "data_rate",
    """WITH RECURSIVE p AS (SELECT stream_id, seq, dts // 1000 AS t, seq * 1400 + event_id % 100 AS n FROM v_packets_n),
       r AS (SELECT stream_id, seq, t AS t1, n AS n1, t AS t2, n AS n2, 0::BIGINT AS rate FROM p WHERE seq = 1
         UNION ALL SELECT stream_id, seq, a, b, c, d, CASE WHEN t > a THEN (n - b) * 1000 // (t - a) ELSE 0 END FROM (
           SELECT p.stream_id, p.seq, p.t, p.n, CASE WHEN p.t - r.t2 > 5000 THEN r.t2 ELSE r.t1 END AS a, CASE WHEN p.t - r.t2 > 5000 THEN r.n2 ELSE r.n1 END AS b,
             CASE WHEN p.t - r.t2 > 5000 THEN p.t ELSE r.t2 END AS c, CASE WHEN p.t - r.t2 > 5000 THEN p.n ELSE r.n2 END AS d
           FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1))
       SELECT stream_id, seq, rate FROM r""",
)
def data_rate(spark, d):
    t = X.v_packets_n(spark, d).select(
        "stream_id", "seq", F.expr("dts div 1000").alias("t_ms"), (F.col("seq") * 1400 + F.col("event_id") % 100).alias("bytes_total")
    )
    return G.data_rate(t).select("stream_id", "seq", "rate")


@query(
    "audio_block_times",
    """WITH RECURSIVE p AS (SELECT stream_id, seq, CASE WHEN event_id % 3 = 0 THEN seq * 100000 + event_id % 5 * 1500 END AS own, 10000000 * size // 192000 AS len FROM v_packets_n),
       r AS (SELECT stream_id, seq, coalesce(own, 0) AS out_start, coalesce(own, 0) + len AS out_stop FROM p WHERE seq = 1
         UNION ALL SELECT stream_id, seq, st, st + len FROM (SELECT p.stream_id, p.seq, p.len,
             CASE WHEN own IS NOT NULL AND (r.out_stop = 0 OR own >= r.out_stop OR own - r.out_stop < -2000) THEN own ELSE r.out_stop END AS st
           FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1))
       SELECT stream_id, seq, out_start, out_stop FROM r""",
)
def audio_block_times(spark, d):
    t = X.v_packets_n(spark, d).select(
        "stream_id", "seq", F.when(F.col("event_id") % 3 == 0, F.col("seq") * 100000 + F.col("event_id") % 5 * 1500).alias("rt_start"), "size"
    )
    return G.audio_block_times(t, bytes_per_second=192000).select("stream_id", "seq", "out_start", "out_stop")


_, _BACK, _GAIN = G.butterworth(4, 0.3)


@query(
    "iir_lowpass",
    f"""WITH RECURSIVE s AS (SELECT block // 100 AS stream_id, block % 100 * 64 + i AS sample_no, floor(x * 20000) AS x FROM v_samples),
       r AS (SELECT stream_id, -1::BIGINT AS sample_no, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d, 0.0::DOUBLE AS y FROM (SELECT DISTINCT stream_id FROM s)
         UNION ALL SELECT stream_id, sample_no, b, c, d, e, a + 4 * b + 6 * c + 4 * d + e FROM (SELECT s.stream_id, s.sample_no, a, b, c, d,
             s.x * {_GAIN!r}::DOUBLE + a * {_BACK[0]!r}::DOUBLE + b * {_BACK[1]!r}::DOUBLE + c * {_BACK[2]!r}::DOUBLE + d * {_BACK[3]!r}::DOUBLE AS e
           FROM r JOIN s ON s.stream_id = r.stream_id AND s.sample_no = r.sample_no + 1))
       SELECT stream_id, sample_no, CAST(greatest(-32768, least(32767, round_even(y, 0))) AS INTEGER) AS y FROM r WHERE sample_no >= 0""",
)
def iir_lowpass(spark, d):
    s = X.v_samples(spark, d).select(
        F.expr("block div 100").alias("stream_id"), (F.col("block") % 100 * 64 + F.col("i")).alias("sample_no"), F.floor(F.col("x") * 20000).alias("x")
    )
    return G.iir_lowpass(s, order=4, cutoff=0.3).select("stream_id", "sample_no", "y")


@query(
    "repair_delayed",
    """WITH RECURSIVE p AS (SELECT stream_id, stream_index, seq, row_number() OVER (PARTITION BY stream_id, stream_index ORDER BY seq) AS n, CASE WHEN event_id % 3 = 0 THEN pts END AS pts,
           CASE WHEN event_id % 2 = 0 THEN dts END AS dts, event_id % 3 <> 0 AS b FROM v_packets),
       w AS (SELECT * REPLACE (CASE WHEN dts > pts THEN dts - 8589934592 ELSE dts END AS dts) FROM p),
       q AS (SELECT stream_id, stream_index, seq, n, NOT b OR coalesce(pts > dts, false) AS held, CASE WHEN NOT b AND pts = dts THEN NULL ELSE pts END AS pts,
           CASE WHEN NOT b AND pts = dts THEN NULL ELSE dts END AS dts FROM w),
       r AS (SELECT stream_id, stream_index, 0::BIGINT AS seq, 0::BIGINT AS n, NULL::BIGINT AS pts_out, NULL::BIGINT AS dts_out, 0::BIGINT AS clock, NULL::BIGINT AS shown FROM (SELECT DISTINCT stream_id, stream_index FROM q)
         UNION ALL SELECT stream_id, stream_index, seq, n, CASE WHEN held THEN pts ELSE t END, CASE WHEN held THEN coalesce(dts, shown, clock) ELSE t END,
             40000 + CASE WHEN held THEN coalesce(dts, shown, clock) ELSE t END, CASE WHEN held THEN pts ELSE shown END FROM (
           SELECT q.*, r.clock, r.shown, coalesce(q.pts, q.dts, r.clock) + CASE WHEN abs(r.clock - 40000 - q.pts) < abs(r.clock - q.pts) AND abs(r.clock - 40000 - q.pts) < 5000 THEN 40000 ELSE 0 END AS t
           FROM r JOIN q ON q.stream_id = r.stream_id AND q.stream_index = r.stream_index AND q.n = r.n + 1))
       SELECT stream_id, stream_index, seq, pts_out, dts_out FROM r WHERE n > 0""",
)
def repair_delayed(spark, d):
    p = X.v_packets(spark, d).select(
        "stream_id", "stream_index", "seq", F.when(F.col("event_id") % 3 == 0, F.col("pts")).alias("pts"),
        F.when(F.col("event_id") % 2 == 0, F.col("dts")).alias("dts"), F.lit(40000).alias("duration"), (F.col("event_id") % 3 != 0).alias("is_b"),
    )
    return G.repair_delayed(p).select("stream_id", "stream_index", "seq", "pts_out", "dts_out")

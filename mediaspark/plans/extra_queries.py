"""Queries of single functions, unit assembly, live filters and live captions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from mediaspark.functions import picture as Pic
from mediaspark.functions import text as Tx
from mediaspark.functions import timebase as Tb
from mediaspark.operators import audio as Au
from mediaspark.operators import lines as L
from mediaspark.operators import stats as S
from mediaspark.operators import transport as T
from mediaspark.operators.scan import chunk_id, number_rows
from mediaspark.plans import fixtures as X
from mediaspark.plans.registry import query
from mediaspark.plans.source_queries import finished, folder, live
from mediaspark.sources import sinks as W
from mediaspark.streaming import twins

GENRES = ("Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop")


@query(
    "wrap_diff",
    """SELECT event_id, CASE WHEN d < 0 THEN d + 65536 ELSE d END AS diff FROM (SELECT event_id, event_id * 7919 % 65536 - event_id * 104729 % 65536 AS d FROM events)""",
)
def wrap_diff(spark, d):
    e = F.col("event_id")
    return X.events(spark, d).select("event_id", Tb.wrap_diff(e * 7919 % 65536, e * 104729 % 65536, 16).alias("diff"))


@query(
    "genre_name",
    f"""SELECT event_id, CASE WHEN n BETWEEN 0 AND {len(GENRES) - 1} THEN {list(GENRES)}[CAST(n + 1 AS INTEGER)] END AS genre
        FROM (SELECT event_id, event_id % 13 - 2 AS n FROM events)""",
)
def genre_name(spark, d):
    return X.events(spark, d).select("event_id", Tx.genre_name((F.col("event_id") % 13 - 2).cast("int"), GENRES).alias("genre"))


@query(
    "floored_mod",
    """SELECT event_id, a, b, CAST(a - floor(a / b::DOUBLE) * b AS BIGINT) AS m FROM
       (SELECT event_id, event_id - 4000 AS a, (event_id % 9 + 1) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS b FROM events)""",
)
def floored_mod(spark, d):
    e = X.events(spark, d).select("event_id", (F.col("event_id") - 4000).alias("a"), F.expr("(event_id % 9 + 1) * IF(event_id % 2 = 0, 1, -1)").alias("b"))
    return e.withColumn("m", Tx.floored_mod(F.col("a"), F.col("b")).cast("bigint"))


URL = r"^([a-z]+)://([^/]*)(.*)$"


@query(
    "join_url",
    f"""SELECT page_id, regexp_extract(url, '{URL}', 1) || '://' || regexp_extract(url, '{URL}', 2)
          || CASE WHEN page_id % 4 > 0 THEN ':' || (page_id % 4 * 1000)::VARCHAR ELSE '' END || regexp_extract(url, '{URL}', 3) AS joined FROM pages""",
)
def join_url(spark, d):
    part = lambda i: F.regexp_extract("url", URL, i)
    port = F.when(F.col("page_id") % 4 > 0, F.col("page_id") % 4 * 1000).otherwise(-1)
    return X.table(spark, d, "pages").select("page_id", Tx.join_url(part(1), part(2), port, part(3)).alias("joined"))


@query(
    "chroma_420",
    """WITH p AS (SELECT stream_id, frame_no, CASE WHEN frame_no % 2 = 0 THEN 'Y' ELSE 'U' END AS plane, line_no, x, p FROM v_px)
       SELECT * FROM p WHERE plane = 'Y' UNION ALL
       SELECT stream_id, frame_no, plane, line_no // 2, x // 2, CAST((sum(p) + 2) // 4 AS INTEGER) FROM p WHERE plane <> 'Y' GROUP BY ALL""",
)
def chroma_420(spark, d):
    v = X.v_lines(spark, d).withColumn("plane", F.when(F.col("frame_no") % 2 == 0, "Y").otherwise("U"))
    return L.chroma_420(v).select("stream_id", "frame_no", "plane", "line_no", F.posexplode("px").alias("x", "p"))


@query(
    "map_blocks",
    "SELECT block, round(sum(x * x), 9) AS energy, round(max(abs(x)), 9) AS peak FROM v_samples GROUP BY block",
)
def map_blocks(spark, d):
    def levels(b: pd.DataFrame) -> pd.DataFrame:
        x = b["x"].map(lambda v: [float(s) for s in v])
        return pd.DataFrame({"block": b["block"], "energy": x.map(lambda v: sum(s * s for s in v)), "peak": x.map(lambda v: max(map(abs, v)))})

    blocks = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("block"), F.col("embedding").alias("x"))
    out = Au.map_blocks(blocks, levels, "block bigint, energy double, peak double")
    return out.select("block", F.round("energy", 9).alias("energy"), F.round("peak", 9).alias("peak"))


def unit_packets(spark, d):
    """One elementary stream unit per event in up to three packets; the middle one of some is lost.

    Units of odd events give their length, ten bytes less than follow; the others have length 0.
    """
    e = F.col("event_id")
    m = (e % 16 + 1).cast("int")
    n = F.ceil((F.lit(6) + m * 32) / F.lit(184)).cast("int")
    p = X.events(spark, d).select("event_id", (F.col("user_id") % 8).alias("pid"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    p = p.withColumn("packet_no", e * 4 + F.col("k"))
    p = number_rows(p, ["pid"], ["packet_no"], [chunk_id("packet_no")], "__n").withColumn("cc", (F.col("__n") % 16).cast("int"))
    p = p.filter(~((e % 23 == 0) & (F.col("k") == 1) & (F.col("n") == 3)))
    size = F.when(e % 2 == 1, m * 32 - 10).otherwise(0)
    whole = F.unhex(F.concat(F.lit("000001E0"), F.lpad(F.hex(size.cast("bigint")), 4, "0"), F.repeat(F.sha2(e.cast("string"), 256), m)))
    return p.select(F.lit(0).alias("stream_id"), "pid", "packet_no", "cc", (F.col("k") == 0).alias("pusi"), F.substring(whole, F.col("k") * 184 + 1, F.lit(184)).alias("payload"))


@query(
    "assemble_pes",
    """SELECT user_id % 8 AS pid, event_id * 4 AS first_packet, 0 AS part_no, n, md5(substr('000001e0' || printf('%04x', CASE WHEN event_id % 2 = 1 THEN 32 * m - 10 ELSE 0 END)
         || repeat(sha256(event_id::VARCHAR), m), 1, 2 * n)) AS digest
       FROM (SELECT *, CAST(event_id % 16 + 1 AS INTEGER) AS m, CAST(32 * (event_id % 16 + 1) + CASE WHEN event_id % 2 = 1 THEN -4 ELSE 6 END AS INTEGER) AS n FROM events)
       WHERE NOT (event_id % 23 = 0 AND 6 + 32 * m > 368)""",
)
def assemble_pes(spark, d):
    u = T.assemble_pes(unit_packets(spark, d))
    return u.select("pid", "first_packet", F.col("part_no").cast("int").alias("part_no"), F.octet_length("data").alias("n"), F.md5(F.encode(F.lower(F.hex("data")), "utf-8")).alias("digest"))


@query(
    "skip_preroll",
    """SELECT user_id AS stream_id, event_id, CAST(floor(value * 100) AS BIGINT) - 2000 AS rt_stop FROM events WHERE floor(value * 100) > 2000 AND event_type <> 'signup'""",
)
def skip_preroll(spark, d):
    e = live(spark, d, "events").select(
        F.col("user_id").alias("stream_id"), "event_id", (F.floor(F.col("value") * 100) - 2000).alias("rt_stop"), (F.col("event_type") == "signup").alias("preroll")
    )
    return finished(spark, twins.skip_preroll(e), "preroll").select("stream_id", "event_id", "rt_stop")


@query("merge_inputs", "SELECT event_id, user_id AS stream_id, epoch_us(ts) AS t, CASE WHEN event_type = 'view' THEN 'a' ELSE 'b' END AS input FROM events")
def merge_inputs(spark, d):
    def one(name: str, views: bool):
        e = live(spark, d, "events").filter((F.col("event_type") == "view") == F.lit(views))
        return e.select("event_id", F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(name).alias("input"))

    both = twins.merge_inputs([one("a", True), one("b", False)], "ts", late="3650 days")
    return finished(spark, both, "merged").select("event_id", "stream_id", F.unix_micros("ts").alias("t"), "input")


@query(
    "live_cues",
    """WITH e AS (SELECT *, epoch_us(ts) AS t FROM events), c AS (SELECT user_id, event_id, t AS start, CASE WHEN event_id % 4 = 0 THEN NULL ELSE t + event_id % 5 * 21600000000 END AS stop FROM e WHERE event_type = 'signup')
       SELECT e.user_id AS stream_id, e.event_id AS frame, c.event_id AS cue FROM e JOIN c ON e.user_id = c.user_id AND e.event_type = 'view' AND e.t >= c.start AND (c.stop IS NULL OR e.t < c.stop)""",
)
def live_cues(spark, d):
    """Captions of a live feed: some last a day, some have no end."""
    def of(kind: str):
        e = live(spark, d, "events").filter(F.col("event_type") == kind)
        return e.select(F.col("user_id").alias("stream_id"), "event_id", F.col("ts").cast("timestamp").alias("at"))

    frames = of("view").withColumnsRenamed({"event_id": "frame", "at": "t"})
    lasts = F.expr("make_dt_interval(0, int(event_id % 5 * 6))")
    cues = of("signup").select("stream_id", F.col("event_id").alias("cue"), F.col("at").alias("start"), F.when(F.col("event_id") % 4 != 0, F.col("at") + lasts).alias("stop"))
    out = finished(spark, twins.live_cues(frames, cues, late="3650 days"), "cues")
    return out.select("stream_id", "frame", "cue")


def _formats() -> str:
    rows = ", ".join(
        f"({i}, '{n}', {depth}, {6 if n == 'rgb565le' else depth}, '{family}', {str(alpha).lower()}, '{layout}', {cw}, {ch}, {Pic._bits(f)})"
        for i, f in enumerate(Pic.PIXEL_FORMATS) for n, _, depth, family, alpha, layout, cw, ch, _ in [f]
    )
    return f"f AS (SELECT * FROM (VALUES {rows}) AS t(ord, name, depth, fine, family, alpha, layout, cw, ch, bits))"


#: The candidate that loses least, by a join of the property table with itself.
BEST_FORMAT = f"""WITH {_formats()},
  l AS (SELECT s.name AS src, d.name AS dst, d.bits * 100 + d.ord AS cost, d.depth < s.depth OR d.fine < s.fine AS depth, d.cw > s.cw OR d.ch > s.ch AS res,
      NOT list_contains(CASE d.family WHEN 'rgb' THEN ['rgb', 'gray'] WHEN 'gray' THEN ['gray'] WHEN 'yuv' THEN ['yuv'] ELSE ['yuvj', 'yuv', 'gray'] END, s.family) AS color,
      d.family = 'gray' AND s.family <> 'gray' AS chroma, d.layout = 'palette' AND s.layout <> 'palette' AND s.family <> 'gray' AS quant FROM f s, f d),
  r AS (SELECT src, dst, cost, CASE WHEN NOT (depth OR res OR color OR chroma OR quant) THEN 0 WHEN NOT (depth OR color OR chroma OR quant) THEN 2 WHEN NOT (depth OR chroma OR quant) THEN 3
      WHEN NOT (depth OR res OR color OR chroma) THEN 4 WHEN NOT (res OR color OR chroma OR quant) THEN 5 ELSE 6 END AS rank FROM l)
  SELECT event_id, arg_min(c.name, rank * 10000 + cost) AS format FROM events
    JOIN f s ON s.ord = event_id % {len(Pic.PIXEL_FORMATS)} LEFT JOIN f c ON (event_id >> (c.ord % 11)::INTEGER) % 2 = 1 LEFT JOIN r ON r.src = s.name AND r.dst = c.name GROUP BY event_id"""

#: Levinson's recursion over the orders of a block, one step per level.
LPC_ORDER = """WITH RECURSIVE w AS (SELECT block, i, x * (1 - pow(2.0::DOUBLE / 63 - 32 + CASE WHEN i >= 32 THEN i - 32 ELSE 31 - i END, 2)) AS d FROM v_samples),
  c AS (SELECT a.block, a.i - b.i AS lag, 1.0::DOUBLE + sum(a.d * b.d) AS v FROM w a JOIN w b ON a.block = b.block AND a.i - b.i BETWEEN 0 AND 8 GROUP BY ALL),
  a AS (SELECT block, list(v ORDER BY lag) AS a FROM c GROUP BY block),
  r AS (SELECT block, a, 0 AS i, [1.0::DOUBLE] AS l, a[1] AS err, 1 AS best FROM a
    UNION ALL SELECT block, a, i + 1, list_transform(range(0, i + 2), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE p[j + 1] + k * p[i + 2 - j] END), err * (1 - k * k),
        CASE WHEN abs(k) > 0.1 THEN i + 1 ELSE best END
      FROM (SELECT *, list_append(l, 0.0::DOUBLE) AS p, CASE WHEN err <> 0 THEN -list_sum(list_transform(range(0, i + 1), lambda j: l[j + 1] * a[i + 2 - j])) / err ELSE 0 END AS k FROM r WHERE i < 8))
  SELECT block, CAST(best AS INTEGER) AS lpc_order FROM r WHERE i = 8"""


@query(
    "pca_moments",
    """WITH m AS (SELECT i, avg(x) AS m FROM v_samples GROUP BY i),
       c AS (SELECT a.i, b.i AS j, avg(a.x * b.x) - any_value(m.m) * any_value(n.m) AS v FROM v_samples a JOIN v_samples b ON a.block = b.block JOIN m ON m.i = a.i JOIN m n ON n.i = b.i GROUP BY ALL)
       SELECT round(sum(v) FILTER (i = j), 6) AS trace, round(sum(v * v), 6) AS squares FROM c""",
)
def pca_moments(spark, d):
    """What the eigenvalues must add up to: the trace of the covariance, and the sum of its squares."""
    p = S.pca(X.table(spark, d, "embeddings"), "embedding", 64)
    return p.groupBy().agg(F.round(F.sum("eigenvalue"), 6).alias("trace"), F.round(F.sum(F.col("eigenvalue") ** 2), 6).alias("squares"))


@query(
    "write_packets",
    """SELECT event_id, stream_index, printf('%05d_%02d_%d_%d_%s.bin', seq, stream_index, coalesce(pts, -9223372036854775808), size, CASE WHEN is_key THEN 'K' ELSE '_' END) AS name,
         md5(event_id::VARCHAR) AS data FROM v_packets""",
)
def write_packets(spark, d):
    """Packets written to one folder per stream, and read again."""
    path = folder(spark, "packets")
    W.write_packets(X.v_packets(spark, d).withColumn("data", F.md5(F.col("event_id").cast("string"))), path)
    return spark.read.parquet(path).select("event_id", F.col("stream_index").cast("int").alias("stream_index"), "name", "data")


@query(
    "thin_index_to_fit",
    """SELECT stream_id, stream_index, seq, dts FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, stream_index ORDER BY seq) AS rn,
         count(*) OVER (PARTITION BY stream_id, stream_index) AS n FROM v_packets)
       WHERE n < 8 OR (rn - 1) % CAST(pow(2, greatest(1, ceil(log2(n / 7.5::DOUBLE)))) AS BIGINT) = 0""",
)
def thin_index_to_fit(spark, d):
    return S.thin_index(X.v_packets(spark, d), 8).select("stream_id", "stream_index", "seq", "dts")

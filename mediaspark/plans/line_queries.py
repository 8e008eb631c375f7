"""Queries over fields, cadence and picture lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaspark.operators import fields as E
from mediaspark.operators import joins as J
from mediaspark.operators import lines as L
from mediaspark.plans import fixtures as X
from mediaspark.plans.registry import query

KEYS = ["stream_id", "frame_no", "plane", "line_no"]


def pixels(df, *keys):
    return df.select(*(keys or KEYS), F.posexplode("px").alias("x", "p"))


def vertical(expr: str, parity: int | None, taps: dict[str, str]) -> str:
    """SQL of a vertical filter: ``taps`` names the lines it reads."""
    cols = ", ".join(f"{v} AS {k}" for k, v in taps.items())
    ready = " AND ".join(f"{k} IS NOT NULL" for k in taps)
    where = ready if parity is None else f"line_no % 2 = {parity} AND {ready}"
    return f"""SELECT stream_id, frame_no, plane, line_no, CAST(x AS INTEGER) AS x, CAST(CASE WHEN {where} THEN {expr} ELSE p END AS INTEGER) AS p
      FROM (SELECT *, {cols} FROM v_px WINDOW w AS (PARTITION BY stream_id, frame_no, plane, x ORDER BY line_no))"""


def up(n, *alt):
    return f"coalesce(lag(p, {n}) OVER w{''.join(', ' + a for a in alt)})"


def down(n, *alt):
    return f"coalesce(lead(p, {n}) OVER w{''.join(', ' + a for a in alt)})"


LAG1, LEAD1 = "lag(p) OVER w", "lead(p) OVER w"
CLIP = "least(255, greatest(0, ({}) >> {}))"


@query("deint_linear", vertical("(a + b + 1) >> 1", 1, {"a": up(1, LEAD1), "b": down(1, LAG1)}))
def deint_linear(spark, d):
    return pixels(L.deint_linear(X.v_lines(spark, d)))


@query(
    "deint_cubic",
    vertical(
        CLIP.format("9 * b + 9 * c - a - d", 4), 1,
        {"a": up(3, LAG1, LEAD1), "b": up(1, LEAD1), "c": down(1, LAG1), "d": down(3, LEAD1, LAG1)},
    ),
)
def deint_cubic(spark, d):
    return pixels(L.deint_cubic(X.v_lines(spark, d)))


@query(
    "deint_ff",
    vertical(
        CLIP.format("4 * b + 2 * p + 4 * c - a - d + 4", 3), 1,
        {"a": up(2, LAG1), "b": up(1, "p"), "c": down(1, "p"), "d": down(2, "p")},
    ),
)
def deint_ff(spark, d):
    return pixels(L.deint_ff(X.v_lines(spark, d)))


@query(
    "deint_lowpass5",
    vertical(
        CLIP.format("2 * b + 2 * c + 6 * p - a - d + 4", 3), None,
        {"a": up(2, LAG1, "p"), "b": up(1, "p"), "c": down(1, "p"), "d": down(2, LEAD1, "p")},
    ),
)
def deint_lowpass5(spark, d):
    return pixels(L.deint_lowpass5(X.v_lines(spark, d)))


@query("deint_blend", vertical("(p + ((a + b) >> 1) + 1) >> 1", None, {"a": up(1, "p"), "b": down(1, "p")}))
def deint_blend(spark, d):
    return pixels(L.deint_blend(X.v_lines(spark, d)))


@query("deint_median", vertical("a + p + b - greatest(a, p, b) - least(a, p, b)", 1, {"a": up(1, "p"), "b": down(1, "p")}))
def deint_median(spark, d):
    return pixels(L.deint_median(X.v_lines(spark, d)))


@query(
    "bob",
    """SELECT stream_id, frame_no, plane, line_no * 2 + o AS line_no, CAST(x AS INTEGER) AS x, p FROM v_px, (SELECT unnest([0, 1]) AS o)""",
)
def bob(spark, d):
    return pixels(L.bob(X.v_lines(spark, d)))


def field_lines(spark, d):
    return X.v_lines(spark, d).withColumnRenamed("frame_no", "field_no").withColumn("is_top", F.col("field_no") % 2 == 0)


@query(
    "weave",
    """SELECT a.stream_id, a.frame_no AS field_no, a.plane, a.line_no * 2 + CASE WHEN a.frame_no % 2 = 0 THEN 0 ELSE 1 END AS line_no,
         CAST(a.x AS INTEGER) AS x, a.p FROM v_px a WHERE a.frame_no > 0
       UNION ALL SELECT b.stream_id, b.frame_no + 1, b.plane, b.line_no * 2 + CASE WHEN b.frame_no % 2 = 1 THEN 1 ELSE 0 END, CAST(b.x AS INTEGER), b.p
       FROM v_px b WHERE EXISTS (SELECT 1 FROM v_lines n WHERE n.stream_id = b.stream_id AND n.line_no = b.line_no AND n.frame_no = b.frame_no + 1)""",
)
def weave(spark, d):
    return pixels(L.weave(field_lines(spark, d)), "stream_id", "field_no", "plane", "line_no")


MOVE = """SELECT stream_id, plane, line_no, frame_no, x, p, least(127, count(*) FILTER (NOT moved) OVER (
      PARTITION BY stream_id, plane, line_no, x, island ORDER BY frame_no)) AS still FROM (
    SELECT *, sum(CASE WHEN moved THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, plane, line_no, x ORDER BY frame_no) AS island FROM (
      SELECT *, coalesce(abs(p - lag(p) OVER (PARTITION BY stream_id, plane, line_no, x ORDER BY frame_no)) >= 8, true) AS moved FROM v_px))"""


@query("movement_map", f"SELECT stream_id, plane, line_no, frame_no, CAST(x AS INTEGER) AS x, CAST(still AS INTEGER) AS still FROM ({MOVE})")
def movement_map(spark, d):
    m = L.movement_map(X.v_lines(spark, d))
    return m.select("stream_id", "plane", "line_no", "frame_no", F.posexplode("still").alias("x", "still"))


@query(
    "diag_deinterlace",
    f"""WITH m AS ({MOVE}),
     v AS (SELECT *, lag(p) OVER w AS b, lead(p) OVER w AS e, lag(still) OVER w AS sa, lead(still) OVER w AS sb FROM m
        WINDOW w AS (PARTITION BY stream_id, frame_no, plane, x ORDER BY line_no)),
     f AS (SELECT * REPLACE (coalesce(b, e) AS b, coalesce(e, b) AS e, coalesce(sa, sb) AS sa, coalesce(sb, sa) AS sb) FROM v),
     h AS (SELECT *, lag(b) OVER w AS a, lead(b) OVER w AS c, lag(e) OVER w AS dd, lead(e) OVER w AS ff FROM f
        WINDOW w AS (PARTITION BY stream_id, frame_no, plane, line_no ORDER BY x)),
     s AS (SELECT *, (abs(a - e) + abs(b - ff) + 1) >> 1 AS sr, (abs(b - dd) + abs(c - e) + 1) >> 1 AS sf FROM h),
     r AS (SELECT *, CASE WHEN sf <= sr THEN 255 ELSE abs(a - ff) END AS ri, CASE WHEN sf > sr THEN 255 ELSE abs(c - dd) END AS fa FROM s)
     SELECT stream_id, frame_no, plane, line_no, CAST(x AS INTEGER) AS x, CAST(CASE WHEN line_no % 2 = 0 OR b IS NULL THEN p
        WHEN still > 1 AND (sa > 1 OR sb > 1) THEN p
        WHEN x < 4 OR x >= 60 OR abs(b - e) <= least(ri, fa) OR abs(b - e) <= 15 THEN (b + e + 1) >> 1
        WHEN ri <= fa THEN (a + ff + 1) >> 1 ELSE (c + dd + 1) >> 1 END AS INTEGER) AS p FROM r""",
)
def diag_deinterlace(spark, d):
    lines = X.v_lines(spark, d)
    still = L.movement_map(lines)
    return pixels(L.diag_deinterlace(lines.join(still, ["stream_id", "plane", "line_no", "frame_no"])))


# ------------------------------------------------------------------ fields

V_TIMED = "SELECT stream_id, frame_no, rt_start, rt_start + nb_fields * 200003 AS rt_stop, nb_fields, progressive, tff FROM v_frames"


def timed_frames(spark, d):
    return X.v_frames(spark, d).withColumn("rt_stop", F.col("rt_start") + F.col("nb_fields") * 200003)


ORACLE_OF_FIELDS = f"""WITH t AS ({V_TIMED}), n AS (SELECT *, coalesce(sum(nb_fields) OVER (PARTITION BY stream_id ORDER BY frame_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f0 FROM t)
  SELECT stream_id, frame_no, CAST(f0 + k AS BIGINT) AS field_no, tff = (k % 2 = 0) AS is_top,
    CASE WHEN progressive THEN CASE WHEN nb_fields = 3 THEN ['AFTERNEXT_32', 'NEXT_32', 'PREV_32'][k + 1] ELSE ['NEXT_22', 'PREV_22'][k + 1] END END AS hint,
    CASE WHEN k = nb_fields - 1 THEN rt_stop ELSE rt_start + (k + 1) * (rt_stop - rt_start) // nb_fields END AS end_time
  FROM n, LATERAL (SELECT unnest(range(nb_fields)) AS k)"""


@query("field_split", ORACLE_OF_FIELDS)
def field_split(spark, d):
    return E.field_split(timed_frames(spark, d))


@query("split_fields", ORACLE_OF_FIELDS)
def split_fields(spark, d):
    """The same by a table function over chunks of frames in order."""
    return E.split_fields(timed_frames(spark, d))


@query(
    "cadence_flag",
    """WITH l AS (SELECT *, lag(nb_fields) OVER w AS nf, lag(progressive) OVER w AS pf FROM v_frames WINDOW w AS (PARTITION BY stream_id ORDER BY frame_no)),
       e AS (SELECT *, CASE WHEN nf IS NULL THEN NULL WHEN progressive AND nb_fields = 3 AND nf <> 3 THEN true
           WHEN progressive AND nb_fields <> 3 AND nf <> 3 THEN false
           WHEN NOT progressive AND (nf <> 3 OR NOT pf OR nb_fields > 2) THEN false END AS ev FROM l)
       SELECT stream_id, frame_no, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame_no), false) AS film FROM e""",
)
def cadence_flag(spark, d):
    return E.cadence_flag(X.v_frames(spark, d)).select("stream_id", "frame_no", "film")


FILM = """WITH RECURSIVE h AS (SELECT stream_id, field_no, CASE WHEN stream_id % 2 = 0 THEN hint
      ELSE ['AFTERNEXT_32', 'NEXT_32', 'PREV_32', 'NEXT_22', 'PREV_22'][(field_no + stream_id) % 5 + 1] END AS hint FROM v_fields),
  r AS (SELECT stream_id, field_no, hint, CASE hint WHEN 'AFTERNEXT_32' THEN 3 WHEN 'NEXT_22' THEN 2 ELSE 0 END AS k,
      CASE hint WHEN 'AFTERNEXT_32' THEN (7 - field_no % 5) % 5 WHEN 'NEXT_22' THEN field_no % 2 ELSE 0 END AS idx FROM h WHERE field_no = 0
    UNION ALL SELECT h.stream_id, h.field_no, h.hint,
      CASE WHEN r.k = 3 AND h.hint = ['NEXT_22', 'PREV_22', 'AFTERNEXT_32', 'NEXT_32', 'PREV_32'][(h.field_no + r.idx) % 5 + 1] THEN 3
           WHEN r.k = 2 AND h.hint = ['NEXT_22', 'PREV_22'][(h.field_no + r.idx) % 2 + 1] THEN 2
           WHEN h.hint = 'AFTERNEXT_32' THEN 3 WHEN h.hint = 'NEXT_22' THEN 2 ELSE 0 END,
      CASE WHEN r.k = 3 AND h.hint = ['NEXT_22', 'PREV_22', 'AFTERNEXT_32', 'NEXT_32', 'PREV_32'][(h.field_no + r.idx) % 5 + 1] THEN r.idx
           WHEN r.k = 2 AND h.hint = ['NEXT_22', 'PREV_22'][(h.field_no + r.idx) % 2 + 1] THEN r.idx
           WHEN h.hint = 'AFTERNEXT_32' THEN (7 - h.field_no % 5) % 5 WHEN h.hint = 'NEXT_22' THEN h.field_no % 2 ELSE 0 END
    FROM r JOIN h ON h.stream_id = r.stream_id AND h.field_no = r.field_no + 1)
"""


def film_fields(spark, d):
    clean = F.element_at(
        F.array(*[F.lit(h) for h in E.HINTS]), ((F.col("field_no") + F.col("stream_id")) % 5 + 1).cast("int")
    )
    return X.v_fields(spark, d).withColumn("hint", F.when(F.col("stream_id") % 2 == 0, F.col("hint")).otherwise(clean))


@query(
    "detect_film",
    FILM + """SELECT stream_id, field_no, CASE k WHEN 3 THEN 'PULLDOWN_32' WHEN 2 THEN 'PULLDOWN_22' ELSE 'FULLRATE' END AS cadence,
      CAST(idx AS INTEGER) AS cadence_index FROM r""",
)
def detect_film(spark, d):
    return E.detect_film(film_fields(spark, d)).select("stream_id", "field_no", "cadence", "cadence_index")


@query(
    "plan_output",
    FILM + """SELECT stream_id, field_no, CASE WHEN field_no < 1 THEN 'IGNORE'
        WHEN k = 3 THEN CASE WHEN (field_no + idx) % 5 IN (1, 4) THEN 'WEAVE' ELSE 'IGNORE' END
        WHEN k = 2 THEN CASE WHEN (field_no + idx) % 2 = 1 THEN 'WEAVE' ELSE 'IGNORE' END ELSE 'DEINTERLACE' END AS action FROM r""",
)
def plan_output(spark, d):
    return E.plan_output(E.detect_film(film_fields(spark, d))).select("stream_id", "field_no", "action")


@query(
    "fill_frame_times",
    """WITH f AS (SELECT stream_id, frame_no, nb_fields, CASE WHEN (frame_no + stream_id) % 4 = 0 THEN rt_start END AS rt_start,
          400001 * nb_fields // 2 AS len FROM v_frames),
       s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM f),
       a AS (SELECT *, coalesce(last_value(rt_start - c IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame_no), 0) + c AS st FROM s)
       SELECT stream_id, frame_no, CAST(st AS BIGINT) AS rt_start, CAST(st + len AS BIGINT) AS rt_stop FROM a""",
)
def fill_frame_times(spark, d):
    f = X.v_frames(spark, d).withColumn(
        "rt_start", F.when((F.col("frame_no") + F.col("stream_id")) % 4 == 0, F.col("rt_start"))
    )
    return E.fill_frame_times(f, avg_time=400001).select("stream_id", "frame_no", "rt_start", "rt_stop")


# -------------------------------------------------------------- statistics


@query(
    "psnr",
    """SELECT block, count(*) AS n, CAST(sum((a - b) * (a - b)) AS BIGINT) AS sse, round(sqrt(sum((a - b) * (a - b)) * 1.0::DOUBLE / count(*)), 6) AS stddev,
         round(CASE WHEN sum((a - b) * (a - b)) = 0 THEN 999.99::DOUBLE ELSE 10.0::DOUBLE * log10(65025.0::DOUBLE * count(*) / sum((a - b) * (a - b))) END, 6) AS psnr
       FROM (SELECT a.block, CAST(floor(a.x * 128) AS BIGINT) AS a, CAST(floor(b.x * 128) AS BIGINT) AS b
             FROM v_samples a JOIN v_samples b ON a.block = b.block AND b.i = a.i + 1) GROUP BY block""",
)
def psnr(spark, d):
    s = X.v_samples(spark, d).withColumn("v", F.floor(F.col("x") * 128))
    out = L.psnr(J.align_pair(s, s, ["block"], "i", "v", shift=1), ["block"])
    return out.select("block", "n", "sse", F.round("stddev", 6).alias("stddev"), F.round("psnr", 6).alias("psnr"))


@query(
    "psnr_planes",
    """WITH e AS (SELECT a.stream_id, ['Y', 'U', 'V'][a.line_no % 3 + 1] AS plane, (a.p - b.p) * (a.p - b.p) AS se FROM v_px a JOIN v_px b
          ON a.stream_id = b.stream_id AND a.frame_no + 1 = b.frame_no AND a.line_no = b.line_no AND a.x = b.x),
       g AS (SELECT stream_id, coalesce(plane, '*') AS plane, CAST(sum(se) AS BIGINT) AS sse, count(*) AS n FROM e GROUP BY ROLLUP (stream_id, plane) HAVING stream_id IS NOT NULL)
       SELECT stream_id, plane, sse, round(CASE WHEN sse > 0 THEN -10.0::DOUBLE * log10(sse / (n * 65025.0::DOUBLE)) END, 6) AS psnr FROM g""",
)
def psnr_planes(spark, d):
    a = X.v_lines(spark, d)
    b = a.withColumn("frame_no", F.col("frame_no") - 1)
    e = L.line_sse(a, b, KEYS).withColumn(
        "plane", F.element_at(F.array(F.lit("Y"), F.lit("U"), F.lit("V")), (F.col("line_no") % 3 + 1).cast("int"))
    )
    return L.psnr_planes(e).select("stream_id", "plane", "sse", F.round("psnr", 6).alias("psnr"))


@query("luma_histogram", "SELECT stream_id, frame_no, p AS v, count(*) AS n FROM v_px GROUP BY ALL")
def luma_histogram(spark, d):
    return L.luma_histogram(X.v_lines(spark, d))


@query(
    "auto_levels",
    """WITH h AS (SELECT stream_id, frame_no, p AS v, count(*) AS n FROM v_px GROUP BY ALL),
       f AS (SELECT s.stream_id, s.frame_no, v.v, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT stream_id, frame_no FROM h) s
           CROSS JOIN (SELECT unnest(range(256)) AS v) v LEFT JOIN h ON h.stream_id = s.stream_id AND h.frame_no = s.frame_no AND h.v = v.v),
       c AS (SELECT *, sum(n) OVER (PARTITION BY stream_id, frame_no ORDER BY v) AS up, sum(n) OVER (PARTITION BY stream_id, frame_no ORDER BY v DESC) AS dn,
           floor(sum(n) OVER (PARTITION BY stream_id, frame_no) * 0.01::DOUBLE) AS m FROM f),
       g AS (SELECT stream_id, frame_no, coalesce(max(v) FILTER (v > 0 AND up < m), 0) AS black, coalesce(min(v) FILTER (dn < m), 256) AS white FROM c GROUP BY ALL)
       SELECT stream_id, frame_no, CAST(black AS INTEGER) AS black, CAST(white AS INTEGER) AS white, round(218.0::DOUBLE / (white - black), 9) AS scale FROM g""",
)
def auto_levels(spark, d):
    lv = L.auto_levels(L.luma_histogram(X.v_lines(spark, d)))
    return lv.select("stream_id", "frame_no", "black", "white", F.round("scale", 9).alias("scale"))


@query(
    "block_stats",
    """SELECT stream_id, frame_no, plane, CAST(x // 16 AS INTEGER) AS bx, line_no // 16 AS by, CAST((sum(p) + 128) >> 8 AS BIGINT) AS mean,
         CAST((sum(p * p) - ((sum(p) * sum(p))::BIGINT >> 8) + 628)::BIGINT >> 8 AS BIGINT) AS variance
       FROM (SELECT * REPLACE (CAST(p AS BIGINT) AS p) FROM v_px16) GROUP BY ALL HAVING count(*) = 256""".replace("(sum(p) + 128) >> 8", "(sum(p) + 128)::BIGINT >> 8"),
)
def block_stats(spark, d):
    return L.block_stats(X.v_lines16(spark, d)).select("stream_id", "frame_no", "plane", "bx", "by", "mean", "variance")


@query(
    "scene_score",
    """WITH q AS (SELECT *, lag(p) OVER (PARTITION BY stream_id, line_no, x ORDER BY frame_no) AS q FROM v_px16),
       b AS (SELECT stream_id, frame_no, x // 16 AS bx, line_no // 16 AS by, list(p) AS ps, CAST(sum(abs(p - q)) AS BIGINT) AS sad, (sum(p) + 128)::BIGINT >> 8 AS mean
           FROM q WHERE q IS NOT NULL GROUP BY ALL HAVING count(*) = 256)
       SELECT stream_id, frame_no, count(*) FILTER (list_sum(list_transform(ps, lambda v: abs(v - mean))) + 500 < sad) AS score FROM b GROUP BY ALL""",
)
def scene_score(spark, d):
    return L.scene_score(X.v_lines16(spark, d))


@query(
    "same_field_test",
    """WITH q AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY stream_id, line_no, x ORDER BY frame_no)) AS e FROM v_px16),
       g AS (SELECT stream_id, frame_no, CAST(sum(e) AS BIGINT) AS errors, CAST(count(*) FILTER (e > 30) AS BIGINT) AS peaks,
           CAST(coalesce(sum(e) FILTER (e > 30), 0) AS BIGINT) AS ps, count(DISTINCT line_no) AS lines
           FROM q WHERE e IS NOT NULL AND line_no >= 2 AND line_no < 14 AND line_no % 2 = 0 GROUP BY ALL)
       SELECT stream_id, frame_no, errors, peaks, CASE WHEN peaks > 250 THEN 2 WHEN peaks > 10 AND ps // peaks > 45 THEN 1
          WHEN errors / (lines * 64.0::DOUBLE) > 10 THEN 2 ELSE 0 END AS verdict FROM g""",
)
def same_field_test(spark, d):
    out = L.same_field_test(X.v_lines16(spark, d), height=16, width=64)
    return out.select("stream_id", "frame_no", "errors", "peaks", "verdict")


# ---------------------------------------------------------------- geometry


@query(
    "crop",
    """SELECT stream_id, frame_no, plane, line_no - 2 AS line_no, CAST(x - 8 AS INTEGER) AS x, p FROM v_px WHERE line_no BETWEEN 2 AND 7 AND x >= 8 AND x < 48""",
)
def crop(spark, d):
    return pixels(L.crop(X.v_lines(spark, d), 9, 3, 40, 6, height=10, width=64))


@query(
    "pad",
    """SELECT stream_id, frame_no, plane, line_no + 2 AS line_no, CAST(x + 4 AS INTEGER) AS x, p FROM v_px
       UNION ALL SELECT stream_id, frame_no, plane, line_no + 2, x, 16 FROM v_lines, (SELECT unnest([0, 1, 2, 3, 68, 69]) AS x)
       UNION ALL SELECT stream_id, frame_no, 'Y', l, CAST(x AS INTEGER), 16 FROM (SELECT DISTINCT stream_id, frame_no FROM v_lines), (SELECT unnest([0, 1, 12, 13, 14]) AS l),
         (SELECT unnest(range(70)) AS x)""",
)
def pad(spark, d):
    return pixels(L.pad(X.v_lines(spark, d), 2, 3, 4, 2, color={"Y": 16, "U": 128, "V": 128}))


@query("vflip", "SELECT stream_id, frame_no, plane, 9 - line_no AS line_no, CAST(x AS INTEGER) AS x, p FROM v_px")
def vflip(spark, d):
    return pixels(L.vflip(X.v_lines(spark, d)))


@query(
    "shrink",
    """SELECT stream_id, frame_no, plane, line_no // 2 AS line_no, CAST(x // 2 AS INTEGER) AS x, CAST((sum(p) + 2)::BIGINT >> 2 AS INTEGER) AS p
       FROM v_px GROUP BY stream_id, frame_no, plane, line_no // 2, x // 2""",
)
def shrink(spark, d):
    return pixels(L.shrink(X.v_lines(spark, d), 2))


@query(
    "rgb_to_yuv",
    """WITH c AS (SELECT stream_id, frame_no, line_no, CAST(x AS INTEGER) AS x, p AS r, 255 - p AS g, (p * 3) % 256 AS b FROM v_px)
       SELECT stream_id, frame_no, line_no, x, 'Y' AS plane, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS p FROM c
       UNION ALL SELECT stream_id, frame_no, line_no, x, 'U', ((32768 * b - 11059 * r - 21709 * g + 32767) >> 16) + 128 FROM c
       UNION ALL SELECT stream_id, frame_no, line_no, x, 'V', ((32768 * r - 27439 * g - 5329 * b + 32767) >> 16) + 128 FROM c""",
)
def rgb_to_yuv(spark, d):
    c = X.v_lines(spark, d).select(
        "stream_id", "frame_no", "line_no", F.col("px").alias("r"), F.transform("px", lambda p: F.lit(255) - p).alias("g"),
        F.transform("px", lambda p: p * 3 % 256).alias("b"),
    )
    return pixels(L.rgb_to_yuv(c), "stream_id", "frame_no", "line_no", "plane")


@query(
    "yuv_to_rgb",
    """WITH c AS (SELECT stream_id, frame_no, line_no, CAST(x AS INTEGER) AS x, p AS y, 255 - p AS u, (p * 3) % 256 AS v FROM v_px)
       SELECT stream_id, frame_no, line_no, x, greatest(0, least(255, ((y - 16) * 76309 + (v - 128) * 104597 + 32768) >> 16)) AS r,
         greatest(0, least(255, ((y - 16) * 76309 - (u - 128) * 25675 - (v - 128) * 53279 + 32768) >> 16)) AS g,
         greatest(0, least(255, ((y - 16) * 76309 + (u - 128) * 132201 + 32768) >> 16)) AS b FROM c""",
)
def yuv_to_rgb(spark, d):
    u = F.transform("px", lambda p: F.lit(255) - p)
    v = F.transform("px", lambda p: p * 3 % 256)
    planes = F.array(*[F.struct(F.lit(n).alias("plane"), c.alias("px")) for n, c in (("Y", F.col("px")), ("U", u), ("V", v))])
    full = X.v_lines(spark, d).select("stream_id", "frame_no", "line_no", F.inline(planes))
    out = L.yuv_to_rgb(full)
    return out.select("stream_id", "frame_no", "line_no", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "z")).select(
        "stream_id", "frame_no", "line_no", "x", "z.r", "z.g", "z.b"
    )


@query(
    "expand_chroma",
    """SELECT stream_id, frame_no, 'U' AS plane, line_no * 2 + dy AS line_no, CAST(x * 2 + dx AS INTEGER) AS x, p
       FROM v_px, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)""",
)
def expand_chroma(spark, d):
    return pixels(L.expand_chroma(X.v_lines(spark, d).withColumn("plane", F.lit("U"))))


@query("map_lines", "SELECT stream_id, frame_no, plane, line_no, CAST(x AS INTEGER) AS x, 255 - p AS p FROM v_px")
def map_lines(spark, d):
    return pixels(L.map_lines(X.v_lines(spark, d), lambda px: 255 - px, planes=["Y"]).select(*KEYS, "px"))


@query(
    "map_fields",
    """SELECT stream_id, frame_no, plane, line_no, CAST(x AS INTEGER) AS x, CAST(CASE WHEN lag(p) OVER w IS NULL OR lead(p) OVER w IS NULL THEN p
         ELSE (lag(p) OVER w + 2 * p + lead(p) OVER w) // 4 END AS INTEGER) AS p
       FROM v_px WINDOW w AS (PARTITION BY stream_id, plane, line_no, x ORDER BY frame_no)""",
)
def map_fields(spark, d):
    f = lambda st: (st[0] + 2 * st[1] + st[2]) // 4
    out = L.map_fields(X.v_lines(spark, d), f, buffered=3, delay=1, order="frame_no")
    return pixels(out.select(*KEYS, "px"))

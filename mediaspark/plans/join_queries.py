"""Queries for seek, cue, table and format joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaspark.operators import joins as J
from mediaspark.operators.scan import count_up, cut_lineage
from mediaspark.plans import fixtures as X
from mediaspark.plans.registry import query, values

HOUR = 3_600_000_000


def seek_index(spark, d):
    return X.v_packets(spark, d).select(
        "stream_id", "stream_index", F.col("dts").alias("ts"), (F.col("seq") * 1000).alias("pos"),
        (F.col("event_id") % 4 == 0).alias("is_key"),
    )


def seek_requests(spark, d):
    """Requests near real entries: exact hits, just before, just after, far off."""
    p = X.v_packets(spark, d)
    return p.select(
        F.col("event_id").alias("req_id"), "stream_id", "stream_index",
        (F.col("dts") + (F.col("event_id") % 5 - 2) * F.lit(40 * HOUR)).alias("ts"),
    )


SEEK = """WITH idx AS (SELECT stream_id, stream_index, dts AS ts, seq * 1000 AS pos, event_id % 4 = 0 AS is_key FROM v_packets),
  req AS (SELECT event_id AS req_id, stream_id, stream_index, dts + (event_id % 5 - 2) * 144000000000 AS ts FROM v_packets)
"""


def _seek_sql(cmp, order, key):
    fn = "arg_max" if order == "max" else "arg_min"
    return SEEK + f"""SELECT req_id, r.ts, {order}(i.ts) AS entry_ts, {fn}(i.pos, i.ts) AS entry_pos
      FROM req r LEFT JOIN (SELECT * FROM idx {'WHERE is_key' if key else ''}) i
        ON r.stream_id = i.stream_id AND r.stream_index = i.stream_index AND i.ts {cmp} r.ts GROUP BY req_id, r.ts"""


def _seek(spark, d, **kw):
    out = J.seek_join(seek_requests(spark, d), seek_index(spark, d), **kw)
    return out.select("req_id", "ts", "entry_ts", "entry_pos")


@query("seek_backward", _seek_sql("<=", "max", False))
def seek_backward(spark, d):
    return _seek(spark, d, backward=True, any_frame=True)


@query("seek_forward", _seek_sql(">=", "min", False))
def seek_forward(spark, d):
    return _seek(spark, d, backward=False, any_frame=True)


@query("seek_keyframe", _seek_sql("<=", "max", True))
def seek_keyframe(spark, d):
    return _seek(spark, d, backward=True)


@query(
    "seek_window",
    SEEK
    + """, q AS (SELECT *, ts - 90000000000 * (req_id % 3) AS min_ts, ts + 60000000000 * (req_id % 4 - 1) AS max_ts FROM req),
    v AS (SELECT *, ts - min_ts > max_ts - ts AS backward FROM q WHERE min_ts <= ts AND max_ts >= ts)
    SELECT req_id, backward,
      CASE WHEN backward THEN max(i.ts) FILTER (i.ts <= v.ts) ELSE min(i.ts) FILTER (i.ts >= v.ts) END AS entry_ts
    FROM v LEFT JOIN (SELECT * FROM idx WHERE is_key) i USING (stream_id, stream_index) GROUP BY req_id, backward""",
)
def seek_window(spark, d):
    r = seek_requests(spark, d)
    r = r.withColumn("min_ts", F.col("ts") - F.lit(90000000000) * (F.col("req_id") % 3))
    r = r.withColumn("max_ts", F.col("ts") + F.lit(60000000000) * (F.col("req_id") % 4 - 1))
    out = J.seek_window_join(r, seek_index(spark, d))
    return out.select("req_id", "backward", "entry_ts")


@query(
    "active_cues",
    """SELECT stream_id, t, cue_no, start, stop FROM v_cue_frames JOIN v_cues USING (stream_id)
       WHERE start <= t AND (stop IS NULL OR t < stop) AND forced""",
)
def active_cues(spark, d):
    out = J.active_cues(X.v_cue_frames(spark, d), X.v_cues(spark, d))
    return out.select("stream_id", "t", "cue_no", "start", "stop")


HIGHLIGHTS = """SELECT stream_id, start + 100 AS start, start + 220 AS stop FROM v_cues WHERE cue_no % 2 = 0"""


def highlights(spark, d):
    return X.v_cues(spark, d).filter("cue_no % 2 = 0").select(
        "stream_id", (F.col("start") + 100).alias("start"), (F.col("start") + 220).alias("stop")
    )


def closed_cues(spark, d):
    return X.v_cues(spark, d).withColumn("stop", F.coalesce("stop", F.col("start") + 300))


_OVERLAY = f"""WITH hl AS ({HIGHLIGHTS}),
  cu AS (SELECT stream_id, start, coalesce(stop, start + 300) AS stop, forced FROM v_cues)
  SELECT stream_id, t FROM v_cue_frames f WHERE {{}} (EXISTS (SELECT 1 FROM cu c WHERE c.stream_id = f.stream_id AND c.forced
      AND c.start <= f.t AND f.t < c.stop) OR EXISTS (SELECT 1 FROM hl h WHERE h.stream_id = f.stream_id AND h.start <= f.t AND f.t < h.stop))"""


@query("frames_with_overlay", _OVERLAY.format(""))
def frames_with_overlay(spark, d):
    return J.frames_needing_overlay(X.v_cue_frames(spark, d), closed_cues(spark, d), highlights(spark, d))


@query("frames_without_overlay", _OVERLAY.format("NOT"))
def frames_without_overlay(spark, d):
    return J.frames_needing_overlay(X.v_cue_frames(spark, d), closed_cues(spark, d), highlights(spark, d), anti=True)


@query(
    "render_overlay",
    f"""WITH hl AS ({HIGHLIGHTS}),
      cu AS (SELECT stream_id, start, coalesce(stop, start + 300) AS stop, forced FROM v_cues)
      SELECT stream_id, t FROM v_cue_frames f WHERE EXISTS (SELECT 1 FROM cu c WHERE c.stream_id = f.stream_id AND NOT c.forced
          AND c.start <= f.t + 90 AND f.t + 90 < c.stop) OR EXISTS (SELECT 1 FROM cu c WHERE c.stream_id = f.stream_id AND c.forced
          AND c.start <= f.t + 90 AND f.t + 90 < c.stop)""",
)
def render_overlay(spark, d):
    return J.frames_needing_overlay(
        X.v_cue_frames(spark, d), closed_cues(spark, d), highlights(spark, d), subtitles_on=True, slack=90
    )


@query(
    "acl_check",
    """SELECT conn_id, src_addr, coalesce((SELECT arg_min(allow, rule_no) FROM v_acl a WHERE v_conns.src_addr BETWEEN a.first_addr
       AND a.last_addr), (SELECT NOT arg_max(allow, rule_no) FROM v_acl)) AS allowed FROM v_conns""",
)
def acl_check(spark, d):
    return J.acl_check(X.v_conns(spark, d), X.v_acl(spark, d)).select("conn_id", "src_addr", "allowed")


# Frame rates of the MPEG-2 sequence header (fixed values).
FRAME_RATES = [(24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60000, 1001), (60, 1)]


@query(
    "nearest_rate",
    f"""WITH r AS (SELECT unnest(range({len(FRAME_RATES)})) AS rate_idx, unnest({[n for n, _ in FRAME_RATES]}) AS n,
          unnest({[m for _, m in FRAME_RATES]}) AS dd),
       q AS (SELECT DISTINCT l_partkey % 70 + 1 AS num, CAST(l_quantity AS BIGINT) % 3 + 1 AS den FROM lineitem)
       SELECT num, den, CAST(arg_min(rate_idx, abs(num * dd - n * den) * 1.0::DOUBLE / dd + rate_idx * 1e-9) AS INTEGER) AS rate_idx FROM q, r GROUP BY num, den""",
)
def nearest_rate(spark, d):
    q = X.table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 70 + 1).alias("num"), (F.col("l_quantity").cast("bigint") % 3 + 1).alias("den")
    ).distinct()
    return J.nearest_rate(q, FRAME_RATES).select("num", "den", "rate_idx")


@query(
    "probe_format",
    r"""WITH s AS (SELECT file_id, [
          struct_pack(s := CASE WHEN starts_with(head, '<!DOCTYPE html') THEN 100 ELSE 0 END, n := 'html'),
          struct_pack(s := CASE WHEN regexp_matches(head, 'var t="</p>"') THEN 100 ELSE 0 END, n := 'script'),
          struct_pack(s := CASE WHEN regexp_matches(head, '(?i)license') THEN 60 ELSE 0 END, n := 'license'),
          struct_pack(s := CASE WHEN regexp_matches(head, '[éè]') THEN 40 ELSE 0 END, n := 'accented'),
          struct_pack(s := CASE WHEN lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1)) IN ('com', 'org') THEN 50 ELSE 0 END, n := 'web')] AS c
        FROM v_files),
       m AS (SELECT file_id, c, list_max(list_transform(c, lambda e: e.s)) AS top FROM s),
       k AS (SELECT file_id, top, list_filter(c, lambda e: e.s = top) AS best FROM m)
       SELECT file_id, CASE WHEN top > 0 AND len(best) = 1 THEN best[1].n END AS format,
         CASE WHEN top > 0 AND len(best) = 1 THEN top END AS score FROM k""",
)
def probe_format(spark, d):
    h = F.col("head")
    rules = [
        ("html", 100, h.startswith("<!DOCTYPE html")),
        ("script", 100, h.contains('var t="</p>"')),
        ("license", 60, h.rlike("(?i)license")),
        ("accented", 40, h.rlike("[éè]")),
    ]
    out = J.probe_format(X.v_files(spark, d), rules, extensions={"web": ["com", "org"]})
    return out.select("file_id", "format", "score")


@query(
    "tag_lookup",
    """WITH t AS (SELECT * FROM (VALUES (0, 'VIEW', 10), (1, 'click', 11), (2, 'CLICK', 12), (3, 'Error', 13)) AS t(ord, tag, id)),
       q AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS tag FROM events)
       SELECT event_id, tag, coalesce((SELECT arg_min(id, ord) FROM t WHERE t.tag = q.tag),
         (SELECT arg_min(id, ord) FROM t WHERE upper(t.tag) = upper(q.tag))) AS id FROM q""",
)
def tag_lookup(spark, d):
    t = values(spark, [(0, "VIEW", 10), (1, "click", 11), (2, "CLICK", 12), (3, "Error", 13)], "ord, tag, id")
    q = X.events(spark, d).select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.upper("event_type")).alias("tag")
    )
    return J.tag_lookup(q, t).select("event_id", "tag", "id")


@query(
    "pick_rendition",
    """WITH req AS (SELECT o_orderkey AS req_id, o_custkey % 7 + 1 AS stream_index, CAST(floor(o_totalprice * 40) AS BIGINT) AS target FROM orders),
       lad AS (SELECT stream_index, stream_id AS rendition, bit_rate FROM v_streams)
       SELECT req_id, target, coalesce(max(bit_rate) FILTER (bit_rate <= target), min(bit_rate) FILTER (bit_rate > target)) AS bit_rate
       FROM req JOIN lad USING (stream_index) GROUP BY req_id, target""",
)
def pick_rendition(spark, d):
    req = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("req_id"), (F.col("o_custkey") % 7 + 1).cast("int").alias("stream_index"),
        F.floor(F.col("o_totalprice") * 40).alias("target"),
    )
    ladder = X.v_streams(spark, d).select("stream_index", F.col("stream_id").alias("rendition"), "bit_rate")
    return J.pick_rendition(req, ladder, ["stream_index"]).select("req_id", "target", "bit_rate")


@query(
    "align_pair",
    """SELECT a.block, a.i AS pos, round(a.x, 9) AS a, round(b.x, 9) AS b FROM v_samples a JOIN v_samples b
       ON a.block = b.block AND b.i = a.i + 3 WHERE a.i >= 10""",
)
def align_pair(spark, d):
    s = X.v_samples(spark, d)
    out = J.align_pair(s, s, ["block"], "i", "x", shift=3, skip=10)
    return out.select("block", "pos", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


@query(
    "diff_golden",
    """WITH a AS (SELECT doc_id, sha256(text) AS v FROM documents WHERE doc_id % 9 <> 0),
       e AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN reverse(text) ELSE text END) AS v FROM documents WHERE doc_id % 7 <> 0)
       SELECT doc_id, CASE WHEN a.v IS NULL THEN 'missing' WHEN e.v IS NULL THEN 'extra' ELSE 'differs' END AS status,
         a.v AS actual, e.v AS expected FROM a FULL JOIN e USING (doc_id) WHERE a.v IS DISTINCT FROM e.v""",
)
def diff_golden(spark, d):
    """Two made-up runs, compared by digest: each lacks some rows, and one turned some texts around at equal length."""
    t = X.table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text"))
    a = t.filter("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("v"))
    e = t.filter("doc_id % 7 <> 0").select("doc_id", F.sha2(text, 256).alias("v"))
    return J.diff_golden(a, e, ["doc_id"], "v")


@query(
    "interpolate_pcr",
    """WITH r AS (SELECT packet_no, pcr, lead(packet_no) OVER w AS no1, lead(pcr) OVER w AS p1 FROM v_ts WHERE pcr IS NOT NULL
           WINDOW w AS (ORDER BY packet_no)),
       s AS (SELECT packet_no AS no0, pcr AS p0, (p1 - pcr) // (no1 - packet_no) AS st FROM r),
       f AS (SELECT no0, p0, coalesce(st, lag(st) OVER (ORDER BY no0)) AS st FROM s)
       SELECT packet_no, p0 + st * (packet_no - no0) AS clock, st AS step,
         CAST(floor(188 * 8 * 27e6 / st) AS BIGINT) AS bit_rate
       FROM v_ts ASOF LEFT JOIN f ON v_ts.packet_no >= f.no0""",
)
def interpolate_pcr(spark, d):
    out = J.interpolate_pcr(X.v_ts(spark, d))
    return out.select("packet_no", "clock", "step", "bit_rate")


@query(
    "copy_metadata",
    """WITH q AS (SELECT stream_id, key, value, stream_id // 3 * 3 AS in_id FROM v_tags),
       own AS (SELECT stream_id, key, value FROM q),
       got AS (SELECT q.stream_id, i.key, i.value FROM q JOIN v_tags i ON i.stream_id = q.in_id)
       SELECT stream_id, key, value FROM got UNION ALL
       SELECT stream_id, key, value FROM own WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.stream_id = own.stream_id AND got.key = own.key)""",
)
def copy_metadata(spark, d):
    t = X.v_tags(spark, d).select("stream_id", F.create_map("key", "value").alias("tags"))
    mapping = t.select(F.col("stream_id").alias("out_id"), F.expr("stream_id div 3 * 3").alias("in_id"))
    out = J.copy_metadata(t, t, mapping)
    return out.select("stream_id", F.explode("tags").alias("key", "value"))


@query(
    "build_sample_table",
    """WITH runs AS (SELECT stream_id, run_no, count % 5 + 1 AS count, duration FROM v_runs),
       stts AS (SELECT *, coalesce(sum(count) OVER w, 0) AS s0, coalesce(sum(count * duration) OVER w, 0) AS d0 FROM runs
           WINDOW w AS (PARTITION BY stream_id ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       smp AS (SELECT stream_id, s0 + j AS sample_no, d0 + j * duration AS dts, duration, 100 + ((s0 + j) * 37 + stream_id) % 900 AS size
           FROM stts, LATERAL (SELECT unnest(range(count)) AS j)),
       stsc AS (SELECT stream_id, run_no AS first_chunk, run_no % 7 + 1 AS per FROM v_runs WHERE run_no % 10 = 1),
       ch AS (SELECT c.stream_id, c.run_no AS chunk_no, c.run_no * 100000 AS off, s.per FROM v_runs c ASOF JOIN stsc s
           ON c.stream_id = s.stream_id AND c.run_no >= s.first_chunk),
       ch2 AS (SELECT *, coalesce(sum(per) OVER w, 0) AS first FROM ch
           WINDOW w AS (PARTITION BY stream_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       pos AS (SELECT s.*, c.first, c.off, c.chunk_no, c.per FROM smp s ASOF JOIN ch2 c ON s.stream_id = c.stream_id AND s.sample_no >= c.first),
       inside AS (SELECT * FROM pos WHERE sample_no < first + per),
       k AS (SELECT *, sample_no % 12 = 0 OR stream_id % 4 = 0 AS is_key FROM inside)
       SELECT stream_id, CAST(sample_no AS BIGINT) AS sample_no, CAST(off + coalesce(sum(size) OVER (PARTITION BY stream_id, chunk_no ORDER BY sample_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, CAST(dts AS BIGINT) AS dts,
         CAST(dts + (stream_id + sample_no // 4) % 3 * 40 AS BIGINT) AS pts,
         is_key, CAST(sample_no - max(CASE WHEN is_key THEN sample_no END) OVER (PARTITION BY stream_id ORDER BY sample_no) AS BIGINT) AS min_distance FROM k""",
)
def build_sample_table(spark, d):
    runs = cut_lineage(X.v_runs(spark, d))
    stts = runs.withColumn("count", F.col("count") % 5 + 1)
    total = cut_lineage(stts.groupBy("stream_id").agg(F.sum("count").alias("n")))
    samples = count_up(total, ["stream_id"], F.col("n"), "sample_no")
    stsz = samples.withColumn("size", F.lit(100) + (F.col("sample_no") * 37 + F.col("stream_id")) % 900)
    stsc = cut_lineage(runs.filter("run_no % 10 = 1").select(
        "stream_id", F.col("run_no").alias("first_chunk"), (F.col("run_no") % 7 + 1).alias("count")
    ))
    stco = runs.select("stream_id", F.col("run_no").alias("chunk_no"), (F.col("run_no") * 100000).alias("offset"))
    # Streams without a key list have only key samples.
    stss = samples.filter("sample_no % 12 = 0 AND stream_id % 4 <> 0").select("stream_id", (F.col("sample_no") + 1).alias("sample"))
    ctts = samples.filter("sample_no % 4 = 0").select(
        "stream_id", (F.expr("sample_no div 4") + 1).alias("run_no"), F.lit(4).alias("count"),
        ((F.col("stream_id") + F.expr("sample_no div 4")) % 3 * 40).alias("offset"),
    )
    out = J.build_sample_table(stsz, stts, stsc, stco, stss, ctts)
    return out.select("stream_id", "sample_no", "pos", "dts", "pts", "is_key", "min_distance")


@query(
    "retime",
    """WITH f AS (SELECT stream_id, frame_no, rt_start, rt_start + 400000 * nb_fields AS rt_stop, nb_fields, progressive FROM v_frames),
       c AS (SELECT DISTINCT stream_id, rt_start - rt_start % 31536000000000 AS change_ts,
              5000 + (stream_id + rt_start // 31536000000000) % 4 * 5000 AS rate FROM v_frames),
       j AS (SELECT f.*, c.change_ts, c.rate FROM f ASOF LEFT JOIN c ON f.stream_id = c.stream_id AND f.rt_start >= c.change_ts),
       a AS (SELECT *, min(rt_start) OVER (PARTITION BY stream_id, change_ts) AS an FROM j)
       SELECT stream_id, frame_no, an + (rt_start - an) * rate // 10000 AS out_start,
         an + (rt_stop - an) * rate // 10000 - CASE WHEN progressive AND nb_fields = 3 THEN 200000 * rate // 10000 ELSE 0 END AS out_stop FROM a""",
)
def retime(spark, d):
    f = X.v_frames(spark, d).withColumn("rt_stop", F.col("rt_start") + F.lit(400000) * F.col("nb_fields"))
    f = f.withColumnRenamed("progressive", "film")
    year = F.expr("rt_start div 31536000000000")
    rates = X.v_frames(spark, d).select(
        "stream_id", (year * F.lit(31536000000000)).alias("change_ts"),
        (F.lit(5000) + (F.col("stream_id") + year) % 4 * 5000).alias("rate"),
    ).distinct()
    out = J.retime(f, rates, smooth_film=True)
    return out.select("stream_id", "frame_no", "out_start", "out_stop")


@query(
    "overlay",
    """WITH o AS (SELECT *, CASE WHEN line_no % 2 = 0 AND x % 7 <> 0 THEN (x + line_no) % 4 END AS code FROM v_px),
       p AS (SELECT *, CASE WHEN line_no BETWEEN 3 AND 6 AND x >= 20 AND x < 40 THEN [16, 235, 128, 90][code + 1] ELSE [0, 200, 100, 50][code + 1] END AS c,
          CASE WHEN line_no BETWEEN 3 AND 6 AND x >= 20 AND x < 40 THEN [15, 8, 4, 0][code + 1] ELSE [0, 15, 7, 3][code + 1] END AS k FROM o)
       SELECT stream_id, frame_no, line_no, CAST(x AS INTEGER) AS x, CASE WHEN code IS NULL OR line_no >= 9 OR x < 4 OR x >= 60 THEN p
          ELSE p - (((p - c) * k) >> 4) END AS p FROM p""",
)
def overlay(spark, d):
    lines = X.v_lines(spark, d)
    codes = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda x: F.when(x % 7 != 0, ((x + F.col("line_no")) % 4).cast("int")),
    )
    ov = lines.filter("line_no % 2 = 0").select("stream_id", "frame_no", "plane", "line_no", codes.alias("codes"))
    out = J.overlay(
        lines, ov, [(0, 0), (200, 15), (100, 7), (50, 3)], clip=(4, 0, 60, 9), highlight=(20, 3, 40, 6),
        highlight_palette=[(16, 15), (235, 8), (128, 4), (90, 0)],
    )
    return out.select("stream_id", "frame_no", "line_no", F.posexplode("px").alias("x", "p"))

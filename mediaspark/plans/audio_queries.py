"""Queries for audio, transport streams, captions and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from mediaspark.functions import audio as A
from mediaspark.functions import picture as Pic
from mediaspark.functions import text as Tx
from mediaspark.functions import timebase as Tb
from mediaspark.operators import audio as Au
from mediaspark.operators import cues as C
from mediaspark.operators import packets as P
from mediaspark.operators import transport as T
from mediaspark.operators.scan import chunk_id, number_rows
from mediaspark.plans import fixtures as X
from mediaspark.plans.registry import query, values


def pcm(spark, d):
    """16-bit samples: 100 vectors of 64 make one stream."""
    return X.v_samples(spark, d).select(
        F.expr("block div 100").alias("stream_id"), (F.col("block") % 100 * 64 + F.col("i")).alias("sample_no"),
        F.floor(F.col("x") * 30000).cast("int").alias("x"),
    )


PCM = """WITH s AS (SELECT block // 100 AS stream_id, block % 100 * 64 + i AS sample_no, CAST(floor(x * 30000) AS INTEGER) AS x FROM v_samples)
"""


@query(
    "decimate2",
    PCM + """SELECT stream_id, sample_no // 2 AS sample_no, (coalesce(a, 0) + 2 * x + b) >> 2 AS x FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM s
      WINDOW w AS (PARTITION BY stream_id ORDER BY sample_no)) WHERE sample_no % 2 = 0 AND b IS NOT NULL""",
)
def decimate2(spark, d):
    return Au.decimate2(pcm(spark, d))


IMPULSE = [0.5, 0.25, -0.125, 0.0625, 0.03125]


@query(
    "convolve",
    PCM + f""", h AS (SELECT unnest(range({len(IMPULSE)})) AS k, unnest({IMPULSE}) AS h)
      SELECT a.stream_id, a.sample_no, round(pow(10.0::DOUBLE, -6.0::DOUBLE / 20) * (0.75::DOUBLE * sum(b.x * h.h::DOUBLE) + 0.25::DOUBLE * max(a.x)), 5) AS x
      FROM s a, h JOIN s b ON true WHERE b.stream_id = a.stream_id AND b.sample_no = a.sample_no - h.k GROUP BY a.stream_id, a.sample_no""",
)
def convolve(spark, d):
    out = Au.convolve(pcm(spark, d), IMPULSE, wet=0.75, attenuation_db=6.0)
    return out.select("stream_id", "sample_no", F.round("x", 5).alias("x"))


_BANK = Au.filter_bank(min(32000 * 0.8 / 44100, 1.0), 7, 8, 1 << 15, 9)


@query(
    "resample",
    PCM + f""", z AS (SELECT *, count(*) OVER (PARTITION BY stream_id) AS n FROM s),
      o AS (SELECT stream_id, n, unnest(range(CAST(n * 32000 // 44100 + 10 AS BIGINT))) AS j FROM (SELECT DISTINCT stream_id, n FROM z)),
      p AS (SELECT *, -24 + (j * 352800) // 32000 AS pos FROM o),
      q AS (SELECT *, pos >> 3 AS idx, pos & 7 AS ph FROM p),
      t AS (SELECT stream_id, j, CASE WHEN idx < 0 THEN abs(idx + k) % n ELSE idx + k END AS at, {_BANK.tolist()}[CAST(ph AS INTEGER) + 1][CAST(k AS INTEGER) + 1] AS c
          FROM q, (SELECT unnest(range(7)) AS k) WHERE idx < 0 OR idx + 7 <= n)
      SELECT t.stream_id, j AS sample_no, CAST(least(32767, greatest(-32768, (CAST(sum(c * x) AS BIGINT) + 16384) >> 15)) AS INTEGER) AS x
      FROM t JOIN s ON s.stream_id = t.stream_id AND s.sample_no = t.at GROUP BY ALL""",
)
def resample(spark, d):
    return Au.resample(pcm(spark, d), 44100, 32000, taps=4, phase_shift=3, rows=1 << 16)


@query(
    "classify_audio",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'DTS' WHEN 1 THEN 'AC3' WHEN 2 THEN 'DTS' WHEN 3 THEN 'SILENCE' ELSE 'PCM' END AS audio_type FROM events""",
)
def classify_audio(spark, d):
    kind = F.col("event_id") % 6
    body = F.md5(F.col("event_id").cast("string"))
    # Hex digits of a digest hold no sync word: only 0x30-0x66 bytes occur.
    data = F.concat(
        F.encode(body, "utf-8"),
        F.when(kind == 0, F.unhex(F.lit("FF1F00E8"))).when(kind == 1, F.unhex(F.lit("72F81F4E0100")))
        .when(kind == 2, F.unhex(F.lit("72F81F4E0B00"))).when(kind == 3, F.unhex(F.lit("72F81F4E0003")))
        .when(kind == 4, F.unhex(F.lit("0072F81F4E0100"))).otherwise(F.unhex(F.lit("00"))),
        F.encode(body, "utf-8"),
    )
    return Au.classify_audio(X.events(spark, d).select("event_id", data.alias("data"))).select("event_id", "audio_type")


# --------------------------------------------------------------- transport


@query(
    "ts_continuity",
    """SELECT pid, packet_no, cc, coalesce(cc <> (p + 1) % 16, false) AS discontinuity FROM (SELECT *, lag(cc) OVER (PARTITION BY pid ORDER BY packet_no) AS p FROM v_ts)""",
)
def ts_continuity(spark, d):
    return T.ts_continuity(X.v_ts(spark, d), keys=["pid"]).select("pid", "packet_no", "cc", "discontinuity")


def section_packets(spark, d):
    """Transport packets carrying one section per event; some packets are lost.

    The section of event n has 1 to 8 digests as payload, so 1 to 3 packets.  The
    second packet of every 23rd event is lost.
    """
    @F.pandas_udf("binary")
    def seal(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b) + T.crc32_mpeg(bytes(b)).to_bytes(4, "big"))

    # A pointer byte, 8 bytes of head, the digests and 4 bytes of CRC in payloads of 184.
    n = F.ceil((F.lit(13) + (F.col("event_id") % 8 + 1) * 32) / F.lit(184)).cast("int")
    p = X.events(spark, d).select("event_id", (F.col("user_id") % 8).alias("pid"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    p = p.withColumn("packet_no", F.col("event_id") * 8 + F.col("k"))
    p = number_rows(p, ["pid"], ["packet_no"], [chunk_id("packet_no")], "__n").withColumn("cc", (F.col("__n") % 16).cast("int"))
    p = p.filter(~((F.col("event_id") % 23 == 0) & (F.col("k") == 1)))
    digest = F.sha2(F.col("event_id").cast("string"), 256)
    body = F.unhex(F.repeat(digest, (F.col("event_id") % 8 + 1).cast("int")))
    two = lambda v: F.unhex(F.lpad(F.hex(v.cast("bigint")), 4, "0"))
    head = F.concat(F.unhex(F.lit("42")), two(F.octet_length(body) + 9 + 0xB000), two(F.col("event_id") % 65536), F.unhex(F.lit("C10000")))
    full = F.concat(F.unhex(F.lit("00")), seal(F.concat(head, body)))
    return p.select(
        F.lit(0).alias("stream_id"), "pid", "packet_no", "cc", (F.col("k") == 0).alias("pusi"),
        F.substring(full, F.col("k") * 184 + 1, F.lit(184)).alias("payload"),
    )


@query(
    "assemble_sections",
    """SELECT user_id % 8 AS pid, CAST(event_id % 65536 AS INTEGER) AS extension, 66 AS table_id, 0 AS version, 0 AS section_no, 0 AS last_no,
         CAST((1 + event_id % 8) * 32 AS INTEGER) AS n, md5(repeat(sha256(CAST(event_id AS VARCHAR)), 1 + event_id % 8)) AS digest, event_id * 8 AS first_packet
       FROM events WHERE NOT (event_id % 23 = 0 AND event_id % 8 >= 5)""",
)
def assemble_sections(spark, d):
    s = T.assemble_sections(section_packets(spark, d))
    return s.select(
        "pid", "extension", "table_id", "version", "section_no", "last_no", F.octet_length("payload").alias("n"),
        F.md5(F.encode(F.lower(F.hex("payload")), "utf-8")).alias("digest"), "first_packet",
    )


def table_sections(spark, d):
    s = X.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("pid"), F.col("l_orderkey").alias("payload"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"),
        (F.col("l_linenumber") - 1).alias("section_no"), F.lit(0).alias("extension"), F.lit(0).alias("table_id"),
        F.expr("l_orderkey div 8000").alias("version"), F.lit(2).alias("last_no"),
    )
    return number_rows(s, ["pid"], ["payload", "section_no", "supp", "price"], [chunk_id("payload", 1024)], "seq")


@query(
    "complete_tables",
    """WITH s AS (SELECT l_partkey AS pid, l_orderkey AS payload, l_linenumber - 1 AS section_no, l_orderkey // 8000 AS version,
           row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS seq FROM lineitem),
       f AS (SELECT * FROM s WHERE section_no <= 2),
       c AS (SELECT pid, version, max(m) AS done FROM (SELECT pid, version, section_no, min(seq) AS m FROM f GROUP BY ALL) GROUP BY ALL HAVING count(*) = 3),
       l AS (SELECT f.pid, f.version, section_no, done, arg_max(payload, seq) AS payload FROM f JOIN c ON f.pid = c.pid AND f.version = c.version WHERE seq <= done GROUP BY ALL)
       SELECT pid, version, done AS completed_at, string_agg(CAST(payload AS VARCHAR), ',' ORDER BY section_no) AS payloads FROM l GROUP BY ALL""",
)
def complete_tables(spark, d):
    t = T.complete_tables(table_sections(spark, d))
    return t.select("pid", "version", "completed_at", F.array_join(F.transform("payloads", lambda p: p.cast("string")), ",").alias("payloads"))


def es_table(spark, d):
    types = [1, 2, 3, 4, 15, 129, 6, 2]
    t = F.element_at(F.array(*[F.lit(x) for x in types]), ((F.col("l_partkey") + F.col("l_linenumber")) % 8 + 1).cast("int"))
    return X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("program"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("es_no"), t.alias("es_type"),
        (F.col("l_partkey") % 4000 + 32).alias("es_pid"),
    )


@query(
    "program_map",
    """WITH e AS (SELECT l_orderkey AS program, l_partkey * 8 + l_linenumber AS es_no, [1, 2, 3, 4, 15, 129, 6, 2][CAST((l_partkey + l_linenumber) % 8 + 1 AS INTEGER)] AS es_type,
           l_partkey % 4000 + 32 AS es_pid FROM lineitem),
       p AS (SELECT o_orderkey AS program, o_custkey % 8000 AS pmt_pid FROM orders WHERE o_orderkey > 0)
       SELECT program, pmt_pid, arg_min(es_pid, es_no) FILTER (es_type IN (1, 2)) AS video_pid,
         coalesce(arg_max(es_pid, es_no) FILTER (es_type = 129), arg_min(es_pid, es_no) FILTER (es_type IN (3, 4, 15))) AS audio_pid
       FROM p JOIN e USING (program) GROUP BY ALL""",
)
def program_map(spark, d):
    pat = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("program"), (F.col("o_custkey") % 8000).alias("pmt_pid"))
    return T.program_map(pat, es_table(spark, d)).select("program", "pmt_pid", "video_pid", "audio_pid")


@query("filter_programs", "SELECT pid, packet_no, cc FROM v_ts WHERE pid IN (0, 2, 5)")
def filter_programs(spark, d):
    pids = values(spark, [(2,), (5,)], "pid")
    return T.filter_programs(X.v_ts(spark, d), pids).select("pid", "packet_no", "cc")


@query(
    "user_data",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 16 AS INTEGER) END AS afd,
         CASE WHEN event_id % 3 = 1 THEN upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 4)) || ',' || upper(substr(md5(CAST(event_id AS VARCHAR)), 9, 4)) ELSE '' END AS pairs FROM events""",
)
def user_data(spark, d):
    k = F.col("event_id") % 3
    m = F.upper(F.md5(F.col("event_id").cast("string")))
    byte = F.lpad(F.hex(F.col("event_id") % 16 + 0xF0), 2, "0")
    cc = F.concat(
        F.lit("474139340343FF"), F.lit("FC"), F.substring(m, 1, 4), F.lit("F8"), F.substring(m, 5, 4), F.lit("FC"), F.substring(m, 9, 4)
    )
    data = F.unhex(F.when(k == 0, F.concat(F.lit("4454473141"), byte)).when(k == 1, cc).otherwise(F.concat(F.lit("00000001"), m)))
    out = T.caption_pairs(T.active_format(X.events(spark, d).select("event_id", data.alias("data"))))
    return out.select("event_id", "afd", F.array_join("pairs", ",").alias("pairs"))


@query(
    "vbr_duration",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey * 7 + 1 END AS frames,
         CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE round((p_partkey * 7 + 1) * 1152.0::DOUBLE / 44100, 6) END AS duration FROM part""",
)
def vbr_duration(spark, d):
    k = F.col("p_partkey")
    n = F.lpad(F.hex(k * 7 + 1), 8, "0")
    zeros = lambda c: F.lit("00" * c)
    head = (
        F.when(k % 4 == 0, F.concat(F.lit("FFFB9000"), zeros(32), F.lit("58696E6700000001"), n))
        .when(k % 4 == 1, F.concat(F.lit("FFFB90C0"), zeros(17), F.lit("496E666F00000003"), n, zeros(20)))
        .when(k % 4 == 2, F.concat(F.lit("FFFB9000"), zeros(32), F.lit("5642524900010000" + "000000000000"), n))
        .otherwise(F.concat(F.lit("FFFB9000"), zeros(60)))
    )
    f = X.table(spark, d, "part").select("p_partkey", F.unhex(head).alias("head"))
    out = T.vbr_duration(f)
    return out.select("p_partkey", "frames", F.round("duration", 6).alias("duration"))


# ----------------------------------------------------------------- captions


@query(
    "close_open_cues",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN conv_id * 10 + (turn * 7) % 5 * 100 END AS start, role AS payload FROM conversations),
       n AS (SELECT *, count(start) OVER (PARTITION BY conv_id ORDER BY turn) AS cue_no FROM c),
       g AS (SELECT conv_id AS stream_id, cue_no, max(start) AS start, string_agg(payload, '' ORDER BY turn) AS payload FROM n WHERE cue_no > 0 GROUP BY ALL)
       SELECT stream_id, cue_no, start, CASE WHEN lead(start) OVER w > start THEN lead(start) OVER w END AS stop, payload FROM g WINDOW w AS (PARTITION BY stream_id ORDER BY cue_no)""",
)
def close_open_cues(spark, d):
    t = F.col("turn")
    c = X.table(spark, d, "conversations").select(
        F.col("conv_id").alias("stream_id"), t.alias("seq"), F.when(t % 3 != 1, F.col("conv_id") * 10 + t * 7 % 5 * 100).alias("start"), F.col("role").alias("payload")
    )
    return C.close_open_cues(c)


@query(
    "chapter_ends",
    """SELECT stream_id, cue_no AS chapter_no, start, coalesce(stop, lead(start) OVER w, max(start) OVER (PARTITION BY stream_id) + 1000) AS "end"
       FROM v_cues WINDOW w AS (PARTITION BY stream_id ORDER BY cue_no)""",
)
def chapter_ends(spark, d):
    c = X.v_cues(spark, d)
    files = c.groupBy("stream_id").agg(F.lit(0).alias("start_time"), (F.max("start") + 1000).alias("duration"))
    ch = c.select("stream_id", F.col("cue_no").alias("chapter_no"), "start", F.col("stop").alias("end"))
    return C.chapter_ends(ch, files)


@query(
    "cue_controls",
    """SELECT event_id AS cue_no, ts AS start, ts + 1024 * (event_id % 500) AS stop, event_id % 2 = 0 AS forced, CAST(event_id % 700 AS INTEGER) AS "left",
         CAST(event_id % 400 AS INTEGER) AS top, CAST(event_id % 16 AS INTEGER) AS c3 FROM (SELECT event_id, epoch_us(ts) AS ts FROM events)""",
)
def cue_controls(spark, d):
    e = F.col("event_id")
    h = lambda v, n: F.lpad(F.hex(v.cast("bigint")), n, "0")
    left, top = e % 700, e % 400
    rect = F.concat(h(left, 3), h(left + 20, 3), h(top, 3), h(top + 10, 3))
    # 4 bytes of head, 4 of picture, a block of 16 bytes and one of 6.
    start = F.when(e % 2 == 0, "00").otherwise("01")
    shown = F.concat(F.lit("00000018"), start, F.lit("03"), h(e % 16, 1), F.lit("210"), F.lit("05"), rect, F.lit("FF"))
    hidden = F.concat(h(e % 500, 4), F.lit("001802FF"))
    body = F.concat(F.lit("001E0008AABBCCDD"), shown, hidden)
    c = X.events(spark, d).select(
        F.lit(0).alias("stream_id"), e.alias("cue_no"), X.us("ts").alias("start"), F.unhex(body).alias("data")
    )
    out = C.cue_controls(c)
    return out.select("cue_no", "start", "stop", "forced", F.col("rect.left").alias("left"), F.col("rect.top").alias("top"), F.col("colors.c3").alias("c3"))


# --------------------------------------------------------- scalar functions


@query(
    "rescale",
    """WITH v AS (SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * epoch_us(ts))::HUGEINT AS a, (event_id % 900 + 1)::HUGEINT AS b, (event_id % 977 + 1)::HUGEINT AS c FROM events),
       m AS (SELECT *, abs(a * b) AS m, CASE WHEN a < 0 THEN -1 ELSE 1 END AS s FROM v)
       SELECT event_id, CAST(s * (m // c) AS BIGINT) AS zero, CAST(s * ((m + c - 1) // c) AS BIGINT) AS inf,
         CAST(CASE WHEN s < 0 THEN -((m + c - 1) // c) ELSE m // c END AS BIGINT) AS down, CAST(CASE WHEN s < 0 THEN -(m // c) ELSE (m + c - 1) // c END AS BIGINT) AS up,
         CAST(s * ((m + c // 2) // c) AS BIGINT) AS near FROM m""",
)
def rescale(spark, d):
    e = F.col("event_id")
    v = X.events(spark, d).select(
        "event_id", (F.when(e % 2 == 0, 1).otherwise(-1) * X.us("ts")).alias("a"), (e % 900 + 1).alias("b"), (e % 977 + 1).alias("c")
    )
    return v.select("event_id", *[Tb.rescale(F.col("a"), F.col("b"), F.col("c"), m).alias(m) for m in Tb.ROUNDINGS])


@query(
    "rational_math",
    """WITH v AS (SELECT event_id, event_id % 1000 - 500 AS n, event_id % 97 + 1 AS dn, event_id % 31 + 1 AS n2, event_id % 53 + 1 AS d2 FROM events),
       r AS (SELECT event_id, n * d2 + n2 * dn AS sn, dn * d2 AS sd, n * n2 AS mn, dn * d2 AS md, n * d2 AS qn, dn * n2 AS qd, n, dn, n2, d2 FROM v)
       SELECT event_id, sn // gcd(sn, sd) AS sum_num, sd // gcd(sn, sd) AS sum_den, mn // gcd(mn, md) AS mul_num, qd // gcd(qn, qd) AS div_den,
         CASE WHEN n * d2 < n2 * dn THEN -1 WHEN n * d2 > n2 * dn THEN 1 ELSE 0 END AS cmp FROM r""",
)
def rational_math(spark, d):
    e = F.col("event_id")
    v = X.events(spark, d).select("event_id", Tb.rational(e % 1000 - 500, e % 97 + 1).alias("a"), Tb.rational(e % 31 + 1, e % 53 + 1).alias("b"))
    v = v.select("event_id", "a", "b", Tb.add_q(F.col("a"), F.col("b")).alias("s"), Tb.mul_q(F.col("a"), F.col("b")).alias("m"), Tb.div_q(F.col("a"), F.col("b")).alias("q"))
    return v.select(
        "event_id", F.col("s.num").alias("sum_num"), F.col("s.den").alias("sum_den"), F.col("m.num").alias("mul_num"), F.col("q.den").alias("div_den"),
        Tb.compare_ts(F.col("a.num"), 1, F.col("a.den"), F.col("b.num"), 1, F.col("b.den")).alias("cmp"),
    )


@query(
    "stream_report",
    """SELECT stream_id, stream_index, codec_type, printf('%d:%02d:%09.6f', CAST(duration // 3600000000 AS BIGINT), CAST(duration // 60000000 % 60 AS BIGINT), duration % 60000000 / 1e6) AS duration,
         printf('%.3f %sbit/s', bit_rate / pow(1000.0::DOUBLE, least(5, CAST(trunc(log10(bit_rate)) AS INTEGER) // 3)), ['', 'K', 'M', 'G', 'T', 'P'][least(5, CAST(trunc(log10(bit_rate)) AS INTEGER) // 3) + 1]) AS bit_rate
       FROM v_streams""",
)
def stream_report(spark, d):
    r = P.stream_report(X.v_streams(spark, d))
    return r.select("stream_id", "stream_index", "codec_type", "duration", "bit_rate")


@query(
    "format_report",
    """WITH t AS (SELECT stream_id, count(*) AS n, max(start_time + duration) - min(start_time) AS dur FROM v_streams GROUP BY stream_id),
       c AS (SELECT *, (stream_id % 50 + 1) * 300000 AS sz FROM t)
       SELECT stream_id, n AS nb_streams, printf('%d:%02d:%09.6f', CAST(dur // 3600000000 AS BIGINT), CAST(dur // 60000000 % 60 AS BIGINT), dur % 60000000 / 1e6) AS duration,
         printf('%.3f %sbyte', sz / pow(1024.0::DOUBLE, CAST(trunc(log2(sz)) AS INTEGER) // 10), ['', 'Ki', 'Mi', 'Gi'][CAST(trunc(log2(sz)) AS INTEGER) // 10 + 1]) AS size FROM c""",
)
def format_report(spark, d):
    s = X.v_streams(spark, d)
    c = s.select("stream_id").distinct().withColumn("file_size", (F.col("stream_id") % 50 + 1) * 300000)
    return P.format_report(P.container_timings(s, c).join(c, "stream_id"), s).select("stream_id", "nb_streams", "duration", "size")


@query(
    "format_bytecount",
    """SELECT o_orderkey, CASE WHEN n < 100000 THEN n || ' ' WHEN n // 1000 < 100000 THEN n // 1000 || 'k' WHEN n // 1000000 < 100000 THEN n // 1000000 || 'M'
         WHEN n // 1000000000 < 100000 THEN n // 1000000000 || 'G' ELSE n // 1000000000000 || 'T' END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_orderkey AS n FROM orders)""",
)
def format_bytecount(spark, d):
    # The cube of a key from 2,097,152 on is beyond 64 bits; a decimal holds it up to keys of 4e12.
    k = F.col("o_orderkey").cast("decimal(20, 0)")
    return X.table(spark, d, "orders").select("o_orderkey", Tx.format_bytecount(k * k * k).alias("size"))


@query(
    "sample_formats",
    """SELECT block, i, v - 0 AS s16, (v >> 8) + 128 AS u8, v << 16 AS s32, round(v / 32768.0::DOUBLE, 9) AS dbl, greatest(-32768, least(32767, CAST(round_even(x * 32768, 0) AS BIGINT))) AS back
       FROM (SELECT block, i, x, CAST(floor(x * 30000) AS BIGINT) AS v FROM v_samples)""".replace("v << 16", "v * 65536"),
)
def sample_formats(spark, d):
    s = X.v_samples(spark, d).withColumn("v", F.floor(F.col("x") * 30000))
    v = F.col("v")
    return s.select(
        "block", "i", A.convert_sample(v, "s16", "s16").alias("s16"), A.convert_sample(v, "s16", "u8").alias("u8"), A.convert_sample(v, "s16", "s32").alias("s32"),
        F.round(A.convert_sample(v, "s16", "dbl"), 9).alias("dbl"), A.clip_bits(A.convert_sample(F.col("x"), "dbl", "s16"), 16).alias("back"),
    )


@query(
    "quantise",
    """SELECT block, i, greatest(-8388608, least(8388607, v + (n >> 8))) >> 8 AS q16, greatest(-8388608, least(8388607, v)) AS q24, greatest(-8388608, least(8388607, v)) * 256 AS q32
       FROM (SELECT block, i, CAST(floor(x * 16000000) AS BIGINT) AS v, ((block * 64 + i) % 16 - 8) * 4096 AS n FROM v_samples)""",
)
def quantise(spark, d):
    s = X.v_samples(spark, d).withColumn("v", F.floor(F.col("x") * 16000000)).withColumn("sample_no", F.col("block") * 64 + F.col("i"))
    noise = spark.range(16).select(F.col("id").alias("slot"), ((F.col("id") - 8) * 4096).alias("noise"))
    s = A.dithered(s, noise, 16)
    v = F.col("v")
    return s.select(
        "block", "i", A.quantise(v, 24, "16", F.col("noise")).alias("q16"), A.quantise(v, 24, "24").alias("q24"), A.quantise(v, 24, "32").alias("q32")
    )


@query(
    "downmix",
    """SELECT vec_id, round(a[1] + 0.7071067811865476::DOUBLE * a[2] + 0.5::DOUBLE * a[4], 6) AS l, round(0.7071067811865476::DOUBLE * a[2] + a[3] + 0.5::DOUBLE * a[5], 6) AS r
       FROM (SELECT vec_id, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)""",
)
def downmix(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("ch"))
    out = e.withColumn("m", A.mix(F.col("ch"), A.downmix_matrix("stereo")))
    return out.select("vec_id", F.round(F.col("m")[0], 6).alias("l"), F.round(F.col("m")[1], 6).alias("r"))


@query(
    "channel_layout",
    """SELECT event_id, CAST(bit_count(m) AS INTEGER) AS channels, CASE m WHEN 3 THEN 'stereo' WHEN 4 THEN 'mono' WHEN 51 THEN 'quad' WHEN 55 THEN '5.0' WHEN 63 THEN '5.1' WHEN 263 THEN '4.0'
         ELSE bit_count(m) || ' channels' || CASE WHEN m = 0 THEN '' ELSE ' (' || concat_ws('|', CASE WHEN m & 1 > 0 THEN 'FL' END, CASE WHEN m & 2 > 0 THEN 'FR' END, CASE WHEN m & 4 > 0 THEN 'FC' END,
           CASE WHEN m & 8 > 0 THEN 'LFE' END, CASE WHEN m & 16 > 0 THEN 'BL' END, CASE WHEN m & 32 > 0 THEN 'BR' END, CASE WHEN m & 64 > 0 THEN 'FLC' END, CASE WHEN m & 128 > 0 THEN 'FRC' END, CASE WHEN m & 256 > 0 THEN 'BC' END) || ')' END END AS name
       FROM (SELECT event_id, event_id % 512 AS m FROM events)""",
)
def channel_layout(spark, d):
    e = X.events(spark, d).select("event_id", (F.col("event_id") % 512).alias("m"))
    n = A.layout_channels(F.col("m"))
    return e.select("event_id", n.alias("channels"), A.layout_name(n, F.col("m")).alias("name"))


@query(
    "common_formats",
    """WITH v AS (SELECT event_id, list_filter(['yuv420p', 'rgb24', 'gray', 'pal8', 'yuv444p'], lambda f, i: (event_id >> (i - 1)) & 1 = 1) AS a,
          list_filter(['gray', 'yuv444p', 'rgb24', 'yuv420p', 'pal8'], lambda f, i: (event_id >> (i + 4)) & 1 = 1) AS b FROM events)
       SELECT event_id, CASE WHEN len(list_filter(a, lambda f: list_contains(b, f))) > 0 THEN array_to_string(list_filter(a, lambda f: list_contains(b, f)), ',') END AS formats FROM v""",
)
def common_formats(spark, d):
    e = F.col("event_id")
    pick = lambda names, at: F.filter(F.array(*[F.lit(n) for n in names]), lambda f, i: F.call_function("shiftright", e, i + at).bitwiseAND(F.lit(1)) == 1)
    both = Pic.common_formats(pick(["yuv420p", "rgb24", "gray", "pal8", "yuv444p"], 0), pick(["gray", "yuv444p", "rgb24", "yuv420p", "pal8"], 5))
    return X.events(spark, d).select("event_id", F.array_join(both, ",").alias("formats"))


@query("best_format")
def best_format(spark, d):
    e = F.col("event_id")
    names = [f[0] for f in Pic.PIXEL_FORMATS]
    cand = F.filter(F.array(*[F.lit(n) for n in names]), lambda f, i: F.call_function("shiftright", e, i % 11).bitwiseAND(F.lit(1)) == 1)
    src = F.element_at(F.array(*[F.lit(n) for n in names]), (e % len(names) + 1).cast("int"))
    return X.events(spark, d).select("event_id", Pic.best_format(cand, src).alias("format"))


@query(
    "picture_size",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2) WHEN 1 THEN w * h * 3 WHEN 2 THEN w * h ELSE w * h + 1024 END AS size
       FROM (SELECT event_id, event_id % 1920 + 1 AS w, event_id % 1081 + 1 AS h FROM events)""",
)
def picture_size(spark, d):
    e = F.col("event_id")
    f = F.element_at(F.array(*[F.lit(n) for n in ("yuv420p", "rgb24", "gray", "pal8")]), (e % 4 + 1).cast("int"))
    return X.events(spark, d).select("event_id", Pic.picture_size(f, e % 1920 + 1, e % 1081 + 1).alias("size"))


@query(
    "display_geometry",
    """WITH v AS (SELECT event_id, 720 AS w, CASE WHEN event_id % 3 = 0 THEN 1088 ELSE 576 END AS h, CASE WHEN event_id % 2 = 0 THEN 16 ELSE 64 END AS px,
          CASE WHEN event_id % 2 = 0 THEN 15 ELSE 45 END AS py, event_id % 16 AS afd FROM events),
       s AS (SELECT *, CASE WHEN h = 1088 THEN 1080 ELSE h END AS oh FROM v),
       a AS (SELECT *, (px * w * 100) // (py * oh) < 144 AS narrow FROM s),
       c AS (SELECT *, NOT narrow AND afd IN (2, 3, 4, 8, 9, 10, 13, 14, 15) AS p43, NOT narrow AND afd = 11 AS p76 FROM a)
       SELECT event_id, CAST(CASE WHEN p43 THEN 540 WHEN p76 THEN 616 ELSE 720 END AS BIGINT) AS out_width, CAST(oh AS BIGINT) AS out_height, CAST(CASE WHEN p43 THEN 90 WHEN p76 THEN 52 ELSE 0 END AS BIGINT) AS offset_x,
         px * w // gcd(px * w, py * oh) * CASE WHEN p43 THEN 3 WHEN p76 THEN 6 ELSE 1 END AS aspect_x,
         py * oh // gcd(px * w, py * oh) * CASE WHEN p43 THEN 4 WHEN p76 THEN 7 ELSE 1 END AS aspect_y FROM c""",
)
def display_geometry(spark, d):
    e = F.col("event_id")
    v = X.events(spark, d).select(
        "event_id", F.lit(720).alias("width"), F.when(e % 3 == 0, 1088).otherwise(576).alias("height"), F.when(e % 2 == 0, 16).otherwise(64).alias("pixel_x"),
        F.when(e % 2 == 0, 15).otherwise(45).alias("pixel_y"), (e % 16).alias("afd"),
    )
    out = Pic.display_geometry(v, "cut")
    return out.select("event_id", "out_width", "out_height", "offset_x", "aspect_x", "aspect_y")


@query(
    "tag_functions",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN k END AS got, CASE event_type WHEN 'click' THEN 'TIT2' WHEN 'view' THEN 'artist' ELSE event_type END AS renamed,
         CASE WHEN starts_with(event_type, 'vi') OR starts_with(event_type, 'er') THEN 1 ELSE 0 END AS n
       FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)""",
)
def tag_functions(spark, d):
    t = X.v_tags(spark, d).select(F.col("stream_id").alias("event_id"), F.create_map("key", "value").alias("tags"))
    renamed = Tx.translate_keys(F.col("tags"), {"CLICK": "title", "VIEW": "artist"}, {"Title": "TIT2"})
    n = F.size(Tx.tags_with_prefix(F.col("tags"), "VI")) + F.size(Tx.tags_with_prefix(F.col("tags"), "er"))
    return t.select("event_id", Tx.tag_get(F.col("tags"), "Click").alias("got"), F.map_keys(renamed)[0].alias("renamed"), n.alias("n"))


@query(
    "number_strings",
    """SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN v * 1000 WHEN 1 THEN v * 1048576 WHEN 2 THEN v * 8 WHEN 3 THEN v / 1000.0::DOUBLE ELSE NULL END, 9) AS n, round(exp(-x * x / 2) / sqrt(2 * pi()), 9) AS g, round(1 / (1 + exp(4 * x)), 9) AS s
       FROM (SELECT event_id, (event_id % 1000 + 0.5)::DOUBLE AS v, (event_id % 7 - 3)::DOUBLE AS x FROM events)""",
)
def number_strings(spark, d):
    e = F.col("event_id")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("k", "Mi", "B", "m")]), F.least(e % 5 + 1, F.lit(4)).cast("int"))
    text = F.when(e % 5 == 4, "none").otherwise(F.concat((e % 1000).cast("string"), F.lit(".5"), suffix))
    x = (e % 7 - 3).cast("double")
    return X.events(spark, d).select("event_id", F.round(Tx.parse_number(text), 9).alias("n"), F.round(Tx.gauss(x), 9).alias("g"), F.round(Tx.squish(x), 9).alias("s"))


@query(
    "url_parts",
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS proto, regexp_extract(url, '^[a-z]+://([^:/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^:/?#]*(.*)$', 1) AS path,
         ends_with(lower(regexp_extract(url, '^[a-z]+://([^:/?#]*)', 1)), '.org') AS org FROM pages""",
)
def url_parts(spark, d):
    p = X.table(spark, d, "pages").withColumn("u", Tx.split_url(F.col("url")))
    return p.select("page_id", "u.proto", "u.host", "u.path", Tx.match_extension(F.col("u.host"), ["ORG"]).alias("org"))


@query(
    "digests",
    """SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, base64(encode(text)) AS b64 FROM documents""",
)
def digests(spark, d):
    return X.table(spark, d, "documents").select(
        "doc_id", F.md5(F.encode("text", "utf-8")).alias("md5"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"),
        F.regexp_replace(F.base64(F.encode("text", "utf-8")), "[\r\n]", "").alias("b64"),
    )

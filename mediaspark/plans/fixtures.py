"""Media tables derived from the driver's tables, in Spark and in SQL.

Each view has a Spark builder and a DuckDB text with the same meaning.  ``sql``
prefixes a query with the views it names, so both engines start from one fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.operators.scan import chunk_id, count_up, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; times are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark, d):
    return table(spark, d, "events")


def v_packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets in arrival order; ``seq`` has gaps within a stream."""
    return events(spark, d).select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("stream_id"),
        "event_id",
        F.when(F.col("event_type") == "view", 0)
        .when(F.col("event_type") == "click", 1)
        .otherwise(2)
        .cast("int")
        .alias("stream_index"),
        us("ts").alias("dts"),
        F.when(F.col("event_id") % 7 != 0, us("ts") + F.lit(40000) * (F.col("event_id") % 3)).alias("pts"),
        F.floor(F.col("value") * 100).alias("size"),
        (F.col("event_type") == "purchase").alias("is_key"),
        (F.col("event_type") == "error").alias("disc"),
    )


def v_packets_n(spark: SparkSession, d: str) -> DataFrame:
    """Packets with consecutive numbers per stream."""
    return number_rows(v_packets(spark, d), ["stream_id"], ["event_id"], [chunk_id("event_id")])


def v_streams(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    su = table(spark, d, "supplier").select("s_suppkey")
    g = li.groupBy("l_suppkey", "l_linenumber").agg(
        F.min(us("l_shipdate")).alias("start_time"),
        F.max(us("l_shipdate")).alias("__stop"),
        F.sum("l_quantity").alias("__q"),
    )
    n = F.col("l_linenumber")
    return g.join(su, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("stream_id"),
        n.alias("stream_index"),
        F.when(n == 1, "video").when(n < 4, "audio").otherwise("data").alias("codec_type"),
        "start_time",
        (F.col("__stop") - F.col("start_time")).alias("duration"),
        (F.col("__q").cast("bigint") * 1000).alias("bit_rate"),
    )


def v_lines(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    px = F.transform(
        "embedding",
        lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 128))).cast("int"),
    )
    return table(spark, d, "embeddings").select(
        F.expr("vec_id div 100").alias("stream_id"),
        F.expr("vec_id div 10 % 10").alias("frame_no"),
        F.lit("Y").alias("plane"),
        (v % 10).alias("line_no"),
        px.alias("px"),
    )


def v_lines16(spark: SparkSession, d: str) -> DataFrame:
    """As ``v_lines`` with 16 lines per picture, for block operators."""
    return v_lines(spark, d).select(
        ((F.col("stream_id") * 100 + F.col("frame_no") * 10 + F.col("line_no"))).alias("__v"), "plane", "px"
    ).select(
        F.expr("__v div 160").alias("stream_id"), F.expr("__v div 16 % 10").alias("frame_no"), "plane",
        (F.col("__v") % 16).alias("line_no"), "px",
    )


def v_fields(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return events(spark, d).select(
        F.expr("event_id div 50").alias("stream_id"),
        (F.col("event_id") % 50).alias("field_no"),
        (F.col("event_id") % 2 == 0).alias("is_top"),
        F.when(t == "view", "AFTERNEXT_32")
        .when(t == "click", "NEXT_32")
        .when(t == "purchase", "PREV_32")
        .when(t == "signup", "NEXT_22")
        .otherwise("PREV_22")
        .alias("hint"),
    )


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]


def _numbered_lines(spark, d, name):
    li = table(spark, d, "lineitem")
    return number_rows(li, ["l_suppkey"], _LINE_ORDER, [chunk_id("l_orderkey")], name)


def v_frames(spark: SparkSession, d: str) -> DataFrame:
    return _numbered_lines(spark, d, "frame_no").select(
        F.col("l_suppkey").alias("stream_id"),
        "frame_no",
        us("l_shipdate").alias("rt_start"),
        (F.lit(2) + F.col("l_linenumber") % 2).cast("int").alias("nb_fields"),
        (F.col("l_returnflag") == "N").alias("progressive"),
        (F.col("l_linestatus") == "O").alias("tff"),
    )


def v_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues laid end to end; a cue's length is its text length.

    Start times are running sums, so they come from ``running`` and hold for a
    conversation of any length.
    """
    from mediaspark.operators.scan import running

    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("stream_id"),
        F.col("turn").alias("cue_no"),
        F.length("text").cast("bigint").alias("__n"),
        (F.col("role") == "assistant").alias("forced"),
    )
    c = running(c, ["stream_id"], "cue_no", {"__stop": ("sum", F.col("__n"))})
    return c.select(
        "stream_id",
        "cue_no",
        (F.col("__stop") - F.col("__n")).alias("start"),
        F.when(F.col("cue_no") % 3 != 0, F.col("__stop")).alias("stop"),
        "forced",
    )


def v_cue_frames(spark: SparkSession, d: str) -> DataFrame:
    last = v_cues(spark, d).groupBy("stream_id").agg(F.max("start").alias("m"))
    frames = count_up(last, ["stream_id"], F.expr("(m + 199) div 40 + 1"), "n")
    return frames.select("stream_id", (F.col("n") * 40).alias("t"))


def v_runs(spark: SparkSession, d: str) -> DataFrame:
    return _numbered_lines(spark, d, "run_no").select(
        F.col("l_suppkey").alias("stream_id"),
        "run_no",
        F.col("l_quantity").cast("int").alias("count"),
        (F.col("l_linenumber") * 40).cast("int").alias("duration"),
    )


def v_pass1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("stream_id"),
        F.col("l_orderkey").alias("frame_no"),
        F.col("l_returnflag").alias("pict_type"),
        F.col("l_quantity").cast("int").alias("q"),
        F.round("l_extendedprice").cast("bigint").alias("tex_bits"),
        F.round(F.col("l_tax") * 10000).cast("int").alias("misc_bits"),
    )


def v_ts(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(
        F.col("event_id").alias("packet_no"),
        (F.col("user_id") % 8).alias("pid"),
        (F.col("event_type") == "signup").alias("pusi"),
        F.when(F.col("event_id") % 20 == 0, us("ts") * 27).alias("pcr"),
    )
    e = number_rows(e, ["pid"], ["packet_no"], [chunk_id("packet_no")], "__n")
    skip = F.when(F.col("packet_no") % 37 == 0, 1).otherwise(0)
    return e.select(
        "packet_no", "pid", ((F.col("__n") + skip) % 16).cast("int").alias("cc"), "pusi", "pcr"
    )


def v_sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_linenumber <= 4").select(
        F.col("l_partkey").alias("pid"),
        (F.col("l_orderkey") % 4).alias("version"),
        (F.col("l_linenumber") - 1).alias("section_no"),
        F.lit(3).alias("last_no"),
        F.col("l_orderkey").alias("payload"),
    )


def v_conns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("conn_id"),
        F.col("o_custkey").alias("src_addr"),
        us("o_orderdate").alias("t"),
        F.floor("o_totalprice").alias("bytes"),
        F.col("o_orderstatus").alias("state"),
    )


def v_acl(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("rule_no"),
        (k * 50).alias("first_addr"),
        (k * 50 + 30).alias("last_addr"),
        (F.col("n_regionkey") % 2 == 0).alias("allow"),
    )


def v_files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(
        F.col("page_id").alias("file_id"), F.col("url").alias("filename"), F.col("html").alias("head")
    )
    t = table(spark, d, "documents").select(
        (F.col("doc_id") + 1000000).alias("file_id"), F.col("source").alias("filename"), F.col("text").alias("head")
    )
    return p.unionByName(t)


def v_tags(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(
        F.col("event_id").alias("stream_id"),
        F.col("event_type").alias("key"),
        F.get_json_object("props", "$.k").alias("value"),
    )


def v_samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("block"), F.posexplode("embedding").alias("i", "x")
    ).withColumn("x", F.col("x").cast("double"))


def v_rtp(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").alias("ssrc"), "event_id", us("ts").alias("arrival_us"))
    e = number_rows(e, ["ssrc"], ["event_id"], [chunk_id("event_id")], "arrival_no")
    jump = F.when(F.col("event_id") % 17 == 0, 3).otherwise(0)
    return e.select(
        "ssrc", "arrival_no", ((F.lit(65500) + F.col("arrival_no") + jump) % 65536).cast("int").alias("seq"),
        "arrival_us",
    )


SQL: dict[str, str] = {
    "v_packets": """SELECT user_id AS stream_id, event_id, event_id AS seq,
        CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS stream_index, epoch_us(ts) AS dts,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch_us(ts) + 40000 * (event_id % 3) END AS pts,
        CAST(floor(value * 100) AS BIGINT) AS size, event_type = 'purchase' AS is_key,
        event_type = 'error' AS disc FROM events""",
    "v_packets_n": """SELECT * REPLACE (row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS seq)
        FROM v_packets""",
    "v_streams": """SELECT s_suppkey AS stream_id, l_linenumber AS stream_index,
        CASE WHEN l_linenumber = 1 THEN 'video' WHEN l_linenumber < 4 THEN 'audio' ELSE 'data' END AS codec_type,
        min(epoch_us(l_shipdate)) AS start_time,
        max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate)) AS duration,
        CAST(sum(l_quantity) AS BIGINT) * 1000 AS bit_rate
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "v_lines": """SELECT vec_id // 100 AS stream_id, vec_id // 10 % 10 AS frame_no, 'Y' AS plane,
        vec_id % 10 AS line_no, list_transform(embedding, lambda x:
        CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 128))) AS INTEGER)) AS px FROM embeddings""",
    "v_px": """SELECT stream_id, frame_no, plane, line_no, unnest(range(64)) AS x, unnest(px) AS p FROM v_lines""",
    "v_lines16": """SELECT (stream_id * 100 + frame_no * 10 + line_no) // 160 AS stream_id,
        (stream_id * 100 + frame_no * 10 + line_no) // 16 % 10 AS frame_no, plane,
        (stream_id * 100 + frame_no * 10 + line_no) % 16 AS line_no, px FROM v_lines""",
    "v_px16": """SELECT stream_id, frame_no, plane, line_no, unnest(range(64)) AS x, unnest(px) AS p FROM v_lines16""",
    "v_fields": """SELECT event_id // 50 AS stream_id, event_id % 50 AS field_no, event_id % 2 = 0 AS is_top,
        CASE event_type WHEN 'view' THEN 'AFTERNEXT_32' WHEN 'click' THEN 'NEXT_32' WHEN 'purchase' THEN 'PREV_32'
        WHEN 'signup' THEN 'NEXT_22' ELSE 'PREV_22' END AS hint FROM events""",
    "v_frames": """SELECT l_suppkey AS stream_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,
        l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS frame_no, epoch_us(l_shipdate) AS rt_start,
        2 + (l_linenumber % 2) AS nb_fields, l_returnflag = 'N' AS progressive, l_linestatus = 'O' AS tff
        FROM lineitem""",
    "v_cues": """SELECT conv_id AS stream_id, turn AS cue_no,
        CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start,
        CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(sum(length(text)) OVER w AS BIGINT) END AS stop,
        role = 'assistant' AS forced FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "v_cue_frames": """SELECT stream_id, unnest(range(0, CAST(max(start) AS BIGINT) + 200, 40)) AS t
        FROM v_cues GROUP BY stream_id""",
    "v_runs": """SELECT l_suppkey AS stream_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,
        l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS run_no, CAST(l_quantity AS INTEGER) AS count,
        CAST(l_linenumber AS INTEGER) * 40 AS duration FROM lineitem""",
    "v_pass1": """SELECT l_suppkey AS stream_id, l_orderkey AS frame_no, l_returnflag AS pict_type,
        CAST(l_quantity AS INTEGER) AS q, CAST(round(l_extendedprice) AS BIGINT) AS tex_bits,
        CAST(round(l_tax * 10000) AS INTEGER) AS misc_bits FROM lineitem""",
    "v_ts": """SELECT event_id AS packet_no, user_id % 8 AS pid,
        CAST((row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id)
        + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END) % 16 AS INTEGER) AS cc, event_type = 'signup' AS pusi,
        CASE WHEN event_id % 20 = 0 THEN epoch_us(ts) * 27 END AS pcr FROM events""",
    "v_sections": """SELECT l_partkey AS pid, l_orderkey % 4 AS version, l_linenumber - 1 AS section_no,
        3 AS last_no, l_orderkey AS payload FROM lineitem""",
    "v_conns": """SELECT o_orderkey AS conn_id, o_custkey AS src_addr, epoch_us(o_orderdate) AS t,
        CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderstatus AS state FROM orders""",
    "v_acl": """SELECT n_nationkey AS rule_no, n_nationkey * 50 AS first_addr, n_nationkey * 50 + 30 AS last_addr,
        n_regionkey % 2 = 0 AS allow FROM nation""",
    "v_files": """SELECT page_id AS file_id, url AS filename, html AS head FROM pages
        UNION ALL SELECT 1000000 + doc_id, source, text FROM documents""",
    "v_tags": """SELECT event_id AS stream_id, event_type AS key,
        json_extract_string(props, '$.k') AS value FROM events""",
    "v_samples": """SELECT vec_id AS block, CAST(unnest(range(64)) AS INTEGER) AS i,
        CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings""",
    "v_rtp": """SELECT user_id AS ssrc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS arrival_no,
        CAST((65500 + row_number() OVER (PARTITION BY user_id ORDER BY event_id)
        + CASE WHEN event_id % 17 = 0 THEN 3 ELSE 0 END) % 65536 AS INTEGER) AS seq, epoch_us(ts) AS arrival_us
        FROM events""",
}


def sql(body: str) -> str:
    """The query text with the fixture views it uses as leading CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", text):
            if name in SQL and name not in needed:
                visit(SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

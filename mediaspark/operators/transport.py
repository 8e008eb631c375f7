"""Transport stream packets: continuity, sections, tables and programs."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspark.operators.scan import CHUNK_ROWS, chunk_id, cut_lineage, neighbours, previous, running

PACKET = 188
SYNC = 0x47
SECTION_MAX = 4096

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 with the polynomial 0x04C11DB7, not reflected, not inverted.

    The library's CRC reads bits the other way round, so bytes go in and the sum
    comes out mirrored.
    """
    mirrored = zlib.crc32(data.translate(_MIRROR)) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def byte_at(data: Column, i) -> Column:
    """Unsigned value of the byte at position ``i`` (from 0) of a binary column."""
    pos = i + 1 if isinstance(i, int) else i + F.lit(1)
    piece = F.substring(data, pos, 1) if isinstance(i, int) else F.substring(data, pos, F.lit(1))
    return F.conv(F.hex(piece), 16, 10).cast("int")


def bytes_at(data: Column, i: int, n: int) -> Column:
    """Big-endian unsigned value of ``n`` bytes."""
    return F.conv(F.hex(F.substring(data, i + 1, n)), 16, 10).cast("bigint")


def parse_header(df: DataFrame, *, data: str = "data") -> DataFrame:
    """Header fields and payload of 188-byte packets; rows without sync are dropped."""
    d = F.col(data)
    ok = df.filter((F.octet_length(d) == PACKET) & (byte_at(d, 0) == SYNC))
    ok = ok.withColumn("__h", bytes_at(d, 1, 3)).withColumn("__a", byte_at(d, 4))
    h = F.col("__h")
    afc = F.shiftright(h, 4).bitwiseAND(F.lit(3)).cast("int")
    skip = F.when(afc.bitwiseAND(F.lit(2)) != 0, F.lit(5) + F.col("__a")).otherwise(4)
    return (
        ok.withColumn("pid", F.shiftright(h, 8).bitwiseAND(F.lit(0x1FFF)).cast("int"))
        .withColumn("pusi", h.bitwiseAND(F.lit(0x400000)) != 0)
        .withColumn("cc", h.bitwiseAND(F.lit(15)).cast("int"))
        .withColumn("afc", afc)
        .withColumn("payload", F.when(afc.bitwiseAND(F.lit(1)) != 0, F.substring(d, skip + 1, F.lit(PACKET))))
        .drop("__h", "__a")
    )


def ts_continuity(
    df: DataFrame, *, keys: Sequence[str] = ("stream_id", "pid"), order: str = "packet_no", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Flag packets whose counter does not follow the one before (first is fine)."""
    out = previous(df, keys, order, {"__cc": F.col("cc")}, rows=rows)
    broken = F.col("__cc").isNotNull() & (F.col("cc") != (F.col("__cc") + 1) % 16)
    return out.withColumn("discontinuity", broken).drop("__cc")


def _units(df: DataFrame, keys: Sequence[str], order: str, rows: int) -> DataFrame:
    """Breaks and unit numbers in one pass; packets without payload go unless the counter breaks there.

    A start opens a unit, and a break without a start ends it.  Adds ``discontinuity``,
    ``unit``, ``__head`` (the unit began with a start) and ``__first`` (its first packet).
    Inside a chunk all but its first packet can tell a break; a chunk hands on its first
    packet, its last counter and its starts, and its first packet is settled between chunks.
    """
    keys = list(keys)
    within, o = [*keys, "__chunk"], F.col(order)
    cc_after = lambda cc, last: last.isNotNull() & (cc != (last + 1) % 16)
    base = df.withColumn("__chunk", chunk_id(order, rows))
    w = Window.partitionBy(*within).orderBy(order)
    base = base.withColumns({"__at": F.row_number().over(w), "__last": F.lag("cc").over(w), "__full": F.col("payload").isNotNull()})
    base = base.withColumn("discontinuity", cc_after(F.col("cc"), F.col("__last")))
    # A cut: its packet number, and whether a unit starts there.
    opens = lambda broken: F.when(F.coalesce(broken, F.lit(False)) | (F.col("pusi") & F.col("__full")), F.struct(o.alias("o"), F.col("pusi").alias("head")))
    base = base.withColumn("__cut", F.when(F.col("__at") > 1, opens(F.col("discontinuity"))))
    summary = base.groupBy(*within).agg(
        F.max_by("cc", o).alias("__cc"), F.count("__cut").alias("__n"), F.max_by("__cut", F.col("__cut.o")).alias("__c"),
        F.min_by(F.struct("cc", F.col("__full"), F.col("pusi"), o.alias("o")), o).alias("__f"),
    )
    wc = Window.partitionBy(*keys).orderBy("__chunk")
    earlier = wc.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__lost", F.coalesce(cc_after(F.col("__f.cc"), F.lag("__cc").over(wc)), F.lit(False)))
    first_cut = F.when(F.col("__lost") | (F.col("__f.pusi") & F.col("__f.__full")), F.struct(F.col("__f.o").alias("o"), F.col("__f.pusi").alias("head")))
    summary = summary.withColumn("__fc", first_cut)
    here = F.col("__fc").isNotNull().cast("bigint")
    summary = summary.withColumns({"__all": F.col("__n") + here, "__c": F.coalesce("__c", "__fc")})
    carry = summary.select(
        *within, "__lost", (F.coalesce(F.sum("__all").over(earlier), F.lit(0)) + here).alias("__before"),
        F.coalesce("__fc", F.last("__c", ignorenulls=True).over(earlier)).alias("__open"),
    )
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({"__k": F.count("__cut").over(so_far), "__c": F.last("__cut", ignorenulls=True).over(so_far)})
    out = local.join(carry, within, "left")
    out = out.withColumns({
        "discontinuity": F.when(F.col("__at") == 1, F.col("__lost")).otherwise(F.coalesce("discontinuity", F.lit(False))),
        "unit": F.col("__before") + F.col("__k"), "__c": F.coalesce("__c", "__open"),
    })
    out = out.filter(F.col("__full") | F.col("discontinuity"))
    kept = [x for x in df.columns if x not in ("discontinuity", "unit")]
    return out.select(*kept, "discontinuity", "unit", F.col("__c.head").alias("__head"), F.col("__c.o").alias("__first"))


def _joined(order: str) -> Column:
    """Aggregate: the bytes ``b`` of a group's packets in order, as hex digits."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.hex("b").alias("h")))), lambda s: s["h"]), "")


def assemble_sections(
    df: DataFrame, *, keys: Sequence[str] = ("stream_id", "pid"), order: str = "packet_no", rows: int = CHUNK_ROWS, check_crc: bool = True
) -> DataFrame:
    """PSI sections from packet payloads (``cc, pusi, payload``).

    A payload start carries a pointer: the bytes ahead of it end the section that
    is open, the rest begins a new one.  A counter break drops the open section.
    Sections are cut to their length field and checked by their CRC.
    """
    keys = list(keys)
    df = _units(df, keys, order, rows)
    p = F.coalesce(F.col("payload"), F.lit(b""))
    pointer = F.when(F.col("pusi"), byte_at(p, 0)).otherwise(0)
    df = df.withColumn("__ptr", pointer)
    # The start of this unit, and the bytes that still belong to the unit before.
    own = F.struct(
        F.col("unit").alias("u"), F.col(order).alias("o"),
        F.when(F.col("pusi"), F.substring(p, F.col("__ptr") + 2, F.lit(PACKET))).otherwise(p).alias("b"),
        F.col("__head").alias("ok"),
    )
    tail = F.struct(
        (F.col("unit") - 1).alias("u"), F.col(order).alias("o"), F.substring(p, F.lit(2), F.col("__ptr")).alias("b"),
        (F.col("pusi") & ~F.col("discontinuity") & (F.col("__ptr") > 0)).alias("ok"),
    )
    parts = df.select(*keys, F.explode(F.array(own, tail)).alias("e")).filter("e.ok AND e.u > 0")
    unit = parts.select(*keys, F.col("e.u").alias("unit"), F.col("e.o").alias(order), F.col("e.b").alias("b"))
    # Parts of a unit are joined first.  Its first three bytes say how long the section is; parts
    # beyond that are stuffing and aren't needed, those of a unit that never ends included.
    part = chunk_id(order, 8192).alias("__part")
    small = unit.groupBy(*keys, "unit", part).agg(F.min(order).alias("__at"), _joined(order).alias("__hex"))
    w = Window.partitionBy(*keys, "unit").orderBy("__part")
    start = F.substring(F.first("__hex").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 3, 4)
    needs = F.when(F.length(start) == 4, F.conv(start, 16, 10).cast("bigint").bitwiseAND(F.lit(0xFFF))).otherwise(0xFFF) + 3
    got = F.coalesce(F.sum(F.length("__hex")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = small.withColumns({"__got": got, "__needs": needs}).filter(F.col("__got") < 2 * F.col("__needs"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__part", "__hex"))), lambda s: s["__hex"]), "")
    g = small.groupBy(*keys, "unit").agg(F.min("__at").alias("first_packet"), F.unhex(whole).alias("data"))
    length = bytes_at(F.col("data"), 1, 2).bitwiseAND(F.lit(0xFFF)) + 3
    g = g.filter(F.octet_length("data") >= 3).withColumn("__len", length.cast("int"))
    g = g.filter((F.octet_length("data") >= F.col("__len")) & (F.col("__len") <= SECTION_MAX))
    g = g.withColumn("data", F.substring("data", F.lit(1), F.col("__len"))).drop("__len")
    d = F.col("data")
    syntax = byte_at(d, 1) >= 128
    if check_crc:

        @F.pandas_udf("boolean")
        def intact(s: pd.Series) -> pd.Series:
            return s.map(lambda b: crc32_mpeg(bytes(b)) == 0)

        g = g.withColumn("__ok", intact(d)).filter(~syntax | F.col("__ok")).drop("__ok")
    n = F.octet_length(d)
    return g.select(
        *keys, "first_packet", byte_at(d, 0).alias("table_id"),
        F.when(syntax, bytes_at(d, 3, 2).cast("int")).alias("extension"),
        F.when(syntax, F.shiftright(byte_at(d, 5).bitwiseAND(F.lit(0x3E)), 1)).alias("version"),
        F.when(syntax, byte_at(d, 5) % 2 == 1).alias("current_next"),
        F.when(syntax, byte_at(d, 6)).alias("section_no"),
        F.when(syntax, byte_at(d, 7)).alias("last_no"),
        F.when(syntax, F.substring(d, F.lit(9), n - 12)).otherwise(F.substring(d, F.lit(4), n - 3)).alias("payload"),
    )


def assemble_pes(
    df: DataFrame, *, keys: Sequence[str] = ("stream_id", "pid"), order: str = "packet_no", rows: int = CHUNK_ROWS, part_span: int = 1 << 16
) -> DataFrame:
    """Elementary stream units: payload from one start to the next.

    A counter break drops the unit it falls into.  A length field other than 0 cuts
    the unit.  A unit that spans more than ``part_span`` packet numbers comes in
    several parts, so one that never ends stays in rows of bounded size.
    """
    keys = list(keys)
    df = _units(df, keys, order, rows)
    # A break opens a unit of its own; the unit before it has lost its end, which a row without bytes tells it.
    part = F.call_function("div", F.col(order) - F.col("__first"), F.lit(part_span))
    own = F.struct(F.col("unit").alias("u"), part.alias("part_no"), F.col("__first").alias("first"), F.col("payload").alias("b"), F.lit(False).alias("lost"))
    end = F.struct(
        (F.col("unit") - 1).alias("u"), F.lit(0).cast("bigint").alias("part_no"), F.lit(None).cast(df.schema[order].dataType).alias("first"),
        F.lit(None).cast("binary").alias("b"), F.lit(True).alias("lost"),
    )
    mine = F.when(F.col("__head") & F.col("payload").isNotNull(), F.array(own))
    broken = F.when(F.col("discontinuity") & ~F.col("pusi"), F.array(end))
    rows_of = F.concat(F.coalesce(mine, F.filter(F.array(own), lambda x: F.lit(False))), F.coalesce(broken, F.filter(F.array(end), lambda x: F.lit(False))))
    told = df.select(*keys, order, F.explode(rows_of).alias("e")).select(*keys, order, F.col("e.u").alias("unit"), "e.part_no", "e.first", "e.b", "e.lost")
    g = told.groupBy(*keys, "unit", "part_no").agg(F.min("first").alias("first_packet"), F.max("lost").alias("__lost"), F.unhex(_joined(order)).alias("data"))
    of_unit = Window.partitionBy(*keys, "unit")
    g = g.withColumn("__lost", F.max("__lost").over(of_unit)).filter(~F.col("__lost")).drop("__lost")
    # Parts per unit, not packets, meet in this window.
    w = Window.partitionBy(*keys, "unit").orderBy("part_no")
    size = F.first(bytes_at(F.col("data"), 4, 2)).over(w)
    before = F.coalesce(F.sum(F.octet_length("data")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumns({"__size": size, "__before": before})
    left = F.when(F.col("__size") > 0, F.greatest(F.col("__size") + 6 - F.col("__before"), F.lit(0))).otherwise(F.octet_length("data"))
    g = g.withColumn("data", F.substring("data", F.lit(1), left.cast("int"))).filter(F.octet_length("data") > 0)
    return g.drop("__size", "__before")


def complete_tables(
    sections: DataFrame, *, keys: Sequence[str] = ("pid", "table_id"), order: str = "seq", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Tables of which all sections have come, with their payloads in order.

    A change of extension, version or last section number, or a discontinuity,
    starts the collection over.  Until a table is complete a repeated section
    replaces the earlier one; later ones do not count.  Needs consecutive numbers.
    """
    keys = list(keys)
    s = sections
    if "disc" not in s.columns:
        s = s.withColumn("disc", F.lit(False))
    s = s.withColumn("__id", F.struct("extension", "version", "last_no"))
    s = neighbours(s, keys, order, 1, 0, {"__pid": lambda w: F.lag("__id").over(w)}, rows=rows)
    fresh = F.col("__pid").isNull() | ~F.col("__id").eqNullSafe(F.col("__pid")) | F.col("disc")
    s = running(s, keys, order, {"epoch": ("count", F.when(fresh, 1))}, rows=rows).drop("__id", "__pid")
    # Read twice below.
    s = cut_lineage(s.filter(F.col("section_no") <= F.col("last_no")))
    e = [*keys, "epoch"]
    seen = s.groupBy(*e, "section_no", "last_no").agg(F.min(order).alias("__first"))
    done = seen.groupBy(*e).agg(
        F.count(F.lit(1)).alias("__n"), F.max("last_no").alias("__last"), F.max("__first").alias("completed_at")
    ).filter(F.col("__n") == F.col("__last") + 1)
    kept = s.join(done.select(*e, "completed_at"), e).filter(F.col(order) <= F.col("completed_at"))
    last = kept.groupBy(*e, "extension", "version", "section_no", "completed_at").agg(F.max_by("payload", order).alias("payload"))
    # A table has at most 256 sections.
    body = F.transform(F.array_sort(F.collect_list(F.struct("section_no", "payload"))), lambda x: x["payload"])
    return last.groupBy(*e, "extension", "version", "completed_at").agg(body.alias("payloads"))


def pat_programs(sections: DataFrame) -> DataFrame:
    """Program numbers and their table PIDs from association section payloads."""
    n = F.call_function("div", F.octet_length("payload"), F.lit(4))
    at = F.col("i") * 4
    rows = sections.filter(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
    word = F.conv(F.hex(F.substring("payload", at + 1, F.lit(4))), 16, 10).cast("bigint")
    return rows.withColumn("program", F.shiftright(word, 16).cast("int")).withColumn(
        "pmt_pid", word.bitwiseAND(F.lit(0x1FFF)).cast("int")
    ).drop("i")


def pmt_streams(sections: DataFrame) -> DataFrame:
    """Elementary streams of map sections, in table order.

    Their descriptors are of any length, so each section (at most 4 KB) is walked.
    """

    @F.pandas_udf("array<struct<es_no:int,es_type:int,es_pid:int>>")
    def walk(payload: pd.Series) -> pd.Series:
        out = []
        for raw in payload:
            b, found = bytes(raw), []
            at = 4 + ((b[2] & 0x0F) << 8 | b[3]) if len(b) >= 4 else len(b)
            while at + 5 <= len(b):
                found.append({"es_no": len(found), "es_type": b[at], "es_pid": (b[at + 1] & 0x1F) << 8 | b[at + 2]})
                at += 5 + ((b[at + 3] & 0x0F) << 8 | b[at + 4])
            out.append(found)
        return pd.Series(out)

    keep = [c for c in sections.columns if c != "payload"]
    return sections.select(*keep, F.inline(walk("payload")))


def sdt_services(sections: DataFrame) -> DataFrame:
    """Services of a description section with status flags."""

    @F.pandas_udf("array<struct<service_id:int,eit_schedule:boolean,eit_present:boolean,running_status:int,free_ca:boolean>>")
    def walk(payload: pd.Series) -> pd.Series:
        out = []
        for raw in payload:
            b, found, at = bytes(raw), [], 3
            while at + 5 <= len(b):
                found.append({
                    "service_id": b[at] << 8 | b[at + 1], "eit_schedule": bool(b[at + 2] & 2), "eit_present": bool(b[at + 2] & 1),
                    "running_status": b[at + 3] >> 5, "free_ca": bool(b[at + 3] & 0x10),
                })
                at += 5 + ((b[at + 3] & 0x0F) << 8 | b[at + 4])
            out.append(found)
        return pd.Series(out)

    keep = [c for c in sections.columns if c != "payload"]
    return sections.select(*keep, F.inline(walk("payload")))


def program_map(pat: DataFrame, streams: DataFrame) -> DataFrame:
    """Video and audio PID per program.

    The first stream of type 1 or 2 is the video.  Audio is the first of type 3, 4
    or 15, unless there is one of type 129: the last such stream counts.
    """
    j = pat.filter("program > 0").join(streams, "program")
    t, at = F.col("es_type"), F.col("es_no")
    g = j.groupBy("program", "pmt_pid").agg(
        F.min_by("es_pid", F.when(t.isin(1, 2), at)).alias("video_pid"),
        F.min_by(F.struct("es_pid", "es_type"), F.when(t.isin(3, 4, 15), at)).alias("__a"),
        F.max_by("es_pid", F.when(t == 129, at)).alias("__x"),
    )
    audio = F.coalesce("__x", F.col("__a")["es_pid"])
    kind = F.when(F.col("__x").isNotNull(), 129).when(F.col("__a")["es_type"] == 15, 6).when(F.col("__a").isNotNull(), 3)
    return g.select("program", "pmt_pid", "video_pid", audio.alias("audio_pid"), kind.alias("audio_type"))


def filter_programs(packets: DataFrame, pids: DataFrame) -> DataFrame:
    """Packets of the chosen PIDs; PID 0 always stays."""
    wanted = pids.select("pid").unionByName(pids.sparkSession.sql("SELECT 0 AS pid")).distinct()
    return packets.join(wanted, "pid", "left_semi")


# ------------------------------------------------------------- user data


def active_format(df: DataFrame, *, data: str = "data") -> DataFrame:
    """Active format code of picture user data marked ``DTG1``, else null."""
    d = F.col(data)
    hit = (F.octet_length(d) >= 6) & (F.hex(F.substring(d, 1, 4)) == "44544731") & (byte_at(d, 4) == 65)
    return df.withColumn("afd", F.when(hit, byte_at(d, 5).bitwiseAND(F.lit(15))))


def caption_pairs(df: DataFrame, *, data: str = "data") -> DataFrame:
    """Caption byte pairs of user data marked ``GA94`` type 3 (field 1 only)."""
    d = F.col(data)
    hit = (F.octet_length(d) >= 6) & (F.hex(F.substring(d, 1, 4)) == "47413934") & (byte_at(d, 4) == 3)
    flags = byte_at(d, 5)
    hit = hit & (flags.bitwiseAND(F.lit(0x40)) != 0)
    count = flags.bitwiseAND(F.lit(0x1F))
    hexed = F.hex(d)
    at = lambda i: F.substring(hexed, i * 6 + 15, F.lit(6))
    triples = F.transform(F.sequence(F.lit(0), count - 1), at)
    used = F.filter(triples, lambda t: F.length(t) == 6)
    pairs = F.transform(F.filter(used, lambda t: t.startswith("FC")), lambda t: F.substring(t, F.lit(3), F.lit(4)))
    none = F.array().cast("array<string>")
    return df.withColumn("pairs", F.when(hit & (count > 0), pairs).otherwise(none))


def vbr_duration(df: DataFrame, *, head: str = "head") -> DataFrame:
    """Frames and duration (s) of variable-rate layer 3 files from their first frame."""
    d = F.col(head)
    v = bytes_at(d, 0, 4)
    bits = lambda shift, mask: F.shiftright(v, shift).bitwiseAND(F.lit(mask)).cast("int")
    version, layer, rate_idx, mode = bits(19, 3), bits(17, 3), bits(10, 3), bits(6, 3)
    valid = (bits(21, 0x7FF) == 0x7FF) & (layer == 1) & (rate_idx != 3) & (version != 1) & (bits(12, 15) != 15)
    # Sample rates by index (fixed values); halved or quartered for lower versions.
    base = F.element_at(F.array(F.lit(44100), F.lit(48000), F.lit(32000)), F.least(rate_idx, F.lit(2)) + 1)
    low = version != 3
    rate = F.when(version == 3, base).when(version == 2, F.shiftright(base, 1)).otherwise(F.shiftright(base, 2))
    mono = mode == 3
    hexed = F.hex(d)
    at = F.when(low, F.when(mono, 9).otherwise(17)).otherwise(F.when(mono, 17).otherwise(32)) + 4
    word = lambda pos: F.substring(hexed, pos * 2 + 1, F.lit(8))
    num = lambda h: F.conv(h, 16, 10).cast("bigint")
    tag = word(at)
    tagged = tag.isin("58696E67", "496E666F") & (num(word(at + 4)) % 2 == 1)
    xing = F.when(tagged, num(word(at + 8)))
    fixed = F.lit(36)
    vbri_hit = (word(fixed) == "56425249") & (F.substring(hexed, fixed * 2 + 9, F.lit(4)) == "0001")
    frames = F.when(vbri_hit, num(word(fixed + 14))).otherwise(xing)
    frames = F.when(valid, frames)
    spf = F.when(low, 576).otherwise(1152)
    return df.withColumn("frames", frames).withColumn("duration", frames * spf / rate.cast("double"))

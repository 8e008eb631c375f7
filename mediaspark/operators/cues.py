"""Captions and chapters: open ends, control blocks and script files."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.operators.scan import CHUNK_ROWS, following, number_sorted, running


def close_open_cues(chunks: DataFrame, *, key: str = "stream_id", order: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """Cues from caption chunks ``(key, order, start, payload)``.

    A chunk with a time begins a cue, one without goes on with the last cue (and is
    lost ahead of the first).  A cue ends where the next one that starts later
    begins; one arrival closes one cue only, the latest that is open.
    """
    keys = [key]
    marked = running(chunks, keys, order, {"cue_no": ("count", F.when(F.col("start").isNotNull(), 1))}, rows=rows)
    marked = marked.filter("cue_no > 0")
    text = F.array_join(
        # One cue's chunks: a subtitle packet, at most 64 KB.
        F.transform(F.array_sort(F.collect_list(F.struct(order, "payload"))), lambda c: c["payload"]), ""
    )
    cues = marked.groupBy(key, "cue_no").agg(F.max("start").alias("start"), text.alias("payload"))
    return following(cues, keys, "cue_no", {"__next": F.col("start")}, rows=rows).select(
        key, "cue_no", "start", F.when(F.col("__next") > F.col("start"), F.col("__next")).alias("stop"), "payload"
    )


def chapter_ends(chapters: DataFrame, containers: DataFrame, *, key: str = "stream_id", order: str = "chapter_no", rows: int = CHUNK_ROWS) -> DataFrame:
    """A chapter without an end stops at the next start; the last one with the file."""
    out = following(chapters, [key], order, {"__next": F.col("start")}, rows=rows)
    c = containers.select(key, (F.col("start_time") + F.col("duration")).alias("__stop"))
    out = out.join(c, key, "left")
    return out.withColumn("end", F.coalesce("end", "__next", "__stop")).drop("__next", "__stop")


CUE_COMMANDS = "cue_block:int, delay:int, command:int, args:binary"
_ARGS = {3: 2, 4: 2, 5: 6, 6: 4}


def _commands(data: bytes):
    """Control commands of one caption packet, in order; None if it is damaged."""
    if len(data) < 4:
        return None
    size = int.from_bytes(data[0:2], "big")
    start = int.from_bytes(data[2:4], "big")
    if size > len(data) or start > size:
        return None
    found, block, here = [], 0, start
    while True:
        if here + 4 > size:
            return None if block == 0 else found
        delay = int.from_bytes(data[here : here + 2], "big")
        nxt = int.from_bytes(data[here + 2 : here + 4], "big")
        if nxt > size or nxt < start:
            return None
        at = here + 4
        while at < size:
            code = data[at]
            n = _ARGS.get(code, 0)
            if at + n >= size or code > 6:
                break
            found.append((block, delay, code, data[at + 1 : at + 1 + n]))
            at += 1 + n
        if not (at <= nxt and at < size) or nxt <= here:
            return found
        block, here = block + 1, nxt


def cue_commands(cues: DataFrame, *, data: str = "data") -> DataFrame:
    """One row per control command of each caption packet."""

    @F.pandas_udf("array<struct<block:int,delay:int,command:int,args:binary>>")
    def parse(s: pd.Series) -> pd.Series:
        names = ("block", "delay", "command", "args")
        return s.map(lambda b: [dict(zip(names, c)) for c in (_commands(bytes(b)) or [])])

    keep = [c for c in cues.columns if c != data]
    return cues.select(*keep, F.inline_outer(parse(data)))


def cue_controls(cues: DataFrame, *, key: Sequence[str] = ("stream_id", "cue_no"), ticks_per_unit: int = 1024) -> DataFrame:
    """Stop time, forced flag, rectangle and palette of each caption.

    Every command's last occurrence counts; delays are in units of 1024 ticks
    after the start.
    """
    c = cue_commands(cues).withColumn("__n", F.monotonically_increasing_id())
    code = F.col("command")
    b = lambda i: F.conv(F.hex(F.substring("args", i + 1, 1)), 16, 10).cast("int")
    hi = lambda i: F.shiftright(b(i), 4)
    lo = lambda i: b(i).bitwiseAND(F.lit(15))
    order = F.struct("block", "__n")
    last = lambda v, when: F.max_by(v, F.when(when, order))
    four = F.struct(lo(1).alias("c0"), hi(1).alias("c1"), lo(0).alias("c2"), hi(0).alias("c3"))
    rect = F.struct(
        (F.shiftleft(b(0), 4) + hi(1)).alias("left"), (F.shiftleft(lo(1), 8) + b(2) + 1).alias("right"),
        (F.shiftleft(b(3), 4) + hi(4)).alias("top"), (F.shiftleft(lo(4), 8) + b(5) + 1).alias("bottom"),
    )
    g = c.groupBy(*key, "start").agg(
        last(F.col("delay"), code == 2).alias("__d"),
        last(code, code.isin(0, 1)).alias("__f"),
        last(four, code == 3).alias("colors"),
        last(four, code == 4).alias("contrasts"),
        last(rect, code == 5).alias("rect"),
    )
    return g.withColumn("stop", F.col("start") + F.col("__d").cast("bigint") * ticks_per_unit).withColumn(
        "forced", F.coalesce(F.col("__f") == 0, F.lit(False))
    ).drop("__d", "__f")


def caption_events(lines: DataFrame, *, key: str = "file_id", order: str = "line_no", text: str = "line", rows: int = CHUNK_ROWS) -> DataFrame:
    """Dialogue lines of caption scripts, numbered by time.

    The body of ``[Events]`` follows two header lines.  Lines without a time are
    dropped; times are centiseconds.
    """
    head = F.when(F.col(text).startswith("["), F.struct(F.col(text).startswith("[Events]").alias("ev"), F.col(order).alias("at")))
    out = running(lines, [key], order, {"__s": ("last", head)}, rows=rows)
    # The section line and one more are the header.
    body = out.filter(F.col("__s")["ev"] & (F.col(order) > F.col("__s")["at"] + 1))
    pat = r"^[^,]+,\s*([+-]?\d+):\s*([+-]?\d+):\s*([+-]?\d+).([+-]?\d+)"
    body = body.filter(F.col(text).rlike(pat))
    part = lambda i: F.regexp_extract(text, pat, i).cast("bigint")
    body = body.withColumn("pts", ((part(1) * 60 + part(2)) * 60 + part(3)) * 100 + part(4)).drop("__s")
    return number_sorted(body, [key], ["pts", order], "event_no")

"""Folds whose effect can be handed on as a map, so that any number of chunks takes two passes.

A chunk of a stream turns the state it starts with into the one it ends with.  Where that map has a short
description, every chunk works its own out without knowing its start; the maps of a stream are then applied one
after the other, a row per chunk, and a second pass puts the rows out from starts that are known.

* A **counter** moves by rules on how far it is from a place that the row names: below some count it is set,
  within a band it advances, above it stays.  ``counted_map`` follows all possible starts at once, as intervals.
* A **linear filter** has a matrix and an offset (see ``clock_filter``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mediaspark.operators.scan import chunk_id, cut_lineage

#: ``(upto, keeps, add, flag)``: counts up to ``upto`` (None: all others) become ``add``, plus themselves if ``keeps``.
Rule = tuple[int | None, bool, int, bool]
Rules = Callable[[tuple, bool, int], list[Rule]]


def map_stream(
    df: DataFrame, keys: Sequence[str], order: str, inputs: Sequence[str], outputs: str, *, chunk_map: Callable[[dict], object],
    advance: Callable[[list | None, object], list], fold: Callable, rows: int, numbered: bool = False,
) -> DataFrame:
    """Add a fold's output columns along each key, from maps of chunks.

    ``chunk_map(columns)`` describes a chunk, ``advance(state, map)`` applies it, and ``fold(state, columns)`` puts
    a chunk out.  ``numbered`` gives all three the number of rows in earlier chunks as ``__before``.  What a stream
    gathers in one place is a description per chunk, whatever its length.

    A map may leave out states that hardly occur; ``advance`` then gives None, and that chunk alone is folded from
    its start, which costs the stream one more pass over the chunk and the descriptions.
    """
    keys, inputs = list(keys), list(inputs)
    added = T._parse_datatype_string(outputs)
    new = to_arrow_schema(added)
    kept = df.drop(*[f.name for f in added.fields])
    group = [*keys, "__chunk"]
    base = cut_lineage(kept.withColumn("__chunk", chunk_id(order, rows)))
    if numbered:
        w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        counts = base.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
        base = base.join(counts.select(*group, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before")), group)
        inputs.append("__before")
    heads, wanted = [kept.schema[k] for k in keys], kept.columns
    columns = lambda table: {c: table[c].to_pylist() for c in inputs}

    def describe(table: pa.Table) -> pa.Table:
        found = json.dumps(chunk_map(columns(table.sort_by(order))))
        return table.select(group).slice(0, 1).append_column("__map", pa.array([found], pa.string()))

    def follow(table: pa.Table) -> pa.Table:
        table, state, starts, known = table.sort_by("__chunk"), None, [], True
        for found, end in zip(table["__map"].to_pylist(), table["__end"].to_pylist()):
            starts.append(json.dumps(state) if known else None)
            state = json.loads(end) if end else advance(state, json.loads(found)) if known and found else None
            known = known and state is not None
        # The last start that is known, if any is missing, belongs to the chunk whose map doesn't hold it.
        return table.select(group).append_column("__start", pa.array(starts, pa.string()))

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        end = json.dumps(fold(json.loads(table["__start"][0].as_py()), columns(table))[0])
        return table.select(group).slice(0, 1).append_column("__found", pa.array([end], pa.string()))

    def put_out(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        _, out = fold(json.loads(table["__start"][0].as_py()), columns(table))
        table = table.select(wanted)
        for f in new:
            table = table.append_column(f, pa.array(out[f.name], type=f.type))
        return table

    narrow = base.select(*group, *[c for c in dict.fromkeys([order, *inputs]) if c not in group])
    chunks = base.select(*group).distinct()
    # Nobody asks where the last chunk of a stream ends.
    asked = narrow.join(chunks.groupBy(*keys).agg(F.max("__chunk").alias("__last")), keys).where("__chunk < __last").drop("__last")
    text = lambda name: T.StructType([*heads, *T._parse_datatype_string(f"__chunk bigint, {name} string").fields])
    maps = asked.groupBy(*group).applyInArrow(describe, text("__map"))
    maps = chunks.join(maps, group, "left").withColumn("__end", F.lit(None).cast("string"))
    while True:
        starts = cut_lineage(maps.groupBy(*keys).applyInArrow(follow, text("__start")))
        missing = starts.where("__start IS NULL").select(*keys).distinct()
        if missing.isEmpty():
            break
        last = starts.where("__start IS NOT NULL").groupBy(*keys).agg(*[F.max_by(c, "__chunk").alias(c) for c in ("__chunk", "__start")])
        ends = narrow.join(last.join(missing, keys), group).groupBy(*group).applyInArrow(finish, text("__found"))
        maps = cut_lineage(maps.join(ends, group, "left").select(*group, "__map", F.coalesce("__found", "__end").alias("__end")))
    return base.join(starts, group).groupBy(*group).applyInArrow(put_out, T.StructType([*kept.schema.fields, *added.fields]))


def stepped(rules: list[Rule], count: int) -> tuple[int, bool, int]:
    """A count after a row, the flag then, and which rule it met."""
    for i, (upto, keeps, add, flag) in enumerate(rules):
        if upto is None or count <= upto:
            return add + (count if keeps else 0), flag, i
    raise ValueError("the last rule must cover all counts")


def _within(low: int | None, high: int | None, part: int, parts: int) -> tuple[int | None, int | None] | None:
    """The smallest and largest count of an interval that leave ``part`` by ``parts``; None if there is none."""
    low = None if low is None else low + (part - low) % parts
    high = None if high is None else high - (high - part) % parts
    return None if low is not None and high is not None and low > high else (low, high)


def counted_map(rules: Rules, rows: Iterable[tuple], flags: Sequence[bool], parts: int = 1, top: int | None = None) -> list[list]:
    """Where a counter stands after some rows, for every count and flag it may start with.

    Returns pieces ``[part, flag, low, high, keeps, add, flag_then]``: starts from ``low`` to ``high`` (None: without
    end) that leave ``part`` by ``parts`` end at ``add``, plus themselves if ``keeps``.  Starts that meet stay
    together, so the pieces are as many as counts still apart, not as rows.  Starts above ``top`` are left out, but
    for those that are above the band of every row.
    """
    moving = [(None, None, 0, p, f, f) for p in range(parts) for f in flags]
    settled: dict[tuple[int, bool], list] = {}

    def settle(into: dict, value: int, flag: bool, piece: list) -> None:
        there = into.setdefault((value, flag), [])
        last = there[-1] if there else None
        if last and last[:2] == piece[:2] and last[3] is not None and piece[2] is not None and last[3] + parts == piece[2]:
            last[3] = piece[3]
        else:
            there.append(piece)

    for row in rows:
        known: dict[tuple[bool, int], list[Rule]] = {}

        def at(flag: bool, part: int) -> list[Rule]:
            if (flag, part) not in known:
                known[flag, part] = rules(row, flag, part)
            return known[flag, part]

        now: dict[tuple[int, bool], list] = {}
        for (value, flag), pieces in settled.items():
            value, flag, _ = stepped(at(flag, value % parts), value)
            if (value, flag) in now:
                for p in pieces:
                    settle(now, value, flag, p)
            else:
                now[value, flag] = pieces
        still = []
        for low, high, shift, part, start, flag in moving:
            below = low
            for upto, keeps, add, then in at(flag, (part + shift) % parts):
                ceiling = high if upto is None else upto - shift if high is None else min(high, upto - shift)
                if below is not None and ceiling is not None and below > ceiling:
                    continue
                span = _within(below, ceiling, part, parts)
                if span and top is not None and span[1] is not None and span[0] is not None and span[0] > top:
                    span = None
                if span and keeps and not (span[0] is not None and span[0] == span[1]):
                    still.append((*span, shift + add, part, start, then))
                elif span:
                    settle(now, add + (span[0] + shift if keeps else 0), then, [part, start, *span])
                if upto is None or ceiling == high:
                    break
                below = ceiling + 1
        moving, settled = still, now
    out = [[part, start, low, high, True, shift, flag] for low, high, shift, part, start, flag in moving]
    for (value, flag), pieces in settled.items():
        ends: dict[tuple[int, bool], list] = {}
        for piece in sorted(pieces, key=lambda p: (p[2] is not None, p[2] or 0)):
            settle(ends, *piece[:2], piece)
        out += [[*piece, False, value, flag] for found in ends.values() for piece in found]
    return out


def counted_end(pieces: list[list], count: int, flag: bool, parts: int = 1) -> tuple[int, bool] | None:
    """Where a counter ends by a map of ``counted_map``; None if the map leaves that start out."""
    for part, start, low, high, keeps, add, then in pieces:
        if part == count % parts and start == flag and (low is None or low <= count) and (high is None or count <= high):
            return add + (count if keeps else 0), then
    return None


def band(place: float, limit: float, *, open_above: bool = False) -> tuple[int, int]:
    """The counts no further than ``limit`` from a place; ``open_above`` leaves out one exactly that far above."""
    low, high = math.ceil(place - limit), math.floor(place + limit)
    # The bounds are rounded; the differences, which decide, are exact.
    if place - low > limit:
        low += 1
    elif place - low + 1 <= limit:
        low -= 1
    near = (lambda c: c - place < limit) if open_above else (lambda c: c - place <= limit)
    if not near(high):
        high -= 1
    elif near(high + 1):
        high += 1
    return low, high

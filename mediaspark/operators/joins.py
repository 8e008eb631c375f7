"""As-of, interval and table look-up joins over streams.

Neither helper uses a non-equi join: an as-of join is a running "last" over both
sides, and an interval join meets on bins.  No side is broadcast by hint; Spark
does so only when it knows a side to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspark.operators.packets import STREAM
from mediaspark.operators.scan import CHUNK_ROWS, anchored_sum, cut_lineage, following, nearest_two, previous, running

# ------------------------------------------------------------------ helpers


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_on: str,
    right_on: str,
    payload: Sequence[str],
    *,
    direction: str = "backward",
    tie: str | None = None,
    cell: int | None = None,
) -> DataFrame:
    """Add to each left row the nearest right row at or before (or after) it.

    ``payload`` columns of the right side are added, null where there is none.  Of
    right rows with one time the one with the smallest ``tie`` counts.  ``cell`` is
    the span, in ticks, of one group; without it groups are ranges that hold a
    bounded number of rows.  Left rows enter the ordered pass once per
    distinct time, so many requests for one time cost nothing there.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    keys = list(keys)
    back = direction == "backward"
    body = F.struct(*[F.col(c) for c in payload])
    # Without a tie column the smallest payload counts, so that every pass agrees.
    pick = F.min_by(body, F.col(tie)) if tie else F.min(body)
    entries = (
        right.filter(F.col(right_on).isNotNull())
        .groupBy(*keys, F.col(right_on).alias("__t"))
        .agg(pick.alias("__e"))
        .withColumn("__side", F.lit(0 if back else 1))
    )
    points = (
        left.filter(F.col(left_on).isNotNull())
        .select(*keys, F.col(left_on).alias("__t"))
        .distinct()
        .withColumn("__side", F.lit(1 if back else 0))
    )
    both = entries.unionByName(points, allowMissingColumns=True).withColumn(
        "__o", F.col("__t").cast("bigint") * 2 + F.col("__side")
    )
    kind = "last" if back else "first"
    found = running(both, keys, "__o", {"__f": (kind, F.col("__e"))}, reverse=not back, rows=cell and 2 * cell)
    found = found.filter(F.col("__side") == (1 if back else 0)).select(
        *keys, F.col("__t").alias(left_on), *[F.col("__f")[c].alias(c) for c in payload]
    )
    return left.join(found, [*keys, left_on], "left")


def asof_both(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, payload: Sequence[str],
    *, tie: str | None = None, offered: Column | None = None, cell: int | None = None,
) -> DataFrame:
    """Add the nearest right row at or before each left row and the nearest at or after it.

    They come as the structs ``at_or_before`` and ``at_or_after`` of the ``payload``, from one ordered pass over
    both sides.  Right rows that aren't ``offered`` (an expression on them) count only at or before.
    """
    keys = list(keys)
    body = F.struct(*[F.col(c) for c in payload])
    pick = F.min_by(body, F.col(tie)) if tie else F.min(body)
    shown = F.lit(True) if offered is None else offered
    late = F.when(shown, body)
    entries = right.filter(F.col(right_on).isNotNull()).groupBy(*keys, F.col(right_on).alias("__t")).agg(
        pick.alias("__e"), (F.min_by(late, F.when(shown, F.col(tie))) if tie else F.min(late)).alias("__n")
    )
    points = left.filter(F.col(left_on).isNotNull()).select(*keys, F.col(left_on).alias("__t")).distinct()
    both = entries.withColumn("__side", F.lit(0)).unionByName(points.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("__o", F.col("__t").cast("bigint") * 2 + F.col("__side"))
    held = F.when(F.col("__e").isNotNull(), F.struct("__t", "__e", "__n"))
    found = running(both, keys, "__o", {"__back": ("last", held)}, ahead={"__next": ("first", F.col("__n"))}, rows=cell and 2 * cell)
    # An entry at the very time of the point lies on both sides of it.
    here = F.when(F.col("__back.__t") == F.col("__t"), F.col("__back.__n"))
    found = found.filter(F.col("__side") == 1).select(
        *keys, F.col("__t").alias(left_on), F.col("__back.__e").alias("at_or_before"), F.coalesce(here, F.col("__next")).alias("at_or_after")
    )
    return left.join(found, [*keys, left_on], "left")


_LEVEL_BITS = 4
_LEVELS = 12
#: Parts that the points an open span may meet are dealt to; an open span has a row in each.
SALTS = 64


def interval_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    t: str,
    start: str,
    stop: str,
    *,
    bin_width: int = 1024,
    closed: bool = False,
) -> DataFrame:
    """Pairs with ``start <= t < stop`` (``<=`` if closed); a null stop is open.

    A span goes to the level whose bins are about as long as itself, where it
    covers at most 18 bins; a point is looked up once per level in use.  So a very
    long span doesn't meet rows outside of its own reach.  Open spans have no end to
    bin by: the points of their level are dealt to SALTS parts by a hash, so that
    those of a hot key don't meet in one task.
    """
    keys = list(keys)
    length = F.greatest(F.col(stop) - F.col(start), F.lit(1))
    level = F.when(F.col(stop).isNull(), F.lit(_LEVELS)).otherwise(
        F.least(
            F.lit(_LEVELS - 1),
            F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(bin_width)) / _LEVEL_BITS) - 1),
        )
    ).cast("int")
    placed = spans.withColumn("__lv", level)
    # At most 13 distinct values come back.
    used = sorted(r[0] for r in placed.select("__lv").distinct().collect())

    def bin_of(value: Column, lv: Column) -> Column:
        size = F.lit(bin_width).cast("bigint") * F.call_function("shiftleft", F.lit(1).cast("bigint"), lv * _LEVEL_BITS)
        return F.when(lv == _LEVELS, F.lit(0).cast("bigint")).otherwise(
            F.floor(value.cast("decimal(38,0)") / size).cast("bigint")
        )

    last = F.when(F.col(stop).isNull(), F.col(start)).otherwise(F.col(stop))
    bins = F.sequence(bin_of(F.col(start), F.col("__lv")), bin_of(F.greatest(last, F.col(start)), F.col("__lv")))
    parts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    placed = placed.withColumn("__bin", F.explode(F.when(F.col("__lv") == _LEVELS, parts).otherwise(bins)))
    if not used:
        used = [0]
    looked = points.withColumn("__lv", F.explode(F.array(*[F.lit(x) for x in used])))
    dealt = F.pmod(F.xxhash64(t), F.lit(SALTS)).cast("bigint")
    looked = looked.withColumn("__bin", F.when(F.col("__lv") == _LEVELS, dealt).otherwise(bin_of(F.col(t), F.col("__lv"))))
    joined = looked.join(placed, [*keys, "__lv", "__bin"])
    inside = F.col(stop).isNull() | ((F.col(t) <= F.col(stop)) if closed else (F.col(t) < F.col(stop)))
    return joined.filter((F.col(start) <= F.col(t)) & inside).drop("__lv", "__bin")


# ---------------------------------------------------------------- operators


def seek_join(
    requests: DataFrame, index: DataFrame, *, backward: bool = True, any_frame: bool = False,
    keys: Sequence[str] = STREAM, cell: int | None = None,
) -> DataFrame:
    """The index entry a seek lands on (``entry_ts``, ``entry_pos``), or null."""
    usable = index if any_frame else index.filter("is_key")
    usable = usable.withColumn("entry_ts", F.col("ts")).withColumnRenamed("pos", "entry_pos")
    return asof_join(
        requests, usable, keys, "ts", "ts", ["entry_ts", "entry_pos"],
        direction="backward" if backward else "forward", cell=cell,
    )


def seek_window_join(
    requests: DataFrame, index: DataFrame, *, keys: Sequence[str] = STREAM, cell: int | None = None
) -> DataFrame:
    """Seek with bounds: outside [min_ts, max_ts] refused; the wider side is searched."""
    valid = requests.filter((F.col("min_ts") <= F.col("ts")) & (F.col("max_ts") >= F.col("ts")))
    usable = index.filter("is_key").select(*keys, F.col("ts").alias("entry_ts"), F.col("pos").alias("entry_pos"))
    both = asof_both(valid, usable, keys, "ts", "entry_ts", ["entry_ts", "entry_pos"], cell=cell)
    both = both.withColumn("backward", F.col("ts") - F.col("min_ts") > F.col("max_ts") - F.col("ts"))
    entry = F.when(F.col("backward"), F.col("at_or_before")).otherwise(F.col("at_or_after"))
    both = both.withColumns({"entry_ts": entry["entry_ts"], "entry_pos": entry["entry_pos"]})
    return both.drop("at_or_before", "at_or_after")


def active_cues(
    frames: DataFrame, cues: DataFrame, *, subtitles_on: bool = False, keys: Sequence[str] = ("stream_id",),
    bin_width: int = 1024,
) -> DataFrame:
    """Frame and cue pairs with ``start <= t < stop``; forced cues always count."""
    shown = cues if subtitles_on else cues.filter("forced")
    return interval_join(frames, shown, keys, "t", "start", "stop", bin_width=bin_width)


_FAR = (1 << 62) - 1


def frames_needing_overlay(
    frames: DataFrame, cues: DataFrame, highlights: DataFrame | None = None, *, subtitles_on: bool = False,
    slack: int = 0, display_forced: bool = True, anti: bool = False, keys: Sequence[str] = ("stream_id",),
    cell: int | None = None,
) -> DataFrame:
    """Frames during which any cue or highlight is active (or none, with ``anti``).

    Some span covers t exactly when the largest stop among spans starting at or
    before t lies after t, so a running maximum replaces the interval join.
    ``slack`` lets a span begin that much early (the render variant uses 90000 and
    retires a cue whose stop is within the slack).
    """
    keys = list(keys)
    def starts(spans: DataFrame, kind: str) -> DataFrame:
        return spans.select(
            *keys, (F.col("start") - slack).alias("t"), (F.coalesce(F.col("stop"), F.lit(_FAR)) - slack).alias(kind)
        )

    parts = [starts(cues.filter("forced"), "__forced")]
    if subtitles_on:
        parts.append(starts(cues.filter("NOT forced"), "__cue"))
    if highlights is not None:
        parts.append(starts(highlights, "__hi"))
    both = frames.select(*keys, "t").withColumn("__side", F.lit(1))
    for p in parts:
        both = both.unionByName(p, allowMissingColumns=True)
    kinds = ["__forced", "__cue", "__hi"]
    both = both.withColumns({k: F.lit(None).cast("bigint") for k in kinds if k not in both.columns} or {"__forced": F.col("__forced")})
    # One row per time and side: spans that begin together, frames of one time.
    both = both.groupBy(*keys, "t", F.coalesce("__side", F.lit(0)).alias("__side")).agg(*[F.max(k).alias(k) for k in kinds])
    both = both.withColumn("__o", F.col("t") * 2 + F.col("__side"))
    run = running(both, keys, "__o", {k: ("max", F.col(k)) for k in kinds}, rows=cell and 2 * cell).filter("__side = 1")
    out = run.withColumns({k: F.coalesce(F.col(k) > F.col("t"), F.lit(False)) for k in kinds})
    if slack:
        forced_ok = F.lit(subtitles_on or display_forced) | F.col("__hi")
        need = F.col("__cue") | (F.col("__forced") & forced_ok)
    else:
        need = F.col("__cue") | F.col("__forced") | F.col("__hi")
    hits = out.filter(need).select(*keys, "t")
    return frames.join(hits, [*keys, "t"], "left_anti" if anti else "left_semi")


_TOP = 15


def least_cover(points: DataFrame, spans: DataFrame, t: str, start: str, stop: str, value: Column) -> DataFrame:
    """``(t, __least)``: the least ``value`` among the spans that cover each point (both ends count, a null stop is open).

    A span is taken apart into the largest blocks of 16 to the power of 0 to 15 that it fills, at most 30 a size;
    each block keeps the least value of its spans, whatever their number, and a point asks the one block of each
    size that it lies in.  Spans and points never meet as pairs.  Values of ``t`` lie in 0 to 2^62.
    """
    end = F.coalesce(F.col(stop), F.lit((1 << 62) - 1)).cast("bigint")
    div = lambda a, b: F.call_function("div", a, b).cast("bigint")
    lv, one = F.col("__lv"), F.lit(1).cast("bigint")
    placed = spans.where(F.col(start).isNotNull()).select(F.col(start).cast("bigint").alias("__a"), end.alias("__b"), value.alias("__value")).where("__a <= __b")
    levels = F.explode(F.sequence(F.lit(0), F.lit(_TOP)))
    placed = placed.withColumn("__lv", levels).withColumn("__size", F.call_function("shiftleft", one, lv * _LEVEL_BITS))
    low, high = div(F.col("__a") + F.col("__size") - 1, F.col("__size")), div(F.col("__b") + 1, F.col("__size")) - 1
    placed = placed.withColumns({"__low": low, "__high": high}).where("__low <= __high")
    # Blocks of a larger block that is filled as a whole are left to it.
    wide = F.col("__size") * 16
    inner = F.when(lv < _TOP, div(F.col("__a") + wide - 1, wide)), F.when(lv < _TOP, div(F.col("__b") + 1, wide) - 1)
    larger = F.coalesce(inner[0] <= inner[1], F.lit(False))
    rows = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    left = rows(F.col("__low"), F.when(larger, inner[0] * 16 - 1).otherwise(F.col("__high")))
    right = F.when(larger, rows(inner[1] * 16 + 16, F.col("__high"))).otherwise(F.array().cast("array<bigint>"))
    blocks = placed.select("__lv", "__value", F.explode(F.concat(left, right)).alias("__block"))
    blocks = blocks.groupBy("__lv", "__block").agg(F.min("__value").alias("__value"))
    asked = points.select(t).distinct().withColumn("__lv", levels)
    asked = asked.withColumn("__block", F.expr(f"shiftright(CAST(`{t}` AS BIGINT), __lv * {_LEVEL_BITS})"))
    return asked.join(blocks, ["__lv", "__block"], "left").groupBy(t).agg(F.min("__value").alias("__least"))


#: Consecutive addresses that are handled as one group, each at most once.
ADDRESSES = 1 << 17


def acl_check(conns: DataFrame, acl: DataFrame, *, cell: int = ADDRESSES) -> DataFrame:
    """First matching address range decides; else the opposite of the last rule.

    The rules cut the addresses into stretches with one verdict each: the first rule over the stretch's beginning.
    An address takes the verdict of the stretch it lies in by an as-of join, so a rule over all addresses, or an
    open one, brings no address onto a common key.  Each distinct address is checked once.  An empty list allows
    everything; a null address gets the default.
    """
    ends = F.array(F.col("first_addr").cast("bigint"), F.col("last_addr").cast("bigint") + 1)
    bounds = acl.select(F.explode(ends).alias("at")).where("at IS NOT NULL").distinct()
    stretches = least_cover(bounds, acl, "at", "first_addr", "last_addr", F.struct("rule_no", "allow"))
    stretches = stretches.select("at", F.col("__least.allow").alias("__v"))
    verdict = asof_join(conns.select("src_addr").distinct(), stretches, [], "src_addr", "at", ["__v"], cell=cell)
    default = acl.agg(F.coalesce(~F.max_by("allow", "rule_no"), F.lit(True)).alias("__d"))
    # ``default`` is one row.
    d = default.select(F.struct("__d").alias("s")).withColumn("__k", F.lit(0))
    out = conns.join(verdict, "src_addr", "left").withColumn("__k", F.lit(0)).join(F.broadcast(d), "__k")
    return out.withColumn("allowed", F.coalesce("__v", F.col("s")["__d"])).drop("__v", "__k", "s")


def nearest_rate(df: DataFrame, rates: Sequence[tuple[int, int]], *, num: str = "num", den: str = "den") -> DataFrame:
    """Nearest rational of a list by exact comparison; a tie keeps the earlier one."""
    wide = lambda c: c.cast("decimal(18,0)")
    best = None
    arr = F.array(
        *[F.struct(F.lit(n).cast("bigint").alias("n"), F.lit(d).cast("bigint").alias("d"), F.lit(i).alias("i"))
          for i, (n, d) in enumerate(rates)]
    )
    gap = lambda r: F.abs(wide(F.col(num)) * wide(r["d"]) - wide(r["n"]) * wide(F.col(den))).cast("decimal(20,0)")
    best = F.aggregate(
        F.slice(arr, 2, max(len(rates) - 1, 1)) if len(rates) > 1 else F.slice(arr, 1, 0),
        F.get(arr, F.lit(0)),
        lambda b, r: F.when(gap(r) * wide(b["d"]) < gap(b) * wide(r["d"]), r).otherwise(b),
    )
    out = df.withColumn("__b", best)
    return out.withColumn("rate_idx", F.col("__b")["i"]).withColumn("rate_num", F.col("__b")["n"]).withColumn(
        "rate_den", F.col("__b")["d"]
    ).drop("__b")


def probe_format(
    files: DataFrame, rules: Sequence[tuple[str, int, Column]], *, extension_score: int = 50,
    extensions: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Best scoring format per file; a tie at the top gives no answer.

    ``rules`` are (format, score, predicate) content tests; ``extensions`` are
    formats known by file name only.
    """
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    scored = [(n, F.when(F.coalesce(p, F.lit(False)), s).otherwise(0)) for n, s, p in rules]
    scored += [
        (n, F.when(ext.isin([e.lower() for e in es]), extension_score).otherwise(0))
        for n, es in (extensions or {}).items()
    ]
    cand = F.array(*[F.struct(s.alias("s"), F.lit(n).alias("n")) for n, s in scored])
    top = F.array_max(cand)
    ties = F.size(F.filter(cand, lambda c: c["s"] == top["s"]))
    ok = (top["s"] > 0) & (ties == 1)
    return files.withColumn("format", F.when(ok, top["n"])).withColumn("score", F.when(ok, top["s"]).cast("int"))


def tag_lookup(df: DataFrame, table: DataFrame, *, tag: str = "tag") -> DataFrame:
    """Codec id of a tag: exact match first, then ignoring case; first entry wins."""
    exact = table.groupBy(F.col("tag").alias("__t")).agg(F.min_by("id", "ord").alias("__exact"))
    folded = table.groupBy(F.upper("tag").alias("__u")).agg(F.min_by("id", "ord").alias("__folded"))
    out = df.join(exact, F.col(tag) == F.col("__t"), "left").join(folded, F.upper(tag) == F.col("__u"), "left")
    return out.withColumn("id", F.coalesce("__exact", "__folded")).drop("__t", "__u", "__exact", "__folded")


def pick_rendition(
    requests: DataFrame, ladder: DataFrame, keys: Sequence[str], *, ceiling: int | None = None, cell: int | None = None
) -> DataFrame:
    """Fastest rendition at or below ``target``, else the slowest above it.

    With a ``ceiling``, renditions at or beyond it aren't offered in place of a
    slower target.
    """
    offered = None if ceiling is None else F.col("bit_rate") < ceiling
    steps = ladder.select(*keys, "bit_rate", "rendition", F.col("bit_rate").alias("__r"))
    both = asof_both(requests, steps, keys, "target", "__r", ["bit_rate", "rendition"], tie="rendition", offered=offered, cell=cell)
    chosen = F.coalesce("at_or_before", "at_or_after")
    both = both.withColumns({"rendition": chosen["rendition"], "bit_rate": chosen["bit_rate"]})
    return both.drop("at_or_before", "at_or_after")


def align_pair(a: DataFrame, b: DataFrame, keys: Sequence[str], pos: str, value: str, *, shift: int = 0, skip: int = 0) -> DataFrame:
    """Pair element ``i`` of one stream with element ``i + shift`` of another."""
    left = a.filter(F.col(pos) >= skip).select(*keys, F.col(pos).alias("pos"), F.col(value).alias("a"))
    right = b.select(*keys, (F.col(pos) - shift).alias("pos"), F.col(value).alias("b"))
    return left.join(right, [*keys, "pos"])


def diff_golden(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that are missing, extra or different against an expected result."""
    a = actual.select(*keys, F.struct(F.col(value).alias("v")).alias("__a"))
    e = expected.select(*keys, F.struct(F.col(value).alias("v")).alias("__e"))
    j = a.join(e, list(keys), "full_outer")
    status = (
        F.when(F.col("__a").isNull(), "missing")
        .when(F.col("__e").isNull(), "extra")
        .when(~F.col("__a")["v"].eqNullSafe(F.col("__e")["v"]), "differs")
    )
    return j.select(*keys, status.alias("status"), F.col("__a")["v"].alias("actual"), F.col("__e")["v"].alias("expected")).filter(
        "status IS NOT NULL"
    )


def interpolate_pcr(
    packets: DataFrame, *, keys: Sequence[str] = (), order: str = "packet_no", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Clock of every packet from the clock references around it.

    The step between two references is their difference over the packets between;
    after the last reference the previous step goes on, before the first one the
    first step runs backwards.
    """
    out = nearest_two(packets, keys, order, F.col("pcr"), before="__b", after="__a", rows=rows)
    b, a = (lambda i: F.get("__b", F.lit(i))), (lambda i: F.get("__a", F.lit(i)))
    # The references that the step is taken from: those around the packet, else the two nearest.
    low = F.when(F.size("__b") == 0, a(0)).when(F.size("__a") > 0, b(0)).otherwise(b(1))
    high = F.when(F.size("__b") == 0, a(1)).when(F.size("__a") > 0, a(0)).otherwise(b(0))
    out = out.withColumns({"__low": low, "__high": high, "__r": F.coalesce(b(0), a(0))})
    step = F.call_function("div", F.col("__high.v") - F.col("__low.v"), F.col("__high.o") - F.col("__low.o"))
    out = out.withColumn("step", step)
    out = out.withColumn("clock", F.col("__r.v") + F.col("step") * (F.col(order) - F.col("__r.o")))
    out = out.withColumn("bit_rate", F.floor(F.try_divide(F.lit(188 * 8 * 27e6), F.col("step"))))
    return out.drop("__b", "__a", "__low", "__high", "__r")


def copy_metadata(outputs: DataFrame, inputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Output tags with the tags of a mapped input laid over them."""
    src = inputs.select(F.col("stream_id").alias("in_id"), F.col("tags").alias("__tags"))
    j = outputs.join(mapping, F.col("stream_id") == F.col("out_id"), "left").drop("out_id").join(src, "in_id", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.coalesce("tags", empty)
    new = F.coalesce("__tags", empty)
    kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return j.withColumn("tags", F.map_concat(kept, new)).drop("__tags", "in_id")


def build_sample_table(
    stsz: DataFrame, stts: DataFrame, stsc: DataFrame, stco: DataFrame, stss: DataFrame, ctts: DataFrame | None = None,
    *, key: str = "stream_id", rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Packet table from the run-length side tables of a file.

    Inputs: ``stsz(key, sample_no, size)`` from 0, ``stts(key, run_no, count,
    duration)``, ``stsc(key, first_chunk, count)``, ``stco(key, chunk_no, offset)``
    from 1, ``stss(key, sample)``, ``ctts(key, run_no, count, offset)``.  Runs are
    never expanded: a run lands on its first sample and is carried forward.

    Samples and what lands on them are one list of narrow rows, dealt once by key and range of samples and
    read in order there; samples join nothing.  Only streams longer than a range hand something on.
    """
    k = [key]

    def by_first_sample(runs: DataFrame, total: Column, value: Column) -> DataFrame:
        r = runs.filter("count > 0")
        r = running(
            r, k, "run_no",
            {"__start": ("sum", F.col("count").cast("bigint")), "__done": ("sum", total)},
            include_current=False, rows=rows,
        )
        return r.select(
            key, F.coalesce("__start", F.lit(0)).alias("sample_no"), F.coalesce("__done", F.lit(0)).alias("done"), value.cast("bigint").alias("value"),
        )

    # Samples ahead of a chunk: those of earlier runs plus the chunks since the run began.
    per = F.col("count").cast("bigint")
    runs = following(stsc, k, "first_chunk", {"__next": F.col("first_chunk")}, rows=rows)
    runs = anchored_sum(runs, k, "first_chunk", "__done", F.lit(None).cast("bigint"), (F.col("__next") - F.col("first_chunk")) * per, rows=rows)
    heads = runs.select(
        key, (F.col("first_chunk") * 2).alias("__o"),
        F.struct(F.col("first_chunk").alias("c"), per.alias("n"), F.col("__done").alias("d")).alias("__sc"),
    )
    # A run stands ahead of its first chunk in one list with the chunks, so that they join nothing either.
    listed = stco.select(key, (F.col("chunk_no") * 2 + 1).alias("__o"), "chunk_no", "offset")
    chunks = running(listed.unionByName(heads, allowMissingColumns=True), k, "__o", {"__in": ("last", F.col("__sc"))}, rows=2 * rows)
    sc = F.col("__in")
    chunks = chunks.filter("chunk_no IS NOT NULL").select(
        key, "offset", sc["n"].alias("__per"), (sc["d"] + (F.col("chunk_no") - sc["c"]) * sc["n"]).alias("sample_no")
    )
    # An empty chunk shares its first sample with the next one, which must win.
    chunks = cut_lineage(chunks.filter("__per > 0"))
    one_based = stss.groupBy(key).agg((F.min("sample") == 1).alias("__one"))
    marks = stss.join(one_based, key).select(
        key, (F.col("sample") - F.when(F.col("__one"), 1).otherwise(0)).alias("sample_no")
    )
    # Every range of a stream with samples in chunks: how many those are, and whether there is a key list.
    total = chunks.groupBy(key).agg(F.max(F.col("sample_no") + F.col("__per")).alias("__total")).join(one_based, key, "left")
    total = cut_lineage(
        total.select(key, "__total", F.col("__one").isNotNull().cast("bigint").alias("__listed"), F.explode(F.expr(f"sequence(0L, (__total - 1) div {rows})")).alias("__range"))
    )
    times = by_first_sample(stts, F.col("count").cast("bigint") * F.col("duration"), F.col("duration"))

    # What lands on a sample comes ahead of it; ``a`` and ``b`` mean what the kind says.
    bound, head, time, comp, mark, sample = range(6)

    def landed(df: DataFrame, kind: int, a: Column, b: Column | None = None) -> DataFrame:
        return df.filter("sample_no >= 0").select(
            key, (F.col("sample_no").cast("bigint") * 8 + kind).alias("__o"), a.cast("bigint").alias("a"),
            (F.lit(None) if b is None else b).cast("bigint").alias("b"),
        )

    parts = [
        landed(total.withColumn("sample_no", F.col("__range") * rows), bound, F.col("__total") * 2 + F.col("__listed")),
        landed(chunks, head, F.col("offset")),
        landed(times, time, F.col("done"), F.col("value")),
        landed(marks, mark, F.lit(None)),
        landed(stsz, sample, F.col("size")),
    ]
    if ctts is not None:
        parts.append(landed(by_first_sample(ctts, F.lit(0).cast("bigint"), F.col("offset")), comp, F.coalesce("value", F.lit(0))))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.withColumn("__range", F.expr(f"__o div {8 * rows}"))
    # Both readers below see the same filter, so that they share one shuffle.
    every = every.filter(F.col(key).isNotNull() & F.col("__range").isNotNull()).repartition(key, "__range")

    w = Window.partitionBy(key, "__range").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    no, of = F.shiftright("__o", 3), lambda kind, v: F.when(F.col("__o").bitwiseAND(7) == kind, v)
    latest = lambda v: F.last(v, ignorenulls=True).over(w)

    def in_range(df: DataFrame) -> DataFrame:
        df = df.withColumns({
            "__sum": F.coalesce(F.sum(of(sample, F.col("a"))).over(w), F.lit(0)),
            "__bound": latest(of(bound, F.col("a"))),
            # A run of unknown duration counts too: its samples have no time.
            "__timed": latest(of(time, F.col("b").isNotNull())),
            "__zero": latest(of(time, F.col("a") - no * F.coalesce("b", F.lit(0)))),
            "__step": latest(of(time, F.coalesce("b", F.lit(0)))),
            "__last": latest(of(mark, no)),
            "__c": latest(of(comp, F.col("a"))),
        })
        return df.withColumn("__base", latest(of(head, F.col("a") - F.col("__sum"))))

    # A range with a later one hands on what holds at its end; offsets are less the bytes of all samples ahead.
    more = total.filter((F.col("__range") + 1) * rows < F.col("__total")).select(key, "__range")
    held = ["__timed", "__zero", "__step", "__last", "__c"]
    ends = in_range(every.join(more, [key, "__range"])).groupBy(key, "__range").agg(
        F.max_by(F.struct("__sum", "__base", *held), "__o").alias("__end")
    ).select(key, "__range", "__end.*")
    along = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("__all", F.sum("__sum").over(along))
    ends = ends.withColumn("__base", F.last(F.col("__base") - F.col("__all") + F.col("__sum"), ignorenulls=True).over(along) + F.col("__all"))
    carry = ends.select(
        key, (F.col("__range") + 1).alias("__range"), F.col("__base").alias("__base0"),
        *[F.last(c, ignorenulls=True).over(along).alias(f"{c}0") for c in held],
    )

    s = in_range(every).filter(F.col("__o").bitwiseAND(7) == sample).filter(no < F.shiftright("__bound", 1))
    s = s.join(carry, [key, "__range"], "left")
    s = s.withColumns({c: F.coalesce(c, f"{c}0") for c in ["__base", *held]}).withColumn("sample_no", no)
    dts = F.when(F.col("__timed"), F.col("__zero") + F.col("sample_no") * F.col("__step"))
    pts = dts + F.coalesce("__c", F.lit(0))
    unlisted = F.col("__bound").bitwiseAND(1) == 0
    is_key = unlisted | F.coalesce(F.col("__last") == F.col("sample_no"), F.lit(False))
    last = F.when(unlisted, F.col("sample_no")).otherwise(F.coalesce("__last", F.lit(0)))
    return s.select(
        key, F.col("sample_no").cast(stsz.schema["sample_no"].dataType).alias("sample_no"),
        (F.col("__base") + F.col("__sum") - F.coalesce("a", F.lit(0))).alias("pos"), dts.alias("dts"), pts.alias("pts"),
        F.when(F.col("__timed"), F.col("__step")).alias("duration"), F.col("a").cast(stsz.schema["size"].dataType).alias("size"), is_key.alias("is_key"),
        (F.col("sample_no") - last).alias("min_distance"),
    )


def retime(
    frames: DataFrame, rates: DataFrame, *, avg_time: int = 400000, delay: int = 0, smooth_film: bool = False,
    key: str = "stream_id", cell: int | None = None,
) -> DataFrame:
    """Play times after rate changes: ``anchor + (t - anchor) * |rate| / 10000``.

    A change takes effect at the first frame at or after its time, and that frame
    is the anchor.  Half a frame is taken from film pictures of three fields when
    smoothing.  ``rates`` has ``(key, change_ts, rate)``.
    """
    r = rates.withColumn("change", F.col("change_ts"))
    out = asof_join(frames, r, [key], "rt_start", "change_ts", ["change", "rate"], cell=cell)
    anchors = out.groupBy(key, "change").agg(F.min("rt_start").alias("__a"))
    anchors = anchors.withColumn("__a", F.when(F.col("change").isNotNull(), F.col("__a")).otherwise(0))
    anchors = anchors.withColumnRenamed(key, "__k").withColumnRenamed("change", "__ch")
    out = out.join(anchors, (F.col(key) == F.col("__k")) & F.col("change").eqNullSafe(F.col("__ch"))).drop("__k", "__ch")
    speed = F.abs(F.coalesce("rate", F.lit(10000))).cast("bigint")
    at = lambda c: F.col("__a") + F.call_function("div", (c - F.col("__a")) * speed, F.lit(10000))
    stop = at(F.col("rt_stop"))
    if smooth_film:
        half = F.call_function("div", F.lit(avg_time // 2) * speed, F.lit(10000))
        stop = F.when(F.col("film") & (F.col("nb_fields") == 3), stop - half).otherwise(stop)
    return out.withColumn("out_start", at(F.col("rt_start"))).withColumn("out_stop", stop + delay * 10000).drop("__a", "change", "rate")


def overlay(
    lines: DataFrame, overlays: DataFrame, palette: Sequence[tuple[int, int]], *,
    clip: tuple[int, int, int, int] | None = None,
    highlight: tuple[int, int, int, int] | None = None,
    highlight_palette: Sequence[tuple[int, int]] | None = None,
    keys: Sequence[str] = ("stream_id", "frame_no", "plane", "line_no"),
) -> DataFrame:
    """Blend colour codes over lines: ``p - ((p - colour) * contrast >> 4)``.

    ``overlays`` has the line keys and ``codes`` (0-3 per pixel, null for none).
    ``palette`` maps a code to (colour, contrast); contrast 0 leaves the pixel.
    Rectangles are (left, top, right, bottom); the clip excludes right and bottom,
    the highlight includes its bottom row, and inside it the second palette counts.
    """
    def table(p):
        return F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).alias("k")) for c, k in p])

    y = F.col(keys[-1])

    def blend(p: Column, code: Column, x: Column) -> Column:
        entry = F.get(table(palette), code)
        if highlight is not None:
            l, t, r, b = highlight
            inside = (y >= t) & (y <= b) & (x >= l) & (x < r)
            entry = F.when(inside, F.get(table(highlight_palette), code)).otherwise(entry)
        mixed = p - F.shiftright((p - entry["c"]) * entry["k"], 4)
        drawn = code.isNotNull()
        if clip is not None:
            l, t, r, b = clip
            drawn = drawn & (y >= t) & (y < b) & (x >= l) & (x < r)
        return F.when(drawn, mixed).otherwise(p)

    j = lines.join(overlays, list(keys), "left")
    # One pass over the positions keeps pixel, code and index together.
    idx = F.sequence(F.lit(0), F.size("px") - 1)
    done = F.transform(idx, lambda i: blend(F.get("px", i), F.get("codes", i), i))
    return j.withColumn("px", F.when(F.col("codes").isNotNull(), done).otherwise(F.col("px"))).drop("codes")

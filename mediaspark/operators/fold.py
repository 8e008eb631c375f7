"""Operators whose next row depends on the state left by the row before.

``fold_stream`` runs such a fold over streams of any length without giving a whole
stream to one task.  A long stream is cut into chunks.  All its chunks are folded at once,
each from a guessed state; the end state of a chunk is then handed to its
successor, and only chunks whose start turned out different are folded again, until
none is.  The result is that of one pass from the beginning.  A fold that forgets its
start (resets, clamps, decay) settles in one or two rounds.  Totals don't belong in a
state, as they never forget: they are running sums over what the fold puts out (see
``rtp_sequence``).  The rate conversions and the clock filter, which carry an absolute count
or clock, hand on maps instead (see ``maps``).

A fold is ``fold(state, columns) -> (state, outputs)`` over lists of one chunk's
values in order; ``state`` is a list of numbers, strings and booleans or None at the
start.  The streaming versions use the same folds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mediaspark.operators.maps import Rule, Rules, band, counted_end, counted_map, map_stream, stepped
from mediaspark.operators.scan import cut_lineage, running

FOLD_ROWS = 1 << 17

Fold = Callable[[list | None, dict[str, list]], tuple[list, dict[str, list]]]


def _folded(
    batches: Iterable[pa.RecordBatch], group: Sequence[str], inputs: Sequence[str], fold: Fold, rows: int
) -> Iterator[tuple[pa.RecordBatch | None, dict[str, list], list[tuple]]]:
    """Fold groups whose rows come together and in order: each batch, its outputs, and the groups that ended ahead of its end.

    A batch may hold many groups and a group may take many batches; the state goes from one batch to the next.  A
    group that ended is its key, the start it used and its end as JSON.  The last ones come without a batch.
    """
    key = used = state = None
    ended: list[tuple] = []
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            # NaN as a key is one group, as it is to Spark: the same object is equal in a tuple.
            names = [[math.nan if v != v else v for v in batch[c].to_pylist()] for c in group]
            names = list(zip(*names))
            values = {c: batch[c].to_pylist() for c in inputs}
            starts = batch["__start"].to_pylist() if "__start" in batch.schema.names else None
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            out: dict[str, list] = {}
            for a, b in zip(cuts, cuts[1:]):
                if names[a] != key:
                    if key is not None:
                        ended.append((*key, used, json.dumps(state)))
                    key, used = names[a], starts[a] if starts else None
                    state = json.loads(used) if used else None
                state, got = fold(state, {c: v[a:b] for c, v in values.items()})
                for name, v in got.items():
                    out.setdefault(name, []).extend(v)
            yield batch, out, ended
            ended = []
    if key is not None:
        ended.append((*key, used, json.dumps(state)))
    yield None, {}, ended


#: Rows that show where long streams are cut, and the most cuts they give.
CUT_SAMPLE = 1 << 13
MOST_CUTS = 512


def _cuts(df: DataFrame, keys: Sequence[str], order: str, rows: int) -> DataFrame | None:
    """``(keys, __cuts)``: where streams of more than about ``rows`` rows are cut; None if there are none.

    The rows with the smallest hashes of (keys, order) show how the others are spread, and the largest of these hashes
    how many there are.  Only the size of the chunks depends on them.
    """
    drawn = df.select(*keys, F.col(order).cast("bigint").alias("__at"), F.xxhash64(*keys, order).alias("__h")).orderBy("__h").limit(CUT_SAMPLE)
    streams = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("__at")).alias("__cuts"), F.max("__h").alias("__h")).collect()
    count, step = sum(len(r["__cuts"]) for r in streams), rows
    if count >= CUT_SAMPLE:
        share = (max(r["__h"] for r in streams) + (1 << 63) + 1) / (1 << 64)
        step = max(math.ceil(rows * share), CUT_SAMPLE // MOST_CUTS)
    long = [(*[r[k] for k in keys], sorted(set(r["__cuts"][step::step]))) for r in streams if len(r["__cuts"]) > step]
    cuts = T.StructType([*[df.schema[k] for k in keys], T.StructField("__cuts", T.ArrayType(T.LongType()))])
    return F.broadcast(df.sparkSession.createDataFrame(long, cuts)) if long else None


def _plain(df: DataFrame) -> bool:
    """Whether reading a frame again costs a scan of files and gives the same rows."""

    def nodes(plan) -> Iterator[str]:
        yield plan.nodeName()
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.deterministic() and {*nodes(plan)} <= {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation", "Range"}


def fold_stream(
    df: DataFrame, keys: Sequence[str], order: str, inputs: Sequence[str], fold: Fold, outputs: str, *, rows: int = FOLD_ROWS
) -> DataFrame:
    """Run ``fold`` along each key and add its output columns.

    Rows go through Arrow as they are, so integers keep all their bits and nulls
    stay nulls.  They come sorted, by batches: short streams share one, and a chunk is never held whole.  A fold must
    give the same in one call as in several.

    Only streams of more than about ``rows`` rows are cut, whatever the unit of ``order`` and its gaps, and only these are
    folded ahead for the states that chunks start from.  All rows are shuffled once; files are read anew for each pass, and
    other inputs written down.
    """
    keys = list(keys)
    added = T._parse_datatype_string(outputs)
    new = to_arrow_schema(added)
    kept = df.drop(*[f.name for f in added.fields])
    schema = T.StructType([*kept.schema.fields, *added.fields])
    columns = kept.columns

    base = kept.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, order]))
    if not _plain(base):
        base = cut_lineage(base)
    cuts = _cuts(base, keys, order, rows)
    group = [*keys, "__chunk"] if cuts is not None else keys

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out, _ in _folded(batches, group, inputs, fold, rows):
            if batch is not None:
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in columns], *[pa.array(out.get(f.name, []), type=f.type) for f in new]], [*columns, *new.names]
                )

    def in_order(frame: DataFrame) -> DataFrame:
        return frame.repartition(*group).sortWithinPartitions(*group, order)

    if cuts is None:
        return in_order(base).mapInArrow(emit, schema)

    ends_schema = T.StructType([*[kept.schema[k] for k in keys], *T._parse_datatype_string("__chunk bigint, __used string, __end string").fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = to_arrow_schema(ends_schema)
        for _, _, ended in _folded(batches, group, inputs, fold, rows):
            if ended:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*ended), heads)], schema=heads)

    passed = F.array_size(F.filter("__cuts", lambda c: c <= F.col(order).cast("bigint")))
    chunk = F.coalesce(passed, F.lit(0)).cast("bigint")
    wanted = [c for c in dict.fromkeys([order, *inputs]) if c not in keys]
    narrow = base.select(*keys, *wanted).join(cuts, keys).select(*keys, chunk.alias("__chunk"), *wanted)
    ends = cut_lineage(in_order(narrow).mapInArrow(finish, ends_schema))
    w = Window.partitionBy(*keys).orderBy("__chunk")
    while True:
        linked = ends.withColumn("__start", F.lag("__end").over(w))
        stale = linked.filter(~F.col("__start").eqNullSafe(F.col("__used"))).select(*group, "__start")
        if stale.isEmpty():
            break
        redone = in_order(narrow.join(F.broadcast(stale), group)).mapInArrow(finish, ends_schema)
        redone = redone.select(*group, F.col("__used").alias("__u"), F.col("__end").alias("__e"))
        ends = cut_lineage(
            ends.join(redone, group, "left").select(
                *group,
                F.when(F.col("__e").isNotNull(), F.col("__u")).otherwise(F.col("__used")).alias("__used"),
                F.coalesce("__e", "__end").alias("__end"),
            )
        )
    final = base.join(cuts, keys, "left").withColumn("__chunk", chunk).join(F.broadcast(linked.select(*group, "__start")), group, "left")
    return in_order(final.select(*columns, "__chunk", "__start")).mapInArrow(emit, schema)


# -------------------------------------------------------------------- folds


def reorder_fold(delay: int) -> Fold:
    """Decode times: hold ``delay + 1`` presentation times, release the smallest."""

    def fold(state, cols):
        held = list(state) if state is not None else None
        out = []
        for pts, dur in zip(cols["pts"], cols["duration"]):
            if pts is None:
                out.append(None)
                continue
            if held is None:
                # Ahead of the first packet stand made-up ones, one duration apart.
                held = [pts + (i - delay - 1) * (dur or 0) for i in range(1, delay + 1)]
            else:
                held = held[1:]
            held = sorted([*held, pts])
            out.append(held[0])
        return held, {"dts_out": out}

    return fold


def dts_from_pts(df: DataFrame, delay: int, *, keys=("stream_id", "stream_index"), order: str = "seq", rows: int = FOLD_ROWS) -> DataFrame:
    """Decode times of a stream with up to ``delay`` reordered pictures (at most 16)."""
    if not 0 <= delay <= 16:
        raise ValueError("delay must be between 0 and 16")
    return fold_stream(df, keys, order, ["pts", "duration"], reorder_fold(delay), "dts_out bigint", rows=rows)


def _video_rules(fps: float, method: str) -> Rules:
    """What a picture due at a place of the output does to the count of pictures put out.

    passthrough sets the count to the place; cfr repeats a picture up to its place when it is late, shows it once
    within 1.1 of it and drops it beyond; vfr moves a late picture to its place, and shows it if less than 0.6
    ahead (fixed values, in pictures).
    """

    def rules(row: tuple, flag: bool, odd: int) -> list[Rule]:
        if row[0] is None:
            return [(None, True, 1, flag)]
        place = row[0] / 1e6 * fps
        if method == "passthrough":
            return [(None, False, round(place) + 1, flag)]
        low, high = band(place, 1.1) if method == "cfr" else band(place, 0.6, open_above=True)
        due = round(place) + 1
        if method == "cfr":
            due = round(place)
            if place % 1 == 0.5:
                # The repeats are rounded to even, so the count that is met keeps its parity.
                due = math.floor(place) + (math.floor(place) + odd) % 2
        return [(low - 1, False, due, flag), (high, True, 1, flag), (None, True, 0, flag)]

    return rules


VIDEO_SYNC = ("cfr", "passthrough", "vfr")


def video_sync_fold(fps: float, method: str) -> Fold:
    rules = _video_rules(fps, method)

    def fold(state, cols):
        count = state[0] if state else 0
        nb, at = [], []
        for t in cols["pts"]:
            met, _, kind = stepped(rules((t,), False, count % 2), count)
            shown = met - count if method == "cfr" else int(kind < 2)
            count = met
            nb.append(shown)
            at.append(count - shown)
        return [count], {"nb_frames": nb, "out_no": at}

    return fold


def video_sync(
    df: DataFrame, *, fps: float, method: str = "cfr", keys=("stream_id", "stream_index"), order: str = "seq", rows: int = FOLD_ROWS
) -> DataFrame:
    """How often each picture is shown at a fixed rate: 0 dropped, >1 duplicated.

    Two passes at any length: a chunk's effect on the count of pictures is a map of few pieces.
    """
    if method not in VIDEO_SYNC:
        raise ValueError(f"method must be one of {VIDEO_SYNC}")
    rules = _video_rules(fps, method)
    return map_stream(
        df, keys, order, ["pts"], "nb_frames int, out_no bigint", rows=rows, fold=video_sync_fold(fps, method),
        chunk_map=lambda cols: counted_map(rules, zip(cols["pts"]), [False], 2),
        advance=lambda state, pieces: [counted_end(pieces, state[0] if state else 0, False, 2)[0]],
    )


def output_frames(synced: DataFrame) -> DataFrame:
    """One row per picture put out."""
    shown = synced.filter("nb_frames > 0")
    return shown.withColumn("out_no", F.explode(F.sequence(F.col("out_no"), F.col("out_no") + F.col("nb_frames") - 1)))


#: Samples a packet may be off the clock without any correction (fixed value).
SLACK = 50


def _audio_rules(rate: int, drift: float) -> Rules:
    """What a packet does to the count of samples put out, by its lead over the ideal clock.

    A packet ahead of the count by more than the tolerance is led in by silence, so that the count stands at its
    place before it; one behind loses the samples that are past, all of them if need be; others are put out as
    they are.  Until the first correction that leaves samples over, the tolerance is the slack alone.
    """

    def rules(row: tuple, starting: bool, part: int) -> list[Rule]:
        t, size = row
        if t is None:
            return [(None, True, size, starting)]
        place = t / 1e6 * rate
        low, high = band(place, SLACK if starting else max(SLACK, drift * rate))
        after = starting and size <= 0
        past = max(high, math.ceil(place) + size - 1)
        return [
            (low - 1, False, math.floor(place) + size, after), (high, True, size, starting),
            (past, False, math.ceil(place) + size, after), (None, True, 0, starting),
        ]

    return rules


def audio_sync_fold(rate: int, drift: float, method: int) -> Fold:
    rules = _audio_rules(rate, drift)

    def fold(state, cols):
        count, starting = state if state else (0, True)
        out = {"dropped": [], "silence": [], "compensation": [], "out_samples": []}
        for t, n in zip(cols["pts"], cols["samples"]):
            met, starting, kind = stepped(rules((t, n), starting, 0), count)
            lead = 0.0 if t is None else t / 1e6 * rate - count
            pulled = kind == 1 and method > 1 and abs(lead) > SLACK
            out["dropped"].append(max(0, n - (met - count)))
            out["silence"].append(max(0, met - count - n))
            out["compensation"].append(int(min(max(lead, -method), method)) if pulled else 0)
            out["out_samples"].append(met - count)
            count = met
        return [count, starting], out

    return fold


def audio_sync(
    df: DataFrame, *, rate: int, drift: float = 0.1, method: int = 1, keys=("stream_id", "stream_index"), order: str = "seq",
    rows: int = FOLD_ROWS,
) -> DataFrame:
    """Samples to discard, silence to insert or drift to compensate per packet.

    Two passes at any length.  The maps hold starts a little further ahead of a chunk's first time than the tolerance,
    and those that the whole chunk doesn't catch up with; only a chunk in which the clock catches up after a jump back that
    began in an earlier one is folded by itself.
    """
    rules = _audio_rules(rate, drift)

    def chunk_map(cols):
        rows = list(zip(cols["pts"], cols["samples"]))
        first = next((t / 1e6 * rate for t, _ in rows if t is not None), 0.0)
        ahead = 1.25 * max(SLACK, drift * rate) + max(n for _, n in rows)
        return counted_map(rules, rows, [False, True], top=math.ceil(first + ahead))

    def advance(state, pieces):
        end = counted_end(pieces, *(state or (0, True)))
        return end and list(end)

    return map_stream(
        df, keys, order, ["pts", "samples"], "dropped bigint, silence bigint, compensation int, out_samples bigint", rows=rows,
        fold=audio_sync_fold(rate, drift, method),
        chunk_map=chunk_map, advance=advance,
    )


def monotone_fold() -> Fold:
    def fold(state, cols):
        last = state[0] if state else 0
        starts, stops = [], []
        for own, stop, cut in zip(cols["rt_start"], cols["rt_stop"], cols["disc"]):
            start = own if cut else last
            if start < last and last != 0:
                start = last
            if stop <= start:
                stop = start + 100
            last = stop
            starts.append(start)
            stops.append(stop)
        return [last], {"out_start": starts, "out_stop": stops}

    return fold


def monotone_output(df: DataFrame, *, keys=("stream_id",), order: str = "frame_no", rows: int = FOLD_ROWS) -> DataFrame:
    """Output times without gaps or steps back; re-anchored only at a discontinuity."""
    return fold_stream(
        df, keys, order, ["rt_start", "rt_stop", "disc"], monotone_fold(), "out_start bigint, out_stop bigint", rows=rows
    )


# Limits of the sequence check (fixed values).
MAX_DROPOUT = 3000
MAX_MISORDER = 100
SEQ_MOD = 1 << 16


#: What a packet does to the sequence check: whether it counts, moves the highest number, starts the totals
#: afresh, and whether a number to wait for is set (next after it), forgotten or kept.
RTP_EFFECTS = {
    #          valid  moves  fresh  expected
    "wait":   (False, True, False, "kept"),
    "begin":  (True, True, True, "forgotten"),
    "next":   (True, True, False, "kept"),
    "late":   (True, False, False, "kept"),
    "jump":   (False, False, False, "set"),
    "again":  (True, True, True, "forgotten"),
}


def _rtp_kind(seq: int, top: int, expected: int | None, waiting: bool) -> str:
    """RFC 3550, A.1: a source is valid after two packets in a row; a large step needs a second packet to prove it."""
    if waiting:
        return "begin" if seq == top + 1 else "wait"
    step = (seq - top) % SEQ_MOD
    if step < MAX_DROPOUT:
        return "next"
    if step > SEQ_MOD - MAX_MISORDER:
        return "late"
    return "again" if seq == expected else "jump"


def rtp_steps(base_seq: int = 0) -> Fold:
    """What each packet does; the state is what decides that, without any totals."""

    def fold(state, cols):
        top, expected, waiting = state if state else (base_seq, None, True)
        out = {"valid": [], "top": [], "wrapped": [], "fresh": []}
        for seq in cols["seq"]:
            kind = _rtp_kind(seq, top, expected, waiting)
            valid, moves, fresh, then = RTP_EFFECTS[kind]
            out["wrapped"].append(int(kind == "next" and seq < top))
            top = seq if moves else top
            expected = {"kept": expected, "forgotten": None, "set": (seq + 1) % SEQ_MOD}[then]
            waiting = kind == "wait"
            out["valid"].append(valid)
            out["top"].append(top)
            out["fresh"].append(fresh)
        return [top, expected, waiting], out

    return fold


def rtp_fold(base_seq: int = 0) -> Fold:
    """The live form: the steps with their totals since the last fresh start, kept in the state."""
    steps = rtp_steps(base_seq)

    def fold(state, cols):
        inner, base, wraps, received = state if state else (None, 0, 0, 0)
        inner, did = steps(inner, cols)
        out = {"valid": did["valid"], "ext_seq": [], "base": [], "received": []}
        for ok, top, wrapped, fresh in zip(*did.values(), strict=True):
            base, wraps, received = (top - 1, 0, 0) if fresh else (base, wraps + wrapped, received)
            received += ok
            out["ext_seq"].append(wraps * SEQ_MOD + top)
            out["base"].append(base)
            out["received"].append(received)
        return [inner, base, wraps, received], out

    return fold


RTP_OUT = "valid boolean, ext_seq bigint, base bigint, received bigint"


def rtp_sequence(df: DataFrame, *, base_seq: int = 0, rows: int = FOLD_ROWS) -> DataFrame:
    """Unwrapped sequence numbers with probation, dropouts, misorder and restarts.

    The fold only decides what each packet does.  Wraps and received packets are running sums, less what they
    were at the last fresh start.
    """
    key, order = ["ssrc"], "arrival_no"
    steps = fold_stream(df, key, order, ["seq"], rtp_steps(base_seq), "valid boolean, top bigint, wrapped int, fresh boolean", rows=rows)
    steps = cut_lineage(steps)
    sums = {"__w": ("sum", F.col("wrapped").cast("bigint")), "__r": ("sum", F.col("valid").cast("bigint"))}
    steps = running(steps, key, order, sums, rows=rows)
    start = F.when(F.col("fresh"), F.struct((F.col("top") - 1).alias("base"), F.col("__w").alias("w"), (F.col("__r") - 1).alias("r")))
    steps = running(steps, key, order, {"__s": ("last", start)}, rows=rows)
    since = lambda total, field: F.col(total) - F.coalesce(F.col("__s")[field], F.lit(0))
    return steps.select(
        *[c for c in df.columns if c not in ("valid", "ext_seq", "base", "received")], "valid", (since("__w", "w") * SEQ_MOD + F.col("top")).alias("ext_seq"),
        F.coalesce("__s.base", F.lit(0)).cast("bigint").alias("base"), since("__r", "r").alias("received"),
    )


def _tracked(state: tuple[float, float], time: float, step: float, gain: float, pull: float) -> tuple[float, float]:
    """An alpha-beta filter's next position and speed; both are linear in the state and the time that is seen."""
    ahead = state[0] + state[1] * step
    miss = time - ahead
    return ahead + gain * miss, state[1] + pull * miss / step


def _gains(before: int, count: int, least: float) -> list[float]:
    """The share of the miss that each row after ``before`` others corrects; the very first is taken as it is."""
    return [max(least, 1.0 / k) for k in range(before + 1, before + count + 1)]


def clock_fold(period: float, f2: float, f3: float) -> Fold:
    def fold(state, cols):
        cycle, clock, before = state if state else (0.0, period, 0)
        out = []
        for k, (t, step, gain) in enumerate(zip(cols["time"], cols["step"], _gains(before, len(cols["time"]), f2)), before):
            cycle, clock = _tracked((cycle, clock), t, step, gain, f3) if k else (float(t), clock)
            out.append(cycle)
        return [cycle, clock, before + len(out)], {"smooth_time": out}

    return fold


def clock_filter(
    df: DataFrame, *, period: float, factor2: float, factor3: float, keys=("stream_id",), order: str = "seq", rows: int = FOLD_ROWS
) -> DataFrame:
    """Delay-locked loop over noisy times; ``step`` is the periods since the last row.

    Two passes at any length.  The gain of a row follows from its number, so a chunk is a linear map of the state:
    what becomes of either unit state if all times were 0, and of the zero state with the true times.
    """
    run = clock_fold(period, factor2, factor3)

    def chunk_map(cols):
        before, n = cols["__before"][0], len(cols["time"])
        ends = [run([*unit, before], {"time": [0.0] * n, "step": cols["step"]})[0] for unit in ((1.0, 0.0), (0.0, 1.0))]
        return [*[e[:2] for e in ends], run([0.0, 0.0, before], cols)[0][:2], n]

    def advance(state, found):
        cycle, clock, before = state or (0.0, period, 0)
        of_cycle, of_clock, alone, n = found
        return [*[a * cycle + b * clock + c for a, b, c in zip(of_cycle, of_clock, alone, strict=True)], before + n]

    return map_stream(
        df, keys, order, ["time", "step"], "smooth_time double", rows=rows, numbered=True, fold=run, chunk_map=chunk_map, advance=advance
    )


def vbv_fold(size: int, low: int, high: int, min_stuffing: int, start: float) -> Fold:
    """A running sum held between empty and full: pictures draw from it, a bounded rate fills it, bytes run over."""

    def fold(state, cols):
        level = state[0] if state else start
        out = {"level": [], "underflow": [], "stuffing": []}
        for bits in cols["bits"]:
            drawn = max(level - bits, 0)
            filled = drawn + sorted((low, int(size - drawn - 1), high))[1]
            over = filled - size
            spare = max(math.ceil(over / 8), min_stuffing) if over > 0 else 0
            out["underflow"].append(level < bits)
            level = filled - 8 * spare
            out["level"].append(float(level))
            out["stuffing"].append(spare)
        # Without bits left the level is a whole number; a state typed as double takes no int.
        return [float(level)], out

    return fold


def vbv_audit(
    df: DataFrame, *, size: int, min_rate: float, max_rate: float, fps: float, min_stuffing: int = 0, start: float | None = None,
    keys=("stream_id",), order: str = "frame_no", rows: int = FOLD_ROWS,
) -> DataFrame:
    """Decoder buffer after each frame: level, underflow and stuffing bytes."""
    return fold_stream(
        df, keys, order, ["bits"], vbv_fold(size, int(min_rate / fps), int(max_rate / fps), min_stuffing, size * 0.75 if start is None else start),
        "level double, underflow boolean, stuffing int", rows=rows,
    )


def data_rate_fold(window_ms: int = 5000) -> Fold:
    """Rates since the older of the two last checkpoints; a row sets one when the last is longer ago than the window."""

    def fold(state, cols):
        marks = [tuple(m) for m in state] if state else []
        out = []
        for here in zip(cols["t_ms"], cols["bytes_total"]):
            if not marks or marks[0] == (0, 0):
                marks = [here]
            elif here[0] - marks[-1][0] > window_ms:
                marks = [marks[-1], here]
            time, total = (b - a for a, b in zip(marks[0], here))
            out.append(total * 1000 // time if time else 0)
        return marks, {"rate": out}

    return fold


def data_rate(df: DataFrame, *, keys=("stream_id",), order: str = "seq", rows: int = FOLD_ROWS) -> DataFrame:
    """Bytes per second since the older of two checkpoints 5 s apart."""
    return fold_stream(df, keys, order, ["t_ms", "bytes_total"], data_rate_fold(), "rate bigint", rows=rows)


def block_times_fold(ticks: int, bytes_per_second: int, tolerance: int) -> Fold:
    def fold(state, cols):
        now = state[0] if state else 0
        starts, stops = [], []
        for own, size in zip(cols["rt_start"], cols["size"]):
            if own is not None and (now == 0 or own >= now or own - now < -tolerance):
                now = own
            starts.append(now)
            now += ticks * size // bytes_per_second
            stops.append(now)
        return [now], {"out_start": starts, "out_stop": stops}

    return fold


def audio_block_times(
    df: DataFrame, *, bytes_per_second: int, ticks: int = 10_000_000, tolerance: int = 2000, keys=("stream_id",), order: str = "seq",
    rows: int = FOLD_ROWS,
) -> DataFrame:
    """Block times by size; re-anchored when ahead or more than 2000 ticks behind."""
    return fold_stream(
        df, keys, order, ["rt_start", "size"], block_times_fold(ticks, bytes_per_second, tolerance),
        "out_start bigint, out_stop bigint", rows=rows,
    )


def butterworth(order: int, cutoff: float) -> tuple[list[float], list[float], float]:
    """Low-pass coefficients by the bilinear transform: (numerator, feedback, gain).

    ``cutoff`` is a share of half the sample rate.  The feedback list starts with
    the oldest sample.
    """
    if order < 2 or order % 2 or order > 30 or not 0 < cutoff < 1:
        raise ValueError("order must be even, 2 to 30, and cutoff between 0 and 1")
    warped = 2 * math.tan(math.pi * 0.5 * cutoff)
    poles = []
    for i in range(order):
        angle = (i + order // 2 + 0.5) * math.pi / order
        s = complex(math.cos(angle), math.sin(angle)) * warped
        poles.append((2 + s) / (2 - s))
    poly = [1 + 0j]
    for z in poles:
        poly = [a - z * b for a, b in zip([*poly, 0], [0, *poly])]
    real = [c.real for c in poly]
    gain = sum(real) / 2**order
    return [float(math.comb(order, i)) for i in range(order + 1)], [-c for c in reversed(real[1:])], gain


def iir_fold(order: int, cutoff: float) -> Fold:
    num, back, gain = butterworth(order, cutoff)

    def fold(state, cols):
        x = list(state) if state else [0.0] * order
        out = []
        for v in cols["x"]:
            new = v * gain + sum(c * s for c, s in zip(back, x))
            total = sum(c * s for c, s in zip(num, [*x, new]))
            out.append(int(max(-32768, min(32767, round(total)))))
            x = [*x[1:], new]
        return x, {"y": out}

    return fold


def iir_lowpass(df: DataFrame, *, order: int, cutoff: float, keys=("stream_id",), by: str = "sample_no", rows: int = FOLD_ROWS) -> DataFrame:
    """Butterworth low pass over 16-bit samples ``x``."""
    return fold_stream(df, keys, by, ["x"], iir_fold(order, cutoff), "y int", rows=rows)


#: Hint that each phase of a cadence must show (fixed values).
PHASES = {
    "PULLDOWN_32": ("NEXT_22", "PREV_22", "AFTERNEXT_32", "NEXT_32", "PREV_32"),
    "PULLDOWN_22": ("NEXT_22", "PREV_22"),
}


def film_fold() -> Fold:
    """Film detection field by field, for live input (see ``detect_film``)."""

    def fold(state, cols):
        kind, index = state if state else ("FULLRATE", 0)
        out = {"cadence": [], "cadence_index": []}
        for n, hint in zip(cols["field_no"], cols["hint"]):
            phases = PHASES.get(kind, ())
            if not phases or phases[(n + index) % len(phases)] != hint:
                kind, index = {
                    "AFTERNEXT_32": ("PULLDOWN_32", (7 - n % 5) % 5), "NEXT_22": ("PULLDOWN_22", n % 2),
                }.get(hint, ("FULLRATE", 0))
            out["cadence"].append(kind)
            out["cadence_index"].append(index)
        return [kind, index], out

    return fold


def repair_fold(delay: int, wrap_bits: int) -> Fold:
    """Timestamps with one reordered picture: see ``repair_delayed``."""

    def first_known(*times):
        return next((t for t in times if t is not None), None)

    def prompt_time(pts, dts, dur, clock):
        """Time of a picture that shows as soon as it is decoded."""
        t = first_known(pts, dts, clock)
        if pts is None or not dur:
            return t
        repeat = abs(clock - dur - pts)
        return t + dur if repeat < min(abs(clock - pts), dur >> 3) else t

    def fold(state, cols):
        clock, shown, shown_dur = state if state else (0, None, 0)
        done = {"pts_out": [], "dts_out": []}
        for pts, dts, dur, is_b in zip(cols["pts"], cols["dts"], cols["duration"], cols["is_b"]):
            both = pts is not None and dts is not None
            if both and dts > pts:
                dts -= 1 << wrap_bits
            held = bool(delay) and not is_b
            if held and delay == 1 and both and dts == pts:
                pts = dts = None
            elif both and pts > dts:
                held = True
            if held:
                dts = first_known(dts, shown, clock)
                clock = dts + (shown_dur or dur)
                shown, shown_dur = pts, dur
            elif dur or pts is not None or dts is not None:
                pts = dts = prompt_time(pts, dts, dur, clock)
                clock = pts + dur
            done["pts_out"].append(pts)
            done["dts_out"].append(dts)
        return [clock, shown, shown_dur], done

    return fold


def repair_delayed(
    df: DataFrame, *, delay: int = 1, wrap_bits: int = 33, keys=("stream_id", "stream_index"), order: str = "seq", rows: int = FOLD_ROWS
) -> DataFrame:
    """Timestamps of streams whose I and P pictures show after the next B pictures.

    A late picture takes the presentation time of the I or P picture before it as
    decode time, and time goes on by that picture's duration; a B picture decodes
    when it shows.  A time that repeats the last one within an eighth of a duration
    moves on by one duration.
    """
    return fold_stream(
        df, keys, order, ["pts", "dts", "duration", "is_b"], repair_fold(delay, wrap_bits), "pts_out bigint, dts_out bigint", rows=rows
    )

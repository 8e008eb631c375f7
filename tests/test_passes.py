"""One ordered pass in place of several: against loops over the rows, over chunk borders, and by scans of the plan."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspark.operators import joins as J
from mediaspark.operators import stats as S
from mediaspark.operators import transport as T
from mediaspark.operators.scan import nearest_two, running

CHUNKS = [3, 1000]


def scans(df):
    """Times that the physical plan reads a source."""
    return len(re.findall(r"Scan ExistingRDD|LocalTableScan|FileScan", df._jdf.queryExecution().sparkPlan().toString()))


def source(spark, rows, schema):
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), schema)


@pytest.mark.parametrize("rows", CHUNKS)
def test_nearest_two_on_either_side(spark, rows):
    rng = random.Random(5)
    data = [(k, o, rng.choice([None, None, None, o * 10])) for k, n in ((0, 40), (1, 1), (2, 25)) for o in rng.sample(range(60), n)]
    data += [(3, o, None) for o in range(8)]
    df = source(spark, data, "k int, o bigint, v bigint")
    out = nearest_two(df, ["k"], "o", F.col("v"), before="b", after="a", rows=rows)
    assert scans(out) == 2
    got = {(r.k, r.o): ([tuple(x) for x in r.b], [tuple(x) for x in r.a]) for r in out.collect()}
    for k, o, _ in data:
        known = sorted((p, v) for q, p, v in data if q == k and v is not None)
        assert got[k, o] == ([x for x in known if x[0] <= o][::-1][:2], [x for x in known if x[0] > o][:2])
    assert len(got) == len(data)
    assert nearest_two(df.limit(0), ["k"], "o", F.col("v"), before="b", after="a", rows=rows).count() == 0


@pytest.mark.parametrize("rows", [3, 1000, None])
def test_running_looks_both_ways(spark, rows):
    rng = random.Random(6)
    data = [(k, o, rng.choice([None, o])) for k in (0, 1) for o in rng.sample(range(50), 30)]
    df = source(spark, data, "k int, o bigint, v bigint")
    out = running(df, ["k"], "o", {"s": ("sum", F.col("v"))}, rows=rows, ahead={"n": ("first", F.col("v")), "c": ("count", F.col("v"))})
    for r in out.collect():
        mine = sorted((o, v) for k, o, v in data if k == r.k and v is not None)
        later = [v for o, v in mine if o > r.o]
        assert (r.s or 0, r.n, r.c) == (sum(v for o, v in mine if o <= r.o), later[0] if later else None, len(later))


@pytest.mark.parametrize("cell", [2, None])
def test_both_neighbours_of_a_request(spark, cell):
    """Ties take the smallest name, an equal time lies on both sides, what isn't offered counts only below."""
    rng = random.Random(7)
    right = [(k, rng.randrange(40), f"n{i}") for i, k in enumerate([0] * 20 + [1] * 2)]
    left = [(i, k, t) for i, (k, t) in enumerate([(k, t) for k in (0, 1, 2) for t in range(-2, 44)] + [(0, 5), (0, None)])]
    out = J.asof_both(
        source(spark, left, "id int, k int, t bigint"), source(spark, right, "k int, at bigint, name string"), ["k"], "t", "at", ["at", "name"],
        tie="name", offered=F.col("at") < 30, cell=cell,
    )
    got = {r.id: (r.at_or_before and tuple(r.at_or_before), r.at_or_after and tuple(r.at_or_after)) for r in out.collect()}
    for i, k, t in left:
        low = [(a, n) for q, a, n in right if q == k and t is not None and a <= t]
        high = [(a, n) for q, a, n in right if q == k and t is not None and t <= a < 30]
        assert got[i] == (min(low, key=lambda x: (-x[0], x[1]), default=None), min(high, default=None))
    assert len(got) == len(left)


@pytest.mark.parametrize("refs", [{}, {4: 90}, {4: 90, 11: 300}, {0: 0, 5: 500, 6: 590, 22: 2000}])
@pytest.mark.parametrize("rows", CHUNKS)
def test_clock_with_few_references(spark, rows, refs):
    df = source(spark, [(i, refs.get(i)) for i in range(25)], "packet_no bigint, pcr bigint")
    out = J.interpolate_pcr(df, rows=rows)
    assert scans(out) == 2
    at = sorted(refs)
    for r in out.collect():
        i = max([k for k, p in enumerate(at) if p <= r.packet_no], default=0)
        pair = at[i : i + 2] if i + 1 < len(at) else at[max(i - 1, 0) :]
        step = (refs[pair[1]] - refs[pair[0]]) // (pair[1] - pair[0]) if len(pair) == 2 else None
        assert r.step == step and r.clock == (None if step is None else refs[at[i]] + step * (r.packet_no - at[i]))


def units(packets):
    """Whole units by a loop over the packets of one key."""
    done, open_, last = [], None, None
    for no, cc, pusi, payload in packets:
        broken, last = last is not None and cc != (last + 1) % 16, cc
        if payload is None and not broken:
            continue
        if pusi:
            done.append(open_)
            open_ = (no, payload or b"")
        elif broken:
            open_ = None
        elif open_:
            open_ = (open_[0], open_[1] + payload)
    return {a: b for a, b in filter(None, [*done, open_]) if b}


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_units_over_lost_and_empty_packets(spark, rows):
    rng = random.Random(8)
    data = []
    for pid in (1, 2):
        cc = 0
        for no in range(120):
            cc = (cc + rng.choice([1, 1, 1, 1, 1, 1, 2])) % 16
            if rng.random() < 0.9:
                payload = rng.choice([None, *[bytes([no, pid, 0, 0, 0, 0])] * 5])
                data.append((0, pid, no * 2 + pid % 2, cc, rng.random() < 0.3, payload and bytearray(payload)))
    df = source(spark, data, "stream_id int, pid int, packet_no bigint, cc int, pusi boolean, payload binary")
    out = T.assemble_pes(df, rows=rows, part_span=1 << 16)
    assert scans(out) == 2
    for pid in (1, 2):
        want = units([(no, cc, pusi, p and bytes(p)) for _, q, no, cc, pusi, p in data if q == pid])
        assert {r.first_packet: bytes(r.data) for r in out.where(F.col("pid") == pid).collect()} == want
    short = T.assemble_pes(df, rows=rows, part_span=4).groupBy("pid", "unit").agg(F.array_sort(F.collect_list(F.struct("part_no", "data"))).alias("p"), F.min("first_packet").alias("f"))
    whole = {(r.pid, r.first_packet): bytes(r.data) for r in out.collect()}
    assert {(r.pid, r.f): b"".join(bytes(x["data"]) for x in r.p) for r in short.collect()} == whole


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_divisor_of_gaps_by_chunks(spark, rows):
    rng = random.Random(9)
    data = []
    for stream, step in ((0, 40), (1, 12), (2, 7)):
        t = 1000
        for seq in range(30 if stream < 2 else 5):
            t += step * rng.choice([0, 1, 2, -1, 3])
            data.append((stream, 0, seq * 2, None if rng.random() < 0.1 else t + (1 if seq < 3 else 0)))
    df = source(spark, data, "stream_id int, stream_index int, seq bigint, dts bigint")
    out = S.delta_gcd(df, rows=rows)
    assert scans(out) == 2
    want = {}
    for stream in (0, 1, 2):
        t = [d for s, _, _, d in data if s == stream and d is not None]
        gap = [x for x in [t[1] - t[0], *[x - t[1] for x in t[2:]]] if x > 0][3:]
        if gap:
            want[stream] = int(np.gcd.reduce(gap))
    assert {r.stream_id: r.gap_gcd for r in out.collect()} == want

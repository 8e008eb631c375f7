"""Near copies of texts and lines against all pairs, on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from mediaspark.llm import linededup, ngramjoin, queries
from mediaspark.llm.common import components, native_sieve, sieve

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    want = roots({x for a, b in edges for x in (a, b) if a != b}, [e for e in edges if e[0] != e[1]])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sieves_lose_none_of_the_ids(spark):
    ids = spark.range(0, 3000, 7).select((F.col("id") * 1_000_003).alias("x"))
    rows = spark.range(3000).select((F.col("id") * 1_000_003).alias("x"))
    for kept in (sieve(rows, ids, "x"), rows.where(native_sieve(ids)(F.col("x")))):
        assert kept.join(ids, "x", "left_semi").count() == ids.count() and kept.count() < ids.count() + 60
    assert rows.where(native_sieve(ids.limit(0))(F.col("x"))).count() == 0 == sieve(rows, ids.limit(0), "x").count()


def shingle_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = roots(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def near_copies(rng):
    """Chains, stars and borderline copies of texts of several lengths, and a passage that many texts share."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, rows = [word() for _ in range(60)], []
    for n in (1, 3, 5, 9, 30, 120, 500):
        base = [word() for _ in range(n)]
        for k in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 18))):
                copy[rng.randrange(n)] = word()
            if k % 4 == 3:
                base = copy
            rows.append(" ".join(copy if k % 3 else [x.upper() for x in copy]))
    for _ in range(60):
        own = [word() for _ in range(rng.randint(30, 90))]
        rows.append(" ".join(own[:20] + passage + own[20:]))
    return [*rows, *rows[:5], None, "", " \n", "one", "One"]


@pytest.mark.parametrize("common, block", [(ngramjoin.COMMON, ngramjoin.BLOCK), (6, 4)])
def test_jaccard_classes_match_all_pairs(spark, monkeypatch, common, block):
    monkeypatch.setattr(ngramjoin, "COMMON", common)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    texts = near_copies(random.Random(11))
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], SCHEMA + ", node int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_classes(df).collect()}
    assert got == jaccard_classes(rows)


def test_jaccard_query_matches_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op9_ngram_jaccard"](spark, DIR).collect()}
    assert got == jaccard_classes(rows)


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 6, 40, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 8 :], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64))))
        ma, mb = ngramjoin.bitmap(a), ngramjoin.bitmap(b)
        words = min(len(ma), len(mb))
        near = ngramjoin.may_overlap(ngramjoin._fold(ma[None], words)[0], len(a), ngramjoin._fold(mb[None], words), np.array([len(b)]), 75)
        both = len(np.intersect1d(a, b))
        assert near[0] or 100 * both < 75 * (len(a) + len(b) - both)


def test_one_of_each_class_stays(spark):
    say = " ".join(f"w{i}" for i in range(40))
    rows = [(5, say, "b", None), (3, say + " x", "a", None), (3, say + " x", "a", None), (9, None, None, None), (8, "", None, None), (None, say, None, None), (7, "alone", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit(1))
    out = ngramjoin.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out.collect()) == [(False, 0), (True, 3), (True, 7), (True, 8), (True, 9)]
    assert ngramjoin.keep_one(df.limit(0)).count() == 0
    assert ngramjoin.jaccard_classes(df.limit(0)).count() == 0
    classes = {(r["doc_id"], r["component_id"]) for r in ngramjoin.jaccard_classes(df).collect()}
    assert classes == {(5, 3), (3, 3), (9, 9), (8, 8), (None, 3), (7, 7)}


def test_no_text_goes_without_one_of_its_class(spark):
    """Several texts under one id: x is kept once, y or its near copy once, and the unrelated text stays."""
    x, y, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, x, "a", None), (2, y, "a", None), (2, x, "b", None), (3, y + " more", None, None), (3, other, "a", None)]
    rows += [(4, "p q", "b", None), (4, "p q", "a", None), (4, None, None, None), (4, "", None, None), (4, "P Q", "a", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__row", F.lit(0))
    found = [(r["doc_id"], r["text"], r["lang"]) for r in ngramjoin.keep_one(df).collect()]
    assert (1, x, "a") in found and (3, other, "a") in found
    assert sum(t == x for _, t, _ in found) == 1 and sum(t in (y, y + " more") for _, t, _ in found) == 1
    assert [f for f in found if f[1] in ("p q", "P Q")] in ([(4, "p q", "a")], [(4, "P Q", "a")])
    assert len(found) == 5 and sum(not t for _, t, _ in found) == 1


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_bit_parallel_distance_matches_the_table(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "x string, y string")
    for edits in (0, 1, 2, 3):
        got = sorted((r["x"], r["y"]) for r in df.where(linededup.within("x", "y", edits)).collect())
        assert got == sorted(p for p in pairs if edits_between(*p) <= edits)


def deduped(rows, least=32, edits=2, equal=20):
    """What stays of each text, by all pairs of lines."""
    lines = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n") if t is not None else []):
            if len(x) >= equal:
                lines[x] = min(lines.get(x, (i, n)), (i, n))
    names = sorted(lines)
    links = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :] if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and edits_between(a, b) <= edits]
    comp = roots(names, links)
    first = {}
    for x in names:
        first[comp[x]] = min(first.get(comp[x], lines[x]), lines[x])
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if len(x) < equal or first[comp[x]] == (i, n)) for i, t in rows}


def near_lines(rng):
    say = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    lines = []
    for n in (31, 32, 33, 40, 61):
        for _ in range(2):
            x = say(n)
            for _ in range(12):
                b = list(x)
                for _ in range(rng.randint(0, 3)):
                    at = rng.randint(0, len(b))
                    b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
                lines.append("".join(b))
                if rng.random() < 0.3:
                    x = lines[-1]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]
    return [*texts, texts[0], None, "", "\n", lines[0] + "\n" + lines[0] + "\nshort\nshort"]


@pytest.mark.parametrize("block", [linededup.BLOCK, 3])
def test_line_dedup_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    rows = [(500 - 7 * i, t) for i, t in enumerate(near_lines(random.Random(21)))]
    df = spark.createDataFrame([(i, t, None, None, "z") for i, t in rows], SCHEMA + ", line string").withColumn("key", F.lit(4))
    out = linededup.dedup_lines(df.repartition(4))
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    want = deduped(rows)
    # A text whose lines all went is empty.
    assert got == want
    for r in out.collect():
        text = dict(rows)[r["doc_id"]]
        assert r["n_lines"] == (0 if text is None else len(text.split("\n")))


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_splits_hot_keys(spark, monkeypatch, edits):
    monkeypatch.setattr(linededup, "HOT", 2)
    monkeypatch.setattr(linededup, "BLOCK", 3)
    rows = [(7 * i, t) for i, t in enumerate(near_lines(random.Random(33)))]
    # Lines that share all but their end, their beginning or their middle.
    same, rng = "the same words on each page of it ", random.Random(34)
    for i in range(60):
        field = "".join(rng.choice("0123") for _ in range(6))
        rows.append((10_000 + i, [same + field, field + same, same[:17] + field + same[17:]][i % 3]))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA), edits=edits).collect()}
    assert got == deduped(rows, edits=edits)


@pytest.mark.parametrize("more", [1, 3])
def test_finer_keys_meet_whatever_is_near(spark, more):
    rng, pairs = random.Random(more), set()
    while len(pairs) < 300:
        a = [rng.choice("ab") for _ in range(rng.randint(32, 40))]
        b = list(a)
        for _ in range(2):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.add(("".join(a), "".join(b)))
    pairs = sorted(p for p in pairs if edits_between(*p) <= 2)
    df = spark.createDataFrame([(n, x) for n, p in enumerate(pairs) for x in sorted(p, key=len)], "n int, line string")
    rows = df.select("n", "line", F.char_length("line").alias("len"), F.encode("line", "UTF-32").alias("units"))
    keys = {}
    for r in rows.select("n", "line", linededup._finer_keys(2, more).alias("k")).collect():
        keys.setdefault(r["n"], []).append(({k["key"] for k in r["k"]}, {k["key"] for k in r["k"] if k["indexed"]}))
    for n, ((short, indexed), (long, _)) in keys.items():
        assert indexed & long, pairs[n]


def test_line_dedup_of_odd_rows(spark):
    say, long = "x" * 20 + "y" * 20, ("word " * 30000).strip()
    rows = [(None, say, None, None), (1, say, None, None), (1, say, None, None), (2, "a\n" + say + "z\n\nb", None, None), (3, long, None, None), (4, long + "!", None, None)]
    got = sorted((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, say, 0), (1, "", 1), (1, "", 1), (2, "a\n\nb", 1), (3, long, 0), (4, "", 1)]
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0

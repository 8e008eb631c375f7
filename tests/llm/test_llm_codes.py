"""Toxicity, vector codes and fill-in-middle against plain Python, round trips and held-out labels."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspark.llm import fim, pqcodes, queries, subword

DIR = "/root/testdata/sf0.001"

# ------------------------------------------------------------ fill in middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", " \n\t ", "a", " a", "a ", "a b", "é ☃ x 𝄞y", "x <P> y", "<", "<S", "a <M", "<M>", "P> <", "one two  three\nfour\x0bfive\x0c ", "\x00\x01 b", "z" * 5000 + " q" * 3000]


def fim_by_hand(key, text, rate=50, spm=80):
    text = text or ""
    words = TOKEN.findall(text)
    digest = hashlib.sha256(b"42:" + ("" if key is None else str(key)).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(words) + 1) for x in h[:2])
    pre, mid, suf = ("".join(w) for w in (words[:a], words[a:b], words[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(words), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(words), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(words), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("size", [fim.SLICE, 16])
@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (100, 100)])
def test_fim_matches_plain_python_and_goes_back(spark, monkeypatch, size, rate, spm):
    monkeypatch.setattr(fim, "SLICE", size)
    rng = random.Random(4)
    more = ["".join(rng.choice("ab é☃<PSM> \n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(None if i == 5 else i, t, "x") for i, t in enumerate([*TEXTS, *more, *TEXTS])]
    # The size of a slice reaches the workers by value only here, so the moves are called directly as well.
    held, starts = fim._bytes_of(__import__("pyarrow").array([t or "" for _, t, _ in rows]))
    draws = np.array([[int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)] for k, _, _ in rows])
    outs, backs = [], []
    for a, b in fim._slices(starts):
        part, at = held[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        c = fim.cut(part, at, draws[a:b], rate, spm)
        out, places = fim.scatter(part, at, c["form"], c["middle"], c["suffix"])
        outs += fim._texts_of(out, places).to_pylist()
        backs += fim._texts_of(*fim.gather(out, places, c["form"])).to_pylist()
    assert outs == [fim_by_hand(k, t, rate, spm)[4] for k, t, _ in rows] and backs == [t or "" for _, t, _ in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, doc_id bigint, text string, form string")
    found = fim.fill_in_middle(df, rate=rate, spm=spm).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        key, text, _ = rows[r["i"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == fim_by_hand(key, text, rate, spm)
        assert r["back"] == (text or "") and r["text"] == text


def test_fim_of_an_empty_table_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3, "doc_id bigint, text string")
    assert fim.fill_in_middle(df).distinct().count() == 1
    assert fim.fill_in_middle(df.limit(0)).columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(df.where("false")).count() == 0


# -------------------------------------------------------------- vector codes


def codes_by_hand(rows, parts, entries, rounds):
    """Plain integers and loops."""
    whole = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
    kept = [(k, [math.floor(x * 1024) for x in v], y) for k, v, y in rows if whole(v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    if not first:
        return {}, []
    w = len(first[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            at = [pick(p, cut(v)[p]) for _, v, _ in kept]
            mine = [[cut(v)[p] for (_, v, _), a in zip(kept, at) if a == e] for e in range(len(books[p]))]
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(mine, books[p])]
    out = {}
    for k, v, y in kept:
        at = [pick(p, cut(v)[p]) for p in range(parts)]
        out.setdefault((k, y), []).append(("".join(f"{a:02x}" for a in at), sum(far(cut(v)[p], books[p][a]) for p, a in enumerate(at))))
    return out, books


def test_codes_match_plain_integers(spark):
    rng = random.Random(6)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.uniform(-1, 1) * rng.choice([0.1, 1, 30]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(200, None, 1), (201, [None] + [0.0] * 7, 1), (202, [nan] * 8, 1), (203, [0.0] * 7 + [inf], None), (204, [], 1), (-1, [-0.0005] * 8, None)]
    rows += [(5, rows[5][1], rows[5][2]), (None, [0.25] * 8, 2), (205, [100000.0, -100000.0] * 4, 7)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "vec_id bigint, embedding array<float>, label int, code string").repartition(5)
    single = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for k, v, y in rows]
    want, books = codes_by_hand(single, 4, 10, 3)
    got = pqcodes.train(df, entries=10, rounds=3)
    assert got.tolist() == books
    coded = pqcodes.with_label_error(pqcodes.encode(df, got))
    found = {}
    for r in coded.collect():
        found.setdefault((r["vec_id"], r["label"]), []).append((r["code"], r["error"]))
        same = [e for (_, y), rest in want.items() if y == r["label"] for _, e in rest]
        assert r["label_error"] == sum(same)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_limbs_give_exact_products():
    rng = np.random.default_rng(2)
    for size in (10, 1 << 20, 1 << 27, (1 << 28) - 1):
        x, y = rng.integers(-size, size, (40, 16)), rng.integers(-size, size, (30, 16))
        assert (pqcodes.exact_dot(x, y).astype(object) == x.astype(object) @ y.astype(object).T).all()
        at, far = pqcodes.nearest(x, y)
        true = ((x.astype(object)[:, None] - y.astype(object)[None]) ** 2).sum(-1)
        assert (far.astype(object) == true.min(1)).all() and (at == true.argmin(1)).all()
    # One limb wouldn't do: the plain product of doubles is off.
    assert ((x.astype(float) @ y.astype(float).T).astype(np.int64) != pqcodes.exact_dot(x, y)).any()
    book = np.array([[3, 3], [1, 1], [1, 1]])
    assert pqcodes.nearest(np.array([[1, 1], [2, 2]]), book)[0].tolist() == [1, 0]


def test_codes_of_few_and_of_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, 1), (2, None, 1), (3, [0.5] * 3, 1)], "vec_id bigint, embedding array<double>, label int")
    books = pqcodes.train(df)
    assert books.tolist() == [[[512]]] * 4
    assert [(r["vec_id"], r["code"], r["error"]) for r in pqcodes.encode(df, books).collect()] == [(1, "00000000", 0)]
    none = df.where("vec_id > 5")
    assert pqcodes.encode(none, pqcodes.train(none)).count() == 0
    nothing = df.where("vec_id = 2")
    assert pqcodes.encode(nothing, pqcodes.train(nothing)).count() == 0


# ------------------------------------------------------------------ toxicity


def margin_by_hand(text, pull, bias):
    """Subwords, words and runs one by one."""
    mask = (1 << 64) - 1
    A, B, C = (int(x) for x in (subword._A, subword._B, subword._C))
    mix = lambda c: (m := (c + 1) * B & mask) ^ m >> 29
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
    values = []
    for w in words:
        marked = [0, *map(ord, w), 0]
        grams = []
        for n in subword.SIZES:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h * A + mix(c)) & mask
                grams.append(h)
        grams.append(sum(mix(ord(c)) * pow(A, k, 1 << 64) for k, c in enumerate(w)) * 31 & mask)
        at = [(((h ^ h >> 31) * C & mask) >> 40) % subword.BUCKETS for h in grams]
        values.append(sum(pull[b] for b in at) / len(at))
    runs = [sum(values[i : i + subword.RUN]) / len(values[i : i + subword.RUN]) for i in range(0, len(values), subword.RUN)]
    best = sorted(runs, reverse=True)[: subword.TOP]
    return (sum(best) / len(best) if best else 0.0) + bias


ODD = [None, "", " \n", "!!! ###", "a", "Ünïcode Wörter ÇA", "x" * 300, "one two three four five six seven eight nine", "tie tie tie tie " * 6, "a_b-c d1e"]


def test_margins_match_plain_python():
    rng = np.random.default_rng(8)
    pull = rng.normal(size=subword.BUCKETS)
    texts = [*ODD, *(" ".join("".join(rng.choice(list("abcdé")) for _ in range(rng.integers(1, 9))) for _ in range(n)) for n in (3, 4, 5, 50))]
    got = subword.margins(texts, pull, -0.5)
    assert np.allclose(got, [margin_by_hand(t, pull, -0.5) for t in texts], atol=1e-9)
    assert np.array_equal(got, np.concatenate([subword.margins([t], pull, -0.5) for t in texts]))


def test_long_texts_are_read_to_the_end(monkeypatch):
    monkeypatch.setattr(subword, "PIECE", 50)
    monkeypatch.setattr(subword, "SLICE", 120)
    text = "word " * 400 + "x" * 300 + " last"
    assert "".join(subword.pieces(text)) == text and max(map(len, subword.pieces(text))) <= 101
    pull = np.zeros(subword.BUCKETS)
    pull[subword.subwords(["last"])[0]] = 5.0
    assert subword.margins([text], pull, 0.0)[0] > 0 == subword.margins(["word " * 400], pull, 0.0)[0]


def test_slopes_are_those_of_the_loss():
    """One short step goes down the loss of the plain forward pass."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["abc", "bcd", "cde", "awful", "dreadful"][: 3 + 2 * (i % 2)]) for _ in range(12)) for i in range(40)]
    labels = np.array([int("ful" in t) for t in texts])
    losses = []
    for rounds in (1, 3, 10, 40):
        vectors, weights, bias = subword.fit(texts, labels, rounds=rounds, rate=0.05, least=1)
        m = np.array([margin_by_hand(t, vectors @ (weights[:, 1] - weights[:, 0]), bias[1] - bias[0]) for t in texts])
        losses.append(float(np.log1p(np.exp(np.where(labels == 1, -m, m))).mean()))
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.5 * losses[0]


def test_unseen_misspellings_are_caught(spark):
    rng = random.Random(5)
    syllables = ["ba", "lo", "mi", "tren", "su", "ka", "dor", "el"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["horrible", "dreadful", "miserable"]
    spoilt = {"horrible": "horribble", "dreadful": "dreadfull", "miserable": "misserable"}

    def text(words):
        body = [word() for _ in range(rng.randint(20, 200))]
        for w in words:
            body.insert(rng.randrange(len(body)), w)
        return " ".join(body)

    rows = [(i, text([rng.choice(bad) for _ in range(4)] if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(400)]
    new = [(1000 + i, text([spoilt[rng.choice(bad)] for _ in range(4)] if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows + new, "doc_id bigint, text string, score int")
    labels = docs.where("doc_id < 1000").select("doc_id", F.col("score").alias("toxic"))
    found = {r["doc_id"]: r for r in subword.score_toxicity(docs.withColumn("predicted", F.lit("x")), docs, labels).collect()}
    assert sum(found[k]["predicted"] == y for k, _, y in new) >= 190
    assert set(found) == {k for k, *_ in rows + new}


def test_toxicity_on_held_out_documents(spark):
    """Ranked by score, held-out toxic documents stand ahead of nearly all others."""
    found = queries.QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = found["score"].rank()
    n1, n0 = (found["toxic"] == 1).sum(), (found["toxic"] == 0).sum()
    assert (rank[found["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.93
    assert found[found["toxic"] == 0]["predicted"].mean() < 0.02 and found[found["toxic"] == 1]["predicted"].mean() > 0.75


def test_toxicity_of_odd_rows(spark):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, 0), (5, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    found = subword.score_toxicity(docs, docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    for few in (labels.where("toxic > 5"), labels.where("doc_id = 7")):
        flat = subword.score_toxicity(docs, docs, few).collect()
        assert len({r["score"] for r in flat}) == 1 and flat[0]["score"] <= 0.5
    assert subword.score_toxicity(docs.limit(0), docs, labels).count() == 0

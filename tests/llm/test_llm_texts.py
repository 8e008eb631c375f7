"""Counts, windows, languages and quality against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mediaspark.llm import decontam, hdlang, nbsvm, outliers, queries, tokencount

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


ODD = [None, "", "   \n\t", "a", "a b " * 40, "x y z \x0b\x0c q", "same line here\nsame line here\n\n\n", "é# ñ| ☃<>", "w " * 60000, "one two three four five six seven eight " * 2 + "nine"]


def test_base_counts_match_plain_python(spark):
    rng = random.Random(3)
    rows = [*ODD, *(" ".join(rng.choice("abc") for _ in range(n)) for n in (8, 9, 16, 17, 30, 200))]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").select("i", outliers.text_counts("text").alias("c"))
    for r in df.collect():
        c = r["c"]
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == base_counts(rows[r["i"]]), r["i"]


def test_outliers_of_the_query_and_planted_ones(spark, texts):
    found = {r["doc_id"]: r for r in queries.QUERIES["op1_robust_outliers"](spark, DIR).collect()}
    assert set(found) == set(texts)
    for k, text in texts.items():
        got = base_counts(text)
        assert tuple(found[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == got
        assert found[k]["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (found[k]["kept"] and found[k]["base_failed"])
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(40, 900))) + ".", "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(word().upper() + "!!" for _ in range(100)), "en", "s") for i in range(30)]
    out = {r["doc_id"]: r["kept"] for r in outliers.reject_outliers(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(out[i] for i, *_ in clean) and not any(out[i] for i, *_ in junk)


def varied(rng, upper, marks, symbols, size):
    """A text of so many words, with given shares of capitals, punctuation and symbols among them."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    say = lambda w: w.upper() if rng.random() < upper else w
    return " ".join(say(word()) + ("," if rng.random() < marks else "") + ("#" if rng.random() < symbols else "") for _ in range(size))


def test_a_tight_cluster_of_a_fifth_is_rejected(spark):
    rng = random.Random(11)
    share = lambda middle, wide: math.exp(rng.gauss(middle, wide))
    clean = [(i, varied(rng, share(-3.5, 0.8), share(-2.2, 0.7), share(-4.5, 0.8), int(rng.lognormvariate(5, 0.6)) + 20), "en", "s") for i in range(400)]
    junk = [(1000 + i, varied(rng, 1.0, 1.0, 1.0, 120), "en", "s") for i in range(100)]
    out = {r["doc_id"]: r["kept"] for r in outliers.reject_outliers(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert not any(out[i] for i, *_ in junk)
    assert all(out[i] for i, *_ in clean)


def test_junk_of_middling_strength_is_rejected(spark):
    rng = random.Random(11)
    share = lambda middle, wide: math.exp(rng.gauss(middle, wide))
    clean = [(i, varied(rng, share(-3.5, 0.8), share(-2.2, 0.7), share(-4.5, 0.8), int(rng.lognormvariate(5, 0.6)) + 20), "en", "s") for i in range(400)]
    junk = [(1000 + i, varied(rng, 0.5, 0.6, 0.3, 120), "en", "s") for i in range(40)]
    out = {r["doc_id"]: r["kept"] for r in outliers.reject_outliers(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert not any(out[i] for i, *_ in junk)
    assert all(out[i] for i, *_ in clean)


def test_the_cut_matches_estimates_by_full_sorting(spark):
    """500 texts of one group, a tenth of them odd: the estimate of many starts whose steps sort all distances."""
    import numpy as np

    rng = random.Random(41)
    rows = []
    for i in range(500):
        odd = i % 10 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 30 if odd else 8))) for _ in range(rng.randint(30, 300))]
        words = [w.upper() + "#$" if odd and rng.random() < 0.5 else w.title() if rng.random() < 0.1 else w for w in words]
        rows.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), "en", "web"))
    found = outliers.reject_outliers(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert not any(r["base_failed"] for r in found)

    names = dict(vars(math))
    x = np.array([[eval(e, {**names, "ln": math.log}, r.asDict()) for e, _ in outliers.STATISTICS.values()] for r in found])
    floor = np.diag([f**2 for _, f in outliers.STATISTICS.values()])
    held, k, best = int(0.75 * len(x)), x.shape[1], None
    draw = np.random.default_rng(5)
    for start in range(40):
        some = x[draw.choice(len(x), k + 1, replace=False)] if start else x
        before = math.inf
        while True:
            centre, cov = some.mean(axis=0), np.cov(some.T, bias=True) + floor
            distance = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(cov), x - centre)
            some = x[np.argsort(distance)[:held]]
            det = np.linalg.slogdet(np.cov(some.T, bias=True) + floor)[1]
            if det > before - 1e-9:
                break
            before = det
        if best is None or before < best[0]:
            centre, cov = some.mean(axis=0), np.cov(some.T, bias=True) + floor
            best = before, np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(cov), x - centre)
    mine = np.array([r["distance"] for r in found])
    # The last bin of distances counts in part, so the estimates differ by little.
    assert np.abs(np.log(mine / best[1])).max() < 0.25
    kept = np.array([r["kept"] for r in found])
    assert not kept[::10].any() and kept.sum() >= 440
    cut = mine[kept].max()
    assert ((best[1] <= cut) == kept)[np.abs(np.log(best[1] / cut)) > 0.25].all()


def test_small_groups_and_clashing_columns(spark):
    rows = [(1, "word " * 5, None, None, 7), (2, None, "en", "x", 8), (2, None, "en", "x", 8), (3, " ".join(f"w{i}" for i in range(50)), "en", None, 9)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_words int").withColumn("row", F.lit(1)).withColumn("x", F.lit(2)).withColumn("g1", F.lit(3))
    out = outliers.reject_outliers(df)
    assert {"row", "x", "g1"} <= set(out.columns) and out.columns.count("n_words") == 1
    got = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in out.collect())
    assert got == [(1, 5, False), (2, 0, False), (2, 0, False), (3, 50, True)]
    assert outliers.reject_outliers(df.limit(0)).count() == 0


def token_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(text, items, size=10):
    w, hit, found = token_words(text), set(), set()
    for item, said in items:
        b = token_words(said)
        n = min(size, len(b))
        for j in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_matches_plain_python(spark):
    rng = random.Random(5)
    vocab = ["The", "of", "ünder", "x1", "and", "to"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, say(14)), (2, "of The"), (10, say(10)), (None, say(12)), (4, None), (5, "... --"), (1, say(11))]
    rows = [(i, say(rng.randint(0, 60)) + "; " + (items[i % 3][1] or "") + "-" + say(5), "en", "s") for i in range(80)]
    rows += [(90, None, None, None), (91, "", "en", "s"), (92, "," * 5000, "en", "s"), (92, "OF the", "en", "s")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("items", F.lit(1)).withColumn("words", F.lit(2))
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = sorted((i, *contamination(t, items)) for i, t, *_ in rows)
    for block in (decontam.BLOCK_BYTES, 40):  # one block, and many
        out = decontam.find_contamination(df, bench, block_bytes=block)
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out.collect())
        assert got == want
        assert all(r["contaminated"] == (r["n_hit"] > 0) for r in out.collect())
    kept = sorted(r["doc_id"] for r in decontam.decontaminate(df, bench).collect())
    assert kept == sorted(i for i, _, h, _ in want if h == 0)
    assert decontam.decontaminate(df, bench).columns == df.columns
    cut = decontam.find_contamination(decontam.decontaminate(df, bench.where("item_id = 10"), remove="spans"), bench.where("item_id = 10"))
    assert cut.where("n_words > 0").count() > 0
    assert decontam.find_contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.find_contamination(df.limit(0), bench).count() == 0


def test_a_large_test_set_is_scanned_block_by_block(spark, monkeypatch):
    """Several blocks give the spans, items and cut texts of one, and no block is held beside another."""
    rng = random.Random(17)
    word = lambda: rng.choice("ab bc cd de ef fg gh hi ij jk".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 14, 30, 11, 3, 25, 40, 10])]
    items += [(90, items[2][1]), (None, items[3][1]), (91, ""), (92, None), (2, items[2][1])]
    docs = [(i, " , ".join(rng.choices([t for _, t in items if t], k=3)) if i % 3 else " ".join(word() for _ in range(40)), "x") for i in range(24)]
    docs += [(30, None, "x"), (31, "", None), (5, docs[5][1], "x"), (32, "zz " * 3000 + items[6][1], "x")]
    df = spark.createDataFrame(docs, "doc_id int, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    shape = lambda d: sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]], r["contaminated"]) for r in d.collect())
    one = decontam.find_contamination(df, bench)
    held = []
    share = decontam._share
    monkeypatch.setattr(decontam, "_share", lambda block: held.append(sum(len(r["words"]) for r in block.collect())) or share(block))
    many = decontam.find_contamination(df, bench, block_bytes=150)
    assert many.columns == one.columns and shape(many) == shape(one)
    assert len(held) > 3 and sum(held) == sum(len(t or "") for _, t in items) and max(held) < sum(held) / 2
    cut = lambda **o: sorted((r["doc_id"], r["text"] or "") for r in decontam.decontaminate(df, bench, remove="spans", **o).collect())
    assert cut(block_bytes=150) == cut()
    assert decontam.find_contamination(df.limit(0), bench, block_bytes=150).count() == 0


def test_tokenizer_calls_are_filled_by_bytes(monkeypatch):
    """Short texts share a call, no call is larger than its bytes and one piece, and forgetting changes no count."""
    import public_tokenizers as P

    name = "word_bpe_49k.json"
    rng = random.Random(3)
    lot = ["".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(3000)]
    texts = ["", *(" ".join(rng.choices(lot, k=rng.randint(0, 60))) for _ in range(400)), " ".join(lot), "", lot[0]]
    want = tokencount._Counter(P.path(name)).count(texts)
    monkeypatch.setattr(tokencount, "CALL_BYTES", 4096)
    for kept, kept_bytes in ((300_000, 32 << 20), (50, 32 << 20), (300_000, 500)):
        monkeypatch.setattr(tokencount, "KEPT", kept)
        monkeypatch.setattr(tokencount, "KEPT_BYTES", kept_bytes)
        counter, calls = tokencount._Counter(P.path(name)), []
        encode = counter.encode
        counter.encode = lambda batch: calls.append(sum(len(x.encode()) for x in batch)) or encode(batch)
        assert counter.count(texts) == want
        assert max(calls) < 4096 + 10
        if kept_bytes > 500 and kept > 50:
            assert len(calls) < len(texts) / 4


def test_spans_are_cut_out_of_the_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"Before, ({item.upper()}) after.", "en", "s"), (2, None, "en", "s")], SCHEMA)
    out = decontam.decontaminate(df, spark.createDataFrame([(1, item)], "item_id int, text string"), remove="spans")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Before, () after.", 2: None}


def test_contamination_query_against_plain_python(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    grams = {}
    for item, said in items:
        b = token_words(said)
        for j in range(len(b) - min(10, len(b)) + 1 if b else 0):
            grams.setdefault(tuple(b[j : j + 10]), set()).add(str(item))
    for r in queries.QUERIES["op3_decontaminate"](spark, DIR).collect():
        w, hit, found = token_words(texts[r["doc_id"]]), set(), set()
        for i in range(len(w)):
            for n in {len(g) for g in grams}:
                if tuple(w[i : i + n]) in grams and i + n <= len(w):
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), digest, bool(hit))


def test_token_counts_match_the_libraries(spark, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = [*ODD, "it's <|endoftext|> a <|startoftext|>x", "é ́ á ΑΣ ΑΣ.", "long" * 3000, "Line\none\r\n two  three " * 400, *list(texts.values())[:60]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").withColumn("n_bytes", F.lit("old"))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        if name.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=P.path(name))
            count = lambda t: len(model.encode(t))
        else:
            model = Tokenizer.from_file(P.path(name))
            count = lambda t: len(model.encode(t, add_special_tokens=False))
        for r in tokencount.count_tokens(df, P.path(name)).collect():
            text = rows[r["i"]] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), count(text)), (name, text[:60])
            assert r["over_limit"] == (r["n_tokens"] > 2048)
    assert tokencount.count_tokens(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_languages_on_held_out_documents(spark, docs):
    found = {r["doc_id"]: r for r in queries.QUERIES["op2_language"](spark, "/root/testdata/sf0.01").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert set(found) == set(lang)
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [k for k in found if found[k]["held_out"]]
    assert sum(found[k]["lang_pred"] == lang[k] for k in held) >= 0.98 * len(held)


def test_languages_of_odd_texts(spark, docs):
    rows = [(1, None, None, "s"), (2, "", "en", "s"), (3, "123 ... 456", "en", "s"), (4, "é", "fr", "s"), (5, "漢字" * 700000, "zh", "s"), (5, "漢字", "zh", "s")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("old"))
    out = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in hdlang.identify(df, docs).collect())
    assert [x[1] for x in out[:3]] == ["und"] * 3 and [x[2] for x in out[:3]] == [0.0] * 3
    assert {x[1] for x in out[3:]} <= {"en", "de", "fr", "es"} and all(0 <= x[2] <= 1 for x in out)
    assert {r["lang_pred"] for r in hdlang.identify(df, docs.limit(0)).collect()} == {"und"}
    assert hdlang.identify(df.limit(0), docs).count() == 0


def naive_bundle(text):
    """The sum of a text's trigram vectors, one by one, and their number."""
    import numpy as np

    vector = lambda c: np.random.Generator(np.random.Philox(key=c)).integers(0, 2, hdlang.DIMENSIONS, dtype=np.int8) * 2 - 1
    points = [0]
    for c in text.lower():
        if c.isalpha() or points[-1]:
            points.append(ord(c) if c.isalpha() else 0)
    points += [0] if points[-1] else []
    total, n = np.zeros(hdlang.DIMENSIONS), max(0, len(points) - 2)
    for i in range(n):
        first, second, third = (vector(c).tolist() for c in points[i : i + 3])
        for d in range(hdlang.DIMENSIONS):
            total[d] += first[d - 2] * second[d - 1] * third[d]
    return total, n


def test_languages_match_a_double_loop(spark):
    import numpy as np

    say = {"en": ["The cat sat on the mat.", "a dog, and 3 birds"], "de": ["Der Hund läuft über die Straße", "und das Kätzchen"], "fr": ["l'été où çà et là"]}
    taught = [(i, t, lang, None) for i, (lang, t) in enumerate((lang, t) for lang, ts in say.items() for t in ts)]
    taught += [(90, None, "en", None), (91, "no language", None, None), (92, "123", "de", None)]
    asked = ["the hat and the mat", "Straße und Hund", "été là", "x", "ΑΣ ΑΣ.", "--", "the the the the"]
    prototypes = {lang: sum(v / n for v, n in map(naive_bundle, ts)) for lang, ts in say.items()}
    found = hdlang.identify(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(asked)], SCHEMA), spark.createDataFrame(taught, SCHEMA))
    for r in found.collect():
        mine, n = naive_bundle(asked[r["doc_id"]])
        if not n:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosine = {k: float(mine @ p / np.linalg.norm(mine) / np.linalg.norm(p)) for k, p in prototypes.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r["lang_pred"] == best and abs(r["score"] - max(0.0, cosine[best])) < 1e-5


def test_pieces_of_a_long_text_add_up(monkeypatch):
    import numpy as np

    text = "the quick brown fox jumps over the lazy dog " * 30
    whole = hdlang._bundles([text, "", None, "ab"])
    monkeypatch.setattr(hdlang, "LETTERS", 100)
    monkeypatch.setattr(hdlang, "GRAMS", 7)
    assert np.array_equal(whole, hdlang._bundles([text, "", None, "ab"])) and not whole[1].any()


def test_quality_on_held_out_documents(spark):
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [k for k in labels if found[k]["held_out"]]
    good = [found[k]["score"] for k in held if labels[k] == 1]
    bad = [found[k]["score"] for k in held if labels[k] == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_quality_model_matches_a_plain_solver():
    """Ratios by counting; the hinge loss's optimum by projected gradient over all rows at once."""
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 12, 5)) * 7 + 3 for _ in range(30)]
    labels = np.array([int(len(x) + rng.integers(0, 3) > 5) for x in rows])
    labels[:2] = 0, 1
    model, ratio = nbsvm.fit_shard(rows, labels, rounds=3000)

    count = lambda g, y: 1 + sum(int(g in x.tolist()) for x, z in zip(rows, labels) if z == y)
    total = {y: nbsvm.BUCKETS + sum(len(x) for x, z in zip(rows, labels) if z == y) for y in (0, 1)}
    want = {g: math.log(count(g, 1) / total[1]) - math.log(count(g, 0) / total[0]) for g in range(3, 90, 7)}
    assert all(abs(ratio[g] - w) < 1e-9 for g, w in want.items())

    dense = np.zeros((len(rows), 90))
    for i, x in enumerate(rows):
        dense[i, x] = [want[g] for g in x.tolist()]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    sign = np.where(labels == 1, 1.0, -1.0)
    bound = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    gram = (dense @ dense.T + 1) * np.outer(sign, sign)
    alpha, step = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(60000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, bound)
    margins = sign * (gram @ alpha)
    size = [np.linalg.norm(ratio[x]) for x in rows]
    mine = np.array([model[x].sum() / s + model[-1] for x, s in zip(rows, size)])
    assert np.abs(mine - margins).max() < 1e-3


def test_quality_of_odd_texts_and_without_labels(spark, docs):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "a " * 50000, "en", "s"), (3, "a " * 50000, "en", "s")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("y", F.lit(1)).withColumn("score", F.lit("old"))
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    out = sorted((r["doc_id"], r["score"]) for r in nbsvm.score_quality(df, docs, labels).collect())
    assert all(0 <= s <= 1 for _, s in out) and out[0][1] == out[1][1] and out[2] == out[3]
    assert {r["score"] for r in nbsvm.score_quality(df, docs, labels.limit(0)).collect()} == {0.5}
    assert nbsvm.score_quality(df.limit(0), docs, labels).count() == 0

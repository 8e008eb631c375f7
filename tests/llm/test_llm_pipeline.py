"""The corpus pipeline, stage by stage, against plain Python."""

import importlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_joins import jaccard_classes
from test_llm_tables import n_words, targets
from test_llm_texts import contamination

import __spark_entry__ as entry
import corpus_pipeline as pipeline

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the rows of every stage."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(pipeline.written(stage(spark, out[-1], DIR), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "mixture"]
    assert all(s.schema == stages[0].schema for s in stages[1:])
    assert entry.queries()["pipeline"] is pipeline.run


def test_language_keeps_all_texts_with_letters(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == {k for k, r in before.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert all(after[k] == before[k] for k in after)


def test_gibberish_goes_and_short_texts_stay(stages, spark):
    """One rule for all lengths: unknown letters go from some hundred on, a few words of a language stay."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("qxzjvkwfybp") for _ in range(n))
    known = [r["text"] for r in stages[0].where("lang = 'en' and length(text) > 400").limit(40).collect()]
    new = [(-1 - i, noise(n), n) for i, n in enumerate([100, 150, 199, 201, 600, 5000] * 5)]
    clean = [(-1000 - i, t[:n], n) for i, t in enumerate(known) for n in (rng.choice([1, 5, 20, 60]), 199, 201)]
    df = spark.createDataFrame([(k, t) for k, t, _ in new + clean], "doc_id bigint, text string")
    docs = stages[0].unionByName(df, allowMissingColumns=True)
    left = {(r["doc_id"], r["text"]) for r in pipeline.language(spark, docs, DIR).where("doc_id < 0").collect()}
    assert left == {(k, t) for k, t, _ in clean if any(c.isalpha() for c in t)}


def test_lines_keep_the_first_of_equal_ones(stages):
    before, after = rows(stages[1]), rows(stages[2])
    first, want = {}, {}
    for k in sorted(before):
        kept = []
        for n, line in enumerate(before[k]["text"].split("\n")):
            if len(line) < 32 or first.setdefault(line, (k, n)) == (k, n):
                kept.append(line)
        want[k] = "\n".join(kept)
    for k, text in want.items():  # links of two edits may take a little more
        if k in after:
            assert set(after[k]["text"].split("\n")) <= set(text.split("\n")) and after[k]["n_chars"] == len(after[k]["text"])
        else:
            assert all(len(x) < 32 for x in text.split("\n")) or text != before[k]["text"]
    same = [k for k in want if want[k] == before[k]["text"]]
    assert sum(k in after and after[k]["text"] == want[k] for k in same) >= 0.95 * len(same)


def test_one_of_each_near_copy_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    classes = jaccard_classes([(k, r["text"]) for k, r in before.items()])
    assert set(after) == {k for k in before if classes[k][1] == k}


def test_benchmark_passages_are_gone(stages, spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) == {k for k, r in before.items() if contamination(r["text"], items)[1] == 0}


def test_mixture_meets_its_targets(stages):
    before = stages[4].collect()
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += n_words(r["text"])
        most[r["source"]] = max(most[r["source"]], n_words(r["text"]))
    for r in stages[5].collect():
        taken[r["source"]] += n_words(r["text"])
    want = targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes)


def test_odd_rows_pass_through(spark, tmp_path):
    say = lambda n: " ".join(random.Random(n).choice(["the", "and", "thing", "other", "word"]) for _ in range(60))
    odd = [(None, say(1), None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "123", None, "a", 3), (4, say(2), "en", "b", 9), (4, say(2), "en", "b", 9), (5, "x " * 100000, "en", "a", None)]
    df = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.withColumns({c: F.lit(1) for c in ("score", "n_dropped", "node", "size", "items", "shard", "line", "key")})
    spark.createDataFrame([(1, "never said before by anyone")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (df, df.limit(0)):
        for name, stage in pipeline.STAGES:
            out = pipeline.written(stage(spark, frame, str(tmp_path)), name)
            assert out.columns == df.columns
            frame = out
    assert frame.count() == 0


def test_the_rest_stands_without_it(monkeypatch):
    assert entry._if_there("mediaspark.llm.nothing") is None and entry._if_there("nothing_at_all") is None
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("mediaspark.llm.nothing")

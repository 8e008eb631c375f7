"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear hinge-loss model."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 18
KEPT = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
_words: dict[bytes, tuple[int, int]] = {}


def _shape(word: str) -> str:
    """What a word looks like: case of its letters and its outer marks, not which letters."""
    letters = "".join(_LETTERS.findall(word))
    case = "-" if not letters else "U" if len(letters) > 1 and letters.isupper() else "T" if letters[0].isupper() else "l" if letters.islower() else "m"
    ends = "".join(c for c in (word[0], word[-1]) if not c.isalnum())
    return f"{case}{ends}{'d' if any(c.isdigit() for c in word) else ''}{min(len(letters), 12) // 4}"


def _word(raw: bytes) -> tuple[int, int]:
    if len(_words) >= KEPT:
        _words.clear()
    word = raw.decode()
    _words[raw] = found = (zlib.crc32(word.lower().encode()), zlib.crc32(b"shape " + _shape(word).encode()))
    return found


def features(text: str | None) -> np.ndarray:
    """Numbers of the n-grams that occur: words and pairs of words, and one to three shapes in a row."""
    words = (text or "").encode().split()
    known = _words
    both = np.array([known.get(w) or _word(w) for w in words], dtype=np.uint64).reshape(-1, 2)
    same = np.concatenate(([False], both[1:, 0] == both[:-1, 0])) if len(both) else np.zeros(0, dtype=bool)
    word, shape = both[:, 0], both[:, 1] * 2 + same
    size = np.uint64(1 << 40 | len(words).bit_length())
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    grams = [np.array([size]), word, word[1:] * a + word[:-1] + np.uint64(1), shape * b, shape[1:] * a + shape[:-1] * b, shape[2:] * a + shape[1:-1] * b + shape[:-2] * np.uint64(31)]
    mixed = np.concatenate(grams) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique((mixed >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features(x) for x in texts.to_pylist()], pa.list_(pa.int32()))


def fit_shard(rows: list[np.ndarray], labels: np.ndarray, *, cost: float = 1.0, rounds: int = 12, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights per n-gram with the bias at the end, and the log-count ratios, by dual coordinate descent on the hinge loss.

    The indicator of an n-gram is scaled by the logarithm of its count ratio between the classes, and a text's
    vector to length 1.  The rarer class weighs as much as the other.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    at = np.concatenate(rows)
    owner = np.repeat(sign, [len(x) for x in rows])
    good = smooth + np.bincount(at[owner > 0], minlength=BUCKETS)
    bad = smooth + np.bincount(at[owner < 0], minlength=BUCKETS)
    ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    values = [ratio[x] / max(1e-9, float(np.linalg.norm(ratio[x]))) for x in rows]
    share = np.array([(sign > 0).mean(), (sign < 0).mean()])
    bound = cost * np.where(sign > 0, 0.5 / max(share[0], 1e-9), 0.5 / max(share[1], 1e-9))
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(BUCKETS), 0.0
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)).tolist():
            x, v, y = rows[i], values[i], sign[i]
            slope = y * (weights[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), bound[i])
            if new != alpha[i]:
                weights[x] += (new - alpha[i]) * y * v
                bias += (new - alpha[i]) * y
                alpha[i] = new
    return np.append(weights * ratio, bias), ratio


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", "y"], kind="stable")
    labels = pdf["y"].to_numpy()
    if len(set(labels.tolist())) < 2:
        return pd.DataFrame({"gram": pd.Series(dtype="int32"), "weight": pd.Series(dtype="float64"), "scale": pd.Series(dtype="float64")})
    model, ratio = fit_shard([np.asarray(x) for x in pdf["grams"]], labels)
    used = np.flatnonzero(model)
    return pd.DataFrame({"gram": used.astype("int32"), "weight": model[used], "scale": np.append(ratio, 0.0)[used]})


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 16_384, shard: int = 4_096, text: str = "text", label: str = "quality"):
    """The model ``(weights, ratios)``: the mean of models fitted on disjoint shards of labelled rows.

    At most ``sample`` labelled documents are taken, those with the smallest hash of their id; each shard of
    about ``shard`` of them is fitted in a task of its own.  Only a number per n-gram bucket reaches the driver.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = picked.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(sample)
    # At most ``sample`` rows of three numbers: safe to broadcast whatever the tables' sizes.
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("at", "y", _features("text").alias("grams"))
    shards = max(1, round(sample / shard))
    fitted = rows.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards))).groupBy("shard").applyInPandas(_fit, "gram int, weight double, scale double")
    model, ratio = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in fitted.groupBy("gram").agg((F.sum("weight") / shards).alias("w"), (F.sum("scale") / shards).alias("s")).collect():
        model[r["gram"]], ratio[r["gram"]] = r["w"], r["s"]
    return model, ratio[:-1]


def score_quality(docs: DataFrame, training: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted to every row of ``docs``.

    The score reads the text alone.  ``training`` gives the texts and ``labels`` the classes to learn from; see
    ``train`` for the bound on labelled rows.  Documents are scored where they stand, without a shuffle.

    Null and empty texts have one n-gram, that of their length, and get a score too; without labels of both
    classes every score is 0.5.  A document labelled twice counts once, by its higher label; repeated rows are
    scored alike; very long texts are scored whole.  A score of exactly 0.5 is predicted 1.  An empty table stays
    empty.  Columns named score and predicted are replaced, others kept.
    """
    spark = docs.sparkSession
    model, ratio = train(training, labels, text=text, **options)
    shared = spark.sparkContext.broadcast((model, ratio))
    found = docs.withColumn("score", _shared_score(shared)(F.col(text)))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _shared_score(shared):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model, ratio = shared.value
        out = []
        for text in texts.to_pylist():
            grams = features(text)
            size = max(1e-9, float(np.linalg.norm(ratio[grams])))
            margin = float(model[grams].sum()) / size + float(model[-1])
            out.append(1.0 / (1.0 + float(np.exp(-np.clip(3.0 * margin, -60, 60)))))
        return pa.array(out, pa.float64())

    return score


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether a document is kept from learning, by the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))

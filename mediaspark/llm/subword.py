"""Toxicity: bags of subword embeddings, averaged over short runs of words, under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 17
#: Lengths of the character n-grams, the marks of a word's two ends counted.
SIZES = (3, 4, 5, 6)
#: Words that are averaged together.
RUN = 4
#: Runs whose mean margin is a text's: its most toxic ones.
TOP = 2
#: Code points after which a text is cut at the next blank, so that memory doesn't grow with its length.
PIECE = 1 << 16
#: Code points that are handled at once.
SLICE = 1 << 18

_IN_WORD = np.array([chr(c).isalnum() for c in range(128)])
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def pieces(text: str | None) -> Iterator[str]:
    """A text in lower case, cut at the first blank after each ``PIECE`` code points; a longer word is cut hard."""
    low = (text or "").lower()
    at = 0
    while len(low) - at > PIECE:
        blank = next((i for i in range(at + PIECE, min(at + 2 * PIECE, len(low))) if low[i].isspace()), at + 2 * PIECE)
        yield low[at:blank]
        at = blank
    yield low[at:]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords, the word each belongs to (rising), and the text each word belongs to.

    A word is a run of letters and digits; its subwords are its n-grams, end marks included, and itself.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = (codes >= 128) | _IN_WORD[np.minimum(codes, 127)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    word = np.cumsum(opens) - 1
    mixed = (np.where(inside, codes, 0).astype(np.uint64) + np.uint64(1)) * _B
    mixed ^= mixed >> np.uint64(29)
    found, owner = [], []
    for n in SIZES:
        last = len(codes) - n + 1
        if last <= 0:
            continue
        whole = inside[1 : last + 1].copy()
        for j in range(2, n - 1):
            whole &= inside[j : last + j]
        at = np.flatnonzero(whole)
        gram = np.full(len(at), n, np.uint64)
        for j in range(n):
            gram = gram * _A + mixed[at + j]
        found.append(gram)
        owner.append(word[at + 1])
    heads = np.flatnonzero(opens)
    if len(heads):
        at = np.flatnonzero(inside)
        place = at - heads[word[at]]
        powers = np.full(int(place.max()) + 1, _A)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        found.append(np.add.reduceat(mixed[at] * powers[place], np.flatnonzero(opens[at])) * np.uint64(31))
        owner.append(np.arange(len(heads)))
    gram = np.concatenate(found) if found else np.zeros(0, np.uint64)
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    gram = gram[order]
    bucket = ((gram ^ gram >> np.uint64(31)) * _C >> np.uint64(40)) % np.uint64(BUCKETS)
    return bucket.astype(np.int32), owner[order], np.searchsorted(np.cumsum(sizes) - sizes + 1, heads, side="right") - 1


def runs_of(word_text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of each word, and the text of each run; runs never cross texts."""
    words = np.bincount(word_text, minlength=texts)
    runs = -(-words // RUN)
    place = np.arange(len(word_text)) - (np.cumsum(words) - words)[word_text]
    return (np.cumsum(runs) - runs)[word_text] + place // RUN, np.repeat(np.arange(texts), runs)


def highest(margin: np.ndarray, owner: np.ndarray, top: int = TOP) -> np.ndarray:
    """Places of the ``top`` highest margins of each owner (rising); the first of equal ones."""
    left, picked = margin.astype(np.float64, copy=True), []
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    for _ in range(top if len(heads) else 0):
        best = np.maximum.reduceat(left, heads)
        size = np.diff(np.append(heads, len(left)))
        at = np.flatnonzero((left == np.repeat(best, size)) & (left > -np.inf))
        at = at[np.diff(owner[at], prepend=-1) != 0]
        picked.append(at)
        left[at] = -np.inf
    return np.sort(np.concatenate(picked)) if picked else np.zeros(0, np.int64)


class Bag:
    """Labelled texts as a table of distinct words: their subwords, and the words of each run."""

    def __init__(self, texts: list[str], least: int):
        parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
        piece_text = np.array([i for i, _ in parts], dtype=np.int64)
        grams, sizes, keys, words = [], [], [], []
        for a, b in _slices([p for _, p in parts]):
            bucket, owner, text = subwords([p for _, p in parts[a:b]])
            size = np.bincount(owner, minlength=len(text))
            if len(text):
                keys.append(np.add.reduceat((bucket.astype(np.uint64) + np.uint64(1)) * _A, np.cumsum(size) - size) * _C + size.astype(np.uint64))
            grams.append(bucket)
            sizes.append(size)
            words.append(text + a)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        gram, piece = np.concatenate(grams), np.concatenate(words).astype(np.int64)
        _, first, self.word = np.unique(key, return_index=True, return_inverse=True)
        self.words = len(first)
        start = (np.cumsum(size) - size)[first]
        self.size = np.maximum(size[first], 1)
        self.owner = np.repeat(np.arange(self.words), size[first])
        self.gram = gram[np.arange(len(self.owner)) - np.repeat(np.cumsum(size[first]) - size[first], size[first]) + np.repeat(start, size[first])]
        self.run, run_piece = runs_of(piece, len(parts))
        self.run_text = piece_text[run_piece]
        self.run_size = np.bincount(self.run, minlength=len(self.run_text))
        self.heads = np.cumsum(self.run_size) - self.run_size
        # Subwords that few texts hold say more of those texts than of their class.
        pairs = np.unique(piece_text[piece] * self.words + self.word) if self.words else np.zeros(0, np.int64)
        held = np.bincount(pairs % max(self.words, 1), minlength=self.words)
        common = np.bincount(self.gram, weights=held[self.owner], minlength=BUCKETS) >= least
        kept = common[self.gram]
        self.gram, self.owner = self.gram[kept], self.owner[kept]
        self.common = common
        self.first = np.searchsorted(self.owner, np.arange(self.words + 1))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` code points."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def fit(texts: list[str], labels: np.ndarray, *, dim: int = 8, rounds: int = 60, rate: float = 0.3, least: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword vectors, softmax weights and bias, trained together on the labels of whole texts.

    A word's vector is the mean of its subwords', a run's that of its words; the softmax reads the run.  A text's
    margin is the mean of its ``TOP`` highest runs, so its loss reaches those runs, and through them the vectors.
    Steps have the length of the largest gradient of late, not of each coordinate's, so rare subwords move little.
    """
    bag, n = Bag(texts, least), len(labels)
    rng = np.random.default_rng(seed)
    vectors, weights, bias = (rng.random((BUCKETS, dim)) - 0.5) / dim, (rng.random((dim, 2)) - 0.5) / dim, np.zeros(2)
    vectors[~bag.common] = 0.0
    if not bag.words or len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if n else 0.5
        return vectors * 0, weights, np.array([0.0, np.log((share * n + 1) / ((1 - share) * n + 1))])
    target = np.stack([1 - labels, labels], 1).astype(float)
    moved, longest = [np.zeros_like(p) for p in (vectors, weights, bias)], [0.0, 0.0, 0.0]
    for _ in range(rounds):
        # Margins of all runs need one number per subword; vectors only those of the runs picked.
        pull = vectors @ (weights[:, 1] - weights[:, 0])
        word = np.bincount(bag.owner, weights=pull[bag.gram], minlength=bag.words) / bag.size
        margin = np.add.reduceat(word[bag.word], bag.heads) / bag.run_size
        at = highest(margin, bag.run_text)
        text = bag.run_text[at]
        share = 1.0 / np.bincount(text, minlength=n)[text]
        place = np.concatenate([np.arange(bag.heads[r], bag.heads[r] + bag.run_size[r]) for r in at])
        of_run = np.repeat(np.arange(len(at)), bag.run_size[at])
        used, slot = np.unique(bag.word[place], return_inverse=True)
        spans = bag.first[used + 1] - bag.first[used]
        sub = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(bag.first[used], spans)
        gram, owner = bag.gram[sub], np.repeat(np.arange(len(used)), spans)
        by_word = _sums(vectors[gram] / bag.size[used][owner, None], owner, len(used))
        mean = _sums(by_word[slot] / bag.run_size[at][of_run, None], of_run, len(at))
        hidden = _sums(mean * share[:, None], text, n)
        logits = hidden @ weights + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        wrong = (odds / odds.sum(1, keepdims=True) - target) / n
        back = (wrong @ weights.T)[text] * share[:, None]
        to_word = _sums(back[of_run] / bag.run_size[at][of_run, None], slot, len(used))
        slopes = (_sums(to_word[owner] / bag.size[used][owner, None], gram, BUCKETS), hidden.T @ wrong, wrong.sum(0))
        for i, (p, slope, step) in enumerate(zip((vectors, weights, bias), slopes, (8.0, 1.0, 0.2), strict=True)):
            longest[i] = max(longest[i] * 0.9, float(np.linalg.norm(slope)) + 1e-12)
            moved[i] = 0.8 * moved[i] + slope / longest[i]
            p -= rate * step * moved[i]
    return vectors, weights, bias


def _sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], 1)


def margins(texts: list[str | None], pull: np.ndarray, bias: float) -> np.ndarray:
    """A text's margin: the mean of its ``TOP`` highest runs; that of no word at all is the bias."""
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    values, owners = [np.zeros(0)], [np.zeros(0, np.int64)]
    for a, b in _slices([p for _, p in parts]):
        own = np.array([i for i, _ in parts[a:b]], dtype=np.int64)
        bucket, owner, text = subwords([p for _, p in parts[a:b]])
        if not len(text):
            continue
        word = np.bincount(owner, weights=pull[bucket], minlength=len(text)) / np.bincount(owner, minlength=len(text))
        run, run_piece = runs_of(text, b - a)
        margin = np.bincount(run, weights=word) / np.bincount(run)
        at = highest(margin, own[run_piece])
        values.append(margin[at])
        owners.append(own[run_piece][at])
    value, owner = np.concatenate(values), np.concatenate(owners)
    at = highest(value, owner)
    total = np.bincount(owner[at], weights=value[at], minlength=len(texts))
    return total / np.maximum(np.bincount(owner[at], minlength=len(texts)), 1) + bias


def train(docs: DataFrame, labels: DataFrame, *, ones: int = 2_048, zeros: int = 4_096, sample_bytes: int = 32 << 20, text: str = "text", label: str = "toxic", **options) -> tuple[np.ndarray, float]:
    """The pull of each subword bucket towards label 1, and the bias, learned in one task of bounded size.

    At most ``ones`` and ``zeros`` labelled documents of the two classes are taken, those with the smallest hash of
    their id, and of them, in that order, as many as ``sample_bytes`` of text hold.  ``options`` go to ``fit``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("at", F.xxhash64("doc_id"))
    # Both limits are reached by a top-k in each task; ``ones + zeros`` rows of three numbers are safe to broadcast.
    pick = lambda y, n: known.where(F.col("y") == y).orderBy("at", "doc_id").limit(n)
    picked = F.broadcast(pick(1, ones).unionByName(pick(0, zeros)))
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, "doc_id").groupBy("doc_id").agg(
        F.first("y").alias("y"), F.first("at").alias("at"), F.max("text").alias("text")
    )
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("at", "doc_id"))
    held = rows.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "doc_id"])
        vectors, weights, bias = fit(pdf["text"].tolist(), pdf["y"].to_numpy(), **options)
        pull = vectors @ (weights[:, 1] - weights[:, 0])
        used = np.flatnonzero(pull)
        return pd.DataFrame({"bucket": np.append(used, -1).astype("int32"), "pull": np.append(pull[used], bias[1] - bias[0])})

    pull, bias = np.zeros(BUCKETS), 0.0
    fitted = held.select("doc_id", "y", "at", "text").groupBy(F.lit(0).alias("all")).applyInPandas(learn, "bucket int, pull double")
    for r in fitted.collect():
        if r["bucket"] < 0:
            bias = r["pull"]
        else:
            pull[r["bucket"]] = r["pull"]
    return pull, bias


def toxicity(text: Column, pull: np.ndarray, bias: float) -> Column:
    """Score of a text, 0 to 1, by a model of ``train``; null counts as the empty text."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast((pull, bias))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        pull, bias = shared.value
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(margins(texts.to_pylist(), pull, bias), -60.0, 60.0))), pa.float64())

    return score(text)


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on) to every row of ``docs``.

    The score reads the whole text and nothing else.  ``training`` gives the texts and ``labels`` the classes to
    learn from; ``train`` states the bounds of what is learned.  Documents are scored where they stand, without a
    shuffle, a very long text in pieces whose runs of words are independent.

    Null and empty texts, and those without letters and digits, get the score of the bias alone.  Ids labelled
    twice count once, by the higher label; of several texts under one id the last in order is learned; null ids
    and null labels teach nothing.  Without labels of both classes all texts get the share of the class there
    is, smoothed; 0.5 without any.  Of runs with equal margins the first are taken, which changes no score.
    Repeated rows score alike, an empty table stays empty.  Columns named score and predicted are replaced, all
    others kept.
    """
    pull, bias = train(training, labels, text=text, **options)
    found = docs.withColumn("score", toxicity(F.col(text), pull, bias))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

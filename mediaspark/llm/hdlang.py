"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
#: Letters and different trigrams that are worked on at a time, which bounds a worker's memory.
LETTERS = 1 << 18
GRAMS = 1 << 12
#: Texts whose vectors are held at a time.
TEXTS = 256
_IS_LETTER: list[np.ndarray] = []
_LETTER: dict[int, np.ndarray] = {}
SCALE = 1 << 20


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, 0 where anything else stands between; ends in 0s."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    points = np.where(_IS_LETTER[0][points], points, 0)
    points = np.concatenate(([0], points, [0]))
    return points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]


def _vector(point: int) -> np.ndarray:
    """A letter's random signs; they depend on the letter alone, so all workers agree."""
    if point not in _LETTER:
        if len(_LETTER) > 8192:
            _LETTER.clear()
        bits = np.random.Generator(np.random.Philox(key=point)).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _LETTER[point] = bits * 2 - 1
    return _LETTER[point]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts in runs of about LETTERS letters; a longer text comes in pieces that share two letters."""
    owners, held, size = [], [], 0
    for n, text in enumerate(texts):
        points = _letters(text) if text else np.zeros(1, dtype=np.int64)
        for start in range(0, max(1, len(points) - 2), LETTERS):
            piece = points[start : start + LETTERS + 2]
            owners.append(n)
            held.append(piece)
            size += len(piece)
            if size >= LETTERS:
                yield owners, held
                owners, held, size = [], [], 0
    if owners:
        yield owners, held


def _trigrams(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some pieces: piece, trigram number and count per trigram of a piece; all trigrams per piece; the vectors.

    Comes in blocks of GRAMS different trigrams, which bounds the memory in any script.
    """
    held = [x if len(x) > 2 else x[:0] for x in held]
    letters, ids = np.unique(np.concatenate(held), return_inverse=True)
    n, first = len(letters), np.cumsum([0, *map(len, held)])
    piece = np.repeat(np.arange(len(held)), np.diff(first))
    whole = np.ones(len(ids), dtype=bool)
    for stop in first[1:]:
        whole[max(0, stop - 2) : stop] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return
    code = (ids[at] * n + ids[at + 1]) * n + ids[at + 2]
    owned, counts = np.unique(piece[at] * n**3 + code, return_counts=True)
    owner, code = owned // n**3, owned % n**3
    total = np.bincount(owner, weights=counts, minlength=len(held))
    grams, where = np.unique(code, return_inverse=True)
    letter = np.stack([_vector(int(p)) for p in letters])
    for low in range(0, len(grams), GRAMS):
        some = grams[low : low + GRAMS]
        # A trigram binds its letters, each permuted as often as it stands from the end.
        bound = np.roll(letter, 2, axis=1)[some // n // n] * np.roll(letter, 1, axis=1)[some // n % n] * letter[some % n]
        mine = slice(None) if len(grams) <= GRAMS else (where >= low) & (where < low + GRAMS)
        yield owner[mine], where[mine] - low, counts[mine], total, bound.astype(np.float32)


def _bundles(texts: list[str | None]) -> np.ndarray:
    """The vector of each text: the sum of the vectors of its trigrams."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float64)
    for owners, held in _pieces(texts):
        for owner, where, counts, _, vectors in _trigrams(held):
            cuts = np.searchsorted(owner, np.arange(len(held) + 1))
            for i, n in enumerate(owners):
                if cuts[i] < cuts[i + 1]:
                    mine = slice(cuts[i], cuts[i + 1])
                    out[n] += counts[mine].astype(np.float32) @ vectors[where[mine]]
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition and language the sum of its texts' trigram shares, bound and bundled."""
    total: dict[str, np.ndarray] = {}
    for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, len(b), TEXTS)):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for owners, held in _pieces(texts):
            named = np.array([langs[n] for n in owners], dtype=object)
            for owner, where, counts, all_counts, vectors in _trigrams(held):
                share, lang = counts / all_counts[owner], named[owner]
                for name in set(lang.tolist()):
                    mine = lang == name
                    weights = np.bincount(where[mine], weights=share[mine], minlength=len(vectors)).astype(np.float32)
                    total[name] = total.get(name, 0) + np.rint((weights @ vectors).astype(np.float64) * SCALE).astype(np.int64)
    for name, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(vector, pa.int64())], names=["lang", "dim", "value"])


def learn_prototypes(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, prototype)``: a bundle of the trigram vectors of all texts with that language.

    Each text counts by its trigram shares, whatever its length.  Partitions add up their own bundles; what is
    shuffled is one number per dimension, language and partition.  Rows without language or text are left out.
    """
    seen = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    parts = seen.mapInArrow(_learn, "lang string, dim int, value bigint")
    sums = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda e: e["value"]).alias("prototype"))


def _judge(names: list[str], prototypes: np.ndarray):
    @F.arrow_udf("struct<lang:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for k in range(0, len(texts), TEXTS):
            bundle = _bundles(texts.slice(k, TEXTS).to_pylist())
            size = np.linalg.norm(bundle, axis=1)
            cosine = (bundle @ prototypes.T) / np.maximum(size, 1e-9)[:, None] if names else np.zeros((len(size), 0))
            for n, row in zip(size.tolist(), cosine, strict=True):
                best = int(np.argmax(row)) if n and names else None
                langs.append("und" if best is None else names[best])
                scores.append(0.0 if best is None else float(min(1.0, max(0.0, row[best]))))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return judge


def identify(docs: DataFrame, training: DataFrame, *, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row of ``docs``, by the prototypes that ``training`` teaches.

    A letter has a random vector of DIMENSIONS signs; a trigram's vector is the product of its letters'
    vectors, each rotated by its place; a text's vector is the sum over its trigrams, with runs of anything
    but letters counting as one blank.  The language is the one whose prototype has the largest cosine, the
    first by name on a tie; the score is that cosine, cut to 0..1.  Two passes over the texts, no shuffle of
    them; what reaches the driver is one vector per language.

    Null texts and texts without letters are ``und`` with score 0, and so is every text if nothing was
    learned.  Long texts are worked through in pieces and never cut short; repeated rows are judged alike; an
    empty table stays empty.  Columns named lang_pred and score are replaced, others are kept.
    """
    learned = sorted(learn_prototypes(training, text=text).collect())
    names = [r["lang"] for r in learned]
    prototypes = np.array([r["prototype"] for r in learned], dtype=np.float64).reshape(-1, DIMENSIONS)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    found = docs.withColumn("lang_pred", _judge(names, prototypes)(F.col(text)))
    return found.withColumns({"score": F.col("lang_pred.score"), "lang_pred": F.col("lang_pred.lang")})


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from learning, by the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))

"""Fill-in-middle: texts cut at two token ends and put out in another order by a scatter of bytes, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands before prefix, suffix and middle (fixed values).
MARKS = (b"<P>", b"<S>", b"<M>")
#: Bytes of text that are moved at once; one longer text makes a slice of its own.
SLICE = 1 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
#: Order of the three parts in the output, as places in (prefix, middle, suffix).
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
#: Mark ahead of each part.
MARK_OF = (0, 2, 1)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts without nulls, and where each text starts; the end last."""
    large = texts.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    starts = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[starts[0] : starts[-1]], starts - starts[0]


def _texts_of(held: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(held))])


def _slices(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` bytes."""
    cuts, n = [0], len(starts) - 1
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + SLICE, side="right")) - 1))
    return list(zip(cuts, cuts[1:], strict=False))


def _places(held: np.ndarray, starts: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where a mark stands whole within a text, and in which text."""
    at = np.flatnonzero(held[: max(0, len(held) - len(mark) + 1)] == mark[0])
    for j in range(1, len(mark)):
        at = at[held[at + j] == mark[j]]
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + len(mark) <= starts[text + 1]
    return at[inside], text[inside]


def _moved(size: int, heads: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Place of each byte after its part's shift: a difference array of the parts' heads, summed up."""
    kind = np.int32 if size < 1 << 29 else np.int64
    steps = np.zeros(size + 1, kind)
    np.add.at(steps, heads, np.diff(shifts, prepend=0).astype(kind))
    steps = np.cumsum(steps[:-1], dtype=kind)
    steps += np.arange(size, dtype=kind)
    return steps


def token_ends(held: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where tokens end: after a word, whose blanks stand ahead of it, and after blanks that end a text."""
    word = (held != 32) & ((held < 9) | (held > 13))
    ends = np.zeros(len(held), bool)
    ends[:-1] = word[:-1] & ~word[1:]
    ends[starts[1:][np.diff(starts) > 0] - 1] = True
    return np.flatnonzero(ends) + 1


def cut(held: np.ndarray, starts: np.ndarray, draws: np.ndarray, rate: int, spm: int) -> dict[str, np.ndarray]:
    """Tokens, form, and where middle and suffix begin, of each text; ``draws`` has four numbers a text."""
    n = len(starts) - 1
    ends = token_ends(held, starts)
    first = np.searchsorted(ends, starts[:-1], side="right")
    tokens = np.searchsorted(ends, starts[1:], side="right") - first
    picks = np.sort(draws[:, :2] % (tokens + 1)[:, None], axis=1)
    # After no token a part ends where the text starts; after k of them at the k-th end.
    known = np.append(ends, 0)
    at = np.where(picks > 0, known[np.minimum(first[:, None] + picks - 1, len(ends))], starts[:-1, None])
    form = np.where(draws[:, 2] % 100 >= rate, PLAIN, np.where(draws[:, 3] % 100 < spm, SPM, PSM))
    form[tokens == 0] = PLAIN
    for mark in MARKS:
        form[_places(held, starts, mark)[1]] = PLAIN
    assert len(form) == n
    return {"tokens": tokens, "form": form, "middle": at[:, 0], "suffix": at[:, 1]}


def scatter(held: np.ndarray, starts: np.ndarray, form: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The output's bytes and where each text's output starts."""
    parts = np.stack([starts[:-1], middle, suffix], 1)
    size = np.stack([middle - starts[:-1], suffix - middle, starts[1:] - suffix], 1)
    width = [len(MARKS[m]) for m in MARK_OF]
    total = size.sum(1) + np.where(form == PLAIN, 0, sum(width))
    out_starts = np.concatenate(([0], np.cumsum(total)))
    target = out_starts[:-1, None] + np.cumsum(size, 1) - size
    marked = []
    for kind, order in ORDER.items():
        rows = np.flatnonzero(form == kind)
        now = out_starts[rows].copy()
        for part in order:
            marked.append((MARKS[MARK_OF[part]], now.copy()))
            target[rows, part] = now + width[part]
            now += width[part] + size[rows, part]
    out = np.empty(out_starts[-1], np.uint8)
    out[_moved(len(held), parts.ravel(), (target - parts).ravel())] = held
    for mark, at in marked:
        for j, byte in enumerate(mark):
            out[at + j] = byte
    return out, out_starts


def gather(held: np.ndarray, starts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse: the texts that outputs of these forms were made of."""
    n = len(starts) - 1
    # A text that was moved holds none of the marks itself, so each stands once in its output.
    mark_at = np.repeat(starts[:-1, None], 3, axis=1)
    for m, mark in enumerate(MARKS):
        at, text = _places(held, starts, mark)
        moved = form[text] != PLAIN
        mark_at[text[moved], m] = at[moved]
    width = np.array([len(m) for m in MARKS])
    source, size = np.repeat(starts[:-1, None], 3, axis=1), np.zeros((n, 3), np.int64)
    size[:, 0] = np.diff(starts)
    source[:, 1:] = starts[1:, None]
    for kind, order in ORDER.items():
        rows = np.flatnonzero(form == kind)
        marks = [MARK_OF[p] for p in order]
        for i, part in enumerate(order):
            begin = mark_at[rows, marks[i]] + width[marks[i]]
            end = mark_at[rows, marks[i + 1]] if i < 2 else starts[rows + 1]
            source[rows, part], size[rows, part] = begin, end - begin
    out_starts = np.concatenate(([0], np.cumsum(size.sum(1))))
    heads = out_starts[:-1, None] + np.cumsum(size, 1) - size
    return held[_moved(int(out_starts[-1]), heads.ravel(), (source - heads).ravel())], out_starts


def _chars(held: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between two places: bytes that don't continue one."""
    so_far = np.concatenate(([0], np.cumsum((held & 0xC0) != 0x80)))
    return so_far[end] - so_far[begin]


RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _transform(rate: int, spm: int):
    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in RESULT.split(', '))}>")
    def moved(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        held, starts = _bytes_of(texts)
        draws = np.stack([h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)], 1)
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        done: dict[str, list] = {name: [] for name in names}
        for a, b in _slices(starts):
            part, at = held[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
            c = cut(part, at, draws[a:b], rate, spm)
            plain = c["form"] == PLAIN
            done["n"].append(pa.array(c["tokens"], pa.int64()))
            done["form"].append(pa.array(FORMS[c["form"]], pa.string()))
            done["prefix_chars"].append(pa.array(_chars(part, at[:-1], c["middle"]), pa.int64(), mask=plain))
            done["middle_chars"].append(pa.array(_chars(part, c["middle"], c["suffix"]), pa.int64(), mask=plain))
            done["output"].append(_texts_of(*scatter(part, at, c["form"], c["middle"], c["suffix"])).cast(texts.type))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), texts.type)
        return pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], k), *done[c]]) for c, k in zip(names, kinds, strict=True)], list(names))

    return moved


@F.arrow_udf(T.StringType())
def _restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    held, starts = _bytes_of(outputs)
    form = np.select([np.asarray(forms.to_numpy(zero_copy_only=False) == f) for f in FORMS[1:]], [PSM, SPM], PLAIN)
    done = [pa.array([], outputs.type)]
    for a, b in _slices(starts):
        done.append(_texts_of(*gather(held[starts[a] : starts[b]], starts[a : b + 1] - starts[a], form[a:b])).cast(outputs.type))
    return pa.concat_arrays(done)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of; null gives the empty text."""
    return _restored(F.coalesce(output, F.lit("")), F.coalesce(form, F.lit("plain")))


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output to every row.

    A text of n tokens is cut after two numbers of tokens that the hash of ``seed`` and its id draws; ``rate``
    percent of the texts are put out as suffix, prefix and middle (``spm`` percent of those: form spm) or prefix,
    suffix and middle (psm), each part behind its mark; the rest stay as they are (plain).  One pass without a
    shuffle, in memory that grows with a megabyte of texts, or with the longest one.

    Null and empty texts have no tokens and stay plain, with an empty output; texts that hold a mark stay plain;
    plain rows have null for the two lengths, which count code points.  Texts of blanks alone are one token.
    Rows of equal id and text come out alike; a null id draws as the empty id; ties don't occur.  An empty
    table stays empty.  Columns of the five new names are replaced, all others kept.
    """
    new = [c.split(" ")[0] for c in RESULT.split(", ")]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("__fim", _transform(rate, spm)(body, *draws))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[F.col(f"__fim.{c}").alias(c) for c in new])

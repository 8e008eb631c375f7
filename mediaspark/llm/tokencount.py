"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct pieces, and bytes of them, whose lengths a worker keeps; beyond either the memory starts afresh.
KEPT = 300_000
KEPT_BYTES = 32 << 20
#: Bytes of texts whose new pieces are learnt together, and of pieces that go to the tokenizer in one call.
CALL_BYTES = 1 << 20
#: Between two letters a blank always opens the next piece of a byte-level tokenizer.
LETTER_BLANK = re.compile(r"(?<=[a-z]) (?=[a-z])")


class _Counter:
    """Lengths of texts by one vocabulary file, remembered piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lengths: dict[bytes, int] = {}
        self.held = 0
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.pieces = lambda text: [text.encode()]
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.encode = lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]
        # Where white space makes no token, no token spans it, and each word stands alone.
        if self.encode([" ", "a b", "a \t\n b"]) == [0, 2, 2]:
            self.pieces = lambda text: text.encode().split()
        else:
            self.pieces = self._at_letters

    @staticmethod
    def _at_letters(text: str) -> list[bytes]:
        if len(text) < 4096:
            return [text.encode()]
        cuts = [0, *(m.start() for m in LETTER_BLANK.finditer(text)), len(text)]
        return [text[i:j].encode() for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        batch, held = [], 0
        for n, piece in enumerate(pieces, 1):
            batch.append(piece)
            held += len(piece)
            if held >= CALL_BYTES or n == len(pieces):
                self.lengths.update(zip(batch, self.encode([x.decode() for x in batch]), strict=True))
                batch, held = [], 0

    def _lengths(self, group: list[list[bytes]]) -> list[int]:
        known = self.lengths
        new = {x for pieces in group for x in pieces if x not in known}
        if len(known) + len(new) > KEPT or self.held + sum(map(len, new)) > KEPT_BYTES:
            known.clear()
            self.held, new = 0, {x for pieces in group for x in pieces}
        self._learn(list(new))
        self.held += sum(map(len, new))
        return [sum(map(known.__getitem__, pieces)) for pieces in group]

    def count(self, texts: list[str]) -> list[int]:
        """Lengths of the texts; their new pieces are learnt in groups of texts of about ``CALL_BYTES``."""
        out, group, held = [], [], 0
        for text in texts:
            group.append(self.pieces(text))
            held += sum(map(len, group[-1]))
            if held >= CALL_BYTES:
                out += self._lengths(group)
                group, held = [], 0
        return out + self._lengths(group)


@lru_cache(maxsize=4)
def _counter(path: str) -> _Counter:
    return _Counter(path)


def token_length(text: Column, path: str) -> Column:
    """Tokens of a text by the vocabulary at ``path``; null counts as the empty text."""

    @F.arrow_udf("bigint")
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(path).count([x or "" for x in texts.to_pylist()]), pa.int64())

    return lengths(text)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 2048, text: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to every row.

    ``path`` names a ``.json`` vocabulary of tokenizers or a ``.model`` of sentencepiece; no begin, end or
    added special tokens, no truncation or padding.  Texts are cut where no token can span the cut, equal
    pieces are encoded once, and calls are filled by bytes over the texts of a batch, so short texts share a
    call and a very long text costs what its words cost.
    One pass without a shuffle.  A null or empty text has 0 bytes and 0 tokens; repeated rows are counted
    alike; an empty table stays empty.  Other columns are kept; columns of the three new names are replaced.
    """
    tokens = token_length(F.col(text), path)
    out = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0)), "n_tokens": tokens})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

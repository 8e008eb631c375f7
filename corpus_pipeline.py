"""The corpus pipeline: language, repeated lines, near copies, benchmark passages, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.llm import decontam, hdlang, linededup, mixing, ngramjoin
from mediaspark.llm.common import load, written

#: Cosine with the nearest language below which a text without end is taken for no language at all.
LEAST_SCORE = 0.15
#: Deviations that a text of the language may fall short; of n trigrams' mean one is 1 / sqrt(n) of it.
SPREAD = 4.0


def _packed(docs: DataFrame) -> tuple[DataFrame, list]:
    """Id, text and the rest of the columns as one, whose names then can't clash; and the columns to select again."""
    own = ("doc_id", "text")
    rest = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    return packed, [F.col(c) if c in own else F.col(f"__rest.`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts, texts without letters and gibberish go.

    One bound for all lengths: it rises with the number of trigrams in the text's different words, whose mean the
    cosine is, from below 0 for a few words, which prove nothing, towards LEAST_SCORE.  Very long texts are judged whole, repeated rows
    alike, null ids like others; an empty table stays empty; other columns, whatever their names, are kept.
    """
    packed, columns = _packed(docs)
    found = hdlang.identify(packed, docs)
    words = F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}]+"))
    trigrams = F.greatest(F.char_length(F.array_join(words, " ")) - 2, F.lit(1))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE * (1 - SPREAD / F.sqrt(trigrams)))).select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere first; those that nothing but such lines made up go.

    Null and empty texts, which have no line to lose, stay; n_chars, where there is such a column, is counted
    anew for texts that lost a line.  Repeated rows and null ids are ranked by ``dedup_lines``; an empty table
    stays empty; other columns, whatever their names, are kept.
    """
    packed, columns = _packed(docs)
    found = linededup.dedup_lines(packed)
    kept = found.where("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(F.col("n_dropped").alias("__dropped"), *columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return kept.drop("__dropped")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; see ``keep_one`` for nulls, ties, repeated rows and clashing names."""
    return ngramjoin.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none and stay.

    Every row is judged by its own text, repeated ones alike; an empty table or benchmark leaves all as it is.
    """
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that the mixture takes, shard by shard; see ``mix`` for null sources and texts."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: Language profiles, random permutations and edit links aren't SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. Its result is written as Parquet and read again by the next stage, so a
lost executor costs at most the tasks of the stage that runs. All stages but the
last give the columns of `docs` as they were, whatever their names: they are put
aside under inner names while an operator runs. Only `text` changes, and a
column n_chars, which counts it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.decontaminate import decontaminate
from lodestar.llm.near_dup import drop_near_duplicates
from lodestar.llm.packing import pack
from lodestar.llm.quality_rules import RepetitionRules, judge
from lodestar.llm.substring_dedup import remove_repeats
from lodestar.llm.text import materialise, table
from lodestar.sources.storage import clear_steps, n_steps

#: A short text is as good as a long one here; one of fewer words has no shingle that it could be compared by.
RULES = RepetitionRules(min_words=5)


def _aside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator's rows with the columns of `docs`; those that it does not need have inner names meanwhile."""
    inner = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = operator(docs.withColumnsRenamed(inner))
    return found.select(*[F.col(inner.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects: with five words or more, and not mostly made of repeats.

    A null, empty or wordless text goes. A very long text is judged whole; a
    count at its limit passes; repeated rows are judged each; an empty table
    gives an empty result; columns pass through, whatever their names.
    """
    return _aside(docs, lambda d: judge(d, RULES).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id.

    Texts that are null, empty or without words are nobody's duplicates and stay;
    a very long text counts whole; of a group without ids one row stays; rows
    that repeat the id and text of the one that stays are that document and stay;
    an empty table gives an empty result; columns pass through, whatever their names.
    """
    return _aside(docs, drop_near_duplicates)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences and passages of 50 words that are repeated; a document that loses all its sentences goes.

    The first text that holds a passage keeps it, in the order of ids, rows
    without an id last. A null or empty text stays as it is; a very long one is
    searched whole; rows of equal id and text lose the same; an empty table gives
    an empty result; columns pass through, whatever their names.
    """
    found = _aside(docs, lambda d: remove_repeats(d, passage=50).filter("n_removed = 0 or n_removed < n_sentences"))
    return _measured(found)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's words; a document that is mostly made of them goes.

    A null, empty or wordless text stays; a very long one is scanned whole; a
    document of which just half is hit stays; repeated rows are scanned each; an
    empty table or benchmark gives what came in; columns pass through, whatever
    their names.
    """
    return _measured(_aside(docs, lambda d: decontaminate(d, table(spark, sf_dir, "benchmark"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids.

    A null or empty text is the end id alone; a very long one is cut into
    windows; rows of one id, or without, are packed each; an empty table gives an
    empty result; columns but doc_id and text are not read.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars counted again, if there is such a number."""
    kind = dict(docs.dtypes).get("n_chars")
    return docs.withColumn("n_chars", F.length("text").cast(kind)) if kind in ("int", "bigint") else docs


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL cannot express MinHash, suffix arrays, tokens and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table `documents`; all but the last run when this is called.

    What a stage has written on its way, and what it read, is deleted when its
    result has been written.
    """
    docs, before = table(spark, sf_dir, "documents"), n_steps(spark)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        clear_steps(spark, kept=1, since=before)
    return STAGES[-1][1](spark, docs, sf_dir)

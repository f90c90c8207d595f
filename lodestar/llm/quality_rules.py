"""Quality rules on repetition, by suffix arrays (operator 6).

Each document is a sequence of words. Its suffix array (over all words, by
prefix doubling from three-word windows, for all documents of a chunk at once)
puts suffixes with long common prefixes side by side; the longest common prefix
of a suffix with its neighbours is the longest substring from there that occurs
elsewhere too, so these intervals are the maximal repeated substrings. Their
spans are united; a document fails if they cover too large a part of its words
or if the longest one is too long. A base rule on length and on repeated
three-word windows is applied first.

No shuffle: documents are judged where they are read, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NONSPACE, Words, buffers, map_chunks, mix, span_hashes, table

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


@dataclass(frozen=True)
class RepetitionRules:
    """Limits.

    A repeat counts from `min_repeat` words; a document is rejected if repeats
    cover more than `max_covered` of its words, or if one repeat has more than
    `max_longest` words and more than `max_longest_part` of all words. So a
    paragraph that stands twice rejects a page of some hundred words, and a
    heading or a line that stands twice rejects none.
    """

    min_words: int = 50
    max_window_share: int = 50
    min_repeat: int = 8
    max_covered: float = 0.35
    max_longest: int = 30
    max_longest_part: float = 0.1


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeats(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of all repeated substrings of three words or more, and the length of the longest that starts there."""
    n, doc = len(words.hashes), words.doc
    if n < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol = _dense(mix(words.hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))) + 1
    ahead = lambda k: np.where(np.append(doc[k:] == doc[:-k], np.zeros(k, bool)), np.append(symbol[k:], np.zeros(k, np.int64)), 0)
    if symbol.max() < 1 << 21:
        first = _dense(symbol << 42 | ahead(1) << 21 | ahead(2))
    else:
        first = _dense(_dense(symbol << 32 | ahead(1)) << 32 | ahead(2))
    rank = first
    at = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(at):
        return at, at
    levels, width, tied = [rank], 3, at
    while len(tied):
        to = tied + width
        inside = np.minimum(to, n - 1)
        following = np.where((to < n) & (doc[inside] == doc[tied]), rank[inside] + 1, 0)
        order = np.lexsort((following, rank[tied]))
        group, following, sorted_at = rank[tied][order], following[order], tied[order]
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = new_group | np.append(True, following[1:] != following[:-1])
        # ranks are sparse: a group of g positions owns g numbers from its first
        place = np.arange(len(order))
        base = place[new_group][np.cumsum(new_group) - 1]
        if len(levels) == 1:  # spread the dense ranks so that each position has a number of its own
            size = np.bincount(rank)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            levels[0] = rank = begin[rank]
            group = rank[sorted_at]
        rank = rank.copy()
        rank[sorted_at] = group + (place[new_key][np.cumsum(new_key) - 1] - base)
        levels.append(rank)
        width *= 2
        key_size = np.diff(np.append(np.flatnonzero(new_key), len(order)))
        tied = sorted_at[np.repeat(key_size > 1, key_size)]
    order = at[np.argsort(rank[at], kind="stable")]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    live = doc[a] == doc[b]
    for k in range(len(levels) - 2, -1, -1):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        same = live & (a + common < n) & (b + common < n) & (levels[k][x] == levels[k][y])
        common += same * (3 << k)
    for _ in range(2):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        live &= (a + common < n) & (b + common < n) & (symbol[x] == symbol[y])
        common += live
    longest = np.maximum(np.append(0, common), np.append(common, 0))
    return order, longest


def _per_doc(flags: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc[flags], minlength=n).astype(np.int64)


def measure(column: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    """All counts of the rules for the texts of one chunk."""
    data, offsets = buffers(column)
    words, n = Words(data, offsets, NONSPACE, lower=False), len(column)
    within = NONSPACE[data]
    chars = np.concatenate([[0], np.cumsum(within & ((data & 0xC0) != 0x80))])[offsets]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])[offsets]

    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends
    filled = np.concatenate([[0], np.cumsum(within)])
    has_word = filled[ends] > filled[starts]
    starts, ends = starts[has_word], ends[has_word]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    lines = np.unique(mix(span_hashes(data, starts, ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[lines], minlength=n)

    at, longest = repeats(words)
    n_words = len(words.hashes)
    in_window = covered(at, np.full(len(at), 3), n_words)
    counts = longest >= min_repeat
    in_repeat = covered(at[counts], longest[counts], n_words)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, words.doc[at[counts]], longest[counts])
    return {
        "n_words": words.counts, "word_chars": np.diff(chars), "n_symbols": np.diff(symbols), "n_dup_lines": dup_lines,
        "n_repeat_words": _per_doc(in_window, words.doc, n), "n_covered": _per_doc(in_repeat, words.doc, n), "longest_repeat": top,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def judge(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text") -> DataFrame:
    """Every row of `docs` with the counts, `base_failed` and `kept` in place of columns of those names.

    A null or empty text has no words and fails the base rule; a very long text
    is one suffix array, in one task. A count that is equal to its limit passes.
    Repeated rows are judged each; an empty table gives an empty result; further
    columns pass through.
    """
    made = {*COUNTS, "base_failed", "kept"}
    through = [c for c in docs.columns if c not in made or c == text]
    rows = docs.select(*through)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} long" for c in COUNTS])

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        return {c: chunk.column(c) for c in through} | measure(chunk.column(text), rules.min_repeat)

    out = map_chunks(rows, work, schema, text)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_window_share * F.col("n_words"))
    too_covered = F.col("n_covered") > rules.max_covered * F.col("n_words")
    too_long = (F.col("longest_repeat") > rules.max_longest) & (F.col("longest_repeat") > rules.max_longest_part * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~(failed | too_covered | too_long))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")

"""Spelling variants by a positional q-gram index with a count filter (operator 13).

Words are counted over all texts by Spark's own functions. Two words one edit apart
share the first half of the shorter one, or its other part as an ending, unchanged
and in place. So every word is sent to the groups of its halves, for its own length
and for the length below; a group whose words share too much is divided again in the
same way, by halves of what is still open, until it is small. Each task reads whole
groups and indexes what is open in their words by positional bigrams. Posting lists
of a group, cut to the lengths and positions that one edit allows, are sorted runs
that are merged for each word; words that meet often enough in the merge (an edit
touches two bigrams at most) are verified by their code points.

A group gives one row for each of its words: how many are near, and the best of
them. Pairs are never written, and no group holds more than a bounded number of words
(of words that differ in one place only, as many as there are letters).
Forms are followed to their roots by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import materialise, small_batches, table

#: Letters of a word, and the case that is folded.
RUN, UPPER, LOWER_CASE = r"[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one group; larger ones are divided.
GROUP = 2000
#: Words that are indexed at once, and candidates or letters that are compared at once.
BLOCK_WORDS, BLOCK_PAIRS = 20_000, 1 << 21
_FAR = (1 << 31) - 1


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, doc_id: str = "doc_id", text: str = "text", drop_one_in: int | None = 97) -> DataFrame:
    """(word, n) of all texts, each distinct word of enough letters and occurrences.

    With `drop_one_in`, a run loses one letter where that number divides the CRC-32
    of its id and itself; rows without an id lose none.
    """
    runs = docs.select(F.col(doc_id).cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run"))
    word: Column = F.translate("run", UPPER, LOWER_CASE)
    if drop_one_in:
        runs = runs.select("id", word.alias("run"))
        runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        word = F.when(F.col("h") % drop_one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _divided(members: DataFrame) -> DataFrame:
    """Every member in the group of the first half of its open part, and in that of the rest.

    A group is known by (base, pre, suf, key): its words have `base` letters, or one
    more; they share the first `pre` and the last `suf`. A pair that shares the first
    half as well is left to the group of that half: in the other one, a pair counts
    only if its common beginning is shorter than `cap`.
    """
    half = F.floor((F.col("base") - F.col("pre") - F.col("suf")) / 2).cast("int")
    first = F.struct((F.col("pre") + half).alias("pre"), F.col("suf").alias("suf"), F.col("cap").alias("cap"))
    other = F.struct(F.col("pre").alias("pre"), (F.col("base") - F.col("pre") - half).alias("suf"), F.least(F.col("cap"), F.col("pre") + half).alias("cap"))
    to = members.select("word", "n", "base", F.explode(F.array(first, other)).alias("to")).select("word", "n", "base", "to.*")
    return to.withColumn("key", F.xxhash64("base", "pre", "suf", F.substring("word", F.lit(1), F.col("pre")), F.expr("right(word, suf)")))


def groups(words: DataFrame) -> DataFrame:
    """(word, n, base, pre, suf, cap, key): all words in their groups, none of which is larger than GROUP unless it has one open letter."""
    least = words.agg(F.min(F.length("word"))).first()[0] or 0
    lengths = F.explode(F.when(F.length("word") > least, F.array(F.length("word"), F.length("word") - 1)).otherwise(F.array(F.length("word")))).alias("base")
    left, done = _divided(words.select("word", "n", lengths, F.lit(0).alias("pre"), F.lit(0).alias("suf"), F.lit(_FAR).alias("cap"))), None
    while True:
        whole = left.filter(F.col("base") - F.col("pre") - F.col("suf") >= 2)
        large = materialise(whole.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > GROUP).select("key"))
        if large.isEmpty():
            return left if done is None else done.unionByName(left)
        small = left.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        left = materialise(_divided(left.join(large, "key", "left_semi")))


class Members:
    """Words of some groups as code points."""

    def __init__(self, batch: pa.RecordBatch):
        words = batch.column("word").to_pylist()
        self.n = batch.column("n").to_numpy()
        self.pre, self.suf, self.cap = (batch.column(c).to_numpy().astype(np.int64) for c in ("pre", "suf", "cap"))
        self.length = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        base = batch.column("base").to_numpy().astype(np.int64)
        self.long, self.open = self.length > base, base - self.pre - self.suf
        ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("base", "pre", "suf", "key")])
        self.group = np.cumsum(np.append(False, (ids[:, 1:] != ids[:, :-1]).any(axis=0)))
        self.order = np.empty(len(words), np.int64)  # by falling n, then by code points
        self.order[np.lexsort((np.argsort(np.argsort(np.array(words, object))), -self.n))] = np.arange(len(words))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, place and bigram of the open parts, with a mark before and after each; all words with one open letter have one more, which no edit touches."""
        size = self.length - self.pre - self.suf + 1
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        at = self.begin[word] + self.pre[word] + place
        last = len(self.letters) - 1
        before = np.where(place > 0, self.letters[np.clip(at - 1, 0, last)], 0)
        after = np.where(place < size[word] - 1, self.letters[np.clip(at, 0, last)], 0)
        narrow = np.flatnonzero(self.open < 2)
        return np.append(word, narrow), np.append(place, np.zeros(len(narrow), np.int64)), np.append(before << 21 | after, np.full(len(narrow), -1))

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members that are one edit apart, the first one no longer than the second."""
        word, place, gram = self.bigrams()
        grams = np.unique(gram, return_inverse=True)[1]
        widest = int(place.max(initial=0)) + 2
        list_of = (self.group[word] * (int(grams.max(initial=0)) + 1) + grams) * widest + place
        short = np.flatnonzero(~self.long[word])
        postings = short[np.argsort(list_of[short], kind="stable")]
        lists = list_of[postings]
        found = []
        # a substitution leaves places as they are; an inserted letter moves those behind it by one
        for probe, shift in ((short, 0), (np.flatnonzero(self.long[word]), 0), (np.flatnonzero(self.long[word]), 1)):
            probe = probe[place[probe] >= shift]
            begin, end = np.searchsorted(lists, list_of[probe] - shift), np.searchsorted(lists, list_of[probe] - shift, "right")
            found.append((word[probe], begin, end - begin))
        probe, begin, size = (np.concatenate(x) for x in zip(*found, strict=True))
        by_word = np.argsort(probe, kind="stable")
        probe, begin, size = probe[by_word], begin[by_word], size[by_word]
        pairs = [self._merged(probe[a:z], begin[a:z], size[a:z], word[postings]) for a, z in _cuts(size, probe)]
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2

    def _merged(self, probe: np.ndarray, begin: np.ndarray, size: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the lists of each probe, keep what they share often enough, and verify it."""
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        a, b = members[at], np.repeat(probe, size)
        once = self.long[b] | (a < b)
        key = a[once] + b[once] * len(self.length)
        key.sort(kind="stable")  # the lists are sorted runs, and this sort merges runs
        key, shared = np.unique(key, return_counts=True)
        a, b = key % len(self.length), key // len(self.length)
        enough = shared >= np.maximum(1, (self.length - self.pre - self.suf)[b] - 1)
        return self._verified(a[enough], b[enough])

    def _verified(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One substitution or insertion leads from a to b, and no other group has the pair."""
        parts = [self._one_edit(a[x:z], b[x:z]) for x, z in _cuts(self.length[a], np.arange(len(a)))]
        keep = np.concatenate(parts) if parts else np.zeros(0, bool)
        return a[keep], b[keep]

    def _one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = self.length[a]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        x, y = self.letters[np.repeat(self.begin[a], size) + place], np.repeat(self.begin[b], size) + place
        same = x == self.letters[y]
        ahead = np.minimum.reduceat(np.where(same, np.repeat(size, size), place), first)  # equal letters from the front
        moved = x == self.letters[np.minimum(y + 1, len(self.letters) - 1)]
        behind = size - 1 - np.maximum.reduceat(np.where(moved, -1, place), first)  # equal letters from the back, one place on
        wrong = np.add.reduceat((~same).astype(np.int64), first)
        near = np.where(self.length[b] == size, wrong == 1, ahead + behind >= size)
        return near & (ahead < np.minimum(self.cap[a], self.cap[b]))


def _cuts(sizes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK_PAIRS in sum that part no owner's entries."""
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + BLOCK_PAIRS, "right"))
        end = max(end, begin + 1)
        end = int(np.searchsorted(owner, owner[end - 1], "right"))
        yield begin, end
        begin = end


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form_n, form) of each word that is near another one of its group."""
    held: pa.RecordBatch | None = None

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        members = Members(rows)
        a, b = members.near()
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        count = np.bincount(one, minlength=rows.num_rows)
        best = np.full(rows.num_rows, rows.num_rows, np.int64)
        np.minimum.at(best, one, members.order[two])
        of_order = np.argsort(members.order)
        at = np.flatnonzero(count)
        form = of_order[best[at]]
        words = rows.column("word")
        return pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(count[at]), pa.array(members.n[form]), words.take(pa.array(form))], ["word", "n_near", "form_n", "form"])

    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        begin = 0
        while rows.num_rows - begin > BLOCK_WORDS:
            # a block ends where a group does
            ids = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("base", "pre", "suf", "key")])[:, begin:]
            ends = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            if not len(ends):
                break
            end = begin + int(ends[max(0, np.searchsorted(ends, BLOCK_WORDS, "right") - 1)])
            yield work(rows.slice(begin, end - begin))
            begin = end
        held = rows.slice(begin) if begin < rows.num_rows else None
    if held is not None and held.num_rows:
        yield work(held)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): how many words are one edit away, and the most frequent of them, the first of equally frequent ones."""
    small_batches(words.sparkSession)
    ids = ["base", "pre", "suf", "key"]
    rows = groups(words).select("word", "n", *ids, "cap").repartition(*ids).sortWithinPartitions(*ids)
    found = rows.mapInArrow(_near_words, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last by pointer doubling, whose rounds are the logarithm of the longest way."""
    to = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(to.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        to = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return to


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, doc_id: str = "doc_id", text: str = "text", drop_one_in: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of enough letters and occurrences in all texts.

    `form` is the most frequent word that is one inserted, deleted or replaced
    letter away (of equally frequent ones the first in code-point order), if it is
    `ratio` times as frequent or more; null, with a null form_n, if none is. `root`
    is the last word to which forms lead, the word itself if it has none. Null and
    empty texts have no words; very long texts and words count whole; repeated rows
    count each; an empty table gives an empty result; other columns are not read.
    `ratio` must be two or more, so that forms never lead in a circle. Words are
    counted and grouped, and their roots written, when this is called.
    """
    if ratio < 2:
        raise ValueError("the ratio must be two or more")
    words = materialise(word_counts(docs, min_length, min_count, doc_id, text, drop_one_in))
    near = near_words(words)
    has = F.col("form_n") >= ratio * F.col("n")
    found = materialise(
        words.join(near, "word", "left").select(
            "word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")
        )
    )
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of all documents with its form and root."""
    return spelling_variants(table(spark, sf_dir, "documents"), drop_one_in=97)

"""Phrases of a large dictionary in whole texts: a pattern automaton, or a join of word n-grams.

A dictionary is a relation (phrase, value) of any size. Up to a checked size it
becomes an automaton over words, as arrays: edges by (state, word), failure links,
and for each state the nearest one on its failure way that ends a phrase. It is
broadcast, and batches of texts run through it side by side, so a text costs a step
for each of its words, however many phrases there are, and nothing is shuffled.
A larger dictionary is joined by the texts' n-grams of words, of those lengths that
its phrases have: only those n-grams are shuffled that a Bloom filter of the phrases
lets through, and the join finds which of them are phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import norm
from ..sources.storage import materialise

#: Bytes of phrases and values that may become an automaton; and words of a text that are one piece of it.
AUTOMATON_BYTES, PIECE = 64 << 20, 256
#: Blocks of 32 bytes that the filter of a larger dictionary has at most.
BLOOM_BLOCKS = 1 << 21
#: Phrases and values of the matches that are held at a time.
VALUES = 50_000
MATCH = "array<struct<phrase:string,words:int,n:int,found:array<string>>>"


class Automaton:
    """Distinct phrases of single-spaced words, each with its values."""

    def __init__(self, phrases: pa.Array, values: pa.Array):
        self.phrases, self.values = phrases, values
        split = pc.split_pattern(phrases, " ")
        self.length = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(split).dictionary_encode()
        self.vocabulary, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n_words, begin = max(1, len(self.vocabulary)), np.cumsum(self.length) - self.length
        at = np.zeros(len(phrases), np.int64)
        keys, levels, n = [], [np.zeros(1, np.int64)], 1
        for depth in range(int(self.length.max(initial=0))):
            longer = np.flatnonzero(self.length > depth)
            key, of = np.unique(at[longer] * self.n_words + word[begin[longer] + depth], return_inverse=True)
            at[longer] = n + of
            keys.append(key)
            levels.append(np.arange(n, n + len(key)))
            n += len(key)
        #: Edge k leads to state k + 1; states are numbered level by level, so the keys rise.
        self.edges = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.phrase = np.full(n, -1, np.int64)
        self.phrase[at] = np.arange(len(phrases))
        self.fail, self.ends = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for depth, states in enumerate(levels[1:]):
            parent, by = np.divmod(self.edges[states - 1], self.n_words)
            if depth:
                self.fail[states] = self.step(self.fail[parent], by)
            own = self.phrase[states] >= 0
            self.ends[states] = np.where(own, states, self.ends[self.fail[states]])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each; word -1 is in no phrase."""
        state, out = state.copy(), np.zeros(len(state), np.int64)
        open_ = np.flatnonzero(word >= 0)
        while len(open_):
            key = state[open_] * self.n_words + word[open_]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[edge] == key
            out[open_[there]] = edge[there] + 1
            open_ = open_[~there & (state[open_] > 0)]
            state[open_] = self.fail[state[open_]]
        return out

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and phrase of every occurrence in single-spaced texts."""
        split = pc.split_pattern(texts.fill_null(""), " ")
        size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(self.edges) or not size.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = pc.index_in(pc.list_flatten(split), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        # a text is cut into pieces, each of which begins as many words early as a phrase may reach back
        back = int(self.length.max()) - 1
        pieces = -(-size // PIECE)
        text = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.maximum(0, number * PIECE - back)
        own, end = number * PIECE - first, np.minimum(size[text], (number + 1) * PIECE)
        begin, length = (np.cumsum(size) - size)[text] + first, end - first
        by_length = np.argsort(-length, kind="stable")
        text, begin, length, own = text[by_length], begin[by_length], length[by_length], own[by_length]
        state, found = np.zeros(len(text), np.int64), []
        for k in range(int(length[0])):
            n = int(np.searchsorted(-length, -k))  # the pieces that go on
            state = self.step(state[:n], word[begin[:n] + k])
            hit = np.flatnonzero((self.ends[state] >= 0) & (own[:n] <= k))
            found.append((text[hit], self.ends[state[hit]]))
        text, state = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        while len(state):
            out.append((text, self.phrase[state]))
            state = self.ends[self.fail[state]]
            text, state = text[state >= 0], state[state >= 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def matches(self, texts: pa.Array) -> pa.Array:
        """For each text its distinct phrases, in the order of the dictionary: phrase, its words, how often, values."""
        found = [part for _, _, part in self.parts(texts)]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.struct([("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int32()), ("found", self.values.type)])))

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
        """The matches of texts, cut so that a part has VALUES phrases and values at most, or one text."""
        text, phrase = self.scan(texts)
        key, n = np.unique(text * len(self.phrases) + phrase, return_counts=True) if len(text) else (text, text)
        text, phrase = np.divmod(key, max(1, len(self.phrases)))
        offsets = np.searchsorted(text, np.arange(len(texts) + 1))
        weight = 1 + pc.list_value_length(self.values).to_numpy(zero_copy_only=False).astype(np.int64)[phrase]
        so_far = np.concatenate([[0], np.cumsum(weight)])[offsets]
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(so_far, so_far[begin] + VALUES, "right")) - 1)
            a, b = offsets[begin], offsets[end]
            columns = [self.phrases.take(pa.array(phrase[a:b])), pa.array(self.length[phrase[a:b]].astype(np.int32)), pa.array(n[a:b].astype(np.int32)), self.values.take(pa.array(phrase[a:b]))]
            cut = pa.array((offsets[begin : end + 1] - a).astype(np.int32))
            yield begin, end, pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(columns, ["phrase", "words", "n", "found"]))
            begin = end


def find_phrases(texts: DataFrame, dictionary: DataFrame, text: str = "text", phrase: str = "phrase", value: str = "value", plural: bool = False, normal: Callable[[Column], Column] = norm) -> DataFrame:
    """Every row of `texts` with `matches`: the distinct phrases that its text has as whole words, each with its number of words, how often it occurs, and its sorted distinct values.

    Texts and phrases are compared as `normal` gives them. With `plural`, a phrase
    with a further `s` counts as the phrase. Overlapping and nested phrases all
    count. Null and empty texts have none, and phrases without words are in none;
    a column `matches` of the texts is replaced. The dictionary is measured, and
    collected if it is small enough, when this is called.
    """
    clean = dictionary.select(F.trim(normal(F.col(phrase))).alias("p"), F.col(value).cast("string").alias("v")).filter("p <> '' and v is not null")
    size = clean.agg(F.sum(F.octet_length("p") + F.octet_length("v") + 16)).first()[0] or 0
    small = size <= (AUTOMATON_BYTES // 2 if plural else AUTOMATON_BYTES)
    forms = clean.select(F.explode(F.array("p", F.concat("p", F.lit("s")))).alias("form"), "p", "v") if plural else clean.select(F.col("p").alias("form"), "p", "v")
    phrases = forms.groupBy("form").agg(F.array_sort(F.collect_set("v")).alias("v"))
    rows = texts.drop("matches").withColumn("__norm", F.trim(normal(F.col(text))))
    return _by_automaton(rows, phrases) if small else _by_join(rows, phrases)


def _by_automaton(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    held = phrases.orderBy("form").toArrow()  # of the size that was checked
    shared = rows.sparkSession.sparkContext.broadcast(Automaton(held.column("form").combine_chunks().cast(pa.string()), held.column("v").combine_chunks().cast(pa.list_(pa.string()))))
    through = [c for c in rows.columns if c != "__norm"]
    schema = StructType([rows.schema[c] for c in through] + StructType.fromDDL(f"matches {MATCH}").fields)
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for begin, end, found in shared.value.parts(batch.column("__norm").cast(pa.string())):
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(begin, end - begin) for c in through], found.cast(arrow.field("matches").type)], schema=arrow)

    return rows.mapInArrow(work, schema)


def _hashes(words: pa.Array, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words that begin at these places."""
    coded = words.dictionary_encode()
    one = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ one[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash in a Bloom filter of blocks of four 64-bit words, and its bits there: two in each word."""
    mixed = hashes * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    bit = lambda k: np.uint64(1) << ((mixed >> np.uint64(6 * k)) & np.uint64(63))
    return (hashes >> np.uint64(32)).astype(np.int64) % blocks, np.stack([bit(2 * k) | bit(2 * k + 1) for k in range(4)], axis=1)


def _bloom(phrases: DataFrame, blocks: int) -> np.ndarray:
    """A Bloom filter of the phrases; tasks make its blocks, and the driver has only those."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern(batch.column("form").cast(pa.string()), " ")
            words, size = pc.list_flatten(split), pc.list_value_length(split).to_numpy().astype(np.int64)
            begin = np.cumsum(size) - size
            for n in np.unique(size):
                block, bits = _places(_hashes(words, begin[size == n], int(n)), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(bits[:, k].view(np.int64)) for k in range(4)]], names=["block", "b0", "b1", "b2", "b3"])

    made = phrases.select("form").mapInArrow(work, "block long, b0 long, b1 long, b2 long, b3 long")
    held = made.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(4)]).toArrow()
    out = np.zeros((blocks, 4), np.uint64)
    out[held.column("block").to_numpy()] = np.stack([held.column(f"b{k}").to_numpy().view(np.uint64) for k in range(4)], axis=1)
    return out


def _by_join(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    phrases = materialise(phrases.withColumn("words", F.size(F.split("form", " "))))
    counts = phrases.groupBy("words").count().collect()  # as many as there are lengths of phrases
    lengths, blocks = sorted(r["words"] for r in counts), min(BLOOM_BLOCKS, sum(r["count"] for r in counts) // 8 + 1)
    bloom = rows.sparkSession.sparkContext.broadcast(_bloom(phrases, blocks))
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word n-grams of texts that may be phrases, each once for a text, with their number."""
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                split = pc.split_pattern(some.column("__norm").cast(pa.string()).fill_null(""), " ")
                words, size = pc.list_flatten(split), pc.list_value_length(split).to_numpy().astype(np.int64)
                of = np.repeat(np.arange(len(size)), size)
                left = np.cumsum(size)[of] - np.arange(len(of))
                for n in lengths:
                    at = np.flatnonzero(left >= n)
                    block, bits = _places(_hashes(words, at, n), blocks)
                    at = at[((bloom.value[block] & bits) == bits).all(axis=1)]
                    said = [words.take(pa.array(at + w)) for w in range(n)]
                    found = pa.table({"__row": some.column("__row").take(pa.array(of[at])), "form": pc.binary_join_element_wise(*said, " ")})
                    found = found.group_by(["__row", "form"]).aggregate([([], "count_all")])
                    yield from found.select(["__row", "form", "count_all"]).rename_columns(["__row", "form", "n"]).set_column(2, "n", found.column("count_all").cast(pa.int32())).to_batches()

    hits = rows.select("__row", "__norm").mapInArrow(grams, "__row long, form string, n int").join(phrases, "form")
    match = F.struct(F.col("form").alias("phrase"), F.col("words"), F.col("n"), F.col("v").alias("found"))
    found = hits.groupBy("__row").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    return rows.join(found, "__row", "left").drop("__row", "__norm").withColumn("matches", F.coalesce("matches", F.array().cast(MATCH)))


def longest(matches: Column) -> Column:
    """The sorted values of the longest phrases, by letters; all of equal length."""
    top = F.array_max(F.transform(matches, lambda m: F.length(m["phrase"])))
    return all_values(F.filter(matches, lambda m: F.length(m["phrase"]) == top))


def all_values(matches: Column) -> Column:
    """The sorted distinct values of all phrases."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(matches, lambda m: m["found"]))))

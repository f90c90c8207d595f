"""Similar names: a set-similarity join over trigrams with bitmaps.

Two sets whose Jaccard similarity reaches a threshold share a trigram among the few
rarest ones of each, so names are compared where they have such a trigram in common,
and a pair counts where its first common trigram is. Where names are so alike that this
would compare more pairs than there are, each pair is compared once instead. Either way
names are cut into blocks that are compared block by block, so no task holds more than
two of them: signatures of 256 bits rule out pairs whose sets differ too much, and the
others are verified on bitmaps of their whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm
from ..sources.storage import materialise

#: Names of one block, and of a step of its comparison.
BLOCK, STEP = 8192, 64


def trigrams(normal: Column) -> Column:
    """The distinct runs of three characters of a normalised name, with the space before and after it; sorted."""
    at = F.sequence(F.lit(1), F.length(normal) - 2)
    return F.array_sort(F.array_distinct(F.when(F.length(normal) > 2, F.transform(at, lambda i: F.substring(normal, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))))


def names(rows: DataFrame, name: str) -> DataFrame:
    """(name, n): the distinct normalised names, and the number of rows of each; a name without letters and digits is none."""
    return rows.groupBy(norm(F.col(name)).alias("name")).agg(F.count("*").alias("n")).filter(F.length("name") > 2)


def by_rarity(known: DataFrame) -> DataFrame:
    """(name, n, grams): the trigrams of each name as numbers, the rarest ones of all names first.

    Names are made of 36 signs and spaces, so there are 50,653 trigrams at most at
    any size of the input: they are numbered in one window and broadcast.
    """
    said = known.select("name", "n", F.explode(trigrams(F.col("name"))).alias("gram"))
    numbers = said.groupBy("gram").agg(F.count("*").alias("df")).select("gram", F.row_number().over(W.orderBy("df", "gram")).alias("k"))
    return said.join(F.broadcast(numbers), "gram").groupBy("name", "n").agg(F.array_sort(F.collect_list("k")).alias("grams"))


def similar_names(rows: DataFrame, name: str, percent: int = 50) -> DataFrame:
    """(a, b, n_a, n_b, common, in_all): all pairs of distinct normalised names, a < b, with 100 * common >= percent * in_all trigrams.

    n_a and n_b count the rows that have the name: equal names are one, and are in no
    pair with themselves. Null and empty names are in none. The numbered trigrams are
    written when this is called.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and 100 at most")
    sets = materialise(by_rarity(names(rows, name)))
    met = _rare(sets, percent).groupBy("gram").agg(F.count("*").cast("double").alias("m")).agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0
    return joined(sets, percent, by_gram=met < sets.count() ** 2)


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """A row for each name and each of its rarest trigrams, of which similar names share one."""
    size = F.size("grams")
    least = F.floor((size * percent + 99) / 100).cast("int")
    return sets.withColumn("gram", F.explode(F.slice("grams", F.lit(1), size - least + 1)))


def joined(sets: DataFrame, percent: int, by_gram: bool) -> DataFrame:
    """The pairs of numbered sets (name, n, grams), met by their rare trigrams or each once."""
    dealt = _rare(sets, percent) if by_gram else sets.withColumn("gram", F.lit(-1))
    # of m names, each one goes to the cells (i, j) of its own block i with all blocks j
    counts = dealt.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    dealt = dealt.join(F.broadcast(counts), "gram").withColumn("own", own)  # a row for each trigram at most
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")

    def compare(cell: pa.Table) -> pa.Table:
        return _similar(cell, percent)

    found = cells.groupBy("gram", "low", "high").applyInArrow(compare, "a string, b string, n_a long, n_b long, common int, in_all int")
    return found.withColumns({"a": F.trim("a"), "b": F.trim("b")})


def _bits(of: np.ndarray, bit: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Bitmaps of rows as 64-bit words, from the sorted rows and their bits."""
    out = np.zeros((rows, -(-width // 64)), np.uint64)
    for k in range(0, rows, 256):
        a, b = np.searchsorted(of, [k, k + 256])
        flags = np.zeros((min(256, rows - k), out.shape[1] * 64), bool)
        flags[of[a:b] - k, bit[a:b]] = True
        out[k : k + 256] = np.packbits(flags, axis=1, bitorder="little").view("<u8")
    return out


def _similar(cell: pa.Table, percent: int) -> pa.Table:
    """The similar pairs of a cell: of two blocks, or of one with itself."""
    cell = cell.combine_chunks()
    size = pc.list_value_length(cell["grams"]).to_numpy().astype(np.int64)
    order = np.argsort(size, kind="stable")
    cell, size = cell.take(pa.array(order)), size[order]
    gram, low, high = (cell[c][0].as_py() for c in ("gram", "low", "high"))
    own, whole, of = cell["own"].to_numpy(), pc.list_flatten(cell["grams"]).to_numpy(), np.repeat(np.arange(len(size)), size)
    known, bit = np.unique(whole, return_inverse=True)
    exact = _bits(of, bit, len(size), len(known))
    short = _bits(of, (whole.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64), len(size), 256)
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    signs = np.ascontiguousarray(short[right].T)
    pairs = [np.zeros((3, 0), np.int64)]
    for k in range(0, len(left), STEP):
        rows = left[k : k + STEP]
        # sizes rise, and those of similar sets are in a ratio of the threshold at least
        begin = k if low == high else np.searchsorted(size[right] * 100, size[rows[0]] * percent, "left")
        end = np.searchsorted(size[right] * percent, size[rows[-1]] * 100, "right")
        if begin >= end:
            continue
        apart = np.zeros((len(rows), end - begin), np.uint16)
        for w in range(signs.shape[0]):
            apart += np.bitwise_count(short[rows, w][:, None] ^ signs[w, begin:end][None, :])
        # a bit that differs needs an element that only one of both has
        most = (size[rows][:, None] + size[right[begin:end]][None, :]) * (100 - percent) // (100 + percent)
        x, y = np.nonzero(apart <= most)
        x, y = rows[x], right[begin:end][y]
        if low == high:
            x, y = x[x < y], y[x < y]
        for t in range(0, len(x), 4096):
            i, j = x[t : t + 4096], y[t : t + 4096]
            both = exact[i] & exact[j]
            common = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
            fits = 100 * common >= percent * (size[i] + size[j] - common)
            if gram >= 0:
                fits &= common > 0
                both, i, j, common = both[fits], i[fits], j[fits], common[fits]
                word = (both != 0).argmax(axis=1)
                lowest = both[np.arange(len(i)), word]
                first = word * 64 + np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1))
                fits = known[first] == gram
            pairs.append(np.stack([i[fits], j[fits], common[fits]]))
    i, j, common = np.concatenate(pairs, axis=1)
    said = cell["name"].combine_chunks().cast(pa.string())
    swapped = pc.greater(said.take(pa.array(i)), said.take(pa.array(j))).to_numpy(zero_copy_only=False).astype(bool)
    i, j = np.where(swapped, j, i), np.where(swapped, i, j)
    n = cell["n"].to_numpy()
    columns = [said.take(pa.array(i)), said.take(pa.array(j)), n[i], n[j], common.astype(np.int32), (size[i] + size[j] - common).astype(np.int32)]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["a", "b", "n_a", "n_b", "common", "in_all"])

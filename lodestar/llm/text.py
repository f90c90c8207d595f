"""Vectorised text kernels shared by the corpus operators.

Every kernel works on one chunk of documents held as one byte buffer plus
offsets, so a chunk of a few MB costs a handful of numpy passes and no Python
per word. Null texts are empty texts. Hashes are 64-bit and depend only on the
bytes of a word, never on the chunk or the machine.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import materialise, shared_folder  # noqa: F401

#: Bytes of text that one kernel call handles (a longer document is a chunk of its own).
CHUNK_BYTES = 1 << 20
#: Bytes of a batch on its way between Spark and Python, where the session has Spark's own default.
BATCH_BYTES = 8 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _byte_class(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


#: Words of `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NONSPACE = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, letters, all beyond ASCII.
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that each bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Hashes of any spans of one buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span."""
    return Spans(data).hashes(starts, ends) if len(starts) else np.zeros(0, np.uint64)


class Words:
    """The words of a chunk: byte starts and ends, the document of each, a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool):
        data = LOWER[data] if lower else data
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        within = inside[data]
        first = within.copy()
        first[1:] &= ~within[:-1]
        last = within.copy()
        last[:-1] &= ~within[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] = within[edges]
        last[edges - 1] = within[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.offs = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = span_hashes(data, self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of every k-word window, and a hash of the window."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            total = total * _BASE + self.hashes[at + j]
        return at, mix(total + np.uint64(k))

    def text(self, a: int, b: int) -> bytes:
        """The words a to b, with one space between them."""
        return b" ".join(bytes(self.data[s:e]) for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offs, offs[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def small_batches(spark: SparkSession) -> None:
    """Keep the batches that workers hold small: both sides hold at least one for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def give_back() -> None:
    """Return the memory of finished chunks to the machine; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_chunks(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow with a function from a chunk to output columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text):
            if (out := f(chunk)) is not None:
                yield pa.RecordBatch.from_arrays([_column(out[x.name], x.type) for x in fields], schema=fields)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _column(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the flat values and the length of each list."""
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def binary_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column; lengths count items of `values`."""
    offs = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]) * values.itemsize
    if offs[-1] >= 1 << 31:
        raise ValueError("a chunk must stay below 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def bytes_of(column: pa.Array) -> memoryview:
    """The bytes of a binary column, one value after the other; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = column.buffers()
    if not len(column) or data is None:
        return memoryview(b"")
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(data)[offs[0] : offs[-1]]


#: A key with one of so many parts of all rows is hot; the tasks that share its rows.
HOT, SALTS = 1000, 64


def hot_keys(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """The keys with a thousandth of `total` rows or more, a thousand at most, to be broadcast."""
    return F.broadcast(counts.filter(F.col(n) * HOT >= total).select(*keys, F.lit(True).alias("__hot")))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, deal: Column, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for a `right` with a row for each key: rows of hot keys are dealt out over SALTS tasks by the number `deal`."""
    salt = F.when(F.col("__hot"), F.pmod(deal, F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = left.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    copied = right.join(hot, keys, "left").select(*right.columns, copies.alias("__salt"))
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

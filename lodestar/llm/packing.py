"""Lexical retrieval packing (operator 4).

Documents become token ids, closed by an end id. Whole windows of a long document
are sequences of their own where they are read; what is left of it, and every
shorter document, is packed by lexical retrieval: these rests, each shorter than
a window, are laid out by two weighted MinHashes of their tokens, so that similar
ones fall into the same shard, and each shard of bounded size has a BM25 inverted
index over token ids. From a seed, its unused neighbours in the order of their
BM25 scores fill the window; the last one is cut where the window is full, and
what is left of it is the next seed. So there is no padding inside a partition;
the window that is open at its end is cut into sequences whose lengths are powers
of two.

Document frequencies and the mean length are counted over all documents: a row
for each id of the vocabulary at most, so they may be collected and broadcast at
any size of the input. Only the rests are shuffled, once, in ranges of equal counts.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import binary_column, bytes_of, map_chunks, materialise, mix, table
from .token_counts import byte_of_char

#: Documents of one inverted index.
SHARD = 1024
#: Token bytes of a partition, on average; and the partitions of a table that would need fewer, of a shard each at least.
PARTITION_BYTES, LEAST_PARTS = 32 << 20, 64
K1, B = 1.2, 0.75


@functools.cache
def encoder(path: str):
    """A tiktoken encoding with the vocabulary of a byte-level BPE file, special strings included; its ids equal those of the tokenizers library."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    of = byte_of_char()
    special = {x["content"]: x["id"] for x in whole["added_tokens"] if x["special"]}
    ranks = {bytes(of[c] for c in s): i for s, i in whole["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _weighted_min_hash(ids: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the id that wins each document's draw, in which an id stands for log(id) tickets; no document is empty."""
    if not len(n):
        return np.zeros(0, np.int64)
    draw = ((mix(ids.astype(np.uint64) + np.uint64(salt)) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    cost = -np.log(draw) / np.log(ids + np.float64(2))
    begin = np.cumsum(n) - n
    at = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, begin), n))
    first = at[np.searchsorted(at, begin)]
    return mix(ids[first].astype(np.uint64) + np.uint64(3 * salt)).view(np.int64)


def tokenise(docs: DataFrame, vocabulary: str, window: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, key2, tie, n, whole, rest): the n ids of each text and the end id, as little-endian 32-bit numbers; a null text is empty.

    `whole` are as many as fill windows, `rest` are the others. `key` and `key2`
    are MinHashes of the rest's distinct ids, weighted by log(id), as a byte-pair
    vocabulary adds its rarer tokens later. They order the rests for sharding.
    """
    rows = docs.select(doc_id, F.col(text).alias("__text"), F.xxhash64(doc_id, text).alias("__tie"))

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        encoding = encoder(vocabulary)
        parts = [np.append(encoding.encode_to_numpy(t or "", allowed_special="all"), np.uint32(end_id)) for t in chunk.column("__text").to_pylist()]
        n = np.array([len(p) for p in parts], np.int64)
        ids, left = np.concatenate(parts), n % window
        in_rest = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n) >= np.repeat(n - left, n)
        rest, some = ids[in_rest], left > 0
        keys = np.zeros((2, len(n)), np.int64)
        for i, salt in enumerate((1, 1 << 32)):
            keys[i, some] = _weighted_min_hash(rest, left[some], salt)
        return {doc_id: chunk.column(doc_id), "key": keys[0], "key2": keys[1], "tie": chunk.column("__tie"), "n": n, "whole": binary_column(ids[~in_rest], n - left), "rest": binary_column(rest, left)}

    kind = rows.schema[doc_id].dataType.simpleString()
    return map_chunks(rows, work, f"`{doc_id}` {kind}, key long, key2 long, tie long, n long, whole binary, rest binary", "__text")


def _ids(batch: pa.RecordBatch, column: str = "ids") -> np.ndarray:
    return np.frombuffer(bytes_of(batch.column(column)), np.uint32)


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, df): in how many documents an id occurs, over all of them; id -1 counts the documents, -2 all tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                ids, n = _ids(part), part.column("n").to_numpy()
                if len(ids):
                    key = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | ids
                    key.sort()
                    seen = (key[np.append(True, key[1:] != key[:-1])] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    more = np.bincount(seen)
                    df = np.pad(df, (0, max(0, len(more) - len(df))))
                    df[: len(more)] += more
                docs, length = docs + len(n), length + len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, length]))], ["id", "df"])

    return tokens.select("n", F.concat("whole", "rest").alias("ids")).mapInArrow(work, "id long, df long").groupBy("id").agg(F.sum("df").alias("df"))


class Shard:
    """A BM25 inverted index over the token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = np.array([len(d) for d in docs], np.int64)
        key = (np.repeat(np.arange(len(docs), dtype=np.uint64), n)) | (np.concatenate(docs).astype(np.uint64) << np.uint64(20))
        key, tf = np.unique(key, return_counts=True)
        self.doc, term = (key & np.uint64(0xFFFFF)).astype(np.int64), (key >> np.uint64(20)).astype(np.int64)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.doc] / mean))
        new = np.append(True, term[1:] != term[:-1])
        self.begin = np.append(np.flatnonzero(new), len(term))
        number = np.cumsum(new) - 1
        order = np.argsort(self.doc, kind="stable")
        self.terms = np.split(number[order], np.cumsum(np.bincount(self.doc, minlength=len(docs)))[:-1])
        self.unused, self.n, self.next = np.ones(len(docs), bool), n, 0

    def neighbours(self, seed: int) -> np.ndarray:
        """The unused documents, those with the highest scores for the seed's terms first."""
        terms = self.terms[seed]
        lengths = self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(self.begin[terms] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        scores = np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.unused))
        free = np.flatnonzero(self.unused)
        return free[np.argsort(-scores[free], kind="stable")]

    def take(self, doc: int) -> None:
        self.unused[doc] = False

    def first_unused(self) -> int:
        while self.next < len(self.unused) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.unused) else -1


class _Pieces:
    """Pieces of one partition in the order in which they were cut."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.room = window, first, window
        self.open: list[tuple[object, int, np.ndarray, int]] = []
        self.rows: list[tuple[object, int, np.ndarray, int, int, int]] = []

    def put(self, doc_id: object, start: int, ids: np.ndarray, total: int) -> int:
        """Add as many ids as fit; gives how many."""
        n = min(self.room, len(ids))
        if n:
            self.open.append((doc_id, start, ids[:n], total))
            self.room -= n
            if not self.room:
                self.close(self.window)
        return n

    def close(self, length: int) -> None:
        """Write a sequence of `length` ids from what is open."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.open:
            n = min(len(ids), length - offset)
            if n:
                self.rows.append((doc_id, start, ids[:n], total, self.sequence, offset))
                offset += n
            if n < len(ids):
                rest.append((doc_id, start + n, ids[n:], total))
        self.open, self.sequence, self.room = rest, self.sequence + 1, self.window - sum(len(x[2]) for x in rest)

    def finish(self) -> None:
        while self.open:
            self.close(1 << (sum(len(x[2]) for x in self.open).bit_length() - 1))


def _columns(doc_id: str) -> list[str]:
    return [doc_id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _whole_windows(batches: Iterator[pa.RecordBatch], doc_id: str, window: int) -> Iterator[pa.RecordBatch]:
    """The pieces that are sequences of their own; their numbers are from 2 ** 62 on."""
    sequence = 1 << 62 | TaskContext.get().partitionId() << 40
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            n = part.column("n").to_numpy()
            times = n // window
            row = np.repeat(np.arange(len(n)), times)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)) * window
            full = np.full(len(row), window)
            ids = binary_column(_ids(part, "whole"), full)
            columns = [part.column(doc_id).take(pa.array(row)), pa.array(start), pa.array(full), ids, pa.array(n[row]), pa.array(sequence + np.arange(len(row))), pa.array(np.zeros(len(row), np.int64))]
            sequence += len(row)
            yield pa.RecordBatch.from_arrays(columns, _columns(doc_id))


def _pack(batches: Iterator[pa.RecordBatch], doc_id: str, kind: pa.DataType, window: int, idf: np.ndarray, mean: float) -> Iterator[pa.RecordBatch]:
    out = _Pieces(window, TaskContext.get().partitionId() << 40)
    names = _columns(doc_id)

    def flush() -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(out.rows), 4096):
            part = out.rows[begin : begin + 4096]
            n = np.array([len(r[2]) for r in part], np.int64)
            whole = lambda k: pa.array(np.array([r[k] for r in part], np.int64))
            ids = binary_column(np.concatenate([r[2] for r in part]).astype(np.uint32), n)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], kind), whole(1), pa.array(n), ids, whole(3), whole(4), whole(5)], names)
        out.rows = []

    def shard(held: list[tuple[object, int, np.ndarray, int]]) -> None:
        index = Shard([x[2] for x in held], idf, mean)
        seed = index.first_unused()
        while seed >= 0:
            index.take(seed)
            doc, start, ids, total = held[seed]
            used = out.put(doc, start, ids, total)
            if used < len(ids):  # the rest of a cut document is the next seed
                held[seed] = (doc, start + used, ids[used:], total)
                continue
            nearest, seed = index.neighbours(seed), -1
            for k in nearest.tolist():
                index.take(k)
                doc, start, ids, total = held[k]
                full = out.room <= len(ids)
                used = out.put(doc, start, ids, total)
                if used < len(ids):
                    held[k], seed = (doc, start + used, ids[used:], total), k
                if full:
                    break
            if seed < 0:
                seed = index.first_unused()

    held: list[tuple[object, int, np.ndarray, int]] = []
    for batch in batches:
        for begin in range(0, batch.num_rows, SHARD):
            part = batch.slice(begin, SHARD)
            ids, n = _ids(part, "rest"), part.column("n").to_numpy()
            ends = np.cumsum(n % window)
            for doc, end, total in zip(part.column(doc_id).to_pylist(), ends.tolist(), n.tolist(), strict=True):
                held.append((doc, total // window * window, ids[end - total % window : end], total))
                if len(held) == SHARD:
                    shard(held)
                    held = []
            yield from flush()
    if held:
        shard(held)
    out.finish()
    yield from flush()


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    `ids` are the token ids of the piece as little-endian 32-bit numbers; each id
    of a document lies in exactly one piece. A sequence has `window` ids, or a
    smaller power of two. A null or empty text is the end id alone. Repeated rows
    are packed each; rows without an id have pieces without an id; an empty table
    gives an empty result; other columns are not read. A very long text is one
    row until it is cut into windows. `window` must be a power of two. The texts
    are tokenised, and their ids written, when this is called.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    tokens = materialise(tokenise(docs, vocabulary, window, end_id, doc_id, text))
    counts = {r["id"]: r["df"] for r in frequencies(tokens).collect()}  # a row for each id of the vocabulary at most
    n_docs, length = counts.pop(-1, 0), counts.pop(-2, 0)
    idf = np.zeros(max(counts, default=0) + 1)
    for i, df in counts.items():
        idf[i] = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    mean = max(1.0, length / max(1, n_docs))
    shared = spark.sparkContext.broadcast(idf)
    parts = max(min(LEAST_PARTS, -(-n_docs // SHARD)), -(-4 * length // PARTITION_BYTES), 1)
    kind = tokens.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    schema = f"`{doc_id}` {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    order = ["key", "key2", "tie"]
    laid = tokens.filter(F.col("n") % window > 0).select(doc_id, "n", "rest", *order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rests = laid.mapInArrow(lambda batches: _pack(batches, doc_id, arrow, window, shared.value, mean), schema)
    whole = tokens.filter(F.col("n") >= window).select(doc_id, "n", "whole").mapInArrow(lambda batches: _whole_windows(batches, doc_id, window), schema)
    return rests.union(whole)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

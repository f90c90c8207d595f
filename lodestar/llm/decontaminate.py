"""Benchmark decontamination (operator 5).

The word n-grams of the benchmark's items form a hash set that is broadcast;
every window of training words is looked up, hits are verified word by word, and
the hit words are removed, or the whole document where most of it is hit. The set
is arrays of hashes, places and items beside the items' words, about 30 bytes an
n-gram; it is broadcast only while it stays below a bound that is checked, and
beyond that the same windows are joined by hash over a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, Spans, Words, buffers, chunks, hot_keys, map_chunks, materialise, spread_join, table

#: Benchmark n-grams that may be broadcast, and the bytes of all of them with the items' words.
MAX_WINDOWS, BROADCAST_BYTES = 10_000_000, 320 << 20
#: Bytes of an n-gram: hash, place, length, item.
_WINDOW_BYTES = 20


def _own_windows(words: Words, n: int) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first words, hashes): n consecutive words of an item, or all k words of a shorter one."""
    for k in range(1, n + 1):
        at, hashes = words.windows(k)
        if k < n:
            short = words.counts[words.doc[at]] == k
            at, hashes = at[short], hashes[short]
        if len(at):
            yield k, at, hashes


def item_windows(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Windows of the benchmark: n consecutive words of an item, or all words of a shorter one."""

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        words = Words(*buffers(chunk.column("__text")), ALNUM, lower=True)
        rows: list[tuple[int, int, int, bytes]] = []
        for k, at, hashes in _own_windows(words, n):
            rows += [(k, h, d, words.text(a, a + k)) for a, h, d in zip(at.tolist(), hashes.view(np.int64).tolist(), words.doc[at].tolist(), strict=True)]
        ids = chunk.column("item").to_pylist()
        return {"size": [r[0] for r in rows], "hash": [r[1] for r in rows], "item": [ids[r[2]] for r in rows], "words": [r[3] for r in rows]}

    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("__text"))
    return map_chunks(items, work, "size int, hash long, item string, words binary", "__text").distinct()


class Index:
    """The benchmark's windows by length: sorted hashes, and for each where its words stand and whose they are."""

    def __init__(self, items: pa.Table, n: int):
        """`items` has item and __text; an item is one row or several."""
        self.items: list[str] = []
        code: dict[str, int] = {}
        text, done = [], 0
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for chunk in chunks(iter(items.to_batches()), "__text"):
            words = Words(*buffers(chunk.column("__text")), ALNUM, lower=True)
            item = np.array([code.setdefault(x, len(code)) for x in chunk.column("item").to_pylist()], np.int32)
            # the words, one space after each
            size = words.ends - words.starts + 1
            stop = np.cumsum(size)
            begin = stop - size
            at = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(begin - words.starts, size)
            joined = words.data[np.minimum(at, len(words.data) - 1)] if len(at) else np.zeros(0, np.uint8)
            joined[stop - 1] = 0x20
            spans = Spans(joined)
            for k, first, hashes in _own_windows(words, n):
                a, b = begin[first], stop[first + k - 1] - 1
                own = item[words.doc[first]]
                twice = np.lexsort((own, spans.hashes(a, b), hashes))  # a window that an item repeats counts once
                h, s, o = hashes[twice], spans.hashes(a, b)[twice], own[twice]
                keep = twice[np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (o[1:] != o[:-1]))]
                parts.setdefault(k, []).append((hashes[keep].view(np.int64), (a[keep] + done).astype(np.uint32), (b - a)[keep].astype(np.int32), own[keep]))
            text.append(joined)
            done += len(joined)
        self.items = list(code)
        self.text = np.concatenate(text).tobytes() if text else b""
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for k, of in parts.items():
            hashes, start, size, item = (np.concatenate(x) for x in zip(*of, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.windows[k] = hashes[order], start[order], size[order], item[order]
        self._sieves: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_sieves": {}}

    def sieve(self, k: int) -> np.ndarray:
        """Which low bits of a hash occur, at 16 places or more for each window up to 16 million places."""
        if k not in self._sieves:
            known = self.windows[k][0]
            self._sieves[k] = np.zeros(1 << min(24, max(16, (16 * len(known)).bit_length())), bool)
            self._sieves[k][known & (len(self._sieves[k]) - 1)] = True
        return self._sieves[k]

    def whose(self, k: int, hash_: int, words: bytes) -> set[str]:
        """Items that hold these k words."""
        hashes, start, size, item = self.windows[k]
        out = set()
        for j in range(int(np.searchsorted(hashes, hash_)), int(np.searchsorted(hashes, hash_, "right"))):
            if self.text[start[j] : start[j] + size[j]] == words:
                out.add(self.items[item[j]])
        return out


def find_hits(words: Words, index: Index) -> list[tuple[int, int, int, set[str]]]:
    """(document, first word, number of words, items) of every verified hit."""
    out = []
    for k, (known, *_) in index.windows.items():
        at, hashes = words.windows(k)
        hashes = hashes.view(np.int64)
        sieve = index.sieve(k)
        maybe = np.flatnonzero(sieve[hashes & (len(sieve) - 1)])
        found = known[np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)] == hashes[maybe]
        for a, h in zip(at[maybe[found]].tolist(), hashes[maybe[found]].tolist(), strict=True):
            if items := index.whose(k, h, words.text(a, a + k)):
                out.append((int(words.doc[a]), a, k, items))
    return out


def _size(items: DataFrame, n: int) -> tuple[int, int]:
    """Windows of the benchmark, and bytes of its words."""

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        words = Words(*buffers(chunk.column("__text")), ALNUM, lower=True)
        return {"windows": np.where(words.counts > 0, np.maximum(words.counts - n + 1, 1), 0), "size": np.bincount(words.doc, weights=words.ends - words.starts + 1, minlength=words.n_docs)}

    got = map_chunks(items, work, "windows long, size double", "__text").agg(F.sum("windows"), F.sum("size")).first()
    return int(got[0] or 0), int(got[1] or 0)


_SCHEMA = "n_words long, n_hit long, items array<string>, spans array<int>"


def _summary(words: Words, hits: list[tuple[int, int, int, set[str]]]) -> dict[str, object]:
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(words.n_docs)]
    for d, a, k, of in hits:
        edge[a] += 1
        edge[a + k] -= 1
        items[d] |= of
    hit = np.cumsum(edge[:-1]) > 0
    at = np.flatnonzero(hit)
    spans: list[list[int]] = [[] for _ in range(words.n_docs)]
    if len(at):
        new = np.append(True, (np.diff(at) != 1) | (words.doc[at[1:]] != words.doc[at[:-1]]))
        lead, tail = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
        for a, b in zip(lead.tolist(), tail.tolist(), strict=True):
            d = words.doc[a]
            spans[d] += [int(words.starts[a] - words.offsets[d]), int(words.ends[b] - words.offsets[d])]
    n_hit = np.bincount(words.doc[at], minlength=words.n_docs)
    return {"n_words": words.counts, "n_hit": n_hit, "items": [sorted(x) for x in items], "spans": spans}


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", max_windows: int = MAX_WINDOWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of `docs` with n_words, n_hit, items (sorted as strings) and spans (start and end bytes of runs of hit words) in place of columns of those names.

    A null or empty text has no words; a very long one is scanned whole. Items
    without words match nothing; a null item_id counts as the id ''; items that
    share a window are all named. Repeated rows are scanned each; an empty
    benchmark hits nothing; an empty table gives an empty result; further columns
    pass through. The benchmark is counted, and gathered, when this is called.
    """
    spark = docs.sparkSession
    through = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    rows = docs.select(*through)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [_SCHEMA])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("__text"))
    n_windows, size = _size(items, n)
    if n_windows > max_windows or n_windows * _WINDOW_BYTES + size > max_bytes:
        return _scan_by_join(rows, materialise(item_windows(benchmark, n)), text, through, schema)
    index = spark.sparkContext.broadcast(Index(items.toArrow(), n))  # its bytes are checked above

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        words = Words(*buffers(chunk.column(text)), ALNUM, lower=True)
        return {c: chunk.column(c) for c in through} | _summary(words, find_hits(words, index.value))

    return map_chunks(rows, work, schema, text)


def _scan_by_join(rows: DataFrame, windows: DataFrame, text: str, through: list[str], schema: str) -> DataFrame:
    """The same result for a benchmark that is too large to broadcast: each distinct text is looked up once."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # n at most
    keys = ["__k1", "__k2"]
    keyed = rows.withColumns({"__k1": F.xxhash64(F.col(text)), "__k2": F.xxhash64(F.col(text), F.lit(1))})

    def cut(chunk: pa.RecordBatch) -> dict[str, object]:
        words = Words(*buffers(chunk.column(text)), ALNUM, lower=True)
        parts = [(k, *words.windows(k)) for k in sizes]
        at, hashes = (np.concatenate([x[i] for x in parts] or [np.zeros(0, np.int64)]) for i in (1, 2))
        doc = words.doc[at]
        size = np.concatenate([np.full(len(a), k) for k, a, _ in parts] or [np.zeros(0, np.int64)])
        return {k: chunk.column(k).to_numpy()[doc] for k in keys} | {"size": size, "hash": hashes.view(np.int64), "first": at - words.offs[doc]}

    lookup = windows.groupBy("size", "hash").agg(F.collect_list(F.struct("words", "item")).alias("of"))
    texts = keyed.filter(F.col(text).isNotNull()).select(text, *keys).dropDuplicates(keys)
    found = map_chunks(texts, cut, "`__k1` long, `__k2` long, size int, hash long, first int", text).join(lookup, ["size", "hash"])
    per_text = found.groupBy(*keys).agg(F.collect_list(F.struct("size", "first", "of")).alias("__hits"))
    counts = materialise(keyed.groupBy(*keys).agg(F.count("*").alias("n")))
    hot = hot_keys(counts, keys, counts.agg(F.sum("n")).first()[0] or 0)
    # rows that repeat one text are dealt out by their place
    joined = spread_join(keyed, per_text, keys, hot, F.monotonically_increasing_id(), "left")

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        words = Words(*buffers(chunk.column(text)), ALNUM, lower=True)
        hits = []
        for d, of in enumerate(chunk.column("__hits").to_pylist()):
            for h in of or []:
                a = int(words.offs[d]) + h["first"]
                same = words.text(a, a + h["size"])
                if items := {x["item"] for x in h["of"] if x["words"] == same}:
                    hits.append((d, a, h["size"], items))
        return {c: chunk.column(c) for c in through} | _summary(words, hits)

    return map_chunks(joined, work, schema, text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, text: str = "text") -> DataFrame:
    """`docs` without the benchmark: hit words are cut out of the text; a document of which more than `drop_share` of the words are hit is dropped.

    The columns are those of `docs`, whatever their names; only the text changes.
    Nulls, empty and very long texts, repeated rows, ties and empty tables are
    taken as scan takes them: a text without words stays as it is.
    """
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c != text}
    found = scan(docs.withColumnsRenamed(names), benchmark, n, text)
    left, columns = found.filter(F.col("n_hit") <= drop_share * F.col("n_words")), [names.get(c, c) for c in docs.columns]
    schema = ", ".join(f"`{names.get(f.name, f.name)}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(chunk: pa.RecordBatch) -> dict[str, object]:
        texts = chunk.column(text).to_pylist()
        for k, spans in enumerate(chunk.column("spans").to_pylist()):
            if spans:
                raw = texts[k].encode()
                texts[k] = b"".join(raw[a:b] for a, b in zip([0, *spans[1::2]], [*spans[0::2], len(raw)], strict=True)).decode()
        return {c: texts if c == text else chunk.column(c) for c in columns}

    return map_chunks(left, cut, schema, text).withColumnsRenamed({v: k for k, v in names.items()})


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document, for windows of ten words."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, sha256(string_agg(s, ',' ORDER BY s)) items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

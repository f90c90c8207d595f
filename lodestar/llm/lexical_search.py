"""Ranked lexical search by Fagin's threshold algorithm (operator 11).

Documents become a forward index: the terms of the queries that each one holds,
and how often. It is written once; counts over all of it give the weights. Each
task then reads its part in blocks of bounded size, sorts every term's postings
by impact, and answers each query by the threshold algorithm: lists are read in
turn from their highest impacts on, a few entries of each at a time; each document
that shows up is scored in full by lookups in the forward index; reading ends when
the threshold, the sum of the impacts that were read last, falls strictly below the
k-th score, so that equal scores are all seen. A task keeps its k best of each
query from block to block, so later blocks end earlier. The k best of all tasks are
ranked at the end.

Documents are never shuffled: what leaves a task is k rows a query. A term that
every document holds is as long a list as the block and no longer. Queries are
taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import ALNUM, Words, binary_column, buffers, bytes_of, map_chunks, materialise, table

#: Bytes of query texts that are searched in one pass over the documents.
QUERY_BYTES = 4 << 20
#: Postings of one block.
BLOCK_POSTINGS = 1 << 20
#: Entries read of each list in the first round and at most in a later one.
FIRST_READ, LARGEST_READ = 8, 512
#: An impact is below 2 ** 20; so many bits tell documents of a block apart.
_IMPACT, _DOC = 20, 22
_NO_ID = np.iinfo(np.int64).max


def _edges(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of every word, as numbers."""
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    loads = np.ndarray(len(words.data) + 1, np.uint64, padded, strides=(1,))
    length = words.ends - words.starts
    mask = np.where(length < 8, (np.uint64(1) << (np.uint64(8) * np.minimum(length, 7).astype(np.uint64))) - np.uint64(1), ~np.uint64(0))
    return loads[words.starts] & mask, loads[np.maximum(words.starts, words.ends - 8)] & mask


class Vocabulary:
    """The distinct terms of some queries, known by hash, length, first and last eight bytes."""

    def __init__(self, words: Words):
        order = np.argsort(words.hashes, kind="stable")
        self.hashes, first = np.unique(words.hashes[order], return_index=True)
        at = order[first]
        self.length = (words.ends - words.starts)[at]
        self.head, self.tail = (x[at] for x in _edges(words))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the number of each term."""
        if not len(self) or not len(words.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self) - 1)
        at = np.flatnonzero(self.hashes[term] == words.hashes)
        term = term[at]
        head, tail = _edges(words)
        same = (self.length[term] == (words.ends - words.starts)[at]) & (self.head[term] == head[at]) & (self.tail[term] == tail[at])
        return at[same], term[same]


def _counted(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and occurrences, in the order of texts and terms."""
    at, term = vocabulary.find(words)
    key, tf = np.unique(words.doc[at].astype(np.uint64) << np.uint64(32) | term.astype(np.uint64), return_counts=True)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), tf


def forward_index(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: how many it has, and which of the vocabulary how often (32-bit numbers)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        words = Words(*buffers(chunk.column("__text")), ALNUM, lower=True)
        doc, term, tf = _counted(words, shared.value)
        rows = np.flatnonzero(words.counts)
        lengths = np.bincount(doc, minlength=words.n_docs)[rows]
        return {
            "id": chunk.column("id").take(pa.array(rows)),
            "n": words.counts[rows],
            "terms": binary_column(term.astype(np.uint32), lengths),
            "tfs": binary_column(tf.astype(np.uint32), lengths),
        }

    return map_chunks(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("__text")), work, "id long, n long, terms binary, tfs binary", "__text")


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(bytes_of(batch.column(column)), np.uint32).astype(np.int64)


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n): in how many documents a term occurs; -1 counts the documents, -2 all terms with repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            more = np.bincount(_numbers(batch, "terms"))
            df = np.pad(df, (0, max(0, len(more) - len(df))))
            df[: len(more)] += more
            docs, length = docs + batch.num_rows, length + int(batch.column("n").to_numpy().sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, length]))], ["term", "n"])

    return index.select("n", "terms").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def weights(counts: dict[int, int], n_docs: int, n_terms: int) -> np.ndarray:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(n_terms)], np.int64)


class Query:
    """A query's terms with their weights, repeats included; terms that weigh nothing are left out."""

    def __init__(self, terms: np.ndarray, times: np.ndarray, weight: np.ndarray):
        keep = weight[terms] > 0
        self.terms, self.weight = terms[keep], (weight[terms] * times)[keep]


class Best:
    """The k best documents of a query: by score, then by id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:
            worth = score >= self.score[-1]
            score, ids = score[worth], ids[worth]
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        first = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[first], ids[first]

    def last(self) -> int:
        """The k-th score; below all others while there are fewer documents."""
        return int(self.score[-1]) if len(self.score) == self.k else -1


class Block:
    """Impact-sorted lists and the forward index of some documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, total: int, n_terms: int):
        self.ids, self.n_terms = ids, n_terms
        doc = np.repeat(np.arange(len(ids)), lengths)
        m = 75 + (25 * n * n_docs) // max(1, total)
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc])
        self.forward, self.forward_impact = doc * n_terms + terms, impact  # rises, as documents and their terms do
        key = (terms << (_IMPACT + _DOC)) | (((1 << _IMPACT) - 1 - impact) << _DOC) | doc
        key.sort()
        self.begin = np.searchsorted(key, np.arange(n_terms + 1) << (_IMPACT + _DOC))
        self.doc = key & ((1 << _DOC) - 1)
        self.impact = (1 << _IMPACT) - 1 - ((key >> _DOC) & ((1 << _IMPACT) - 1))
        self.seen = np.zeros(len(ids), bool)

    def scores(self, docs: np.ndarray, query: Query) -> np.ndarray:
        """Whole scores, by lookups of each document's terms."""
        if not len(self.forward):
            return np.zeros(len(docs), np.int64)
        wanted = docs[:, None] * self.n_terms + query.terms[None, :]
        at = np.minimum(np.searchsorted(self.forward, wanted), len(self.forward) - 1)
        return (np.where(self.forward[at] == wanted, self.forward_impact[at], 0) * query.weight).sum(axis=1)

    def search(self, query: Query, best: Best) -> int:
        """Threshold algorithm; gives the number of documents that were scored."""
        begin, end = self.begin[query.terms], self.begin[query.terms + 1]
        live = end > begin
        begin, end, weight = begin[live], end[live], query.weight[live]
        depth, step, touched = 0, FIRST_READ, []
        # before anything is read, the highest impacts bound every score
        threshold = int((self.impact[begin] * weight).sum())
        while len(begin) and threshold >= best.last():
            at = begin[:, None] + depth + np.arange(step)
            docs = np.unique(self.doc[at[at < end[:, None]]])
            docs = docs[~self.seen[docs]]
            self.seen[docs] = True
            touched.append(docs)
            score = self.scores(docs, query)
            best.add(score[score > 0], self.ids[docs[score > 0]])
            depth += step
            step = min(2 * step, LARGEST_READ)
            more = begin + depth < end  # an unseen document is in no list that was read to its end
            begin, end, weight = begin[more], end[more], weight[more]
            threshold = int((self.impact[begin + depth - 1] * weight).sum())
        for docs in touched:
            self.seen[docs] = False
        return sum(len(d) for d in touched)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size, rows = [], 0, 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            size, rows = size + len(bytes_of(part.column("terms"))) // 4, rows + part.num_rows
            held.append(part)
            if size >= BLOCK_POSTINGS or rows >= (1 << _DOC) - 256:
                yield held
                held, size, rows = [], 0, 0
    if held:
        yield held


def _search_block(index: DataFrame, items: list[tuple[object, np.ndarray, np.ndarray]], n_terms: int, k: int, id_field: pa.DataType, id_kind: str) -> DataFrame:
    """(query, item_id, doc_id, score): the k best of each task."""
    counts = {r["term"]: r["n"] for r in frequencies(index).collect()}  # a row for each term of a block of queries
    n_docs, total = counts.pop(-1, 0), counts.pop(-2, 0)
    weight = weights(counts, n_docs, n_terms)
    shared = index.sparkSession.sparkContext.broadcast([(item, Query(terms, times, weight)) for item, terms, times in items])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [Best(k) for _ in queries]
        for held in _blocks(batches):
            column = lambda c: np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held])
            ids = np.concatenate([x.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False) for x in held]).astype(np.int64)
            lengths = np.concatenate([pc.binary_length(x.column("terms")).to_numpy() for x in held]).astype(np.int64) // 4
            terms, tfs = (np.concatenate([_numbers(x, c) for x in held]) for c in ("terms", "tfs"))
            block = Block(ids, column("n").astype(np.int64), lengths, terms, tfs, n_docs, total, n_terms)
            for (_, query), found in zip(queries, best, strict=True):
                block.search(query, found)
        for number, ((item, _), found) in enumerate(zip(queries, best, strict=True)):
            if n := len(found.score):
                ids = pa.array(found.id, mask=found.id == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array([item] * n, id_field), ids, pa.array(found.score)], ["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(work, f"query int, item_id {id_kind}, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every query, those with a score above 0.

    Equal scores stand by ascending id, documents without an id last; rows that
    repeat an id or a text are documents of their own. A null or empty text has
    no terms and is no document; a very long one is indexed whole. Queries of
    equal id and text are one query; of equal id and other text, each has a ranking;
    a query without terms has none. An empty table gives an empty result; other
    columns are not read. Document ids are whole numbers. Counting, and writing
    the forward index, happen when this is called.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    asked = queries.select(F.col(query_id).alias("item_id"), F.col(query_text).alias("text")).filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // QUERY_BYTES))
    kind = asked.schema["item_id"].dataType
    found = None
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()  # about QUERY_BYTES
        words = Words(*buffers(pa.array([r["text"] for r in rows], pa.string())), ALNUM, lower=True)
        vocabulary = Vocabulary(words)
        doc, term, times = _counted(words, vocabulary)
        bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
        items = [(r["item_id"], term[a:z], times[a:z]) for r, a, z in zip(rows, bounds[:-1], bounds[1:], strict=True) if z > a]
        index = materialise(forward_index(docs, vocabulary, doc_id, text))
        part = _search_block(index, items, len(vocabulary), k, to_arrow_type(kind), kind.simpleString()).withColumn("query", F.struct(F.lit(b).alias("block"), "query"))
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term FROM benchmark),
n AS (SELECT doc_id, count(*) n FROM d GROUP BY doc_id),
a AS (SELECT count(*) nd, CAST(sum(n) AS BIGINT) l FROM n),
tf AS (SELECT doc_id, term, count(*) tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) w FROM tf, a GROUP BY term, nd),
i AS (SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))) x FROM tf JOIN w USING (term) JOIN n USING (doc_id), a),
s AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(x) > 0),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""

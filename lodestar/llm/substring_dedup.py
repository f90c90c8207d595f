"""Substring deduplication by sliding sentence spans (operator 7).

A text is cut into sentences; at every sentence starts a run: at least
`sentences` consecutive sentences, and further ones until the run has at least
`words` words (so that short, common sentences alone make no run). Each run is
hashed; hashes are counted over the whole table; of a repeated hash, the first
run in the order of (document id, position) stays, and every sentence that any
other of its runs covers is removed.

Sentences alone miss a passage that is cut in one or two long ones. With
`passage`, spans of half that many words join the runs, at places which the words
of the passage alone decide: every passage of so many words holds a span, in all
its copies the same one, and the spans of a longer passage leave no gap. Words
that they cover are removed also from sentences of which something stays; at
either end of a passage less than half of `passage` words may stay.

Counting moves one 8-byte hash per run and combines before the shuffle, so a
passage in a third of all documents is one row per task. Only repeated runs are
moved a second time, with a 128-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, HOT, SALTS, Words, buffers, hot_keys, map_chunks, materialise, mix, spread_join, table

_STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: What tells rows apart: hashes of the id and the text together.
_KEY = ["__key", "__key2"]
_ROW = ["__id", *_KEY]


class Sentences:
    """Sentences of a chunk: a piece of text up to and with its closing `.`, `!`, `?` or line ends, if it has a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(data, offsets, ALNUM, lower=True)
        self.offsets = offsets
        stop = _STOPS[data]
        opens = np.append(False, stop[:-1] & ~stop[1:]) if len(data) else stop
        opens[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.begins = np.flatnonzero(opens)  # first byte of each piece
        piece = np.searchsorted(self.begins, self.words.starts, "right") - 1
        first = np.append(True, piece[1:] != piece[:-1]) if len(piece) else np.zeros(0, bool)
        self.first_word = np.flatnonzero(first)
        self.piece = piece[self.first_word]
        self.doc = self.words.doc[self.first_word]
        self.n = len(self.first_word)
        self.counts = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.offs = np.concatenate([[0], np.cumsum(self.counts)])

    def runs(self, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, end, and two hashes of every run."""
        if not self.n:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        bounds = np.append(self.first_word, len(self.words.hashes))
        start = np.arange(self.n)
        end = np.maximum(start + sentences, np.searchsorted(bounds, bounds[:-1] + words))
        whole = end <= self.offs[self.doc + 1]
        return self.hashed(bounds[start[whole]], bounds[end[whole]])

    def hashed(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans of words with two hashes of each."""
        return start, end, *(_range_hash(self.words.hashes ^ salt, start, end) for salt in (np.uint64(0), _SECOND))

    def spans(self, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, end, and two hashes of the spans: in each passage, those with the smallest hash of all its spans."""
        k = passage // 2 + 1
        w = passage - k + 1  # spans in a passage; fewer than words in a span, so neighbours overlap
        doc, n = self.words.doc, len(self.words.doc)
        at, h = self.words.windows(k)
        hashes = np.full(n, ~np.uint64(0))
        hashes[at] = h
        least = _sliding(np.minimum, hashes, w)
        # a passage that leaves its text chooses nothing
        inside = np.zeros(n, bool)
        inside[: max(0, n - passage + 1)] = doc[: max(0, n - passage + 1)] == doc[passage - 1 :]
        least[~inside] = 0
        chosen = _sliding(np.maximum, least[::-1], w)[::-1]
        start = at[chosen[at] == h]
        return self.hashed(start, start + k)

    def bytes_of(self, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the pieces."""
        ends = np.append(self.begins, len(self.words.data))
        return ends[self.piece[sentence]], ends[self.piece[sentence] + 1]


def _sliding(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """f over x[i : i + w] for every i, and over what is left at the end."""
    x, done = x.copy(), 1
    while done < w:
        step = min(done, w - done)
        x[: max(0, len(x) - step)] = f(x[: max(0, len(x) - step)], x[step:])
        done += step
    return x


def _range_hash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of hashes[start:end] for every pair."""
    from .text import powers

    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def repeated_runs(docs: DataFrame, sentences: int, words: int, text: str, passage: int | None = None) -> DataFrame:
    """(__key, __key2, start, end): first word and end of the runs that are not the first of their kind.

    With `passage`, a run that overlaps the first of its kind in the same text begins where that ends.
    """

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        found = Sentences(*buffers(chunk.column("__text")))
        start, end, h1, h2 = found.runs(sentences, words)
        if passage:
            start, end, h1, h2 = (np.concatenate(x) for x in zip((start, end, h1, h2), found.spans(passage), strict=True))
        doc = found.words.doc[start]
        base = found.words.offs[doc]
        own = {c: chunk.column(c).take(pa.array(doc)) for c in _ROW}
        return own | {"start": start - base, "end": end - base, "h1": h1.view(np.int64), "h2": h2.view(np.int64)}

    kind = docs.schema["__id"].dataType.simpleString()
    runs = map_chunks(docs.select(*_ROW, F.col(text).alias("__text")), work, f"`__id` {kind}, `__key` long, `__key2` long, start int, end int, h1 long, h2 long", "__text")
    often = materialise(runs.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1"))
    total = often.agg(F.sum("n")).first()[0] or 0
    # a hash with a thousandth of the repeats is dealt out by salt; there are a thousand such at most
    hot = F.broadcast(often.filter(F.col("n") * HOT >= total).select("h1", F.lit(True).alias("hot")))
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("__key", "__key2", "start"), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = runs.join(hot, "h1", "left").withColumn("salt", salt).drop("hot")
    again = materialise(salted.join(often.join(hot, "h1", "left").select("h1", copies), ["h1", "salt"], "left_semi"))
    place = F.struct(F.col("__id").isNull().alias("last"), *_ROW, "start")  # rows without an id come last
    first = again.groupBy("h1", "h2").agg(F.min(place).alias("first")).join(hot, "h1", "left").select("h1", "h2", "first", copies)
    repeats = again.join(first, ["h1", "h2", "salt"]).filter(~place.eqNullSafe(F.col("first")))
    if passage:
        same = (F.col("__key") == F.col("first.__key")) & (F.col("__key2") == F.col("first.__key2"))
        repeats = repeats.withColumn("start", F.when(same, F.greatest("start", F.col("first.start") + F.col("end") - F.col("start"))).otherwise(F.col("start")))
    return repeats.select(*_KEY, "start", "end")


def remove_repeats(docs: DataFrame, sentences: int = 2, words: int = 15, doc_id: str = "doc_id", text: str = "text", passage: int | None = None) -> DataFrame:
    """Every row of `docs` with the shortened text, and n_sentences, n_removed in place of columns of those names.

    With `passage`, no passage of so many words is left in two texts, however
    long its sentences are; n_removed counts the sentences that go as a whole.
    A null text stays null and has no sentences; a very long one is searched
    whole. Ids may have any type that has an order. Rows without an id come last
    in the order of documents. Rows with equal id and text are one document that
    occurs more than once: they keep or lose the same sentences. A document that
    loses all its sentences stays as a row with what is left of its text. An
    empty table gives an empty result; further columns pass through (names that
    begin with two underscores are used inside). The runs are counted, and the
    repeated ones written, when this is called.
    """
    through = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    marks = {"__id": F.col(doc_id), "__key": F.xxhash64(text, doc_id), "__key2": F.xxhash64(doc_id, F.lit(1), text)}
    keyed = docs.select(*through, *[c.alias(k) for k, c in marks.items()])
    runs = repeated_runs(keyed, sentences, words, text, passage)
    gone = runs.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("__gone"), F.count("*").alias("n"))
    gone = materialise(gone.withColumn("n", F.col("n") / F.size("__gone")))  # about the rows that are this document
    joined = spread_join(keyed, gone.select(*_KEY, "__gone"), _KEY, hot_keys(gone, _KEY, docs.count()), F.monotonically_increasing_id(), "left")
    rows = docs.select(*through)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["n_sentences long, n_removed long"])

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        column = chunk.column(text)
        found = Sentences(*buffers(column))
        removed = np.zeros(len(column), np.int64)
        texts = None
        gone = chunk.column("__gone")
        for d in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
            texts = texts or column.to_pylist()
            base, n = int(found.words.offs[d]), int(found.words.counts[d])
            out = np.zeros(n, bool)
            for r in gone[d].as_py():
                out[r["start"] : r["end"]] = True
            first = found.first_word[found.offs[d] : found.offs[d + 1]] - base
            whole = np.logical_and.reduceat(out, first)
            removed[d] = whole.sum()
            # words of other sentences go with what follows them, the last one of a sentence without its end
            part = np.flatnonzero(out & ~np.repeat(whole, np.diff(np.append(first, n))))
            last = np.isin(part, np.append(first[1:], n) - 1)
            ends = np.where(last, found.words.ends[base + part], found.words.starts[base + part + ~last])
            cuts = np.zeros(int(found.offsets[d + 1] - found.offsets[d]) + 1, np.int64)
            for a, b in (found.bytes_of(np.flatnonzero(whole) + found.offs[d]), (found.words.starts[base + part], ends)):
                np.add.at(cuts, a - found.offsets[d], 1)
                np.add.at(cuts, b - found.offsets[d], -1)
            texts[d] = np.frombuffer(texts[d].encode(), np.uint8)[np.cumsum(cuts[:-1]) == 0].tobytes().decode()
        return {c: (texts if c == text and texts else chunk.column(c)) for c in through} | {"n_sentences": found.counts, "n_removed": removed}

    return map_chunks(joined, work, schema, text)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its text after removal."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")


OP7_SQL = """
WITH p AS (SELECT doc_id, unnest(x) piece, generate_subscripts(x, 1) k FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+') x FROM documents)),
w AS (SELECT *, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws FROM p),
s AS (SELECT doc_id, k, ws, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 s,
             sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY k) upto FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
a AS (SELECT doc_id, list(ws ORDER BY s) wss, list(upto ORDER BY s) ups FROM s GROUP BY doc_id),
r0 AS (SELECT s.doc_id, s.s, greatest(s.s + 2, s.s + 1 + len(list_filter(list_slice(a.ups, s.s + 1, len(a.ups)), lambda u: u - (s.upto - len(s.ws)) < 15))) e, a.wss, n.n
       FROM s JOIN a USING (doc_id) JOIN n USING (doc_id)),
r AS (SELECT doc_id, s, e, array_to_string(flatten(list_slice(wss, s + 1, e)), ' ') g FROM r0 WHERE e <= n),
f AS (SELECT g, min((doc_id, s)) first FROM r GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e)) s FROM r JOIN f USING (g) WHERE (doc_id, s) <> first),
gk AS (SELECT s.doc_id, s.k FROM s JOIN gone USING (doc_id, s)),
t AS (SELECT p.doc_id, coalesce(string_agg(CASE WHEN gk.k IS NULL THEN piece END, '' ORDER BY p.k), '') text, count(gk.k) n_removed
      FROM p LEFT JOIN gk USING (doc_id, k) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_sentences, CAST(coalesce(t.n_removed, 0) AS BIGINT) n_removed, coalesce(t.text, d.text) text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

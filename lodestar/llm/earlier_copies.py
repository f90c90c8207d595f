"""Suffix-array dedup: bytes that an earlier document holds too (operator 12).

A byte goes if a string of `length` bytes that covers it also starts in a document
with a smaller id. Longest-previous-factor arrays find such strings: suffixes stand
in order, the nearest ones before and after with a smaller id give the longest
earlier match, and a match of `length` bytes or more counts.

No suffix array of a whole corpus fits a task, so suffixes that cannot match each
other are kept apart. Each window of `length` bytes names its anchor, the piece of
ANCHOR bytes in it with the smallest hash: equal windows have equal anchors. The
windows of one anchor that follow each other in a text are one context of at most
84 bytes. Texts are dealt into chunks of about CHUNK bytes, and in three steps over
them

1. each chunk sends what its contexts are (32 bits of the anchor, 64 of the context,
   the smallest id, once for equal contexts) to buckets by anchor; a bucket answers
   with a state for each: nobody else has the anchor, a smaller id has the same
   context, or other contexts share the anchor;
2. each chunk sends the bytes of the last kind to buckets by anchor, where suffix
   order and longest previous factors tell which of their windows match;
3. each chunk cuts its texts.

Equal contexts in a chunk are one, so a passage in a third of all documents is a row
for each chunk and no more. An anchor with very many contexts is not gathered: its
windows go by themselves, by their own hash, equal ones of a chunk once. Texts are
shuffled once; all steps read the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .text import Spans, binary_column, buffers, bytes_of, mix, small_batches, table

#: Bytes of an anchor.
ANCHOR = 16
#: Bytes of text of a chunk, on average; and bytes of text for each bucket (about a fifteenth of them are sent there).
CHUNK, BUCKET, LEAST_BUCKETS = 1 << 20, 16 << 20, 64
#: Contexts of one anchor that one task compares; windows of a more common one go by themselves.
COMMON = 20_000
#: Bytes of contexts that are sorted at once.
SLICE = 1 << 20
ALONE, COPY, COMPARED, SCATTERED = range(4)
_NO_ID = np.iinfo(np.int64).max
_STATES = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("entries", pa.binary()), ("states", pa.binary())])


class Contexts:
    """The contexts of a chunk, whose first two columns are ids and texts: one run for each, and an entry for equal ones."""

    def __init__(self, texts: pa.Table, length: int, n_buckets: int):
        ids, column = (texts.column(i).combine_chunks() for i in (0, 1))
        self.length, self.ids = length, ids.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.data, self.offsets = buffers(column)
        found = [self._runs(at, end) for at, end in self._blocks()]
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.first, self.last, anchor, context = (np.concatenate(x) for x in zip(empty, *found, strict=True))
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1
        run_id = self.ids[self.doc]
        bucket = (anchor >> np.uint64(33)) % np.uint64(n_buckets)
        key = bucket << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)
        order = np.lexsort((run_id, context, key))
        k, c = key[order], context[order]
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(order) else np.zeros(0, bool)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        #: For each entry: a run of the smallest id that has it.
        self.run = order[new]
        self.key, self.context, self.id = k[new], c[new], run_id[self.run]

    def _blocks(self) -> list[tuple[int, int]]:
        """Ranges of about CHUNK bytes that cut no text but one longer than that, which is cut at places counted from its start; so runs do not depend on the order of rows."""
        size = np.diff(self.offsets)
        pieces = np.maximum(1, -(-size // CHUNK))
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        bounds = np.append(np.repeat(self.offsets[:-1], pieces) + number * CHUNK, len(self.data))
        blocks, i = [], 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
            blocks.append((int(bounds[i]), int(bounds[j])))
            i = j
        return blocks

    def _runs(self, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run of windows that start in a range, hashes of its anchor and of its context."""
        data, length = self.data[at : end + self.length - 1], self.length
        n = len(data) - length + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        spans = Spans(data)
        starts = np.arange(len(data) - ANCHOR + 1)
        hashes = spans.hashes(starts, starts + ANCHOR)
        least, place, wide, done = hashes.copy(), starts.astype(np.int32), length - ANCHOR + 1, 1
        while done < wide:
            step = min(done, wide - done)
            less = least[step:] < least[:-step]  # the first of equal ones stays
            place = np.append(np.where(less, place[step:], place[:-step]), place[-step:])
            least = np.append(np.minimum(least[step:], least[:-step]), least[-step:])
            done += step
        inside = np.ones(n, bool)
        ends = self.offsets[1:] - at
        ends = ends[(ends > 0) & (ends < n + length)]
        beyond = (ends[:, None] - np.arange(1, length)).ravel()
        inside[beyond[(beyond >= 0) & (beyond < n)]] = False
        windows = np.flatnonzero(inside)
        if not len(windows):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        anchors = place[windows].astype(np.int64)
        new = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        first, last, anchor = windows[new], windows[np.append(new[1:], len(windows)) - 1], anchors[new]
        context = mix(spans.hashes(first, last + length) ^ (anchor - first).astype(np.uint64))
        return first + at, last + at, hashes[anchor], context

    def windows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, number and first byte of every window of some entries."""
        run = self.run[entries]
        size = self.last[run] - self.first[run] + 1
        number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(entries, size), number, np.repeat(self.first[run], size) + number

    def scattered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entry, number, first byte and hash of the windows of some entries, and for each the place of the window that stands for it: of equal ones that of the smallest id."""
        entry, number, start = self.windows(entries)
        if not len(entry):
            return entry, number, start, np.zeros(0, np.uint64), entry
        spans = Spans(self.data)
        hashes = spans.hashes(start, start + self.length)
        order = np.lexsort((self.id[entry], hashes))
        new = np.append(True, hashes[order][1:] != hashes[order][:-1])
        leader = np.empty(len(order), np.int64)
        leader[order] = order[new][np.cumsum(new) - 1]
        rows = self.data[start[:, None] + np.arange(self.length)]
        differs = (rows != rows[leader]).any(axis=1)
        leader[differs] = np.flatnonzero(differs)
        return entry, number, start, hashes, leader


def _table(rows: dict[str, object], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([rows[f.name] if isinstance(rows[f.name], pa.Array) else pa.array(rows[f.name], f.type) for f in schema], schema=schema)


_SENT = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("base", pa.int64()), ("heads", pa.binary()), ("contexts", pa.binary()), ("ids", pa.binary())])


def _send(chunk: int, texts: pa.Table, length: int, n_buckets: int) -> pa.Table:
    """What the contexts of a chunk are, a row for each bucket; ids as distances from `base`, in 32 bits where they fit."""
    c = Contexts(texts, length, n_buckets)
    bucket = (c.key >> np.uint64(32)).astype(np.int64)
    which, size = np.unique(bucket, return_counts=True)
    base = int(c.id.min(initial=_NO_ID))
    near = np.uint32 if len(c.id) and int(c.id.max()) - base < 1 << 32 else np.uint64
    ids = (c.id.astype(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)).astype(near)
    heads = (c.key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows = {"chunk": [chunk] * len(which), "bucket": which.astype(np.int32), "base": [base] * len(which)}
    return _table(rows | {"heads": binary_column(heads, size), "contexts": binary_column(c.context, size), "ids": binary_column(ids, size)}, _SENT)


def _lengths(column: pa.ChunkedArray, width: int) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column.combine_chunks()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // width


def _values(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(bytes_of(column.combine_chunks()), kind)


def _decide(sent: pa.Table) -> pa.Table:
    """The state of every context of a bucket."""
    size = _lengths(sent.column("heads"), 4)
    head, context = _values(sent.column("heads"), np.uint32), _values(sent.column("contexts"), np.uint64)
    ids = np.concatenate([np.frombuffer(b, np.uint32 if len(b) == 4 * n else np.uint64).astype(np.uint64) + np.uint64(base & 0xFFFFFFFFFFFFFFFF) for b, n, base in zip(sent.column("ids").to_pylist(), size, sent.column("base").to_pylist(), strict=True)])
    ids = ids.astype(np.int64)
    order = np.lexsort((ids, context, head))
    h, c, i = head[order], context[order], ids[order]
    new_head = np.append(True, h[1:] != h[:-1])
    new = new_head | np.append(True, c[1:] != c[:-1])
    least = i[new][np.cumsum(new) - 1]
    kinds = np.bincount(np.cumsum(new_head) - 1, weights=new)[np.cumsum(new_head) - 1]
    states = np.empty(len(order), np.uint8)
    states[order] = np.where(i > least, COPY, np.where(kinds > COMMON, SCATTERED, np.where(kinds > 1, COMPARED, ALONE)))
    n = len(size)
    return _table({"chunk": sent.column("chunk").combine_chunks(), "bucket": sent.column("bucket").combine_chunks(), "kind": [0] * n, "entries": [b""] * n, "states": binary_column(states, size)}, _STATES)


def _states(c: Contexts, answers: pa.Table) -> np.ndarray:
    """The state of every entry of a chunk."""
    states = np.zeros(len(c.key), np.uint8)
    begin = np.searchsorted(c.key, answers.column("bucket").to_numpy().astype(np.uint64) << np.uint64(32))
    for at, b in zip(begin.tolist(), answers.column("states").to_pylist(), strict=True):
        states[at : at + len(b)] = np.frombuffer(b, np.uint8)
    return states


_BYTES = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("heads", pa.binary()), ("entries", pa.binary()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("bytes", pa.binary())])


def _send_bytes(chunk: int, texts: pa.Table, answers: pa.Table, length: int, n_buckets: int) -> pa.Table:
    """The bytes of contexts that must be compared, and the windows of those that are scattered, a row for each bucket."""
    c = Contexts(texts, length, n_buckets)
    states = _states(c, answers)
    entry = np.flatnonzero(states == COMPARED)
    run = c.run[entry]
    start, size, number, key = c.first[run], c.last[run] - c.first[run] + length, np.zeros(len(entry), np.int64), c.key[entry]
    one, its_number, at, hashes, leader = c.scattered(np.flatnonzero(states == SCATTERED))
    lead = np.flatnonzero(leader == np.arange(len(leader)))
    its_key = ((hashes >> np.uint64(33)) % np.uint64(n_buckets)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
    entry, number, key = np.append(entry, one[lead]), np.append(number, its_number[lead]), np.append(key, its_key[lead])
    start, size = np.append(start, at[lead]), np.append(size, np.full(len(lead), length))
    order = np.argsort(key, kind="stable")
    entry, number, key, start, size = entry[order], number[order], key[order], start[order], size[order]
    which, rows = np.unique((key >> np.uint64(32)).astype(np.int64), return_counts=True)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    held = np.add.reduceat(size, np.cumsum(rows) - rows) if len(rows) else rows
    out = {"heads": binary_column((key & np.uint64(0xFFFFFFFF)).astype(np.uint32), rows), "entries": binary_column(entry.astype(np.uint32), rows), "numbers": binary_column(number.astype(np.uint8), rows)}
    out |= {"sizes": binary_column(size.astype(np.uint8), rows), "ids": binary_column(c.id[entry], rows), "bytes": binary_column(c.data[place], held)}
    return _table(out | {"chunk": [chunk] * len(which), "bucket": which.astype(np.int32)}, _BYTES)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at `starts` in the order of their first `length` bytes, and which of them equal the one before in all of these; equal ones stand in the order of `starts`.

    Eight bytes are compared at a time, further ones only among suffixes that are
    equal so far.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    tied = np.arange(len(starts))
    for depth in range(0, length, 8):
        if not len(tied):
            break
        piece = loads[starts[order[tied]] + depth].astype(np.uint64)
        if length - depth < 8:
            piece >>= np.uint64(8 * (8 - length + depth))
        by = np.lexsort((piece, group[tied]))
        order[tied], piece, inner = order[tied][by], piece[by], group[tied][by]
        new = np.append(True, (inner[1:] != inner[:-1]) | (piece[1:] != piece[:-1]))
        # a group is named by the place of its first suffix
        group[tied] = tied[new][np.cumsum(new) - 1]
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
    same = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, bool)
    return order, same


def _nearest_smaller(ids: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller id and `same` all the way; -1 if there is none."""
    before = np.where(same, np.arange(len(ids)) - 1, -1)
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[ids[before[open_]] >= ids[open_]]
        # what lies between is not smaller either, so that one's own pointer may be taken over
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def previous_factors(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes have a longest previous factor of `length` bytes or more: one with a smaller id begins with the same ones.

    In suffix order that is the nearest smaller one before or after, if the common
    prefixes on the way to it reach `length`.
    """
    order, same = suffix_order(data, starts, length)
    ids = ids[order]
    before = _nearest_smaller(ids, same)
    after = _nearest_smaller(ids[::-1], np.append(False, same[1:][::-1]) if len(same) else same)[::-1]
    found = np.zeros(len(starts), bool)
    found[order] = (before >= 0) | (after >= 0)
    return found


def _compare(sent: pa.Table, length: int) -> pa.Table:
    """For every context of a bucket that matches: a bit for each of its windows."""
    rows = _lengths(sent.column("heads"), 4)
    head, entry, ids = _values(sent.column("heads"), np.uint32), _values(sent.column("entries"), np.uint32), _values(sent.column("ids"), np.int64)
    number, size, data = _values(sent.column("numbers"), np.uint8).astype(np.uint64), _values(sent.column("sizes"), np.uint8).astype(np.int64), _values(sent.column("bytes"), np.uint8)
    begin = np.cumsum(size) - size
    order = np.argsort(head, kind="stable")
    bits = np.zeros(len(head), np.uint64)
    ends = np.flatnonzero(np.append(head[order][1:] != head[order][:-1], True)) + 1  # contexts of one anchor stay together
    total, at = np.cumsum(size[order]), 0
    while at < len(order):
        end = int(ends[np.searchsorted(ends, max(at + 1, np.searchsorted(total, (total[at - 1] if at else 0) + SLICE)))])
        part = order[at:end]
        n = size[part] - length + 1
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which = np.repeat(part, n)
        match = previous_factors(data, begin[which] + own, ids[which], length)
        np.bitwise_or.at(bits, which[match], np.uint64(1) << (own[match].astype(np.uint64) + number[which[match]]))
        at = end
    row = np.repeat(np.arange(len(rows)), rows)
    hit = np.flatnonzero(bits)
    n = np.bincount(row[hit], minlength=len(rows))
    out = {"chunk": sent.column("chunk").combine_chunks(), "bucket": sent.column("bucket").combine_chunks(), "kind": [1] * len(rows)}
    return _table(out | {"entries": binary_column(entry[hit], n), "states": binary_column(bits[hit], n)}, _STATES).filter(pa.array(n > 0))


def removed_spans(texts: pa.Table, answers: pa.Table, length: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and end (within the chunk) of the strings that earlier documents hold."""
    c = Contexts(texts, length, n_buckets)
    kind = answers.column("kind").to_numpy()
    states = _states(c, answers.filter(pa.array(kind == 0)))
    bits = np.zeros(len(c.key), np.uint64)
    masks = answers.filter(pa.array(kind == 1))
    np.bitwise_or.at(bits, _values(masks.column("entries"), np.uint32), _values(masks.column("states"), np.uint64))
    entry, number, _, _, leader = c.scattered(np.flatnonzero(states == SCATTERED))
    led = np.flatnonzero((c.id[entry] > c.id[entry[leader]]) | (bits[entry[leader]] >> number[leader].astype(np.uint64) & np.uint64(1) > 0))
    np.bitwise_or.at(bits, entry[led], np.uint64(1) << number[led].astype(np.uint64))
    whole = (c.ids[c.doc] > c.id[c.entry]) | (states[c.entry] == COPY)
    part = np.flatnonzero(~whole & (bits[c.entry] > 0))
    width = c.last[part] - c.first[part] + 1
    own = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    of = np.repeat(part, width)
    hit = bits[c.entry[of]] >> own.astype(np.uint64) & np.uint64(1) > 0
    at = c.first[of[hit]] + own[hit]
    return np.append(c.doc[whole], c.doc[of[hit]]), np.append(c.first[whole], at), np.append(c.last[whole], at) + length


def _cut(texts: pa.Table, answers: pa.Table, length: int, n_buckets: int, through: list[str], schema: pa.Schema) -> pa.Table:
    _, begin, end = removed_spans(texts, answers, length, n_buckets)
    data, offsets = buffers(texts.column(1).combine_chunks())
    cuts = np.zeros(len(data) + 1, np.int32)
    np.add.at(cuts, begin, 1)
    np.add.at(cuts, end, -1)
    gone = np.cumsum(cuts[:-1]) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    opens[edges] = gone[edges]
    size = np.diff(offsets)
    sums = lambda x: np.diff(np.append(0, np.cumsum(x))[offsets])
    removed = sums(gone)
    out = {c: texts.column(c).combine_chunks() for c in through}
    return _table(out | {"kept": binary_column(data[~gone], size - removed), "n_bytes": size, "n_removed": removed, "n_spans": sums(opens)}, schema)


def remove_earlier(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with `kept`, the bytes of its text that stay, and n_bytes, n_removed, n_spans, in place of columns of those names.

    A byte goes if it lies in a string of `length` bytes that also starts in a
    document with a smaller id; such strings may overlap, and are looked for in the
    texts as they came. n_spans counts the maximal runs of bytes that went. Ids are
    whole numbers; documents without an id come last. Rows of equal id are no
    earlier than each other, so both keep what they share. A null or empty text has
    no bytes, a text of fewer than `length` bytes loses none, a very long one is
    searched whole. `kept` may begin or end inside a character. An empty table gives
    an empty result; further columns pass through (names that begin with two
    underscores are used inside). `length` is 32 to 79. Only the size of all texts
    is summed when this is called.
    """
    if not 32 <= length <= ANCHOR + 63:
        raise ValueError(f"the length must be 32 to {ANCHOR + 63}")
    small_batches(docs.sparkSession)
    through = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_chunks, n_buckets = max(1, -(-size // CHUNK)), max(LEAST_BUCKETS, -(-size // BUCKET))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_chunks)).cast("int")
    placed = docs.select(doc_id, text, *[c for c in through if c not in (doc_id, text)], place.alias("__chunk")).repartition("__chunk")
    counts = StructType([StructField("kept", BinaryType())] + [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")])
    schema = to_arrow_schema(StructType([docs.schema[c] for c in through] + counts.fields))
    sent_as, states_as, bytes_as, rows_as = (from_arrow_schema(x) for x in (_SENT, _STATES, _BYTES, schema))

    sent = placed.groupBy("__chunk").applyInArrow(lambda key, texts: _send(key[0].as_py(), texts, length, n_buckets), sent_as)
    states = sent.groupBy("bucket").applyInArrow(_decide, states_as)
    asked = placed.groupBy("__chunk").cogroup(states.groupBy("chunk")).applyInArrow(lambda key, texts, answers: _send_bytes(key[0].as_py(), texts, answers, length, n_buckets), bytes_as)
    masks = asked.groupBy("bucket").applyInArrow(lambda rows: _compare(rows, length), states_as)
    answers = states.union(masks)
    return placed.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda texts, rows: _cut(texts, rows, length, n_buckets, through, schema), rows_as)


def op12_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with what an earlier one does not hold."""
    found = remove_earlier(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x FROM documents),
p AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) s FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 49)) k FROM h)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, k, k - max(k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM p JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, k, count(*) FILTER (gap IS NULL OR gap > 50) OVER (PARTITION BY doc_id ORDER BY k) n FROM r),
s AS (SELECT doc_id, n, min(k) a, max(k) + 50 z FROM g GROUP BY doc_id, n),
k AS (SELECT doc_id, count(*) n_spans, sum(z - a) n_removed, list(a ORDER BY a) az, list(z ORDER BY a) zs FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) n_spans,
       sha256(from_hex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(CAST(n_spans AS BIGINT) + 1),
           lambda i: substr(x, CASE WHEN i = 0 THEN 1 ELSE 2 * zs[i] + 1 END, CASE WHEN i = n_spans THEN len(x) ELSE 2 * (az[i + 1] - CASE WHEN i = 0 THEN 0 ELSE zs[i] END) END)), '') END)) kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""

"""Near duplicates by an LSH forest of MinHash signatures (operator 3).

Each document is its set of distinct word shingles. Documents with equal sets
form one class, found by a 128-bit hash of the set; all further work is on one
representative of a class, so thousands of copies cost what one document costs.

The forest: `TREES` sorted orders, each of `DEPTH` MinHash values. A global
range sort lays all orders out evenly, hot regions too, as the node is the last
sort key. The next ones in order have the longest common prefixes; those that
share `LEAST` values are candidates. The depth adapts to how crowded a region
is: where it holds more than the next few, a member that stands further off is a
candidate if the prefix in common is longer, by one value for each step of
`FURTHER`. Candidates are confirmed on the full sets, and links give connected
components.

A region (equal prefix of `LEAST` values) with more members than the window may
hold links that the window did not try. So no link is lost there: a region whose
members are all in one component is done; in each other region all members are
tried against its best-linked member. Where several components are left, the
members outside the largest one are compared in full with the others, in blocks
of bounded size, with only the spanning links given out. Nothing is capped or
sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, spanning
from .text import NONSPACE, Words, binary_column, buffers, bytes_of, give_back, hot_keys, map_chunks, materialise, mix, spread_join, table

TREES, DEPTH, LEAST, WINDOW = 16, 8, 4, 3
#: Steps to members of a crowded region beyond the window: step i asks for a prefix of LEAST + 1 + i values.
FURTHER = (4, 16, 64)
#: Rows of the orders that a task sorts, about 25 bytes each; small tables are cut finer, into up to 64 parts.
ORDER_ROWS, SMALL_ROWS = 4_000_000, 65_536
#: Members of a block where a region is compared in full, and their shingles on average.
BLOCK, BLOCK_SHINGLES = 192, 400_000
#: Rows without an id have a number from here on, made of their text.
NO_ID = 1 << 62
#: Ids of candidates that may be broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(20260101))
_XOR = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each text, and the number of each text."""
    words = Words(*buffers(column), NONSPACE, lower=True)
    at, h = words.windows(k)
    doc = words.doc[at]
    for j in range(1, k):  # fewer words: the whole sequence
        short, hs = words.windows(j)
        own = words.counts[words.doc[short]] == j
        doc, h = np.concatenate([doc, words.doc[short[own]]]), np.concatenate([h, hs[own]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        doc, h = doc[new], h[new]
    return h, np.bincount(doc, minlength=words.n_docs)


def _firsts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have shingles, and where theirs begin."""
    full = np.flatnonzero(counts)
    return full, (np.cumsum(counts) - counts)[full]


def _set_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    full, first = _firsts(counts)
    out = np.zeros((2, len(counts)), np.uint64)
    for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        if len(full):
            out[k, full] = mix(np.add.reduceat(mix(h ^ np.uint64(salt)), first) + counts[full].astype(np.uint64))
    return out.view(np.int64)


def _signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of TREES * DEPTH 16-bit MinHash values for each text that has shingles."""
    full, first = _firsts(counts)
    out = np.empty((len(full), TREES * DEPTH), ">u2")
    for j in range(TREES * DEPTH):
        if len(full):
            out[:, j] = mix(np.minimum.reduceat((h ^ _XOR[j]) * _MUL[j], first)) >> np.uint64(48)
    return out


def _is_number(docs: DataFrame, doc_id: str) -> bool:
    return docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _row_number(docs: DataFrame, doc_id: str, text: str) -> Column:
    """The id, or a hash of an id that is no whole number; for rows without an id, a hash of the text from NO_ID on."""
    number = F.col(doc_id).cast("long") if _is_number(docs, doc_id) else F.when(F.col(doc_id).isNotNull(), F.shiftrightunsigned(F.xxhash64(doc_id), 2))
    return F.coalesce(number, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))


def _signed(docs: DataFrame, k: int) -> DataFrame:
    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        h, counts = shingle_sets(chunk.column("__text"), k)
        key = _set_keys(h, counts)
        size = np.where(counts > 0, TREES * DEPTH, 0)
        return {"row": chunk.column("__row"), "id": chunk.column("__id"), "h": chunk.column("__h"), "n": counts, "k1": key[0], "k2": key[1], "sig": binary_column(_signatures(h, counts).reshape(-1), size)}

    kind = docs.schema["__id"].dataType.simpleString()
    return map_chunks(docs, work, f"row long, id {kind}, h long, n long, k1 long, k2 long, sig binary", "__text")


def _orders(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree: its first and its other MinHash values, as two numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = bytes_of(batch.column("sig"))
            keys = np.frombuffer(data, ">i8").reshape(batch.num_rows, TREES, 2)
            tree = np.repeat(np.arange(TREES, dtype=np.int8), batch.num_rows)
            p, q = (keys[:, :, i].T.ravel().astype(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(p), pa.array(q), pa.array(np.tile(batch.column("node").to_numpy(), TREES))], ["tree", "p", "q", "node"])

    return nodes.filter("n > 0").select("node", "sig").mapInArrow(work, "tree byte, p long, q long, node long")


def _shared(rows: np.ndarray) -> np.ndarray:
    """MinHash values that each row (tree, p, q, node) has in common with the one before, from the first on; 0 if fewer than LEAST."""
    out = np.zeros(len(rows), np.int8)
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    differ = (rows[1:, 2] ^ rows[:-1, 2]).view(np.uint64)
    out[1:] = same * (LEAST + sum((differ >> np.uint64(16 * k) == 0).astype(np.int8) for k in range(DEPTH - LEAST)))
    return out


def _later(x: np.ndarray, k: int) -> np.ndarray:
    """x moved on by k places, 0 before."""
    return np.append(np.zeros(min(k, len(x)), x.dtype), x[: max(0, len(x) - k)])


def _neighbours(orders: DataFrame) -> DataFrame:
    """Candidate pairs (a > b) of near neighbours; and, with b null, the members of each region that the window may not cover.

    A region at the border of a partition counts as one that the window may not cover.
    """
    reach, back = WINDOW + 1, max(FURTHER)

    def out(a: np.ndarray, b: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
        node = members[:, 3]
        region = mix(members[:, 1].view(np.uint64) + mix(members[:, 0].view(np.uint64) + np.uint64(1))).view(np.int64)
        columns = ([pa.array(a), pa.array(node)], [pa.array(b), pa.nulls(len(node), pa.int64())], [pa.nulls(len(a), pa.int64()), pa.array(region)])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], ["a", "b", "region"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        first = True
        none = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tree", "p", "q", "node")], axis=1)])
            node, old = rows[:, 3].copy(), len(held)
            a, b = [none], [none]
            least = {1: _shared(rows)}  # values that all rows from k before on have in common
            for k in (2, 3, *(1 << i for i in range(2, back.bit_length()))):
                half = k // 2
                least[k] = np.minimum(least[k - half], _later(least[half], k - half))
            for k, values in [(k, LEAST) for k in range(1, WINDOW + 1)] + [(k, LEAST + 1 + i) for i, k in enumerate(FURTHER)]:
                near = np.flatnonzero(least[k] >= values)
                near = near[(near >= max(old, k)) & (node[near] != node[near - k])]
                a.append(np.maximum(node[near], node[near - k]))
                b.append(np.minimum(node[near], node[near - k]))
            crowded = np.zeros(len(rows), bool)
            far = np.flatnonzero(least[reach] >= LEAST)
            far = far[far >= max(old, reach)]
            for k in range(reach + 1):
                crowded[far - k] = True
            if first:
                crowded[:reach] |= (rows[:reach, :2] == rows[0, :2]).all(axis=1)
                first = False
            yield out(np.concatenate(a), np.concatenate(b), np.ascontiguousarray(rows[crowded]))
            held = rows[-back:]
        if len(held):
            last = held[-reach:]
            yield out(none, none, np.ascontiguousarray(last[(last[:, :2] == last[-1, :2]).all(axis=1)]))

    return orders.mapInArrow(work, "a long, b long, region long")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, set): the shingle sets, sorted hashes as bytes, of the wanted representatives (node, k1, k2)."""
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if few else wanted, docs["__row"] == wanted["node"]).select("node", "k1", "k2", "__text")

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        h, counts = shingle_sets(chunk.column("__text"), k)
        key = _set_keys(h, counts)
        mine = (key[0] == chunk.column("k1").to_numpy()) & (key[1] == chunk.column("k2").to_numpy())
        return {"node": chunk.column("node"), "k1": chunk.column("k1"), "mine": mine, "n": counts, "set": binary_column(h.view(np.int64), counts)}

    return map_chunks(texts, work, "node long, k1 long, mine boolean, n long, set binary", "__text").filter("mine").dropDuplicates(["node", "k1"]).select("node", "n", "set")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    joined = pairs.join(right, "b").join(left, "a").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])
        give_back()

    return joined.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def _open_regions(members: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """(region, node, component, major) of the regions whose members are in several components; major says that the component is the region's largest."""
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = labelled.groupBy("region", "component").agg(F.count("*").alias("c"))
    top = parts.groupBy("region").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    largest = top.select("region", F.col("m.component").alias("largest"))
    return spread_join(labelled, largest, ["region"], hot, F.xxhash64("node")).select("region", "node", "component", (F.col("component") == F.col("largest")).alias("major"))


def _in_full(open_: DataFrame, sets: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """Spanning links of the regions' members: each that is not in a region's largest component is compared with all of other components there, in blocks."""
    blocks_of = lambda count, size: F.greatest(F.lit(1), F.ceil(count / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    minor = ~F.col("major")
    shape = open_.join(sets.select("node", "n"), "node").groupBy("region").agg(
        blocks_of(F.count("*"), F.sum("n")).alias("blocks"), blocks_of(F.count_if(minor), F.sum(F.when(minor, F.col("n")).otherwise(0))).alias("asking")
    )
    # small rows are dealt by region; the sets join by node, and a task has one pair of blocks
    dealt = spread_join(open_, shape, ["region"], hot, F.xxhash64("node")).join(sets, "node").withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "ask": F.pmod(F.xxhash64("node"), F.col("asking")).cast("int")})
    columns = ["region", "node", "component", "n", "set"]
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = dealt.select(*columns, "block", upto("asking").alias("ask"), F.lit(False).alias("asks"))
    asking = dealt.filter(minor).select(*columns, upto("blocks").alias("block"), "ask", F.lit(True).alias("asks"))

    def work(group: pa.Table) -> pa.Table:
        node, component, n = (group.column(c).to_numpy() for c in ("node", "component", "n"))
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
        token = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(n)])
        there = np.repeat(~asks, n)  # an inverted index over the members that are asked
        owner, listed = np.repeat(np.arange(len(sets)), n)[there], token[there]
        order = np.argsort(listed, kind="stable")
        posting = owner[order]
        begin = np.concatenate([[0], np.cumsum(np.bincount(listed, minlength=int(token.max()) + 1))])
        a, b = [node[:0]], [node[:0]]
        for x in np.flatnonzero(asks).tolist():
            t = token[at[x] : at[x + 1]]
            lengths = begin[t + 1] - begin[t]
            to = np.repeat(begin[t] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            common = np.bincount(posting[to], minlength=len(sets))
            y = np.flatnonzero((100 * common >= percent * (n[x] + n - common)) & (component != component[x]) & ~asks)
            a.append(np.full(len(y), node[x]))
            b.append(node[y])
        a, b = spanning(np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64))
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return asked.union(asking).repartition("region", "block", "ask").groupBy("region", "block", "ask").applyInArrow(work, "a long, b long")


def _membership(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(row, id, h, n, component) for every row: its number, its id, the hash of its text, its set's size, the smallest number that it reaches."""
    rows = docs.select(_row_number(docs, doc_id, text).alias("__row"), F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__h"))
    signed = materialise(_signed(rows, shingle))
    classes = signed.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("row", "n", "sig")).alias("m"), F.count("*").alias("copies"))
    nodes = materialise(classes.select("k1", "k2", "copies", F.col("m.row").alias("node"), F.col("m.n").alias("n"), F.col("m.sig").alias("sig")))
    n_orders = nodes.count() * TREES
    n_parts = max(-(-n_orders // ORDER_ROWS), min(64, -(-n_orders // SMALL_ROWS)), 1)
    order = ["tree", "p", "q", "node"]
    found = materialise(_neighbours(_orders(nodes).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)))
    pairs = materialise(found.filter("b is not null").select("a", "b").distinct())
    members = found.filter("b is null").select("region", F.col("a").alias("node")).distinct()
    several = materialise(members.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1"))
    in_regions = several.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(several, ["region"], in_regions)
    members = materialise(members.join(several.select("region"), "region", "left_semi"))
    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct()
    sets = materialise(_sets(rows, materialise(nodes.select("node", "k1", "k2").join(involved, "node", "left_semi")), shingle))

    links = materialise(_confirmed(pairs, sets, percent))
    labels = components(links)
    open_ = materialise(_open_regions(members, labels, hot))
    if not open_.isEmpty():
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        best = open_.join(degree, "node", "left").groupBy("region").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), "node", "component")).alias("h"))
        best = best.select("region", F.col("h.node").alias("b"), F.col("h.component").alias("of"))
        tried = spread_join(open_, best, ["region"], hot, F.xxhash64("node"))
        tried = tried.filter("component <> of").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
        links = materialise(links.union(_confirmed(tried.join(pairs, ["a", "b"], "left_anti"), sets, percent)))
        labels = components(links)
        open_ = materialise(_open_regions(members, labels, hot))
        if not open_.isEmpty():
            labels = components(links.union(_in_full(open_, sets, percent, hot)))

    of_class = nodes.select("k1", "k2", "node").join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    hot_classes = hot_keys(nodes, ["k1", "k2"], signed.count(), "copies")
    full = spread_join(signed.filter("n > 0").select("row", "id", "h", "n", "k1", "k2"), of_class, ["k1", "k2"], hot_classes, F.xxhash64("row"))
    columns = ["row", "id", "h", "n", "component"]
    return full.select(*columns).union(signed.filter("n = 0").withColumn("component", F.col("row")).select(*columns))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Two documents are linked if their sets of distinct `shingle`-word shingles
    have a Jaccard similarity of `percent` / 100 or more; a document with fewer
    words is one shingle. component_id is the smallest id that links reach; kept
    says that the row has this id. A null or empty text, or one without words, is
    linked with nothing; texts of any length count whole. Repeated rows share
    their component; rows of one id with different texts are linked each by its
    own text. Rows without an id are linked by their texts; they are kept, with a
    null component_id, only where no document with an id is reached. Ids may have
    any type that has an order (whole numbers below 2 ** 62). An empty table
    gives an empty result; other columns are not read. The links are found, and
    written to the shared folder, when this is called.
    """
    kind = docs.schema[doc_id].dataType
    found = _membership(docs, shingle, percent, doc_id, text)
    if _is_number(docs, doc_id):
        first = F.when(F.col("component") < NO_ID, F.col("component")).cast(kind)
        found = found.withColumn("first", first)
    else:
        sizes = materialise(found.groupBy("component").agg(F.min("id").alias("first"), F.count("*").alias("size")))
        hot = hot_keys(sizes, ["component"], sizes.agg(F.sum("size")).first()[0] or 0, "size")
        found = spread_join(found, sizes.select("component", "first"), ["component"], hot, F.xxhash64("row", "h"))
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"), F.col("id").eqNullSafe(F.col("first")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group of near duplicates; columns as they were.

    The document with the smallest id stays (for ids that are no whole numbers,
    the one with the smallest hash), of a group without ids one row. Rows that
    repeat the id and the text of the one that stays are that document and stay
    too. Nulls, empty and very long texts, ties and empty tables are taken as
    near_duplicates takes them. Column names that begin with two underscores are
    used inside.
    """
    found = _membership(docs, shingle, percent, doc_id, text)
    gone = materialise(found.filter("row <> component").select("row", "h").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    here = docs.withColumns({"__row": _row_number(docs, doc_id, text), "__h": F.xxhash64(text)})
    # rows without an id and with one text are copies of each other; texts without words are nothing's copies
    unnamed = F.col(doc_id).isNull() & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    once = here.filter(unnamed).dropDuplicates(["__row", "__h"])
    rows = here.filter(~F.coalesce(unnamed, F.lit(False))).unionByName(once)
    return rows.join(gone, (F.col("__row") == gone["row"]) & (F.col("__h") == gone["h"]), "left_anti").select(*docs.columns)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Component of every document, for shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)

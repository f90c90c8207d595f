"""URL filter: a blocked Bloom filter before an exact hash join (operator 1).

A list entry is a canonical URL, host and path; it fits a URL if the host is the
entry's or a subdomain of it and the URL's path starts with the entry's. So a
URL fits an entry exactly if one of its keys, a suffix of its host with a prefix
of its path, is the entry; only the path lengths that the list has are tried.

The filter has blocks of eight 32-bit words (one bit set in each word for an
entry), two words to a number. It is a table with a row for each block that is
not empty, built by one aggregation, and is broadcast as long as it has at most
`MAX_BLOCKS` blocks (some 16 million entries): so each row is tested where it is
read, and one without a key that may be listed has its verdict there, without a
shuffle. Only the other rows, and their keys that may be listed, go on to the exact join with the
list, which removes the false positives; the longest entry wins. A longer list is
joined exactly without a filter, which would have to be shuffled to like the list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from .text import table

#: Filter bits for each entry; 16 give about one false positive in 700 keys.
BITS_PER_ENTRY = 16
#: Blocks that may be broadcast, about 70 bytes each.
MAX_BLOCKS = 1 << 20
#: Odd multipliers that pick the bit in each word of a block (fixed values of the published split-block filter).
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty if there is no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _times(low: Column, s: int) -> Column:
    """low * s modulo 2 ** 32, for a 32-bit `low`, without a product beyond 64 bits."""
    upper = (low * F.lit(s >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(upper, 16) + low * F.lit(s & 0xFFFF)).bitwiseAND(F.lit(0xFFFFFFFF))


def _probe(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block number and the masks of a key in four numbers of two words each."""
    h = F.xxhash64(key)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    bit = lambda s: F.shiftright(_times(low, s), 27).cast("int")
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    masks = [one(bit(a)).bitwiseOR(one(bit(b) + 32)) for a, b in zip(SALTS[::2], SALTS[1::2], strict=True)]
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks)), masks


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter: a row (block, w0 ... w3) for each block that is not empty. `keys` has a column `key`."""
    block, masks = _probe(F.col("key"), n_blocks)
    rows = keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def maybe_listed(keys: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of `keys` whose `key` may be in the filter, which is broadcast."""
    if n_blocks > MAX_BLOCKS:
        raise ValueError(f"the filter has {n_blocks} blocks; {MAX_BLOCKS} may be broadcast")
    block, masks = _probe(F.col("key"), n_blocks)
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit &= F.col(f"w{i}").bitwiseAND(m) == m
    columns = keys.columns
    return keys.withColumn("block", block).join(F.broadcast(blocks), "block").filter(hit).select(*columns)


def rows_by_filter(rows: DataFrame, keys: Column, blocks: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """The rows of which one of `keys`, an array, may be in the filter, and the others; each is told apart where it is read."""
    held = blocks.toArrow()  # a row for each block, MAX_BLOCKS at most
    words = np.zeros((n_blocks, 4), np.int64)
    words[held.column("block").to_numpy()] = np.stack([held.column(f"w{i}").to_numpy() for i in range(4)], axis=1)
    shared = rows.sparkSession.sparkContext.broadcast(words)

    schema = StructType([*rows.schema.fields, StructField("__may", BooleanType())])
    arrow = to_arrow_schema(schema)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("__hashes")
            h = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            low, hit = h.view(np.uint64) & np.uint64(0xFFFFFFFF), np.ones(len(h), bool)
            block = (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) % len(shared.value)
            for i, (a, b) in enumerate(zip(SALTS[::2], SALTS[1::2], strict=True)):
                one, two = ((low * np.uint64(s) & np.uint64(0xFFFFFFFF)) >> np.uint64(27) for s in (a, b))
                mask = (np.uint64(1) << one | np.uint64(1) << (two + np.uint64(32))).view(np.int64)
                hit &= shared.value[block, i] & mask == mask
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(hashes).fill_null(0).to_numpy(zero_copy_only=False))
            may = np.bincount(row[hit], minlength=batch.num_rows) > 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(may)], schema=arrow)

    marked = rows.withColumn("__hashes", F.transform(keys, lambda k: F.xxhash64(k))).mapInArrow(probe, schema)
    return marked.filter("__may").drop("__may"), marked.filter("not __may").drop("__may")


def url_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All host suffixes (at label borders) with all path prefixes of the given lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.lit(sorted(set(lengths))), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def filter_urls(pages: DataFrame, listed: DataFrame, otherwise: str = "allow", url: str = "url") -> DataFrame:
    """Every row of `pages` with host, path, rule and verdict in place of columns of those names.

    `listed` has host, path and verdict; a repeated entry counts once (of several
    verdicts the smallest). A null URL, or one without `://`, has an empty host
    and path and fits only entries with an empty host; what fits no entry has a null rule and the
    verdict `otherwise`. URLs of any length are judged whole; of two entries that
    fit the longer one wins, and two of one length cannot both fit. Repeated rows
    are judged each, a URL that is common only once; empty tables give an empty
    result or the verdict `otherwise`; further columns pass through. The list is
    counted, and its filter built, when this is called.
    """
    pages = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    listed = listed.groupBy(F.concat("host", "path").alias("key")).agg(F.min("verdict").alias("verdict"), F.collect_set(F.length("path")).alias("n"))
    lengths = [r[0] for r in listed.select(F.explode("n")).distinct().collect()]  # distinct path lengths, a few hundred at most
    n_blocks = max(1, -(-listed.count() * BITS_PER_ENTRY // 256))
    parsed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not lengths:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    filtered, of_url = n_blocks <= MAX_BLOCKS, url_keys(F.col("host"), F.col("path"), lengths)
    if filtered:
        blocks = bloom_blocks(listed, n_blocks)
        parsed, others = rows_by_filter(parsed, of_url, blocks, n_blocks)
    keys = parsed.select("host", "path").distinct().select("host", "path", F.explode(of_url).alias("key"))
    candidates = maybe_listed(keys, blocks, n_blocks) if filtered else keys
    exact = candidates.join(listed.select("key", F.col("verdict").alias("__verdict")), "key")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct("key", "__verdict"), F.struct(F.length("key"), "key")).alias("__best"))
    found = parsed.join(best, ["host", "path"], "left").select(
        *pages.columns, "host", "path", F.col("__best.key").alias("rule"), F.coalesce("__best.__verdict", F.lit(otherwise)).alias("verdict")
    )
    return found.unionByName(others.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})) if filtered else found


#: The list of the query: host, path, verdict (fixed values).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path, row_number() OVER () n FROM pages),
r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
b AS (SELECT p.n, max_by(h || q, length(h || q)) rule, max_by(v, length(h || q)) verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY p.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') verdict FROM p LEFT JOIN b USING (n)
"""

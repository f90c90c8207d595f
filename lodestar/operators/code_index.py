"""Ranked code search for many queries at once: an inverted index with field weights.

`taxonomy.ranked` scans all nodes for one query. Here each node is cut once into
postings: its words, and the beginnings of five letters or more of the longer ones,
each with the best points that a field gives it. The postings are a table that can be
written and kept. A batch of queries is joined to it by term; points are summed for
each pair of a query and a node that share a term, and only those; each task keeps
the best of its part before they are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.storage import materialise
from .dictionary import all_values, find_phrases
from .taxonomy import FIELD_WEIGHTS, OTHER_WEIGHTS, STOP_WORDS

#: Letters from which on the beginning of a word counts.
LEAST_BEGINNING = 5


def postings(nodes: DataFrame) -> DataFrame:
    """(term, code, points, other_points): what a term gives a node as a word of a query, and as a further word.

    `nodes` has code and the normalised fields of `taxonomy.ranked`.
    """
    fields = F.array(*[F.struct(F.col(f).alias("field"), F.lit(FIELD_WEIGHTS[f]).alias("w"), F.lit(OTHER_WEIGHTS[f]).alias("o")) for f in FIELD_WEIGHTS if f in nodes.columns])
    of_field = nodes.select("code", F.explode(fields).alias("f")).select("code", "f.w", "f.o", F.explode(F.array_distinct(F.split(F.trim("f.field"), " "))).alias("word")).filter(F.length("word") >= 2)
    whole = F.array(F.struct(F.col("word").alias("term"), F.lit(2).alias("hit")))
    longer = F.length("word") > LEAST_BEGINNING
    begun = F.transform(F.sequence(F.lit(LEAST_BEGINNING), F.greatest(F.length("word") - 1, F.lit(LEAST_BEGINNING))), lambda n: F.struct(F.substring("word", F.lit(1), n).alias("term"), F.lit(1).alias("hit")))
    terms = of_field.select("code", "w", "o", F.explode(F.when(longer, F.concat(whole, begun)).otherwise(whole)).alias("t"))
    return terms.groupBy(F.col("t.term").alias("term"), "code").agg(F.max(F.col("t.hit") * F.col("w")).alias("points"), F.max(F.col("t.hit") * F.col("o")).alias("other_points"))


def search_many(index: DataFrame, nodes: DataFrame, queries: DataFrame, query_id: str = "query_id", text: str = "text", limit: int = 20) -> DataFrame:
    """(query_id, code, score) of every query: the codes that `taxonomy.ranked` gives for it.

    `queries` may have `further`, an array of further words (`taxonomy.expand_all`),
    and `preferred` and `boosted`, arrays of codes and headings. Query ids are
    distinct; a query without words that count has no rows. `index` is `postings`
    of `nodes`, whose codes are distinct. The distinct queries are written when this is called.
    """
    column = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in queries.columns else F.array().cast("array<string>")
    base = F.filter(words(F.col(text), 2), lambda w: ~w.isin(STOP_WORDS))
    asked = queries.select(F.col(query_id).alias("id"), base.alias("base"), column("further").alias("further"), column("preferred").alias("preferred"), column("boosted").alias("boosted")).filter(F.size("base") > 0)
    # queries that ask for the same are searched once
    same = ["base", "further", "preferred", "boosted"]
    q = materialise(asked.groupBy(*same).agg(F.min("id").alias("query_id")))
    own = q.select("query_id", F.explode("base").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("other", F.lit(False))
    more = q.select("query_id", F.explode(F.array_distinct("further")).alias("term"), F.lit(1).cast("long").alias("times"), F.lit(True).alias("other"))
    hits = own.unionByName(more).join(index, "term").select(
        "query_id", "code", F.when(~F.col("other"), F.col("points") * F.col("times")).alias("points"), F.when(~F.col("other"), F.col("times")).alias("matched"), F.when(F.col("other"), F.col("other_points")).alias("extra"))
    liked = q.select("query_id", F.explode(F.array_distinct("preferred")).alias("code"), *[F.lit(None).cast(k).alias(c) for c, k in (("points", "double"), ("matched", "long"), ("extra", "double"))])
    pairs = hits.unionByName(liked).groupBy("query_id", "code").agg(*[F.coalesce(f(c), F.lit(0)).alias(c) for f, c in ((F.sum, "points"), (F.sum, "matched"), (F.max, "extra"))])
    phrase = F.array_join("base", " ")
    whole = q.select("query_id", F.size("base").alias("n_base"), phrase.alias("phrase"), "preferred", "boosted")
    scored = pairs.join(nodes.select("code", "level", "own", "head"), "code").join(whole, "query_id")
    starts = (F.length("phrase") > 3) & (F.startswith("own", F.concat(F.lit(" "), "phrase")) | F.startswith("head", F.concat(F.lit(" "), "phrase")))
    bonus = F.when(F.col("matched") == F.col("n_base"), 10.0).otherwise(0.0) + F.when(starts, 12.0).otherwise(0.0) + F.when(F.array_contains("preferred", F.col("code")), 40.0).otherwise(0.0)
    bonus += F.when(F.array_contains("boosted", F.substring("code", 1, 4)), 20.0).otherwise(0.0) - F.when(F.col("level") == 8, 2.0).otherwise(0.0)
    order = W.partitionBy("query_id").orderBy(F.desc("raw"), "code")
    ranked = scored.select("query_id", "code", (F.col("points") + F.col("extra") + bonus).alias("raw")).withColumn("k", F.row_number().over(order))
    best = ranked.filter(F.col("k") <= limit).select("query_id", "code", F.floor(F.col("raw") + 0.5).alias("score"))
    return asked.join(q, same).select("id", "query_id").join(best, "query_id").select(F.col("id").alias("query_id"), "code", "score")


def categories(queries: DataFrame, keywords: DataFrame, index: DataFrame, nodes: DataFrame, default: str, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, category, by): that of the first of `keywords` (place, keyword, category) that stands in a query, else the heading of the code that ranks first for it, else `default`.

    `by` says which: keyword, search or default. Keywords are a relation of any size,
    places are whole numbers from 0; query ids are distinct. A query without words has the default.
    """
    told = keywords.select(F.col("keyword").alias("phrase"), F.concat(F.lpad(F.col("place").cast("string"), 19, "0"), F.lit(":"), "category").alias("value"))
    rows = find_phrases(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text")), told)
    first = F.array_min(all_values(F.col("matches")))
    named = rows.select("query_id", "text", F.substring(first, 21, 1 << 30).alias("named"))
    best = search_many(index, nodes, named.filter("named is null"), limit=1).select("query_id", F.substring("code", 1, 4).alias("found"))
    by = F.when(F.col("named").isNotNull(), "keyword").when(F.col("found").isNotNull(), "search").otherwise("default")
    return named.join(best, "query_id", "left").select("query_id", F.coalesce("named", "found", F.lit(default)).alias("category"), by.alias("by"))

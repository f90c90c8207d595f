"""The product taxonomy: tree, labels, ranked search, aliases, classifiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm, words
from .dictionary import all_values, find_phrases

#: Words that say nothing in a search (fixed values).
STOP_WORDS = ["and", "for", "from", "of", "the", "with"]
#: Points of a whole word or of a prefix in each field (fixed values).
FIELD_WEIGHTS = {"own": 6.0, "context": 4.0, "head": 2.5, "en": 3.0, "enctx": 1.5}
OTHER_WEIGHTS = {"own": 4.0, "context": 3.0, "head": 2.0, "en": 2.5, "enctx": 1.2}


def tree(leaves: DataFrame) -> DataFrame:
    """(code, level, parent, n): all nodes over six-digit codes, with the number of rows below."""
    levels = F.explode(F.array(*[F.struct(F.substring("code6", 1, n).alias("code"), F.lit(n).alias("level"), (F.substring("code6", 1, n - 2) if n > 2 else F.lit(None).cast("string")).alias("parent")) for n in (2, 4, 6)]))
    return leaves.select(levels.alias("x")).groupBy("x.code", "x.level", "x.parent").agg(F.count("*").alias("n"))


def build(book: DataFrame, deepest: int = 8) -> DataFrame:
    """(code, level, parent, label, label_en, path, path_en, heading) from the lines of a tariff book, one row for each code.

    `book` has chapter, place, code (null or without digits for a group line),
    label and label_en, whose leading dashes say how deep a line is. A group line
    or a subheading is the context of the deeper lines after it, until a line of
    its own depth or less, or the next heading. That context needs no fold: for
    each depth, the last line of this depth counts if it is also the last one of
    this depth or less. So it is windows over a chapter, a few hundred lines.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\-–]+", ""), r"\s*:\s*$", ""), r"\s+", " "))
    digits = F.regexp_replace(F.coalesce("code", F.lit("")), "[^0-9]", "")
    depth = F.length(F.regexp_replace(F.regexp_extract(F.coalesce("label", F.lit("")), r"^((?:-\s*)+)", 1), "[^-]", ""))
    lines = book.select("chapter", "place", digits.alias("digits"), depth.alias("depth"), clean(F.col("label")).alias("label"), clean(F.col("label_en")).alias("label_en"))
    h4, is_group = F.substring("digits", 1, 4), F.col("digits") == ""
    is_heading = (F.length("digits") == 4) | F.col("digits").rlike("^[0-9]{4}0000$")
    upto = W.partitionBy("chapter").orderBy("place")
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumns({"h4": F.when(~is_group, h4), "is_heading": is_heading & ~is_group})
    # a line under a heading that has no line of its own opens it
    opens = ~is_group & (F.col("is_heading") | ~F.col("h4").eqNullSafe(F.last("h4", ignorenulls=True).over(before)))
    lines = lines.withColumn("opens", opens)
    lines = lines.withColumn("section", F.coalesce(F.last(F.when(F.col("opens"), F.col("place")), ignorenulls=True).over(upto), F.lit(-1)))
    lines = lines.withColumn("kept", (is_group | (F.length("digits") == 6)) & ~F.col("is_heading"))
    inside = W.partitionBy("chapter", "section").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    counts = ~F.col("is_heading")
    contexts = []
    for d in range(deepest + 1):
        same = F.last(F.when(F.col("kept") & (F.col("depth") == d), F.struct("place", "label", "label_en")), ignorenulls=True).over(inside)
        less = F.last(F.when(counts & (F.col("depth") <= d), F.col("place")), ignorenulls=True).over(inside)
        contexts.append(F.when((F.col("depth") > d) & (same["place"] == less), same))
    lines = lines.withColumn("context", F.array_compact(F.array(*contexts))).filter(~is_group)
    heading = W.partitionBy("chapter", "section").orderBy("place")
    lines = lines.withColumns({"h_label": F.first("label").over(heading), "h_label_en": F.first("label_en").over(heading)})
    joined = lambda items, f: F.array_join(F.transform(items, lambda x: x[f]), " › ")
    none = F.lit(None).cast("string")

    def node(code, level, parent, label, label_en, path, path_en, head):
        fields = zip(("code", "level", "parent", "label", "label_en", "path", "path_en", "heading"), (code, F.lit(level), parent, label, label_en, path, path_en, head), strict=True)
        return F.struct(*[v.alias(n) for n, v in fields])

    own, own_en, ctx = F.col("label"), F.col("label_en"), F.col("context")
    top, six, whole = F.col("h4"), F.substring("digits", 1, 6), F.length("digits") == 8
    last = F.element_at(ctx, -1)
    rest = F.slice(ctx, F.lit(1), F.greatest(F.size(ctx) - 1, F.lit(0)))
    chapter = F.substring("digits", 1, 2)
    path, path_en = joined(ctx, "label"), joined(ctx, "label_en")
    filled = lambda a, b: F.when(F.size(ctx) > 0, a).otherwise(b)
    nodes = F.array(
        F.when(F.col("opens"), node(top, 4, chapter, own, own_en, none, none, none)),
        F.when(F.col("is_heading") & whole, node(F.concat(top, F.lit("00")), 6, top, own, own_en, none, none, top)),
        F.when(F.col("is_heading") & whole, node(F.col("digits"), 8, F.concat(top, F.lit("00")), own, own_en, none, none, top)),
        F.when(~F.col("is_heading") & (F.length("digits") == 6), node(six, 6, top, own, own_en, path, path_en, top)),
        # a national line whose subheading has no line: the line itself, the heading, or the group that it stands in
        F.when(~F.col("is_heading") & whole, F.when(F.col("digits").endswith("00"), node(six, 6, top, own, own_en, path, path_en, top))
               .when(six.endswith("00"), node(six, 6, top, F.col("h_label"), F.col("h_label_en"), none, none, top))
               .otherwise(node(six, 6, top, filled(last["label"], own), filled(last["label_en"], own_en), joined(rest, "label"), joined(rest, "label_en"), top))),
        F.when(~F.col("is_heading") & whole, node(F.col("digits"), 8, six, own, own_en, path, path_en, top)),
    )
    found = lines.select("place", F.posexplode(F.array_compact(nodes)).alias("k", "node"))
    return found.groupBy("node.code").agg(F.min_by("node", F.struct("place", "k")).alias("n")).select("n.*")


def hit(field: Column, word: str) -> Column:
    """2 for a whole word of a normalised field, 1 for the start of one if the word has five letters, else 0."""
    start = F.when(F.contains(field, F.lit(f" {word}")), 1).otherwise(0) if len(word) >= 5 else F.lit(0)
    return F.when(F.contains(field, F.lit(f" {word} ")), 2).otherwise(start)


def search_words(text: str) -> list[str]:
    """The words of a query that count."""
    import re
    import unicodedata

    folded = unicodedata.normalize("NFD", text.lower())
    return [w for w in re.sub(r"[^a-z0-9]+", " ", "".join(c for c in folded if not unicodedata.combining(c))).split() if len(w) >= 2 and w not in STOP_WORDS]


def expand(text: str, synonyms: Mapping[str, Sequence[str]]) -> list[str]:
    """Further words for a query: those of the phrases whose key it contains."""
    padded, own = f" {' '.join(search_words(text))} ", set(search_words(text))
    found = [w for key, phrases in synonyms.items() if f" {' '.join(search_words(key))} " in padded for p in phrases for w in search_words(p)]
    return list(dict.fromkeys(w for w in found if w not in own))


def synonyms_for(text: str, relation: DataFrame) -> dict[str, list[str]]:
    """The synonyms that a query needs from a relation (phrase, synonym): Spark finds the phrases that the query contains, and only those are fetched."""
    padded = f" {' '.join(search_words(text))} "
    found = relation.filter(F.contains(F.lit(padded), norm(F.col("phrase")))).select("phrase", "synonym").distinct().orderBy("phrase", "synonym").collect()
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r["phrase"], []).append(r["synonym"])
    return out


def searchable(text: Column) -> Column:
    """The words of a text that count in a search, single-spaced."""
    return F.array_join(F.filter(words(text, 2), lambda w: ~w.isin(STOP_WORDS)), " ")


def expand_all(queries: DataFrame, relation: DataFrame, text: str = "text") -> DataFrame:
    """Every row of `queries` with `further`, the sorted words of the synonyms of all phrases that its text has, without the text's own.

    `relation` is (phrase, synonym), of any size; phrases and texts are compared
    without stop words, as `expand` does for one query.
    """
    found = find_phrases(queries, relation.select("phrase", searchable(F.col("synonym")).alias("value")), text, normal=searchable)
    said = F.flatten(F.transform(all_values(F.col("matches")), lambda v: F.split(v, " ")))
    further = F.array_sort(F.array_except(F.filter(said, lambda w: w != ""), F.split(searchable(F.col(text)), " ")))
    return found.withColumn("further", further).drop("matches")


def ranked(nodes: DataFrame, text: str, synonyms: Mapping[str, Sequence[str]] | None = None, preferred: Sequence[str] = (), boosted: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """Codes by how well they fit a query, best first.

    `nodes` has code, level and the normalised fields own, context, head, and, if
    there is a second language, en and enctx. Each
    word scores its best field, further words only the best of all of them. No
    join with the words: a query has a few, so each is an expression.
    """
    base, other = search_words(text), expand(text, synonyms or {})
    if not base:
        return nodes.limit(0).select("code", F.lit(0).cast("long").alias("score"))
    fields = [f for f in FIELD_WEIGHTS if f in nodes.columns]
    per_word = [F.greatest(*[hit(F.col(f), w) * FIELD_WEIGHTS[f] for f in fields]) for w in base]
    matched = reduce(lambda a, b: a + b, [F.when(s > 0, 1).otherwise(0) for s in per_word])
    extra = F.greatest(*[hit(F.col(f), w) * OTHER_WEIGHTS[f] for w in other for f in fields], F.lit(0.0)) if other else F.lit(0.0)
    phrase = " ".join(base)
    liked, near = F.col("code").isin(list(preferred)), F.substring("code", 1, 4).isin(list(boosted))
    starts = F.col("own").startswith(f" {phrase}") | F.col("head").startswith(f" {phrase}")
    score = reduce(lambda a, b: a + b, per_word) + extra + F.when(matched == len(base), 10.0).otherwise(0.0) + F.when(starts, 12.0 if len(phrase) > 3 else 0.0).otherwise(0.0) + F.when(liked, 40.0).otherwise(0.0) + F.when(near, 20.0).otherwise(0.0) - F.when(F.col("level") == 8, 2.0).otherwise(0.0)
    found = nodes.withColumns({"raw": score, "matched": matched, "extra": extra}).filter((F.col("matched") > 0) | (F.col("extra") > 0) | liked)
    return found.orderBy(F.desc("raw"), "code").limit(limit).select("code", F.floor(F.col("raw") + 0.5).alias("score"))


def close_matches(found: DataFrame, share: float = 0.55, most: int = 3) -> DataFrame:
    """The next best codes with at least a share of the best score; `found` is a top list."""
    best = W.orderBy(F.desc("score"), "code")
    return found.withColumns({"k": F.row_number().over(best), "top": F.max("score").over(W.partitionBy())}).filter((F.col("k") > 1) & (F.col("score") >= share * F.col("top"))).filter(F.col("k") <= most + 1).select("code", "score")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def longest_alias(texts: DataFrame, aliases: Mapping[str, str], text: str = "text") -> DataFrame:
    """With `codes`: those of the longest aliases that a text contains, all of equal length; sorted."""
    found = lambda n: F.array_compact(F.array(*[F.when(F.contains(n, F.lit(f" {a} ")), F.struct(F.lit(len(a)).alias("l"), F.lit(c).alias("c"))) for a, c in aliases.items()]))
    hits = _once(norm(F.col(text)), found)
    top = F.array_max(F.transform(hits, lambda h: h["l"]))
    return texts.withColumn("codes", F.array_sort(F.array_distinct(F.transform(F.filter(hits, lambda h: h["l"] == top), lambda h: h["c"]))))


def dictionary_codes(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """Codes of all dictionary words that a text has, in singular or plural, in the order of the dictionary."""
    named = lambda n, w: F.contains(n, F.lit(f" {w} ")) | F.contains(n, F.lit(f" {w}s "))
    found = lambda n: F.flatten(F.array(*[F.when(named(n, w), F.array(*map(F.lit, codes))).otherwise(F.array().cast("array<string>")) for w, codes in dictionary.items()]))
    return F.array_distinct(_once(norm(text), found))


def classify(activities: Column, named: Column, narrow: Mapping[str, Sequence[str]], gated: Mapping[str, Sequence[str]]) -> Column:
    """Codes of the first activity class that gives any.

    A narrow class gives its codes that are named, or all of them; a gated class
    only those that are named. Order is that of the named codes.
    """
    out = F.array().cast("array<string>")
    tried = F.transform(activities, lambda a: _class_codes(a, named, narrow, gated))
    return F.coalesce(F.get(F.filter(tried, lambda c: F.size(c) > 0), F.lit(0)), out)


def _class_codes(activity: Column, named: Column, narrow: Mapping[str, Sequence[str]], gated: Mapping[str, Sequence[str]]) -> Column:
    out = F.array().cast("array<string>")
    for name, codes in gated.items():
        out = F.when(activity == name, F.array_intersect(named, F.array(*map(F.lit, codes)))).otherwise(out)
    for name, codes in narrow.items():
        both = F.array_intersect(named, F.array(*map(F.lit, codes)))
        out = F.when(activity == name, F.when(F.size(both) > 0, both).otherwise(F.array(*map(F.lit, codes)))).otherwise(out)
    return out


def label_path(head: Column, context: Column, own: Column) -> Column:
    """`heading › context › own` without empty, generic and repeated parts."""
    parts = F.filter(F.array(head, context, own), lambda p: F.coalesce((F.length(p) > 0) & ~F.lower(p).isin("other", "others"), F.lit(False)))
    return F.array_join(F.filter(parts, lambda p, i: (i == 0) | (p != F.get(parts, i - 1))), " › ")


__all__ = ["classify", "close_matches", "dictionary_codes", "expand", "hit", "label_path", "longest_alias", "ranked", "search_words", "tree", "words"]

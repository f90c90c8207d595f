"""Matching at size: dictionaries in texts, similar names, many searches at once, trees of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_title
from ..operators import code_index as i_
from ..operators import dictionary as d
from ..operators import similar as m_
from ..operators import taxonomy as x
from ..operators import tree as t_
from .q_text import _LABEL_SQL, _NODES_SQL, _nodes, _norm
from .registry import query
from .views import Views, sql

_ORDER_TEXT_SQL = """SELECT l_orderkey order_id, string_agg(t, '; ' ORDER BY t) t FROM (
    SELECT l_orderkey, p_name || ' ' || (p_partkey + l_linenumber % 3) || ', ' || p_type || 's ' || l_suppkey t FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1"""
_ALIAS_SQL = """SELECT p, min(code6) v FROM (SELECT code6, unnest([description, description || ' ' || part_id, p_type || ' ' || part_id]) p FROM v_taxonomy JOIN part ON part_id = p_partkey) GROUP BY 1"""


def _order_texts(v: Views) -> DataFrame:
    """(order_id, t): what an order's lines say."""
    lines = v.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").join(v.table("part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    said = F.concat("p_name", F.lit(" "), F.col("p_partkey") + F.col("l_linenumber") % 3, F.lit(", "), "p_type", F.lit("s "), "l_suppkey")
    return lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("t"))


def _aliases(v: Views) -> DataFrame:
    """(phrase, value): names, and names and kinds with numbers, of all parts, with the first code of each."""
    parts = v.taxonomy.join(v.table("part").select(F.col("p_partkey").alias("part_id"), "p_type"), "part_id")
    return parts.select(F.explode(F.array("description", F.concat("description", F.lit(" "), "part_id"), F.concat("p_type", F.lit(" "), "part_id"))).alias("phrase"), "code6").groupBy("phrase").agg(F.min("code6").alias("value"))


def _scan_sql(text: str, alias: str) -> str:
    """Every distinct pair of a text and a phrase that it has."""
    return f"SELECT id, a.p, list(DISTINCT a.v) vs FROM (SELECT id, {_norm('t')} n FROM ({text})) x JOIN (SELECT {_norm('p')} p, v FROM ({alias})) a ON a.p <> '  ' AND contains(x.n, a.p) GROUP BY ALL"


@query("dictionary_scan", sql("""SELECT id order_id, count(*) n, array_to_string(list_sort(list_distinct(flatten(list(vs) FILTER (WHERE length(p) = top)))), ',') codes, CAST(len(list_distinct(flatten(list(vs)))) AS INTEGER) n_codes
    FROM (SELECT *, max(length(p)) OVER (PARTITION BY id) top FROM hits) GROUP BY 1""", alias=_ALIAS_SQL, hits=_scan_sql(f"SELECT order_id id, t FROM ({_ORDER_TEXT_SQL})", "SELECT * FROM alias")))
def dictionary_scan(v: Views) -> DataFrame:
    """All aliases of the catalogue in the texts of all orders: how many, and the codes of the longest."""
    found = d.find_phrases(_order_texts(v), _aliases(v), "t").filter(F.size("matches") > 0)
    m = F.col("matches")
    return found.select("order_id", F.size(m).cast("long").alias("n"), F.array_join(d.longest(m), ",").alias("codes"), F.size(d.all_values(m)).alias("n_codes"))


@query("product_words", sql("""SELECT id order_id, array_to_string(list_sort(list_distinct(flatten(list(vs)))), ',') headings FROM hits GROUP BY 1""",
    alias="SELECT DISTINCT unnest([w, w || 's']) p, chapter v FROM (SELECT lower(p_type) w, chapter FROM v_taxonomy JOIN part ON part_id = p_partkey)",
    hits=_scan_sql(f"SELECT order_id id, t FROM ({_ORDER_TEXT_SQL})", "SELECT * FROM alias")))
def product_words(v: Views) -> DataFrame:
    """Chapters of the product words, in singular or plural, in the texts of all orders."""
    words = v.taxonomy.join(v.table("part").select(F.col("p_partkey").alias("part_id"), "p_type"), "part_id").select(F.col("p_type").alias("phrase"), F.col("chapter").alias("value"))
    found = d.find_phrases(_order_texts(v), words, "t", plural=True).filter(F.size("matches") > 0)
    return found.select("order_id", F.array_join(d.all_values(F.col("matches")), ",").alias("headings"))


_STOPS = ", ".join(f"'{w}'" for w in x.STOP_WORDS)


def _searchable(c: str) -> str:
    return f"list_filter(string_split(trim({_norm(c)}), ' '), lambda w: length(w) >= 2 AND w NOT IN ({_STOPS}))"


@query("synonym_expand", sql("""SELECT id part_id, array_to_string(list_sort(list_distinct(list(w))), ' ') further
    FROM (SELECT q.id, q.own, unnest(r.s) w FROM q JOIN r ON contains(' ' || array_to_string(q.own, ' ') || ' ', ' ' || r.p || ' ')) WHERE NOT list_contains(own, w) GROUP BY 1""",
    q=f"SELECT p_partkey id, {_searchable("p_name || ' for the ' || p_type || ' of ' || p_size")} own FROM part",
    r=f"SELECT DISTINCT array_to_string({_searchable('p')}, ' ') p, {_searchable('s')} s FROM (SELECT p_name p, 'the ' || p_brand || ' and ' || p_type s FROM part UNION ALL SELECT p_type || ' of ' || p_size, 'from ' || p_brand FROM part)"))
def synonym_expand(v: Views) -> DataFrame:
    """Further words for a query of each part, from a relation of synonyms made of all parts."""
    p, lit = v.table("part"), F.lit
    relation = p.select(F.explode(F.array(
        F.struct(F.col("p_name").alias("phrase"), F.concat(lit("the "), "p_brand", lit(" and "), "p_type").alias("synonym")),
        F.struct(F.concat("p_type", lit(" of "), "p_size").alias("phrase"), F.concat(lit("from "), "p_brand").alias("synonym")),
    )).alias("r")).select("r.*")
    queries = p.select(F.col("p_partkey").alias("part_id"), F.concat("p_name", lit(" for the "), "p_type", lit(" of "), "p_size").alias("text"))
    return x.expand_all(queries, relation).filter(F.size("further") > 0).select("part_id", F.array_join("further", " ").alias("further"))


_TITLE_SQL = f"SELECT name, n, list_distinct([substr(name, CAST(i AS INTEGER), 3) for i in range(1, length(name) - 1)]) g FROM (SELECT {_norm("title")} AS name, count(*) n FROM (SELECT trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) title FROM pages UNION ALL SELECT p_name || ' ' || p_type FROM part) GROUP BY 1) WHERE length(name) > 2"


@query("similar_names", sql("""SELECT a, b, n_a, n_b, CAST(common AS INTEGER) common, CAST(in_all AS INTEGER) in_all FROM (
    SELECT trim(x.name) a, trim(y.name) b, x.n n_a, y.n n_b, len(list_intersect(x.g, y.g)) common, len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)) in_all FROM t x JOIN t y ON x.name < y.name) WHERE 2 * common >= in_all""", t=_TITLE_SQL))
def similar_names(v: Views) -> DataFrame:
    """All pairs of names, page titles and parts, that share half of their trigrams."""
    titles = v.table("pages").select(html_title(F.col("html")).alias("title"))
    return m_.similar_names(titles.unionAll(v.table("part").select(F.concat("p_name", F.lit(" "), "p_type"))), "title")


def _many_sql(limit: int) -> str:
    """The points of every query and node, word by word."""
    hit = lambda f: f"(CASE WHEN contains({f}, ' ' || w || ' ') THEN 2 WHEN length(w) >= 5 AND contains({f}, ' ' || w) THEN 1 ELSE 0 END)"
    best = f"greatest({', '.join(f'{k} * {hit(f)}' for f, k in x.FIELD_WEIGHTS.items())})"
    return f"""SELECT query_id, code, CAST(floor(raw + 0.5) AS BIGINT) score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, code) k FROM (
        SELECT query_id, code, sum(s) + CASE WHEN count(*) FILTER (WHERE s > 0) = any_value(len(ws)) THEN 10 ELSE 0 END + CASE WHEN any_value(starts_with(own, ' ' || array_to_string(ws, ' ')) OR starts_with(head, ' ' || array_to_string(ws, ' '))) THEN 12 ELSE 0 END raw
        FROM (SELECT query_id, code, ws, own, head, {best} s FROM (SELECT query_id, ws, unnest(ws) w FROM q) JOIN nodes ON true) GROUP BY query_id, code HAVING count(*) FILTER (WHERE s > 0) > 0)) WHERE k <= {limit}"""


@query("code_search_all", sql(_many_sql(5), q=f"SELECT p_partkey query_id, {_searchable("p_name || ' of the ' || p_type || ' goods'")} ws FROM part", l=_LABEL_SQL, nodes=_NODES_SQL))
def code_search_all(v: Views) -> DataFrame:
    """The five best codes for the description of every part, all in one job over an inverted index."""
    nodes = _nodes(v)
    queries = v.table("part").select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" goods")).alias("text"))
    return i_.search_many(i_.postings(nodes), nodes, queries, limit=5)


_KEYWORD_SQL = "SELECT w, min(part_id) place, 'k' || min(chapter) category FROM (SELECT part_id, chapter, split_part(description, ' ', 2) w FROM v_taxonomy) WHERE length(w) <= 4 GROUP BY 1"
_ASKED_SQL = "SELECT p_partkey query_id, CASE WHEN p_partkey % 10 = 0 THEN '?!' ELSE p_name || ' for ' || p_brand END t FROM part"


@query("category_search", sql(f"""SELECT a.query_id, coalesce(any_value(n.category), any_value(f.heading), '0901') category, CASE WHEN any_value(n.category) IS NOT NULL THEN 'keyword' WHEN any_value(f.heading) IS NOT NULL THEN 'search' ELSE 'default' END AS "by" FROM asked a
    LEFT JOIN (SELECT query_id, arg_min(category, place) category FROM asked JOIN k ON contains({_norm("t")}, ' ' || w || ' ') GROUP BY 1) n USING (query_id) LEFT JOIN (SELECT query_id, left(code, 4) heading FROM ({_many_sql(1)})) f USING (query_id) GROUP BY a.query_id""",
    k=_KEYWORD_SQL, asked=_ASKED_SQL, q=f"SELECT query_id, {_searchable('t')} ws FROM asked", l=_LABEL_SQL, nodes=_NODES_SQL))
def category_search(v: Views) -> DataFrame:
    """A category for a query of each part: by keyword, else by text search over the taxonomy, else the default."""
    word = F.split_part("description", F.lit(" "), F.lit(2))
    keywords = v.taxonomy.select(word.alias("keyword"), "part_id", "chapter").filter(F.length("keyword") <= 4).groupBy("keyword").agg(F.min("part_id").alias("place"), F.concat(F.lit("k"), F.min("chapter")).alias("category"))
    asked = v.table("part").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 10 == 0, "?!").otherwise(F.concat("p_name", F.lit(" for "), "p_brand")).alias("text"))
    nodes = _nodes(v)
    return i_.categories(asked, keywords, i_.postings(nodes), nodes, "0901")


#: Every part but the first few hangs below an earlier one: a tree of depth thirty and more.
_PART_TREE_SQL = "SELECT p_partkey node, nullif(p_partkey * 39 // 50, p_partkey) parent, p_name AS label, p_size FROM part"


def _part_tree(v: Views) -> DataFrame:
    parent = F.floor(F.col("p_partkey") * 39 / 50).cast("long")
    return v.table("part").select(F.col("p_partkey").alias("node"), F.when(parent != F.col("p_partkey"), parent).alias("parent"), F.col("p_name").alias("label"), "p_size")


@query("tree_ancestors", f"WITH RECURSIVE t AS ({_PART_TREE_SQL}), a AS (SELECT node, parent ancestor, CAST(1 AS BIGINT) distance FROM t WHERE parent IS NOT NULL UNION ALL SELECT a.node, t.parent, a.distance + 1 FROM a JOIN t ON a.ancestor = t.node WHERE t.parent IS NOT NULL) SELECT * FROM a")
def tree_ancestors(v: Views) -> DataFrame:
    """All nodes above each node of a deep tree."""
    return t_.ancestors(_part_tree(v))


@query("tree_crumbs", f"WITH RECURSIVE t AS ({_PART_TREE_SQL}), a AS (SELECT node, CAST(0 AS BIGINT) AS depth, label crumbs FROM t WHERE parent IS NULL UNION ALL SELECT t.node, a.depth + 1, a.crumbs || ' › ' || t.label FROM a JOIN t ON t.parent = a.node) SELECT * FROM a")
def tree_crumbs(v: Views) -> DataFrame:
    """The labels from the root down to each node."""
    return t_.crumbs(_part_tree(v), "label")


@query("tree_cascade", f"WITH RECURSIVE t AS ({_PART_TREE_SQL}), g AS (SELECT node FROM t WHERE p_size = 7 UNION SELECT t.node FROM t JOIN g ON t.parent = g.node) SELECT node, label FROM t WHERE node NOT IN (SELECT node FROM g)")
def tree_cascade(v: Views) -> DataFrame:
    """What stays of a deep tree when some nodes go with all that hangs below."""
    return t_.cascade(_part_tree(v), F.col("p_size") == 7).select("node", "label")

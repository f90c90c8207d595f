"""Text: taxonomy search, classifiers, contacts from pages, verification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import contacts as k_
from ..operators import taxonomy as x
from .registry import query
from .views import Views, sql


def _norm(c: str) -> str:
    return f"(' ' || trim(regexp_replace(translate(lower(coalesce({c}, '')), '{t.MARKED}', '{t.PLAIN}'), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def _text(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", "text")


@query("norm_text", f"SELECT doc_id, md5({_norm('text')}) h, CAST(length({_norm('text')}) AS BIGINT) n FROM documents")
def norm_text(v: Views) -> DataFrame:
    n = t.norm(F.col("text"))
    return _text(v).select("doc_id", F.md5(n).alias("h"), F.length(n).cast("long").alias("n"))


@query("taxonomy_tree", sql("SELECT code, level, parent, count(*) n FROM (SELECT unnest([{'code': left(code6, 2), 'level': 2, 'parent': NULL}, {'code': left(code6, 4), 'level': 4, 'parent': left(code6, 2)}, {'code': code6, 'level': 6, 'parent': left(code6, 4)}], recursive := true) FROM v_taxonomy) GROUP BY 1, 2, 3"))
def taxonomy_tree(v: Views) -> DataFrame:
    return x.tree(v.taxonomy)


@query("taxonomy_build", sql("""SELECT code, level, parent, label, path FROM (SELECT heading code, 4 AS level, chapter parent, 'Heading ' || heading AS label, NULL path FROM g UNION ALL SELECT code6, 6, heading, 'Item ' || code6, 'Group ' || (CAST(substr(code6, 5, 2) AS INTEGER) // 10) FROM c
    UNION ALL SELECT code6 || '10', 8, code6, 'Line of ' || code6, 'Group ' || (CAST(substr(code6, 5, 2) AS INTEGER) // 10) || ' › Item ' || code6 FROM c)""",
    c="SELECT DISTINCT chapter, heading, code6 FROM v_taxonomy WHERE heading IS NOT NULL", g="SELECT DISTINCT chapter, heading FROM c"))
def taxonomy_build(v: Views) -> DataFrame:
    """The tree of a tariff book: headings, groups of ten codes, codes and a national line of each, with the path of dashes above."""
    codes = v.taxonomy.select("chapter", "heading", "code6").filter("heading is not null").distinct()
    c, lit = F.col, F.lit
    ten = F.floor(F.substring("code6", 5, 2).cast("int") / 10)
    line = lambda order, code, label: F.struct(order.alias("order"), code.alias("code"), label.alias("label"))
    heads = codes.select("chapter", line(c("heading"), F.concat(F.substring("heading", 1, 2), lit("."), F.substring("heading", 3, 2)), F.concat(lit("Heading "), "heading", lit(" :"))).alias("x")).distinct()
    groups = codes.select("chapter", line(F.concat("heading", ten.cast("string")), lit(""), F.concat(lit("- Group "), ten, lit(":"))).alias("x")).distinct()
    items = codes.select("chapter", F.explode(F.array(
        line(F.concat("heading", ten.cast("string"), "code6"), c("code6"), F.concat(lit("- - Item  "), "code6")),
        line(F.concat("heading", ten.cast("string"), "code6", lit("x")), F.concat("code6", lit("10")), F.concat(lit("- - - Line of "), "code6")),
    )).alias("x"))
    book = heads.union(groups).union(items).select("chapter", c("x.order").alias("place"), c("x.code").alias("code"), c("x.label").alias("label"), c("x.label").alias("label_en"))
    return x.build(book).select("code", "level", "parent", "label", "path")


_LABEL_SQL = "SELECT code6 code, heading head_code, min(description) own, max(description) context, min(split_part(description, ' ', 2)) head, min(p_brand || ' widget') en, max(split_part(description, ' ', 1) || ' goods') enctx FROM v_taxonomy GROUP BY 1, 2"


def _labelled(v: Views) -> DataFrame:
    return v.taxonomy.groupBy(F.col("code6").alias("code"), F.col("heading").alias("head_code")).agg(F.min("description").alias("own"), F.max("description").alias("context"), F.min(F.split_part("description", F.lit(" "), F.lit(2))).alias("head"), F.min(F.concat("p_brand", F.lit(" widget"))).alias("en"), F.max(F.concat(F.split_part("description", F.lit(" "), F.lit(1)), F.lit(" goods"))).alias("enctx"))


@query("taxonomy_labels", sql("SELECT code, array_to_string(list_filter([head, context, own], lambda p, i: length(p) > 0 AND lower(p) NOT IN ('other', 'others') AND (i = 1 OR p IS DISTINCT FROM [head, context, own][i - 1])), ' › ') path, CASE WHEN length(trim(split_part(context || '; ' || own, ';', 1))) > 6 THEN regexp_replace(left(trim(split_part(context || '; ' || own, ';', 1)), 6), '\\s+\\S*$', '') || '…' ELSE trim(split_part(context || '; ' || own, ';', 1)) END short FROM l", l=_LABEL_SQL))
def taxonomy_labels(v: Views) -> DataFrame:
    """Paths and short titles of codes."""
    c = F.col
    return _labelled(v).select("code", x.label_path(c("head"), c("context"), c("own")).alias("path"), t.short_title(F.concat(c("context"), F.lit("; "), c("own")), 6).alias("short"))


_NODES_SQL = f"SELECT code, 6 AS level, {', '.join(f'{_norm(f)} {f}' for f in x.FIELD_WEIGHTS)} FROM l"


def _nodes(v: Views) -> DataFrame:
    return _labelled(v).select("code", F.lit(6).alias("level"), *[t.norm(F.col(k)).alias(k) for k in x.FIELD_WEIGHTS])


def _score_sql(base: list[str], other: list[str], preferred: str, boosted: str) -> str:
    def hit(f: str, w: str) -> str:
        start = f"CASE WHEN contains({f}, ' {w}') THEN 1 ELSE 0 END" if len(w) >= 5 else "0"
        return f"(CASE WHEN contains({f}, ' {w} ') THEN 2 ELSE {start} END)"

    per = [f"greatest({', '.join(f'{k} * {hit(f, w)}' for f, k in x.FIELD_WEIGHTS.items())})" for w in base]
    extra = f"greatest(0, {', '.join(f'{k} * {hit(f, w)}' for w in other for f, k in x.OTHER_WEIGHTS.items())})" if other else "0"
    matched = " + ".join(f"CASE WHEN {p} > 0 THEN 1 ELSE 0 END" for p in per)
    phrase = " ".join(base)
    return f"""SELECT code, CAST(floor(raw + 0.5) AS BIGINT) score, raw FROM (SELECT code, {matched} m, {extra} e, {' + '.join(per)} + {extra} + CASE WHEN {matched} = {len(base)} THEN 10 ELSE 0 END
        + CASE WHEN starts_with(own, ' {phrase}') OR starts_with(head, ' {phrase}') THEN 12 ELSE 0 END + CASE WHEN code = '{preferred}' THEN 40 ELSE 0 END + CASE WHEN left(code, 4) = '{boosted}' THEN 20 ELSE 0 END raw FROM nodes) WHERE m > 0 OR e > 0 OR code = '{preferred}' ORDER BY raw DESC, code LIMIT 20"""


_QUERY = "Red goods and widgets for the ring"
_SYNONYMS = {"ring": ["gear", "steel bolt"], "valve": ["gadget"], "red goods": ["crimson"], "goods of": ["never"]}


@query("code_search", sql(f"SELECT code, score FROM ({_score_sql(x.search_words(_QUERY), [], '010305', '0211')})", l=_LABEL_SQL, nodes=_NODES_SQL))
def code_search(v: Views) -> DataFrame:
    """Codes for a free text, with a preferred code and a boosted heading."""
    return x.ranked(_nodes(v), _QUERY, preferred=["010305"], boosted=["0211"])


@query("code_prefix_search", sql("SELECT DISTINCT code6 code, 100 score FROM v_taxonomy WHERE code6 LIKE '031%' ORDER BY code LIMIT 20"))
def code_prefix_search(v: Views) -> DataFrame:
    """A query of digits is a prefix."""
    return v.taxonomy.select(F.col("code6").alias("code"), F.lit(100).alias("score")).filter(F.col("code").startswith("031")).distinct().orderBy("code").limit(20)


@query("synonym_search", sql(f"SELECT code, score FROM ({_score_sql(x.search_words(_QUERY), x.expand(_QUERY, _SYNONYMS), '', '')})", l=_LABEL_SQL, nodes=_NODES_SQL))
def synonym_search(v: Views) -> DataFrame:
    """With the words of synonyms, from a relation of phrases."""
    relation = v.spark.createDataFrame([(k, w) for k, of in _SYNONYMS.items() for w in of], "phrase string, synonym string")
    return x.ranked(_nodes(v), _QUERY, x.synonyms_for(_QUERY, relation))


@query("close_alternatives", sql(f"SELECT code, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, code) k, max(score) OVER () top FROM ({_score_sql(x.search_words(_QUERY), [], '010305', '0211')})) WHERE k BETWEEN 2 AND 4 AND score >= 0.55 * top", l=_LABEL_SQL, nodes=_NODES_SQL))
def close_alternatives(v: Views) -> DataFrame:
    return x.close_matches(x.ranked(_nodes(v), _QUERY, preferred=["010305"], boosted=["0211"]))


_ALIASES = {"the": "0101", "and": "0102", "der": "0201", "und der": "0202", "que": "0301", "de la": "0302", "of the": "0103", "los": "0401"}


@query("longest_alias", f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list(c) FILTER (WHERE l = top))), ','), '') codes FROM (SELECT *, max(l) OVER (PARTITION BY doc_id) top FROM (
    SELECT doc_id, CASE WHEN contains({_norm('text')}, ' ' || a || ' ') THEN length(a) END l, c FROM documents, (VALUES {', '.join(f"('{a}', '{c}')" for a, c in _ALIASES.items())}) v(a, c))) GROUP BY 1""")
def longest_alias(v: Views) -> DataFrame:
    return x.longest_alias(_text(v), _ALIASES).select("doc_id", F.coalesce(F.array_join("codes", ","), F.lit("")).alias("codes"))


_DICTIONARY = {"ring": ["0103", "0104"], "bolt": ["0211"], "widget": ["0301", "0103"], "gear": ["0402"]}
_NAMED_SQL = "list_distinct(flatten([" + ", ".join(f"CASE WHEN contains(n, ' {w} ') OR contains(n, ' {w}s ') THEN {c} ELSE [] END" for w, c in _DICTIONARY.items()) + "]))"


@query("dictionary_codes", f"SELECT p_partkey part_id, array_to_string(list_sort({_NAMED_SQL}), ',') codes FROM (SELECT p_partkey, {_norm("p_name || ' and ' || p_type || ' rings'")} n FROM part WHERE p_partkey IS NOT NULL)")
def dictionary_codes(v: Views) -> DataFrame:
    p = v.table("part")
    codes = x.dictionary_codes(F.concat("p_name", F.lit(" and "), "p_type", F.lit(" rings")), _DICTIONARY)
    return p.select(F.col("p_partkey").alias("part_id"), F.array_join(F.array_sort(codes), ",").alias("codes"))


_NARROW, _GATED = {"46.37": ["0103", "0104"], "10.83": ["0301"]}, {"46.38": ["0211", "0103"], "46.90": ["0402"]}
_CLASS_SQL = "CASE a " + " ".join(f"WHEN '{k}' THEN CASE WHEN len(list_intersect(named, {c})) > 0 THEN list_intersect(named, {c}) ELSE {c} END" for k, c in _NARROW.items()) + " " + " ".join(f"WHEN '{k}' THEN list_intersect(named, {c})" for k, c in _GATED.items()) + " ELSE [] END"


@query("classify_code_gate", f"""SELECT part_id, coalesce(array_to_string(list_sort(arg_min(codes, i) FILTER (WHERE len(codes) > 0)), ','), '') codes FROM (SELECT part_id, i, {_CLASS_SQL} codes FROM (SELECT part_id, named, unnest(acts) a, unnest([1, 2]) i FROM (
    SELECT part_id, {_NAMED_SQL} named, [CASE part_id % 4 WHEN 0 THEN '46.37' WHEN 1 THEN '46.38' WHEN 2 THEN '46.90' ELSE '99.99' END, CASE part_id % 3 WHEN 0 THEN '10.83' ELSE '46.38' END] acts FROM (SELECT p_partkey part_id, {_norm('p_name')} n FROM part)))) GROUP BY 1""")
def classify_code_gate(v: Views) -> DataFrame:
    """Codes from activity classes and the words of the name."""
    k = F.col("p_partkey")
    acts = F.array(F.when(k % 4 == 0, "46.37").when(k % 4 == 1, "46.38").when(k % 4 == 2, "46.90").otherwise("99.99"), F.when(k % 3 == 0, "10.83").otherwise("46.38"))
    rows = v.table("part").select(k.alias("part_id"), acts.alias("acts"), x.dictionary_codes(F.col("p_name"), _DICTIONARY).alias("named"))
    return rows.select("part_id", F.array_join(F.array_sort(x.classify(F.col("acts"), F.col("named"), _NARROW, _GATED)), ",").alias("codes"))


@query("classify_name", "SELECT p_partkey part_id, regexp_matches(lower(p_name), 'bolt|ring') AND regexp_matches(lower(p_name), 'blue|red|steel') AND (regexp_matches(lower(p_name), 'steel') OR p_size > 25) fits FROM part")
def classify_name(v: Views) -> DataFrame:
    """A trade word and a commodity word, and either a specific word or a strong sign; the words are relations."""
    words = lambda *w: v.spark.createDataFrame([(x,) for x in w], "word string")
    fits = k_.fits_name("p_name", words("ring", "bolt"), words("red", "blue", "steel"), words("steel"), F.col("p_size") > 25)
    return v.table("part").select(F.col("p_partkey").alias("part_id"), fits.alias("fits"))


_PREFIXES = {"01": "Economy", "0111": "Economy eleven", "02": "Large", "021": "Large one", "0": "Any"}


@query("industry_prefix", sql(f"SELECT code6, arg_max(label, length(prefix)) label FROM (SELECT DISTINCT code6 FROM v_taxonomy) LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PREFIXES.items())}) v(prefix, label) ON starts_with(code6, prefix) GROUP BY 1"))
def industry_prefix(v: Views) -> DataFrame:
    """The label of the longest prefix that fits, from a relation of prefixes."""
    labels = v.spark.createDataFrame(list(_PREFIXES.items()), "prefix string, label string")
    return k_.prefix_labels(v.taxonomy.select("code6").distinct(), "code6", labels)


_OPENED_SQL = f"regexp_replace(regexp_replace(lower(s), '{t.AT_SIGN}', '@', 'g'), '{t.DOT_SIGN}', '.', 'g')"
_EMAILS_SQL = f"""list_sort(list_distinct(list_filter(list_concat(regexp_extract_all({_OPENED_SQL}, '{t.EMAIL}'),
    list_filter(list_transform(regexp_extract_all({_OPENED_SQL}, '{t.SPOKEN}'), lambda e: regexp_replace(regexp_replace(e, '\\s+at\\s+', '@'), '\\s+dot\\s+', '.', 'g')), lambda e: regexp_matches(e, '^{t.EMAIL}$') AND length(split_part(e, '@', 1)) <= 40)),
    lambda e: split_part(e, '@', 1) NOT IN ({', '.join(f"'{b}'" for b in t.BLOCKED_LOCALS)}))))"""
_PHONES_SQL = f"""list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(s, '{t.PHONE}'), lambda p: NOT regexp_matches(p, '^(19|20)[0-9]{{2}}[-./][0-9]{{1,2}}[-./][0-9]{{1,2}}')), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 8 AND 15)))"""
_CONTACT_TEXT_SQL = "SELECT doc_id, coalesce(text, '') || ' mail: Info' || doc_id || ' (at) firm' || (doc_id % 9) || ' (dot) example.com, noreply@x.org, +49 (30) 1234-' || (1000 + doc_id % 9000) || ', 2024-01-31' s FROM documents"


def _contact_text(v: Views) -> DataFrame:
    k = F.col("doc_id")
    tail = F.concat(F.lit(" mail: Info"), k, F.lit(" (at) firm"), k % 9, F.lit(" (dot) example.com, noreply@x.org, +49 (30) 1234-"), 1000 + k % 9000, F.lit(", 2024-01-31"))
    return _text(v).select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("s"))


@query("email_extract", f"SELECT doc_id, array_to_string({_EMAILS_SQL}, ',') emails FROM ({_CONTACT_TEXT_SQL})")
def email_extract(v: Views) -> DataFrame:
    return _contact_text(v).select("doc_id", F.array_join(t.emails(F.col("s")), ",").alias("emails"))


@query("phone_extract", f"SELECT doc_id, array_to_string({_PHONES_SQL}, ',') phones FROM ({_CONTACT_TEXT_SQL})")
def phone_extract(v: Views) -> DataFrame:
    return _contact_text(v).select("doc_id", F.array_join(t.phones(F.col("s")), ",").alias("phones"))


_ADDRESS_SQL = """SELECT c_custkey id, 'www.firm' || (c_custkey % 50) || '.com' site_host, 'page' || c_custkey % 3 source_url, CASE c_custkey % 13 WHEN 0 THEN 'Info@Firm' || c_custkey % 50 || '.com' WHEN 1 THEN 'max.muster@firm' || c_custkey % 50 || '.com' WHEN 2 THEN 'someone' || c_custkey || '@gmail.com' WHEN 3 THEN 'jdoe@firm' || c_custkey || '.com'
    WHEN 4 THEN 'x1@firm' || c_custkey % 50 || '.com' WHEN 5 THEN 'not an address' WHEN 6 THEN 'einkauf-' || c_custkey || '@mail.firm' || c_custkey % 50 || '.com' WHEN 7 THEN 'no-reply@firm' || c_custkey % 50 || '.com' WHEN 8 THEN 'buyer@mailinator.com' WHEN 9 THEN 'vertrieb@firm' || c_custkey % 50 || '.com' WHEN 10 THEN 'trading@other.co.uk' END email FROM customer"""


def _role_sql(local: str, kind: bool) -> str:
    roles = " ".join(f"WHEN regexp_matches({local}, '^(?:{'|'.join(words.split())})') THEN {"'role'" if kind else rank}" for rank, words in t.ROLE_RANKS.items())
    person = f"regexp_matches({local}, '^[a-z]{{2,}}[._-][a-z]{{2,}}$') OR regexp_matches({local}, '^[a-z]\\.?[a-z]{{3,}}$')"
    return f"CASE {roles} WHEN {person} THEN {"'personal'" if kind else t.PERSON_RANK} ELSE {"'other'" if kind else t.OTHER_RANK} END"


_LOCAL = "split_part(a, '@', 1)"
_FREE_SQL = f"split_part(a, '@', 2) IN ({', '.join(f"'{f}'" for f in t.FREEMAIL)})"
_STATUS_SQL = f"CASE WHEN regexp_matches(a, '^{t.EMAIL}$') THEN CASE WHEN {_FREE_SQL} THEN 'freemail' WHEN {_role_sql(_LOCAL, True)} = 'other' THEN 'domain' ELSE {_role_sql(_LOCAL, True)} END END"
_USABLE_SQL = f"coalesce(regexp_matches(a, '^{t.EMAIL}$') AND NOT regexp_matches({_LOCAL}, '{t.NEVER}') AND NOT regexp_matches(a, '{t.DISPOSABLE}'), FALSE)"
_SECOND = ", ".join(f"'{x}'" for x in t.SECOND_LEVEL)


def _registrable_sql(h: str) -> str:
    p = f"string_split({h}, '.')"
    return f"CASE WHEN len({p}) < 2 THEN {h} WHEN len({p}) >= 3 AND {p}[-2] IN ({_SECOND}) AND length({p}[-1]) = 2 THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END"


_CANDIDATES_SQL = f"SELECT *, same OR {_FREE_SQL} AS own FROM (SELECT *, {_registrable_sql("split_part(a, '@', 2)")} = {_registrable_sql("replace(site_host, 'www.', '')")} same FROM (SELECT *, lower(trim(email)) a FROM ({_ADDRESS_SQL}))) WHERE {_USABLE_SQL}"


def _addresses(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    firm = F.concat(F.lit("firm"), k % 50, F.lit(".com"))
    forms = [
        F.concat(F.lit("Info@Firm"), k % 50, F.lit(".com")), F.concat(F.lit("max.muster@"), firm), F.concat(F.lit("someone"), k, F.lit("@gmail.com")), F.concat(F.lit("jdoe@firm"), k, F.lit(".com")), F.concat(F.lit("x1@"), firm),
        F.lit("not an address"), F.concat(F.lit("einkauf-"), k, F.lit("@mail."), firm), F.concat(F.lit("no-reply@"), firm), F.lit("buyer@mailinator.com"), F.concat(F.lit("vertrieb@"), firm), F.lit("trading@other.co.uk"),
    ]
    email = F.get(F.array(*forms), (k % 13).cast("int"))
    return v.table("customer").select(k.alias("id"), F.concat(F.lit("www."), firm).alias("site_host"), F.concat(F.lit("page"), k % 3).alias("source_url"), email.alias("email"))


@query("email_class", f"SELECT id, {_STATUS_SQL} status, CASE WHEN a IS NOT NULL THEN {_role_sql(_LOCAL, True)} ELSE 'other' END kind, CASE WHEN a IS NOT NULL THEN {_role_sql(_LOCAL, False)} ELSE {t.OTHER_RANK} END AS rank FROM (SELECT id, lower(trim(email)) a FROM ({_ADDRESS_SQL}))")
def email_class(v: Views) -> DataFrame:
    """Status, kind and rank of each address."""
    return _addresses(v).select("id", t.email_status(F.col("email")).alias("status"), t.email_kind(F.col("email"))["kind"].alias("kind"), t.email_kind(F.col("email"))["rank"].alias("rank"))


@query("email_norm", f"SELECT id, CASE WHEN {_STATUS_SQL} IS NOT NULL THEN a END email, {_STATUS_SQL} status FROM (SELECT id, lower(trim(email)) a FROM ({_ADDRESS_SQL}))")
def email_norm(v: Views) -> DataFrame:
    status = t.email_status(F.col("email"))
    return _addresses(v).select("id", F.when(status.isNotNull(), F.lower(F.trim("email"))).alias("email"), status.alias("status"))


@query("email_accept", f"SELECT id, a address, same FROM ({_CANDIDATES_SQL}) WHERE own")
def email_accept(v: Views) -> DataFrame:
    """Addresses that may be a contact: read by someone, not disposable, of the site's own domain or a free host."""
    return k_.usable_addresses(_addresses(v)).select("id", "address", "same")


@query("best_email", f"""SELECT site_host, x.a email, x.s status, x.u source_url FROM (SELECT site_host, min({{'o': NOT same, 'r': {_role_sql(_LOCAL, False)}, 'a': a, 'u': source_url, 's': {_STATUS_SQL}}}) x FROM ({_CANDIDATES_SQL}) WHERE own GROUP BY 1)""")
def best_email(v: Views) -> DataFrame:
    """The best address of each site: of its own domain, then by the rank of its role, then the first in order."""
    return k_.best_addresses(_addresses(v), "site_host")


_HTML_SQL = "html"
for _p in ("(?is)<script\\b.*?</script>", "(?is)<style\\b.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{_p}', ' ', 'g')"
for _a, _b in t._ENTITIES.items():
    _HTML_SQL = f"replace({_HTML_SQL}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
_HTML_SQL = f"trim(regexp_replace({_HTML_SQL}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def _pages(v: Views) -> DataFrame:
    return v.table("pages").withColumn("plain", t.html_text(F.col("html")))


@query("html_text", f"SELECT page_id, md5({_HTML_SQL}) h, CAST(length({_HTML_SQL}) AS BIGINT) n FROM pages")
def html_text(v: Views) -> DataFrame:
    return _pages(v).select("page_id", F.md5("plain").alias("h"), F.length("plain").cast("long").alias("n"))


@query("html_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) title FROM pages")
def html_title(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", t.html_title(F.col("html")).alias("title"))


def _entities_sql(c: str) -> str:
    for a, b in t._ENTITIES.items():
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


#: The target of a tag, by cutting the tag where an href ends and taking what stands between its quotes or up to the next blank.
_AFTER_SQL = "ltrim(regexp_replace(a, '(?is)^.*?\\shref\\s*=', ''))"
_TARGET_SQL = _entities_sql(f"trim(CASE left({_AFTER_SQL}, 1) WHEN '\"' THEN split_part({_AFTER_SQL}, '\"', 2) WHEN '''' THEN split_part({_AFTER_SQL}, '''', 2) ELSE rtrim(split_part(split_part({_AFTER_SQL}, ' ', 1), '>', 1)) END)")


@query("page_links", f"SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href[^>]*>'), lambda a: {_TARGET_SQL}))), ' ') links FROM pages")
def page_links(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.array_join(t.links(F.col("html")), " ").alias("links"))


_HOST_SQL = "nullif(regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1), '^www\\.', ''), '')"
_REG_SQL = f"CASE WHEN len(p) < 2 THEN h WHEN len(p) >= 3 AND p[-2] IN ({', '.join(f"'{s}'" for s in t.SECOND_LEVEL)}) AND length(p[-1]) = 2 THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END"


@query("host_registrable", f"SELECT page_id, h host, {_REG_SQL} registered FROM (SELECT page_id, h, string_split(h, '.') p FROM (SELECT page_id, {_HOST_SQL} h FROM pages))")
def host_registrable(v: Views) -> DataFrame:
    h = t.host(F.col("url"))
    return v.table("pages").select("page_id", h.alias("host"), t.registrable(h).alias("registered"))


_BLOCKED_HOSTS = ["example.org", "facebook.com", "news.example.net", "com"]


@query("company_hosts", f"SELECT page_id, h host FROM (SELECT page_id, {_HOST_SQL} h FROM pages) p WHERE NOT EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{b}')" for b in _BLOCKED_HOSTS)}) v(b) WHERE h = b OR ends_with(h, '.' || b))")
def company_hosts(v: Views) -> DataFrame:
    """Pages that are not on a directory, a network or another host that is no company's, nor on one of its subdomains."""
    blocked = v.spark.createDataFrame([(b,) for b in _BLOCKED_HOSTS], "host string")
    return k_.without_hosts(v.table("pages").select("page_id", "url"), "url", blocked).select("page_id", t.host(F.col("url")).alias("host"))


_PAGE_NORM_SQL = f"SELECT page_id, url, plain, {_norm('plain')} n, title FROM (SELECT page_id, url, {_HTML_SQL} plain, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) title FROM pages)"
_TOKENS_SQL = f"list_filter(string_split(trim({_norm('name')}), ' '), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(f"'{f}'" for f in t.LEGAL_FORMS)}))"
_NAME_SQL = f"coalesce(CASE WHEN len(toks) > 0 THEN floor(len(list_filter(toks, lambda w: contains(n, w))) * 100.0 / len(toks)) >= 60 END, contains(n, trim({_norm('name')})))"


def _word(k: int):
    return F.split_part("title", F.lit(" "), F.lit(k))


def _named_pages(v: Views) -> DataFrame:
    rows = _pages(v).withColumns({"title": t.html_title(F.col("html")), "n": t.norm(F.col("plain"))})
    return rows.withColumn("name", F.concat(_word(1), F.lit(" zzzq GmbH "), F.when(F.col("page_id") % 2 == 0, _word(2)).otherwise("")))


_NAMED_PAGES_SQL = "SELECT *, split_part(title, ' ', 1) || ' zzzq GmbH ' || CASE WHEN page_id % 2 = 0 THEN split_part(title, ' ', 2) ELSE '' END name FROM p"


@query("name_on_page", sql(f"SELECT page_id, {_NAME_SQL} named FROM (SELECT *, {_TOKENS_SQL} toks FROM q)", p=_PAGE_NORM_SQL, q=_NAMED_PAGES_SQL))
def name_on_page(v: Views) -> DataFrame:
    return _named_pages(v).select("page_id", t.name_on_page(F.col("name"), F.col("n")).alias("named"))


_QUOTE_SQL = "length(q) >= 15 AND (contains(n, q) OR (len(lw) >= 3 AND coalesce(floor(len(list_filter(lw, lambda w: contains(n, w))) * 100.0 / len(lw)) >= 85, FALSE)))"


@query("quote_grounding", sql(f"SELECT page_id, {_QUOTE_SQL} grounded FROM (SELECT *, list_filter(string_split(q, ' '), lambda w: length(w) >= 4) lw FROM (SELECT page_id, n, trim({_norm('quote')}) q FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN substr(plain, 40, 80) WHEN 1 THEN 'invented words that nobody wrote here' ELSE title || ' invented' END quote FROM p)))", p=_PAGE_NORM_SQL))
def quote_grounding(v: Views) -> DataFrame:
    """Quotes that stand on their page, and those that do not."""
    k = F.col("page_id")
    quote = F.when(k % 3 == 0, F.substring("plain", 40, 80)).when(k % 3 == 1, "invented words that nobody wrote here").otherwise(F.concat("title", F.lit(" invented")))
    return _named_pages(v).select("page_id", t.quote_on_page(quote, F.col("n")).alias("grounded"))


_KINDS = ["importer", "distributor", "retail_chain"]
_ORIGIN, _IMPORTS, _PRODUCT = "(?i)proudly made|handwerk", "(?i)the and|tion", ["heas", "qu"]
_CANDIDATE_SQL = """SELECT page_id, url, n, plain, CASE page_id % 11 WHEN 0 THEN 'x' ELSE split_part(title, ' ', 1) || ' zzzq GmbH ' || CASE WHEN page_id % 2 = 0 THEN split_part(title, ' ', 2) ELSE '' END END AS name, CASE page_id % 13 WHEN 0 THEN 'FR' WHEN 1 THEN 'de' ELSE 'DE' END country,
    CASE page_id % 7 WHEN 0 THEN 'Retail chain' WHEN 1 THEN 'nobody' ELSE 'importer' END kind, CASE page_id % 5 WHEN 0 THEN 'www.shop' || page_id || '.id' WHEN 1 THEN 'https://firm1.de/x' END site, CASE page_id % 9 WHEN 0 THEN 'invented words that nobody wrote here' ELSE substr(plain, 40, 80) END quote,
    CASE WHEN page_id % 2 = 0 THEN 'A@firm1.de' ELSE 'other@firm1.de' END email, CASE WHEN page_id % 3 = 0 THEN '+49 30 1234567' END phone, CASE WHEN page_id % 17 <> 0 THEN plain || CASE WHEN page_id % 4 = 0 THEN ' proudly made' ELSE '' END END evidence, CASE WHEN page_id % 4 = 1 THEN 'Site of ' || title END site_text, ['a@firm1.de', 'z@mail.firm1.de'] seen_emails, ['49301234567'] seen_phones FROM p"""


def _norm_sql(c: str) -> str:
    return _norm(c)


def _on_page_sql(page: str) -> str:
    tokens = f"list_filter(string_split(trim({_norm('name')}), ' '), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(f"'{f}'" for f in t.LEGAL_FORMS)}))"
    return f"coalesce(CASE WHEN len({tokens}) > 0 THEN floor(len(list_filter({tokens}, lambda w: contains({page}, w))) * 100.0 / len({tokens})) >= 60 END, contains({page}, trim({_norm('name')})))"


_VERIFY_QUOTE_SQL = _QUOTE_SQL.replace("contains(n,", "contains(ev,")
_SITE_SQL = "nullif(regexp_replace(regexp_extract(lower(site), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1), '^www\\.', ''), '')"


@query("verify_candidates", sql(f"""SELECT page_id, reason, CASE WHEN reason IS NULL THEN em END email, CASE WHEN reason IS NULL THEN ph END phone, CASE WHEN reason IS NULL THEN least(92, 55 + CASE WHEN site_text IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN em IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN ph IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN buys THEN 8 ELSE 0 END + CASE WHEN fits THEN 7 ELSE 0 END + CASE WHEN kind = 'importer' THEN 3 ELSE 0 END) END confidence FROM (
    SELECT *, CASE WHEN length(trim(name)) < 2 THEN 'no_name' WHEN upper(country) <> 'DE' THEN 'other_country' WHEN replace(lower(trim(kind)), ' ', '_') NOT IN ({', '.join(f"'{k}'" for k in _KINDS)}) THEN 'unknown_kind' WHEN evidence IS NULL THEN 'evidence_not_opened' WHEN NOT ({_VERIFY_QUOTE_SQL}) THEN 'quote_not_found'
      WHEN coalesce(ends_with(h, '.id'), FALSE) THEN 'home_site' WHEN NOT ({_on_page_sql('ev')} OR (site_text IS NOT NULL AND {_on_page_sql('st')})) THEN 'name_not_found' WHEN regexp_matches(left(own, 4000), '{_ORIGIN}') AND NOT regexp_matches(own, '{_IMPORTS}') THEN 'home_exporter' WHEN NOT fits AND NOT buys THEN 'no_sign_of_buying' END reason,
      CASE WHEN list_contains(seen_emails, lower(email)) THEN lower(email) WHEN h IS NOT NULL THEN list_min(list_filter(seen_emails, lambda e: ends_with(split_part(e, '@', 2), h))) END em, CASE WHEN list_contains(seen_phones, regexp_replace(phone, '[^0-9]', '', 'g')) THEN regexp_replace(phone, '[^0-9]', '', 'g') WHEN site_text IS NOT NULL THEN seen_phones[1] END ph
    FROM (SELECT *, list_filter(string_split(q, ' '), lambda w: length(w) >= 4) lw, regexp_matches(b, '{_IMPORTS}') buys, {' OR '.join(f"contains({_norm_sql('b')}, '{k}')" for k in _PRODUCT)} fits FROM (SELECT *, {_norm('evidence')} ev, {_norm('site_text')} st, trim({_norm('quote')}) q, coalesce(site_text, evidence) own, concat_ws(' ', evidence, site_text) b, {_SITE_SQL} h FROM q)))""", p=_PAGE_NORM_SQL, q=_CANDIDATE_SQL))
def verify_candidates(v: Views) -> DataFrame:
    """Why a candidate is refused, or with which contacts and how far it is trusted."""
    k, c = F.col("page_id"), F.col
    rows = _named_pages(v).withColumns({
        "name": F.when(k % 11 == 0, "x").otherwise(F.col("name")), "country": F.when(k % 13 == 0, "FR").when(k % 13 == 1, "de").otherwise("DE"), "kind": F.when(k % 7 == 0, "Retail chain").when(k % 7 == 1, "nobody").otherwise("importer"),
        "site": F.when(k % 5 == 0, F.concat(F.lit("www.shop"), k, F.lit(".id"))).when(k % 5 == 1, "https://firm1.de/x"), "quote": F.when(k % 9 == 0, "invented words that nobody wrote here").otherwise(F.substring("plain", 40, 80)),
        "email": F.when(k % 2 == 0, "A@firm1.de").otherwise("other@firm1.de"), "phone": F.when(k % 3 == 0, "+49 30 1234567"), "evidence": F.when(k % 17 != 0, F.concat("plain", F.when(k % 4 == 0, " proudly made").otherwise(""))),
        "site_text": F.when(k % 4 == 1, F.concat(F.lit("Site of "), "title")), "seen_emails": F.array(F.lit("a@firm1.de"), F.lit("z@mail.firm1.de")), "seen_phones": F.array(F.lit("49301234567")),
    })
    found = k_.verify(rows, "DE", _KINDS, ".id", _ORIGIN, _IMPORTS, _PRODUCT)
    return found.select("page_id", c("reason"), c("email"), c("phone"), c("confidence"))


_LISTED_SQL = """SELECT page_id page, i place, plain AS text, CASE i WHEN 1 THEN split_part(title, ' ', 1) || ' Ltd' WHEN 2 THEN 'Zzzq Invented' WHEN 3 THEN upper(split_part(title, ' ', 1)) || ' LTD' ELSE split_part(title, ' ', 2) || ' ' || split_part(title, ' ', 1) END AS name, CASE (page_id + i) % 5 WHEN 0 THEN 'ID' WHEN 1 THEN NULL WHEN 2 THEN 'DE' ELSE 'FR' END country,
    CASE WHEN i = 1 THEN 'nobody@nowhere.de' END email, CASE WHEN i = 4 THEN regexp_extract(plain, '([0-9]{4,})', 1) END phone, url site FROM p, (VALUES (1), (2), (3), (4)) v(i)"""


@query("directory_harvest", sql(f"""SELECT page, place, outcome, phone, CASE WHEN outcome = 'kept' THEN 58 + CASE WHEN em IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN st IS NOT NULL THEN 4 ELSE 0 END END confidence FROM (
    SELECT *, coalesce(o, CASE WHEN row_number() OVER (PARTITION BY page, lower(trim(name)), country, o IS NULL ORDER BY place) > 1 THEN 'repeated' ELSE 'kept' END) outcome FROM (
    SELECT page, place, name, country, CASE WHEN NOT {_on_page_sql('n')} THEN 'dropped_name' WHEN country IS NULL OR country = 'ID' OR country NOT IN ('DE', 'FR') THEN 'dropped_country' END o, CASE WHEN contains(s, email) THEN email END em, CASE WHEN d <> '' AND contains(regexp_replace(text, '[^0-9]', '', 'g'), d) THEN d END phone, CASE WHEN contains(s, h) THEN h END st
    FROM (SELECT *, {_norm('text')} n, lower(regexp_replace(text, '\\s+', ' ', 'g')) s, regexp_replace(phone, '[^0-9]', '', 'g') d, {_SITE_SQL} h FROM q) WHERE length(trim(name)) >= 3))""", p=_PAGE_NORM_SQL, q=_LISTED_SQL))
def directory_harvest(v: Views) -> DataFrame:
    """Rows that a page is said to list: what the page bears out, and why the others go."""
    k, i = F.col("page"), F.col("place")
    rows = _named_pages(v).select(F.col("page_id").alias("page"), F.col("plain").alias("text"), "title", F.col("url").alias("site"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("place")).withColumns({
        "name": F.when(i == 1, F.concat(_word(1), F.lit(" Ltd"))).when(i == 2, "Zzzq Invented").when(i == 3, F.concat(t.capitals(_word(1)), F.lit(" LTD"))).otherwise(F.concat(_word(2), F.lit(" "), _word(1))),
        "country": F.when((k + i) % 5 == 0, "ID").when((k + i) % 5 == 1, None).when((k + i) % 5 == 2, "DE").otherwise("FR"), "email": F.when(i == 1, "nobody@nowhere.de"), "phone": F.when(i == 4, F.regexp_extract("text", "([0-9]{4,})", 1)),
    })
    return k_.harvest(rows, "ID", ["DE", "FR"]).select("page", "place", "outcome", "phone", "confidence")


@query("list_page_precheck", f"SELECT doc_id, length(text) >= 600 AND (len(regexp_extract_all(text, '(?i)\\b(?:gmbh|ltd|inc|the)\\b')) >= 10 OR len({_EMAILS_SQL.replace('lower(s)', 'lower(text)')}) >= 8) is_list FROM documents")
def list_page_precheck(v: Views) -> DataFrame:
    s = F.col("text")
    return _text(v).select("doc_id", ((F.length(s) >= 600) & ((F.regexp_count(s, F.lit(r"(?i)\b(?:gmbh|ltd|inc|the)\b")) >= 10) | (F.size(t.emails(s)) >= 8))).alias("is_list"))


@query("judge_accept", "SELECT doc_id, quality = 1 AND toxic = 0 AND (doc_id * 7) % 100 >= 60 accepted FROM labels")
def judge_accept(v: Views) -> DataFrame:
    return v.table("labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0) & ((F.col("doc_id") * 7) % 100 >= 60)).alias("accepted"))


@query("template_render", sql("SELECT id, 'Dear ' || name || ' of ' || country || ', write to ' || coalesce(email, '') || '. ' message FROM v_entity"))
def template_render(v: Views) -> DataFrame:
    c = F.col
    return v.entity.select("id", t.render("Dear {{name}} of {{country}}, write to {{email}}. {{unknown}}", {"name": c("name"), "country": c("country"), "email": c("email")}).alias("message"))


@query("tidy_name")
def tidy_name(v: Views) -> DataFrame:
    """Names in capitals made readable; tests hold it against a plain version."""
    k = F.col("p_partkey")
    raw = F.concat(F.upper("p_name"), F.when(k % 3 == 0, " SAINT-DENIS GMBH").when(k % 3 == 1, " bcd LTD").otherwise(""))
    return v.table("part").select(k.alias("part_id"), t.tidy_name(raw).alias("name"))


@query("query_generator", sql("SELECT query, heading, country, n, rn AS rank FROM (SELECT *, row_number() OVER (ORDER BY n, heading, country, tpl) rn FROM (SELECT heading, country, tpl, replace(replace(tpl, '{p}', heading), '{c}', country) query, coalesce(n, 0) n FROM (SELECT * FROM (SELECT DISTINCT heading FROM v_taxonomy), (SELECT DISTINCT n_name country FROM nation), (VALUES ('{p} importers {c}'), ('{c} {p} Einkauf')) x(tpl)) LEFT JOIN (SELECT heading, supplier_country country, count(*) n FROM v_shipment JOIN v_supplier USING (supplier_id) GROUP BY 1, 2) USING (heading, country))) WHERE rn <= 500"))
def query_generator(v: Views) -> DataFrame:
    """The next 500 search queries for products, countries and templates: pairs of which least is known first."""
    from ..operators.search import page

    known = v.shipments("supplier_id", "heading").join(v.supplier, "supplier_id").groupBy("heading", F.col("supplier_country").alias("country")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(r[0]) for r in v.table("nation").select("n_name").distinct().collect()])  # 25 names, as settings are
    pairs = v.taxonomy.select("heading").distinct().select("heading", F.explode(names).alias("country"))
    rows = pairs.join(known, ["heading", "country"], "left").withColumn("tpl", F.explode(F.array(F.lit("{p} importers {c}"), F.lit("{c} {p} Einkauf"))))
    made = rows.select("heading", "country", "tpl", F.replace(F.replace("tpl", F.lit("{p}"), F.col("heading")), F.lit("{c}"), F.col("country")).alias("query"), F.coalesce("n", F.lit(0)).alias("n"))
    return page(made, [F.asc("n"), F.asc("heading"), F.asc("country"), F.asc("tpl")], 1, 500).select("query", "heading", "country", "n", "rank")


_KEYWORDS = [(1, "steel ring", "jewellery"), (2, "bolt", "hardware"), (3, "ring", "jewellery"), (4, "red", "colour"), (5, "blue", "colour")]


@query("keyword_category", f"SELECT part_id, coalesce(arg_min(c, place), any_value(fallback)) category FROM (SELECT p_partkey part_id, {_norm('p_name')} n, CASE WHEN p_size > 40 THEN 'large goods' ELSE 'general' END fallback FROM part) LEFT JOIN (VALUES {', '.join(str(k) for k in _KEYWORDS)}) v(place, w, c) ON contains(n, ' ' || w || ' ') GROUP BY 1")
def keyword_category(v: Views) -> DataFrame:
    """The category of the first keyword that a name has, from a relation of keywords; else by size, else a default."""
    keywords = v.spark.createDataFrame(_KEYWORDS, "place int, keyword string, category string")
    found = k_.keyword_categories(v.table("part"), "p_name", keywords, "")
    fallback = F.when(F.col("p_size") > 40, "large goods").otherwise("general")
    return found.select(F.col("p_partkey").alias("part_id"), F.coalesce(F.nullif("category", F.lit("")), fallback).alias("category"))


@query("pick_by_preference", sql("SELECT heading, code, rate FROM (SELECT heading, code6 code, CASE WHEN part_id % 3 = 0 THEN part_id % 20 END rate, row_number() OVER (PARTITION BY heading ORDER BY (part_id % 3 = 0) DESC, code6, part_id) rn FROM v_taxonomy) WHERE rn = 1"))
def pick_by_preference(v: Views) -> DataFrame:
    """For each heading the first code with a rate, else the first."""
    k = F.col("part_id")
    first = F.min(F.struct((k % 3 != 0).alias("no"), "code6", "part_id"))
    best = v.taxonomy.groupBy("heading").agg(first.alias("m"))
    return best.select("heading", F.col("m.code6").alias("code"), F.when(~F.col("m.no"), F.col("m.part_id") % 20).alias("rate"))


@query("best_candidate", sql("SELECT country, id, score FROM (SELECT country, id, n_codes * 10 + confidence score, row_number() OVER (PARTITION BY country ORDER BY (phone IS NOT NULL) DESC, n_codes * 10 + confidence DESC, id) rn FROM v_entity) WHERE rn <= 2"))
def best_candidate(v: Views) -> DataFrame:
    """The first two of each country in order of preference."""
    from pyspark.sql import Window as W

    score = F.col("n_codes") * 10 + F.col("confidence")
    rank = W.partitionBy("country").orderBy(F.col("phone").isNotNull().desc(), F.desc("score"), F.asc("id"))
    return v.entity.withColumn("score", score).withColumn("rn", F.row_number().over(rank)).filter("rn <= 2").select("country", "id", "score")


_SLUGS_SQL = f"list_filter(string_split(trim({_norm('p_name')}), ' '), lambda w: length(w) >= 3)"


@query("domain_slugs", f"SELECT p_partkey part_id, unnest(list_distinct(flatten(list_transform([array_to_string(k, ''), array_to_string(k, '-'), k[1]], lambda s: [s || '.com', s || '.de'])))) AS host FROM (SELECT p_partkey, {_SLUGS_SQL} k FROM part) WHERE len(k) > 0")
def domain_slugs(v: Views) -> DataFrame:
    """Hosts that a name may have."""
    k = t.words(F.col("p_name"), 3)
    slugs = F.array(F.array_join(k, ""), F.array_join(k, "-"), F.get(k, F.lit(0)))
    hosts = F.array_distinct(F.flatten(F.transform(slugs, lambda s: F.array(F.concat(s, F.lit(".com")), F.concat(s, F.lit(".de"))))))
    return v.table("part").filter(F.size(k) > 0).select(F.col("p_partkey").alias("part_id"), F.explode(hosts).alias("host"))


_WANTED = ["Example Blog Handel", "Wetter Example Ltd", "The Site Inc"]


@query("host_rank", f"""SELECT search, host, score, place FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY score DESC, host DESC) place FROM (SELECT search, host, max(CAST(3 * len(list_filter(k, lambda w: contains(replace(host, '-', ''), w))) + len(list_filter(k, lambda w: contains(lower(title), w))) AS BIGINT)) score FROM (
    SELECT page_id % 40 search, {_HOST_SQL} host, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) title, CASE page_id % 3 {' '.join(f"WHEN {i} THEN {[w for w in n.lower().split() if len(w) >= 4]}" for i, n in enumerate(_WANTED))} END k FROM pages) WHERE host IS NOT NULL GROUP BY 1, 2)) WHERE place <= 3""")
def host_rank(v: Views) -> DataFrame:
    """The three hosts of each search that fit the wanted name best."""
    k = F.col("page_id")
    name = F.get(F.array(*map(F.lit, _WANTED)), (k % 3).cast("int"))
    return k_.best_hosts(v.table("pages").select((k % 40).alias("search"), name.alias("name"), "url", t.html_title(F.col("html")).alias("title")))


@query("website_norm", "SELECT page_id, CASE WHEN regexp_matches(h, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') AND regexp_replace(h, '^www\\.', '') NOT IN ('facebook.com', 'linkedin.com', 'instagram.com') THEN 'https://' || h END website FROM (SELECT page_id, regexp_extract(lower(trim(CASE page_id % 4 WHEN 0 THEN 'facebook.com/x' WHEN 1 THEN 'WWW.Shop' || page_id || '.de/abc' WHEN 2 THEN 'no host' ELSE url END)), '^(?:https?://)?([^/?#:]+)', 1) h FROM pages)")
def website_norm(v: Views) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 4 == 0, "facebook.com/x").when(k % 4 == 1, F.concat(F.lit("WWW.Shop"), k, F.lit(".de/abc"))).when(k % 4 == 2, "no host").otherwise(F.col("url"))
    return v.table("pages").select("page_id", t.website(url).alias("website"))


@query("phone_norm", "SELECT id, CASE WHEN length(replace(k, '+', '')) BETWEEN 8 AND 15 THEN CASE WHEN starts_with(k, '+') THEN '+' ELSE '' END || replace(k, '+', '') END phone FROM (SELECT id, regexp_replace(regexp_replace(trim(p), '[^0-9+]', '', 'g'), '^00', '+') k FROM (SELECT c_custkey id, CASE c_custkey % 4 WHEN 0 THEN ' 0049 (30) 12' || c_custkey WHEN 1 THEN '+33 1 23 45 ' || c_custkey WHEN 2 THEN '12' || c_custkey ELSE '030/55-66-77-' || c_custkey END p FROM customer))")
def phone_norm(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    number = F.when(k % 4 == 0, F.concat(F.lit(" 0049 (30) 12"), k)).when(k % 4 == 1, F.concat(F.lit("+33 1 23 45 "), k)).when(k % 4 == 2, F.concat(F.lit("12"), k)).otherwise(F.concat(F.lit("030/55-66-77-"), k))
    return v.table("customer").select(k.alias("id"), t.phone(number).alias("phone"))


@query("derived_website", sql("SELECT id, coalesce(website, CASE WHEN email_status <> 'freemail' THEN 'https://' || split_part(email, '@', 2) END) website FROM v_entity"))
def derived_website(v: Views) -> DataFrame:
    own = F.when(F.col("email_status") != "freemail", F.concat(F.lit("https://"), F.substring_index("email", "@", -1)))
    return v.entity.select("id", F.coalesce("website", own).alias("website"))


@query("address_join", sql("SELECT id, array_to_string(list_filter([nullif(CASE WHEN id % 2 = 0 THEN 'Street ' || id ELSE '' END, ''), CASE WHEN id % 3 = 0 THEN country END, industry], lambda p: p IS NOT NULL), ', ') address FROM v_entity"))
def address_join(v: Views) -> DataFrame:
    k = F.col("id")
    street = F.nullif(F.when(k % 2 == 0, F.concat(F.lit("Street "), k)).otherwise(""), F.lit(""))
    return v.entity.select("id", F.array_join(F.array_compact(F.array(street, F.when(k % 3 == 0, F.col("country")), F.col("industry"))), ", ").alias("address"))


@query("activity_class", "SELECT id, CASE WHEN length(d) >= 4 THEN left(d, 2) || '.' || substr(d, 3, 2) END class FROM (SELECT c_custkey id, regexp_replace(CASE c_custkey % 3 WHEN 0 THEN '46.' || (10 + c_custkey % 90) || 'Z' WHEN 1 THEN '46' || (100 + c_custkey % 900) ELSE 'A' END, '[^0-9]', '', 'g') d FROM customer)")
def activity_class(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    digits = F.regexp_replace(F.when(k % 3 == 0, F.concat(F.lit("46."), 10 + k % 90, F.lit("Z"))).when(k % 3 == 1, F.concat(F.lit("46"), 100 + k % 900)).otherwise("A"), "[^0-9]", "")
    return v.table("customer").select(k.alias("id"), F.when(F.length(digits) >= 4, F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 2))).alias("class"))


@query("excerpt", "SELECT doc_id, substr(text, greatest(1, CAST(strpos(lower(text), 'tion') AS BIGINT) - 40), 80) excerpt FROM documents")
def excerpt(v: Views) -> DataFrame:
    return _text(v).select("doc_id", t.excerpt(F.col("text"), "tion", 80).alias("excerpt"))


@query("chunks")
def chunks(v: Views) -> DataFrame:
    """Texts in pieces of 400 characters at most, cut at spaces; tests hold it against a plain version."""
    return _text(v).select("doc_id", F.posexplode(t.chunks(F.col("text"), 400)).alias("k", "chunk"))


@query("parked_filter", sql("SELECT page_id, length(plain) >= 200 AND NOT regexp_matches(lower(left(plain, 3000)), 'domain is for sale|buy this domain|parked free|ierpa') own FROM p", p=_PAGE_NORM_SQL))
def parked_filter(v: Views) -> DataFrame:
    """Pages that are a site of their own; the words are looked for where such pages have them, at the top."""
    parked = F.lower(F.substring("plain", 1, 3000)).rlike("domain is for sale|buy this domain|parked free|ierpa")
    return _pages(v).select("page_id", ((F.length("plain") >= 200) & ~parked).alias("own"))


@query("tag_gate", "SELECT event_id, CAST(k AS BIGINT) >= 30 AND user_id % 3 <> 0 AND (user_id % 2 = 0 OR event_type = 'view') admitted FROM (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') k FROM events)")
def tag_gate(v: Views) -> DataFrame:
    """Rows whose tags allow them: not of a refused kind, with a contact and a sign of scale."""
    tags = F.from_json("props", "map<string,string>")
    k = F.try_element_at(tags, F.lit("k")).cast("long")
    return v.table("events").select("event_id", ((k >= 30) & (F.col("user_id") % 3 != 0) & ((F.col("user_id") % 2 == 0) | (F.col("event_type") == "view"))).alias("admitted"))


_EXTRA_SQL = """html || '<meta name="description" content="  About  page ' || page_id || ' ">' || '<a href="mailto:Buying' || page_id || '%40firm' || page_id % 9 || '.de?subject=x">write</a><a href="tel:+49 30 ' || (100000 + page_id) || '">call</a><span data-cfemail="' || CASE WHEN page_id % 2 = 0 THEN '0a63646c654a6c6378672e6e6f' ELSE 'zz' END || '"></span>'
    || '<script type="application/ld+json">{"@graph": [{"contactPoint": {"email": "a' || page_id || '@firm.de", "x": [1]}}, {"telephone": "+4930' || (100000 + page_id) || '"}]}</script><p>Tel.: 030/55 66-' || (1000 + page_id) || ', sales (at) firm' || page_id || ' (dot) fr, 20240131, logo@2x.png</p><script type="application/ld+json">[{"a": {"Email": "mailto:second@firm.de"}}]</script>'
    || '<a class="x" href="/kontakt#top">Write <b>us</b></a><a href="next?page=2">2</a><a href="https://elsewhere.test/contact">Contact</a><a href="about.html">Who we are</a><a href="//www.elsewhere.test/x">B</a><a href="/list/page/3">more</a><a href="?p=4">›</a>'
    || '<a id=one href=''/contact-us?a=1&amp;b=2''>Single</a><a href=/impressum>Bare</a><a rel="next" href = next5>weiter</a><a href=''tel:+33 1 22 33 ' || (1000 + page_id) || '''>t</a><a href=mailto:bare' || page_id || '@firm.de>m</a>'
    || '<script type="application/ld+json">{"note": "say \\"email\\": \\"no@firm.de\\"", "EMAIL": ["x", {"email": "deep\\u0041' || page_id || '@firm.de"}], "Phone": "+49 30 \\u003123' || (1000 + page_id) || '"}</script><script type="application/ld+json">{"email": "broken@firm.de"</script>'
    || '<p>write to spoken' || page_id || ' at firm dot co dot uk or curly {at} firm.de, punkt [at] firm (punkt) de</p>'"""


def _rich_pages(v: Views) -> DataFrame:
    """The pages with more of what pages have: mail and call links, hidden addresses, structured data, links."""
    k, lit = F.col("page_id"), F.lit
    parts = [
        F.col("html"), lit('<meta name="description" content="  About  page '), k, lit(' ">'), lit('<a href="mailto:Buying'), k, lit("%40firm"), k % 9, lit('.de?subject=x">write</a><a href="tel:+49 30 '), 100000 + k, lit('">call</a><span data-cfemail="'),
        F.when(k % 2 == 0, "0a63646c654a6c6378672e6e6f").otherwise("zz"), lit('"></span><script type="application/ld+json">{"@graph": [{"contactPoint": {"email": "a'), k, lit('@firm.de", "x": [1]}}, {"telephone": "+4930'), 100000 + k, lit('"}]}</script><p>Tel.: 030/55 66-'), 1000 + k,
        lit(", sales (at) firm"), k, lit(' (dot) fr, 20240131, logo@2x.png</p><script type="application/ld+json">[{"a": {"Email": "mailto:second@firm.de"}}]</script>'),
        lit('<a class="x" href="/kontakt#top">Write <b>us</b></a><a href="next?page=2">2</a><a href="https://elsewhere.test/contact">Contact</a><a href="about.html">Who we are</a><a href="//www.elsewhere.test/x">B</a><a href="/list/page/3">more</a><a href="?p=4">›</a>'),
        lit("<a id=one href='/contact-us?a=1&amp;b=2'>Single</a><a href=/impressum>Bare</a><a rel=\"next\" href = next5>weiter</a><a href='tel:+33 1 22 33 "), 1000 + k, lit("'>t</a><a href=mailto:bare"), k, lit("@firm.de>m</a>"),
        lit('<script type="application/ld+json">{"note": "say \\"email\\": \\"no@firm.de\\"", "EMAIL": ["x", {"email": "deep\\u0041'), k, lit('@firm.de"}], "Phone": "+49 30 \\u003123'), 1000 + k, lit('"}</script><script type="application/ld+json">{"email": "broken@firm.de"</script>'),
        lit("<p>write to spoken"), k, lit(" at firm dot co dot uk or curly {at} firm.de, punkt [at] firm (punkt) de</p>"),
    ]
    return v.table("pages").select("page_id", "url", F.concat(*parts).alias("html"))


#: Values by a walk over the parsed JSON of each script.
_DATA_SQL = """coalesce((SELECT list(x.atom->>'$' ORDER BY k, x.id) FROM (SELECT unnest(regexp_extract_all(html, '(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>', 1)) j, generate_subscripts(regexp_extract_all(html, '(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>', 1), 1) k) u, json_tree(CASE WHEN json_valid(u.j) THEN u.j ELSE '{{}}' END) x WHERE x.type = 'VARCHAR' AND lower(x.key) IN ({}) AND (x.atom->>'$') <> ''), [])"""
_HEX_SQL = "CASE WHEN regexp_matches(c, '^[0-9a-fA-F]{6,}$') AND length(c) % 2 = 0 THEN array_to_string(list_transform(range(1, length(c) // 2), lambda i: chr(xor(CAST('0x' || substr(c, CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER), CAST('0x' || left(c, 2) AS INTEGER)))), '') END"
_PAGE_EMAILS_SQL = f"""list_sort(list_distinct(list_filter(list_transform(list_filter(flatten([
    list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?mailto:([^"''?\\s>]+)', 1), lambda e: url_decode(e)), list_transform(regexp_extract_all(html, '(?i)(?:data-cfemail=["'']|/cdn-cgi/l/email-protection#)([0-9a-f]+)', 1), lambda c: {_HEX_SQL}),
    list_transform({_DATA_SQL.format("'email'")}, lambda e: replace(e, 'mailto:', '')), {_EMAILS_SQL.replace('lower(s)', 'lower(plain)')}]), lambda e: e IS NOT NULL), lambda e: regexp_replace(lower(trim(e)), '^[.,;:]+|[.,;:]+$', '', 'g')),
    lambda e: regexp_matches(e, '^{t.EMAIL}$') AND NOT regexp_matches(e, '{t.NO_ADDRESS}') AND NOT regexp_matches(e, '{t.NO_ADDRESS_END}'))))"""
_PAGE_PHONES_SQL = f"""list_sort(list_distinct(list_filter(list_transform(flatten([regexp_extract_all(html, '(?i)href\\s*=\\s*"tel:([^"]*)', 1), regexp_extract_all(html, '(?i)href\\s*=\\s*''tel:([^'']*)', 1), regexp_extract_all(html, '(?i)href\\s*=\\s*tel:([^\\s>]*)', 1), {_DATA_SQL.format("'telephone', 'phone'")}, regexp_extract_all(plain, '{t.LABELLED_PHONE}', 1), regexp_extract_all(plain, '{t.WORLD_PHONE}', 1)]), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 8 AND 15 AND NOT regexp_matches(d, '^(19|20)[0-9]{{6,}}$'))))"""
_RICH_SQL = f"SELECT *, {_HTML_SQL} plain FROM (SELECT page_id, url, {_EXTRA_SQL} html FROM pages)"
_LABEL_OF_SQL = _entities_sql("trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")
_ANCHORS_SQL = f"""list_filter(list_transform(list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href[^>]*>.*?</a>'), lambda a: {{'h': {_TARGET_SQL}, 'l': {_LABEL_OF_SQL}}}), lambda x: NOT regexp_matches(x.h, '(?i)^(mailto:|tel:|javascript:|#)')),
    lambda x: {{'h': regexp_replace(CASE WHEN regexp_matches(x.h, '^[a-z]+://') THEN x.h WHEN starts_with(x.h, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || x.h WHEN starts_with(x.h, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || x.h ELSE rtrim(regexp_extract(url, '^([a-z]+://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || x.h END, '#.*$', ''), 'l': x.l}}),
    lambda x: {_HOST_SQL.replace('lower(url)', 'lower(x.h)')} IS NOT DISTINCT FROM {_HOST_SQL})"""


@query("page_emails", f"SELECT page_id, array_to_string({_PAGE_EMAILS_SQL}, ',') emails FROM ({_RICH_SQL})")
def page_emails(v: Views) -> DataFrame:
    """Addresses of a page from all the places where pages have them."""
    return _rich_pages(v).select("page_id", F.array_join(t.page_emails(F.col("html")), ",").alias("emails"))


@query("page_phones", f"SELECT page_id, array_to_string({_PAGE_PHONES_SQL}, ',') phones FROM ({_RICH_SQL})")
def page_phones(v: Views) -> DataFrame:
    return _rich_pages(v).select("page_id", F.array_join(t.page_phones(F.col("html")), ",").alias("phones"))


@query("page_meta", f"SELECT page_id, nullif(left(trim(regexp_replace(regexp_extract(regexp_extract(html, '(?is)(<meta\\s[^>]*(?:name=[\"'']description[\"'']|property=[\"'']og:description[\"''])[^>]*>)', 1), '(?is)content=[\"'']([^\"'']*)[\"'']', 1), '\\s+', ' ', 'g')), 400), '') description, array_to_string(list_sort(list_distinct(list_transform(list_filter(a, lambda x: regexp_matches(x.h, '{t.CONTACT_LINK}') OR regexp_matches(x.l, '{t.CONTACT_LINK}')), lambda x: x.h))), ' ') contacts FROM (SELECT *, {_ANCHORS_SQL} a FROM ({_RICH_SQL}))")
def page_meta(v: Views) -> DataFrame:
    """What a page says of itself, and its links to contacts on the same host."""
    return _rich_pages(v).select("page_id", t.meta_description(F.col("html")).alias("description"), F.array_join(t.contact_links(F.col("html"), F.col("url")), " ").alias("contacts"))


_PATH_SQL = "regexp_extract({}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("pagination_links", f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(a, lambda x: x.h <> url AND (regexp_matches(x.l, '{t.NEXT_LABEL}') OR ((regexp_replace({_PATH_SQL.format('x.h')}, '/$', '') = regexp_replace({_PATH_SQL.format('url')}, '/$', '') OR starts_with({_PATH_SQL.format('x.h')}, regexp_replace({_PATH_SQL.format('url')}, '/[^/]*$', '')))
    AND (regexp_matches(x.h, '{t.PAGE_NUMBER}') OR regexp_matches(x.l, '^([0-9]{{1,3}}|[A-Z])$'))))), lambda x: x.h))), ' ') pages FROM (SELECT *, {_ANCHORS_SQL} a FROM ({_RICH_SQL}))""")
def pagination_links(v: Views) -> DataFrame:
    """Links that go on with a page's list: labelled as next, numbered, or a letter, on the same host."""
    return _rich_pages(v).select("page_id", F.array_join(t.paging_links(F.col("html"), F.col("url")), " ").alias("pages"))


@query("jsonld_contacts", f"SELECT page_id, array_to_string({_DATA_SQL.format("'email'")}, ',') emails, array_to_string({_DATA_SQL.format("'telephone', 'phone'")}, ',') phones FROM ({_RICH_SQL})")
def jsonld_contacts(v: Views) -> DataFrame:
    """Contacts from structured data at any depth, of all its scripts."""
    h = F.col("html")
    return _rich_pages(v).select("page_id", F.array_join(t.data_values(h, "email"), ",").alias("emails"), F.array_join(t.data_values(h, "telephone", "phone"), ",").alias("phones"))


def _loose(text: str | None) -> str | None:
    """The first JSON value in a text that may have thoughts, fences and words around it."""
    import json
    import re

    s = re.sub(r"(?s)<think>.*?</think>", "", text or "")
    for start in (m.start() for m in re.finditer(r"[{\[]", s)):
        try:
            return json.dumps(json.JSONDecoder().raw_decode(s[start:])[0], sort_keys=True)
        except ValueError:
            continue
    return None


@query("loose_json")
def loose_json(v: Views) -> DataFrame:
    """JSON out of free text."""
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit("<think>{no}</think> ```json\n"), "props", F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("Here: "), "props", F.lit(" done {"))).when(k % 4 == 2, "no JSON").otherwise(F.col("props"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"event_id": b["event_id"], "value": b["raw"].map(_loose)})

    return v.table("events").select("event_id", raw.alias("raw")).mapInPandas(parse, "event_id long, value string")

"""Search, facets, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import search as s
from .registry import query
from .views import Views, sql

#: Industries that count as a known type; industries that do not buy goods, and the words that make up for it.
TYPED, NOT_BUYER, BUT = r"(?i)build|mach|auto", r"(?i)house", r"(?i)hold$"
QUALITY_SQL = """least(100, CASE WHEN email IS NOT NULL THEN CASE email_status WHEN 'role' THEN 35 WHEN 'domain' THEN 30 WHEN 'personal' THEN 28 WHEN 'freemail' THEN 20 ELSE 18 END ELSE 0 END
    + CASE WHEN phone IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN regexp_matches(industry, '(?i)build|mach|auto') THEN 15 ELSE 0 END
    + CASE WHEN n_codes > 0 THEN 5 ELSE 0 END + least(n_sources, 3) * 3 + CASE WHEN evidence THEN 6 ELSE 0 END)"""
HIDDEN_SQL = """CASE WHEN length(trim(name)) < 3 THEN 'bad_name' WHEN n_codes = 0 THEN 'no_commodity' WHEN regexp_matches(industry, '(?i)house') AND NOT regexp_matches(industry, '(?i)hold$') THEN 'not_a_buyer'
    WHEN email IS NULL AND phone IS NULL AND website IS NULL THEN 'unreachable' WHEN NOT (evidence OR confidence >= 60) THEN 'unverified' END"""
RATED_SQL = f"SELECT *, CAST({QUALITY_SQL} AS BIGINT) quality, {HIDDEN_SQL} hidden_reason FROM v_entity"


def rated(v: Views) -> DataFrame:
    """Entities with quality and hidden_reason."""
    c = F.col
    reachable = c("email").isNotNull() | c("phone").isNotNull() | c("website").isNotNull()
    return v.entity.withColumns({
        "quality": scoring.quality_score(c("email"), c("email_status"), c("phone"), c("website"), c("industry").rlike(TYPED), c("n_codes") > 0, c("n_sources"), c("evidence")),
        "hidden_reason": scoring.hidden_reason(c("name"), c("n_codes") > 0, c("industry"), NOT_BUYER, BUT, reachable, c("evidence") | (c("confidence") >= 60)),
    })


PARAMS = s.SearchParams(countries=("NATION_1", "NATION_2", "NATION_3", "NATION_6", "NATION_7"), industries=("BUILDING", "MACHINERY", "AUTOMOBILE"), has="any", min_quality=40)
_WHERE = """country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_6', 'NATION_7') AND industry IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
    AND (email IS NOT NULL OR phone IS NOT NULL OR website IS NOT NULL) AND quality >= 40 AND hidden_reason IS NULL"""


@query("search_entities", sql(f"""SELECT id, name, country, industry, quality, CASE WHEN quality >= 70 THEN 'HOT' WHEN quality >= 45 THEN 'WARM' ELSE 'COLD' END AS label, email IS NOT NULL has_email,
    row_number() OVER (ORDER BY quality DESC, id) AS rank FROM rated WHERE {_WHERE} ORDER BY quality DESC, id LIMIT 25""", rated=RATED_SQL))
def search_entities(v: Views) -> DataFrame:
    """The first page of a search by country, industry, contacts and quality."""
    found = s.search(rated(v), PARAMS)
    return found.select("id", "name", "country", "industry", "quality", scoring.label(F.col("quality"), "search").alias("label"), F.col("email").isNotNull().alias("has_email"), "rank")


@query("facet_country", sql("SELECT country, count(*) n FROM rated WHERE hidden_reason IS NULL GROUP BY 1 ORDER BY n DESC, country LIMIT 20", rated=RATED_SQL))
def facet_country(v: Views) -> DataFrame:
    return s.facet(rated(v).filter("hidden_reason is null"), "country", 20)


@query("facet_source", sql("SELECT source, count(*) n FROM rated GROUP BY 1", rated=RATED_SQL))
def facet_source(v: Views) -> DataFrame:
    return s.facet(rated(v), "source")


@query("contact_stats", sql("""SELECT count(*) total, count(*) FILTER (WHERE email IS NOT NULL) with_email, count(*) FILTER (WHERE phone IS NOT NULL) with_phone, count(*) FILTER (WHERE website IS NOT NULL) with_website,
    count(*) FILTER (WHERE hidden_reason IS NULL) visible, count(DISTINCT country) countries FROM rated""", rated=RATED_SQL))
def contact_stats(v: Views) -> DataFrame:
    return rated(v).agg(
        F.count("*").alias("total"), F.count("email").alias("with_email"), F.count("phone").alias("with_phone"), F.count("website").alias("with_website"),
        F.count_if(F.col("hidden_reason").isNull()).alias("visible"), F.count_distinct("country").alias("countries"),
    )


@query("masked_contacts", sql("""SELECT id, substr(email, 1, 1) || '***@' || split_part(email, '@', 2) email, CASE WHEN phone IS NULL THEN NULL ELSE substr(phone, 1, 4) || '****' || right(phone, 2) END phone,
    regexp_replace(website, '^(https?://[^/]+).*$', '\\1/***') website FROM v_entity"""))
def masked_contacts(v: Views) -> DataFrame:
    return v.entity.select("id", *[F.when(F.col(k).isNotNull(), s.mask_contact(F.col(k), k)).alias(k) for k in ("email", "phone", "website")])


@query("similar_entities", sql("""SELECT id, similar_id, similar_confidence, place FROM (SELECT a.id, b.id similar_id, b.confidence similar_confidence, row_number() OVER (PARTITION BY a.id ORDER BY b.confidence DESC, b.id) place
    FROM v_entity a JOIN v_entity b ON a.industry = b.industry AND a.id <> b.id) WHERE place <= 3"""))
def similar_entities(v: Views) -> DataFrame:
    return s.similar(v.entity).select("id", "similar_id", "similar_confidence", "place")


@query("preview_gated", sql("""SELECT id, rn AS rank, CASE WHEN rn <= 2 THEN name END name, rn > 2 blurred, country FROM (SELECT *, row_number() OVER (ORDER BY (email IS NOT NULL) DESC, confidence DESC, id) rn FROM v_entity) WHERE rn <= 6"""))
def preview_gated(v: Views) -> DataFrame:
    """A preview of six entities, of which only two show their names."""
    top = s.page(v.entity, [F.col("email").isNotNull().desc(), F.desc("confidence"), F.asc("id")], 1, 6)
    return top.select("id", "rank", F.when(F.col("rank") <= 2, F.col("name")).alias("name"), (F.col("rank") > 2).alias("blurred"), "country")


@query("recommend_unsaved", sql("""SELECT account, entity_id, place FROM (SELECT a.account, e.id entity_id, row_number() OVER (PARTITION BY a.account ORDER BY e.quality DESC, e.id) place
    FROM (SELECT DISTINCT account, account % 5 AS region FROM v_event) a JOIN rated e ON e.region = a.region AND e.hidden_reason IS NULL
    WHERE NOT EXISTS (SELECT 1 FROM v_saved x WHERE x.account = a.account AND x.entity_id = e.id)) WHERE place <= 5""", rated=RATED_SQL))
def recommend_unsaved(v: Views) -> DataFrame:
    """For each account the best entities of its region that it has not saved.

    An account needs at most five entities beyond those it has saved. So accounts
    are put into bands of like need, each twice the one below, and joined with as many
    of their region's best as their band needs: an account that has saved much makes
    no other one look at more. The best are found in two steps, first within 64
    parts of a region, so that no task sorts a whole region.
    """
    saved = v.saved.select("account", "entity_id")
    accounts = v.event.select("account", (F.col("account") % 5).alias("region")).distinct().join(saved.groupBy("account").agg(F.count("*").alias("n")), "account", "left")
    accounts = accounts.withColumn("band", F.ceil(F.log2(F.coalesce("n", F.lit(0)) + 5.0)).cast("int"))
    bands = F.broadcast(accounts.select("region", "band").distinct().withColumn("upto", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("band"))))  # a row for each region and doubling
    need = F.broadcast(accounts.groupBy("region").agg((F.coalesce(F.max("n"), F.lit(0)) + 5).alias("need")))  # a row for each region
    rows = rated(v).filter("hidden_reason is null").select("region", F.col("id").alias("entity_id"), "quality").join(need, "region")
    order = [F.desc("quality"), F.asc("entity_id")]
    part = rows.withColumn("part", F.pmod(F.xxhash64("entity_id"), F.lit(64)))
    few = part.withColumn("k", F.row_number().over(W.partitionBy("region", "part").orderBy(*order))).filter("k <= need")
    top = few.withColumn("k", F.row_number().over(W.partitionBy("region").orderBy(*order))).filter("k <= need").select("region", "entity_id", "quality", "k")
    top = top.join(bands, "region").filter("k <= upto").select("region", "band", "entity_id", "quality")
    pairs = accounts.select("account", "region", "band").join(top, ["region", "band"]).join(saved, ["account", "entity_id"], "left_anti")
    own = W.partitionBy("account").orderBy(*order)
    return pairs.withColumn("place", F.row_number().over(own).cast("long")).filter("place <= 5").select("account", "entity_id", "place")


CODES_SQL = "SELECT entity_id, list_sort(list(DISTINCT heading)) codes FROM v_shipment GROUP BY 1"


def entity_codes(v: Views) -> DataFrame:
    """The sorted headings that each entity ships."""
    return v.shipments("entity_id", "heading").groupBy("entity_id").agg(F.array_sort(F.collect_set("heading")).alias("codes"))


@query("filter_code", sql("SELECT id, name, array_to_string(codes, ',') codes FROM v_entity JOIN codes ON id = entity_id WHERE list_contains(codes, '0111')", codes=CODES_SQL))
def filter_code(v: Views) -> DataFrame:
    """Entities that ship under a heading."""
    with_codes = v.entity.join(entity_codes(v), F.col("id") == F.col("entity_id"))
    return with_codes.filter(s.conditions(s.SearchParams(code="0111", visible_only=False))).select("id", "name", F.array_join("codes", ",").alias("codes"))


@query("filter_in_list", sql("SELECT id, country FROM v_entity WHERE country IN ('NATION_2', 'NATION_3')"))
def filter_in_list(v: Views) -> DataFrame:
    return v.entity.filter(s.conditions(s.SearchParams(countries=("NATION_2", "NATION_3"), visible_only=False))).select("id", "country")


@query("filter_text", sql("SELECT id, name FROM v_entity WHERE lower(name) LIKE '%00001%'"))
def filter_text(v: Views) -> DataFrame:
    return v.entity.filter(s.conditions(s.SearchParams(text="00001", visible_only=False))).select("id", "name")


@query("filter_prefix", sql("SELECT code6, count(*) n FROM v_shipment WHERE code6 LIKE '03%' GROUP BY 1"))
def filter_prefix(v: Views) -> DataFrame:
    return v.shipments("code6").filter(F.col("code6").startswith("03")).groupBy("code6").agg(F.count("*").alias("n"))


@query("filter_recent", sql("SELECT flag, count(*) n, isum(value) AS value FROM v_shipment WHERE day >= DATE '2001-11-05' - 365 GROUP BY 1"))
def filter_recent(v: Views) -> DataFrame:
    return v.shipments("day", "flag", "value").filter("day >= date_sub(date'2001-11-05', 365)").groupBy("flag").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query("filter_visible", sql("SELECT coalesce(hidden_reason, '') reason, count(*) n FROM rated GROUP BY 1", rated=RATED_SQL))
def filter_visible(v: Views) -> DataFrame:
    return rated(v).groupBy(F.coalesce("hidden_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("has_flags", sql("SELECT id, email IS NOT NULL has_email, phone IS NOT NULL has_phone, website IS NOT NULL has_website FROM v_entity"))
def has_flags(v: Views) -> DataFrame:
    return v.entity.select("id", *[F.col(k).isNotNull().alias(f"has_{k}") for k in ("email", "phone", "website")])


@query("coalesce_json", sql("SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN 'own' END, json_extract_string(props, '$.k'), 'none') AS kind FROM v_event"))
def coalesce_json(v: Views) -> DataFrame:
    own = F.when(F.col("event_id") % 4 == 0, "own")
    return v.event.select("event_id", F.coalesce(own, F.get_json_object("props", "$.k"), F.lit("none")).alias("kind"))


#: Country codes of a few names, for display; names beyond the list stay as they are.
COUNTRY_CODES = {f"NATION_{k}": f"N{k:02d}" for k in range(13)}


@query("country_names", sql(f"SELECT id, coalesce(CASE country {' '.join(f"WHEN '{k}' THEN '{c}'" for k, c in COUNTRY_CODES.items())} END, country) country_code FROM v_entity"))
def country_names(v: Views) -> DataFrame:
    """Codes of countries, the name itself where there is none."""
    names = F.create_map(*[F.lit(x) for pair in COUNTRY_CODES.items() for x in pair])
    return v.entity.select("id", F.coalesce(names[F.col("country")], "country").alias("country_code"))


@query("sort_bool_first", sql("SELECT id, rn AS place FROM (SELECT id, row_number() OVER (ORDER BY (phone IS NOT NULL) DESC, updated DESC, id) rn FROM v_entity) WHERE rn <= 50"))
def sort_bool_first(v: Views) -> DataFrame:
    """The fifty most recent, those with a phone first."""
    return s.page(v.entity, [F.col("phone").isNotNull().desc(), F.desc("updated"), F.asc("id")], 1, 50).select("id", F.col("rank").alias("place"))


@query("same_chapter_first", sql("SELECT heading, n, rn AS place FROM (SELECT heading, n, row_number() OVER (ORDER BY (left(heading, 2) = '04') DESC, n DESC, heading) rn FROM (SELECT heading, count(*) n FROM v_shipment GROUP BY 1)) WHERE rn <= 30"))
def same_chapter_first(v: Views) -> DataFrame:
    """Headings by traffic, those of one chapter first."""
    counted = v.shipments("heading").groupBy("heading").agg(F.count("*").alias("n"))
    return s.page(counted, [F.col("heading").startswith("04").desc(), F.desc("n"), F.asc("heading")], 1, 30).select("heading", "n", F.col("rank").alias("place"))


@query("capped_rows", sql("SELECT account, event_id FROM (SELECT account, event_id, row_number() OVER (PARTITION BY account ORDER BY ts DESC, event_id DESC) rn FROM v_event WHERE event_type = 'error') WHERE rn <= 3"))
def capped_rows(v: Views) -> DataFrame:
    """The latest three alerts of each account, the cap of its plan."""
    latest = W.partitionBy("account").orderBy(F.desc("ts"), F.desc("event_id"))
    return v.event.filter("event_type = 'error'").withColumn("rn", F.row_number().over(latest)).filter("rn <= 3").select("account", "event_id")

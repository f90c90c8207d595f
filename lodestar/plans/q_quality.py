"""Quality, scores, purges, missions; merging, upserts, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import resolution as r
from ..sources.buckets import BucketedTable
from ..sources.storage import new_path
from .q_search import RATED_SQL, rated
from .registry import SQL, query
from .views import AS_OF, Views, sql


@query("quality_score", sql("SELECT id, quality FROM rated", rated=RATED_SQL))
def quality_score(v: Views) -> DataFrame:
    return rated(v).select("id", "quality")


@query("hidden_reason", sql("SELECT id, hidden_reason FROM rated", rated=RATED_SQL))
def hidden_reason(v: Views) -> DataFrame:
    return rated(v).select("id", "hidden_reason")


#: Parts of names that mark shells and dead companies (fixed values).
JUNK = ["nominee", "liquidat", "dormant", "000013"]
#: Industries that rows of one source may have (fixed values).
KEPT_CODES = ["1", "3", "5", "7", "9"]


_FIT_SQL = """CASE WHEN codes IS NULL THEN 50 WHEN len(list_intersect(codes, f6)) > 0 THEN 100 WHEN len(list_intersect(list_transform(codes, lambda x: left(x, 4)), list_transform(f6, lambda x: left(x, 4)))) > 0 THEN 75
    WHEN len(list_intersect(list_transform(codes, lambda x: left(x, 2)), list_transform(f6, lambda x: left(x, 2)))) > 0 THEN 50 ELSE 15 END"""
_CODES6 = "SELECT entity_id, list(DISTINCT code6) codes FROM v_shipment WHERE day >= DATE '2001-01-01' GROUP BY 1"
FOCUS = ["010305", "020411", "031107", "040201"]


def _codes6(v: Views) -> DataFrame:
    return v.shipments("entity_id", "day", "code6").filter("day >= date'2001-01-01'").groupBy("entity_id").agg(F.collect_set("code6").alias("codes"))


@query("product_fit", sql(f"SELECT id, CAST({_FIT_SQL} AS BIGINT) fit FROM (SELECT id, codes, {FOCUS} f6 FROM v_entity LEFT JOIN c ON id = entity_id)", c=_CODES6))
def product_fit(v: Views) -> DataFrame:
    """How well an entity's codes of this year fit a focus."""
    focus = F.array(*map(F.lit, FOCUS))
    return v.entity.join(_codes6(v), F.col("id") == F.col("entity_id"), "left").select("id", scoring.product_fit(F.col("codes"), focus).alias("fit"))


_YOY = SQL["buyer_12m_yoy"].split(" SELECT entity_id, n_12m", 1)[1]


@query("final_score", sql(f"""SELECT id, CAST(least(100, floor((30 * activity + 20 * growth + 25 * fit + 15 * reach + 10 * untapped + 50) / 100.0)) AS BIGINT) score FROM (
    SELECT id, least(100, coalesce(n_12m, 0) * 10) activity, CASE WHEN growth IS NULL THEN 50 ELSE least(100, greatest(0, 50 + CAST(floor(growth / 2.0) AS BIGINT))) END growth, {_FIT_SQL} fit, CASE WHEN email IS NOT NULL THEN 50 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 25 ELSE 0 END reach,
    CASE WHEN h.entity_id IS NULL THEN 100 ELSE 30 END untapped FROM (SELECT *, {FOCUS} f6 FROM v_entity) LEFT JOIN c ON id = c.entity_id LEFT JOIN y ON id = y.entity_id LEFT JOIN h ON id = h.entity_id)""",
    c=_CODES6, y=f"SELECT entity_id, n_12m{_YOY}", h="SELECT DISTINCT entity_id FROM v_shipment JOIN v_supplier USING (supplier_id) WHERE is_home AND day >= DATE '2001-06-01'"))
def final_score(v: Views) -> DataFrame:
    """The weighted score of an entity.

    The components are this library's: activity from the shipments of a year,
    growth from the year before, reach from contacts, untapped where no home
    supplier has delivered lately.
    """
    c = F.col
    # one pass over the shipments of two years gives all that is known of an entity
    day, year = c("day"), F.add_months(F.to_date(F.lit(AS_OF)), -12)
    two_years = v.shipments("entity_id", "supplier_id", "day", "value", "code6").filter((day >= F.add_months(F.to_date(F.lit(AS_OF)), -24)) & (day < AS_OF))
    home = v.supplier.filter("is_home").select("supplier_id", F.lit(True).alias("home"))
    known = two_years.join(home, "supplier_id", "left").groupBy("entity_id").agg(
        F.count_if(day >= year).alias("n_12m"), F.sum(F.when(day >= year, c("value"))).alias("late"), F.sum(F.when(day < year, c("value"))).alias("early"),
        F.collect_set(F.when(day >= "2001-01-01", c("code6"))).alias("all_codes"), F.max(c("home") & (day >= "2001-06-01")).alias("has_home"),
    )
    growth = F.when(c("early") > 0, F.floor((F.coalesce("late", F.lit(0)) - c("early")) * 100.0 / c("early") + 0.5))
    known = known.withColumns({"growth": growth, "codes": F.when(F.size("all_codes") > 0, c("all_codes")), "h_id": F.when(c("has_home"), c("entity_id"))})
    rows = v.entity.join(known, c("id") == c("entity_id"), "left")
    points = lambda col, n: F.when(c(col).isNotNull(), n).otherwise(0)
    return rows.select("id", scoring.final_score(
        F.least(F.lit(100), F.coalesce("n_12m", F.lit(0)) * 10), F.when(c("growth").isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), 50 + F.floor(c("growth") / 2)))),
        scoring.product_fit(c("codes"), F.array(*map(F.lit, FOCUS))), points("email", 50) + points("phone", 25) + points("website", 25), F.when(c("h_id").isNull(), 100).otherwise(30)).alias("score"))


_LABEL_SQL = ", ".join(
    f"CASE {' '.join(f"WHEN quality >= {least} THEN '{name}'" for least, name in steps[:-1])} ELSE '{steps[-1][1]}' END label_{scheme}" for scheme, steps in scoring.LABELS.items()
)


@query("score_labels", sql(f"SELECT id, {_LABEL_SQL} FROM rated", rated=RATED_SQL))
def score_labels(v: Views) -> DataFrame:
    """The label of a score under each of the four schemes."""
    return rated(v).select("id", *[scoring.label(F.col("quality"), k).alias(f"label_{k}") for k in scoring.LABELS])


@query("null_guessed_email", sql("SELECT id, CASE WHEN NOT (coalesce(email = 'info@' || regexp_replace(regexp_replace(website, '^https?://', ''), '^www\\.', ''), FALSE) AND NOT evidence) THEN email END email FROM e", e="SELECT id, evidence, website, CASE WHEN id % 4 = 1 THEN 'info@firm' || (id % 50) || '.example.com' ELSE email END email FROM v_entity"))
def null_guessed_email(v: Views) -> DataFrame:
    e = v.entity.withColumn("email", F.when(F.col("id") % 4 == 1, F.concat(F.lit("info@firm"), F.col("id") % 50, F.lit(".example.com"))).otherwise(F.col("email")))
    return e.select("id", scoring.without_invented_email(F.col("email"), F.col("website"), F.col("evidence")).alias("email"))


@query("mission_priority", sql(f"""SELECT heading, country, CAST(round(1000000 * (CASE WHEN heading < '0300' THEN 3 ELSE 1 END) * (CASE WHEN country < 'NATION_2' THEN 2.0 ELSE 1.0 END) / (1 + coalesce(n, 0) / 15.0) * CASE WHEN n IS NULL THEN 1.5 ELSE 1 END * CASE WHEN last_value = 0 THEN 0.4 ELSE 1 END) AS BIGINT) priority
    FROM (SELECT DISTINCT heading FROM v_taxonomy) CROSS JOIN (SELECT DISTINCT n_name country FROM nation) LEFT JOIN (SELECT heading, supplier_country country, count(*) n, max(day) last_day, arg_max(value % 7, lpad(CAST(day - DATE '1970-01-01' AS VARCHAR), 8, '0') || lpad(CAST(order_id AS VARCHAR), 12, '0') || lpad(CAST(line AS VARCHAR), 3, '0') || lpad(CAST(part_id AS VARCHAR), 12, '0') || lpad(CAST(value AS VARCHAR), 12, '0')) last_value
      FROM v_shipment JOIN v_supplier USING (supplier_id) WHERE day >= DATE '2001-06-01' GROUP BY 1, 2) x USING (heading, country) WHERE last_day IS NULL OR last_day < DATE '{AS_OF}' - 10"""))
def mission_priority(v: Views) -> DataFrame:
    """Pairs of product and country by how little is known of them, those done lately left out.

    Both sides of the matrix are configuration: headings and countries.
    """
    shipped = v.shipments("day", "supplier_id", "heading", "order_id", "line", "part_id", "value").filter("day >= date'2001-06-01'").join(v.supplier, "supplier_id").groupBy("heading", F.col("supplier_country").alias("country"))
    done = shipped.agg(F.count("*").alias("n"), F.max("day").alias("last_day"), F.max(F.struct("day", "order_id", "line", "part_id", "value"))["value"].alias("v")).withColumn("last_value", F.col("v") % 7)
    countries = F.array(*[F.lit(r[0]) for r in v.table("nation").select("n_name").distinct().collect()])  # 25 names, as settings are
    matrix = v.taxonomy.select("heading").distinct().select("heading", F.explode(countries).alias("country"))
    rows = matrix.join(done, ["heading", "country"], "left").filter(F.col("last_day").isNull() | (F.col("last_day") < F.date_sub(F.to_date(F.lit(AS_OF)), 10)))
    weight = F.when(F.col("heading") < "0300", 3.0).otherwise(1.0) * F.when(F.col("country") < "NATION_2", 2.0).otherwise(1.0)
    priority = weight / (1 + F.coalesce("n", F.lit(0)) / 15.0) * F.when(F.col("n").isNull(), 1.5).otherwise(1.0) * F.when(F.col("last_value") == 0, 0.4).otherwise(1.0)
    return rows.select("heading", "country", F.round(priority * 1000000).cast("long").alias("priority"))


@query("source_lifecycle", sql("""SELECT source, kept, fresh, runs, CASE WHEN kept = 0 AND runs = 1 THEN 'rejected' WHEN fresh = 0 AND runs > 1 THEN 'exhausted' ELSE 'active' END state FROM (
    SELECT source || '/' || country source, count(*) FILTER (WHERE confidence >= 60) kept, count(*) FILTER (WHERE confidence >= 85) fresh, max(n_sources) runs FROM v_entity GROUP BY 1)"""))
def source_lifecycle(v: Views) -> DataFrame:
    by = v.entity.groupBy(F.concat_ws("/", "source", "country").alias("source")).agg(F.count_if(F.col("confidence") >= 60).alias("kept"), F.count_if(F.col("confidence") >= 85).alias("fresh"), F.max("n_sources").alias("runs"))
    return by.withColumn("state", F.when((F.col("kept") == 0) & (F.col("runs") == 1), "rejected").when((F.col("fresh") == 0) & (F.col("runs") > 1), "exhausted").otherwise("active"))


@query("enrich_bump", sql("SELECT id, least(100, confidence + CASE WHEN website IS NOT NULL AND id % 7 = 0 THEN 5 ELSE 0 END + CASE WHEN email IS NOT NULL AND id % 5 = 1 THEN 12 ELSE 0 END + CASE WHEN phone IS NOT NULL AND id % 3 = 1 THEN 5 ELSE 0 END) confidence FROM v_entity"))
def enrich_bump(v: Views) -> DataFrame:
    """Confidence after contacts have been found."""
    k = F.col("id")
    found = lambda c, test, n: F.when(F.col(c).isNotNull() & test, n).otherwise(0)
    return v.entity.select("id", F.least(F.lit(100), F.col("confidence") + found("website", k % 7 == 0, 5) + found("email", k % 5 == 1, 12) + found("phone", k % 3 == 1, 5)).alias("confidence"))


@query("refresh_diff", sql("SELECT id, quality FROM (SELECT id, quality, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 4 = 0 THEN quality - 1 ELSE quality END stored FROM rated) WHERE quality IS DISTINCT FROM stored", rated=RATED_SQL))
def refresh_diff(v: Views) -> DataFrame:
    """Rows whose stored score differs from the computed one."""
    k = F.col("id")
    stored = F.when(k % 9 == 0, None).when(k % 4 == 0, F.col("quality") - 1).otherwise(F.col("quality"))
    return rated(v).filter(~F.col("quality").eqNullSafe(stored)).select("id", "quality")


@query("normalise_record", sql("SELECT c_custkey id, nullif(trim(regexp_replace('  ' || c_name || '   ' || CASE WHEN c_custkey % 3 = 0 THEN 'GmbH' ELSE '' END, '\\s+', ' ', 'g')), '') name, CASE WHEN c_custkey % 3 = 0 THEN 'medium' ELSE 'unknown' END size, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 100 AS BIGINT) END, 60) confidence FROM customer"))
def normalise_record(v: Views) -> DataFrame:
    """Clean names, sizes guessed from them, defaults."""
    k = F.col("c_custkey")
    raw = v.table("customer").select(k.alias("id"), F.concat(F.lit("  "), "c_name", F.lit("   "), F.when(k % 3 == 0, "GmbH").otherwise("")).alias("raw"), F.when(k % 4 != 0, k % 100).alias("given"))
    name = F.nullif(F.trim(F.regexp_replace("raw", r"\s+", " ")), F.lit(""))
    size = F.when(F.col("raw").rlike(r"(?i)\b(group|holding|global)\b"), "large").when(F.col("raw").rlike(r"(?i)\b(gmbh|ltd|sarl|llc)\b"), "medium").otherwise("unknown")
    return raw.select("id", name.alias("name"), size.alias("size"), F.coalesce("given", F.lit(60)).alias("confidence"))


@query("size_buckets", sql("SELECT id, CASE WHEN staff IS NULL THEN 'unknown' WHEN staff >= 250 THEN 'large' WHEN staff >= 50 THEN 'medium' WHEN staff >= 10 THEN 'small' ELSE 'micro' END size FROM (SELECT id, CASE WHEN id % 6 <> 0 THEN (id * 31) % 400 END staff FROM v_entity)"))
def size_buckets(v: Views) -> DataFrame:
    staff = F.when(F.col("id") % 6 != 0, (F.col("id") * 31) % 400)
    return v.entity.select("id", F.when(staff.isNull(), "unknown").when(staff >= 250, "large").when(staff >= 50, "medium").when(staff >= 10, "small").otherwise("micro").alias("size"))


@query("unique_check", sql("SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"))
def unique_check(v: Views) -> DataFrame:
    """Keys that break a uniqueness rule."""
    return v.table("lineitem").filter("l_linenumber is not null").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("tenant_scope", sql("SELECT entity_id, CAST(epoch_us(saved_at) AS BIGINT) saved_at FROM v_saved WHERE account = 7"))
def tenant_scope(v: Views) -> DataFrame:
    """Only what one account may see."""
    return v.saved.filter("account = 7").select("entity_id", F.unix_micros("saved_at").alias("saved_at"))


@query("admission_rules", sql("SELECT reason, count(*) n FROM (SELECT CASE WHEN balance < 0 THEN 'not_active' WHEN n_codes = 1 THEN 'sole_trader' WHEN confidence < 45 THEN 'bankrupt' WHEN region = 4 THEN 'out_of_area' ELSE 'admitted' END reason FROM v_entity) GROUP BY 1"))
def admission_rules(v: Views) -> DataFrame:
    c = F.col
    rules = [("not_active", c("balance") < 0), ("sole_trader", c("n_codes") == 1), ("bankrupt", c("confidence") < 45), ("out_of_area", c("region") == 4)]
    return v.entity.groupBy(F.coalesce(scoring.first_reason(rules), F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


# --- resolution: the same entities under several sources, with noise in their names
_RAW_SQL = """SELECT *, md5(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || '|' || lower(country)) hash FROM (
    SELECT id, name, country, email, phone, website, confidence, source, id * 4 seq, [CAST(n_codes AS VARCHAR)] codes FROM v_entity
    UNION ALL SELECT id, '  ' || upper(name) || ' ', country, CASE WHEN id % 2 = 0 THEN 'sales@x' || id || '.example.com' END, NULL, 'https://x' || id || '.example.com', 60 + id % 30, 'other', id * 4 + 1, ['90', CAST(n_codes AS VARCHAR)] FROM v_entity WHERE id % 2 = 0
    UNION ALL SELECT id, replace(name, '#', ' # '), country, 'info@y' || id || '.example.com', '+33' || (10000000 + id), NULL, 50 + id % 50, 'third', id * 4 + 2, ['91'] FROM v_entity WHERE id % 3 = 0
    UNION ALL SELECT id, name, country, 'new@z' || id || '.example.com', NULL, NULL, 77, source, id * 4 + 3, ['92'] FROM v_entity WHERE id % 5 = 0)"""


def raw_entities(v: Views) -> DataFrame:
    """Rows of several sources for the same entities, in order of arrival (seq), with their content hash."""
    k, text = F.col("id"), lambda x: F.col(x).cast("string")
    none = F.lit(None).cast("string")

    def row(n: int, name, email, phone, website, confidence, source, codes):
        return F.struct(name.alias("name"), F.col("country"), email.alias("email"), phone.alias("phone"), website.alias("website"), confidence.cast("long").alias("confidence"), source.alias("source"), (k * 4 + n).alias("seq"), codes.alias("codes"))

    c = F.col
    rows = [  # an entity's own row, and those of other sources that some entities have
        row(0, c("name"), c("email"), c("phone"), c("website"), c("confidence"), c("source"), F.array(text("n_codes"))),
        F.when(k % 2 == 0, row(1, F.concat(F.lit("  "), F.upper("name"), F.lit(" ")), F.concat(F.lit("sales@x"), k, F.lit(".example.com")), none, F.concat(F.lit("https://x"), k, F.lit(".example.com")), 60 + k % 30, F.lit("other"), F.array(F.lit("90"), text("n_codes")))),
        F.when(k % 3 == 0, row(2, F.replace("name", F.lit("#"), F.lit(" # ")), F.concat(F.lit("info@y"), k, F.lit(".example.com")), F.concat(F.lit("+33"), 10000000 + k), none, 50 + k % 50, F.lit("third"), F.array(F.lit("91")))),
        F.when(k % 5 == 0, row(3, c("name"), F.concat(F.lit("new@z"), k, F.lit(".example.com")), none, none, F.lit(77), c("source"), F.array(F.lit("92")))),
    ]
    return v.entity.select("id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("id", "r.*").withColumn("hash", r.content_hash(c("name"), c("country")))


_PURGE_SQL = f"""CASE WHEN regexp_matches(lower(name), '{'|'.join(JUNK)}') THEN 'junk_name' WHEN confidence < 55 AND email IS NULL AND phone IS NULL AND website IS NULL THEN 'bare' WHEN country IS NULL THEN 'no_country'
    WHEN source = 'third' AND id % 9 = 0 THEN 'wrong_class' WHEN source = 'other' AND codes[2] NOT IN ({', '.join(f"'{c}'" for c in KEPT_CODES)}) THEN 'off_topic' END"""


@query("purge_buckets", sql(f"SELECT coalesce(reason, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END) reason, count(*) n FROM (SELECT reason, row_number() OVER (PARTITION BY reason, hash ORDER BY seq DESC) rn FROM (SELECT *, {_PURGE_SQL} reason FROM raw)) GROUP BY 1", raw=_RAW_SQL))
def purge_buckets(v: Views) -> DataFrame:
    """Rows by the first rule that removes them; of what the other rules leave, the newest row of each content hash stays."""
    c = F.col
    return r.purge(raw_entities(v), [
        ("junk_name", F.lower("name").rlike("|".join(JUNK))), ("bare", (c("confidence") < 55) & c("email").isNull() & c("phone").isNull() & c("website").isNull()), ("no_country", c("country").isNull()),
        ("wrong_class", (c("source") == "third") & (c("id") % 9 == 0)), ("off_topic", (c("source") == "other") & ~F.get("codes", F.lit(1)).isin(KEPT_CODES)),
    ], "hash", "seq").groupBy("reason").agg(F.count("*").alias("n"))


@query("content_hash", sql("SELECT seq, hash FROM raw", raw=_RAW_SQL))
def content_hash(v: Views) -> DataFrame:
    return raw_entities(v).select("seq", "hash")


@query("dedup_latest", sql("SELECT hash, seq, source FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seq DESC, id DESC) rn FROM raw) WHERE rn = 1", raw=_RAW_SQL))
def dedup_latest(v: Views) -> DataFrame:
    return r.latest(raw_entities(v), ["hash"], [F.desc("seq"), F.desc("id")]).select("hash", "seq", "source")


@query("latest_per_pair", sql("SELECT account, event_type, event_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY account, event_type ORDER BY ts DESC, event_id DESC) rn FROM v_event) WHERE rn = 1"))
def latest_per_pair(v: Views) -> DataFrame:
    """The last event of each account and kind, as a maximum of rows: partial maxima before the shuffle."""
    last = v.event.groupBy("account", "event_type").agg(F.max(F.struct("ts", "event_id", "amount")).alias("m"))
    return last.select("account", "event_type", "m.event_id", "m.amount")


@query("merge_cross_source", sql("""SELECT hash, arg_min(name, seq) name, arg_min(email, seq) FILTER (WHERE email IS NOT NULL) email, arg_min(phone, seq) FILTER (WHERE phone IS NOT NULL) phone, arg_min(website, seq) FILTER (WHERE website IS NOT NULL) website,
    CAST(list_reduce(list(c ORDER BY seq), lambda a, x: least(100, greatest(a, x) + 5)) AS BIGINT) confidence, array_to_string(list_sort(list_distinct(flatten(list(codes)))), ',') codes, array_to_string(list_sort(list_distinct(list(source))), ',') sources
    FROM (SELECT hash, source, min(seq) seq, max(confidence) c, arg_min(name, seq) name, arg_min(email, seq) FILTER (WHERE email IS NOT NULL) email, arg_min(phone, seq) FILTER (WHERE phone IS NOT NULL) phone, arg_min(website, seq) FILTER (WHERE website IS NOT NULL) website, flatten(list(codes)) codes FROM raw GROUP BY 1, 2) GROUP BY 1""", raw=_RAW_SQL))
def merge_cross_source(v: Views) -> DataFrame:
    merged = r.merge_cross_source(raw_entities(v))
    return merged.withColumns({"codes": F.array_join("codes", ","), "sources": F.array_join("sources", ",")})


@query("merge_same_source", sql("""SELECT source, id, arg_min(email, seq) FILTER (WHERE email IS NOT NULL) email, arg_min(phone, seq) FILTER (WHERE phone IS NOT NULL) phone, arg_min(website, seq) FILTER (WHERE website IS NOT NULL) website,
    arg_max(name, seq) name, arg_max(country, seq) country, max(confidence) confidence FROM raw GROUP BY 1, 2""", raw=_RAW_SQL))
def merge_same_source(v: Views) -> DataFrame:
    return r.merge_same_source(raw_entities(v), ["source", "id"], ["email", "phone", "website"], ["name", "country"])


@query("provenance_merge", sql("SELECT hash, arg_min(email, seq) FILTER (WHERE email IS NOT NULL) email, arg_min(source, seq) FILTER (WHERE email IS NOT NULL) email_status, arg_min('page' || seq, seq) FILTER (WHERE email IS NOT NULL) email_url FROM raw GROUP BY 1", raw=_RAW_SQL))
def provenance_merge(v: Views) -> DataFrame:
    rows = raw_entities(v).select("hash", "seq", "email", F.col("source").alias("email_status"), F.concat(F.lit("page"), "seq").alias("email_url"))
    return r.merge_provenance(rows, "hash")


@query("insert_ignore", sql("SELECT account, kind, event_id FROM (SELECT account, event_type kind, event_id, row_number() OVER (PARTITION BY account, event_type ORDER BY ts, event_id) rn FROM v_event WHERE ts >= TIMESTAMP '2024-01-20') n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_event o WHERE o.ts < TIMESTAMP '2024-01-20' AND o.account = n.account AND o.event_type = n.kind)"))
def insert_ignore(v: Views) -> DataFrame:
    """New alerts whose key has not been written before."""
    rows = v.event.select("account", F.col("event_type").alias("kind"), "event_id", "ts")
    edge = F.expr("timestamp'2024-01-20 00:00:00'")
    return r.insert_ignore(rows.filter(F.col("ts") >= edge), rows.filter(F.col("ts") < edge), ["account", "kind"], [F.asc("ts"), F.asc("event_id")]).select("account", "kind", "event_id")


@query("stale_rows", sql("SELECT id FROM (SELECT id, arg_max(updated, id) updated, list(DISTINCT source) sources FROM (SELECT id, updated, source FROM v_entity UNION ALL SELECT id, updated, 'other' FROM v_entity WHERE id % 2 = 0) GROUP BY 1) WHERE updated < DATE '2001-11-05' - 200 AND sources = ['src3']"))
def stale_rows(v: Views) -> DataFrame:
    """Rows that a full refresh of one source did not touch and no other source has."""
    both = v.entity.select("id", "updated", "source").union(v.entity.filter("id % 2 = 0").select("id", "updated", F.lit("other")))
    by = both.groupBy("id").agg(F.max("updated").alias("updated"), F.collect_set("source").alias("sources"))
    return by.filter((F.col("updated") < F.date_sub(F.to_date(F.lit(AS_OF)), 200)) & (F.col("sources") == F.array(F.lit("src3")))).select("id")


@query("codes_union", sql("SELECT hash, array_to_string(list_sort(list_distinct(flatten(list(codes)))), ',') codes, array_to_string(list_sort(list_intersect(list_distinct(flatten(list(codes))), ['90', '91', '5', '6'])), ',') named FROM raw GROUP BY 1", raw=_RAW_SQL))
def codes_union(v: Views) -> DataFrame:
    """United codes of a key, and those of them that are named."""
    by = raw_entities(v).select("hash", F.explode("codes").alias("code")).groupBy("hash").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    named = F.array_sort(F.array_intersect("codes", F.array(*map(F.lit, ("90", "91", "5", "6")))))
    return by.select("hash", F.array_join("codes", ",").alias("codes"), F.array_join(named, ",").alias("named"))


@query("local_dedup", sql("SELECT seq, lname, country FROM (SELECT seq, lower(trim(name)) lname, country, row_number() OVER (PARTITION BY lower(trim(name)), country ORDER BY seq) rn FROM raw) WHERE rn = 1", raw=_RAW_SQL))
def local_dedup(v: Views) -> DataFrame:
    """The first row of each name and country."""
    rows = raw_entities(v).select("seq", F.lower(F.trim("name")).alias("lname"), "country")
    return rows.groupBy("lname", "country").agg(F.min("seq").alias("seq"))


@query("hash_probe_same_source", sql("SELECT seq, known_seq FROM (SELECT a.seq, b.seq known_seq, row_number() OVER (PARTITION BY a.seq ORDER BY (a.source = b.source) DESC, b.seq) rn FROM raw a JOIN raw b ON a.hash = b.hash AND b.seq % 4 = 0 WHERE a.seq % 4 <> 0) WHERE rn = 1", raw=_RAW_SQL))
def hash_probe_same_source(v: Views) -> DataFrame:
    """For each new row the known row of its hash, that of its own source first.

    Known rows are reduced to the first of each hash and source and to the first
    of each hash, so a crowded hash joins once and not with all its rows.
    """
    rows = raw_entities(v).select("seq", "hash", "source")
    known = rows.filter("seq % 4 = 0")
    same = known.groupBy("hash", "source").agg(F.min("seq").alias("same_seq"))
    any_ = known.groupBy("hash").agg(F.min("seq").alias("any_seq"))
    return rows.filter("seq % 4 <> 0").join(any_, "hash").join(same, ["hash", "source"], "left").select("seq", F.coalesce("same_seq", "any_seq").alias("known_seq"))


@query("upsert_batch", sql("""SELECT action, count(*) n FROM (SELECT CASE WHEN rn > 1 THEN 'duplicate' WHEN known IS NULL THEN 'insert' WHEN list_contains(known, source) THEN 'update' ELSE 'merge' END action
    FROM (SELECT *, row_number() OVER (PARTITION BY hash, source ORDER BY seq) rn FROM raw WHERE seq % 4 <> 0 OR id % 7 = 0) n LEFT JOIN (SELECT hash, list(DISTINCT source) known FROM raw WHERE seq % 4 = 0 AND id % 7 <> 0 GROUP BY 1) k USING (hash)) GROUP BY 1""", raw=_RAW_SQL))
def upsert_batch(v: Views) -> DataFrame:
    """What a batch does to the table, by action."""
    rows = raw_entities(v)
    return r.upsert_status(rows.filter("seq % 4 <> 0 or id % 7 = 0"), rows.filter("seq % 4 = 0 and id % 7 <> 0"), "hash").groupBy("action").agg(F.count("*").alias("n"))


_FIELDS = ("name", "email", "phone", "website")


UPSERT_SQL = sql(f"""SELECT s.hash, {', '.join(f'coalesce(s.{f}, m.{f}) {f}' for f in _FIELDS)}, CAST(list_reduce(list_prepend(s.confidence, list_transform(coalesce(steps, []), lambda z: CASE WHEN z.s = s.source THEN z.c ELSE z.c + 1000 END)), lambda a, x: CASE WHEN x < 1000 THEN greatest(a, x) ELSE least(100, greatest(a, x - 1000) + 5) END) AS BIGINT) confidence,
    array_to_string(list_sort(list_distinct(list_concat(s.codes, coalesce(m.codes, [])))), ',') codes, array_to_string(list_sort(list_distinct(list_prepend(s.source, coalesce(m.sources, [])))), ',') sources
    FROM (SELECT * FROM raw WHERE seq % 4 = 0 AND id % 11 <> 0) s LEFT JOIN (SELECT hash, {', '.join(f'arg_min({f}, seq) FILTER (WHERE {f} IS NOT NULL) {f}' for f in _FIELDS)}, list({{'s': source, 'c': c}} ORDER BY seq) steps, flatten(list(codes)) codes, list(source) sources
      FROM (SELECT hash, source, min(seq) seq, max(confidence) c, {', '.join(f'arg_min({f}, seq) FILTER (WHERE {f} IS NOT NULL) {f}' for f in _FIELDS)}, flatten(list(codes)) codes FROM raw WHERE seq % 4 <> 0 AND id % 11 <> 0 GROUP BY 1, 2) GROUP BY 1) m USING (hash)""", raw=_RAW_SQL)


@query("upsert_table", UPSERT_SQL)
def upsert_table(v: Views) -> DataFrame:
    """The table that a batch leaves: rows that were stored, with those of the batch merged into them, and new ones."""
    rows = raw_entities(v).filter("id % 11 <> 0")
    stored = r.merge_cross_source(rows.filter("seq % 4 = 0"))
    path = new_path(v.spark, "table")
    r.write_table(stored, path)
    r.write_table(r.upsert(v.spark.read.parquet(r.current(v.spark, path)), rows.filter("seq % 4 <> 0")), path)
    merged = v.spark.read.parquet(r.current(v.spark, path))
    return merged.select("hash", "name", "email", "phone", "website", "confidence", F.array_join("codes", ",").alias("codes"), F.array_join("sources", ",").alias("sources"))


@query("refresh_buckets", UPSERT_SQL)
def refresh_buckets(v: Views) -> DataFrame:
    """The same from a table in buckets, of which a batch rewrites only its own."""
    rows = raw_entities(v).filter("id % 11 <> 0")
    held = BucketedTable(v.spark, new_path(v.spark, "buckets"), "hash", 32)
    held.create(r.merge_cross_source(rows.filter("seq % 4 = 0")))
    held.refresh(rows.filter("seq % 4 <> 0"), lambda stored, batch: r.upsert(stored, batch))
    return held.read().select("hash", "name", "email", "phone", "website", "confidence", F.array_join("codes", ",").alias("codes"), F.array_join("sources", ",").alias("sources"))


@query("shipment_append", sql("SELECT order_id, line, entity_id, value FROM v_shipment WHERE entity_id % 4 <> 0 GROUP BY ALL"))
def shipment_append(v: Views) -> DataFrame:
    """Shipments of a batch added to those that are stored: known ones are left out, as are those of entities that are gone."""
    rows = v.shipments("order_id", "line", "entity_id", "value", "day").drop("day").distinct()
    key = ["order_id", "line", "entity_id", "value"]
    stored, batch = rows.filter("entity_id % 4 = 1"), rows.filter("entity_id % 4 <> 0 or order_id % 2 = 0")
    known = v.entity.filter("id % 4 <> 0").select(F.col("id").alias("entity_id"))
    return r.append_children(stored, batch, key, known, "entity_id").select(*key)


@query("cascade_delete", sql("SELECT event_id, account FROM v_event WHERE account NOT IN (SELECT id FROM v_entity WHERE balance < 0)"))
def cascade_delete(v: Views) -> DataFrame:
    """The children that stay when some accounts go."""
    gone = v.entity.filter("balance < 0").select(F.col("id").alias("account"))
    return v.event.join(gone, "account", "left_anti").select("event_id", "account")

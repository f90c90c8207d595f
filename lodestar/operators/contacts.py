"""Contacts: the best address of a site, hosts that are no company's, labels by prefix, categories by keyword."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import FREEMAIL, email_kind, email_status, email_usable, host, name_on_page, name_tokens, norm, quote_on_page, registrable


def usable_addresses(candidates: DataFrame) -> DataFrame:
    """The candidates (email, site_host, ...) that may be a contact of their site, with `address` and `same`.

    An address must be usable, and of the site's own registered domain or of a
    free mail host; without a site any domain is.
    """
    address = F.lower(F.trim("email"))
    domain = F.substring_index(address, "@", -1)
    same = F.coalesce(registrable(domain) == registrable(host(F.col("site_host"))), F.lit(False))
    rows = candidates.filter(email_usable(F.col("email"))).withColumns({"address": address, "same": same})
    return rows.filter(F.col("site_host").isNull() | F.col("same") | domain.isin(FREEMAIL))


def best_addresses(candidates: DataFrame, key: str) -> DataFrame:
    """(key, email, status, source_url): the best address of each key.

    Of the own domain first, then by the rank of its role, then the first in
    order. A minimum of rows: tasks keep one candidate of a key each.
    """
    rank = F.struct(~F.col("same"), email_kind(F.col("address"))["rank"].alias("rank"), "address", "source_url")
    best = usable_addresses(candidates).groupBy(key).agg(F.min(rank).alias("m"))
    return best.select(key, F.col("m.address").alias("email"), email_status(F.col("m.address")).alias("status"), "m.source_url")


def without_hosts(rows: DataFrame, url: str, blocked: DataFrame) -> DataFrame:
    """Rows whose URL is not on a blocked host or one of its subdomains; rows without a host stay.

    `blocked` has `host`. Each suffix of a URL's host at a dot is looked up, so
    the list is joined by equality, whatever its size.
    """
    labels = F.split(host(F.col(url)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(host(F.col(url)).alias("__host"), F.explode(suffixes).alias("host")).distinct()
    found = hosts.join(blocked.select("host").distinct(), "host", "left_semi").select("__host").distinct()
    return rows.withColumn("__host", host(F.col(url))).join(found, "__host", "left_anti").drop("__host")


def prefix_labels(rows: DataFrame, code: str, labels: DataFrame) -> DataFrame:
    """`rows` with `label`: that of the longest prefix of the code in `labels` (prefix, label), null if none fits."""
    codes = rows.select(F.col(code).alias("__code")).filter("`__code` is not null").distinct()
    tried = codes.select("__code", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__code"), F.lit(1))), lambda n: F.substring(F.col("__code"), F.lit(1), n))).alias("prefix"))
    best = tried.join(labels, "prefix").groupBy("__code").agg(F.max_by("label", F.length("prefix")).alias("label"))
    return rows.join(best, rows[code] == best["__code"], "left").drop("__code")


def keyword_categories(rows: DataFrame, text: str, keywords: DataFrame, default: str) -> DataFrame:
    """`rows` with `category`: that of the first of `keywords` (place, keyword, category) whose words stand in the text, else `default`.

    Keywords are settings, a few hundred at most, and become one expression.
    """
    known = [(r["keyword"], r["category"]) for r in keywords.orderBy("place", "keyword").collect()]
    first = lambda n: F.coalesce(*[F.when(F.contains(n, norm(F.lit(k))), c) for k, c in known], F.lit(default))
    return rows.withColumn("category", F.get(F.transform(F.array(norm(F.col(text))), first), F.lit(0)))


def fits_name(name: str, trade: DataFrame, commodity: DataFrame, specific: DataFrame, strong: Column) -> Column:
    """Whether a name has a word of the trade and of a commodity, and either a specific commodity or another strong sign; word lists are settings with `word`."""
    words = lambda df: "|".join(sorted(r[0] for r in df.select("word").distinct().collect()))
    n = F.lower(name)
    return n.rlike(words(trade)) & n.rlike(words(commodity)) & (n.rlike(words(specific)) | strong)


#: Kinds of buyers that may be saved, and those that surely trade (fixed values).
TRADING = ["importer", "distributor", "wholesaler", "trader", "roaster", "processor"]


def verify(candidates: DataFrame, country: str, kinds: list[str], home_end: str, origin: str, imports: str, keywords: list[str]) -> DataFrame:
    """`candidates` with reason (null if accepted), email, phone and confidence.

    A candidate has name, country, kind, site, quote, email, phone, and what was
    read: evidence (text of the page of its quote, null if that was not opened),
    site_text (null without pages of its site), seen_emails, seen_phones (digits)
    of all pages. `origin` and `imports` are patterns of words of home exporters
    and of buyers, `keywords` of the product. Contacts that no page shows are
    dropped for ones that its site shows; the first reason that holds counts.
    """
    c, none = F.col, F.lit(None).cast("string")
    evidence, site_text = norm(c("evidence")), norm(c("site_text"))
    own = F.coalesce("site_text", "evidence")
    both = F.concat_ws(" ", "evidence", "site_text")
    named = name_on_page(c("name"), evidence) | (c("site_text").isNotNull() & name_on_page(c("name"), site_text))
    fits = reduce(or_, [F.contains(norm(both), F.trim(norm(F.lit(k)))) for k in keywords])
    buys = both.rlike(imports)
    site = host(c("site"))
    reason = F.coalesce(
        F.when(F.length(F.trim(F.coalesce("name", F.lit("")))) < 2, "no_name"), F.when(F.upper(F.coalesce("country", F.lit(country))) != country, "other_country"),
        F.when(~F.coalesce(F.replace(F.lower(F.trim("kind")), F.lit(" "), F.lit("_")).isin(kinds), F.lit(False)), "unknown_kind"), F.when(c("evidence").isNull(), "evidence_not_opened"),
        F.when(~F.coalesce(quote_on_page(c("quote"), evidence), F.lit(False)), "quote_not_found"), F.when(F.coalesce(site.endswith(home_end), F.lit(False)), "home_site"), F.when(~F.coalesce(named, F.lit(False)), "name_not_found"),
        F.when(F.substring(own, 1, 4000).rlike(origin) & ~own.rlike(imports), "home_exporter"), F.when(~fits & ~buys, "no_sign_of_buying"),
    )
    asked = F.lower(F.trim("email"))
    of_site = F.array_min(F.filter("seen_emails", lambda e: F.substring_index(e, "@", -1).endswith(site)))
    email = F.coalesce(F.when(F.array_contains("seen_emails", asked), asked), F.when(site.isNotNull(), of_site), none)
    digits = F.regexp_replace("phone", "[^0-9]", "")
    phone = F.coalesce(F.when(F.array_contains("seen_phones", digits), digits), F.when(c("site_text").isNotNull(), F.get("seen_phones", F.lit(0))), none)
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    trust = 55 + points(c("site_text").isNotNull(), 10) + points(email.isNotNull(), 8) + points(phone.isNotNull(), 4) + points(buys, 8) + points(fits, 7) + points(F.lower(F.trim("kind")).isin(TRADING), 3)
    rows = candidates.withColumns({"__reason": reason, "__email": email, "__phone": phone, "confidence": F.least(F.lit(92), trust)})
    kept = F.col("__reason").isNull()
    return rows.withColumns({"reason": c("__reason"), "email": F.when(kept, c("__email")), "phone": F.when(kept, c("__phone")), "confidence": F.when(kept, c("confidence"))}).drop("__reason", "__email", "__phone")


def harvest(proposed: DataFrame, home: str, allowed: list[str]) -> DataFrame:
    """Rows that a list's text is said to name, with `outcome` (kept, dropped_name, dropped_country, repeated), contacts that the page shows, and confidence.

    A row has page, place, name, country (a code), email, phone, site, and the
    page's text. The first row of a name and country of a page counts.
    """
    page = norm(F.col("text"))
    squeezed, digits = F.lower(F.regexp_replace("text", r"\s+", " ")), F.regexp_replace("text", "[^0-9]", "")
    outcome = F.when(~name_on_page(F.col("name"), page), "dropped_name").when(F.col("country").isNull() | (F.col("country") == home) | ~F.col("country").isin(allowed), "dropped_country")
    email, number, name = F.lower(F.trim("email")), F.regexp_replace("phone", "[^0-9]", ""), host(F.col("site"))
    rows = proposed.filter(F.length(F.trim("name")) >= 3).withColumns({
        "__out": outcome, "email": F.when(F.contains(squeezed, email), email), "phone": F.when((number != "") & F.contains(digits, number), number),
        "site": F.when(F.contains(squeezed, name), F.concat(F.lit("https://"), name)),
    }).drop("text")
    key = ["page", F.lower(F.trim("name")), "country", F.col("__out").isNull()]
    first = F.row_number().over(W.partitionBy(*key).orderBy("place"))
    points = lambda col, n: F.when(F.col(col).isNotNull(), n).otherwise(0)
    trust = 58 + points("email", 8) + points("phone", 4) + points("site", 4)
    judged = rows.withColumn("outcome", F.coalesce("__out", F.when(first > 1, "repeated").otherwise("kept"))).drop("__out")
    return judged.withColumn("confidence", F.when(F.col("outcome") == "kept", trust))


def best_hosts(hits: DataFrame, most: int = 3) -> DataFrame:
    """The best hosts of each search: `hits` has search, name, url and title.

    A long word of the name that the host has counts three, one that the title
    has counts one; of equal hosts the last by name comes first. Each host once.
    """
    tokens = F.filter(name_tokens(F.col("name")), lambda w: F.length(w) >= 4)
    count = lambda field: F.size(F.filter(tokens, lambda w: F.contains(field, w)))
    score = (3 * count(F.replace(host(F.col("url")), F.lit("-"), F.lit(""))) + count(F.lower(F.coalesce("title", F.lit(""))))).cast("long")
    once = hits.select("search", host(F.col("url")).alias("host"), score.alias("score")).filter("host is not null").groupBy("search", "host").agg(F.max("score").alias("score"))
    rank = W.partitionBy("search").orderBy(F.desc("score"), F.desc("host"))
    return once.withColumn("place", F.row_number().over(rank).cast("long")).filter(F.col("place") <= most)

"""Entity search: filters from parameters, sort modes, pages, facets, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchParams:
    """What a search asks for; an empty value asks for nothing."""

    code: str = ""
    countries: Sequence[str] = ()
    industries: Sequence[str] = ()
    text: str = ""
    has: str = ""  # email, phone, website or any
    min_quality: int = 0
    visible_only: bool = True
    sort: str = "quality"
    page: int = 1
    per_page: int = 25


def conditions(p: SearchParams) -> Column:
    """The conjunction of all that is asked for, over the columns of an entity relation."""
    contacts = {"email": F.col("email").isNotNull(), "phone": F.col("phone").isNotNull(), "website": F.col("website").isNotNull()}
    contacts["any"] = contacts["email"] | contacts["phone"] | contacts["website"]
    out: list[Column] = []
    if p.code:
        out.append(F.array_contains("codes", p.code))
    if p.countries:
        out.append(F.col("country").isin(*p.countries))
    if p.industries:
        out.append(F.col("industry").isin(*p.industries))
    if p.text:
        out.append(F.lower("name").contains(p.text.lower()))
    if p.has:
        out.append(contacts[p.has])
    if p.min_quality:
        out.append(F.col("quality") >= p.min_quality)
    if p.visible_only:
        out.append(F.col("hidden_reason").isNull())
    return reduce(lambda a, b: a & b, out, F.lit(True))


#: Sort modes; each ends with the id, so that pages are stable.
SORTS = {
    "quality": [F.desc_nulls_last, "quality"], "name": [F.asc_nulls_last, "name"], "recent": [F.desc_nulls_last, "updated"],
}


def order(mode: str) -> list[Column]:
    how, column = SORTS[mode]
    return [how(column), F.asc("id")]


def page(found: DataFrame, sort: Sequence[Column], number: int, per_page: int) -> DataFrame:
    """One page of the sorted rows with `rank`, the place in the whole order.

    Only the rows up to the page's end are sorted together.
    """
    begin = (number - 1) * per_page
    top = found.orderBy(*sort).limit(begin + per_page)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*sort)).cast("long")).filter(F.col("rank") > begin)


def search(entities: DataFrame, p: SearchParams) -> DataFrame:
    return page(entities.filter(conditions(p)), order(p.sort), p.page, p.per_page)


def facet(rows: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """How many rows have each value, the most frequent first."""
    out = rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(by))
    return out.limit(top) if top else out


def mask_contact(value: Column, kind: str) -> Column:
    """A contact with its middle hidden: the local part of an address, the inner digits of a phone, the path of a URL."""
    if kind == "email":
        local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        return F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)
    if kind == "phone":
        return F.when(F.length(value) > 6, F.concat(F.substring(value, 1, 4), F.lit("****"), F.substring(value, -2, 2))).otherwise(F.lit("****"))
    return F.regexp_replace(value, r"^(https?://[^/]+).*$", "$1/***")


def similar(entities: DataFrame, n: int = 3) -> DataFrame:
    """For each entity the n most trusted others of its industry.

    The best n + 1 of an industry are all that any member can need, so the join
    is with n + 1 rows for each industry, not of an industry with itself.
    """
    best = W.partitionBy("industry").orderBy(F.desc("confidence"), F.asc("id"))
    top = entities.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= n + 1)
    other = top.select("industry", F.col("id").alias("similar_id"), F.col("confidence").alias("similar_confidence"))
    own = W.partitionBy("id").orderBy(F.desc("similar_confidence"), F.asc("similar_id"))
    pairs = entities.select("id", "industry").join(other, "industry").filter("id <> similar_id")
    return pairs.withColumn("place", F.row_number().over(own).cast("long")).filter(F.col("place") <= n)

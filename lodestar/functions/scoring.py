"""Scores, labels and reasons of entities, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points for an e-mail address by its status; any other status gets OTHER_EMAIL (fixed values).
EMAIL_POINTS = {"role": 35, "domain": 30, "personal": 28, "freemail": 20}
OTHER_EMAIL = 18
#: Thresholds and names of the label schemes, highest first; the last name is for the rest (fixed values).
LABELS = {
    "list": ((80, "Hot"), (60, "Warm"), (40, "Cold"), (None, "Low")),
    "search": ((70, "HOT"), (45, "WARM"), (None, "COLD")),
    "profile": ((80, "HOT"), (60, "WARM"), (None, "FRESH")),
    "advice": ((70, "strong"), (45, "fair"), (None, "weak")),
}


def quality_score(email: Column, status: Column, phone: Column, website: Column, typed: Column, has_codes: Column, n_sources: Column, evidence: Column) -> Column:
    """0 to 100: contacts, type, codes, sources and evidence."""
    by_status = F.lit(OTHER_EMAIL)
    for name, points in EMAIL_POINTS.items():
        by_status = F.when(status == name, points).otherwise(by_status)
    flag = lambda c, points: F.when(c, points).otherwise(0)
    total = flag(email.isNotNull(), by_status) + flag(phone.isNotNull(), 15) + flag(website.isNotNull(), 15) + flag(typed, 15) + flag(has_codes, 5) + F.least(n_sources, F.lit(3)) * 3 + flag(evidence, 6)
    return F.least(F.lit(100), total).cast("long")


def hidden_reason(name: Column, has_codes: Column, description: Column, not_buyer: str, but: str, reachable: Column, verified: Column) -> Column:
    """Why an entity is not shown, the first rule that fits; null if it is shown."""
    return (
        F.when(F.length(F.trim(name)) < 3, "bad_name").when(~has_codes, "no_commodity")
        .when(description.rlike(not_buyer) & ~description.rlike(but), "not_a_buyer").when(~reachable, "unreachable").when(~verified, "unverified")
    )


def label(score: Column, scheme: str) -> Column:
    """The name of a score under one of the schemes."""
    steps = LABELS[scheme]
    out = F.lit(steps[-1][1])
    for least, name in reversed(steps[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def product_fit(codes: Column, focus: Column) -> Column:
    """50 without codes or focus; else 100, 75, 50 or 15 for the longest common prefix of 6, 4, 2 digits or none."""
    cut = lambda a, n: F.transform(a, lambda c: F.substring(c, 1, n))
    shares = lambda n: F.arrays_overlap(cut(codes, n), cut(focus, n))
    unknown = F.coalesce(F.size(codes) <= 0, F.lit(True)) | F.coalesce(F.size(focus) <= 0, F.lit(True))
    return F.when(unknown, 50).when(shares(6), 100).when(shares(4), 75).when(shares(2), 50).otherwise(15).cast("long")


def final_score(activity: Column, growth: Column, fit: Column, reach: Column, untapped: Column) -> Column:
    """Weighted sum of the components, at most 100; half a point rounds up."""
    total = activity * 30 + F.coalesce(growth, F.lit(50)) * 20 + fit * 25 + reach * 15 + untapped * 10
    return F.least(F.lit(100), F.floor((total + 50) / 100)).cast("long")


def without_invented_email(email: Column, website: Column, verified: Column) -> Column:
    """The e-mail, but null where it only repeats the website's host behind `info@` and nothing verified it."""
    host = F.regexp_replace(F.regexp_replace(website, r"^https?://", ""), r"^www\.", "")
    return F.when(~(F.coalesce(email == F.concat(F.lit("info@"), host), F.lit(False)) & ~verified), email)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(list(rules)):
        out = F.when(rule, name).otherwise(out)
    return out

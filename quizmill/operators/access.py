"""Who may see and do what: tiers, gates, ownership, checkout mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gates and what opens them: fixed values
GATES = {"set_50": "pro", "set_100": "pro", "set_150": "pro", "exam_mode": "pro", "adaptive": "pro", "dashboard": "pro", "sync": "signed_in", "weak_weight": "pro", "tutor": "pro"}


def active(tier: Column, valid_until: Column, as_of: Column) -> Column:
    return F.coalesce((tier == "free") | valid_until.isNull() | (valid_until > as_of), F.lit(False))


def in_scope(tier: Column, scope: Column, slug: Column) -> Column:
    """The client's rule, which leaves the term out."""
    return F.coalesce(F.when(tier == "all_access", True).when(tier != "pro", False).otherwise(scope == slug), F.lit(False))


def covers(tier: Column, scope: Column, is_active: Column, slug: Column) -> Column:
    """The server's rule: an inactive tier covers nothing; one of unknown activity counts."""
    return F.coalesce(is_active, F.lit(True)) & in_scope(tier, scope, slug)


def is_pro(tier: Column, scope: Column, is_active: Column, slug: Column) -> Column:
    return covers(tier, scope, is_active, slug)


def paid_elsewhere(tier: Column, scope: Column, is_active: Column, slug: Column) -> Column:
    return F.coalesce(is_active, F.lit(True)) & F.coalesce(tier != "free", F.lit(False)) & ~covers(tier, scope, is_active, slug)


def can(feature: Column, pro: Column, signed_in: Column) -> Column:
    """Whether a feature is open; unknown ones are not."""
    rule = F.try_element_at(F.create_map(*(F.lit(x) for kv in GATES.items() for x in kv)), feature)
    return F.coalesce(F.when(rule == "pro", pro).when(rule == "signed_in", signed_in), F.lit(False))


def tier_record(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Each profile's tier as JSON."""
    rec = F.struct("tier", "tier_app", F.date_format("valid_until", "yyyy-MM-dd'T'HH:mm:ss").alias("tier_valid_until"), active(F.col("tier"), F.col("valid_until"), as_of).alias("is_active"))
    return profiles.select("id", F.to_json(rec, {"ignoreNullFields": "false"}).alias("record"))


def owned_books(purchases: DataFrame, user: str = "customer") -> DataFrame:
    """The slugs that each user owns as a JSON array in order of purchase."""
    return purchases.groupBy(user).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "slug"))), lambda x: x["slug"])).alias("books"))


def may_download(requests: DataFrame, purchases: DataFrame, *keys: str) -> DataFrame:
    """``allowed``: whether a purchase by these keys exists."""
    own = purchases.select(*keys).distinct().withColumn("_own", F.lit(True))
    return requests.join(own, list(keys), "left").withColumn("allowed", F.col("_own").isNotNull()).drop("_own")


def checkout(rows: DataFrame) -> DataFrame:
    """Mode and customer of a checkout. rows: recurring, customer, email."""
    known = F.col("customer").isNotNull()
    return rows.withColumn("mode", F.when(F.col("recurring"), "subscription").otherwise("payment")).withColumn("use_customer", F.col("customer")).withColumn("use_email", F.when(~known, F.col("email")))

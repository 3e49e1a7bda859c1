"""Purchases and subscriptions: tiers, grants, prices, discounts, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_CENTS = 999
PAYING, ENDED = ("active", "trialing"), ("canceled", "unpaid")


def latest(events: DataFrame, key: str, time: str, *columns: str, tie: str = "id") -> DataFrame:
    """Last write wins: each key's row of the latest event."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time, tie)).alias("_x")).select(key, *(F.col(f"_x.{c}").alias(c) for c in columns))


def set_tiers(profiles: DataFrame, events: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """Profiles after the events; ``changed`` says whose. Events of unknown customers change nothing."""
    new = latest(events, key, time, *columns).select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    hit = F.col("_k").isNotNull()
    out = profiles.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*(F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in profiles.columns), hit.alias("changed"))


def linked(requests: DataFrame, users: DataFrame) -> DataFrame:
    """(email, customer) requests with the id of the first user of that e-mail, or null."""
    first = users.groupBy(F.col("email").alias("_e")).agg(F.min("id").alias("user_id"))
    return requests.join(first, F.col("email") == F.col("_e"), "left").drop("_e")


def granted(purchases: DataFrame, time: str = "created_at", tie: str = "line") -> DataFrame:
    """One row per (customer, slug): the first grant, with the first session that isn't null. Replays change nothing."""
    order = F.struct(time, "session", tie, "amount")
    return purchases.groupBy("customer", "slug").agg(F.min_by("amount", order).alias("amount"), F.min_by(F.col("session"), F.when(F.col("session").isNotNull(), order)).alias("session"), F.min(time).alias(time), F.count("*").alias("events"))


def rejected(purchases: DataFrame, users: DataFrame) -> DataFrame:
    """Purchases of customers that nobody is linked to."""
    return purchases.join(users.select(F.col("customer").alias("_c")).distinct(), F.col("customer") == F.col("_c"), "left_anti")


def replayed(purchases: DataFrame, time: str = "created_at", tie: str = "line") -> DataFrame:
    """``replay``: whether the same (session, slug) came before; rows without a session never are."""
    nth = F.row_number().over(Window.partitionBy("session", "slug").orderBy(time, tie))
    return purchases.withColumn("replay", F.col("session").isNotNull() & (nth > 1))


def profile_update(profiles: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    columns = [c for c in changes.columns if c != "id"]
    n = changes.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = profiles.join(n, F.col("id") == F.col("_id"), "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in profiles.columns), F.when(F.col("_id").isNotNull(), as_of).alias("updated_at"))


def display_name(meta: Column, email: Column) -> Column:
    return F.coalesce(F.get_json_object(meta, "$.display_name"), F.split_part(email, F.lit("@"), F.lit(1)))


def price_plan(apps: DataFrame) -> DataFrame:
    """The prices to be set up: a Pro price per live app, one for all, a book price per shipped book.

    apps: slug, status, book_price (null without a book)."""
    key = F.translate("slug", "-", "_")
    cents = F.floor(F.col("book_price") * 100 + 0.5).cast("long")
    pro = apps.where("status = 'live'").select(F.concat(F.lit("pro_"), key).alias("lookup_key"), F.lit(799).cast("long").alias("cents"), F.lit(True).alias("recurring"))
    whole = apps.sparkSession.range(1).select(F.lit("all_access").alias("lookup_key"), F.lit(1499).cast("long").alias("cents"), F.lit(True).alias("recurring"))
    books = apps.where("status in ('live', 'free') and book_price is not null").select(F.concat(F.lit("ebook_"), key).alias("lookup_key"), cents.alias("cents"), F.lit(False).alias("recurring"))
    return pro.unionByName(whole).unionByName(books)


def drift_map(want: Column, got: Column) -> Column:
    """Entries that are wanted and are not there with that value."""
    return F.map_filter(want, lambda k, v: ~F.try_element_at(got, k).eqNullSafe(v))


def price_drift(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """State of each planned price: missing, metadata, price or ok, in this precedence."""
    e = existing.select(F.col("lookup_key").alias("_k"), F.col("cents").alias("_cents"), F.col("metadata").alias("_metadata"))
    out = planned.join(e, F.col("lookup_key") == F.col("_k"), "left")
    drift = F.size(drift_map(F.col("metadata"), F.coalesce("_metadata", F.create_map().cast("map<string,string>")))) > 0
    return out.select("lookup_key", F.when(F.col("_k").isNull(), "missing").when(drift, "metadata").when(F.col("cents") != F.col("_cents"), "price").otherwise("ok").alias("state"))


def merged_metadata(product: Column, price: Column) -> Column:
    """The price's entries win."""
    empty = F.create_map().cast("map<string,string>")
    product, price = F.coalesce(product, empty), F.coalesce(price, empty)
    return F.map_concat(F.map_filter(product, lambda k, _: ~F.map_contains_key(price, k)), price)


def entitlement(metadata: Column) -> tuple[Column, Column]:
    """(tier, app) that the metadata names; both null when it names none for sure."""
    tier, app = F.try_element_at(metadata, F.lit("tier")), F.try_element_at(metadata, F.lit("app"))
    sure = (tier == "all_access") | ((tier == "pro") & (F.coalesce(app, F.lit("")) != ""))
    return F.when(sure, tier), F.when(sure & (tier == "pro"), app)


def resolved(prices: DataFrame, overrides: DataFrame) -> DataFrame:
    """(price, tier, app) by override, else by metadata. overrides: price, tier, app."""
    tier, app = entitlement(merged_metadata(F.col("product_metadata"), F.col("price_metadata")))
    o = overrides.select(F.col("price").alias("_p"), F.col("tier").alias("_t"), F.col("app").alias("_a"))
    return prices.join(o, F.col("price") == F.col("_p"), "left").select("price", F.when(F.col("_p").isNotNull(), F.col("_t")).otherwise(tier).alias("tier"), F.when(F.col("_p").isNotNull(), F.col("_a")).otherwise(app).alias("app"))


def lifecycle(events: DataFrame) -> DataFrame:
    """What each subscription event does: action (set, free, none), tier, app, valid_until.

    events: status, tier, app (as resolved), period_end in epoch seconds."""
    status = F.col("status")
    action = F.when(status.isin(*ENDED), "free").when(status.isin(*PAYING) & F.col("tier").isNotNull(), "set").otherwise("none")
    out = events.withColumn("action", action)
    return out.select("id", "action", F.when(F.col("action") == "free", "free").when(F.col("action") == "set", F.col("tier")).alias("tier"), F.when(F.col("action") == "set", F.col("app")).alias("app"), F.when(F.col("action") != "none", F.timestamp_seconds("period_end")).alias("valid_until"))


def checkout_totals(lines: DataFrame) -> DataFrame:
    """Per session: slugs granted and cents, a line without an amount at the default price."""
    return lines.groupBy("session").agg(F.array_sort(F.collect_set("slug")).alias("slugs"), F.sum(F.coalesce("amount", F.lit(DEFAULT_CENTS))).alias("cents"))


def line_slug(price_meta: Column, product_meta: Column) -> Column:
    return F.coalesce(F.try_element_at(price_meta, F.lit("ebook")), F.try_element_at(product_meta, F.lit("ebook")))


def discount(ebooks: Column) -> tuple[Column, Column]:
    """(what it is for, percent off) by the number of books."""
    return F.when(ebooks >= 3, "all_access").when(ebooks >= 1, "pro"), F.when(ebooks >= 3, 20).when(ebooks >= 1, 10).otherwise(0).cast("long")


def missing_events(rows: DataFrame) -> DataFrame:
    """``missing`` and ``all``: events wanted and not enabled, and the union; ``*`` enables all. rows: wanted, enabled."""
    every = F.array_contains("enabled", "*")
    miss = F.when(every, F.array().cast("array<string>")).otherwise(F.array_except("wanted", "enabled"))
    return rows.withColumn("missing", miss).withColumn("all", F.when(every, F.col("enabled")).otherwise(F.array_union("enabled", "wanted")))


def notice(kind: Column, name: Column, what: Column, cents: Column) -> Column:
    """The text of a notice by kind of event."""
    return (
        F.when(kind == "subscription", F.concat(F.lit("Subscription: "), F.coalesce(name, F.lit("someone")), F.lit(" -> "), F.coalesce(what, F.lit("?"))))
        .when(kind == "ebook_purchase", F.concat(F.lit("Books: "), F.coalesce(what, F.lit("?")), F.lit(" for "), (F.coalesce(cents, F.lit(0)) / 100.0).cast("decimal(20,2)").cast("string")))
        .when(kind == "signup", F.concat(F.lit("New account: "), F.coalesce(name, F.lit("someone"))))
        .otherwise(F.concat(F.lit("Event: "), kind))
    )


def shelf(owned: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Owned slugs with their titles; an unknown slug is its own title."""
    c = catalogue.select(F.col("slug").alias("_s"), "title")
    return owned.join(c, F.col("slug") == F.col("_s"), "left").withColumn("title", F.coalesce("title", F.col("slug").cast("string"))).drop("_s")


def backfilled(local: DataFrame, server: DataFrame, key: str = "user_id") -> DataFrame:
    """Local rows of users of whom the server has none."""
    return local.join(server.select(key).distinct(), key, "left_anti")

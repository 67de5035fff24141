"""Users and their prediction history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.operators.ranking import top_per_group
from acreage.operators.snapshot import Snapshot

RECENT = 50
PRIVATE = ("password",)


def normalise_keys(df: DataFrame) -> DataFrame:
    """Trimmed names, trimmed lower-case e-mail, and null for a blank full name."""
    rules = {
        "username": F.trim("username") if "username" in df.columns else None,
        "email": F.lower(F.trim("email")) if "email" in df.columns else None,
        "full_name": F.nullif(F.trim("full_name"), F.lit("")) if "full_name" in df.columns else None,
    }
    return df.withColumns({c: rule for c, rule in rules.items() if rule is not None})


def key_conflicts(new: DataFrame, existing: DataFrame, keys: Sequence[str] = ("email", "username")) -> DataFrame:
    """Registrations whose e-mail or username is taken, by a user or by another row of the batch."""
    new, existing = normalise_keys(new), normalise_keys(existing)
    found = None
    for key in keys:
        taken = new.join(existing.select(key).distinct(), key, "left_semi").select(
            "id", F.lit(key).alias("field"), F.lit("existing").alias("conflict"))
        repeated = new.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(key)
        inside = new.join(repeated, key, "left_semi").select(
            "id", F.lit(key).alias("field"), F.lit("batch").alias("conflict"))
        part = taken.unionByName(inside)
        found = part if found is None else found.unionByName(part)
    return found


def user_counts(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total_users"), F.count_if("is_active").alias("active_users")).withColumn(
        "inactive_users", F.col("total_users") - F.col("active_users"))


def user_prediction_stats(history: DataFrame) -> DataFrame:
    """Predictions of each user: how many, mean price and the last date."""
    return history.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("total_predictions"), F.avg("predicted_price").alias("avg_price"),
        F.max("created_at").alias("last_prediction"))


def recent_predictions(history: DataFrame, n: int = RECENT) -> DataFrame:
    """The latest ``n`` predictions of every user, newest first."""
    return top_per_group(history.filter(F.col("user_id").isNotNull()), ["user_id"],
                         [F.desc("created_at"), F.desc("id")], n)


def apply_changes(users: DataFrame, changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The user table after create, update and delete events.

    Each field takes its latest given value; a field an event leaves null is not changed. A delete
    switches ``is_active`` off and keeps the row. The latest values are aggregated, not windowed,
    so a user with very many events does not fill one task.
    """
    fields = [c for c in users.columns if c != key]
    given: dict[str, Column] = {c: F.col(c) if c in changes.columns else F.lit(None) for c in fields}
    given["is_active"] = F.when(F.col("op") == "delete", False).when(
        F.col("op") == "create", True).otherwise(given["is_active"].cast("boolean"))
    events = changes.select(key, order, *[given[c].cast(users.schema[c].dataType).alias(c) for c in fields])
    latest = events.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}") for c in fields])
    merged = users.join(latest, key, "full_outer")
    return merged.select(key, *[F.coalesce(f"_new_{c}", F.col(c)).alias(c) for c in fields])


def update_users(table: Snapshot, changes: DataFrame, number: int | None = None, order: str = "seq") -> int:
    """:func:`apply_changes` on a stored user table: only the buckets of users with changes are read and written. Batches come in the order of their events."""
    return table.apply(changes, lambda users, events: apply_changes(users, events, table.key, order), number)


def public_users(users: DataFrame, private: Sequence[str] = PRIVATE) -> DataFrame:
    """The listing shown to others: everything but the secrets."""
    return users.select(*[c for c in users.columns if c not in private])


def status_label(users: DataFrame) -> DataFrame:
    """Badges and labels of the user table."""
    badge = lambda test: F.when(test, "active").otherwise("inactive")
    return users.withColumns({
        "shown_name": F.coalesce(F.nullif(F.col("full_name"), F.lit("")), F.lit("-")),
        "role_badge": badge(F.col("role") == "admin"),
        "status_badge": badge(F.col("is_active")),
        "status": F.when(F.col("is_active"), "Active").otherwise("Inactive"),
    })

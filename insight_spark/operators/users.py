"""Profiles, plans, entitlements and usage quotas as joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import named, normalised_email


def is_listed(email: Column, overrides: Collection[str]) -> Column:
    """Whether an email is on a short configured list."""
    names = sorted({e.strip().lower() for e in overrides if e.strip()})
    return F.coalesce(normalised_email(email).isin(names), F.lit(False)) if names else F.lit(False)


def profile_lookup(
    requests: DataFrame, profiles: DataFrame, email: str = "email", overrides: Collection[str] = ()
) -> DataFrame:
    """Each request with the premium flag and plan of its user; unknown users are on the free plan.

    A lookup must find exactly one profile, so an email stored twice counts as unknown. An email in
    `overrides` is premium whatever the profiles say, also without one.
    """
    flags = (
        profiles.select(normalised_email(named(email)).alias("__email"), F.col("is_premium").alias("__premium"))
        .groupBy("__email")
        .agg(F.max("__premium").alias("__premium"), F.count(F.lit(1)).alias("__n"))
    )
    looked_up = requests.withColumn("__key", normalised_email(named(email))).join(
        flags, F.col("__key") == F.col("__email"), "left"
    )
    premium = is_listed(named(email), overrides) | F.coalesce((F.col("__n") == 1) & F.col("__premium"), F.lit(False))
    return (
        looked_up.withColumn("is_premium", premium)
        .withColumn("plan", plan_name(F.col("is_premium")))
        .drop("__key", "__email", "__premium", "__n")
    )


def plan_name(is_premium: Column) -> Column:
    return F.when(is_premium, "premium").otherwise("free")


def premium_status(profiles: DataFrame, overrides: Collection[str], email: str = "email") -> DataFrame:
    """Effective plan: premium by override list (a short configured list) or by stored flag."""
    effective = is_listed(named(email), overrides) | F.coalesce(F.col("is_premium"), F.lit(False))
    return profiles.withColumn("effective_premium", effective).withColumn(
        "plan", plan_name(F.col("effective_premium"))
    )


def feature_entitlements(
    requests: DataFrame, features: Mapping[str, bool] = fixed.PREMIUM_FEATURES
) -> DataFrame:
    """Whether each request (feature, is_premium) is allowed. Unlisted features are open to all."""
    premium_only = sorted(name for name, only in features.items() if only)
    needs_plan = F.col("feature").isin(premium_only) if premium_only else F.lit(False)
    return requests.withColumn(
        "enabled", ~F.coalesce(needs_plan, F.lit(False)) | F.coalesce(F.col("is_premium"), F.lit(False))
    )


def usage_quota(
    runs: DataFrame,
    user: str = "user_id",
    order_by: tuple[str, ...] = ("ts", "event_id"),
    limit: int = fixed.FREE_ANALYSIS_LIMIT,
) -> DataFrame:
    """For each analysis request whether it is allowed, and the reason if not.

    A request (with `is_premium` and optionally `succeeded`) is allowed for premium users and
    while fewer than `limit` earlier requests of the user succeeded. Only the `limit` earliest
    successes per user matter: they are found with a top-k filter that runs before the shuffle,
    so a very active user is never gathered in one task. The cut-off is then joined back.
    """
    order = F.struct(*[named(c) for c in order_by])
    counted = runs.where(F.col("succeeded")) if "succeeded" in runs.columns else runs
    earliest = (
        counted.select(named(user).alias("__user"), *[named(c) for c in order_by])
        .withColumn("__rank", F.row_number().over(W.partitionBy("__user").orderBy(*[named(c) for c in order_by])))
        .where(F.col("__rank") <= limit)
    )
    cutoff = earliest.where(F.col("__rank") == limit).select("__user", order.alias("__last_free"))
    over = F.col("__last_free").isNotNull() & (order > F.col("__last_free"))
    allowed = F.coalesce(F.col("is_premium"), F.lit(False)) | ~over
    return (
        runs.join(cutoff, named(user) == F.col("__user"), "left")
        .withColumn("allowed", allowed)
        .withColumn(
            "reason",
            F.when(F.col("allowed"), "").otherwise(
                f"Free analysis limit reached ({limit}). Upgrade to continue."
            ),
        )
        .drop("__user", "__last_free")
    )


def usage_summary(
    runs: DataFrame, user: str = "user_id", limit: int = fixed.FREE_ANALYSIS_LIMIT, users: DataFrame | None = None
) -> DataFrame:
    """Per user: used, shown as used (capped), remaining, percent used (cut off).

    `users` names everyone to report on, so that those without a run are there with zero.
    """
    capped = F.least(F.col("used"), F.lit(limit))
    used = runs.groupBy(named(user)).agg(F.count(F.lit(1)).alias("used"))
    if users is not None:
        everyone = users.select(named(user)).distinct()
        used = everyone.join(used, user, "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("bigint"))
    return (
        used
        .withColumn("used_capped", capped)
        .withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used")))
        .withColumn("percent_used", (F.col("used_capped").cast("double") / max(limit, 1) * 100).cast("int"))
    )


def latest_sign_ins(sign_ins: DataFrame) -> DataFrame:
    """One row per email from (email, id, ts): the last time, and the last id that was given."""
    given = F.col("id").isNotNull() & (F.col("id") != "")
    return (
        sign_ins.withColumn("__email", normalised_email(F.col("email")))
        .where(F.col("__email") != "")
        .groupBy("__email")
        .agg(
            F.max("ts").alias("__ts"),
            F.max(F.when(given, F.struct("ts", "id")))["id"].alias("__id"),
        )
    )


def profile_upsert(profiles: DataFrame, sign_ins: DataFrame) -> DataFrame:
    """Profiles (email, id, is_premium, updated_at) after a batch of sign-ins (email, id, ts).

    Known emails get the new time, and the new id if one was given; unknown ones are added
    without premium. Result is the next version of the profile table.
    """
    return _merged(profiles, sign_ins).drop("__seen")


def _merged(profiles: DataFrame, sign_ins: DataFrame) -> DataFrame:
    merged = profiles.join(latest_sign_ins(sign_ins), F.col("email") == F.col("__email"), "full")
    return merged.select(
        F.coalesce("email", "__email").alias("email"),
        F.coalesce("__id", "id").alias("id"),
        F.when(F.col("email").isNull(), F.lit(False)).otherwise(F.col("is_premium")).alias("is_premium"),
        F.coalesce("__ts", "updated_at").alias("updated_at"),
        F.col("__email").isNotNull().alias("__seen"),
    )


def premium_activate(profiles: DataFrame, activations: DataFrame) -> DataFrame:
    """Like `profile_upsert`, then premium is on for every email in the batch."""
    merged = _merged(profiles, activations)
    return merged.withColumn("is_premium", F.col("__seen") | F.col("is_premium")).drop("__seen")

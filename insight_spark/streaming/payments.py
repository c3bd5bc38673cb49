"""Payment events as a stream: parse, keep completed checkouts, activate premium profiles.

Each micro-batch is reduced to the newest event per email and stored under its batch id and the id
of the stream's progress, so a replayed batch overwrites its own output and a stream that lost its
progress does not overwrite an older one's. Profiles are merged with the stored activations when
read: the cost of a batch depends on the batch, not on the size of the profile table. From time to
time `folded` makes the activations part of the next profile version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery

from insight_spark.functions.scalars import normalised_email

# Event type and event layout.
COMPLETED = "checkout.session.completed"
EVENT_SCHEMA = (
    "type string, data struct<object: struct<id: string, customer: string, customer_email: string,"
    " customer_details: struct<email: string>, metadata: struct<email: string>>>"
)
ACTIVATION_COLUMNS = ("email", "event_time", "event_id", "customer_id", "session_id")


def event_email(session: Column) -> Column:
    """First non-empty of the three places an email can be in, trimmed and lower-cased."""
    places = [session["customer_details"]["email"], session["customer_email"], session["metadata"]["email"]]
    return normalised_email(F.coalesce(*[F.when(p != "", p) for p in places]))


def parse_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Completed checkouts from (event_time, event_id, payload JSON); works on batches and streams."""
    event = F.from_json(F.col(payload), EVENT_SCHEMA)
    return (
        events.select("event_time", "event_id", event.alias("event"))
        .where(F.col("event.type") == COMPLETED)
        .select(
            "event_time",
            "event_id",
            event_email(F.col("event.data.object")).alias("email"),
            F.col("event.data.object.customer").alias("customer_id"),
            F.col("event.data.object.id").alias("session_id"),
        )
    )


def with_email(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.coalesce(F.col("email"), F.lit("")) != "")


def newest_per_email(parsed: DataFrame) -> DataFrame:
    """The last event of each email by (event_time, event_id); partial aggregation absorbs hot emails."""
    newest = F.max(F.struct("event_time", "event_id", "customer_id", "session_id")).alias("newest")
    return with_email(parsed).groupBy("email").agg(newest).select("email", "newest.*")


def store_parsed(parsed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append parsed events to a table."""
    return (
        parsed.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def progress_id(spark: SparkSession, checkpoint: str) -> str:
    """An id kept inside the progress folder: a new one if that folder is new."""
    own = f"{checkpoint.rstrip('/')}/insight_id"
    try:
        return spark.read.text(own).first()[0]
    except AnalysisException:
        spark.range(1).select(F.lit(uuid.uuid4().hex)).coalesce(1).write.mode("overwrite").text(own)
        return spark.read.text(own).first()[0]


def store_activations(parsed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the newest activation per email of every micro-batch under its progress and batch id."""
    progress = progress_id(parsed.sparkSession, checkpoint)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        newest_per_email(batch).write.mode("overwrite").parquet(f"{path}/progress={progress}/batch_id={batch_id}")

    return (
        parsed.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def activated_profiles(profiles: DataFrame, activations: DataFrame) -> DataFrame:
    """Profiles (email, is_premium, ...) with premium on for activated emails.

    Emails without a profile are not added. The newest activation wins across batches. A payment
    counts only for a profile that was there: where profiles have `created_at`, the event must not be
    older. Where they have `premium_changed_at`, only later events count, so a flag that was reset
    after a payment stays reset. Both are compared with `event_time` as they are.
    """
    latest = newest_per_email(activations)
    latest = latest.select(
        F.col("email").alias("__email"),
        F.col("event_time").alias("__time"),
        F.col("customer_id").alias("__customer"),
        F.col("session_id").alias("__session"),
    )
    hit = F.col("__email").isNotNull()
    if "created_at" in profiles.columns:
        hit = hit & F.coalesce(F.col("__time") >= F.col("created_at"), F.lit(True))
    if "premium_changed_at" in profiles.columns:
        hit = hit & F.coalesce(F.col("__time") > F.col("premium_changed_at"), F.lit(True))
    joined = profiles.join(latest, F.col("email") == F.col("__email"), "left").withColumn("__hit", hit)
    hit = F.col("__hit")
    kept = {c: F.col(c) if c in profiles.columns else F.lit(None).cast("string") for c in ("stripe_customer_id", "stripe_checkout_session_id")}
    return (
        joined.withColumn("is_premium", hit | F.coalesce(F.col("is_premium"), F.lit(False)))
        .withColumn("stripe_customer_id", F.when(hit, F.col("__customer")).otherwise(kept["stripe_customer_id"]))
        .withColumn(
            "stripe_checkout_session_id",
            F.when(hit, F.col("__session")).otherwise(kept["stripe_checkout_session_id"]),
        )
        .drop("__email", "__customer", "__session", "__hit", "__time")
    )


def folded(profiles: DataFrame, activations: DataFrame) -> DataFrame:
    """The next profile version: activations applied, and `premium_changed_at` set to the newest event
    time taken in, so that the same activations change nothing any more."""
    newest = newest_per_email(activations).select(F.col("email").alias("__taken"), F.col("event_time").alias("__at"))
    before = F.col("premium_changed_at") if "premium_changed_at" in profiles.columns else F.lit(None)
    applied = activated_profiles(profiles, activations)
    joined = applied.join(newest, F.col("email") == F.col("__taken"), "left")
    return joined.withColumn("premium_changed_at", F.greatest(before, "__at")).drop("__taken", "__at")

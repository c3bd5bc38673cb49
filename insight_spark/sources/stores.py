"""Report, share and snapshot records, and the tables they are appended to.

A store is a folder of versions, each partitioned by the first digit of the user key: 16 partitions
however many users there are. Rows are range-partitioned by key and record id before writing, so one
very active user is spread over several files, files hold neighbouring keys, and the key statistics
of each file let a read for one user skip the others. Appends go to the newest version and leave out
records it has; compaction and erasure write the next version, which counts from the moment it is
whole, and remove the older ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import content_id, named, normalised_email, user_key, utc_stamp
from insight_spark.operators.profile import profile
from insight_spark.operators.quality import score_of_profile

KEY_PREFIX = "key_prefix"
REPORT_FIELDS = ("file_name", "analysis", "translation", "answer", "doctor")
SHARE_FIELDS = ("file_name", "analysis", "translation", "doctor")
LOCAL_USER = "local_user"


def _text_fields(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [
        (F.coalesce(named(n), F.lit("")) if n in df.columns else F.lit("")).alias(n) for n in names
    ]


def report_records(reports: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Report records from (email, file_name, analysis[, translation, answer, doctor]).

    The id is derived from the content, so repeating a job gives the same records.
    """
    created = utc_stamp(created_at)
    filled = reports.select("email", *_text_fields(reports, REPORT_FIELDS), created.alias("created_at"))
    parts = [F.col(c) for c in ("email", *REPORT_FIELDS, "created_at")]
    return filled.select("email", content_id(14, *parts).alias("report_id"), *REPORT_FIELDS, "created_at")


def share_links(reports: DataFrame, base_url: str = "", created_at: Column | None = None) -> DataFrame:
    """Shareable records with their link; reports with neither analysis nor findings are left out."""
    filled = reports.select(
        *_text_fields(reports, SHARE_FIELDS), F.col("email").alias("shared_by"), utc_stamp(created_at).alias("created_at")
    ).where((F.col("analysis") != "") | (F.col("doctor") != ""))
    parts = [F.col(c) for c in (*SHARE_FIELDS, "shared_by", "created_at")]
    return filled.select(content_id(16, *parts).alias("share_id"), *SHARE_FIELDS, "shared_by", "created_at").withColumn(
        "link", F.concat(F.lit(f"{base_url}?share="), F.col("share_id"))
    )


def dashboard_snapshot(
    df: DataFrame,
    email: str,
    file_name: str,
    industry: str = fixed.INDUSTRIES[0],
    created_at: Column | None = None,
    profiled: DataFrame | None = None,
) -> DataFrame:
    """Snapshot record of a frame's profile (`profiled`, if it is there); an empty frame gives no record."""
    owner = email.strip() or LOCAL_USER
    row = (profile(df) if profiled is None else profiled).where("rows > 0").select(
        F.lit(owner).alias("email"),
        F.lit(file_name).alias("file_name"),
        utc_stamp(created_at).alias("created_at"),
        "rows",
        "columns",
        F.col("missing_cells").alias("missing_values"),
        F.col("duplicate_rows"),
        F.lit(industry).alias("industry_template"),
        score_of_profile().cast("bigint").alias("data_quality_score"),
    )
    parts = [F.col(c) for c in row.columns]
    return row.select("email", content_id(12, *parts).alias("dashboard_id"), *row.columns[1:])


def key_prefix(key: Column) -> Column:
    """Partition value; the letter keeps it text when partitions are discovered."""
    return F.concat(F.lit("k"), F.substring(key, 1, 1))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a store, oldest first."""
    files, at = _folder(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    numbers = sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))
    whole = lambda n: files.exists(_folder(spark, f"{path}/version-{n}/_SUCCESS")[1])
    return [n for n in numbers if whole(n)]


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest whole version, or None where there is none."""
    known = versions(spark, path)
    return f"{path}/version-{known[-1]}" if known else None


def unversioned(spark: SparkSession, path: str) -> list[str]:
    """Partition folders of a store from before versions, where no version hides them yet."""
    files, at = _folder(spark, path)
    if not files.exists(at) or versions(spark, path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return sorted(f"{path}/{n}" for n in names if n.startswith(f"{KEY_PREFIX}="))


def _placed(keyed: DataFrame, record_id: str) -> DataFrame:
    order = (KEY_PREFIX, "user_key", record_id)
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def append_records(
    records: DataFrame,
    path: str,
    record_id: str,
    keep_local: bool = False,
    fmt: str = "parquet",
    owner: str = "email",
) -> str:
    """Append records to a user store; those whose id the user's store has already are left out, and so
    are repetitions within the batch, so a repeated job changes nothing.

    Records without an email (column `owner`) are refused, or kept under the local user with ``keep_local``.
    """
    spark = records.sparkSession
    email = F.coalesce(normalised_email(named(owner)), F.lit(""))
    if keep_local:
        kept = records.withColumn(owner, F.when(email != "", email).otherwise(LOCAL_USER))
    else:
        kept = records.where(email != "").withColumn(owner, email)
    keyed = kept.withColumn("user_key", user_key(named(owner))).withColumn(KEY_PREFIX, key_prefix(F.col("user_key")))
    fresh = keyed.dropDuplicates(["user_key", record_id])
    version = current(spark, path)
    if version is None and unversioned(spark, path):
        # taken as version 0 first; as lines or columns, whatever they hold
        version = _replace(spark, path, record_id, _rows(spark, path, record_id, fmt), fmt)
    if version is not None:
        there = spark.read.format(fmt).schema(f"user_key string, {record_id} string, {KEY_PREFIX} string").load(version)
        fresh = fresh.join(there, [KEY_PREFIX, "user_key", record_id], "left_anti")
    target = version or f"{path}/version-0"
    _placed(fresh, record_id).write.mode("append").partitionBy(KEY_PREFIX).format(fmt).save(target)
    return path


def _load(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "json":
        if schema is None:
            raise ValueError("a JSON store needs its record schema")
        reader = reader.schema(schema).option("mode", "DROPMALFORMED")
    version = current(spark, path)
    old = unversioned(spark, path) if version is None else []
    return reader.option("basePath", path).load(old) if old else reader.load(version or path)


def _rows(spark: SparkSession, path: str, record_id: str, fmt: str) -> DataFrame:
    """Rows to be written again: columns, or for JSON whole lines with the keys read from them, so that
    unread fields and lines that do not parse are kept."""
    if fmt != "json":
        return _load(spark, path, fmt)
    version = current(spark, path)
    reader = spark.read.format("text").schema(f"value string, {KEY_PREFIX} string")
    lines = reader.load(version) if version else reader.option("basePath", path).load(unversioned(spark, path))
    keys = [F.get_json_object("value", f"$.{n}").alias(n) for n in ("user_key", record_id)]
    return lines.select("value", KEY_PREFIX, *keys)


def list_records(
    spark: SparkSession,
    path: str,
    record_id: str,
    email: str | None = None,
    fmt: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """Stored records, newest first; of one user (partition and file pruning apply) or of all.

    JSON stores need the record `schema`; lines that do not parse are skipped.
    """
    stored = _load(spark, path, fmt, schema)
    if email is not None:
        key = user_key(F.lit(email.strip() or LOCAL_USER))
        stored = stored.where((F.col(KEY_PREFIX) == key_prefix(key)) & (F.col("user_key") == key))
    return stored.drop(KEY_PREFIX).orderBy(F.desc("created_at"), F.col(record_id))


def _replace(spark: SparkSession, path: str, record_id: str, rows: DataFrame, fmt: str) -> str:
    """Write rows as the next version and remove the older ones once it is whole."""
    older = versions(spark, path)
    gone = [f"{path}/version-{n}" for n in older] or unversioned(spark, path)
    target = f"{path}/version-{older[-1] + 1 if older else 0}"
    placed = _placed(rows, record_id)
    if fmt == "json":
        placed, fmt = placed.select("value", KEY_PREFIX), "text"
    placed.write.mode("overwrite").partitionBy(KEY_PREFIX).format(fmt).save(target)
    for folder in gone:
        files, at = _folder(spark, folder)
        files.delete(at, True)
    return target


def compact(spark: SparkSession, path: str, record_id: str, fmt: str = "parquet", schema: str | None = None) -> str:
    """Rewrite a store with files bounded by size instead of by the number of appends."""
    return _replace(spark, path, record_id, _rows(spark, path, record_id, fmt), fmt)


def purge_store(
    spark: SparkSession, path: str, record_id: str, requests: DataFrame, fmt: str = "parquet", schema: str | None = None
) -> str:
    """Erase the users (email) who asked for it: the next version lacks them, and the older ones are removed."""
    return _replace(spark, path, record_id, purge_users(_rows(spark, path, record_id, fmt), requests), fmt)


def purge_users(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records without those of the users (email) who asked for erasure: the next store version."""
    keys = requests.select(user_key(F.col("email")).alias("user_key")).distinct()
    return records.join(keys, "user_key", "left_anti")

"""Text and image files, the upload inventory, text export, and the sample table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import decode_text, lines_of, named, plain_number

MEGABYTE = 1024 * 1024


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def file_inventory(files: DataFrame, max_mb: int = fixed.MAX_UPLOAD_MB) -> DataFrame:
    """Route files (path, length) by suffix and size: adds suffix, mode, supported, size_ok, reason."""
    name = F.substring_index("path", "/", -1)
    suffix = F.when(
        F.regexp_like(name, F.lit(r"^.+\.[^.]+$")), F.lower(F.substring_index(name, ".", -1))
    ).otherwise("")
    by_mode = {m: [s for s, v in fixed.SUFFIX_MODES.items() if v == m] for m in fixed.SUFFIX_MODES.values()}
    mode = F.coalesce(*[F.when(F.col("suffix").isin(s), m) for m, s in by_mode.items()])
    size_mb = F.col("length") / MEGABYTE
    return (
        files.withColumn("suffix", suffix)
        .withColumn("mode", mode)
        .withColumn("supported", F.col("mode").isNotNull())
        .withColumn("size_ok", size_mb <= max_mb)
        .withColumn(
            "reason",
            F.when(
                ~F.col("size_ok"),
                F.concat(
                    F.lit("File is "), plain_number(size_mb, 1), F.lit(f"MB. Max allowed size is {max_mb}MB.")
                ),
            )
            .when(~F.col("supported"), "Unsupported file type.")
            .otherwise(""),
        )
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) per file, undecodable bytes dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", decode_text(F.col("content")).alias("text"))


def text_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: (key, line_no, text)."""
    return texts.select(named(key), F.posexplode(lines_of(named(text))).alias("line_no", "text"))


def _big_endian(content: Column, start: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, length)), 16, 10).cast("bigint")


def _little_endian(content: Column, start: int, length: int) -> Column:
    return sum(
        (_big_endian(content, start + i, 1) * (256**i) for i in range(1, length)), _big_endian(content, start, 1)
    )


def header_dimensions(content: Column) -> Column:
    """Struct (image_width, image_height) from a PNG or WebP file header, null for anything else.

    Fixed values: signatures and field positions of the two file formats.
    """
    def magic(start: int, text: bytes) -> Column:
        return F.hex(F.substring(content, start, len(text))) == text.hex().upper()

    def size(width: Column, height: Column) -> Column:
        return F.struct(width.cast("int").alias("image_width"), height.cast("int").alias("image_height"))

    webp = magic(1, b"RIFF") & magic(9, b"WEBP")
    packed = _little_endian(content, 22, 4)
    return (
        F.when(magic(1, b"\x89PNG\r\n\x1a\n"), size(_big_endian(content, 17, 4), _big_endian(content, 21, 4)))
        .when(
            webp & magic(13, b"VP8X"),
            size(_little_endian(content, 25, 3) + 1, _little_endian(content, 28, 3) + 1),
        )
        .when(
            webp & magic(13, b"VP8L"),
            size(packed % 16384 + 1, F.floor(packed / 16384) % 16384 + 1),
        )
        .when(
            webp & magic(13, b"VP8 "),
            size(_little_endian(content, 27, 2) % 16384, _little_endian(content, 29, 2) % 16384),
        )
    )


def jpeg_dimensions(content: Column, segments: int = 256) -> Column:
    """Struct (image_width, image_height) from a JPEG file's markers, null for anything else.

    The segments before the frame header are walked by their lengths: `segments` of them at first, and only
    in files where that is not enough as many more as the file has room for.
    Fixed values: marker codes and field positions of the file format.
    """
    start = F.when(F.hex(F.substring(content, 1, 2)) == "FFD8", F.lit(3)).otherwise(F.lit(None))
    none = F.lit(None).cast("int")
    first = F.struct(start.cast("long").alias("at"), none.alias("image_width"), none.alias("image_height"))

    def step(acc: Column, _: Column) -> Column:
        marker = F.hex(F.substring(content, acc["at"].cast("int"), F.lit(2)))
        at = lambda k, n: F.conv(F.hex(F.substring(content, (acc["at"] + k).cast("int"), F.lit(n))), 16, 10).cast("long")
        frame = marker.rlike("^FF(C[0-35-79ABD-F])$")
        moved = F.when(marker == "FFFF", acc["at"] + 1).when(marker.rlike("^FF[0-9A-F]{2}$") & ~marker.isin("FFD9", "FFDA"), acc["at"] + 2 + at(2, 2))
        return F.when(acc["at"].isNull(), acc).otherwise(
            F.struct(
                F.when(~frame, moved).alias("at"),
                F.when(frame, at(7, 2)).cast("int").alias("image_width"),
                F.when(frame, at(5, 2)).cast("int").alias("image_height"),
            )
        )

    begun = F.aggregate(F.sequence(F.lit(1), F.lit(segments)), first, step)
    # a segment has four bytes at least
    room = F.sequence(F.lit(1), F.ceil(F.octet_length(content) / 4).cast("int") + 1)
    walked = F.when(begun["at"].isNull(), begun).otherwise(F.aggregate(room, begun, step))
    return F.when(walked["image_width"].isNotNull(), F.struct(walked["image_width"], walked["image_height"]))


IMAGES = "*.{png,PNG,webp,WEBP,jpg,JPG,jpeg,JPEG}"


def read_image_metadata(spark: SparkSession, path: str, pattern: str = IMAGES) -> DataFrame:
    """(path, image_width, image_height, reason) of image files (png, webp, jpg, jpeg by name, unless another
    pattern of names is given), from their headers.

    A file whose header cannot be read has null sizes and a reason. Spark's reader loads whole files.
    """
    content = F.col("content")
    images = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter=pattern)
        .load(path)
        .select("path", F.coalesce(header_dimensions(content), jpeg_dimensions(content)).alias("d"))
    )
    reason = F.when(F.col("d").isNull(), "Image header cannot be read.").otherwise("")
    return images.select("path", "d.image_width", "d.image_height", reason.alias("reason"))


def write_text(reports: DataFrame, path: str, column: str = "report", mode: str = "errorifexists") -> str:
    """Export one text column."""
    reports.select(named(column).alias("value")).write.mode(mode).text(path)
    return path


# The built-in sample table.
SAMPLE_START = "2025-01-01"
SAMPLE_SALES = [12000, 13200, 12800, 14100, 15500, 16200, 17000, 16800, 17600, 18300, 19100, 20500]
SAMPLE_CUSTOMERS = [210, 225, 218, 233, 248, 255, 270, 266, 278, 286, 294, 310]
SAMPLE_RETURNS = [11, 14, 12, 16, 15, 17, 18, 16, 19, 20, 22, 21]
SAMPLE_REGION = "South"


def sample_dataset(spark: SparkSession) -> DataFrame:
    """Twelve months of Date, Sales, Customers, Returns, Region."""
    rows = list(zip(range(12), SAMPLE_SALES, SAMPLE_CUSTOMERS, SAMPLE_RETURNS))
    months = spark.createDataFrame(rows, "month int, Sales bigint, Customers bigint, Returns bigint")
    return months.select(
        F.add_months(F.lit(SAMPLE_START).cast("date"), F.col("month")).cast("timestamp_ntz").alias("Date"),
        "Sales",
        "Customers",
        "Returns",
        F.lit(SAMPLE_REGION).alias("Region"),
    )

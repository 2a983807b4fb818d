"""Image files as rows: decoded pixels and file evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def bgr_to_rgb(data: Column) -> Column:
    """Swap the channel order of the image source, JVM-side, three hex pairs at a time."""
    return F.unhex(F.regexp_replace(F.hex(data), "(..)(..)(..)", "$3$2$1"))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded RGB rows; a file that cannot be decoded becomes a row with an error.

    Columns: path, width, height, rgb, byte_size, content, error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("byte_size"), "content")
    decoded = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    decoded = decoded.select(
        F.regexp_replace("origin", "^file:/+", "file:/").alias("path"), "width", "height", "nChannels", F.col("data").alias("bgr")
    )
    joined = files.join(decoded, "path", "left")
    usable = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    gray = F.unhex(F.regexp_replace(F.hex("bgr"), "(..)", "$1$1$1"))
    four = F.unhex(F.regexp_replace(F.hex("bgr"), "(..)(..)(..)(..)", "$3$2$1"))
    rgb = F.when(F.col("nChannels") == 3, bgr_to_rgb(F.col("bgr"))).when(F.col("nChannels") == 1, gray).otherwise(four)
    return joined.select(
        "path",
        F.when(usable, F.col("width")).alias("width"),
        F.when(usable, F.col("height")).alias("height"),
        F.when(usable, rgb).alias("rgb"),
        "byte_size",
        "content",
        F.when(~usable, F.lit("undecodable")).alias("error"),
    )


def image_format(content: Column) -> Column:
    """File format from the leading bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), F.lit("PNG"))
        .when(head.startswith("FFD8FF"), F.lit("JPEG"))
        .when(head.startswith("424D"), F.lit("BMP"))
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), F.lit("TIFF"))
        .when(head.startswith("52494646") & head.endswith("57454250"), F.lit("WEBP"))
    )


# Content type by format.
CONTENT_TYPES = {"PNG": "image/png", "JPEG": "image/jpeg", "BMP": "image/bmp", "TIFF": "image/tiff", "WEBP": "image/webp"}


def media_manifest(files: DataFrame, variant: Column) -> DataFrame:
    """(path, content) to path, variant, byte_size, sha256, format and content type."""
    form = image_format(F.col("content"))
    types = F.create_map(*[F.lit(v) for pair in CONTENT_TYPES.items() for v in pair])
    return files.select(
        "path",
        variant.alias("variant"),
        F.octet_length("content").cast("bigint").alias("byte_size"),
        F.sha2("content", 256).alias("sha256"),
        form.alias("format"),
        F.coalesce(F.try_element_at(types, form), F.lit("application/octet-stream")).alias("content_type"),
    )

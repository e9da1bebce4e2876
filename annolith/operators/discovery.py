"""Discovery: records of found files, why they are dropped, and the candidate rows of those that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X


def drop_reason(mime: Column, width: Column, height: Column, licence: Column, least: int = V.LEAST_SIDE, keep_incompatible: bool = False) -> Column:
    """not_jpeg, small or incompatible, the first that holds; NULL for a record that stays."""
    small = F.least(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))) < least
    reason = F.when(X.text_or_empty(mime) != "image/jpeg", "not_jpeg").when(small, "small")
    return reason if keep_incompatible else reason.when(X.gate_verdict(licence) == "INCOMPATIBLE", "incompatible")


def dropped(records: DataFrame, least: int = V.LEAST_SIDE, keep_incompatible: bool = False) -> DataFrame:
    """(reason, n) of records (mime, width, height, license); those kept count as `kept`."""
    reason = drop_reason(F.col("mime"), F.col("width"), F.col("height"), F.col("license"), least, keep_incompatible)
    return records.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def candidates(records: DataFrame, least: int = V.LEAST_SIDE, keep_incompatible: bool = False) -> DataFrame:
    """Candidate rows of the records that stay, all pending.

    records (page_id, url, page_url, artist, uploader, license, license_url, attribution, description, mime, width, height, found_via).
    """
    kept = records.filter(drop_reason(F.col("mime"), F.col("width"), F.col("height"), F.col("license"), least, keep_incompatible).isNull())
    named = kept.withColumns({
        "__verdict": X.gate_verdict(F.col("license")), "__artist": X.strip_markup(F.col("artist")), "__credit": X.strip_markup(F.col("attribution")),
        "__told": F.substring(X.strip_markup(F.col("description")), 1, 120),
    })
    creator = F.when(F.col("__artist") != "", F.col("__artist")).otherwise(F.concat(F.lit("uploader:"), X.text_or_empty(F.col("uploader"))))
    named = named.withColumn("__creator", creator)
    permitted = F.when(F.col("__verdict") == "COMPATIBLE", "yes").when(F.col("__verdict") == "INCOMPATIBLE", "no").otherwise("unclear")
    licence = X.text_or_empty(F.col("license"))
    page = F.col("page_id").cast("string")
    values = {
        "candidate_id": F.concat(F.lit("cw"), page), "source_platform": F.lit("wikimedia_commons"), "original_url": X.text_or_empty(F.col("url")),
        "file_page_url": X.text_or_empty(F.col("page_url")), "creator": F.col("__creator"), "license": F.when(licence == "", "UNKNOWN").otherwise(licence),
        "license_url": X.text_or_empty(F.col("license_url")), "attribution": F.when(F.col("__credit") != "", F.col("__credit")).otherwise(F.col("__creator")),
        "redistribution_status": permitted, "modification_status": permitted, "plate_class": F.lit("AMBIGUOUS"), "class_confidence": F.lit("unreviewed"),
        "is_real_photo": F.lit("unclear"), "full_scene_or_crop": F.lit("UNKNOWN"),
        "resolution": F.concat_ws("x", F.coalesce("width", F.lit(0)).cast("string"), F.coalesce("height", F.lit(0)).cast("string")),
        "source_group": F.concat(F.lit("commons:"), page), "provenance_status": F.lit("PLATFORM_METADATA_ONLY"), "decision": F.lit("PENDING"),
        "notes": F.concat(F.lit("found via "), X.text_or_empty(F.col("found_via")), F.lit("; licence gate "), F.col("__verdict"), F.lit("; "), F.col("__told")),
    }
    return named.select(*(values[c].alias(c) for c in V.CANDIDATE_FIELDS))


def approved(rows: DataFrame) -> DataFrame:
    """Rows whose decision is the accepting one, in that very case."""
    return rows.filter(X.stripped(F.col("decision")) == V.ACCEPT)


def working_copies(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of which no folder is the one that holds untouched originals."""
    parts = F.split(X.forward_slashes(F.col(path)), "/")
    return files.filter(~F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), V.ORIGINALS))

"""Expressions on file names, addresses, checksums and secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """The extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_name(address: Column, key: Column) -> Column:
    """The last part of an address's path, decoded; ``download_<key>`` where that has no dot."""
    path = F.coalesce(F.try_parse_url(address, F.lit("PATH")), F.lit(""))
    last = F.coalesce(F.try_url_decode(F.substring_index(path, "/", -1)), F.lit(""))
    return F.when(F.contains(last, F.lit(".")), last).otherwise(F.concat(F.lit("download_"), key.cast("string")))


def safe_name(name: Column, most: int = 200) -> Column:
    """A name without the signs that file systems refuse; blank names are ``unnamed_file``; long stems are cut."""
    s = F.regexp_replace(F.translate(name, '<>:"/\\|?*', "_________"), r"^[ .]+|[ .]+$", "")
    ext = F.regexp_extract(s, r"(\.[^.]*)$", 1)
    stem = F.substring(s, F.lit(1), F.length(s) - F.length(ext))
    cut = F.concat(F.substring(stem, F.lit(1), F.greatest(F.lit(0), most - F.length(ext))), ext)
    return F.when(F.coalesce(s, F.lit("")) == "", "unnamed_file").when(F.length(s) > most, cut).otherwise(s)


def unique_names(df: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """``df`` with ``unique_name``: the second and later of equal names in a folder get ``_1``, ``_2`` … before the extension."""
    n = F.row_number().over(W.partitionBy(folder, name).orderBy(order)) - 1
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    return df.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def checksum(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def masked_key(key: Column) -> Column:
    """The first and last four signs of a key; ``***`` for short ones, empty for none."""
    return F.when(F.coalesce(key, F.lit("")) == "", "").when(F.length(key) <= 8, "***").otherwise(F.concat(F.substring(key, 1, 4), F.lit("***"), F.right(key, F.lit(4))))


def client_address(forwarded: Column, real: Column, peer: Column) -> Column:
    """The first forwarded address, else the real one, else the peer's; blanks count as missing."""
    first = F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(real), F.lit("")), peer)


def made_id(prefix: str, key: Column) -> Column:
    """``prefix_`` and 16 hex digits that depend on the key alone; null for null."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(key.cast("binary"), 256), 1, 16))


def base64url(text: Column) -> Column:
    """Base 64 with the signs that addresses allow, without padding."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(text.cast("binary")), "[\r\n]", ""), "+/", "-_"), "=+$", "")


def url_encoded(text: Column) -> Column:
    """Percent encoding of all but letters, digits and ``-._~``; a blank is ``%20``."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

"""Text and path expressions; everything here is Catalyst."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """Lower-cases A-Z only (Spark's lower() is Unicode's)."""
    return F.translate(c, UPPER, LOWER)


def fold(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def normalize_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased extension, empty when absent: `.bashrc` has none, `a.tar.gz` has `gz`."""
    return ascii_fold(F.regexp_extract(name, r"^(?s).+\.([^.]*)$", 1))


def unicode_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def fingerprint(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def parse_fingerprint(c: Column) -> Column:
    """64 hex digits in any case to lower case, anything else to null."""
    return F.when(c.rlike("^[0-9a-fA-F]{64}$"), ascii_fold(c))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5, from SHA-1 of namespace and name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def asset_uuid(archive: Column, path: Column, prefix: str = "asset") -> Column:
    """Deterministic asset id of a path in an archive; another system's ids come out with its prefix."""
    return uuid5(F.concat(F.lit(f"{prefix}:"), archive, F.lit(":"), path))


def asset_uuid_from_parts(path_hash: Column, mtime_ms: Column, size: Column, prefix: str = "file") -> Column:
    return uuid5(F.concat_ws(":", F.lit(prefix), path_hash.cast("string"), mtime_ms.cast("string"), size.cast("string")))


def sort_key(path: Column) -> Column:
    """Order of paths by components: `a/b` before `a.b`."""
    return F.split(path, "/")

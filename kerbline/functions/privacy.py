"""Privacy in the query path: keyed hashes, pseudonyms, masking of texts and of nested documents, scrubbing of secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What looks like a plate in free text; keys that hold plates; keys that are dropped; secrets in details.
PLATE_LIKE = r"\b(?:[A-Z]{2}\s?\d{1,2}\s?[A-Z]{0,3}\s?\d{3,4}|\d{2}\s?BH\s?\d{4}\s?[A-Z]{1,2})\b"
PLATE_KEYS = {"plate_text", "plate_raw", "plate_display", "raw_text", "normalized_text", "plate", "plates", "ocr_text", "ocr_raw", "plate_query"}
DROPPED_KEYS = {"plate_reads_raw"}
SECRET_KEYS = {"password", "new_password", "old_password", "password_encrypted", "token", "secret"}


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Hexadecimal HMAC-SHA256; null for null and empty texts. The padded keys are computed here, the hashes by Spark."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)
    return F.when(F.length(text) > 0, digest)


def pseudonym(text: Column, key: bytes) -> Column:
    return F.concat(F.lit("PSN-"), F.upper(F.substring(hmac_sha256(text, key), 1, 10)))


def pseudonym_prefix(query: str) -> str | None:
    """The hash prefix that a query such as PSN-1A2B means, null for other queries."""
    import re

    found = re.fullmatch(r"PSN-([0-9A-F]{4,10})", query.strip().upper())
    return found[1].lower() if found else None


def mask_text(text: Column, key: bytes) -> Column:
    """Every plate-like passage replaced by the pseudonym of its letters and digits."""
    found = F.regexp_extract_all(text, F.lit(PLATE_LIKE), F.lit(0))
    # Split by the passages and put the pseudonyms between, so that what was replaced is not searched again.
    between = F.split(F.regexp_replace(text, PLATE_LIKE, "\u0001"), "\u0001")
    filled = F.zip_with(between, found, lambda a, p: F.concat(a, F.coalesce(pseudonym(F.replace(p, F.lit(" "), F.lit("")), key), F.lit(""))))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(filled, ""))


def _plate_value(value: Column, key: bytes) -> Column:
    return F.when(value.startswith("PSN-"), value).otherwise(pseudonym(F.replace(value, F.lit(" "), F.lit("")), key))


def masked(column: Column, kind: T.DataType, key: bytes, name: str = "") -> Column:
    """A column of any nested type with plates as pseudonyms, other texts masked and sensitive fields dropped, by its schema."""
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in DROPPED_KEYS]
        return F.when(column.isNotNull(), F.struct(*[masked(column[f.name], f.dataType, key, f.name).alias(f.name) for f in kept]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: masked(x, kind.elementType, key, name))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.map_filter(F.transform_values(column, lambda k, v: F.when(k.isin(*PLATE_KEYS), _plate_value(v, key)).otherwise(mask_text(v, key))), lambda k, _: ~k.isin(*DROPPED_KEYS))
    if isinstance(kind, T.StringType):
        return _plate_value(column, key) if name in PLATE_KEYS else mask_text(column, key)
    return column


def scrubbed(details: Column) -> Column:
    """A map of texts with the values of secret keys redacted."""
    return F.transform_values(details, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), F.lit("***")).otherwise(v))


def scrubbed_tree(column: Column, kind: T.DataType, name: str = "") -> Column:
    """A column of nested details with the values of secret keys redacted at any depth, by its schema. Lists are left as they are."""
    if name.lower() in SECRET_KEYS:
        return F.lit("***")
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[scrubbed_tree(column[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return scrubbed(column)
    return column


def safe_uri(uri: Column) -> Column:
    """User and password in a URI replaced by stars."""
    return F.regexp_replace(uri, r"//[^/@]+@", "//***:***@")

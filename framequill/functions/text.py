"""Scalar helpers for documents and requests: canonical JSON, media URIs, masks, colours, rationals, names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from framequill.session import ship

ship(__name__)

#: Fixed value: a template's unfinished places.
PLACEHOLDER = r"(?i)\{\{[^}]+\}\}|\[(?:ACTUAL|ALLOWED|PATH|OBSERVABLE|DESIRED|TASK|SUBJECT|FIXED|ENDING|RELEVANT)[A-Z _-]*\]|replace-with-"


def canonical(pairs: dict, ascii_only: bool = False) -> Column:
    """JSON object with sorted keys, nested dictionaries too; null fields are left out. ``ascii_only`` writes other characters as \\uXXXX units."""
    def struct(d: dict) -> Column:
        return F.struct(*[(struct(d[k]) if isinstance(d[k], dict) else d[k]).alias(k) for k in sorted(d)])

    text = F.to_json(struct(pairs))
    if not ascii_only:
        return text
    other = r"[^\x00-\x7F]+"
    units = lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(....)", r"\\u$1")
    plain, runs = F.split(text, other, -1), F.regexp_extract_all(text, F.lit(other), F.lit(0))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.array_join(F.zip_with(plain, runs, lambda p, r: F.concat(p, F.coalesce(units(r), F.lit("")))), ""))


def canonical_document(document: Column) -> Column:
    """A JSON document of any shape with the keys of every object sorted by code point, compact and in ASCII; null for what is no JSON.

    VARIANT sorts keys too, but writes 1.0 as 1 and 1e22 as 1.0E22, so hashes of documents with such numbers would differ.
    """
    @F.pandas_udf("string")
    def run(documents: pd.Series) -> pd.Series:
        import json

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
            except (ValueError, RecursionError):
                return None

        return documents.map(one)

    return run(document)


def document_sha256(document: Column) -> Column:
    return F.sha2(canonical_document(document), 256)


def unknown_keys(document: Column, allowed: list[str]) -> Column:
    """Keys of the outermost object that are none of ``allowed``."""
    return F.array_except(F.json_object_keys(document), F.array(*[F.lit(k) for k in allowed]))


def data_uri(mime: Column, content: Column) -> Column:
    """Inline media; the line breaks that ``base64`` may put after every 76 digits are left out."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def media_uri(value: Column, mime: Column, content: Column) -> Column:
    """Addresses and inline media as they are, anything else as the inline form of its content; a type that is not known is a plain stream."""
    return F.when(value.rlike(r"^(https?://|data:)"), value).otherwise(data_uri(F.coalesce(mime, F.lit("application/octet-stream")), content))


def uri_mime(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^data:([^;,]+);base64,", 1)


def uri_content(uri: Column) -> Column:
    return F.unbase64(F.regexp_extract(uri, r"^data:[^;,]+;base64,([A-Za-z0-9+/]*={0,2})$", 1))


def masked(text: Column) -> Column:
    """Text with web addresses and inline media taken out."""
    return F.regexp_replace(F.regexp_replace(text, r"https?://[^\s\"<>]+", "[url]"), r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "[media]")


def hex_colour(colour: Column) -> Column:
    """array<int> of #rgb or #rrggbb, null for anything else."""
    short = F.regexp_extract(colour, r"^#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])$", 0) != ""
    full = F.when(short, F.regexp_replace(colour, r"([0-9a-fA-F])", "$1$1")).otherwise(colour)
    channel = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.when(full.rlike(r"^#[0-9a-fA-F]{6}$"), F.array(channel(2), channel(4), channel(6)))


def rational(rate: Column) -> Column:
    """"n/d" or a number as double; null for 0/0 and for what is neither."""
    top, bottom = F.regexp_extract(rate, r"^(\d+(?:\.\d+)?)(?:/(\d+))?$", 1), F.regexp_extract(rate, r"^(\d+(?:\.\d+)?)/(\d+)$", 2)
    over = F.when(bottom == "", F.lit(1.0)).otherwise(bottom.cast("double"))
    return F.when((top != "") & (over != 0), top.cast("double") / over)


def is_prose(text: Column) -> Column:
    """Whether a text says anything: neither blank nor a placeholder."""
    return F.coalesce((F.trim(text) != "") & ~text.rlike(PLACEHOLDER), F.lit(False))


def is_confined(path: Column) -> Column:
    """A relative path that stays below its root."""
    return F.coalesce((path != "") & ~path.rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def is_layer_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-z][a-z0-9-]*$"), F.lit(False))


def numbered(prefix: str, number: Column, width: int = 6) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def short_number(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(20,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")

"""Hashes, keys and URL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import text

TRACKERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid")
SORTS = ("sort", "order", "orderby", "sortby", "dir")
POINTS = uuid.UUID("9b1d2f54-6a43-5c0e-8f0d-2c1b7a9e4d10")


def dedup_url(c: Column) -> Column:
    """A URL without fragment and closing slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"#.*$", ""), r"/+$", ""))


def content_hash(c: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " ")), 256)


def page_id(url: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", dedup_url(url), content_hash(content)), 256), 1, 24)


def fingerprint(c: Column, words: int = 250) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " ")), " "), 1, words), " ")


def chunk_id(page: Column, index: Column, content: Column) -> Column:
    return F.format_string("%s:%04d:%s", page, index, F.substring(content_hash(content), 1, 12))


def paragraph_hash(c: Column) -> Column:
    return F.sha1(F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " ")))


def cache_key(query: Column) -> Column:
    x = F.trim(F.regexp_replace(F.lower(text(query)), r"\s+", " "))
    return F.sha1(F.trim(F.regexp_replace(x, r"[?!. ]+$", "")))


def uuid5(c: Column, namespace: uuid.UUID = POINTS) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(text(c), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case (https by default), no www., double or closing slashes, fragment, tracker, sort or blank parameters; parameters in order."""
    url = F.regexp_replace(F.trim(text(c)), r"#.*$", "")
    url = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    scheme = F.lower(F.regexp_extract(url, r"^([^:]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:]+://([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?]*([^?]*)", 1), r"/+", "/"), r"/$", "")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    drop = list(TRACKERS + SORTS)
    kept = F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]+=.") & ~F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).isin(drop))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def slug_words(c: Column) -> Column:
    """The last part of a URL's path as words."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(text(c), r"^[^:]+://[^/?#]*([^?#]*)", 1), r"/+$", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.trim(F.regexp_replace(F.try_url_decode(last), r"[\-_+ ]+", " "))


def titleize(c: Column) -> Column:
    return F.initcap(c)

"""URL extraction, normalisation and clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import java_pattern, text_or_empty

_SPLIT = r"^(https?)://([^/?#]*)([^?#]*)"


def extract_urls(col: Column) -> Column:
    """All http(s) URLs of a text in order, duplicates kept."""
    return F.regexp_extract_all(
        text_or_empty(col), F.lit(java_pattern(fv.REPLY_URL_PATTERN)), F.lit(0)
    )


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 1)


def url_host(url: Column) -> Column:
    """Network location as written: port, user info and case are kept."""
    return F.regexp_extract(url, _SPLIT, 2)


def url_path(url: Column) -> Column:
    """Path without query, fragment, parameters of the last segment and trailing slashes."""
    path = F.regexp_extract(url, _SPLIT, 3)
    return F.regexp_replace(F.regexp_replace(path, ";[^/]*$", ""), "/+$", "")


def is_trusted(url: Column) -> Column:
    return url_host(url).isin(fv.TRUSTED_HOSTS)


def whitelist_kind(url: Column) -> Column:
    """``host`` for a URL without a path, else ``path``."""
    return F.when(url_path(url) == "", "host").otherwise("path")


def whitelist_key(url: Column) -> Column:
    """What must be listed for the URL to pass: the bare host, or scheme, host and path."""
    path = url_path(url)
    return F.when(path == "", url_host(url)).otherwise(
        F.concat(url_scheme(url), F.lit("://"), url_host(url), path)
    )


def sanitize(text: Column, violations: Column) -> Column:
    """Replace every listed URL, longest first, wherever it occurs in the text."""
    longest_first = F.array_sort(
        violations, lambda a, b: (F.length(b) - F.length(a)).cast("int")
    )
    cleaned = F.aggregate(
        longest_first, text, lambda acc, url: F.replace(acc, url, F.lit(fv.REMOVED_URL_TEXT))
    )
    return F.when(F.size(violations) > 0, cleaned).otherwise(text)

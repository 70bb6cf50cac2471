"""URL parts, endpoints, slugs and links, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
_PARAMS = ";[^/]*$"
_LOCALE = "^[a-z]{2}-[A-Z]{2}$"


def url_parts(url: Column) -> Column:
    """Struct (scheme, netloc, path); netloc keeps its port. Never fails on odd text."""
    return F.struct(
        F.lower(F.regexp_extract(url, _URL, 1)).alias("scheme"),
        F.regexp_extract(url, _URL, 2).alias("netloc"),
        F.regexp_replace(F.regexp_extract(url, _URL, 3), _PARAMS, "").alias("path"),
    )


def _split_path(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")


def clean_segments(path: Column) -> Column:
    """Path segments without locale tags. An empty path gives `['']`."""
    return F.filter(_split_path(path), lambda s: ~s.rlike(_LOCALE))


def filled_segments(path: Column) -> Column:
    """Non-empty path segments, locale tags kept."""
    return F.filter(_split_path(path), lambda s: s != "")


def page_endpoints(url: Column) -> Column:
    """Struct (tenant, org, detail_url, list_url) of a paged source.

    `org` and both URLs are null when no segment is left: such a company is a reject.
    """
    parts = url_parts(url)
    host = parts["netloc"]
    tenant = F.substring_index(host, ".", 1)
    org = F.get(clean_segments(parts["path"]), F.lit(0))
    detail = F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), tenant, F.lit("/"), org)
    return F.struct(
        tenant.alias("tenant"),
        org.alias("org"),
        detail.alias("detail_url"),
        F.concat(detail, F.lit("/jobs")).alias("list_url"),
    )


def board_slug(url: Column) -> Column:
    """The segment after the first `boards`, else the last segment, else the URL itself."""
    segments = filled_segments(url_parts(url)["path"])
    at = F.array_position(segments, "boards").cast("int")
    after = F.when(at > 0, F.get(segments, at))
    return F.coalesce(after, F.get(segments, F.size(segments) - 1), url)


def link_prefix(url: Column) -> Column:
    """`scheme://netloc/` and the first two non-empty segments."""
    parts = url_parts(url)
    head = F.array_join(F.slice(filled_segments(parts["path"]), 1, 2), "/")
    return F.concat(parts["scheme"], F.lit("://"), parts["netloc"], F.lit("/"), head)


def application_link(url: Column, external_path: Column) -> Column:
    return F.concat(link_prefix(url), F.coalesce(external_path, F.lit("")))


def percent_encode(text: Column) -> Column:
    """Percent form that keeps `/` and the unreserved characters."""
    form = F.url_encode(text)
    for encoded, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        form = F.replace(form, F.lit(encoded), F.lit(plain))
    return form


def search_url(company: Column) -> Column:
    """People-search link for one company."""
    words = F.concat(F.lit("software engineer "), company, F.lit(" bangalore"))
    # Fixed value: link format
    return F.concat(
        F.lit("https://www.linkedin.com/search/results/people/?keywords="),
        percent_encode(words),
        F.lit("&origin=FACETED_SEARCH&pastCompany=%5B%229390173%22%5D"),
    )

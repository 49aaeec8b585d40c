"""Content categories, status classes and endpoint categories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .headers import media_type

# File extensions of static assets.
ASSET_EXTENSIONS = (
    "js mjs cjs css png jpg jpeg gif svg ico webp avif woff woff2 ttf eot otf map mp4 webm mp3 ogg pdf"
).split()
# Path parts of static assets, and the pattern of API paths.
ASSET_PATHS = ("/static/", "/assets/", "/dist/", "/bundle", "/_next/", "/chunks/")
API_PATH = r"(?i)^/(api|graphql|rest|v\d+)(/|$)"


def classify(content_type: Column) -> Column:
    """json, html, xml, yaml, csv, form, text or binary; what is empty or unknown is binary."""
    m = media_type(F.coalesce(content_type, F.lit("")))
    return (
        F.when(F.contains(m, F.lit("json")), "json")
        .when(m.isin("text/html", "application/xhtml+xml"), "html")
        .when(F.contains(m, F.lit("xml")), "xml")
        .when(F.contains(m, F.lit("yaml")), "yaml")
        .when(m.isin("text/csv", "text/tab-separated-values"), "csv")
        .when(m == "application/x-www-form-urlencoded", "form")
        .when(m.startswith("text/"), "text")
        .otherwise("binary")
    )


def is_binary(content_type: Column, body: Column) -> Column:
    """Whether a decoded body is binary: by content type, else by whether it is valid UTF-8."""
    c = F.lower(F.coalesce(content_type, F.lit("")))
    textual = c.startswith("text/") | c.rlike("json|xml|javascript|html|css|yaml|form-urlencoded")
    binary = c.rlike("^(image|audio|video)/|octet-stream|gzip|zip|pdf")
    return F.when(textual, False).when(binary, True).otherwise(~F.is_valid_utf8(body.cast("string")))


def status_class(status: Column) -> Column:
    """1xx to 5xx, else other."""
    return F.when((status >= 100) & (status < 600), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("other")


def endpoint_category(template: Column, dominant_type: Column) -> Column:
    """asset, api, page, data or other: by extension, then by dominant content type, then by path."""
    low = F.lower(template)
    last = F.regexp_extract(low, r"([^/]*)\z", 1)
    extension = F.when(last.startswith("{"), F.lit("")).otherwise(F.regexp_extract(last, r"\.([^.]*)\z", 1))
    kind = F.when(dominant_type != "", classify(dominant_type))
    path_test = F.lit(False)
    for part in ASSET_PATHS:
        path_test = path_test | F.contains(low, F.lit(part))
    return (
        F.when(extension.isin(*ASSET_EXTENSIONS), "asset")
        .when((kind == "binary") | F.coalesce(F.lower(dominant_type), F.lit("")).rlike("javascript|css"), "asset")
        .when(kind.isin("json", "xml", "yaml"), "api")
        .when(kind == "html", "page")
        .when(kind.isin("csv", "form"), "data")
        .when(template.rlike(API_PATH), "api")
        .when(path_test, "asset")
        .otherwise("other")
    )

"""Columns and rows from HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']+)"""
_IMAGE = r"""(?i)<img\s[^>]*src\s*=\s*["']([^"']+)"""


def links(pages: DataFrame) -> DataFrame:
    """page_id, href of each anchor, as written."""
    return pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("href"))


def absolute(url: Column, href: Column) -> Column:
    """An href as an absolute http(s) address without fragment; null for other schemes."""
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    folder = F.concat(origin, F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]+|[?#].*$", ""), r"[^/]*$", ""))
    bare = F.regexp_replace(F.trim(href), r"#.*$", "")
    return (
        F.when(bare == "", F.lit(None)).when(bare.rlike(r"(?i)^https?://"), bare).when(bare.rlike(r"^//"), F.concat(F.regexp_extract(url, r"^(https?:)", 1), bare)).when(bare.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None)).when(bare.startswith("/"), F.concat(origin, bare))
        .otherwise(F.concat(F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder), bare))
    )


def images(pages: DataFrame) -> DataFrame:
    """page_id, src, image_id; no data: or blob:."""
    found = pages.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_IMAGE), F.lit(1)))).alias("src"))
    return found.where(~F.col("src").rlike("^(?:data|blob):")).withColumn("image_id", F.md5(F.encode(F.concat("url", F.lit(":"), "src"), "UTF-8")))


def title(html: Column) -> Column:
    """X46."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_language(html: Column) -> Column:
    """X47, where the markup says it."""
    return F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z]+)""", 1))


def visible_text(html: Column) -> Column:
    """Without comments, scripts, styles and tags; blocks break lines, entities of the markup resolved."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer)\b[^>]*>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\f]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def needs_browser(html: Column) -> Column:
    """Pages that only a script fills."""
    return html.rlike(r"""(?i)<div[^>]*id=["'](?:root|app|__next)["'][^>]*>\s*</div>|enable javascript""") & (F.length(visible_text(html)) < 200)

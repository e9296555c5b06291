"""Rules on HTML pages: metadata, images, links, headings and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.regex import java
from tidemark.functions.text import dirname
from tidemark.operators.code import mask_html
from tidemark.operators.imports import join_path

# fixed values: severity, rule, message, pattern that must be present in a page with a head
HEAD_RULES = (
    ("warning", "missing-description", "Missing meta description", r"""<meta\s[^>]*name=["']description["']"""),
    ("error", "missing-viewport", "Missing viewport meta — page won't be mobile-responsive", r"""<meta\s[^>]*name=["']viewport["']"""),
    ("warning", "missing-charset", "Missing charset declaration", r"<meta\s[^>]*charset"),
    ("info", "missing-og", "Missing Open Graph tags (og:title, og:description) — social sharing will look plain", r"""<meta\s[^>]*property=["']og:title["']"""),
    ("info", "missing-canonical", "Missing canonical link — may cause duplicate content issues", r"""<link\s[^>]*rel=["']canonical["']"""),
    ("info", "missing-favicon", "Missing favicon", r"""<link\s[^>]*rel=["'](?:shortcut )?icon["']"""),
)
# fixed values: severity, rule, message, attribute an image must have
IMAGE_RULES = (
    ("error", "img-no-alt", "Image missing alt attribute", r"alt\s*="),
    ("warning", "img-no-dimensions", "Image missing width/height — causes layout shift", r"(?:width|height)\s*="),
    ("info", "img-no-lazy", 'Image missing loading="lazy" — add for below-fold images', r"loading\s*="),
)
TITLE = java(r"<title[^>]*>([^<]*)</title>", "i")
MIXED_CONTENT = java(r"""<(?:img|script|link|iframe)\s[^>]*(?:src|href)=["']http://(?!localhost)""", "i")
LINK = java(r"""<a\s[^>]*href=["']([^"']+)["'][^>]*>""", "i")


def title_of(content: Column) -> Column:
    return F.trim(F.regexp_extract(content, TITLE, 1))


def _found(severity: str, rule: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), text.alias("message"))


def scan_pages(pages: DataFrame) -> DataFrame:
    """Page-level findings: one row per page and missing or faulty element."""
    raw, dom = F.col("content"), F.col("dom")
    has_head = raw.contains("<head")
    has_title = raw.rlike(java(r"<title[^>]*>"))
    title = title_of(raw)
    closed = raw.rlike(TITLE)
    rules = [
        F.when(has_head & ~has_title, _found("error", "missing-title", "Missing <title> tag")),
        F.when(
            has_head & closed & (F.length(title) < 10),
            _found("warning", "short-title", F.concat(F.lit('Title too short: "'), title, F.lit('" — aim for 30-60 characters'))),
        ),
        F.when(
            dom.rlike(java(r"<html[\s>]")) & ~dom.rlike(java(r"<html\s[^>]*lang=", "i")),
            _found("warning", "missing-lang", "Missing lang attribute on <html> — screen readers need this (WCAG 3.1.1)"),
        ),
        F.when(dom.rlike(MIXED_CONTENT), _found("warning", "mixed-content", "Mixed content: HTTP resource on page — use HTTPS")),
    ]
    rules += [
        F.when(has_head & ~raw.rlike(java(p, "i")), _found(severity, rule, message)) for severity, rule, message, p in HEAD_RULES
    ]
    masked = mask_html(pages.withColumn("_raw", raw)).select(
        *[c for c in pages.columns if c != "content"], F.col("_raw").alias("content"), F.col("content").alias("dom")
    )
    head = F.regexp_extract(raw, java(r"<head[^>]*>(.*?)</head>", "is"), 1)
    blocking = F.filter(
        F.regexp_extract_all(head, F.lit(java(r"""<script\s[^>]*src=["'][^"']+["'][^>]*>""", "i")), F.lit(0)),
        lambda tag: ~tag.rlike(java(r"""\b(?:async|defer|type=["']module["'])\b""", "i")),
    )
    images = F.regexp_extract_all(dom, F.lit(java(r"<img\s[^>]*>", "i")), F.lit(0))
    image_hits = F.flatten(
        F.transform(
            images,
            lambda tag: F.array_compact(
                F.array(*[F.when(~tag.rlike(java(p, "i")), _found(s, r, m)) for s, r, m, p in IMAGE_RULES])
            ),
        )
    )
    anchors = F.regexp_extract_all(dom, F.lit(LINK), F.lit(0))
    anchor_hits = F.flatten(
        F.transform(
            anchors,
            lambda tag: F.array_compact(
                F.array(
                    F.when(
                        tag.rlike(java(r"""href=["']http://""", "i")) & ~tag.contains("localhost"),
                        _found("warning", "http-link", F.concat(F.lit("HTTP link: "), F.regexp_extract(tag, java(r"""href=["']([^"']+)""", "i"), 1), F.lit(" — use HTTPS"))),
                    ),
                    F.when(
                        tag.rlike(java(r"""href=["']http""", "i"))
                        & tag.rlike(java(r"""target\s*=\s*["']_blank["']""", "i"))
                        & ~tag.rlike(java(r"""rel\s*=\s*["'][^"']*noopener""", "i")),
                        _found("warning", "missing-noopener", 'External link with target="_blank" missing rel="noopener"'),
                    ),
                )
            ),
        )
    )
    blocked = F.transform(blocking, lambda _: _found("warning", "render-blocking", "Render-blocking script in <head> — add async or defer"))
    everything = F.concat(F.array_compact(F.array(*rules)), blocked, image_hits, anchor_hits)
    return masked.select("project", "path", F.explode(everything).alias("_f")).select(
        "project", "path", F.lit("html-quality").alias("check"), "_f.rule", "_f.severity", "_f.message"
    )


def csp_and_sri(pages: DataFrame) -> DataFrame:
    """Pages without a content security policy; external scripts without integrity."""
    content = F.col("content")
    external = F.filter(
        F.regexp_extract_all("content", F.lit(java(r"""<script[^>]*src=["'][^"']*["'][^>]*>""")), F.lit(0)),
        lambda t: ~t.contains("integrity") & ~t.contains("localhost") & ~t.contains("/src/"),
    )
    csp = F.array_compact(
        F.array(F.when(~content.rlike("[Cc]ontent-[Ss]ecurity-[Pp]olicy"), _found("info", "CWE-1021", "No Content-Security-Policy meta tag in HTML")))
    )
    sri = F.transform(external, lambda _: _found("info", "CWE-829", "External script without subresource integrity (SRI)"))
    return pages.select("project", "path", F.explode(F.concat(csp, sri)).alias("_f")).select(
        "project", "path", F.lit("security").alias("check"), "_f.rule", "_f.severity", "_f.message"
    )


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Titles shared by several pages of a site."""
    titled = pages.where(F.col("content").rlike(TITLE)).select("project", title_of(F.col("content")).alias("title"))
    return titled.groupBy("project", "title").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > 1)


def heading_levels(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?i)<h(\d)"), F.lit(1)), lambda d: d.cast("int"))


def heading_skips(pages: DataFrame, first_only: bool = True) -> DataFrame:
    """Headings more than one level below the one before, in document order."""
    levels = mask_html(pages).select("project", "path", heading_levels(F.col("content")).alias("_h"))
    steps = F.filter(
        F.transform("_h", lambda h, i: F.struct((i + 1).alias("position"), F.get(F.col("_h"), i - 1).alias("before"), h.alias("level"))),
        lambda s: s["level"] > s["before"] + 1,
    )
    wanted = F.slice(steps, 1, 1) if first_only else steps
    return levels.select("project", "path", F.explode(wanted).alias("_s")).select(
        "project", "path", F.col("_s.position").alias("position"), F.col("_s.before").alias("before"), F.col("_s.level").alias("level")
    )


def links(pages: DataFrame) -> DataFrame:
    """Internal links with the site path they point to. ``url_path`` is the page's own path."""
    hrefs = F.regexp_extract_all("content", F.lit(LINK), F.lit(1))
    found = mask_html(pages).select("project", "path", "url_path", F.explode(hrefs).alias("href"))
    internal = found.where(~F.col("href").rlike(r"^(?:http|//|mailto:|#|javascript:)"))
    clean = internal.withColumn("clean", F.regexp_replace("href", r"[#?].*\z", "")).where(F.col("clean") != "")
    own = F.regexp_replace(dirname(F.col("url_path")), r"^/", "")
    target = F.when(F.col("clean").startswith("/"), F.regexp_replace("clean", "^/+", "")).otherwise(join_path(own, F.col("clean")))
    return clean.select("project", "path", "href", "clean", target.alias("target"))


def link_candidates(target: Column, href: Column) -> Column:
    """Paths a link may resolve to: itself, its index page, its .html form."""
    bare = F.regexp_replace(target, r"/+\z", "")
    last = F.substring_index(F.regexp_replace(href, r"/+\z", ""), "/", -1)
    has_extension = last.rlike(r"\.[^/.]+\z")
    folder = F.concat(bare, F.when(bare == "", "").otherwise("/"))
    index = F.when(href.endswith("/") | ~has_extension, F.array(F.concat(folder, F.lit("index.html")), F.concat(folder, F.lit("index.htm"))))
    named = F.when(~href.endswith("/") & ~has_extension, F.array(F.concat(bare, F.lit(".html")), F.concat(bare, F.lit(".htm"))))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(bare), F.coalesce(index, empty), F.coalesce(named, empty)))


def broken_links(pages: DataFrame) -> DataFrame:
    """Links none of whose candidates is a page of the site.

    Menus repeat the same targets on every page: the distinct (site, target) pairs are
    resolved, and only the unresolved ones meet the links again.
    """
    found = links(pages)
    known = pages.select("project", F.regexp_replace("url_path", r"^/+|/+\z", "").alias("candidate")).distinct()
    targets = found.select("project", "target", "clean").distinct()
    tried = targets.select("project", "target", "clean", F.explode(link_candidates(F.col("target"), F.col("clean"))).alias("candidate"))
    good = tried.join(known, ["project", "candidate"], "left_semi").select("project", "target", "clean").distinct()
    bad = targets.join(good, ["project", "target", "clean"], "left_anti")
    return found.join(bad, ["project", "target", "clean"], "left_semi").select("project", "path", "href", "target")


def missing_site_files(pages: DataFrame, required: tuple[str, ...] = ("robots.txt", "sitemap.xml")) -> DataFrame:
    """Sites without the files crawlers look for."""
    sites = pages.select("project").distinct().withColumn("missing", F.explode(F.array(*[F.lit(r) for r in required])))
    known = pages.select("project", F.regexp_replace("url_path", "^/+", "").alias("missing")).distinct()
    return sites.join(known, ["project", "missing"], "left_anti")


def id_references(files: DataFrame) -> DataFrame:
    """Repeated ids and label references to ids the same file does not have."""
    ids = F.regexp_extract_all("content", F.lit(java(r"""\bid=["']([^"'{}]+)["']""")), F.lit(1))
    refs = F.regexp_extract_all("content", F.lit(java(r"""\baria-labelledby=["']([^"']+)["']""")), F.lit(1))
    words = F.filter(F.flatten(F.transform(refs, lambda r: F.split(F.trim(r), r"\s+"))), lambda w: w != "")
    listed = files.select("project", "path", ids.alias("_ids"), words.alias("_refs"))
    repeated = F.filter(F.array_distinct("_ids"), lambda v: F.size(F.filter("_ids", lambda o: o == v)) > 1)
    rows = F.concat(
        F.transform(repeated, lambda v: F.struct(F.lit("duplicate-id").alias("rule"), v.alias("id"))),
        F.transform(F.array_except("_refs", "_ids"), lambda v: F.struct(F.lit("broken-aria-reference").alias("rule"), v.alias("id"))),
    )
    return listed.select("project", "path", F.explode(rows).alias("_r")).select("project", "path", "_r.rule", "_r.id")

"""Queries on HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.rules import SMELLS
from tidemark.operators import code as C
from tidemark.operators import findings as W
from tidemark.operators import pages as H
from tidemark.operators import rules as E
from tidemark.operators import scores as K
from tidemark.plans.registry import named
from tidemark.plans.views import LINES, PAGE_FILES, with_views
from tidemark.sources.corpus import page_files

PAGES = with_views(PAGE_FILES)
_DOM = (
    "dom AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script\\b([^>]*)>.*?</script>', '<script\\1></script>', 'g'), "
    "'(?is)<style\\b([^>]*)>.*?</style>', '<style\\1></style>', 'g'), '(?s)<!--.*?-->', '', 'g') AS dom, "
    "trim(regexp_extract(content, '(?i)<title[^>]*>([^<]*)</title>', 1)) AS title FROM files)"
)
_PAGE_RULES = (
    _DOM + """, found AS (
    SELECT project, path, 'missing-title' AS rule, 'error' AS severity FROM dom WHERE contains(content, '<head') AND NOT regexp_matches(content, '<title[^>]*>')
    UNION ALL SELECT project, path, 'short-title', 'warning' FROM dom WHERE contains(content, '<head') AND regexp_matches(content, '(?i)<title[^>]*>([^<]*)</title>') AND length(title) < 10
    UNION ALL SELECT project, path, 'missing-description', 'warning' FROM dom WHERE contains(content, '<head') AND NOT regexp_matches(content, '(?i)<meta\\s[^>]*name=["'']description["'']')
    UNION ALL SELECT project, path, 'missing-viewport', 'error' FROM dom WHERE contains(content, '<head') AND NOT regexp_matches(content, '(?i)<meta\\s[^>]*name=["'']viewport["'']')
    UNION ALL SELECT project, path, 'missing-charset', 'warning' FROM dom WHERE contains(content, '<head') AND NOT regexp_matches(content, '(?i)<meta\\s[^>]*charset')
    UNION ALL SELECT project, path, 'missing-og', 'info' FROM dom WHERE contains(content, '<head') AND NOT regexp_matches(content, '(?i)<meta\\s[^>]*property=["'']og:title["'']')
    UNION ALL SELECT project, path, 'missing-canonical', 'info' FROM dom WHERE contains(content, '<head') AND NOT regexp_matches(content, '(?i)<link\\s[^>]*rel=["'']canonical["'']')
    UNION ALL SELECT project, path, 'missing-favicon', 'info' FROM dom WHERE contains(content, '<head') AND NOT regexp_matches(content, '(?i)<link\\s[^>]*rel=["''](?:shortcut )?icon["'']')
    UNION ALL SELECT project, path, 'missing-lang', 'warning' FROM dom WHERE regexp_matches(dom, '<html[\\s>]') AND NOT regexp_matches(dom, '(?i)<html\\s[^>]*lang=')
    UNION ALL SELECT project, path, 'http-link', 'warning' FROM (SELECT project, path, unnest(regexp_extract_all(dom, '(?i)<a\\s[^>]*href=["'']([^"'']+)["''][^>]*>', 1)) AS href FROM dom)
      WHERE starts_with(href, 'http://') AND NOT contains(href, 'localhost'))"""
)


@named("page_findings", with_views(PAGE_FILES, _PAGE_RULES) + "SELECT project, path, rule, severity FROM found")
def page_findings(spark, sf_dir):
    return H.scan_pages(page_files(spark, sf_dir)).select("project", "path", "rule", "severity")


@named(
    "site_scores",
    with_views(PAGE_FILES, _PAGE_RULES) + """SELECT project, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
    CAST(greatest(0, 100 - 15 * count(*) FILTER (severity = 'error') - 5 * count(*) FILTER (severity = 'warning')) AS BIGINT) AS score FROM found GROUP BY project""",
)
def site_scores(spark, sf_dir):
    pages = page_files(spark, sf_dir)
    units = pages.groupBy("project").agg(F.count(F.lit(1)).alias("n")).withColumn("check", F.lit("html-quality"))
    return K.score_checks(H.scan_pages(pages), units).select("project", "errors", "warnings", "score")


@named(
    "csp_and_sri",
    PAGES + """SELECT project, path, 'CWE-1021' AS rule FROM files WHERE NOT regexp_matches(content, '[Cc]ontent-[Ss]ecurity-[Pp]olicy')
    UNION ALL SELECT project, path, 'CWE-829' FROM (SELECT project, path, unnest(regexp_extract_all(content, '<script[^>]*src=["''][^"'']*["''][^>]*>')) AS t FROM files)
    WHERE NOT contains(t, 'integrity') AND NOT contains(t, 'localhost') AND NOT contains(t, '/src/')""",
)
def csp_and_sri(spark, sf_dir):
    return H.csp_and_sri(page_files(spark, sf_dir)).select("project", "path", "rule")


@named(
    "duplicate_titles",
    PAGES + """SELECT project, trim(regexp_extract(content, '(?i)<title[^>]*>([^<]*)</title>', 1)) AS title, count(*) AS pages FROM files
    WHERE regexp_matches(content, '(?i)<title[^>]*>([^<]*)</title>') GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_titles(spark, sf_dir):
    return H.duplicate_titles(page_files(spark, sf_dir))


def _with_subheads(pages):
    """Bold text becomes a second-level heading and paragraphs fourth-level ones, so that levels are skipped."""
    content = F.replace(F.replace("content", F.lit("<b>"), F.lit("<h2>")), F.lit("<p>"), F.lit("<h4>"))
    return pages.withColumn("content", content)


_HEADS = """h AS (SELECT project, path, regexp_extract_all(replace(replace(content, '<b>', '<h2>'), '<p>', '<h4>'), '(?i)<h(\\d)', 1) AS h FROM files),
  s AS (SELECT project, path, unnest(generate_series(2, len(h))) AS position, h FROM h),
  skips AS (SELECT project, path, position, CAST(h[position - 1] AS BIGINT) AS before, CAST(h[position] AS BIGINT) AS level FROM s
    WHERE CAST(h[position] AS BIGINT) > CAST(h[position - 1] AS BIGINT) + 1)"""


@named("heading_skips", with_views(PAGE_FILES, _HEADS) + "SELECT * FROM skips")
def heading_skips(spark, sf_dir):
    return H.heading_skips(_with_subheads(page_files(spark, sf_dir)), first_only=False)


@named(
    "first_heading_skip",
    with_views(PAGE_FILES, _HEADS) + "SELECT project, path, min(position) AS position, arg_min(before, position) AS before, arg_min(level, position) AS level FROM skips GROUP BY project, path",
)
def first_heading_skip(spark, sf_dir):
    return H.heading_skips(_with_subheads(page_files(spark, sf_dir)))


_LINKS = """links AS (SELECT project, path, href, ltrim(regexp_replace(href, '[#?].*$', ''), '/') AS target, regexp_replace(href, '[#?].*$', '') AS clean
  FROM (SELECT project, path, unnest(regexp_extract_all(dom, '(?i)<a\\s[^>]*href=["'']([^"'']+)["''][^>]*>', 1)) AS href FROM dom)
  WHERE NOT regexp_matches(href, '^(?:http|//|mailto:|#|javascript:)') AND regexp_replace(href, '[#?].*$', '') <> '')"""


@named("page_links", with_views(PAGE_FILES, _DOM, _LINKS) + "SELECT project, count(*) AS links, count(DISTINCT target) AS targets FROM links GROUP BY project")
def page_links(spark, sf_dir):
    found = H.links(page_files(spark, sf_dir)).groupBy("project", "target").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("project").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("targets"))


_SITE = """files AS (SELECT regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) AS project, page_id || '.html' AS path,
  '/' || regexp_extract(html, '<a href="/([^"]*)"', 1) || CASE WHEN page_id % 3 = 0 THEN '.html' ELSE '' END AS url_path, html AS content FROM pages)"""


@named(
    "broken_links",
    with_views(_SITE, _DOM, _LINKS) + """, known AS (SELECT DISTINCT project, ltrim(url_path, '/') AS p FROM files)
    SELECT project, path, href, target FROM links l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.project = l.project AND
      (k.p = l.target OR (NOT regexp_matches(target, '\\.[^/.]+$') AND k.p IN (l.target || '.html', l.target || '.htm', l.target || '/index.html', l.target || '/index.htm'))))""",
)
def broken_links(spark, sf_dir):
    """Menu links of each page on a site where a page is published under its first menu entry."""
    pages = page_files(spark, sf_dir)
    first = F.regexp_extract("content", '<a href="/([^"]*)"', 1)
    number = F.regexp_extract("path", r"^(\d+)", 1).cast("bigint")
    site = pages.withColumn("project", F.regexp_extract("url_path", "^/([^/]*)", 1)).withColumn(
        "url_path", F.concat(F.lit("/"), first, F.when(number % 3 == 0, ".html").otherwise(""))
    )
    return H.broken_links(site)


@named(
    "missing_site_files",
    "SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project, unnest(['robots.txt', 'sitemap.xml']) AS missing FROM pages",
)
def missing_site_files(spark, sf_dir):
    return H.missing_site_files(page_files(spark, sf_dir))


@named(
    "id_references",
    PAGES + """, refs AS (SELECT project, path, regexp_extract_all(replace(replace(content, '<a href="/', '<a aria-labelledby="'), '<p>', '<p id="the">'), '\\bid=["'']([^"''{}]+)["'']', 1) AS ids,
      regexp_extract_all(replace(replace(content, '<a href="/', '<a aria-labelledby="'), '<p>', '<p id="the">'), '\\baria-labelledby=["'']([^"'']+)["'']', 1) AS refs FROM files)
    SELECT project, path, 'duplicate-id' AS rule, 'the' AS id FROM refs WHERE len(ids) > 1
    UNION ALL SELECT DISTINCT project, path, 'broken-aria-reference', r FROM (SELECT project, path, ids, unnest(refs) AS r FROM refs) WHERE NOT list_contains(ids, r)""",
)
def id_references(spark, sf_dir):
    """Menu links turned into label references, paragraphs all given the id "the"."""
    content = F.replace(F.replace("content", F.lit('<a href="/'), F.lit('<a aria-labelledby="')), F.lit("<p>"), F.lit('<p id="the">'))
    return H.id_references(page_files(spark, sf_dir).withColumn("content", content))


@named(
    "extracted_scripts",
    PAGES + """, s AS (SELECT *, list_filter(regexp_extract_all(content, '(?is)<script[^>]*>(.*?)</script>', 1), lambda b: b <> '') AS s FROM files)
    SELECT project, path, CASE WHEN len(s) > 0 THEN array_to_string(s, chr(10)) ELSE content END AS script, length(content) AS raw_characters FROM s""",
)
def extracted_scripts(spark, sf_dir):
    return C.extract_scripts(page_files(spark, sf_dir)).select(
        "project", "path", F.col("content").alias("script"), F.length("raw_content").alias("raw_characters")
    )


@named(
    "page_smells",
    with_views(PAGE_FILES, LINES) + """SELECT project, path, line_no, 'var keyword' AS rule FROM lines WHERE regexp_matches(line, '\\bvar\\s+\\w')
    UNION ALL SELECT project, path, line_no, 'loose equality' FROM lines WHERE regexp_matches(line, '[^!=]==[^=]') AND NOT regexp_matches(line, '[''"]use strict[''"]')
    UNION ALL SELECT project, path, line_no, 'TODO/FIXME' FROM lines WHERE regexp_matches(line, '\\b(TODO|FIXME|HACK|XXX)\\b')
    UNION ALL SELECT project, path, line_no, 'console.log' FROM lines WHERE regexp_matches(line, '\\bconsole\\.(log|debug|info)\\s*\\(') AND NOT regexp_matches(line, '// ?ok|eslint-disable|biome-ignore')
    UNION ALL SELECT project, path, line_no, 'magic number' FROM lines WHERE regexp_matches(line, '(?:timeout|delay|interval|limit|max|min)\\s*[:=]\\s*\\d{4,}')
    UNION ALL SELECT project, path, line_no, 'http:// URL' FROM lines WHERE regexp_matches(line, '[''"]http://') AND NOT regexp_matches(line, '[''"]http://(?:localhost|127\\.0\\.0\\.1|www\\.w3\\.org|schemas?\\.)')""",
)
def page_smells(spark, sf_dir):
    return E.scan_lines(E.to_lines(page_files(spark, sf_dir)), SMELLS).select("project", "path", "line_no", "rule")


@named(
    "sarif_results",
    with_views(PAGE_FILES, _PAGE_RULES) + """SELECT project, rule AS "ruleId", CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, path AS uri, count(*) AS results
    FROM found GROUP BY ALL""",
)
def sarif_results(spark, sf_dir):
    """The exported SARIF objects, read back."""
    found = H.scan_pages(page_files(spark, sf_dir)).withColumn("line_no", F.lit(None).cast("int"))
    text = W.sarif_results(found)
    read = lambda p: F.get_json_object("result", p)
    uri = read("$.locations[0].physicalLocation.artifactLocation.uri")
    return text.groupBy("project", read("$.ruleId").alias("ruleId"), read("$.level").alias("level"), uri.alias("uri")).agg(F.count(F.lit(1)).alias("results"))

"""Counts and ratios over source text, tests, exports and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.tables import (
    COPYLEFT_LICENSES,
    HARDCODED_COLOUR,
    ICON_LIBRARIES,
    PERMISSIVE_LICENSES,
    POOR_COMMIT_MESSAGE,
    SPACING_PROPERTY,
    STALE_REF_IGNORED,
    STYLE_APPROACHES,
    UNTESTED_NAMES,
)
from tidemark.functions import scoring as S
from tidemark.functions.regex import java
from tidemark.functions.text import basename, dirname, stem
from tidemark.operators.skew import numbered_runs, top_n_per_key

CHARS_PER_TOKEN = 3.5
MAX_FILE_TOKENS = 4000
MAX_IMPORTS = 15
EXPORT_PATTERNS = (
    # fixed values: what an exported name looks like
    r"export\s+(?:async\s+)?function\s+(\w+)",
    r"export\s+(?:const|let|var)\s+(\w+)",
    r"export\s+class\s+(\w+)",
    r"export\s+interface\s+(\w+)",
    r"export\s+type\s+(\w+)",
)
LOCAL_IMPORT = r"""(?:import|export)\s+(?:[\s\S]*?)\s+from\s+['"]([./][^'"]*)['"]"""
MOCKS = (
    r"\b(?:vi\.fn|jest\.fn|vi\.mock|jest\.mock|vi\.spyOn|jest\.spyOn|sinon\.(?:stub|spy|mock)"
    r"|\.mockResolvedValue|\.mockReturnValue|\.mockImplementation)\b"
)


def occurrences(pattern: str, column: str = "content", flags: str = "") -> Column:
    return F.regexp_count(column, F.lit(java(pattern, flags)))


def tokens_of(content: Column) -> Column:
    return F.floor(F.length(content) / CHARS_PER_TOKEN + 0.5).cast("bigint")


def token_density(files: DataFrame, *keys: str) -> DataFrame:
    """Estimated tokens: total, mean per file, files above the limit."""
    tokens = files.select(*(keys or ("project",)), tokens_of(F.col("content")).alias("t"))
    return tokens.groupBy(*(keys or ("project",))).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("t").alias("tokens"),
        S.round_half_up(F.sum("t") / F.count(F.lit(1))).alias("mean_tokens"),
        F.count_if(F.col("t") > MAX_FILE_TOKENS).alias("heavy_files"),
    )


def heavy_files(files: DataFrame) -> DataFrame:
    tokens = files.select("project", "path", tokens_of(F.col("content")).alias("tokens"))
    return tokens.where(F.col("tokens") > MAX_FILE_TOKENS)


def import_load(files: DataFrame) -> DataFrame:
    """Local imports and exports per file; heavy importers and context sinks."""
    imports = F.size(F.regexp_extract_all("content", F.lit(java(LOCAL_IMPORT)), F.lit(1)))
    counted = files.select("project", "path", imports.alias("imports"), occurrences(r"\bexport\s+").alias("exports"))
    return counted.withColumn("heavy", F.col("imports") > MAX_IMPORTS).withColumn(
        "sink", (F.col("imports") > 8) & (F.col("exports") <= 1)
    )


def exported_names(files: DataFrame) -> DataFrame:
    """Every exported name with its file."""
    found = F.concat(*[F.regexp_extract_all("content", F.lit(java(p)), F.lit(1)) for p in EXPORT_PATTERNS])
    return files.where(F.col("content").contains("export")).select("project", "path", F.explode(found).alias("name"))


def package_of(path: Column) -> Column:
    package = F.regexp_extract(path, r"^(?:packages|apps|libs|modules|internal)/[^/]+", 0)
    return F.when(package == "", ".").otherwise(package)


def export_collisions(files: DataFrame) -> DataFrame:
    """Names exported more than once inside one package."""
    names = exported_names(files).withColumn("package", package_of(F.col("path")))
    return (
        names.groupBy("project", "package", "name")
        .agg(F.count(F.lit(1)).alias("exports"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
        .where(F.col("exports") > 1)
    )


def duplicate_exports(files: DataFrame) -> DataFrame:
    """Exported functions of the same name, whatever the package."""
    names = F.regexp_extract_all("content", F.lit(java(EXPORT_PATTERNS[0])), F.lit(1))
    rows = files.where(F.col("content").contains("export")).select("project", "path", F.explode(names).alias("name"))
    return rows.groupBy("project", "name").agg(F.count(F.lit(1)).alias("exports"), F.min("path").alias("first_path")).where(
        F.col("exports") > 1
    )


def mixed_patterns(files: DataFrame) -> DataFrame:
    """Files that both throw errors and return null."""
    both = F.col("content").rlike(java(r"\bthrow\s+new\s+Error")) & F.col("content").rlike(java(r"return\s+null\b"))
    return files.where(both).select("project", "path")


def export_docs(files: DataFrame) -> DataFrame:
    """Exported declarations and whether the nearest of three lines above is a comment.

    The look-back reads the file's own line array, so no window is needed.
    """
    declared = java(r"^\s*export (?:function|async function|class|interface) ")
    lines = F.transform(F.split("content", "\n"), lambda l: F.trim(l))
    numbered = files.where(F.col("content").contains("export ")).select("project", "path", lines.alias("_l")).withColumn(
        "_at", F.filter(F.transform("_l", lambda l, i: F.when(l.rlike(declared), i + 1)), lambda v: v.isNotNull())
    )
    spread = numbered.select("project", "path", "_l", F.explode("_at").alias("line_no"))
    above = F.slice("_l", F.greatest(F.col("line_no") - 3, F.lit(1)), F.col("line_no") - F.greatest(F.col("line_no") - 3, F.lit(1)))
    nearest = F.element_at(F.concat(F.array(F.lit("")), F.filter(above, lambda l: l != "")), -1)
    documented = nearest.endswith("*/") | nearest.startswith("//") | nearest.startswith("/**") | nearest.startswith("* ")
    return spread.select("project", "path", "line_no", documented.alias("documented"))


def doc_coverage(files: DataFrame) -> DataFrame:
    docs = export_docs(files).groupBy("project").agg(
        F.count(F.lit(1)).alias("exports"), F.count_if("documented").alias("documented")
    )
    return docs.withColumn("percent", S.round_half_up(F.col("documented") / F.col("exports") * 100))


def docs_scores(files: DataFrame) -> DataFrame:
    """README length and sections, documented exports and changelog, 0.4 / 0.4 / 0.2."""
    lines = F.size(F.split("content", "\n"))
    readme = F.max(F.when(F.col("path") == "README.md", F.when(lines < 5, 30).when(lines < 20, 60).otherwise(100)))
    changelog = F.max(
        F.when(F.col("path").isin("CHANGELOG.md", "CHANGES.md"), 100).when(F.col("path").startswith(".changeset/"), 80)
    )
    parts = files.groupBy("project").agg(
        F.coalesce(readme, F.lit(0)).alias("readme"), F.coalesce(changelog, F.lit(30)).alias("changelog")
    )
    return (
        parts.join(doc_coverage(files).select("project", F.col("percent").alias("exports")), "project", "left")
        .withColumn("exports", F.coalesce("exports", F.lit(100)))
        .withColumn("score", S.docs_score(F.col("readme"), F.col("exports"), F.col("changelog")))
    )


def test_layers(tests: DataFrame) -> DataFrame:
    """Layer of every test file: end to end, integration, component or unit."""
    low, text = F.lower("path"), F.col("content")
    browser = text.rlike(java(r"\b(?:page|browser|navigate|goto|click|fill|expect\(page)\b")) & text.rlike("playwright|puppeteer|cypress")
    live = text.rlike(java(r"""\bfetch\(["']https?:""")) & ~text.rlike(r"mock|stub|spy|vi\.fn|jest\.fn")
    layer = (
        F.when(low.contains("/e2e/") | low.contains(".e2e.") | low.contains("/playwright/") | low.contains(".pw.") | browser, "e2e")
        .when(low.contains("integration") | low.contains(".int.") | live | text.rlike(java(r"\bglobalSetup\b")), "integration")
        .when(text.rlike(java(r"\b(?:render|screen|fireEvent|userEvent|@testing-library)\b")) | low.contains(".component."), "component")
        .otherwise("unit")
    )
    return tests.select(
        "project", "path", layer.alias("layer"),
        (occurrences(r"\bexpect\s*\(") + occurrences(r"\bassert[.(]")).alias("assertions"),
        occurrences(MOCKS).alias("mocks"),
        occurrences(r"\btoMatchSnapshot|toMatchInlineSnapshot\b").alias("snapshots"),
        occurrences(r"\b(?:it|test)\s*\(").alias("tests"),
    )


def test_pyramid(tests: DataFrame) -> DataFrame:
    return test_layers(tests).groupBy("project", "layer").agg(
        F.count(F.lit(1)).alias("files"), F.sum("assertions").alias("assertions")
    )


def test_quality(tests: DataFrame) -> DataFrame:
    """Assertions per test and the mock and snapshot ratios."""
    sums = test_layers(tests).groupBy("project").agg(
        F.sum("assertions").alias("assertions"), F.sum("mocks").alias("mocks"),
        F.sum("snapshots").alias("snapshots"), F.sum("tests").alias("tests"),
        F.sum(F.when(F.col("assertions") == 0, F.col("tests")).otherwise(0)).alias("unasserted"),
    )
    return (
        sums.withColumn("per_test", S.ratio(F.col("assertions"), F.col("tests"), 1))
        .withColumn("mock_ratio", S.ratio(F.col("mocks"), F.col("assertions"), 2))
        .withColumn("snapshot_ratio", S.ratio(F.col("snapshots"), F.col("assertions"), 2))
    )


def testing_score(layers, expected, execution, coverage, pairing_percent, quality) -> Column:
    """30 for the pyramid, 20 execution, 20 coverage, 15 pairing, 15 quality."""
    pyramid = F.when(expected > 0, S.round_half_up(layers / expected * 30)).otherwise(30)
    return S.round_half_up(
        S.clamp(
            pyramid + S.round_half_up(execution * 20) + S.round_half_up(F.coalesce(coverage, F.lit(0.0)) / 100 * 20)
            + S.round_half_up(pairing_percent / 100 * 15) + quality
        )
    )


def quality_points(per_test, mock_ratio, snapshot_ratio, unasserted) -> Column:
    return F.greatest(
        F.lit(0),
        F.lit(15) - F.when(per_test < 1, 5).otherwise(0) - F.when(mock_ratio > 0.5, 3).otherwise(0)
        - F.when(snapshot_ratio > 0.3, 3).otherwise(0) - F.when(unasserted > 0, 2).otherwise(0),
    )


def test_pairing(files: DataFrame) -> DataFrame:
    """Source files and whether a test file of the same base name exists; conventional names are exempt."""
    from tidemark.sources.policy import is_test_path

    ending = r"\.(?:ts|tsx|js|jsx)\z"
    tests = files.where(is_test_path(F.col("path"))).select(
        "project", F.regexp_replace(basename(F.col("path")), r"\.(?:test|spec|e2e|int)" + ending, "").alias("base")
    ).distinct().withColumn("paired", F.lit(True))
    sources = files.where(~is_test_path(F.col("path"))).select(
        "project", "path", F.regexp_replace(basename(F.col("path")), ending, "").alias("base")
    ).where(~F.col("base").isin(*UNTESTED_NAMES))
    return sources.join(tests, ["project", "base"], "left").select(
        "project", "path", F.coalesce("paired", F.lit(False)).alias("paired")
    )


def pairing_percent(pairing: DataFrame) -> DataFrame:
    return pairing.groupBy("project").agg(
        F.count(F.lit(1)).alias("sources"), F.count_if("paired").alias("paired"),
        S.round_half_up(F.count_if("paired") / F.count(F.lit(1)) * 100).alias("percent"),
    )


def large_files(files: DataFrame, soft_limit: int = 300) -> DataFrame:
    """Files above the line limit and the squared penalty of each project."""
    lines = files.select("project", F.size(F.split("content", "\n")).alias("n"))
    over = F.col("n") > soft_limit
    excess = (F.col("n") - soft_limit) / 100
    return lines.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(over).alias("large"),
        (F.floor(F.sum(F.when(over, excess * excess).otherwise(0.0)) * 100 + 0.5) / 100).alias("penalty"),
    )


def naming_convention(files: DataFrame) -> DataFrame:
    """Lower-case component files of projects whose components are mostly Pascal case."""
    # Both endings have four characters, so extension and stem are plain pieces of the name.
    name, rest = basename(F.col("path")), F.length(basename(F.col("path"))) - 4
    component = (F.endswith(name, F.lit(".tsx")) | F.endswith(name, F.lit(".jsx"))) & (rest > 0) & (F.substr(name, rest, F.lit(1)) != ".")
    components = files.where(component).select("project", "path", "content", F.substr(name, F.lit(1), rest).alias("base"))
    style = components.groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("base").rlike("^[A-Z]")).alias("pascal")
    ).where(~((F.col("n") >= 3) & (F.col("pascal") < F.col("n") / 2)))
    lower = F.col("base").rlike("^[a-z]") & ~F.col("base").isin("main", "index")
    exports = F.col("content").rlike(r"export (?:default )?(?:function|const) [A-Z]")
    return components.where(lower & exports).join(style, "project", "left_semi").select("project", "path")


def barrel_files(files: DataFrame) -> DataFrame:
    """Index files that are more than 80 % re-exports (three or more)."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda l: F.trim(l)), lambda l: l != "")
    exports = F.size(F.filter("_l", lambda l: l.rlike(r"^export\s")))
    return (
        files.where(stem(F.col("path")) == "index").select("project", "path", lines.alias("_l"))
        .select("project", "path", exports.alias("exports"), F.size("_l").alias("lines"))
        .where((F.col("exports") >= 3) & (F.col("exports") / F.col("lines") > 0.8))
    )


def commented_code(files: DataFrame) -> DataFrame:
    """Runs of three or more commented-out code lines.

    Runs are islands of consecutive line numbers among the code-like comment lines.
    """
    code = java(r"^\s*//\s*(?:const |let |var |function |return |if \(|for \(|\}|await |import |export |class )")
    kept = java(r"^\s*(?:///|//\s*(?:TODO|FIXME|HACK|NOTE|eslint|biome|ts-|@))")
    hits = F.filter(
        F.transform(F.split("content", "\n"), lambda l, i: F.when(l.rlike(code) & ~l.rlike(kept), i + 1)), lambda v: v.isNotNull()
    )
    lines = files.where(F.col("content").contains("//")).select("project", "path", F.explode(hits).alias("line_no"))
    runs = numbered_runs(lines, ["project", "path"], "line_no").where(F.col("size") >= 3)
    return runs.select("project", "path", F.col("start").alias("line_no"), F.col("size").alias("lines"))


def todo_comments(lines: DataFrame, as_of: Column) -> DataFrame:
    """TODO comments: stale when dated over six months before ``as_of``, else undated."""
    pattern = java(r"//\s*(TODO|FIXME|HACK|XXX|TEMP)\b[:\s]*(.*)", "i")
    text = F.regexp_extract("line", pattern, 2)
    found = lines.where(F.col("line").rlike(pattern)).select(
        "project", "path", "line_no", F.upper(F.regexp_extract("line", pattern, 1)).alias("tag"), text.alias("text"),
        F.regexp_extract(text, r"(?:^|\D)(20\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]20\d{2})(?:\D|\z)", 1).alias("written"),
    )
    plain = F.translate("written", "/", "-")
    date = F.coalesce(
        F.try_to_timestamp(plain, F.lit("yyyy-M-d")), F.try_to_timestamp(plain, F.lit("M-d-yyyy"))
    ).cast("date")
    months = F.datediff(as_of, date) / 30.0
    return (
        found.withColumn("months", S.round_half_up(months))
        .withColumn("rule", F.when(F.col("written") == "", "undated-todo").when(months > 6, "stale-todo"))
        .where(F.col("rule").isNotNull())
    )


def stale_refs(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Back-quoted names in documents that occur nowhere in the project's source text.

    The corpus is reduced to its distinct identifiers, so the check is an anti-join on
    (project, name) instead of a substring search in every file.
    """
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"`(\w{3,})`"), F.lit(1)))
    wanted = docs.select("project", "path", F.explode(names).alias("name")).where(
        F.col("name").rlike("^[a-z]") & (F.length("name") > 4) & ~F.lower("name").isin(*STALE_REF_IGNORED)
    )
    known = files.select("project", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("name")).distinct()
    return wanted.join(known, ["project", "name"], "left_anti").select("project", "path", "name")


def license_kind(text: Column) -> Column:
    """permissive, copyleft, expression or unknown."""
    squeezed = F.regexp_replace(text, r"\s+", "")
    return (
        F.when(text.isin(*PERMISSIVE_LICENSES) | squeezed.isin(*PERMISSIVE_LICENSES), "permissive")
        .when(squeezed.isin(*COPYLEFT_LICENSES) | text.rlike("(?i)GPL|AGPL|SSPL"), "copyleft")
        .when(text.rlike(r"^\(.*\)\z"), "expression")
        .otherwise("unknown")
    )


def license_audit(packages: DataFrame) -> DataFrame:
    """Copyleft and unknown licences; ``packages``: project, name, version, license."""
    declared = packages.where(F.coalesce("license", F.lit("")).isin("", "UNLICENSED") == F.lit(False))
    kinds = declared.withColumn("kind", license_kind(F.col("license")))
    return kinds.where(F.col("kind").isin("copyleft", "unknown"))


def license_lines(lines: DataFrame) -> DataFrame:
    """Licence statements in text, with the family they name."""
    family = (
        F.when(F.col("line").rlike("(?i)gnu|gpl"), "copyleft")
        .when(F.col("line").rlike("(?i)apache|mit license|bsd|isc license"), "permissive")
        .otherwise("unknown")
    )
    stated = F.col("line").rlike("(?i)licen[sc]ed under|under the .* license|copyright")
    return lines.where(stated).select("project", "path", "line_no", family.alias("family"))


def style_consistency(lines: DataFrame) -> DataFrame:
    """Styling approaches, inline share, hard-coded colours and off-scale spacing per project."""
    line = F.col("line")
    flags = [F.count_if(line.rlike(java(p))).alias(name.replace("-", "_")) for name, p in STYLE_APPROACHES]
    pixels = F.filter(
        F.transform(F.regexp_extract_all("line", F.lit(r"(\d+)px"), F.lit(1)), lambda v: v.cast("int")),
        lambda v: (v > 2) & (v % 4 != 0),
    )
    spaced = F.when(line.rlike(java(SPACING_PROPERTY)), pixels)
    rows = lines.where(~line.rlike(java(r"^\s*(?://|\*)")))
    sums = rows.groupBy("project").agg(
        *flags, F.count_if(line.contains("className")).alias("class_names"),
        F.count_if(line.rlike(java(HARDCODED_COLOUR)) & ~F.col("path").rlike(r"tailwind\.config|theme|tokens")).alias("colours"),
    )
    off = (
        rows.select("project", F.explode(spaced).alias("px")).distinct().groupBy("project")
        .agg(F.count(F.lit(1)).alias("off_scale"))
    )
    active = F.array_compact(F.array(*[F.when(F.col(n.replace("-", "_")) >= 3, F.lit(n)) for n, _ in STYLE_APPROACHES]))
    return (
        sums.join(off, "project", "left").withColumn("off_scale", F.coalesce("off_scale", F.lit(0)))
        .withColumn("approaches", F.array_join(active, ","))
        .withColumn("mixed", F.size(active) > 1)
        .withColumn("inline_ratio", S.ratio(F.col("inline"), F.col("inline") + F.col("class_names"), 2))
    )


def repeated_class_strings(lines: DataFrame, at_least: int = 3) -> DataFrame:
    text = F.trim(F.regexp_extract("line", java(r"""className\s*=\s*["'`]([^"'`]{20,})["'`]"""), 1))
    rows = lines.where(F.col("line").contains("className")).select("project", "path", text.alias("classes")).where(F.col("classes") != "")
    return rows.groupBy("project", "classes").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= at_least)


def mixed_libraries(lines: DataFrame) -> DataFrame:
    """Icon libraries per project; more than one is a finding."""
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(java(p)), F.lit(name)) for name, p in ICON_LIBRARIES]))
    used = lines.select("project", F.explode(hits).alias("library")).distinct()
    return used.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("library")), ",").alias("libraries"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") > 1
    )


def commit_quality(commits: DataFrame, n: int = 20) -> DataFrame:
    """Share of poor messages among the newest ``n`` commits of each project."""
    recent = top_n_per_key(commits, ["project"], [F.desc("committed_at"), F.desc("sha")], n)
    message = F.trim(F.col("message"))
    poor = (F.length(message) < 5) | F.lower(message).rlike(POOR_COMMIT_MESSAGE.replace("$", r"\z"))
    return recent.groupBy("project").agg(F.count(F.lit(1)).alias("commits"), F.count_if(poor).alias("poor")).withColumn(
        "flagged", F.col("poor") / F.col("commits") > 0.5
    )


def migration_audit(files: DataFrame) -> DataFrame:
    """Per directory: unnumbered and repeated migration numbers, unguarded drops."""
    number = F.regexp_extract(basename(F.col("path")), r"^(\d+)", 1)
    rows = files.select(
        "project", dirname(F.col("path")).alias("dir"), F.when(number != "", number.cast("bigint")).alias("n"),
        (F.col("content").rlike(java(r"\bDROP\s+TABLE\b", "i")) & ~F.col("content").rlike(java(r"IF\s+EXISTS", "i"))).alias("drop"),
    )
    numbers = rows.groupBy("project", "dir", "n").agg(F.count(F.lit(1)).alias("files"), F.count_if("drop").alias("drops"))
    return numbers.groupBy("project", "dir").agg(
        F.sum("files").alias("migrations"),
        F.sum(F.when(F.col("n").isNull(), F.col("files")).otherwise(0)).alias("unnumbered"),
        F.count_if(F.col("n").isNotNull() & (F.col("files") > 1)).alias("repeated_numbers"),
        F.sum("drops").alias("unsafe_drops"),
    )


def directory_sizes(files: DataFrame) -> DataFrame:
    """Bytes below every directory, counted at each level of the path."""
    from tidemark.sources.policy import path_prefixes

    per_dir = files.groupBy("project", dirname(F.col("path")).alias("dir")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"))
    spread = per_dir.select("project", "size", "files", F.explode(F.array_distinct(path_prefixes(F.col("dir")))).alias("dir"))
    return spread.groupBy("project", "dir").agg(F.sum("size").alias("bytes"), F.sum("files").alias("files"))


def clusters(files: DataFrame) -> DataFrame:
    """Directories with their file count and an order-free content hash.

    Each file contributes two 60-bit slices of its SHA-256 over path and text; they are
    combined with XOR and a sum, which combine map-side, so no directory is gathered.
    """
    digest = F.sha2(F.concat_ws("\x00", "path", "content"), 256)
    rows = files.select(
        "project", dirname(F.col("path")).alias("dir"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("a"),
        F.conv(F.substring(digest, 16, 15), 16, 10).cast("decimal(38,0)").alias("b"),
    )
    return rows.groupBy("project", "dir").agg(
        F.count(F.lit(1)).alias("files"), F.bit_xor("a").alias("x"), F.sum("b").alias("s")
    ).select("project", "dir", "files", F.substring(F.sha1(F.concat_ws("|", F.col("x").cast("string"), F.col("s").cast("string"))), 1, 16).alias("hash"))


def reusable_clusters(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Directories unchanged since ``previous(project, dir, hash)``: their stored findings still hold."""
    return current.join(previous.select("project", "dir", "hash"), ["project", "dir", "hash"], "left_semi")


def feature_map(clusters_: DataFrame, findings: DataFrame) -> DataFrame:
    """Directories with their findings: those with findings first, larger ones first."""
    counts = findings.groupBy("project", dirname(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("findings"))
    joined = clusters_.join(counts, ["project", "dir"], "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("bigint"))
    return joined.orderBy((F.col("findings") == 0).cast("int"), F.desc("files"), "project", "dir")

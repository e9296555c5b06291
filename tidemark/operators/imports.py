"""Import extraction, resolution and reconciliation of declared and used names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.tables import (
    ENTRYPOINTS,
    EXEMPT_FRAMEWORKS,
    HEAVY_PACKAGES,
    IMPORT_EXTENSIONS,
    RUNTIME_CSS_PACKAGES,
    SANITIZER_MODULES,
    UI_FRAMEWORKS,
)
from tidemark.functions.regex import java
from tidemark.functions.text import basename, dirname

# fixed values: the three ways a module is imported
TYPE_IMPORT = r"""(?:import|export)\s+type\s+[^'"`;]*?\s+from\s+['"]([^'"]+)['"]"""
STATIC_IMPORT = r"""(?:import|export)\s+(?!type\b)[^'"`;()]*?\s+from\s+['"]([^'"]+)['"]"""
BARE_IMPORT = r"""(?:^|\n)\s*import\s+['"]([^'"]+)['"]"""
DYNAMIC_IMPORT = r"""\bimport\s*\(\s*['"]([^'"]+)['"]"""


def specifiers(files: DataFrame) -> DataFrame:
    """Every import specifier of every file with its layer: static, type or dynamic."""

    def found(pattern: str, kind: str) -> Column:
        return F.transform(
            F.array_distinct(F.regexp_extract_all("content", F.lit(java(pattern)), F.lit(1))),
            lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("specifier")),
        )

    every = F.array_distinct(
        F.concat(found(STATIC_IMPORT, "static"), found(BARE_IMPORT, "static"), found(TYPE_IMPORT, "type"), found(DYNAMIC_IMPORT, "dynamic"))
    )
    likely = F.col("content").contains("import") | F.col("content").contains("export")
    return files.where(likely).select("project", "path", F.explode(every).alias("_s")).select("project", "path", "_s.kind", "_s.specifier")


def join_path(directory: Column, relative: Column) -> Column:
    """``a/b`` + ``../c`` -> ``a/c``."""
    steps = F.concat(F.split(F.when(directory == ".", "").otherwise(directory), "/"), F.split(relative, "/"))
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.array_append(acc, s)),
    )
    return F.array_join(kept, "/")


def import_edges(files: DataFrame) -> DataFrame:
    """Resolved local imports: project, src, dst, kind; self imports are dropped.

    Many files import the same module, so the distinct targets are resolved first
    (first existing candidate wins) and the edges then look up one row per target.
    """
    local = specifiers(files).where(F.col("specifier").startswith("./") | F.col("specifier").startswith("../") | F.col("specifier").startswith("/"))
    target = F.when(F.col("specifier").startswith("/"), F.substring("specifier", 2, 10**6)).otherwise(join_path(dirname(F.col("path")), F.col("specifier")))
    wanted = local.select("project", F.col("path").alias("src"), "kind", target.alias("target"))
    exact = F.col("target").rlike(r"\.(?:vue|svelte|ts|tsx|js|jsx)\z")
    names = [F.concat("target", F.lit(e)) for e in IMPORT_EXTENSIONS] + [F.concat("target", F.lit("/index" + e)) for e in (".ts", ".tsx")]
    candidates = F.when(exact, F.array("target")).otherwise(F.array(*names))
    tried = wanted.select("project", "target").distinct().select("project", "target", F.posexplode(candidates).alias("priority", "path"))
    hits = tried.join(files.select("project", "path"), ["project", "path"])
    resolved = hits.groupBy("project", "target").agg(F.min_by("path", "priority").alias("dst"))
    return wanted.join(resolved, ["project", "target"]).where(F.col("src") != F.col("dst")).select("project", "src", "dst", "kind").distinct()


def edge_layers(edges: DataFrame) -> DataFrame:
    """Edges of the three graphs: static alone, static + type, static + dynamic."""
    layer = (
        F.when(F.col("kind") == "static", F.array(F.lit("static"), F.lit("type"), F.lit("dynamic")))
        .otherwise(F.array("kind"))
    )
    return edges.withColumn("layer", F.explode(layer)).drop("kind").distinct()


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files nobody imports, entry points aside."""
    imported = edges.select("project", F.col("dst").alias("path")).distinct()
    return files.where(~basename(F.col("path")).isin(*ENTRYPOINTS)).select("project", "path").join(imported, ["project", "path"], "left_anti")


def reconcile(declared: DataFrame, used: DataFrame, known: DataFrame, key: str = "name") -> DataFrame:
    """Declared but unused (warning), used but undeclared (error), used and known elsewhere (info)."""
    by = ["project", key]
    d = declared.select(*by).distinct().withColumn("_d", F.lit(True))
    u = used.select(*by).distinct().withColumn("_u", F.lit(True))
    k = known.select(*by).distinct().withColumn("_k", F.lit(True))
    rows = d.join(u, by, "full").join(k, by, "left")
    rule = (
        F.when(F.col("_u").isNull(), "unused-binding")
        .when(F.col("_d").isNull() & F.col("_k").isNotNull(), "secret-binding")
        .when(F.col("_d").isNull(), "undeclared-binding")
    )
    severity = F.when(rule == "unused-binding", "warning").when(rule == "secret-binding", "info").otherwise("error")
    return rows.select(*by, rule.alias("rule"), severity.alias("severity")).where(F.col("rule").isNotNull())


def env_references(files: DataFrame) -> DataFrame:
    """Names read from ``env`` in source text."""
    names = F.concat(
        F.regexp_extract_all("content", F.lit(java(r"\benv\.([A-Z][A-Z0-9_]{1,40})\b")), F.lit(1)),
        F.regexp_extract_all("content", F.lit(java(r"""\benv\[["']([A-Z][A-Z0-9_]{1,40})["']\]""")), F.lit(1)),
    )
    return files.where(F.col("content").contains("env")).select("project", F.explode(F.array_distinct(names)).alias("name")).distinct()


def declared_bindings(configs: DataFrame) -> DataFrame:
    """Variables and bindings declared in worker configuration text."""
    bindings = F.regexp_extract_all("content", F.lit(r"""(?m)^\s*binding\s*=\s*"([A-Za-z_][A-Za-z0-9_]*)\""""), F.lit(1))
    section = F.regexp_extract("content", r"(?s)\[vars\]\n(.*?)(?=\n\[|\z)", 1)
    variables = F.regexp_extract_all(section, F.lit(r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\""), F.lit(1))
    return configs.select("project", F.explode(F.array_distinct(F.concat(bindings, variables))).alias("name")).distinct()


def env_keys(files: DataFrame) -> DataFrame:
    keys = F.regexp_extract_all("content", F.lit(r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*="), F.lit(1))
    return files.select("project", F.explode(F.array_distinct(keys)).alias("name")).distinct()


def key_drift(real: DataFrame, example: DataFrame) -> DataFrame:
    """Keys present on one side only: undocumented (warning) or possibly missing (info)."""
    by = ["project", "name"]
    a = real.select(*by).distinct().withColumn("_a", F.lit(True))
    b = example.select(*by).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, by, "full")
    side = F.when(F.col("_b").isNull(), "undocumented").when(F.col("_a").isNull(), "missing")
    return both.select(*by, side.alias("drift"), F.when(side == "undocumented", "warning").otherwise("info").alias("severity")).where(
        F.col("drift").isNotNull()
    )


def dependency_catalogue(deps: DataFrame) -> DataFrame:
    """Heavy, runtime-CSS and non-ESM packages among ``deps(project, name)``."""
    spark = deps.sparkSession
    heavy = [(n, "heavy-dependency", "warning", f"{n} (~{kb}KB) — consider {alt}") for n, kb, alt in HEAVY_PACKAGES]
    css = [(n, "runtime-css", "info", f"{n} adds runtime CSS overhead") for n in RUNTIME_CSS_PACKAGES]
    catalogue = spark.createDataFrame(heavy + css, "name string, rule string, severity string, message string")
    listed = deps.select("project", "name").distinct().join(F.broadcast(catalogue), "name")
    plain = deps.where(F.col("name").isin("lodash", "lodash-es")).groupBy("project").agg(F.max("name").alias("m"), F.min("name").alias("name"))
    non_esm = plain.where(F.col("m") == "lodash").select(
        "name", "project", F.lit("non-esm-dep").alias("rule"), F.lit("warning").alias("severity"),
        F.lit("lodash (not lodash-es) — CommonJS build defeats tree-shaking").alias("message"),
    )
    return listed.unionByName(non_esm).select("project", "name", "rule", "severity", "message")


def framework_conflicts(deps: DataFrame) -> DataFrame:
    """Projects using two or more UI frameworks that exclude each other."""
    catalogue = deps.sparkSession.createDataFrame(list(UI_FRAMEWORKS), "name string, framework string")
    used = deps.select("project", "name").join(F.broadcast(catalogue), "name").where(~F.col("framework").isin(*EXEMPT_FRAMEWORKS))
    return (
        used.groupBy("project").agg(F.array_sort(F.collect_set("framework")).alias("_f")).where(F.size("_f") > 1)
        .select("project", F.array_join("_f", " + ").alias("frameworks"))
    )


def sanitizer_imports(files: DataFrame) -> DataFrame:
    """Files that import a module whose output is escaped or sanitised."""
    name = F.col("specifier")
    label = None
    for pattern, text in SANITIZER_MODULES:
        hit = name.rlike(java(pattern, "i"))
        label = F.when(hit, text) if label is None else label.when(hit, text)
    rows = specifiers(files).where(~name.rlike(r"(?i)\.(?:css|scss|sass|less)\z")).select("project", "path", label.alias("sanitizer"))
    return rows.where(F.col("sanitizer").isNotNull()).groupBy("project", "path").agg(F.min("sanitizer").alias("sanitizer"))


def grade_html_sinks(findings: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Raw-HTML findings become info in files that import a sanitiser."""
    sink = F.col("message").contains("dangerouslySetInnerHTML")
    joined = findings.join(sanitizers, ["project", "path"], "left")
    safe = sink & F.col("sanitizer").isNotNull()
    return joined.withColumn("severity", F.when(safe, "info").otherwise(F.col("severity"))).select(*findings.columns, "sanitizer")

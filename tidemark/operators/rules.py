"""The rule engine: six rule shapes applied to lines or whole files.

Every shape is one projection over its input: the pack becomes an array of rule
numbers, one exploded row per rule that fires. No shape joins or shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.rules import CONCERNS, CloserRule, Pack, Rule
from tidemark.functions.regex import java

FINDING = ["project", "path", "line_no", "line", "check", "rule", "severity", "message", "seq"]
_RULES_PER_STEP = 48  # keeps one projection below the generated-code limits


def to_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(
        "project", "path", F.posexplode(F.split("content", "\n")).alias("_pos", "line")
    ).select("project", "path", (F.col("_pos") + 1).alias("line_no"), "line")


def skip_lines(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Lines none of the skip predicates matches."""
    for pattern in patterns:
        lines = lines.where(~F.col("line").rlike(java(pattern)))
    return lines


def _fires(rule: Rule, line: Column, path: Column) -> Column:
    hit = line.rlike(java(rule.pattern, rule.flags))
    if rule.needles:
        text = F.lower(line) if "i" in rule.flags else line
        cheap = text.contains(rule.needles[0])
        for needle in rule.needles[1:]:
            cheap = cheap | text.contains(needle)
        hit = cheap & hit
    if rule.paths:
        hit = path.rlike(java(rule.paths)) & hit
    if rule.exclude:
        hit = hit & ~line.rlike(java(rule.exclude))
    return hit


def _label(df: DataFrame, rules: Sequence, index: str) -> DataFrame:
    """Turn a rule number into its catalogue columns."""

    def pick(attribute: str) -> Column:
        return F.element_at(F.array(*[F.lit(getattr(r, attribute)) for r in rules]), F.col(index) + 1)

    return (
        df.withColumn("check", pick("check"))
        .withColumn("rule", pick("rule"))
        .withColumn("severity", pick("severity"))
        .withColumn("message", pick("message"))
    )


def _numbers(conditions: Sequence[Column], first: int) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(first + i)) for i, c in enumerate(conditions)]))


def scan_lines(lines: DataFrame, pack: Pack) -> DataFrame:
    """At most one finding per rule and line.

    The pack's skip predicates are tested inside the array of rules that fired, that
    is only on lines where one did, which is far fewer than all lines.
    """
    skipped = F.lit(False)
    for pattern in pack.skip:
        skipped = skipped | F.col("line").rlike(java(pattern))
    parts = []
    for first in range(0, len(pack.rules), _RULES_PER_STEP):
        block = pack.rules[first : first + _RULES_PER_STEP]
        numbers = _numbers([_fires(r, F.col("line"), F.col("path")) for r in block], first)
        kept = F.filter(numbers, lambda _: ~skipped) if pack.skip else numbers
        parts.append(lines.select("project", "path", "line_no", "line", F.explode(kept).alias("seq")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _label(found, pack.rules, "seq").select(*FINDING)


def scan_occurrences(lines: DataFrame, pack: Pack) -> DataFrame:
    """One finding per match, with the rule's weight.

    Directive rules (``@…``) are also looked for inside comment lines.
    """
    kept = skip_lines(lines, pack.skip)
    comment = F.col("line").rlike(java(r"^\s*//"))
    counts = []
    for i, rule in enumerate(pack.rules):
        n = F.regexp_count("line", F.lit(java(rule.pattern, rule.flags)))
        allowed = F.lit(True) if rule.message.startswith("@ts-") else ~comment
        cheap = F.lit(False)
        for needle in rule.needles:
            cheap = cheap | F.col("line").contains(needle)
        gate = allowed & (cheap if rule.needles else F.lit(True))
        counts.append(F.when(gate & F.col("line").rlike(java(rule.pattern, rule.flags)), F.struct(F.lit(i).alias("seq"), n.alias("n"))))
    hits = kept.select("project", "path", "line_no", "line", F.explode(F.array_compact(F.array(*counts))).alias("_h"))
    each = hits.select("project", "path", "line_no", "line", "_h.seq", F.explode(F.sequence(F.lit(1), F.col("_h.n"))).alias("nth"))
    weights = F.element_at(F.array(*[F.lit(float(r.weight)) for r in pack.rules]), F.col("seq") + 1)
    return _label(each, pack.rules, "seq").withColumn("weight", weights).select(*FINDING, "nth", "weight")


def first_matching_line(content: Column, pattern: str) -> Column:
    """1-based number of the first line matching, null when there is none."""
    flags = F.transform(F.split(content, "\n"), lambda l: l.rlike(java(pattern)))
    at = F.array_position(flags, True)
    return F.when(at > 0, at.cast("int"))


def scan_files(files: DataFrame, rules: Sequence[CloserRule]) -> DataFrame:
    """Opener present and every closer absent; placed on the first opener line."""
    content = F.col("content")
    hits = []
    for i, rule in enumerate(rules):
        fires = content.rlike(java(rule.opener))
        for closer in rule.closers:
            fires = fires & ~content.contains(closer)
        if rule.unless:
            fires = fires & ~content.rlike(java(rule.unless))
        hits.append(F.when(fires, F.struct(F.lit(i).alias("seq"), first_matching_line(content, rule.opener).alias("line_no"))))
    found = files.select("project", "path", F.explode(F.array_compact(F.array(*hits))).alias("_h"))
    return _label(found.select("project", "path", "_h.seq", "_h.line_no"), rules, "seq").select(
        "project", "path", "line_no", "check", "rule", "severity", "message", "seq"
    )


def line_windows(files: DataFrame, trigger: str, before: int, after: int, gate: str | None = None) -> DataFrame:
    """Lines matching ``trigger`` with their surroundings, for rules that look around.

    Returns the trimmed line, the ``before`` lines above it (``above``) and the line
    itself with the ``after - 1`` lines below it (``below``), each joined by newlines.
    """
    content = F.col("content")
    kept = files.where(content.rlike(java(gate or trigger, "m")))  # multi-line: the trigger may sit on any line
    split = kept.select("project", "path", F.split("content", "\n").alias("_lines"))
    numbered = split.withColumn(
        "_at",
        F.filter(
            F.transform("_lines", lambda l, i: F.when(l.rlike(java(trigger)), i + 1)), lambda v: v.isNotNull()
        ),
    )
    spread = numbered.select("project", "path", "_lines", F.explode("_at").alias("line_no"))
    at = F.col("line_no")
    start = F.greatest(at - before, F.lit(1))
    return spread.select(
        "project",
        "path",
        "line_no",
        F.element_at("_lines", at).alias("line"),
        F.array_join(F.slice("_lines", start, at - start), "\n").alias("above"),
        F.array_join(F.slice("_lines", at, F.lit(after)), "\n").alias("below"),
    )


def scan_window(
    files: DataFrame,
    check: str,
    rule: str,
    severity: str,
    message: str,
    trigger: str,
    fires: Callable[[Column, Column, Column], Column],
    before: int = 0,
    after: int = 1,
    skip: Sequence[str] = (),
) -> DataFrame:
    """A rule decided from the lines around its trigger: ``fires(line, above, below)``."""
    around = skip_lines(line_windows(files, trigger, before, after), skip)
    found = around.where(fires(F.col("line"), F.col("above"), F.col("below")))
    return found.select(
        "project", "path", "line_no", "line",
        F.lit(check).alias("check"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        F.lit(message).alias("message"), F.lit(0).alias("seq"),
    )


def unsafe_json_parse(files: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """``JSON.parse`` of outside data with no ``try`` in the twenty lines above."""
    outside = java(r"\b(?:body|response|res|request|req|text|data|payload|input|event|stdout)\b|\.text\(\)|\.json\(\)")
    known = java(r'package\.json|tsconfig|\.json"')
    return scan_window(
        files, "error-handling", "unsafe-json-parse", "warning",
        "JSON.parse of external data without try-catch — crashes on malformed input",
        r"\bJSON\.parse\s*\(",
        lambda line, above, below: line.rlike(outside) & ~line.rlike(known) & ~above.contains("try"),
        before=20, skip=skip,
    )


def infinite_loops(files: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """An endless loop head with no ``break`` or ``return`` in twenty lines."""
    return scan_window(
        files, "error-handling", "infinite-loop", "error",
        "Potential infinite loop — no break or return found within 20 lines",
        r"\bwhile\s*\(\s*true\s*\)|\bfor\s*\(\s*;\s*;\s*\)",
        lambda line, above, below: ~below.contains("break") & ~below.contains("return"),
        after=20, skip=skip,
    )


def regrade_cors(findings: DataFrame) -> DataFrame:
    """Wildcard CORS becomes info unless the surroundings send credentials.

    Needs a ``context`` column with the lines around the finding.
    """
    cors = F.col("message").contains("Access-Control-Allow-Origin") | F.col("message").startswith("CORS allows")
    credentialed = F.col("context").rlike(
        java(r"""Access-Control-Allow-Credentials["']?\s*[:,]\s*["']?true|\bcredentials\s*:\s*["']include["']""", "i")
    )
    public = F.col("context").rlike(java(r"\b(?:llms\.txt|skills\.json|\.well-known|metadata|manifest|public docs?|static metadata)\b", "i"))
    severity = F.when(cors & credentialed, "warning").when(cors, "info").otherwise(F.col("severity"))
    message = (
        F.when(cors & credentialed, "Credentialed CORS uses wildcard origin — browsers reject this and it may expose API intent incorrectly")
        .when(cors & public, "Public metadata endpoint uses wildcard CORS without credentials")
        .when(cors, "Wildcard CORS without credentials — verify the response is intentionally public")
        .otherwise(F.col("message"))
    )
    return findings.withColumn("severity", severity).withColumn("message", message)


def regrade_storage(findings: DataFrame) -> DataFrame:
    """Browser-storage findings: UI preferences dropped, sensitive keys raised."""
    line = F.col("line")
    store = F.regexp_extract(line, r"\b(localStorage|sessionStorage)\.setItem", 1)
    key = F.regexp_extract(line, java(r"""Storage\.setItem\s*\(\s*["'`]([^"'`]+)["'`]"""), 1)
    value = F.regexp_extract(line, java(r"Storage\.setItem\s*\(\s*[^,]+\s*,\s*(.*)"), 1)
    sensitive_key = key.rlike(r"(?i)(?:^|[:._-])(?:access|auth|bearer|credential|jwt|oauth|password|refresh|secret|session|token)(?:$|[:._-])")
    preference_key = key.rlike(
        r"(?i)(?:^|[:._-])(?:appearance|drawer|filter|font|fontsize|font-size|language|last-route|lastroute|layout|locale"
        r"|onboarding|preference|preferences|prefs|route|sidebar|sort|tab|text-scale|textscale|theme|timezone|tour|ui|view)(?:$|[:._-])"
    )
    sensitive_value = value.rlike(java(r"\b(?:accessToken|apiKey|auth|bearer|credential|jwt|password|refreshToken|secret|session|token)\b", "i"))
    storage = (F.col("rule") == "CWE-922") & (store != "")
    dropped = storage & preference_key & ~sensitive_value
    raised = storage & (sensitive_key | sensitive_value)
    place = F.when(store == "localStorage", "localStorage (persistent browser storage)").otherwise("sessionStorage (browser session storage)")
    message = F.concat(F.lit("Auth/session-like key or value in "), place, F.lit(" — accessible to XSS. Prefer HttpOnly cookies"))
    return (
        findings.where(~dropped)
        .withColumn("severity", F.when(raised, F.when(store == "localStorage", "error").otherwise("warning")).otherwise(F.col("severity")))
        .withColumn("message", F.when(raised, message).otherwise(F.col("message")))
    )


def scan_concerns(files: DataFrame, groups: Mapping[str, Sequence[str]] = CONCERNS, min_lines: int = 100) -> DataFrame:
    """Files touching two or more topic groups; three or more is an error."""
    content = F.col("content")
    hits = []
    for name, patterns in groups.items():
        any_hit = content.rlike(java(patterns[0]))
        for pattern in patterns[1:]:
            any_hit = any_hit | content.rlike(java(pattern))
        hits.append(F.when(any_hit, F.lit(name)))
    size = F.size(F.split("content", "\n"))
    return (
        files.where(size >= min_lines)
        .select("project", "path", size.alias("lines"), F.array_compact(F.array(*hits)).alias("concerns"))
        .where(F.size("concerns") >= 2)
        .select(
            "project", "path", "lines",
            F.size("concerns").alias("n_concerns"),
            F.array_join("concerns", ", ").alias("concerns"),
            F.when(F.size("concerns") >= 3, "error").otherwise("warning").alias("severity"),
        )
    )


def require_present(projects: DataFrame, files: DataFrame, required: DataFrame) -> DataFrame:
    """Required files a project lacks. ``required``: kind, path, required, description."""
    wanted = projects.join(required, "kind")
    return wanted.join(files.select("project", "path").distinct(), ["project", "path"], "left_anti").select(
        "project",
        F.col("path").alias("missing"),
        F.when(F.col("required"), "error").otherwise("warning").alias("severity"),
        F.concat(F.lit("Missing "), F.col("path"), F.lit(" — "), F.col("description")).alias("message"),
    )


def adherence(practices: DataFrame) -> DataFrame:
    """Followed / checked practices and the severity-weighted score per project."""
    broken = ~F.col("followed")
    cost = F.when(F.col("severity") == "error", 15).when(F.col("severity") == "warning", 8).otherwise(2)
    return practices.groupBy("project").agg(
        F.count(F.lit(1)).alias("practices"),
        F.count_if("followed").alias("followed"),
        F.greatest(F.lit(0), F.lit(100) - F.sum(F.when(broken, cost).otherwise(0))).cast("bigint").alias("score"),
    )

"""Rules that read more than one line: blocks, neighbouring lines, whole files, whole projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.tables import BINARY_EXTENSIONS
from tidemark.functions.regex import java
from tidemark.functions.text import extension
from tidemark.operators.rules import line_windows, scan_window
from tidemark.operators.textmetrics import MOCKS, occurrences

COLUMNS = ["project", "path", "line_no", "check", "rule", "severity", "message"]


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _finding(check: str, rule: Column | str, severity: Column | str, message: Column | str) -> Column:
    col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(check).alias("check"), col(rule).alias("rule"), col(severity).alias("severity"), col(message).alias("message"))


def blocks(files: DataFrame, trigger: str, reach: int) -> DataFrame:
    """Trigger lines with the lines inside the braces they open, at most ``reach`` lines on.

    The brace depth is folded over the few lines below the trigger; on the trigger line
    itself only what follows the match counts.
    """
    around = line_windows(files, trigger, 0, reach)
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("body")
    )

    def step(acc: Column, line: Column) -> Column:
        depth = (acc["depth"] + _count(line, "{") - _count(line, "}")).cast("int")
        opened = acc["open"] | line.contains("{")
        body = F.when(acc["open"], F.array_append(acc["body"], line)).otherwise(acc["body"])
        return F.when(acc["done"], acc).otherwise(
            F.struct(depth.alias("depth"), opened.alias("open"), (opened & (depth <= 0)).alias("done"), body.alias("body"))
        )

    head = F.regexp_replace(F.col("line"), "^.*?(?=" + java(trigger).lstrip("^") + ")", "")
    below = F.concat(F.array(head), F.slice(F.split("below", "\n"), 2, reach))
    return around.select("project", "path", "line_no", "line", F.array_join(F.aggregate(below, start, step)["body"], "\n").alias("body"))


# fixed values: assertions that always hold, and those that only test existence
TRIVIAL = (
    r"expect\s*\(\s*true\s*\)\s*\.toBe\s*\(\s*true\s*\)", r"expect\s*\(\s*false\s*\)\s*\.toBe\s*\(\s*false\s*\)", r"expect\s*\(\s*1\s*\)\s*\.toBe\s*\(\s*1\s*\)",
    r"""expect\s*\(\s*"[^"]*"\s*\)\s*\.toBe\s*\(\s*"[^"]*"\s*\)""", r"expect\s*\(\s*null\s*\)\s*\.toBeNull\s*\(\s*\)", r"expect\s*\(\s*undefined\s*\)\s*\.toBeUndefined\s*\(\s*\)",
)
WEAK = r"\.(?:toBeDefined|toBeTruthy|not\.toBeNull|not\.toBeUndefined|toBeInstanceOf)\s*\("


def audit_tests(tests: DataFrame) -> DataFrame:
    """Test blocks that are empty, assert nothing, assert the obvious, or mostly mock."""
    counted = blocks(tests, r"^\s*(?:it|test)\s*\(", 40).select(
        "project", "path", "line_no", "body",
        (F.length(F.regexp_replace("body", r"[});\s]", "")) == 0).alias("empty"),
        (occurrences(r"\bexpect\s*\(", "body") + occurrences(r"\bassert[.(]", "body") + occurrences(r"\bshould\.", "body")).alias("asserts"),
        sum((F.col("body").rlike(java(p)).cast("int") for p in TRIVIAL), F.lit(0)).alias("trivial"),
        occurrences(WEAK, "body").alias("weak"), occurrences(MOCKS, "body").alias("mocks"),
    )
    n = F.col("asserts").cast("string")
    first = (
        F.when(F.col("empty"), _finding("test-audit", "empty-test", "warning", "Empty test body — no assertions, no logic"))
        .when(F.col("asserts") == 0, _finding("test-audit", "no-assertions", "warning", "Test has no assertions — it always passes"))
        .when(
            (F.col("trivial") > 0) & (F.col("trivial") >= F.col("asserts")),
            _finding("test-audit", "trivial-assertions", "warning", F.concat(F.lit("All "), n, F.lit(" assertion(s) are trivial — testing constants, not behavior"))),
        )
    )
    weak = F.when(
        (F.col("weak") > 0) & (F.col("weak") >= F.col("asserts")),
        _finding("test-audit", "weak-assertions", "info", F.concat(F.lit("All "), n, F.lit(" assertion(s) are weak — only checks existence, not correctness"))),
    )
    mocked = F.when(
        F.col("mocks") > F.col("asserts") * 2,
        _finding("test-audit", "mock-heavy", "info", F.concat(F.lit("Mock-heavy: "), F.col("mocks").cast("string"), F.lit(" mocks vs "), n, F.lit(" assertions — may be testing mocks, not code"))),
    )
    found = F.when(first.isNotNull(), F.array(first)).otherwise(F.array_compact(F.array(weak, mocked)))
    return counted.select("project", "path", "line_no", F.explode(found).alias("_f")).select("project", "path", "line_no", "_f.*")


def fallback_catches(files: DataFrame) -> DataFrame:
    """Catch blocks of four or more lines that call something other than a logger."""
    bodies = blocks(files, r"\bcatch\s*[({]", 20).withColumn("_lines", F.split("body", "\n"))
    calls = F.exists("_lines", lambda l: l.rlike(r"\w+\s*\(") & ~l.rlike(r"console\.|\.log\(|\.error\(|\.warn\(|throw\s"))
    return bodies.where((F.size("_lines") >= 4) & calls).select(
        "project", "path", "line_no", _finding("dead-patterns", "fallback-catch", "info", "Catch block with fallback logic — may be a leftover from a migration").alias("_f")
    ).select("project", "path", "line_no", "_f.*")


def hardcoded_flags(files: DataFrame) -> DataFrame:
    """Constant feature flags that a condition of the same file tests."""
    pattern = java(r"(?:const|let|var)\s+(USE_\w+|ENABLE_\w+|FEATURE_\w+|FLAG_\w+|WITH_\w+)\s*[=:]\s*(true|false)\b")
    name, value = F.regexp_extract("_l", pattern, 1), F.regexp_extract("_l", pattern, 2)
    spread = files.where(F.col("content").rlike(pattern)).select("project", "path", "content", F.posexplode(F.split("content", "\n")).alias("_i", "_l"))
    flags = spread.where(F.col("_l").rlike(pattern)).select("project", "path", "content", (F.col("_i") + 1).alias("line_no"), name.alias("flag"), value.alias("value"))
    tested = F.contains(F.col("content"), F.concat(F.lit("if ("), "flag")) | F.contains(F.col("content"), F.concat(F.lit("if (!"), "flag"))
    return flags.where(tested).select(
        "project", "path", "line_no",
        _finding("dead-patterns", "hardcoded-flag", "warning", F.concat(F.lit('Hardcoded flag "'), "flag", F.lit(" = "), "value", F.lit('" — one branch is permanently dead, remove it'))).alias("_f"),
    ).select("project", "path", "line_no", "_f.*")


def numeric_mismatches(files: DataFrame) -> DataFrame:
    """Comments that count cases, steps, modes ... differently from the code below them."""
    claim = java(r"//.*\b(\d+)\s+(?:cases?|options?|steps?|types?|variants?|modes?|states?)\b", "i")
    around = line_windows(files, r"^\s*//.*\d+\s+(?:[Cc]ase|[Oo]ption|[Ss]tep|[Tt]ype|[Vv]ariant|[Mm]ode|[Ss]tate)", 0, 30)
    below = F.array_join(F.slice(F.split("below", "\n"), 2, 29), "\n")
    counted = around.select("project", "path", "line_no", F.regexp_extract("line", claim, 1).try_cast("int").alias("claimed"), below.alias("text"))
    actual = F.greatest(
        occurrences(r"\bcase\s+", "text"), occurrences(r"\belse\s+if\b", "text") + F.regexp_count("text", F.lit(r"(?m)^\s*if\s*\("))
    )
    return counted.withColumn("actual", actual).where((F.col("actual") > 0) & (F.abs(F.col("actual") - F.col("claimed")) > 1)).select(
        "project", "path", "line_no",
        _finding("comment-staleness", "numeric-mismatch", "warning", F.concat(F.lit("Comment says "), F.col("claimed").cast("string"), F.lit(" but code has "), F.col("actual").cast("string"))).alias("_f"),
    ).select("project", "path", "line_no", "_f.*")


def effects_without_dependencies(files: DataFrame) -> DataFrame:
    return scan_window(
        files, "react", "effect-no-deps", "warning", "useEffect without dependency array — runs on every render",
        r"\buseEffect\s*\(\s*(?:\(\)|function|\([^)]*\)\s*=>)",
        lambda line, above, below: below.rlike(r"\}\s*\)\s*;") & ~below.rlike(r",\s*\["), after=20,
    ).select(*COLUMNS)


def missing_keys(files: DataFrame) -> DataFrame:
    """List rendering whose first element has no key in the eight lines from the call on."""
    return scan_window(
        files, "react", "missing-key", "error", "JSX in .map() without key prop", r"\.map\(.*(?:=>|return)\s*\(?\s*(?:<[A-Za-z>]|$)",
        lambda line, above, below: below.rlike(r"\.map\([^;]*?(?:=>|return)\s*\(?\s*<[A-Za-z>]") & ~below.rlike("key[=:]"), after=8,
    ).select(*COLUMNS)


def queries_in_loops(files: DataFrame) -> DataFrame:
    """Database calls with a loop head in the five lines above, unless a batch is being built."""
    return scan_window(
        files, "sqlite-d1", "query-in-loop", "warning", "query inside a loop — N+1 queries; use one IN (...) query or a batch",
        r"\.(?:prepare|exec|query)\s*\(.*\b(?:[Ss][Ee][Ll][Ee][Cc][Tt]|[Ii][Nn][Ss][Ee][Rr][Tt]|[Uu][Pp][Dd][Aa][Tt][Ee]|[Dd][Ee][Ll][Ee][Tt][Ee])\b",
        lambda line, above, below: above.rlike(r"\bfor\s*(?:await\s*)?\(|\bwhile\s*\(|\.forEach\s*\(|\.map\s*\(") & ~(above.contains(".batch") | below.contains(".batch")),
        before=5, after=3,
    ).select(*COLUMNS)


def unbound_placeholders(files: DataFrame) -> DataFrame:
    """``prepare`` with placeholders and no ``bind`` close by nor on the statement's variable."""
    around = line_windows(files, r"\.prepare\s*\(.*\?", 0, 12)
    variable = F.regexp_extract("line", r"(?:const|let|var)\s+(\w+)\s*=", 1)
    rows = around.where(~F.col("below").rlike(r"\.\s*bind\s*\(")).withColumn("variable", variable)
    bound = files.select("project", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\w+)\s*\.\s*bind\s*\("), F.lit(1)))).alias("variable"))
    return rows.join(bound, ["project", "path", "variable"], "left_anti").select(
        "project", "path", "line_no", _finding("sqlite-d1", "missing-bind", "error", "prepare() declares ? placeholders but no .bind() follows — throws at runtime").alias("_f")
    ).select("project", "path", "line_no", "_f.*")


def unlabelled_controls(files: DataFrame) -> DataFrame:
    """Form controls with no label, aria-label or aria-labelledby on or next to them, and images without alt text."""
    controls = scan_window(
        files, "accessibility", "form-label", "warning", "Form control without label, aria-label, or aria-labelledby", r"<(?:input|select|textarea)\b",
        lambda line, above, below: ~line.rlike(r"""type=["'](?:hidden|submit|button|reset)["']""") & ~F.concat(above, F.lit("\n"), below).rlike("aria-label|<label|htmlFor|<Label"),
        before=3, after=3,
    )
    images = scan_window(
        files, "accessibility", "img-alt", "error", "<img> missing alt attribute", r"<img\b",
        lambda line, above, below: ~F.regexp_extract(below, r"(?s)<img\b[^>]*", 0).contains("alt="), after=5,
    )
    loops = scan_window(
        files, "accessibility", "vue-v-for-key", "error", "v-for without :key — causes rendering bugs when list changes", r"v-for=",
        lambda line, above, below: ~F.regexp_extract(below, r"(?s)^[^>]*", 0).rlike("(?::|v-bind:)key="), after=5,
    )
    return controls.unionByName(images).unionByName(loops).select(*COLUMNS)


def nested_markup(files: DataFrame) -> DataFrame:
    """Elements inside an open element that must not contain them, judged on the five lines above."""
    pairs = (("p", "div"), ("p", "p"), ("a", "a"), ("button", "button"), ("a", "button"))  # fixed values: parent, child
    around = line_windows(files, r"<(?:div|p|a|button)(?:\s|>|/)", 5, 1)
    hits = []
    for parent, child in pairs:
        opened = F.regexp_count("above", F.lit(rf"<{parent}(?:\s|>|/)"))
        closed = F.regexp_count("above", F.lit(rf"</{parent}\s*>"))
        hits.append(F.when(F.col("line").rlike(rf"<{child}(?:\s|>|/)") & (opened > closed), F.lit(f"{child} inside {parent} — invalid nesting")))
    return around.select("project", "path", "line_no", F.coalesce(*hits).alias("message")).where(F.col("message").isNotNull()).select(
        "project", "path", "line_no", F.lit("frontend-health").alias("check"), F.lit("dom-nesting").alias("rule"), F.lit("warning").alias("severity"), "message"
    )


UNTRUSTED = r"\$\{\{\s*github\.(?:event\.(?:issue|pull_request)\.(?:title|body)|event\.comment\.body|head_ref)\s*\}\}"


def workflow_findings(files: DataFrame) -> DataFrame:
    """CI workflow rules that need more than one line. ``files`` are workflow files only."""
    content = F.col("content")
    before_jobs = F.substring_index(content, "\njobs:", 1)
    third_party = F.filter(
        F.regexp_extract_all("content", F.lit(r"uses:\s*([^\n]+)"), F.lit(1)),
        lambda u: ~u.contains("actions/") & ~u.contains("pnpm/") & (~u.contains("@") | ~(u.rlike("@[a-f0-9]{40}") | u.contains("@sha"))),
    )
    rules = F.array_compact(
        F.array(
            F.when(F.size(third_party) > 0, _finding("best-practices", "pin-actions-to-sha", "info", F.concat(F.size(third_party).cast("string"), F.lit(" third-party actions not pinned to SHA")))),
            F.when(
                content.contains("pull_request_target") & content.rlike(r"(?s)actions/checkout.*ref.*\$\{\{.*(?:github\.event\.pull_request|head)"),
                _finding("best-practices", "pwn-request", "error", "pull_request_target + checkout of PR code — allows fork PRs to steal secrets"),
            ),
            F.when(
                content.rlike("publish|deploy") & ~content.contains("id-token: write") & content.rlike("NPM_TOKEN|DEPLOY_TOKEN|AWS_ACCESS_KEY"),
                _finding("best-practices", "prefer-oidc", "info", "uses long-lived secret tokens — consider OIDC trusted publishing/workload identity"),
            ),
            F.when(
                before_jobs.rlike(r"env:\s*\n\s+\w+:\s*\$\{\{\s*secrets\.\w+\s*\}\}"),
                _finding("best-practices", "secrets-in-global-env", "warning", "secrets in top-level env — exposed to all jobs/steps"),
            ),
        )
    )
    whole = files.select("project", "path", F.lit(None).cast("int").alias("line_no"), F.explode(rules).alias("_f")).select("project", "path", "line_no", "_f.*")
    injected = scan_window(
        files, "best-practices", "gha-script-injection", "error", "script injection — untrusted input used in run: block", r"^\s*(?:- )?run ?:",
        lambda line, above, below: below.rlike(UNTRUSTED), after=10,
    )
    return whole.unionByName(injected.select(*COLUMNS))


def cache_busting(dockerfiles: DataFrame) -> DataFrame:
    """``COPY .`` before the dependencies are installed."""
    lines = F.transform(F.split("content", "\n"), lambda l: F.trim(l))
    first = lambda p: F.array_position(F.transform("_l", lambda l: l.rlike(p)), True)
    placed = dockerfiles.select("project", "path", lines.alias("_l")).select(
        "project", "path", first(r"(?i)^COPY\s+\.\s+").cast("int").alias("line_no"), first(r"(?i)npm install|pnpm install|yarn install").alias("install")
    )
    return placed.where((F.col("line_no") > 0) & (F.col("line_no") < F.col("install"))).select(
        "project", "path", "line_no",
        _finding("container-health", "cache-bust", "warning", "COPY . before npm install — copy package.json first to leverage Docker cache").alias("_f"),
    ).select("project", "path", "line_no", "_f.*")


def project_findings(files: DataFrame) -> DataFrame:
    """Things a whole project lacks: a rejection handler, an error boundary."""
    content = F.col("content")
    facts = files.groupBy("project").agg(
        F.bool_or(content.rlike("createServer|app\\.listen|Hono|express")).alias("server"),
        F.bool_or(content.rlike("unhandledRejection|uncaughtException")).alias("handler"),
        F.bool_or(F.col("path").endswith(".tsx")).alias("components"),
        F.bool_or(content.rlike("componentDidCatch|ErrorBoundary")).alias("boundary"),
    )
    rules = F.array_compact(
        F.array(
            F.when(F.col("server") & ~F.col("handler"), _finding("error-handling", "no-rejection-handler", "info", "Server with no process.on('unhandledRejection') handler")),
            F.when(F.col("components") & ~F.col("boundary"), _finding("react", "no-error-boundary", "warning", "React project with no Error Boundary")),
        )
    )
    return facts.select("project", F.explode(rules).alias("_f")).select("project", "_f.*")


def tracked_files(files: DataFrame, large: int = 5_000_000) -> DataFrame:
    """Large and binary files under version control. ``files``: project, path, size."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("size") > large, _finding("git-hygiene", "large-file", "warning", F.concat(F.lit("Large file tracked in git: "), "path"))),
            F.when(F.lower(extension(F.col("path"))).isin(*BINARY_EXTENSIONS), _finding("git-hygiene", "binary-in-git", "warning", F.concat(F.lit("Binary file tracked in git: "), "path"))),
        )
    )
    return files.select("project", "path", F.explode(rules).alias("_f")).select("project", "path", "_f.*")

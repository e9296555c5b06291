"""Queries on text: lines, rule shapes, secrets, fingerprints, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.rules import RESOURCE_LIFECYCLE, SECRET_PATTERNS, SECRETS, CloserRule, Pack, Rule
from tidemark.functions import redaction as R
from tidemark.functions import scoring as S
from tidemark.operators import code as C
from tidemark.operators import deltas as D
from tidemark.operators import findings as W
from tidemark.operators import fingerprints as P
from tidemark.operators import naming as N
from tidemark.operators import rules as E
from tidemark.operators import scores as K
from tidemark.operators import textmetrics as M
from tidemark.plans.registry import named
from tidemark.plans.scan import identify
from tidemark.plans.views import FILES, LINES, quoted, with_views
from tidemark.sources.corpus import document_files, size_capped, table

DOC = with_views(FILES, LINES)

# A small pack that fires on prose: licence statements, secrets, very short and shouted lines.
PROSE = Pack(
    "prose",
    (
        Rule("secrets", "secret-detected", "error", "Possible Generic Secret Assignment", SECRET_PATTERNS[-1][1], needles=("token",)),
        Rule("best-practices", "license-line", "info", "License statement in text", r"(?:Released|licensed|Licensed) under", needles=("under",)),
        Rule("standards", "short-line", "info", "Line of one or two words", r"^\S{1,14}(?: \S{1,14})?$"),
        Rule("standards", "shouting", "warning", "Line in capitals", r"^[A-Z0-9!?.,*#$%& ]{12,}$"),
        Rule("security", "card-number", "warning", "Sixteen-digit number", r"\b4\d{15}\b"),
    ),
)
PROSE_FINDINGS = (
    "found AS ("
    + " UNION ALL ".join(
        f"SELECT project, path, line_no, line, '{r.check}' AS \"check\", '{r.rule}' AS rule, '{r.severity}' AS severity, "
        f"'{quoted(r.message)}' AS message, {i} AS seq FROM lines WHERE regexp_matches(line, '{quoted(r.pattern)}')"
        for i, r in enumerate(PROSE.rules)
    )
    + ")"
)
_REDACTED_LINE = (
    "regexp_replace(line, '((?:password|secret|api_key|apikey|token|auth)[ \\t]*[:=][ \\t]*[''\"])([A-Za-z0-9+/=]{20,})', '\\1[REDACTED]', 'gi')"
)
_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
PROSE_KEYED = (
    f"clean AS (SELECT * REPLACE ({_REDACTED_LINE} AS line) FROM found), "
    "keyed AS (SELECT *, concat_ws(chr(0), \"check\", rule, path, lower(" + _SQUEEZE.format("message") + "), "
    "'@' || substr(sha1(" + _SQUEEZE.format("line") + "), 1, 12)) AS k FROM clean), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY project, k ORDER BY line_no, seq) - 1 AS n FROM keyed), "
    "identified AS (SELECT *, substr(sha1(CASE WHEN n > 0 THEN k || chr(0) || '#' || n ELSE k END), 1, 16) AS fingerprint FROM numbered)"
)


def prose_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan_lines(E.to_lines(document_files(spark, sf_dir)), PROSE)


@named(
    "size_capped_files",
    with_views(FILES) + "SELECT project, count(*) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM files "
    "WHERE octet_length(encode(content)) <= 1000000 GROUP BY project",
)
def size_capped_files(spark, sf_dir):
    files = size_capped(document_files(spark, sf_dir))
    return files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


@named(
    "line_table",
    DOC + "SELECT project, count(*) AS lines, max(line_no) AS longest_file, CAST(sum(length(line)) AS BIGINT) AS characters FROM lines GROUP BY project",
)
def line_table(spark, sf_dir):
    lines = E.to_lines(document_files(spark, sf_dir))
    return lines.groupBy("project").agg(
        F.count(F.lit(1)).alias("lines"), F.max("line_no").alias("longest_file"), F.sum(F.length("line")).alias("characters")
    )


@named(
    "prose_rule_findings",
    with_views(FILES, LINES, PROSE_FINDINGS) + "SELECT project, path, line_no, \"check\", rule, severity, message FROM found",
)
def prose_rule_findings(spark, sf_dir):
    return prose_findings(spark, sf_dir).select("project", "path", "line_no", "check", "rule", "severity", "message")


_SECRET_SQL = DOC + " UNION ALL ".join(
    f"SELECT project, path, line_no, 'secret-detected' AS rule, 'Possible {name}' AS message FROM lines "
    f"WHERE regexp_matches(line, '{'(?i)' if flags else ''}{quoted(pattern)}')"
    for name, pattern, flags, _ in SECRET_PATTERNS
)


@named("secret_findings", _SECRET_SQL)
def secret_findings(spark, sf_dir):
    return E.scan_lines(E.to_lines(document_files(spark, sf_dir)), SECRETS).select("project", "path", "line_no", "rule", "message")


TEXT_CLOSERS = (
    CloserRule("text", "unlicensed-secret", "warning", "Secret in a text without a licence", r'token\s*=\s*"', ("License", "licensed")),
    CloserRule("text", "open-table", "info", "Table row in a text that never shouts", r" \| ", ("!!", "###")),
)


@named(
    "files_without_closer",
    DOC + """, firsts AS (
      SELECT project, path, min(line_no) FILTER (regexp_matches(line, 'token\\s*=\\s*"')) AS t, min(line_no) FILTER (contains(line, ' | ')) AS b
      FROM lines GROUP BY project, path)
    SELECT project, path, t AS line_no, 'unlicensed-secret' AS rule, 'warning' AS severity FROM firsts JOIN files USING (project, path)
    WHERE t IS NOT NULL AND NOT contains(content, 'License') AND NOT contains(content, 'licensed')
    UNION ALL
    SELECT project, path, b, 'open-table', 'info' FROM firsts JOIN files USING (project, path)
    WHERE b IS NOT NULL AND NOT contains(content, '!!') AND NOT contains(content, '###')""",
)
def files_without_closer(spark, sf_dir):
    found = E.scan_files(document_files(spark, sf_dir), RESOURCE_LIFECYCLE + TEXT_CLOSERS)
    return found.select("project", "path", "line_no", "rule", "severity")


@named(
    "lines_in_context",
    DOC + """SELECT a.project, a.path, a.line_no FROM lines a WHERE regexp_matches(a.line, '\\b4\\d{15}\\b')
    AND NOT EXISTS (SELECT 1 FROM lines b WHERE b.project = a.project AND b.path = a.path AND b.line_no BETWEEN a.line_no - 4 AND a.line_no - 1
                    AND regexp_matches(b.line, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]'))
    AND NOT EXISTS (SELECT 1 FROM lines b WHERE b.project = a.project AND b.path = a.path AND b.line_no BETWEEN a.line_no AND a.line_no + 4
                    AND regexp_matches(b.line, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]'))""",
)
def lines_in_context(spark, sf_dir):
    """Card numbers with no network address in the four lines above or below."""
    address = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"
    found = E.scan_window(
        document_files(spark, sf_dir), "security", "card-number", "warning", "Card number", r"\b4\d{15}\b",
        lambda line, above, below: ~above.rlike(address) & ~below.rlike(address), before=4, after=5,
    )
    return found.select("project", "path", "line_no")


TOPICS = {
    "money": (r"\b4\d{15}\b", r"\$\$\$"),
    "network": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"@[a-z0-9]+\.example"),
    "legal": (r"[Ll]icensed? under|Released under",),
    "phone": (r"\+1 \(\d{3}\)",),
}


@named(
    "topic_groups",
    with_views(FILES) + """, hits AS (SELECT project, path, len(string_split(content, chr(10))) AS lines,
      list_filter(['money', 'network', 'legal', 'phone'], lambda g, i: [
        regexp_matches(content, '\\b4\\d{15}\\b') OR contains(content, '$$$'),
        regexp_matches(content, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b') OR regexp_matches(content, '@[a-z0-9]+\\.example'),
        regexp_matches(content, '[Ll]icensed? under|Released under'),
        regexp_matches(content, '\\+1 \\(\\d{3}\\)')][i]) AS g FROM files)
    SELECT project, path, lines, len(g) AS n_concerns, array_to_string(g, ', ') AS concerns,
      CASE WHEN len(g) >= 3 THEN 'error' ELSE 'warning' END AS severity FROM hits WHERE lines >= 4 AND len(g) >= 2""",
)
def topic_groups(spark, sf_dir):
    return E.scan_concerns(document_files(spark, sf_dir), TOPICS, min_lines=4)


@named(
    "ignored_findings_dropped",
    with_views(FILES, LINES, PROSE_FINDINGS) + """SELECT project, path, line_no, "check", rule FROM found
    WHERE NOT ("check" = 'standards' AND (path LIKE 'en/%' OR path LIKE '%7.txt')) AND NOT ("check" = 'security' AND path LIKE 'fr/1%')""",
)
def ignored_findings_dropped(spark, sf_dir):
    ignores = spark.createDataFrame(
        [("standards", "en/**"), ("standards", "*7.txt"), ("security", "fr/1")], "check string, pattern string"
    )
    return W.drop_ignored(prose_findings(spark, sf_dir), ignores).select("project", "path", "line_no", "check", "rule")


@named(
    "changed_files_only",
    with_views(FILES, LINES, PROSE_FINDINGS) + """, changed AS (SELECT lang || '/' || doc_id || '.txt' AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
    SELECT project, path, line_no, rule FROM found WHERE path IN (SELECT path FROM changed)""",
)
def changed_files_only(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("quality = 0")
    changed = table(spark, sf_dir, "documents").join(bad, "doc_id", "left_semi").select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))
    return W.only_changed(prose_findings(spark, sf_dir), changed).select("project", "path", "line_no", "rule")


@named(
    "change_impact",
    with_views(FILES, LINES, PROSE_FINDINGS) + """, changed AS (SELECT source AS project, lang || '/' || doc_id || '.txt' AS path FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT project, path, count(found.rule) AS n FROM changed LEFT JOIN found USING (project, path) GROUP BY ALL""",
)
def change_impact(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    changed = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select(
        F.col("source").alias("project"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path")
    )
    return W.change_impact(changed, prose_findings(spark, sf_dir))


@named(
    "not_already_reported",
    with_views(FILES, LINES, PROSE_FINDINGS) + """, again AS (SELECT project, path, line_no, 'short-line' AS rule FROM lines WHERE length(line) BETWEEN 1 AND 20)
    SELECT * FROM again WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.project = again.project AND f.path = again.path
      AND f.line_no = again.line_no AND f.rule = again.rule)""",
)
def not_already_reported(spark, sf_dir):
    lines = E.to_lines(document_files(spark, sf_dir))
    again = lines.where(F.length("line").between(1, 20)).select("project", "path", "line_no", F.lit("short-line").alias("rule"))
    return W.not_already(again, E.scan_lines(lines, PROSE))


@named(
    "required_languages",
    """WITH need AS (SELECT * FROM (VALUES ('en', true), ('fr', true), ('de', false), ('es', false), ('it', true)) t(path, required))
    SELECT p.project, n.path AS missing, CASE WHEN required THEN 'error' ELSE 'warning' END AS severity
    FROM (SELECT DISTINCT source AS project FROM documents) p CROSS JOIN need n
    WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = p.project AND d.lang = n.path)""",
)
def required_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    required = spark.createDataFrame(
        [("text", lang, must, "documents in this language") for lang, must in (("en", True), ("fr", True), ("de", False), ("es", False), ("it", True))],
        "kind string, path string, required boolean, description string",
    )
    projects = docs.select(F.col("source").alias("project")).distinct().withColumn("kind", F.lit("text"))
    files = docs.select(F.col("source").alias("project"), F.col("lang").alias("path"))
    return E.require_present(projects, files, required).select("project", "missing", "severity")


@named(
    "practice_adherence",
    """SELECT d.source AS project, count(*) AS practices, count(*) FILTER (quality = 1) AS followed,
    CAST(greatest(0, 100 - sum(CASE WHEN quality = 1 THEN 0 WHEN toxic = 1 THEN 15 WHEN d.lang = 'en' THEN 8 ELSE 2 END)) AS BIGINT) AS score
    FROM documents d JOIN labels USING (doc_id) GROUP BY d.source""",
)
def practice_adherence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("source").alias("project"), (F.col("quality") == 1).alias("followed"),
        F.when(F.col("toxic") == 1, "error").when(F.col("lang") == "en", "warning").otherwise("info").alias("severity"),
    )
    return E.adherence(rows)


_APPLY = """WITH per AS (SELECT source AS project, lang, count(*) AS n FROM documents GROUP BY ALL),
  projects AS (SELECT project, arg_max(lang, (n, lang)) AS language, list(lang) AS components FROM per GROUP BY project)
  SELECT project, 'prose' AS "check", list_contains(['en', 'fr'], language) AS applies FROM projects
  UNION ALL SELECT project, 'pairs', list_has_all(components, ['de', 'es']) FROM projects
  UNION ALL SELECT project, 'any', true FROM projects
  UNION ALL SELECT project, 'french', language = 'fr' AND list_contains(components, 'fr') FROM projects"""


@named("applicable_checks", _APPLY)
def applicable_checks(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project"), "lang").agg(F.count(F.lit(1)).alias("n"))
    projects = per.groupBy("project").agg(
        F.max_by("lang", F.struct("n", "lang")).alias("language"), F.collect_set("lang").alias("components"),
        F.lit("none").alias("framework"),
    )
    checks = (("prose", ("en", "fr"), None, None), ("pairs", None, None, ("de", "es")), ("any", None, None, None), ("french", ("fr",), None, ("fr",)))
    return K.applicable(projects, checks)


# --- secrets -----------------------------------------------------------------------
_PAIR = r"""([A-Za-z][A-Za-z0-9_.-]{0,127})["'']?[ \t]*(?::=|=>|[:=])[ \t]*["'']?([^\s"''`,;\\]{1,512})"""
_CRED = (
    DOC + ", m AS (SELECT project, path, line_no, unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9_.-])" + _PAIR + "', 1)) AS name, "
    "unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9_.-])" + _PAIR + "', 2)) AS value FROM lines) "
    """SELECT project, path, line_no, name, value,
    CASE WHEN regexp_matches(lower(name), '(?:secret|secrets|token|password|passwd|passphrase|pwd|credential|credentials)(?:$|[_.-])')
         OR regexp_matches(lower(name), '(?:^|[_.-])(?:sk|pat|pw|pass)(?:$|[_.-])') THEN 'strong'
         WHEN regexp_matches(lower(name), '(?:^|[_.-])(?:auth|authorization|dsn|private|session|cookie)(?:$|[_.-])') OR lower(name) = 'key' THEN 'weak'
         ELSE 'none' END AS strength,
    CASE WHEN regexp_full_match(value, '[0-9]+(?:\\.[0-9]+)?') THEN 'number' WHEN length(value) >= 20 THEN 'long'
         WHEN regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') THEN 'mixed' ELSE 'word' END AS shape FROM m"""
)


@named("credential_pairs", _CRED)
def credential_pairs(spark, sf_dir):
    return R.credential_pairs(E.to_lines(document_files(spark, sf_dir)))


@named(
    "redacted_texts",
    with_views(FILES) + "SELECT project, path, length(c) AS characters, sha1(c) AS digest FROM (SELECT project, path, "
    + _REDACTED_LINE.replace("(line,", "(content,") + " AS c FROM files)",
)
def redacted_texts(spark, sf_dir):
    return R.redact_text(document_files(spark, sf_dir), "content").select(
        "project", "path", F.length("content").alias("characters"), F.sha1("content").alias("digest")
    )


@named(
    "redacted_logs",
    with_views(FILES) + "SELECT project, path, length(c) AS characters, sha1(c) AS digest FROM (SELECT project, path, substr("
    + _REDACTED_LINE.replace("(line,", "(trim(content),") + ", 1, 8000) AS c FROM files)",
)
def redacted_logs(spark, sf_dir):
    """Logs cut to 8,000 characters after redaction: the cut is what this operator does."""
    return R.redact_log(document_files(spark, sf_dir), "content", 8000).select(
        "project", "path", F.length("content").alias("characters"), F.sha1("content").alias("digest")
    )


@named(
    "redacted_json_logs",
    "SELECT conv_id, turn, length(log) AS characters, sha1(log) AS digest FROM (SELECT conv_id, turn, substr('{' || chr(10) || ' \"turn\": ' || turn || ',' || chr(10) "
    "|| ' \"results\": [' || chr(10) || '  {' || chr(10) || '   \"message\": ' || CAST(to_json(coalesce(text, '') || chr(10) || 'DB_PASSWORD=\"[REDACTED]\"' || chr(10) || 'NEXT=1') AS VARCHAR) "
    "|| chr(10) || '  }' || chr(10) || ' ]' || chr(10) || '}', 1, 8000) AS log FROM conversations)",
)
def redacted_json_logs(spark, sf_dir):
    """Every turn as a JSON log whose message ends in an assignment with a key made of its place; escapes hide its quotes and line breaks."""
    key = F.concat(F.lit("k7"), F.left(F.md5(F.concat_ws("-", "conv_id", "turn")), F.lit(16)))
    message = F.concat(F.coalesce("text", F.lit("")), F.lit('\nDB_PASSWORD="'), key, F.lit('"\nNEXT=1'))
    log = F.to_json(F.struct("turn", F.array(F.struct(message.alias("message"))).alias("results")))
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", log.alias("log"))
    return R.redact_log(logs, "log", 8000).select("conv_id", "turn", F.length("log").alias("characters"), F.sha1("log").alias("digest"))


@named("redacted_conversations", "SELECT conv_id, turn, role, sha1(text) AS digest FROM conversations")
def redacted_conversations(spark, sf_dir):
    """Every string of nested rows redacted; conversation text holds no credential, so it comes back unchanged."""
    turns = table(spark, sf_dir, "conversations")
    nested = turns.select("conv_id", "turn", F.struct("role", F.array("text").alias("texts")).alias("message"))
    return R.redact_deep(nested).select("conv_id", "turn", "message.role", F.sha1(F.col("message.texts")[0]).alias("digest"))


# --- identity and comparison ---------------------------------------------------------
@named(
    "fingerprints",
    with_views(FILES, LINES, PROSE_FINDINGS, PROSE_KEYED) + "SELECT project, path, line_no, rule, fingerprint FROM identified",
)
def fingerprints(spark, sf_dir):
    return identify(prose_findings(spark, sf_dir)).select("project", "path", "line_no", "rule", "fingerprint")


@named(
    "fingerprints_v1",
    with_views(FILES, LINES, PROSE_FINDINGS)
    + "SELECT project, path, rule, substr(sha1(concat_ws(chr(0), \"check\", rule, path, lower(message))), 1, 16) AS fingerprint_v1, count(*) AS findings "
    "FROM found GROUP BY ALL",
)
def fingerprints_v1(spark, sf_dir):
    keyed = P.fingerprint_v1(prose_findings(spark, sf_dir))
    return keyed.groupBy("project", "path", "rule", "fingerprint_v1").agg(F.count(F.lit(1)).alias("findings"))


_AFTER_FILES = (
    "files AS (SELECT source AS project, lang || '/' || doc_id || '.txt' AS path, "
    "replace(text, 'License', 'Licence') || chr(10) || string_split(text, chr(10))[1] AS content FROM documents)"
)
_TWO_SIDES = (
    "WITH before AS (" + with_views(FILES, LINES, PROSE_FINDINGS, PROSE_KEYED) + "SELECT * FROM identified), "
    "after AS (" + with_views(_AFTER_FILES, LINES, PROSE_FINDINGS, PROSE_KEYED) + "SELECT * FROM identified), "
    'b AS (SELECT project, "check", fingerprint, count(*) AS n FROM before GROUP BY ALL), '
    'a AS (SELECT project, "check", fingerprint, count(*) AS n FROM after GROUP BY ALL) '
)


def two_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents, and the same documents with reworded licences and their first line repeated."""
    files = document_files(spark, sf_dir)
    edited = files.withColumn(
        "content", F.concat(F.replace("content", F.lit("License"), F.lit("Licence")), F.lit("\n"), F.split("content", "\n")[0])
    )
    return tuple(identify(E.scan_lines(E.to_lines(f), PROSE)) for f in (files, edited))


@named(
    "finding_delta",
    _TWO_SIDES + """SELECT project, "check", fingerprint, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'introduced' ELSE 'fixed' END AS kind,
    abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS copies FROM a FULL JOIN b USING (project, "check", fingerprint) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def finding_delta(spark, sf_dir):
    before, after = two_scans(spark, sf_dir)
    return D.finding_delta(before, after).select("project", "check", "fingerprint", "kind", "copies")


@named(
    "finding_trend",
    _TWO_SIDES + """SELECT project, "check", kind, count(*) AS findings, min(line_no) AS first_line FROM (
      SELECT after.project, after."check", 'introduced' AS kind, line_no, row_number() OVER (PARTITION BY after.project, after."check", after.fingerprint ORDER BY line_no, seq) AS r,
        coalesce(b.n, 0) AS other FROM after LEFT JOIN b USING (project, "check", fingerprint)
      UNION ALL
      SELECT before.project, before."check", 'fixed', line_no, row_number() OVER (PARTITION BY before.project, before."check", before.fingerprint ORDER BY line_no, seq),
        coalesce(a.n, 0) FROM before LEFT JOIN a USING (project, "check", fingerprint)) WHERE r > other GROUP BY ALL""",
)
def finding_trend(spark, sf_dir):
    surplus = D.finding_trend(*two_scans(spark, sf_dir))
    return surplus.groupBy("project", "check", "kind").agg(F.count(F.lit(1)).alias("findings"), F.min("line_no").alias("first_line"))


# --- scores of the text scan ------------------------------------------------------------
_PROSE_CHECKS = ("secrets", "best-practices", "standards", "security")
_SCORES = (
    with_views(FILES, LINES, PROSE_FINDINGS) + """, n AS (SELECT project, count(*) AS n FROM files GROUP BY project),
    units AS (SELECT n.project, n.n, c."check" FROM n CROSS JOIN (VALUES ('secrets'), ('best-practices'), ('security')) c("check")),
    c AS (SELECT u.project, u."check", u.n, count(*) FILTER (f.severity = 'error') AS errors, count(*) FILTER (f.severity = 'warning') AS warnings,
      count(*) FILTER (f.severity = 'info') AS infos FROM units u LEFT JOIN found f USING (project, "check") GROUP BY ALL),
    scored AS (SELECT project, "check", errors, warnings, infos, CAST(floor(greatest(0, least(100, CASE "check"
      WHEN 'secrets' THEN 100 - least(100, errors / n::DOUBLE * 200) - least(20, warnings / n::DOUBLE * 50)
      WHEN 'best-practices' THEN 100 - 15 * errors - 8 * warnings - 2 * infos
      ELSE 100 - least(70, errors * greatest(10, 50 / sqrt(n))) - least(25, warnings * greatest(3, 20 / sqrt(n))) END)) + 0.5) AS BIGINT) AS score FROM c)"""
)
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"


def prose_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    units = files.groupBy("project").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "check", F.explode(F.array(*[F.lit(c) for c in ("secrets", "best-practices", "security")]))
    )
    return K.score_checks(prose_findings(spark, sf_dir), units)


@named("check_scores", _SCORES + f' SELECT project, "check", errors, warnings, infos, score, {_GRADE} AS grade FROM scored')
def check_scores(spark, sf_dir):
    return prose_scores(spark, sf_dir).select("project", "check", "errors", "warnings", "infos", "score", "grade")


@named(
    "composite_scores",
    _SCORES + f""", total AS (SELECT project, CAST(floor(sum(score * w) / sum(w) + 0.5) AS BIGINT) AS score FROM scored
      JOIN (VALUES ('secrets', 6), ('best-practices', 3), ('security', 5)) m("check", w) USING ("check") GROUP BY project)
    SELECT project, score, {_GRADE} AS grade FROM total""",
)
def composite_scores(spark, sf_dir):
    return K.composite(prose_scores(spark, sf_dir).select("project", "check", "score"), K.check_meta(spark))


@named(
    "severity_counts",
    with_views(FILES, LINES, PROSE_FINDINGS) + """SELECT project, "check", count(*) FILTER (severity = 'error') AS errors,
    count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM found GROUP BY ALL""",
)
def severity_counts(spark, sf_dir):
    return W.severity_counts(prose_findings(spark, sf_dir), "project", "check")


@named(
    "file_hotspots",
    with_views(FILES, LINES, PROSE_FINDINGS) + """SELECT project, path, count(*) AS total, count(*) FILTER (severity = 'error') AS errors,
    count(*) FILTER (severity <> 'error') AS warnings, string_agg(DISTINCT "check", ',' ORDER BY "check") AS checks
    FROM found GROUP BY project, path ORDER BY total DESC, project, path LIMIT 30""",
)
def file_hotspots(spark, sf_dir):
    return W.file_hotspots(prose_findings(spark, sf_dir))


@named(
    "file_hotspots_split",
    with_views(FILES, LINES, PROSE_FINDINGS) + """SELECT project, path, count(*) AS total, count(*) FILTER (severity = 'error') AS errors,
    count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, string_agg(DISTINCT "check", ',' ORDER BY "check") AS checks
    FROM found GROUP BY project, path ORDER BY total DESC, project, path LIMIT 10""",
)
def file_hotspots_split(spark, sf_dir):
    return W.file_hotspots(prose_findings(spark, sf_dir), 10, split_info=True)


@named(
    "top_findings",
    with_views(FILES, LINES, PROSE_FINDINGS) + """SELECT project, path, line_no, "check", rule, severity, w AS weight FROM found
    JOIN (VALUES ('secrets', 6::BIGINT), ('best-practices', 3), ('standards', 3), ('security', 5)) m("check", w) USING ("check")
    ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, w DESC, project, path, line_no, rule LIMIT 40""",
)
def top_findings(spark, sf_dir):
    top = W.top_findings(prose_findings(spark, sf_dir), 40, "project", "path", "line_no", "rule")
    return top.select("project", "path", "line_no", "check", "rule", "severity", "weight")


@named(
    "capped_per_rule",
    with_views(FILES, LINES, PROSE_FINDINGS) + """, r AS (SELECT *, row_number() OVER (PARTITION BY "check", rule ORDER BY project, path, line_no) AS rank FROM found)
    SELECT "check", rule, path, message, rank FROM r WHERE rank <= 5
    UNION ALL SELECT "check", rule, NULL, '...and ' || (count(*) - 5) || ' more', 6 FROM found GROUP BY "check", rule HAVING count(*) > 5""",
)
def capped_per_rule(spark, sf_dir):
    order = [F.asc("project"), F.asc("path"), F.asc("line_no")]
    return W.cap_per_rule(prose_findings(spark, sf_dir), 5, order)


@named(
    "all_findings",
    with_views(FILES, LINES, PROSE_FINDINGS) + """SELECT rule, count(*) AS findings, count(message) AS with_message FROM (
      SELECT rule, message FROM found UNION ALL SELECT 'long-text', NULL FROM files WHERE length(content) > 8000) GROUP BY rule""",
)
def all_findings(spark, sf_dir):
    long_texts = document_files(spark, sf_dir).where(F.length("content") > 8000).select("project", "path", F.lit("long-text").alias("rule"))
    union = W.all_findings(prose_findings(spark, sf_dir), long_texts)
    return union.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"), F.count("message").alias("with_message"))


# --- text metrics ------------------------------------------------------------------------
@named(
    "token_density",
    with_views(FILES) + """, t AS (SELECT project, CAST(floor(length(content) / 3.5::DOUBLE + 0.5) AS BIGINT) AS t FROM files)
    SELECT project, count(*) AS files, CAST(sum(t) AS BIGINT) AS tokens, CAST(floor(sum(t)::DOUBLE / count(*) + 0.5) AS BIGINT) AS mean_tokens,
    count(*) FILTER (t > 4000) AS heavy_files FROM t GROUP BY project""",
)
def token_density(spark, sf_dir):
    return M.token_density(document_files(spark, sf_dir))


@named(
    "heavy_files",
    with_views(FILES) + "SELECT project, path, CAST(floor(length(content) / 3.5::DOUBLE + 0.5) AS BIGINT) AS tokens FROM files WHERE floor(length(content) / 3.5::DOUBLE + 0.5) > 4000",
)
def heavy_files(spark, sf_dir):
    return M.heavy_files(document_files(spark, sf_dir))


@named(
    "large_file_penalty",
    with_views(FILES) + """, n AS (SELECT project, len(string_split(content, chr(10))) AS n FROM files)
    SELECT project, count(*) AS files, count(*) FILTER (n > 20) AS large,
    floor(sum(CASE WHEN n > 20 THEN ((n - 20) / 100::DOUBLE) * ((n - 20) / 100::DOUBLE) ELSE 0 END) * 100 + 0.5) / 100 AS penalty FROM n GROUP BY project""",
)
def large_file_penalty(spark, sf_dir):
    return M.large_files(document_files(spark, sf_dir), soft_limit=20)


@named(
    "license_statements",
    DOC + """SELECT project, path, line_no, CASE WHEN regexp_matches(line, '(?i)gnu|gpl') THEN 'copyleft'
      WHEN regexp_matches(line, '(?i)apache|mit license|bsd|isc license') THEN 'permissive' ELSE 'unknown' END AS family
    FROM lines WHERE regexp_matches(line, '(?i)licen[sc]ed under|under the .* license|copyright')""",
)
def license_statements(spark, sf_dir):
    return M.license_lines(E.to_lines(document_files(spark, sf_dir)))


@named(
    "license_audit",
    """WITH l AS (SELECT source AS project, CAST(doc_id AS VARCHAR) AS name, unnest(regexp_extract_all(text, 'under the ([A-Za-z ]+) License', 1)) AS license FROM documents)
    SELECT project, name, license, CASE WHEN regexp_matches(license, '(?i)GPL|AGPL|SSPL') THEN 'copyleft' ELSE 'unknown' END AS kind
    FROM l WHERE license NOT IN ('MIT', 'ISC', 'Apache-2.0', 'Unlicense', 'Zlib', '0BSD')""",
)
def license_audit(spark, sf_dir):
    names = F.regexp_extract_all("text", F.lit("under the ([A-Za-z ]+) License"), F.lit(1))
    packages = table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), F.col("doc_id").cast("string").alias("name"), F.lit("?").alias("version"), F.explode(names).alias("license")
    )
    return M.license_audit(packages).select("project", "name", "license", "kind")


@named(
    "commented_out_blocks",
    with_views("files AS (SELECT source AS project, lang || '/' || doc_id || '.txt' AS path, regexp_replace(text, '(?m)^[A-M]', '// const ', 'g') AS content FROM documents)", LINES)
    + """, hits AS (SELECT project, path, line_no, line_no - row_number() OVER (PARTITION BY project, path ORDER BY line_no) AS island
      FROM lines WHERE regexp_matches(line, '^\\s*//\\s*(?:const |let |var |function |return |if \\(|for \\(|\\}|await |import |export |class )'))
    SELECT project, path, min(line_no) AS line_no, count(*) AS lines FROM hits GROUP BY project, path, island HAVING count(*) >= 3""",
)
def commented_out_blocks(spark, sf_dir):
    """Lines beginning with A to M are turned into commented-out code first."""
    files = document_files(spark, sf_dir).withColumn("content", F.regexp_replace("content", "(?m)^[A-M]", "// const "))
    return M.commented_code(files)


@named(
    "todo_ages",
    """WITH t AS (SELECT event_id, '// todo: ' || event_type || ' since ' || CASE WHEN event_type = 'view' THEN 'ever' ELSE strftime(ts - to_days(CAST(floor(value + 0.5) AS INTEGER)), '%Y-%m-%d') END AS line,
      date_diff('day', CAST(ts - to_days(CAST(floor(value + 0.5) AS INTEGER)) AS DATE), DATE '2024-08-01') / 30.0::DOUBLE AS m, event_type FROM events)
    SELECT event_id AS line_no, CASE WHEN event_type = 'view' THEN 'undated-todo' ELSE 'stale-todo' END AS rule,
      CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(m + 0.5) AS BIGINT) END AS months FROM t WHERE event_type = 'view' OR m > 6""",
)
def todo_ages(spark, sf_dir):
    """To-do comments written from events, dated ``value`` days before the event."""
    events = table(spark, sf_dir, "events")
    day = F.date_sub(F.to_date("ts"), F.floor(F.col("value") + 0.5).cast("int"))
    since = F.when(F.col("event_type") == "view", "ever").otherwise(F.date_format(day, "yyyy-MM-dd"))
    lines = events.select(
        F.lit("app").alias("project"), F.lit("todo.ts").alias("path"), F.col("event_id").alias("line_no"),
        F.concat(F.lit("// todo: "), "event_type", F.lit(" since "), since).alias("line"),
    )
    return M.todo_comments(lines, F.lit("2024-08-01").cast("date")).select("line_no", "rule", "months")


@named(
    "stale_references",
    """WITH known AS (SELECT DISTINCT source, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS name FROM documents WHERE lang <> 'es'),
    docs AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[a-z][0-9A-Za-z_]{4,}\\b'))) AS name FROM documents WHERE lang = 'es')
    SELECT source AS project, doc_id || '.md' AS path, name FROM docs WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source = docs.source AND k.name = docs.name)
      AND name NOT IN ('false', 'undefined', 'string', 'number', 'boolean')""",
)
def stale_references(spark, sf_dir):
    """Spanish documents read as manuals whose words are quoted names; the other documents of the source are the code."""
    docs = table(spark, sf_dir, "documents")
    # Java's \b treats accented letters as word characters; the class is spelled out to stay ASCII.
    quoted_words = F.regexp_replace("text", r"(?<![0-9A-Za-z_])([a-z][0-9A-Za-z_]{4,})(?![0-9A-Za-z_])", "`$1`")
    manuals = docs.where("lang = 'es'").select(F.col("source").alias("project"), F.concat("doc_id", F.lit(".md")).alias("path"), quoted_words.alias("content"))
    code = docs.where("lang <> 'es'").select(F.col("source").alias("project"), F.col("text").alias("content"))
    return M.stale_refs(manuals, code)


@named(
    "directory_clusters",
    with_views(FILES) + """, d AS (SELECT project, string_split(path, '/')[1] AS dir, sha256(path || chr(0) || content) AS h FROM files)
    SELECT project, dir, count(*) AS files, substr(sha1(bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT))), 1, 16) AS hash
    FROM d GROUP BY ALL""",
)
def directory_clusters(spark, sf_dir):
    return M.clusters(document_files(spark, sf_dir))


@named(
    "unchanged_clusters",
    """SELECT source AS project, lang AS dir, count(*) AS files FROM documents GROUP BY ALL HAVING NOT bool_or(contains(text, 'License'))""",
)
def unchanged_clusters(spark, sf_dir):
    """Directories whose content hash survives an edit of every text that mentions a licence."""
    files = document_files(spark, sf_dir)
    edited = files.withColumn("content", F.replace("content", F.lit("License"), F.lit("Licence")))
    return M.reusable_clusters(M.clusters(edited), M.clusters(files)).select("project", "dir", "files")


@named(
    "feature_map",
    with_views(FILES, LINES, PROSE_FINDINGS) + """, c AS (SELECT project, string_split(path, '/')[1] AS dir, count(*) AS files FROM files GROUP BY ALL),
    f AS (SELECT project, string_split(path, '/')[1] AS dir, count(*) AS findings FROM found GROUP BY ALL)
    SELECT project, dir, files, coalesce(findings, 0) AS findings FROM c LEFT JOIN f USING (project, dir)""",
)
def feature_map(spark, sf_dir):
    clusters = M.clusters(document_files(spark, sf_dir))
    return M.feature_map(clusters, prose_findings(spark, sf_dir)).select("project", "dir", "files", "findings")


# --- duplicates -----------------------------------------------------------------------------
@named(
    "duplicate_documents",
    with_views(FILES) + "SELECT sha256(content) AS digest, count(*) AS copies, min(project || '/' || path) AS first_path FROM files GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_documents(spark, sf_dir):
    return C.duplicate_files(document_files(spark, sf_dir))


@named(
    "duplicate_blocks",
    with_views(FILES) + """, l AS (SELECT project, path, list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')) AS l FROM files),
    b AS (SELECT project, path, l, unnest(generate_series(1, len(l) - 5)) AS start FROM l WHERE len(l) >= 6),
    d AS (SELECT project || '/' || path AS file, start, sha1(array_to_string(l[start:start + 5], chr(10))) AS digest FROM b)
    SELECT digest, count(*) AS copies, arg_min(file, (file, start)) AS first_file, arg_min(start, (file, start)) AS first_line FROM d GROUP BY digest HAVING count(*) > 1""",
)
def duplicate_blocks(spark, sf_dir):
    return C.duplicate_blocks(document_files(spark, sf_dir), 6)


# Tokens as the tokeniser sees them: comment, text literal, word, sign.
_TOKENS = (
    r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|\"(?:[^\"\\\n]|\\(?s:.))*\"?|''(?:[^''\\\n]|\\(?s:.))*''?|`(?:[^`\\]|\\(?s:.))*`?|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
)
# Windows of fifty tokens, first occurrences, the diagonals they name, the runs on these, and of the runs those in no other one.
_CLONES = (
    "WITH f AS (SELECT source AS project, lang || '/' || doc_id || '.txt' AS path, text FROM documents), "
    "i AS (SELECT project, path, unnest(x) AS item, generate_subscripts(x, 1) AS nth FROM (SELECT *, regexp_extract_all(text, '" + _TOKENS + "|\\n') AS x FROM f)), "
    """n AS (SELECT *, 1 + coalesce(sum(len(item) - len(replace(item, chr(10), ''))) OVER (PARTITION BY project, path ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM i),
    k AS (SELECT project, path, hash(item) AS a1, CAST(line AS INTEGER) AS line, row_number() OVER (PARTITION BY project, path ORDER BY nth) AS pos
      FROM n WHERE item <> chr(10) AND NOT (starts_with(item, '//') OR starts_with(item, '/*'))),
    k2 AS (SELECT *, hash(a1, lead(a1, 1) OVER f) AS a2 FROM k WINDOW f AS (PARTITION BY project, path ORDER BY pos)),
    k4 AS (SELECT *, hash(a2, lead(a2, 2) OVER f) AS a4 FROM k2 WINDOW f AS (PARTITION BY project, path ORDER BY pos)),
    k8 AS (SELECT *, hash(a4, lead(a4, 4) OVER f) AS a8 FROM k4 WINDOW f AS (PARTITION BY project, path ORDER BY pos)),
    k16 AS (SELECT *, hash(a8, lead(a8, 8) OVER f) AS a16 FROM k8 WINDOW f AS (PARTITION BY project, path ORDER BY pos)),
    k32 AS (SELECT *, hash(a16, lead(a16, 16) OVER f) AS a32 FROM k16 WINDOW f AS (PARTITION BY project, path ORDER BY pos)),
    w AS (SELECT project, path, pos, line, h, last_line FROM (SELECT project, path, pos, line, hash(a32, lead(a16, 32) OVER f, lead(a2, 48) OVER f) AS h, lead(line, 49) OVER f AS last_line
      FROM k32 WINDOW f AS (PARTITION BY project, path ORDER BY pos)) WHERE last_line IS NOT NULL),
    o AS (SELECT project, h, arg_min(path, (path, pos)) AS origin_path, arg_min(pos, (path, pos)) AS origin_pos FROM w GROUP BY ALL HAVING count(*) > 1),
    d AS (SELECT DISTINCT w.project, w.path, origin_path, pos - origin_pos AS shift FROM w JOIN o USING (project, h) WHERE w.path <> origin_path OR pos >= origin_pos + 50),
    m AS (SELECT d.*, a.pos, a.line, a.last_line, b.line AS origin_line FROM d JOIN w a ON a.project = d.project AND a.path = d.path JOIN w b ON b.project = d.project AND b.path = d.origin_path AND b.pos = a.pos - shift AND b.h = a.h),
    r AS (SELECT *, pos - row_number() OVER (PARTITION BY project, path, origin_path, shift ORDER BY pos) AS island FROM m),
    u AS (SELECT project, path, origin_path, shift, min(pos) AS start, max(pos) AS stop, arg_min(line, pos) AS start_line, arg_max(last_line, pos) AS end_line, arg_min(origin_line, pos) AS origin_line FROM r
      GROUP BY project, path, origin_path, shift, island),
    v AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY project, path, origin_path ORDER BY start, stop DESC, shift ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM u),
    c AS (SELECT v.project, v.path, origin_path, substr(sha1(trim(regexp_replace(array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10)), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')), 1, 12) AS digest,
      start_line, end_line, origin_line, CAST(stop - start + 50 AS INTEGER) AS tokens, end_line - start_line + 1 AS lines FROM v JOIN f ON f.project = v.project AND f.path = v.path WHERE stop > reached)
    """
)


@named("token_clones", _CLONES + "SELECT * FROM c")
def token_clones(spark, sf_dir):
    """Clones of at least fifty tokens inside each source."""
    return C.clones(document_files(spark, sf_dir), 50)


@named("clone_pairs", _CLONES + "SELECT project, path, origin_path, count(*) AS clones, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY ALL")
def clone_pairs(spark, sf_dir):
    """Clones and copied tokens per pair of files."""
    found = C.clones(document_files(spark, sf_dir), 50)
    return found.groupBy("project", "path", "origin_path").agg(F.count(F.lit(1)).alias("clones"), F.sum("tokens").alias("tokens"))


@named(
    "clone_subjects",
    _CLONES + """SELECT project, path, start_line AS line_no, CASE WHEN path < origin_path THEN path || '|' || origin_path ELSE origin_path || '|' || path END || '|' || digest AS subject, count(*) AS clones FROM c GROUP BY ALL""",
)
def clone_subjects(spark, sf_dir):
    """What identifies each clone: the sorted pair of files and the digest of the copied lines."""
    found = C.clone_findings(C.clones(document_files(spark, sf_dir), 50))
    return found.groupBy("project", "path", "line_no", "subject").agg(F.count(F.lit(1)).alias("clones"))


@named("clone_fingerprints")
def clone_fingerprints(spark, sf_dir):
    """Clone findings with their fingerprint, which has no line in it."""
    found = C.clone_findings(C.clones(document_files(spark, sf_dir), 50))
    return P.fingerprint(found.withColumn("line", F.lit(None).cast("string"))).select("project", "path", "line_no", "subject", "fingerprint")


@named(
    "duplication_scores",
    _CLONES + """, t AS (SELECT project, sum(len(string_split(text, chr(10)))) AS lines FROM f GROUP BY ALL),
    x AS (SELECT project, count(DISTINCT (path, line)) AS copied FROM (SELECT project, path, unnest(generate_series(start_line, end_line)) AS line FROM c) GROUP BY ALL)
    SELECT project, CAST(lines AS BIGINT) AS lines, coalesce(copied, 0) AS copied, CAST(floor(greatest(0, least(100, 100 - coalesce(copied, 0) / lines * 100)) + 0.5) AS BIGINT) AS score FROM t LEFT JOIN x USING (project)""",
)
def duplication_scores(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return C.duplication_scores(files, C.clones(files, 50))


@named("masked_texts")
def masked_texts(spark, sf_dir):
    """Comments and literals blanked: sizes and line counts must not change."""
    files = document_files(spark, sf_dir)
    masked = C.mask_text(files).select("project", "path", F.col("content").alias("masked"))
    return files.join(masked, ["project", "path"]).groupBy("project").agg(
        F.sum(F.length("masked") - F.length("content")).alias("size_change"),
        F.sum(F.size(F.split("masked", "\n")) - F.size(F.split("content", "\n"))).alias("line_change"),
    )


# --- names ------------------------------------------------------------------------------------
_WORDS = """words AS (SELECT lang AS project, source AS dir, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS name FROM documents)"""


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a file name: language = project, source = directory."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("project"), F.col("source").alias("dir"), F.explode(words).alias("name"))


# Names up to two edits apart share a form with up to two characters left out: another way than the query's.
@named(
    "similar_names",
    "WITH " + _WORDS + """, n AS (SELECT DISTINCT project, dir, name FROM words),
    o AS (SELECT project, dir, name, unnest(generate_series(0, len(name))) AS i FROM n),
    f1 AS (SELECT project, dir, name, CASE WHEN i = 0 THEN name ELSE substr(name, 1, i - 1) || substr(name, i + 1) END AS form FROM o),
    p AS (SELECT project, dir, name, form, unnest(generate_series(0, CASE WHEN len(name) < 5 THEN 0 ELSE len(form) END)) AS i FROM f1),
    f AS (SELECT DISTINCT project, dir, name, CASE WHEN i = 0 THEN form ELSE substr(form, 1, i - 1) || substr(form, i + 1) END AS form FROM p),
    c AS (SELECT DISTINCT a.project, a.dir, a.name AS name_a, b.name AS name_b FROM f a JOIN f b ON a.project = b.project AND a.dir = b.dir AND a.form = b.form AND a.name < b.name),
    d AS (SELECT *, levenshtein(name_a, name_b) AS distance FROM c)
    SELECT * FROM d WHERE distance = 1 OR (distance = 2 AND least(len(name_a), len(name_b)) >= 5)""",
)
def similar_names(spark, sf_dir):
    """Words of all texts that are easily confused, within each language and source."""
    return N.similar_names(document_words(spark, sf_dir))


WORD_PAIRS = (("the", "and"), ("re", "er"), ("ou", "le"), ("en", "an"))


@named(
    "synonym_names",
    "WITH " + _WORDS + """, c AS (SELECT project, dir, contains(name, 'the') AS w1, contains(name, 'and') AS w2, contains(name, 're') AS w3, contains(name, 'er') AS w4,
      contains(name, 'ou') AS w5, contains(name, 'le') AS w6, contains(name, 'en') AS w7, contains(name, 'an') AS w8, count(*) AS n FROM words GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY project, dir ORDER BY w1, w2, w3, w4, w5, w6, w7, w8) AS nth FROM c),
    p AS (SELECT a.project, a.dir, CASE WHEN (a.w1 AND b.w2) OR (a.w2 AND b.w1) THEN 'the/and' WHEN (a.w3 AND b.w4) OR (a.w4 AND b.w3) THEN 're/er'
      WHEN (a.w5 AND b.w6) OR (a.w6 AND b.w5) THEN 'ou/le' WHEN (a.w7 AND b.w8) OR (a.w8 AND b.w7) THEN 'en/an' END AS words,
      CASE WHEN a.nth = b.nth THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS pairs FROM k a JOIN k b ON a.project = b.project AND a.dir = b.dir AND a.nth <= b.nth)
    SELECT project, dir, words, CAST(sum(pairs) AS BIGINT) AS name_pairs FROM p WHERE words IS NOT NULL AND pairs > 0 GROUP BY ALL""",
)
def synonym_names(spark, sf_dir):
    """Pairs of word occurrences of a language and source that mix two syllables of WORD_PAIRS."""
    return N.synonym_names(document_words(spark, sf_dir), WORD_PAIRS).select("project", "dir", "words", "name_pairs")


ENDINGS = ("th", "er", "nd", "ou", "ea", "ti", "os", "al")


@named(
    "ambiguous_abbreviations",
    """SELECT project, path, abbreviation, count(*) AS places FROM (SELECT source AS project, lang || '/' || doc_id AS path, unnest(string_split(replace(lower(text), chr(10), ' '), ' ')) AS abbreviation FROM documents)
    WHERE abbreviation IN ('th', 'er', 'nd', 'ou', 'ea', 'ti', 'os', 'al') GROUP BY ALL""",
)
def ambiguous_abbreviations(spark, sf_dir):
    """Words of each whole text taken as the parts of a file name; short syllables stand for the abbreviations."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.concat("lang", F.lit("/"), "doc_id").alias("path"), "text")
    found = N.ambiguous_abbreviations(docs, F.translate("text", " \n.-/_", "__\x01\x01\x01\x01"), ENDINGS)
    return found.groupBy("project", "path", "abbreviation").agg(F.count(F.lit(1)).alias("places"))

"""Fingerprints, deltas, scores, history and exports."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import deltas as D
from tidemark.operators import findings as W
from tidemark.operators import fingerprints as P
from tidemark.operators import scores as K
from tidemark.operators.skew import numbered_runs, previous_row, top_n_per_key
from tidemark.plans import scan
from tidemark.sources import history as H

FINDING = "project string, check string, rule string, path string, line_no int, line string, message string, severity string, seq int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(("score", "grade"), [(100, "A"), (101, "A"), (90, "A"), (89, "B"), (75, "B"), (74, "C"), (60, "C"), (59, "D"), (40, "D"), (39, "F"), (-1, "F")])
def test_grades(spark, score, grade):
    assert value(spark, S.grade(F.lit(score))) == grade


def test_rounding_and_scores(spark):
    assert [value(spark, S.round_half_up(F.lit(x))) for x in (-2.5, 2.5, 0.49)] == [-2, 3, 0]
    assert [value(spark, S.normal_score(F.lit(x))) for x in ("NaN", "Infinity", "abc", "101", "-3", "72.5")] == [0, 0, 0, 100, 0, 73]
    assert value(spark, S.check_score(F.lit("lint"), F.lit(3), F.lit(4), F.lit(0), F.lit(1))) == 100 - 30 - 8
    assert value(spark, S.check_score(F.lit("security"), F.lit(1), F.lit(1), F.lit(0), F.lit(4))) == 65
    assert value(spark, S.check_score(F.lit("styling"), F.lit(0), F.lit(3), F.lit(9), F.lit(10))) == 100 - 5 - 8
    assert value(spark, S.context_score(F.lit(1), F.lit(2), F.lit(1), F.lit(10))) == 62
    assert value(spark, S.dead_code_score(F.lit(0), F.lit(0), F.lit(26), F.lit(False))) == 98


def test_composite(spark):
    meta = K.check_meta(spark)
    rows = [("a", "testing", 100, "ran"), ("a", "lint", 0, "ran"), ("a", "security", 0, "skipped"), ("b", "docs", 50, "skipped"), ("c", "html-quality", 10, "ran")]
    checks = spark.createDataFrame(rows, "project string, check string, score int, state string")
    assert {r["project"]: (r["score"], r["grade"]) for r in K.composite(checks, meta).collect()} == {"a": (72, "C"), "b": (0, "F"), "c": (0, "F")}


def test_run_states(spark):
    rows = [(None, "runner error: x", False, True), ("skipped", "runner error: x", False, False), ("passed", "", True, False), (None, "", True, True), (None, "", False, True), (None, None, None, None), ("odd", "", False, False)]
    table = spark.createDataFrame(rows, "status string, reason string, unavailable boolean, skipped boolean")
    got = [r["s"] for r in table.select(K.run_state(F.col("status"), F.col("reason"), F.col("unavailable"), F.col("skipped")).alias("s")).collect()]
    assert got == ["runner-error", "skipped", "ran", "unavailable", "skipped", "ran", "ran"]


def prints(spark, rows):
    table = spark.createDataFrame([("p", "c", *r, "warning", i) for i, r in enumerate(rows)], FINDING)
    return {r["seq"]: r["fingerprint"] for r in P.fingerprint(table).collect()}


def test_fingerprint_identity(spark):
    base = [("r", "src/a.ts", 3, "eval(x)", "Eval used")]
    first = prints(spark, base)[0]
    assert len(first) == 16
    assert prints(spark, [("r", "./src/a.ts", 90, "  eval(x) ", "eval  used")])[0] == first  # moved, re-indented, path spelled differently
    assert prints(spark, [("r", "src/a.ts", 3, "eval(y)", "Eval used")])[0] != first
    assert prints(spark, [("r", "src/b.ts", 3, "eval(x)", "Eval used")])[0] != first
    twice = prints(spark, [*base, ("r", "src/a.ts", 9, "eval(x)", "Eval used"), ("r", "src/a.ts", 1, "eval(x)", "Eval used")])
    assert len(set(twice.values())) == 3 and twice[2] == first  # the first by line keeps the plain hash
    vue = [("r", "a.vue", 3, "x", "m"), ("r", "a.vue", 4, "y", "m")]
    assert prints(spark, [vue[0]])[0] == prints(spark, [("r", "a.vue", 7, "z", "m")])[0]
    assert prints(spark, [(None, None, None, None, "project level")])[0]


def test_fingerprint_by_subject(spark):
    rows = [("p", "c", "large-file", "a.ts", "a.ts", 1, f"{n} lines", 0) for n in (400, 900)]
    table = spark.createDataFrame(rows, "project string, check string, rule string, path string, subject string, line_no int, message string, seq int").withColumn("line", F.lit(None).cast("string"))
    one, two = (P.fingerprint(table.where(F.col("message").startswith(n))).collect()[0]["fingerprint"] for n in ("400", "900"))
    assert one == two


def test_fingerprints_do_not_depend_on_partitioning(spark, files):
    table = files({f"f{i}.ts": "eval(a)\neval(a)\n" * (i + 1) for i in range(5)})
    key = lambda t: sorted((r["path"], r["line_no"], r["fingerprint"]) for r in scan.identify(scan.find(t)).collect())
    assert key(table) == key(table.repartition(7)) == key(table.orderBy(F.desc("path")).coalesce(1))


def test_versions(spark):
    c = P.comparable_key(F.lit(None), F.lit(2), F.lit("stored"), F.lit("v1"))
    assert value(spark, c) == "v1" and value(spark, P.comparable_key(F.lit(2), F.lit(2), F.lit("stored"), F.lit("v1"))) == "stored"


def side(spark, rows):
    return spark.createDataFrame([("p", c, f, "a.ts", n, "r", "info", m, n) for c, f, n, m in rows], "project string, check string, fingerprint string, path string, line_no int, rule string, severity string, message string, seq int")


def test_delta_is_a_multiset_difference(spark):
    before = side(spark, [("c", "x", 1, "x"), ("c", "x", 2, "x"), ("c", "x", 3, "x"), ("c", "y", 4, "y"), ("d", "z", 5, "z")])
    after = side(spark, [("c", "x", 1, "x"), ("c", "w", 2, "w"), ("c", "w", 6, "w"), ("c", "y", 9, "y")])
    comparable = spark.createDataFrame([("p", "c")], "project string, check string")
    delta = D.finding_delta(before, after, comparable)
    assert {(r["fingerprint"], r["kind"], r["copies"]) for r in delta.collect()} == {("x", "fixed", 2), ("w", "introduced", 2)}
    assert D.finding_delta_rows(delta).count() == 4
    trend = {(r["fingerprint"], r["kind"], r["line_no"]) for r in D.finding_trend(before, after).collect()}
    assert trend == {("x", "fixed", 2), ("x", "fixed", 3), ("z", "fixed", 5), ("w", "introduced", 2), ("w", "introduced", 6)}


def test_transitions(spark):
    schema = "project string, check string, state string, score int"
    before = spark.createDataFrame([("p", "lint", "ran", 50), ("p", "docs", "ran", 70), ("p", "types", "skipped", None), ("p", "same", "ran", 9)], schema)
    after = spark.createDataFrame([("p", "lint", "ran", 80), ("p", "types", "unavailable", None), ("p", "new", "ran", 60), ("p", "same", "ran", 9)], schema)
    rows = {r["check"]: (r["before"], r["after"], r["delta"], r["transition"]) for r in D.check_delta(before, after).collect()}
    assert rows == {
        "lint": (50, 80, 30, None), "docs": (70, None, 0, "ran → absent"), "types": (None, None, 0, "skipped → unavailable"), "new": (None, 60, 0, "absent → ran"),
    }


def test_gate(spark):
    table = spark.createDataFrame([(59, None, None, True), (59, 50, 80, True), (10, None, None, False), (70, None, 71, False)], "score int, flag int, config int, ci boolean")
    assert [(r["threshold"], r["threshold_source"], r["passed"]) for r in W.gate(table).collect()] == [
        (60, "ci default", False), (50, "flag", True), (0, "none", True), (71, "config", False),
    ]


def test_normalised_checks(spark):
    rows = [("lint", "NaN", False, False, False, "", 0, 0), ("docs", "0", True, False, False, "", 0, 0), ("lint", "0", True, False, False, "runner error: x", 0, 0), ("html-quality", "10", False, False, False, "", 2, 2)]
    table = spark.createDataFrame(rows, "check string, raw_score string, skipped boolean, unavailable boolean, synthetic boolean, reason string, n_findings int, n_errors int")
    got = [(r["score"], r["status"], r["score_mode"], r["invalid_score"]) for r in K.normalise_checks(table, K.check_meta(spark)).collect()]
    assert got == [(0, "failed", "available-scored", True), (100, "skipped", "not-applicable", False), (0, "failed", "not-applicable", False), (10, "passed", "available-unscored", False)]


# --- skew helpers -------------------------------------------------------------------------
def hot(spark):
    return spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), ((F.col("id") * 7919) % 3000).alias("at"), (F.col("id") % 17).alias("v"))


def test_top_n_of_a_hot_key(spark):
    table = hot(spark).cache()
    table.createOrReplaceTempView("hot_rows")
    plain = spark.sql("select key, at, v, r rank from (select *, row_number() over (partition by key order by at desc) r from hot_rows) where r <= 7")
    got = top_n_per_key(table, ["key"], [F.desc("at")], 7)
    assert sorted(got.collect()) == sorted(plain.select(*got.columns).collect())


def test_previous_row_of_a_hot_key(spark):
    table = hot(spark).cache()
    table.createOrReplaceTempView("hot_rows")
    plain = spark.sql("select *, lag(v) over (partition by key order by at) p from hot_rows")
    got = previous_row(table, ["key"], ["at"], F.col("v"), [F.floor(F.col("at") / 10), F.floor(F.col("at") / 500)], "p")
    assert sorted(got.collect(), key=str) == sorted(plain.select(*got.columns).collect(), key=str)


def test_runs_across_stretches(spark):
    positions = [*range(4000, 9000), 9002, *range(20000, 20003)]
    table = spark.createDataFrame([("a", p) for p in positions] + [("b", 1)], "key string, at int")
    rows = {(r["key"], r["start"], r["stop"], r["size"]) for r in numbered_runs(table, ["key"], "at").collect()}
    assert rows == {("a", 4000, 8999, 5000), ("a", 9002, 9002, 1), ("a", 20000, 20002, 3), ("b", 1, 1, 1)}


# --- stored scans -----------------------------------------------------------------------------
def snapshot(i, **more):
    issue = {"fingerprint": "f1", "severity": "error", "message": "m"}
    checks = [{"name": "lint", "score": 80, "issues": [issue, {"severity": "error", "message": "m"}]}]
    return json.dumps({"project": "p", "scan_id": f"s{i:03}", "timestamp": f"2024-01-01T00:{i:02}:00Z", "score": i, "checks": checks, **more})


def test_history_from_snapshots(spark, tmp_path):
    lines = [snapshot(i) for i in range(40)] + ["{broken", snapshot(50, score=None), snapshot(51, meta={"scan": {"diffBase": "main"}}), snapshot(52, checks=None)]
    (tmp_path / "h.json").write_text("\n".join(lines))
    snapshots = H.read_snapshots(spark, str(tmp_path))
    rows = H.load_history(snapshots).orderBy("point").collect()
    assert [r["score"] for r in rows] == [float(i) for i in range(10, 40)] and [r["point"] for r in rows] == list(range(1, 31))
    assert H.history_findings(snapshots.where("scan_id = 's001'")).count() == 1


def test_scan_sink_round_trip(spark, tmp_path):
    scans = spark.sql("select 'p' project, timestamp'2024-01-02 03:04:05' scan_ts, 90 score")
    findings = spark.sql("select 'p' project, timestamp'2024-01-02 03:04:05' scan_ts, 'f' fingerprint")
    for _ in range(2):
        H.write_scan(scans, findings, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "scans"))
    assert back.count() == 2 and str(back.first()["scan_date"]) == "2024-01-02"


def test_sarif_documents(spark, tmp_path):
    rows = [("p", "c", "r1", "error", "a.ts:3", 3, "m1"), ("p", "c", None, "info", None, None, "m2"), ("q", "c", "r1", "warning", "b.ts", None, "m3")]
    findings = spark.createDataFrame(rows, "project string, check string, rule string, severity string, path string, line_no int, message string")
    H.write_sarif(findings, str(tmp_path / "out"), "tidemark", "1")
    logs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(logs) == 2 and all(log["version"] == "2.1.0" for log in logs)
    results = [x for log in logs for x in log["runs"][0]["results"]]
    one = next(x for x in results if x["message"]["text"] == "[c] m1")
    assert one["level"] == "error" and one["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.ts"}, "region": {"startLine": 3}}
    two = next(x for x in results if x["message"]["text"] == "[c] m2")
    assert two["ruleId"] == "c" and two["level"] == "note" and "locations" not in two


def test_registered_check_joins_the_scan(spark, files):
    scan.register_check("custom", lambda f: f.select("project", "path", F.lit("custom").alias("check"), F.lit("seen").alias("rule"), F.lit("info").alias("severity"), F.lit("hello").alias("message"), F.lit(0).alias("seq")))
    try:
        table = files({"a.ts": "eval(x) // password: hunter22", "b.ts": ""})
        found = scan.identify(scan.find(table))
        assert {r["rule"] for r in found.collect()} >= {"seen", "CWE-94"}
        assert found.where(F.col("line").contains("hunter22")).count() == 0
        checks, total = scan.score(found, table, ["security", "secrets"])
        assert {r["check"]: r["score"] for r in checks.collect()}["security"] == 65
        assert total.count() == 1
    finally:
        scan._custom_checks.clear()


def test_pack_from_rows(spark, files):
    pack = scan.pack_from_rows("mine", [{"check": "standards", "rule": "no-foo", "severity": "info", "message": "foo", "pattern": r"\bfoo\b"}])
    assert scan.find(files({"a.ts": "foo food"}), [pack]).count() == 1


def test_explicit_metrics_come_first(spark):
    listed = '[{"id": "a", "label": "A", "value": 3, "unit": "ms", "trend": "neutral"}, {"id": 5, "label": "B", "value": 1}, {"id": "c", "label": "C", "value": {}}, 7, null, {"id": "d", "label": "D", "value": "12", "unit": "miles"}, {"id": "e", "label": "E", "value": true}, {"id": "f", "label": "F", "value": 0.5}]'
    rows = [(1, {"metrics": listed, "avgScore": "80"}), (2, {"metrics": '[{"id": "x"}]', "avgScore": "80"}), (3, {"metrics": "no list"}), (4, {"metrics": '{"id": "a"}', "name": "n"}), (5, None)]
    got = K.snapshot_metrics(spark.createDataFrame(rows, "check int, details map<string,string>"), ["check"]).collect()
    assert [tuple(r) for r in sorted(got)] == [
        (1, 1, "a", "A", 3.0, None, "ms", "neutral"), (1, 2, "d", "D", None, "12", None, None), (1, 3, "e", "E", None, "true", None, None), (1, 4, "f", "F", 0.5, None, None, None),
        (2, 1, "avgScore", "Avg Score", 80.0, None, "score", "higher-is-better"), (4, 1, "name", "Name", None, "n", None, "neutral"),
    ]

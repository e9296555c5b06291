"""Cycles, graph metrics, path policy, report parsers, corpus reader and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans import scan
from tidemark.plans.stream_queries import _with_state_store, run_to_end
from tidemark.sources import corpus
from tidemark.sources import policy as L
from tidemark.sources import reports as R
from tidemark.streaming import jobs as J


def components(edges):
    nodes = {n for e in edges for n in e}
    out = {n: set() for n in nodes}
    for a, b in edges:
        out[a].add(b)

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            for n in out[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    reached = {n: reach(n) for n in nodes}
    groups = {n: {m for m in reached[n] if n in reached[m]} | {n} for n in nodes}
    return {(n, max(g), len(g)) for n, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 12, 14), (2, 30, 40), (3, 25, 25), (4, 8, 30)])
def test_cycles_against_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    table = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    got = {(r["node"], r["component"], r["size"]) for r in G.strongly_connected(table).collect()}
    assert got == components({e for e in edges if e[0] != e[1]})


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    """A ring, a chain that hangs on it and one that stands alone, a ring of two chains, and a loop at a node of no other group."""
    n, rng = 20_000, random.Random(3)
    names = rng.sample(range(10 * n), 4 * n)
    ring, chain, two, loop = (names[i * n : (i + 1) * n] for i in range(4))
    edges = [*zip(ring, ring[1:] + ring[:1]), *zip(chain, chain[1:]), *zip(two, two[1:] + two[:1]), (two[100], two[9000]), (two[100], chain[0])]
    edges += [*zip(loop[:50], loop[1:50] + loop[:1]), *zip(loop[50:], loop[51:]), (loop[0], loop[50])]
    rounds = []
    write = G.Scratch.write
    monkeypatch.setattr(G.Scratch, "write", lambda self, *a: rounds.append(0) or write(self, *a))
    found = G.strongly_connected(spark.createDataFrame(edges, "src long, dst long").repartition(4))
    groups = {}
    for r in found.collect():
        groups.setdefault((r["component"], r["size"]), set()).add(r["node"])
    assert groups == {(max(g), len(g)): set(g) for g in (ring, two, loop[:50])}
    assert len(rounds) < 80


def test_no_cycles(spark):
    table = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(3, 3)], "src bigint, dst bigint")
    assert G.strongly_connected(table).count() == 0


def test_two_rings_and_a_bridge(spark):
    table = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f")], "src string, dst string")
    found = G.strongly_connected(table)
    assert {(r["node"], r["component"]) for r in found.collect()} == {("a", "b"), ("b", "b"), ("c", "e"), ("d", "e"), ("e", "e")}
    assert sorted(r["members"] for r in G.cycle_findings(found).collect()) == [2, 3]


def test_policy_evidence(spark):
    paths = [
        "src/a.ts", "node_modules/x/index.js", "src/app.min.js", ".env.local", "secrets/.env", "packages/b/k.pem", "tmp/.env", "dist/.env", "yarn.lock", ".yarn/cache/x.zip",
        "screenshot-1.html", "legacy/x.ts", "a/legacy", "./src\\b.ts", ".hidden/x.ts",
    ]
    policy = L.Policy(config_patterns=("legacy/**",), user_names=("secrets",), gitignore_names=("packages/b", "tmp"), ignore_hidden=False)
    rows = L.apply_path_policy(spark.createDataFrame([(p,) for p in paths], "path string"), policy).collect()
    action = {r["path"]: (r["action"], r["classification"]) for r in rows}
    assert action == {
        "src/a.ts": ("include", "normal"), "node_modules/x/index.js": ("exclude", "normal"), "src/app.min.js": ("exclude", "generated"), ".env.local": ("include", "security-sensitive"),
        "secrets/.env": ("include-security-sensitive", "security-sensitive"), "packages/b/k.pem": ("include-security-sensitive", "security-sensitive"),
        "tmp/.env": ("include-security-sensitive", "security-sensitive"), "dist/.env": ("exclude", "generated"), "yarn.lock": ("exclude", "lockfile"),
        ".yarn/cache/x.zip": ("exclude", "generated"), "screenshot-1.html": ("exclude", "generated"), "legacy/x.ts": ("exclude", "normal"), "a/legacy": ("include", "normal"),
        "./src\\b.ts": ("include", "normal"), ".hidden/x.ts": ("include", "normal"),
    }
    dist = next(r for r in rows if r["path"] == "dist/.env")
    assert [(e["precedence"], e["source"], e["reason"]) for e in dist["evidence"]] == [(10, "security-sensitive", "security-sensitive"), (40, "default-directory", "build-output")]
    hidden = L.apply_path_policy(spark.createDataFrame([(".hidden/x.ts",)], "path string"), L.Policy(ignore_hidden=True)).collect()[0]
    assert hidden["reasons"] == ["hidden-directory"]
    assert L.policy_summary(policy)["config-ignore"] == 1


def test_no_finding_names_an_excluded_path(spark, files):
    table = files({"src/a.ts": "eval(x)", "dist/a.ts": "eval(x)", "node_modules/m/a.ts": "eval(x)", "src/a.generated.ts": "eval(x)", "vendor/x.ts": "eval(x)"})
    decided = L.classify_files(L.apply_path_policy(table.withColumn("size", F.length("content"))))
    kept = L.select_files(decided, "source")
    assert {r["path"] for r in scan.find(kept.select("project", "path", "content")).collect()} == {"src/a.ts"}


def test_file_kinds(spark):
    paths = ["a.test.ts", "tests/x.py", "x/index.html", "README.md", ".env", "package.json", "src/a.vue", "logo.svg", "Makefile", "x_test.dart"]
    kinds = {r["path"]: r["kind"] for r in L.classify_files(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert list(kinds.values()) == ["test", "test", "html", "doc", "env", "config", "source", "asset", "unknown", "test"]


def test_corpus_reader(spark, tmp_path):
    for name, text in (("p/src/a.ts", "eval('é')"), ("p/b.md", "x"), ("q/big.ts", "y" * 2000)):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    rows = corpus.read_corpus(spark, str(tmp_path), str(tmp_path), max_bytes=1000).collect()
    assert {(r["project"], r["path"], r["content"]) for r in rows} == {("p", "src/a.ts", "eval('é')"), ("p", "b.md", "x")}


def raw(spark, body):
    return spark.createDataFrame([("p", body)], "project string, body string")


def test_parsers_survive_bad_input(spark):
    for body in ("", "not json", "[]", "{}", "null", '{"issues": 3}', '{"diagnostics": null}'):
        table = raw(spark, body)
        for tool in ("eslint", "stylelint", "biome"):
            assert R.parse_lint_reports(table, tool).count() == 0
        assert R.parse_dead_code(table).count() == 0 and R.parse_test_cases(table).count() == 0 and R.parse_coverage_summary(table).count() == 0
        assert R.parse_audit(table).collect()[0]["critical"] == 0 and R.parse_compiler_log(table).count() == 0
        assert R.parse_test_runs(table).collect()[0]["parsed"] is False


def test_statuses(spark):
    rows = [("a", True, 3, 0, 3, False), ("a", True, 3, 0, 3, False), ("b", True, 2, 0, 3, False), ("c", False, 0, 0, 0, True), ("d", True, 0, 0, 0, False), ("e", False, 0, 0, 0, False), ("f", True, 1, 1, 2, False)]
    runs = spark.createDataFrame(rows, "project string, parsed boolean, passed bigint, failed bigint, total bigint, timed_out boolean")
    assert {r["project"]: r["status"] for r in R.combined_status(R.run_status(runs)).collect()} == {
        "a": "passed", "b": "partial", "c": "timeout", "d": "no-tests-matched", "e": "parse-failed", "f": "failed",
    }


# --- streams fed file by file -------------------------------------------------------------
SCAN = "project string, check string, scan_ts timestamp, scan_id bigint, score bigint"
FOUND = "project string, check string, scan_ts timestamp, scan_id bigint, fingerprint string"


def fed(spark, tmp_path, schema, batches, job):
    """Rows that a job emits when ``batches`` arrive one by one, each in a run that goes on from the checkpoint, and then time passes.

    Rows have minutes in place of scan_ts. A micro-batch sees the watermark of those before it.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    out = str(tmp_path / "out")

    def feed():
        for rows in [*batches, [(None, None, 10**6, None, None)]]:
            df = spark.createDataFrame(rows, schema.replace("scan_ts timestamp", "scan_ts bigint"))
            df.withColumn("scan_ts", F.timestamp_seconds(F.col("scan_ts") * 60 + 1704067200)).select(names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            J.append_to(job(stream), out, str(tmp_path / "state")).awaitTermination()

    _with_state_store(spark, feed)
    return spark.read.parquet(out)


def score_changes(rows):
    """Changes by (project, check) in the order of time, over rows of (project, check, minute, scan_id, score)."""
    out, last = set(), {}
    for project, check, _, scan_id, score in sorted(rows, key=lambda r: (r[2], r[3])):
        before = last.get((project, check))
        if before is not None and before != score:
            out.add((project, check, scan_id, before, score, score - before))
        last[project, check] = score
    return out


def test_scores_are_compared_in_order_of_time_and_late_scans_go_out(spark, tmp_path):
    batches = [
        [("1", "lint", 0, 1, 50), ("1", "lint", 120, 3, 70), ("2", "lint", 0, 2, 10)],
        [("1", "lint", 60, 4, 99), ("1", "lint", 30, 9, 5), ("1", "lint", 180, 5, 70), ("1", "lint", 240, 6, 20)],
    ]
    rows = fed(spark, tmp_path, SCAN, batches, lambda s: J.live_delta(s, "1 hour", "1 hour"))
    found = {(r["kind"], r["scan_id"], r["before"], r["after"], r["delta"]) for r in rows.collect()}
    assert found == {("change", 4, 50, 99, 49), ("change", 3, 99, 70, -29), ("change", 6, 70, 20, -50), ("late", 9, None, 5, None)}
    assert J.regression_alerts(rows, 30).count() == 1


def test_shuffled_scans_give_the_batch_twin_of_all_that_is_not_late(spark, tmp_path):
    patience, draw = "5 hours", random.Random(7)
    rows = [(draw.choice("aaab"), draw.choice(["x", "y"]), draw.randint(0, 2000), i, draw.randint(0, 3)) for i in range(300)]
    draw.shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    found = fed(spark, tmp_path, SCAN, batches, lambda s: J.live_delta(s, patience, "3 hours")).collect()
    late = {r["scan_id"] for r in found if r["kind"] == "late"}
    mark, expected = -(10**9), set()
    for batch in batches:
        expected |= {r[3] for r in batch if (r[2] // 180 + 1) * 180 <= mark}
        mark = max(mark, max(r[2] for r in batch) - int(patience.split()[0]) * 60)
    assert late == expected and late
    assert sum(r["kind"] == "late" for r in found) == len(late)
    changes = [(r["project"], r["check"], r["scan_id"], r["before"], r["after"], r["delta"]) for r in found if r["kind"] == "change"]
    assert len(changes) == len(set(changes)) and set(changes) == score_changes([r for r in rows if r[3] not in late])


def test_shuffled_findings_give_the_batch_twin(spark, tmp_path):
    patience, draw = "5 hours", random.Random(8)
    scans = [(draw.choice("ab"), "c", draw.randint(0, 2000), i, draw.choices("fgh", k=draw.randint(0, 3))) for i in range(80)]
    rows = [(p, c, m, i, f) for p, c, m, i, found in scans for f in found or [None]]
    groups = [[r for r in rows if r[3] % 3 == k] for k in range(3)]
    found = fed(spark, tmp_path, FOUND, groups, lambda s: J.live_finding_delta(s, patience, "3 hours")).collect()
    late = {r["scan_id"] for r in found if r["kind"] == "late"}
    assert late
    expected, last = [], {}
    for p, c, _, i, prints in sorted(scans, key=lambda s: (s[2], s[3])):
        if i in late:
            continue
        if p in last:
            for f in "fgh":
                gap = prints.count(f) - last[p].count(f)
                if gap:
                    expected.append((p, c, i, f, "introduced" if gap > 0 else "fixed", abs(gap)))
        last[p] = prints
    assert sorted((r["project"], r["check"], r["scan_id"], r["fingerprint"], r["kind"], r["copies"]) for r in found if r["kind"] != "late") == sorted(expected)


@pytest.mark.parametrize("slide", [None, "1 hour"])
def test_windows_late_rows_and_input_add_up(spark, tmp_path, slide):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), "c", draw.randint(0, 1500), i, draw.choice([None, 1, 5])) for i in range(200)]
    batches = [rows[i::4] for i in range(4)]
    found = fed(spark, tmp_path, SCAN, batches, lambda s: J.live_trend(s, "3 hours", slide, "4 hours")).collect()
    windows, late, mark, step = {}, 0, -(10**9), 60 if slide else 180
    for batch in batches:
        for p, _, m, _, score in batch:
            for start in range(m // step * step, m - 180, -step):
                if start + 180 <= mark:
                    late += 1
                else:
                    windows.setdefault((p, start), []).append(score)
        mark = max(mark, max(r[2] for r in batch) - 240)
    got = {(r["project"], int(r["window_start"].timestamp() - 1704067200) // 60): (r["scans"], r["lowest"], r["total"]) for r in found if r["kind"] == "window"}
    known = {k: [s for s in v if s is not None] for k, v in windows.items()}
    assert got == {k: (len(v), min(known[k], default=None), sum(known[k]) if known[k] else None) for k, v in windows.items()}
    assert late and sum(r["scans"] for r in found if r["kind"] == "late") == late
    assert sum(r["kind"] == "window" for r in found) == len(windows)


class _CountedState:
    """A list state and its handle that count round trips."""

    def __init__(self):
        self.rows, self.trips, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.trips += 1
        self.timers.append(at)

    def exists(self):
        self.trips += 1
        return bool(self.rows)

    def appendList(self, rows):
        self.trips += 1
        self.rows += rows

    def get(self):
        self.trips += 1
        return iter(self.rows)

    def clear(self):
        self.trips += 1
        self.rows = []

    def getCurrentWatermarkInMs(self):
        return 0


def test_round_trips_of_streams_dont_grow_with_keys():
    from pyspark.sql import Row

    state = _CountedState()
    stretch = J.ScoreStretch("string")
    stretch.init(state)
    for turn in range(2):
        rows = [Row(project=f"p{i}", check="c", at=turn, scan_id=turn, score=turn) for i in range(100)]
        assert not list(stretch.handleInputRows((7, 60), iter(rows), state))
    found = list(stretch.handleExpiredTimer((7, 60), state, None))
    assert sum(r["kind"] == "change" for r in found) == sum(r["kind"] == "edge" for r in found) == 100
    assert state.trips <= 7 and state.timers == [60]
    state = _CountedState()
    window = J.ScoreWindow("string")
    window.init(state)
    for turn in range(2):
        rows = [Row(project=f"p{i}", scans=1, lowest=turn or None, total=turn or None) for i in range(100)]
        assert not list(window.handleInputRows((7, 0, 60), iter(rows), state))
    found = list(window.handleExpiredTimer((7, 0, 60), state, None))
    assert {(r["kind"], r["start"], r["scans"], r["lowest"], r["total"]) for r in found} == {("window", 0, 2, 1, 1)} and len(found) == 100
    assert state.trips <= 7


def test_replays_are_cut_into_several_micro_batches(spark):
    from tidemark.plans import stream_queries as Q

    events = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 3600 + 1704067200).alias("ts"))
    seen = Q.replayed(events, lambda e: e.select("id", F.col("ts")), batches=6)
    files = {f for f in seen.select("id").inputFiles()}
    assert len(files) >= 7 and seen.where("id is not null").count() == 200 and seen.where("id is null").count() == 1


def test_streamed_scan_equals_batch(spark, files, tmp_path):
    table = files({f"f{i}.ts": "ok\ntoken = 'abcdefghijklmnopqrstuvwx'\n" * i for i in range(6)})
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = run_to_end(J.continuous_scan(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))))
    from tidemark.catalog.rules import SECRETS
    from tidemark.operators.rules import scan_lines, to_lines

    key = ["project", "path", "line_no", "rule"]
    assert sorted(streamed.select(key).collect()) == sorted(scan_lines(to_lines(table), SECRETS).select(key).collect())
    assert streamed.where(F.col("line").contains("abcdefgh")).count() == 0

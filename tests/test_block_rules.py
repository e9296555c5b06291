"""Rules over blocks, neighbouring lines, files and projects."""

from pyspark.sql import functions as F

from tidemark.operators import block_rules as B


def rules(df):
    return {(r["path"], r["line_no"], r["rule"]) for r in df.collect()}


def test_test_blocks(spark, files):
    table = files({"a.test.ts": "\n".join([
        "it('empty', () => {", "});", "it('none', () => {", "  run();", "});", "test('trivial', () => {", "  expect(true).toBe(true);", "});",
        "it('weak', () => {", "  expect(x).toBeDefined();", "});", "it('good', () => {", "  if (x) {", "    expect(x).toBe(2);", "  }", "});",
        "it('mocks', () => {", "  vi.fn(); vi.fn(); vi.fn();", "  expect(x).toBe(2);", "});",
    ])})
    assert rules(B.audit_tests(table)) == {
        ("a.test.ts", 1, "empty-test"), ("a.test.ts", 3, "no-assertions"), ("a.test.ts", 6, "trivial-assertions"), ("a.test.ts", 9, "weak-assertions"), ("a.test.ts", 17, "mock-heavy"),
    }


def test_triggers_anywhere_in_a_file(spark, files):
    assert rules(B.audit_tests(files({"b.test.ts": "import x from 'y'\n\ndescribe('d', () => {\n  it('e', () => {\n  });\n});"}))) == {("b.test.ts", 4, "empty-test")}


def test_dead_patterns(spark, files):
    table = files({
        "a.ts": "try {\n  a()\n} catch (e) {\n  const x = load()\n  use(x)\n  keep(x)\n  done()\n}", "b.ts": "} catch (e) {\n  console.log(e)\n}",
        "f.ts": "const USE_NEW = true\nif (USE_NEW) go()\nconst ENABLE_X = false", "n.ts": "// handles 5 cases\nswitch (x) {\n case 1:\n case 2:\n}\n", "ok.ts": "// 2 cases\nswitch (x) {\n case 1:\n case 2:\n}\n",
    })
    assert rules(B.fallback_catches(table)) == {("a.ts", 3, "fallback-catch")}
    assert rules(B.hardcoded_flags(table)) == {("f.ts", 1, "hardcoded-flag")}
    assert rules(B.numeric_mismatches(table)) == {("n.ts", 1, "numeric-mismatch")}


def test_components(spark, files):
    table = files({
        "a.tsx": "useEffect(() => {\n  go();\n});\nuseEffect(() => {\n  go();\n}, [x]);".replace("\nuseEffect(() => {\n  go();\n}, [x]);", ""), "b.tsx": "useEffect(() => {\n  go();\n}, [x]);",
        "k.tsx": "xs.map((x) => <li>{x}</li>)\nys.map((y) => y + 1)", "l.tsx": "xs.map((x) => (\n  <li key={x}>{x}</li>\n))", "p.tsx": "<p>\n  <div>x</div>\n</p>\n<a>y</a>",
        "form.tsx": '<input name="a">\n\n\n\n\n\n\n<label>b</label>\n<input name="b">\n<input type="hidden">', "img.tsx": '<img\n  src="a"\n  alt="b"\n>', "img2.tsx": "<img src=a>", "v.vue": '<li v-for="x in y">\n<li v-for="x in y" :key="x">',
    })
    assert rules(B.effects_without_dependencies(table)) == {("a.tsx", 1, "effect-no-deps")}
    assert rules(B.missing_keys(table)) == {("k.tsx", 1, "missing-key")}
    assert rules(B.nested_markup(table)) == {("p.tsx", 2, "dom-nesting")}
    assert rules(B.unlabelled_controls(table)) == {("form.tsx", 1, "form-label"), ("img2.tsx", 1, "img-alt"), ("v.vue", 1, "vue-v-for-key")}


def test_sql(spark, files):
    table = files({
        "a.ts": "for (const x of xs) {\n  db.prepare('SELECT a FROM t WHERE b = ?').first()\n}", "b.ts": "const s = db.prepare('INSERT INTO t VALUES (?)')\n" + "\n" * 20 + "s.bind(1)",
        "c.ts": "db.prepare('SELECT a FROM t WHERE b = ?')\n  .bind(x)",
    })
    assert rules(B.queries_in_loops(table)) == {("a.ts", 2, "query-in-loop")}
    assert rules(B.unbound_placeholders(table)) == {("a.ts", 2, "missing-bind")}


def test_workflows_and_containers(spark, files):
    table = files({
        "bad.yml": "on: pull_request_target\nenv:\n  KEY: ${{ secrets.KEY }}\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}\n      - uses: some/action@v1\n      - run: echo ${{ github.head_ref }}\n      - run: npm publish # NPM_TOKEN",
        "good.yml": "on: push\njobs:\n  a:\n    env:\n      KEY: ${{ secrets.KEY }}\n    steps:\n      - uses: some/action@" + "a" * 40 + "\n      - run: echo hi",
    })
    assert rules(B.workflow_findings(table)) == {
        ("bad.yml", None, "pin-actions-to-sha"), ("bad.yml", None, "pwn-request"), ("bad.yml", None, "prefer-oidc"), ("bad.yml", None, "secrets-in-global-env"), ("bad.yml", 11, "gha-script-injection"),
    }
    docker = files({"Dockerfile": "FROM node:22\nCOPY . .\nRUN npm install", "ok/Dockerfile": "COPY package.json .\nRUN npm install\nCOPY . ."})
    assert rules(B.cache_busting(docker)) == {("Dockerfile", 2, "cache-bust")}


def test_projects_and_tracked_files(spark, files):
    table = files({("p", "a.tsx"): "express()", ("q", "b.tsx"): "createServer(); process.on('unhandledRejection'); <ErrorBoundary>"})
    assert {(r["project"], r["rule"]) for r in B.project_findings(table).collect()} == {("p", "no-rejection-handler"), ("p", "no-error-boundary")}
    sizes = spark.createDataFrame([("p", "a.zip", 10), ("p", "b.ts", 6_000_000), ("p", "c.ts", 5)], "project string, path string, size bigint")
    assert {(r["path"], r["rule"]) for r in B.tracked_files(sizes).collect()} == {("a.zip", "binary-in-git"), ("b.ts", "large-file")}

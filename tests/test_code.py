"""Tokens, masking, functions and clones."""

import random

import pytest

from tidemark.operators import code as C
from tidemark.operators import naming as N

BLOCK = "\n".join([
    "function handleOrder(order) {", "  const total = order.items.reduce((sum, i) => sum + i.price * i.count, 0);", "  const tax = total * order.region.rate;",
    "  const label = order.id + ':' + order.customer.name;", "  const paid = order.payments.some((p) => p.state === 'done');", "  log.write(label, total, tax, paid);",
    "  return { total, tax, label, paid };", "}",
])


def found(files, contents, n=50):
    return [r.asDict() for r in C.clones(files(contents), n).collect()]


def test_block_in_two_files_is_one_clone(spark, files):
    rows = found(files, {"src/a.ts": BLOCK + "\nexport const a = 1;\n", "src/b.ts": "// intro\n" + BLOCK + "\nexport const b = 2;\n"})
    assert len(rows) == 1
    assert (rows[0]["path"], rows[0]["origin_path"], rows[0]["start_line"], rows[0]["lines"] >= 8) == ("src/b.ts", "src/a.ts", 2, True)


def test_what_is_no_clone(spark, files):
    imports = "\n".join(f"import {{ mod{i} }} from './mod{i}';" for i in range(30))
    table = "\n".join(f'  if (key === "k{i}") return "value {i}";' for i in range(18))
    assert not found(files, {"a.ts": imports + "\nexport const a = 1;", "b.ts": imports + "\nexport const b = 2;"})
    assert not found(files, {"t.ts": f"function f(key) {{\n{table}\n}}"})
    assert not found(files, {"a.ts": "function tiny() {\n  return 1 + 2;\n}", "b.ts": "function tiny() {\n  return 1 + 2;\n}"})
    assert not found(files, {"a.ts": "", "b.ts": "x"})


def test_copies_grow_linearly(spark, files):
    rows = found(files, {f"f{i}.ts": BLOCK for i in range(9)})
    assert len(rows) == 8 and {r["origin_path"] for r in rows} == {"f0.ts"}


def clones_by_definition(contents, width):
    """(path, origin, first token, tokens) of the runs on the diagonals that first occurrences name, apart from those inside another one."""
    tokens = {p: [t for t, _ in C.tokenise(text)] for p, text in contents.items()}
    windows = {p: [tuple(t[i : i + width]) for i in range(len(t) - width + 1)] for p, t in tokens.items()}
    first, diagonals, covered = {}, set(), set()
    for p in sorted(windows):
        for i, w in enumerate(windows[p]):
            o, j = first.setdefault(w, (p, i))
            if p != o or i >= j + width:
                diagonals.add((p, o, i - j))
                covered.add((p, o, i))
    runs = {}
    for p, o, shift in diagonals:
        same = [i for i in range(len(windows[p])) if 0 <= i - shift < len(windows[o]) and windows[p][i] == windows[o][i - shift]]
        for i in same:
            if i - 1 not in same:
                stop = next(k for k in range(i, len(windows[p]) + 1) if k + 1 not in same)
                runs.setdefault((p, o), set()).add((i, stop, shift))
    out = set()
    for pair, found in runs.items():
        for a, b, shift in found:
            if not any(x <= a and b <= y and ((x, y) != (a, b) or s < shift) for x, y, s in found):
                out.add((*pair, a, b - a + width))
    return out, covered


def test_clones_equal_brute_force(spark, files):
    rng = random.Random(5)
    width, contents = 6, {}
    for f in range(14):
        contents[f"f{f:02}"] = "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 90)))
    contents["g"], contents["h"] = "\n".join("x" * 40), "\n".join("ab" * 30)
    expected, covered = clones_by_definition(contents, width)
    rows = found(files, contents, width)
    # A token a line: the line is the token's number.
    assert {(r["path"], r["origin_path"], r["start_line"] - 1, r["tokens"]) for r in rows} == expected and len(rows) == len(expected)
    for path, origin, i in covered:
        assert any((r["path"], r["origin_path"]) == (path, origin) and r["start_line"] - 1 <= i <= r["end_line"] - width for r in rows)
    assert all(r["lines"] == r["tokens"] == r["end_line"] - r["start_line"] + 1 for r in rows)


def test_a_clone_is_whole_where_a_third_file_holds_a_part(spark, files):
    words = [f"w{i}" for i in range(200)]
    part = "\n".join(words[80:140])
    rows = found(files, {"a.ts": part, "b.ts": "\n".join(words), "c.ts": "intro\n" + "\n".join(words)})
    assert {(r["path"], r["origin_path"], r["start_line"], r["origin_line"], r["tokens"]) for r in rows} == {("b.ts", "a.ts", 81, 1, 60), ("c.ts", "a.ts", 82, 1, 60), ("c.ts", "b.ts", 2, 1, 200)}


def test_token_arrays_equal_the_tokeniser():
    sources = ["", "const x = 1; // c\n/* b\n */ f(`a ${b}\nc`, 'it''s')\n\"open", "import { a } from './a';\n\nexport const é_1 = \"\\\"\"; /* open\n", "a\r\n\tb // x\n'\\\n' /"]
    known = C.Vocabulary()
    code_of = {}
    for source in sources * 2:
        expected = C.tokenise(C.blank_imports(source))
        codes, lines = known.token_arrays(source)
        assert lines.tolist() == [line for _, line in expected] and len(codes) == len(expected)
        assert all(code_of.setdefault(token, code) == code for (token, _), code in zip(expected, codes.tolist()))
    assert len(set(code_of.values())) == len(code_of)


def test_windows_are_shuffled_packed(spark, files):
    """A row per batch and bucket, not one per window of tokens."""
    tokens = C.token_table(files({f"f{i}": " ".join(f"w{i}x{j}" for j in range(500)) for i in range(20)}).coalesce(1), 50)
    rows = C._window_buckets(tokens, 50, 3).collect()
    assert len(rows) <= 3 * 4 and sum(len(r["windows"]) for r in rows) == 20 * 451 * 18


def dealt_files(monkeypatch):
    """Collects (path, number of windows made) of the files whose windows are dealt to buckets."""
    dealt, deal = [], C._window_buckets
    monkeypatch.setattr(C, "_window_buckets", lambda tokens, *a: dealt.extend((r["path"], sum(r["kept"])) for r in tokens.collect()) or deal(tokens, *a))
    return dealt


def test_windows_are_made_only_where_anchors_recur(spark, files, monkeypatch):
    dealt = dealt_files(monkeypatch)
    shared = " ".join(f"s{j}" for j in range(60))
    own = {f"f{i:02}": " ".join(f"w{i}x{j}" for j in range(400)) for i in range(30)}
    rows = found(files, own | {"g": own["f00"] + " end", "h": " ".join(f"h{j}" for j in range(300)) + " " + shared, "i": shared})
    assert {(r["path"], r["origin_path"], r["tokens"]) for r in rows} == {("g", "f00", 400), ("i", "h", 60)}
    assert {path for path, _ in dealt} == {"f00", "g", "h", "i"} and sum(n for _, n in dealt) < 2 * (351 + 11 + 26)


def test_copies_of_a_text_are_compared_once(spark, files, monkeypatch):
    dealt = dealt_files(monkeypatch)
    rng = random.Random(11)
    width, contents = 6, {}
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(7)] + ["x\n" * 30, " \n\ny\n" * 9, "\n".join(f"w{i}" for i in range(20))]
    for f in range(40):
        contents[f"f{rng.randint(0, 999):03}-{f}"] = texts[f % len(texts)]
    expected, _ = clones_by_definition(contents, width)
    rows = found(files, contents, width)
    lines = {p: [line for _, line in C.tokenise(t)] for p, t in contents.items()}
    assert sorted((r["path"], r["origin_path"], r["start_line"], r["end_line"], r["tokens"]) for r in rows) == sorted((p, o, lines[p][i], lines[p][i + n - 1], n) for p, o, i, n in expected)
    assert all(r["digest"] == C._snippet_digest([x.encode() for x in contents[r["path"]].split("\n")[r["start_line"] - 1 : r["end_line"]]]) for r in rows)
    assert len(dealt) <= len(texts)


def test_clones_of_rows_with_one_path(spark):
    """A path in several rows stands for all of them, as each row of a pair meets each of the other path."""
    block, other = "\n".join(f"b{i}" for i in range(60)), "\n".join(f"o{i}" for i in range(60))
    rows = [("p", "a", block), ("p", "a", block), ("p", "b", block), ("p", "b", block), ("p", "c", block), ("p", "d", other), ("p", "d", block + "\n" + other), ("p", None, block), (None, "a", block), ("p", "e", None), ("q", "z", block)]
    out = [(r["path"], r["origin_path"], r["start_line"], r["tokens"]) for r in C.clones(spark.createDataFrame(rows, "project string, path string, content string")).collect()]
    assert sorted(out) == sorted([("b", "a", 1, 60)] * 4 + [("c", "a", 1, 60)] * 2 + [("d", "a", 1, 60)] * 2 + [("d", "d", 61, 60)])


def test_runs_by_parts_equal_runs_along():
    import numpy as np

    rng = random.Random(3)
    for _ in range(2000):
        width = rng.randint(1, 12)
        here = np.array([rng.choice((1, 1, 2, 3)) for _ in range(rng.randint(width, 70))], np.int64)
        there = here if rng.random() < 0.3 else np.concatenate([here[rng.randint(0, 9) :], np.array([rng.choice((1, 2)) for _ in range(width)], np.int64)])
        shifts = sorted({rng.randint(1 - len(there), len(here) - 1) for _ in range(9)})
        along, parts = ({r for r in zip(*(x.tolist() for x in f(here, there, shifts, width)), strict=True) if r[1] - r[0] >= width} for f in (C._runs_along, C._runs_by_parts))
        assert along == parts


def test_tokens_of_many_texts_equal_the_tokeniser():
    rng = random.Random(1)
    signs = [*"ab_1 \t\n\r'\"`/\\*é、漢€😀\u00a0\u0085\x1c.+-\0", "//", "/*", "*/", "import x from 'y';", "\nexport * from \"z\"\n", "longer_than_eight", "é" * 200]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    codes, lines, bounds = C.Vocabulary().tokens([t.encode() for t in texts])
    code_of, token_of = {}, {}
    for text, start, end in zip(texts, bounds[:-1], bounds[1:], strict=True):
        expected = C.tokenise(C.blank_imports(text))
        assert lines[start:end].tolist() == [line for _, line in expected]
        for (token, _), code in zip(expected, codes[start:end].tolist(), strict=True):
            assert code_of.setdefault(token, code) == code and token_of.setdefault(code, token) == token


def test_the_digest_is_of_the_whole_clone(spark, files):
    import hashlib

    lines = [f"  call{i}(a,   b);" for i in range(20)]
    other = lines[:9] + ["  other(c);"] + lines[10:]
    rows = found(files, {"a.ts": "\n".join(lines), "b.ts": "\n".join(lines), "c.ts": "\n".join(other), "d.ts": "\n".join(other)})
    whole = hashlib.sha1(" ".join(" ".join(lines).split()).encode()).hexdigest()[:12]
    by_path = {(r["path"], r["origin_path"]): r["digest"] for r in rows}
    assert by_path["b.ts", "a.ts"] == whole and by_path["d.ts", "c.ts"] != whole


def test_findings_have_stable_subjects(spark, files):
    table = files({"a.ts": BLOCK, "b.ts": BLOCK})
    moved = files({"a.ts": "// one\n" + BLOCK, "b.ts": BLOCK.replace("  ", "    ")})
    subjects = [{r["subject"] for r in C.clone_findings(C.clones(t)).collect()} for t in (table, moved)]
    assert len(subjects[0]) == 1 and subjects[0] == subjects[1]


def test_duplication_score(spark, files):
    table = files({"a.ts": BLOCK, "b.ts": BLOCK, ("q", "c.ts"): "x"})
    scores = {r["project"]: (r["copied"], r["score"]) for r in C.duplication_scores(table, C.clones(table)).collect()}
    assert scores == {"p": (8, 50), "q": (0, 100)}


def test_lines_in_clones_are_counted_without_a_row_for_each(spark, files):
    rng = random.Random(4)
    table = files({(p, f"{i}.ts"): "\n" * 99 for p in "pqr" for i in range(3)})
    spans = [(rng.choice("pq"), f"{rng.randint(0, 2)}.ts", start, min(100, start + rng.randint(0, 30))) for start in (rng.randint(1, 100) for _ in range(25))]
    clones = spark.createDataFrame(spans * 2, "project string, path string, start_line int, end_line int")
    scores = C.duplication_scores(table, clones)
    assert "explode" not in scores._jdf.queryExecution().toString()
    lines = {(project, path, line) for project, path, start, end in spans for line in range(start, end + 1)}
    assert {r["project"]: (r["lines"], r["copied"]) for r in scores.collect()} == {p: (300, sum(x[0] == p for x in lines)) for p in "pqr"}


def test_tokens():
    tokens = C.tokenise("const x = 1; // c\n/* b\n */ f(`a ${b} c`, 'it''s')")
    assert [t for t, _ in tokens] == ["const", "x", "=", "1", ";", "f", "(", "`a ${b} c`", ",", "'it'", "'s'", ")"]
    assert dict(tokens)["f"] == 3
    blanked = C.blank_imports("import { a } from './a';\nimport {\n  b,\n} from './b';\nexport * from './c';\nconst real = 1;\nimport './d';")
    assert blanked.count("\n") == 6 and "from" not in blanked and "const real = 1;" in blanked


def test_mask_keeps_positions():
    source = "a // b\n'x\\'y' + `q\n` /* z */ c"
    masked = C.mask(source)
    assert len(masked) == len(source) and masked.count("\n") == source.count("\n") and masked.split() == ["a", "+", "c"]
    assert C.mask(source, comments=False, strings=False) == source


def test_functions():
    source = "export function one(a) {\n  if (a) {\n    return a ? 1 : 2;\n  }\n}\nconst two = async (b) => {\n  // {\n  return b && c;\n};\nif (x) {\n}\nclass K {\n  method(a) {\n    for (;;) {}\n  }\n}"
    assert [(n, s, lines, c) for n, s, lines, c in C.functions_of(source)] == [("one", 1, 5, 2), ("two", 6, 4, 1), ("method", 13, 3, 1)]


def test_complexity_findings(spark, files):
    long = "function long() {\n" + "  if (a && b) c();\n" * 70 + "}"
    rows = C.complexity_findings(C.functions(files({"a.ts": long, "b.ts": "function f() {\n}"}))).collect()
    assert {(r["rule"], r["subject"]) for r in rows} == {("long-function", "a.ts#long"), ("high-complexity", "a.ts#long")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_names_brute_force(spark, seed):
    rng = random.Random(seed)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(120)})
    table = spark.createDataFrame([("p", "d", n) for n in names * 3] + [("p", "e", names[0])], "project string, dir string, name string")
    expected = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d = distance(a, b)
            if min(len(a), len(b)) >= 3 and (d == 1 or (d == 2 and min(len(a), len(b)) >= 5)):
                expected.add((a, b, d))
    assert {(r["name_a"], r["name_b"], r["distance"]) for r in N.similar_names(table).collect()} == expected
    # Crowded keys on every level give the same pairs.
    assert {(r["name_a"], r["name_b"], r["distance"]) for r in N.similar_names(table, crowd=2).collect()} == expected


def test_similar_long_names(spark):
    """Edits at the ends, at cuts, side by side and far apart, in names longer than all parts together."""
    rng = random.Random(5)
    base = "customerRelationshipOverviewPage"
    names = {base, "", "ab", base + "x", "xy" + base}
    for _ in range(40):
        name = base
        for _ in range(rng.randint(1, 3)):
            at, kind = rng.randrange(len(name) + 1), rng.randrange(3)
            name = name[:at] + ("" if kind == 0 else "q") + name[at + (kind != 1) :]
        names.add(name)
    names = sorted(names)
    expected = {(a, b, distance(a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if len(a) >= 3 and distance(a, b) <= 2}
    table = spark.createDataFrame([("p", "d", n) for n in names] + [("p", "d", None)], "project string, dir string, name string")
    for crowd in (1, 64):
        assert {(r["name_a"], r["name_b"], r["distance"]) for r in N.similar_names(table, crowd=crowd).collect()} == expected


@pytest.mark.parametrize("piece, size, keys, pairs", [(1, 1, 64, 4), (40, 100, 1, 16), (200, 1 << 20, 1 << 22, 1)])
def test_similar_names_in_pieces(spark, monkeypatch, piece, size, keys, pairs):
    """Directories cut into pieces, pieces read, keyed and paired a few rows at a time: each pair once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for limit, value in (("BYTES", size), ("KEYS", keys), ("PAIRS", pairs), ("ROWS", pairs)):
        monkeypatch.setattr(N, limit, value)
    rng = random.Random(piece)
    long = "b" * 13 + "ac" * 9
    words = ["".join(rng.choice("aé\U0001f600") for _ in range(rng.randint(2, 6))) for _ in range(90)]
    words += [long[:k] + rng.choice("ab") * rng.randint(0, 2) + long[k + rng.randint(0, 2) :] for k in range(0, len(long), 3)]
    names = [(p, d, n) for n in words for p, d in (("p", "d"), ("p", "e"), (None, "d"), ("p", None)) if d != "e" or rng.random() < 0.5]
    expected = []
    for where in (("p", "d"), ("p", "e")):
        own = sorted({n for p, d, n in names if (p, d) == where and len(n) >= 3})
        found = [(a, b, distance(a, b)) for i, a in enumerate(own) for b in own[i + 1 :]]
        expected += [(*where, a, b, d) for a, b, d in found if d == 1 or (d == 2 and min(len(a), len(b)) >= 5)]
    table = spark.createDataFrame(names + [("p", "d", None)], "project string, dir string, name string").repartition(3)
    for crowd in (1, 64):
        assert sorted(tuple(r) for r in N.similar_names(table, crowd=crowd, piece=piece).collect()) == sorted(expected)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_similar_names_shuffles_names_only(spark):
    """Names go through the shuffle a few times, whatever their length; before, as dozens of keys on every level."""
    rng = random.Random(3)
    own = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 30))) for _ in range(400)})
    names = spark.createDataFrame([("p", "d", n) for n in own], "project string, dir string, name string")
    assert "hashpartitioning(project" in (plan := N.similar_names(names)._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Exchange ") <= 8 and "hashpartitioning(key" not in plan and "dir#" in plan
    whole = [tuple(r) for r in N._pieces(names, N.PIECE).select("name", "kept").collect()]
    assert sorted(whole) == [(n, True) for n in own]
    cut = N._pieces(names, 500).collect()
    assert sorted(r["name"] for r in cut if r["kept"]) == own and len(cut) <= 4 * len(own)


def test_similar_names_of_great_length(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abc") for _ in range(5000))
    own = [base, base[:100] + base[101:], base + "xy", "q" + base[1:-1] + "?", base[::-1]]
    expected = {(*sorted((base, own[i])), d) for i, d in ((1, 1), (2, 2), (3, 2))}
    table = spark.createDataFrame([("p", "d", n) for n in own], "project string, dir string, name string")
    assert {(r["name_a"], r["name_b"], r["distance"]) for r in N.similar_names(table).collect()} == expected


def test_component_files_shuffle_no_words(spark):
    from tidemark.operators import textmetrics as M
    from tidemark.plans.code_queries import component_files

    rows = [("src1", "en", 1, "Ab ab Cd word"), ("src1", "en", 1, "ab other"), ("x", "de", 2, "LONG long ab"), ("x", "de", None, "gone"), (None, "de", 3, "gone"), ("x", None, 4, "gone"), ("x", "de", 5, None)]
    found = component_files(spark.createDataFrame(rows, "source string, lang string, doc_id bigint, text string"))
    expected = [("src1", "en/ab1.tsx"), ("src1", "en/cd1.tsx"), ("src1", "en/other1.tsx"), ("src1", "en/word1.tsx"), ("x", "de/Long2.tsx"), ("x", "de/ab2.tsx")]
    assert sorted((r["project"], r["path"]) for r in found.collect()) == expected
    names = [("p", "a/b.tsx"), ("p", "a/.tsx"), ("p", "a/..tsx"), ("p", "a.b/C.d.jsx"), ("p", "x.ts"), ("p", "a.b.tsx"), ("p", "main.tsx"), ("p", "D.tsx"), ("p", "E.tsx")]
    files = spark.createDataFrame(names, "project string, path string").selectExpr("*", "'export const A = 1' AS content")
    assert sorted(r["path"] for r in M.naming_convention(files).collect()) == ["a.b.tsx", "a/b.tsx"]


def test_synonyms_count_pairs(spark):
    names = ["userUtils", "userHelpers", "dateUtils", "types", "models", "interfaces"]
    table = spark.createDataFrame([("p", "d", n.lower()) for n in names], "project string, dir string, name string")
    assert {(r["words"], r["name_pairs"]) for r in N.synonym_names(table).collect()} == {("utils/helpers", 2), ("types/interfaces", 1), ("types/models", 1), ("interfaces/models", 1)}

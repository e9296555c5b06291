"""The native operators against brute force, on small tables with odd rows."""

import hashlib
import itertools
import json
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, licenses, mixing, quality, sharding, toolcalls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank_ int, part_ string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts):
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, 0, 5, "x") for i, t in enumerate(texts)]


TEXTS = [
    "a b c d e f g a b c d", "", None, "one", "one two\nthree\n\none two\nthree", "x " * 300, "é ü ñ " * 50, "a b c d e f g a b c d",
    "Released under the MIT License. more words", "  \t ", "word " * 5000 + "end", "#### $$ 12 | <a>",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*rows_of(TEXTS), (None, "no id here", None, None, None, 1, None), *rows_of(TEXTS)[:1]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def hilbert_brute(bits):
    """Cells of a two-dimensional curve in order, by the textbook rotation."""
    n, out = 1 << bits, []
    for d in range(n * n):
        x = y = 0
        t, s = d, 1
        while s < n:
            rx = 1 & (t // 2)
            ry = 1 & (t ^ rx)
            if ry == 0:
                if rx == 1:
                    x, y = s - 1 - x, s - 1 - y
                x, y = y, x
            x, y = x + s * rx, y + s * ry
            t //= 4
            s *= 2
        out.append((x, y))
    return out


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_curve_visits_neighbours(spark, dims):
    from pyspark.sql import functions as F

    cells = list(itertools.product(range(8), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"c{k} int" for k in range(dims)))
    got = df.select("*", sharding.hilbert_index([F.col(f"c{k}") for k in range(dims)], 3).alias("h")).collect()
    order = [r[:dims] for r in sorted(got, key=lambda r: r["h"])]
    assert sorted(r["h"] for r in got) == list(range(8**dims))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(order))
    if dims == 2:
        steps = [{abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in itertools.pairwise(hilbert_brute(3))}, {1}]
        assert steps[0] == steps[1]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(docs, empty, law):
    got = sharding.hilbert_shards(docs, 4, law).collect()
    assert len(got) == docs.count()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 16 for t in [*TEXTS, "no id here", TEXTS[0]])
    for r in got:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id here"
        assert r["text_crc32"] == zlib.crc32((text or "").encode()) and r["law"] == law and 0 <= r["shard"] < 4
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    if law == "rows":
        counts = [len(by.get(k, [])) for k in range(4)]
        assert max(counts) - min(counts) <= 1
    cells = [r["cell"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert cells == sorted(cells)
    assert sharding.hilbert_shards(empty, 4, law).collect() == []


def test_shard_bytes_are_near_equal(spark):
    df = spark.createDataFrame([(i, "z" * (i % 37 + 1), "en", f"s{i % 5}", 0, 1, "") for i in range(2000)], DOCS)
    got = sharding.hilbert_shards(df, 10, "bytes").groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * (37 + 16)


def test_files_of_shards_cover_few_cells(spark, docs, tmp_path):
    sharding.write_shards(docs.where("doc_id > 0"), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.where("doc_id > 0").count()
    assert back.select("shard").distinct().count() == 3


def test_written_shards_hold_every_row_once(spark, tmp_path):
    """Repeated and null ids, equal texts, and columns named like the operator's own."""
    rows = [(i % 7 if i % 5 else None, "word " * (i % 40), f"l{i % 4}", f"s{i % 6}", i, -i) for i in range(400)] + [(3, "word " * 3, "l3", "s3", 3, -3)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, shard int, row int")
    sharding.write_shards(df, str(tmp_path / "out"), 4, files=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc.*").collect())) == sorted(map(str, df.collect()))
    slots = sorted((r["shard"], r["slot"]) for r in back.select("shard", "slot").collect())
    want = sharding.hilbert_shards(df.drop("row", "shard"), 4)
    assert slots == sorted((r["shard"], r["slot"]) for r in want.collect())


def test_statistics_of_written_shards_skip_files(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, f"{i} " + "word " * (1 << (i % 9)), f"l{i % 5}", f"s{i // 5 % 8}", 0) for i in range(3600)], "doc_id bigint, text string, lang string, source string, n int")
    sharding.write_shards(df, str(tmp_path / "out"), 8, files=6)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/out/*/*.parquet")]
    cell = spark.range(1).select(sharding.name_cell(F.lit("s3"))).first()[0]
    read = 0
    for f in files:
        at = next(i for i in range(f.metadata.num_columns) if f.metadata.row_group(0).column(i).path_in_schema == "source_cell")
        stats = [f.metadata.row_group(g).column(at).statistics for g in range(f.metadata.num_row_groups)]
        read += any(s.min <= cell <= s.max for s in stats)
    assert read <= len(files) * 2 // 3
    assert spark.read.parquet(f"{tmp_path}/out").where(f"doc.source = 's3' AND source_cell = {cell}").count() == 450


def test_equal_json_gives_equal_strings(spark):
    rows = [
        ('{"b":1.0,"a":1e2}', '{"a":100,"b":1}'), ('{"a":100.0,"b":10e-1}', '{"a":100,"b":1}'), ('[-0, -0.0, 0e5]', "[0,0,0]"),
        ('{"x":"1.0 \\" 2.50","y":2.50}', '{"x":"1.0 \\" 2.50","y":2.5}'), ("[12345678901234567890, 1e20, 100000000000000000000]", "[12345678901234567890,100000000000000000000,100000000000000000000]"),
        ('["a-0", true, null, -1.5]', '["a-0",true,null,-1.5]'), ("no json", None), (None, None), ("{}", "{}"), ('""', '""'),
    ]
    df = spark.createDataFrame(rows, "given string, want string")
    for r in df.select("given", "want", toolcalls.canonical(F.col("given")).alias("got")).collect():
        assert r["got"] == r["want"], r


def targets_brute(sizes):
    """Shares handed on until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    cap, out, left = {s: 2 * n for s, n in sizes.items()}, {}, sum(sizes.values()) * 1.5
    open_ = set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= cap[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


def test_mix(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id here"
        assert r["size"] == len(WORDS.findall(text or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets_brute(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed_documents(empty).columns == empty.columns


def test_mixed_documents_keep_columns_of_any_name(spark):
    rows = [(f"id{i % 30}", "w " * (i % 9), f"s{i % 3}", i, -i, i + 7, "x") for i in range(60)]
    names = ("row", "copies", "mix_k_", "whole")
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, row bigint, copies bigint, mix_k_ bigint, whole string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(rows) and all(n <= 2 for n in got.values())
    plain = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed_documents(df.drop(*names)).collect())
    assert sum(got.values()) == sum(plain.values())


def test_mix_comes_near_its_targets(spark):
    df = spark.createDataFrame([(i, "w " * (i % 90), "en", f"s{(i * i) % 4}" if i % 3 else "hot", 0, 1, "") for i in range(3000)], DOCS)
    taken, want = {}, {}
    for r in mixing.mix(df).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        want[r["source"]] = r["target"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * 90
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns
    assert {r["source"]: r["n"] for r in copies.selectExpr("source", "size(filter(split(text, ' '), x -> x != '')) AS k").groupBy("source").sum("k").withColumnRenamed("sum(k)", "n").collect()} == {s: n for s, n in taken.items() if n}


def statistics_brute(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, k in __import__("collections").Counter(windows).items() if k > 1}
    hit = set()
    for i, w in enumerate(windows):
        if w in twice:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_statistics(docs, empty):
    for r in quality.with_statistics(docs).collect():
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id here"
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics_brute(text)
    judged = quality.judged(docs, []).collect()
    assert all(r["kept"] != r["base_failed"] and r["rule"] == 0 for r in judged)
    assert quality.judged(empty, []).collect() == []


def test_rules_are_learned_and_applied_alike(spark):
    good = [(i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(80 + i % 9)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"W{k % 13 + i}!!" for k in range(70)) if i % 2 else " ".join(f"y{k}###" for k in range(60 + i)), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rules = quality.fit_rules(docs, labels)
    assert rules and rules == quality.fit_rules(docs.repartition(4), labels)
    got = {r["doc_id"]: r.asDict() for r in quality.judged(docs, rules).collect()}
    for i, _, q in good + bad:
        first = next((k for k, rule in enumerate(rules, 1) if all(c.holds(got[i]) for c in rule)), 0)
        assert got[i]["rule"] == first
        assert (first == 0) == (q == 1)
    assert quality.fit_rules(docs, labels.limit(0)) == []


def shingles_brute(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    def hashed(parts):
        h = 42
        for p in parts:
            v = xxhash.xxh64_intdigest(p.encode(), h)
            h = v
        return h - 2**64 if h >= 2**63 else h

    if not words:
        return set()
    return {hashed(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {hashed([" ".join(words)])}


def test_fingerprints(spark, docs, empty):
    distinct = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(distinct, 16).collect()}
    ids = sorted(got)
    for i in ids:
        text, following = TEXTS[i] or "", TEXTS[ids[ids.index(i) - 1]] or ""
        half = len(text) // 2
        assert got[i]["n_chars"] == len(text) and got[i]["edited"] == text[: len(text) - half] + following[:half]
        assert list(got[i]["sketch"]) == sorted(shingles_brute(text))[:16]
        assert list(got[i]["next_sketch"]) == sorted(shingles_brute(following))[:16]
    assert got[0]["sketch"] == got[7]["sketch"]
    assert len(fingerprints.edited_pairs(docs).collect()) == docs.count()
    assert fingerprints.edited_pairs(empty).collect() == []


def test_sketch_estimates(spark):
    from pyspark.sql import functions as F

    a, b = [f"w{i} x y z {i}" for i in range(400)], [f"w{i} x y z {i}" for i in range(100, 500)]
    row = spark.createDataFrame([(1, " ".join(a), " ".join(b), " ".join(a[:100]))], "id int, a string, b string, c string")
    for name in "abc":
        row = fingerprints.with_sketch(row, name, f"s{name}")
    sa, sb, sc = (set(shingles_brute(" ".join(x))) for x in (a, b, a[:100]))
    got = row.select(
        fingerprints.resemblance(F.col("sa"), F.col("sb")).alias("j"), fingerprints.containment(F.col("sc"), F.col("sa")).alias("c"),
        fingerprints.distinct_shingles(F.col("sa")).alias("n"), fingerprints.resemblance(F.col("sa"), F.col("sa")).alias("one"),
    ).first()
    assert abs(got["j"] - len(sa & sb) / len(sa | sb)) < 0.15 and got["c"] > 0.7 and got["one"] == 1.0
    assert abs(got["n"] / len(sa) - 1) < 0.3


def test_licenses(spark, empty):
    texts = [
        "x y Released under the MIT License. z", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "mit\nlicense and MIT, License again", "the license of the work is under it", None, "", "licensed under the the the apache",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, the software, to deal in the software without restriction",
        "word " * 3000 + "Released under the MIT License",
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ws string")
    got = {r["doc_id"]: r for r in licenses.scanned(docs, licenses.word_idf(docs)).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == ["mit,mit-notice", "apache,apache-2.0", "gpl,gpl-3.0", "cc-by-nc-4.0", "mit", "", "", "", "", "mit-grant", "mit,mit-notice"]
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = [k for p, _ in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert 0 <= r["score"] <= 1
    assert licenses.scanned(empty, licenses.word_idf(empty)).collect() == []


def test_licenses_no_template_hides_another(spark):
    lines = [t for _, t, _ in licenses.TEMPLATES]
    varied = " ".join(f"word{i} {w}" for i in range(300) for w in licenses.VOCABULARY[i % 7 :: 7])
    grant = next(t for label, t, _ in licenses.TEMPLATES if label == "mit-grant")
    texts = ["\n".join(lines), "\n".join(lines[::-1]), varied + " licensed under CC BY-NC 4.0", f"{grant}. Licensed under CC BY-NC 4.0", f"{grant}. Released under the MIT License"]
    # The last line's words are common here, the grant's are not.
    texts += ["Licensed under CC BY-NC 4.0, released under the MIT License"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = licenses.word_idf(docs)
    got = {r["doc_id"]: r for r in licenses.scanned(docs, idf).collect()}
    for i, text in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        brute = set()
        for label, t, phrases in licenses.TEMPLATES:
            own = t.split()
            for start in range(-len(own), len(ws)):
                at = [ws[start + k] if 0 <= start + k < len(ws) else None for k in range(len(own))]
                if sum(a == b for a, b in zip(at, own)) / len(own) >= licenses.MIN_SCORE and any(
                    own[k : k + len(p.split())] == p.split() == at[k : k + len(p.split())] for p in phrases for k in range(len(own))
                ):
                    brute.add((label, start))
        assert {(h["label"], h["start"]) for h in got[i]["hits"]} == brute
    assert {label for label, _, _ in licenses.TEMPLATES} <= set(got[0]["labels"].split(","))
    assert got[2]["labels"] == "cc-by-nc-4.0" and got[3]["labels"] == "cc-by-nc-4.0,mit-grant" and got[4]["labels"] == "mit,mit-grant,mit-notice"


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "search", '{"query": "x", "limit": 3}', None), (1, "b", 2, "search", '{"limit":"many","extra":1}', "a"), (1, "c", 1, "search", "{bad", "b"),
            (1, "d", 3, "nope", "[1]", "e"), (1, "e", 4, "search", '{"query":null}', "d"), (1, "a", 9, "search", "{}", None), (2, "z", 0, None, None, "missing"),
            (None, None, None, "search", '{"query":"q"}', None),
        ],
        "conv_id long, call_id string, pos long, name string, arguments string, after string",
    )
    results = spark.createDataFrame([(1, "a", 1, 'say "hi"\n'), (1, "a", 7, "later"), (1, "q", 3, "lost"), (2, "z", 1, None)], "conv_id long, call_id string, pos long, content string")
    schemas = spark.createDataFrame([("search", {"query": "string", "limit": "integer"}, ["query"])], "name string, kinds map<string,string>, required array<string>")
    got = toolcalls.linked_calls(calls, results, schemas).collect()
    by = {(r["conv_id"], r["place"]): r for r in got}
    assert len(by) == len(got) == 9
    assert [(by[1, k]["call_id"], by[1, k]["state"]) for k in range(7)] == [
        ("a", "linked"), ("b", "pending"), ("c", "pending"), ("d", "cyclic"), ("q", "orphan"), ("e", "cyclic"), ("a", "repeated"),
    ]
    assert by[1, 0]["errors"] == [] and by[1, 0]["n_results"] == 2
    assert by[1, 0]["json"] == '{"after":null,"arguments":{"limit":3,"query":"x"},"errors":[],"id":"a","name":"search","result":"say \\"hi\\"\\n","state":"linked"}'
    assert by[1, 1]["errors"] == ["kind limit", "missing query", "unknown extra"]
    assert by[1, 2]["errors"] == ["no object"] and '"arguments":"{bad"' in by[1, 2]["json"]
    assert by[1, 3]["errors"] == ["no schema"] and by[1, 5]["errors"] == ["missing query"]
    assert by[2, 0]["level"] == 0 and by[2, 0]["errors"] == ["no schema"]
    assert toolcalls.linked_calls(calls.limit(0), results.limit(0), schemas).collect() == []


def test_every_tool_result_has_a_row(spark):
    calls = [
        (1, "a", 0, "first", None), (1, "a", 2, "again", None), (-1, "a", 0, "minus one", None), (None, "a", 0, "no conversation", None), (None, "a", 0, "no conversation", None),
        (1, None, 5, "no id", "a"), (1, None, 5, "no id", "a"), (1, "", 6, "empty id", None), (1, "x", 7, "loop", "x"), (1, None, 8, "after a loop", "x"),
    ]
    results = [
        (1, "a", 1, "answer"), (1, "a", 3, "later"), (1, "a", 3, "later"), (1, "q", 4, "lost"), (1, "q", 4, "lost"), (1, "q", 9, None),
        (None, "a", 1, "unknown 1"), (None, "a", 1, "unknown 2"), (-1, "a", 1, "to minus one"), (1, None, 1, "no id"), (1, "", 7, "to the empty id"), (None, None, None, None),
    ]
    cs = spark.createDataFrame([(c, i, p, n, "{}", a) for c, i, p, n, a in calls], "conv_id long, call_id string, pos long, name string, arguments string, after string")
    rs = spark.createDataFrame(results, "conv_id long, call_id string, pos long, content string")
    schemas = spark.createDataFrame([], "name string, kinds map<string,string>, required array<string>")
    got = toolcalls.linked_calls(cs, rs, schemas, further=True).collect()
    assert len({(r["conv_id"], r["place"]) for r in got}) == len(got) and {r["place"] for r in got if r["conv_id"] is None} == set(range(5))
    told = Counter((r["conv_id"], r["call_id"], json.loads(r["json"])["result"]) for r in got if r["state"] in ("linked", "orphan", "repeated result"))
    assert told == Counter((c, i, t) for c, i, _, t in results) and sum(r["n_results"] for r in got) == len(results)
    named = Counter((r["conv_id"], r["call_id"], r["name"], r["state"], r["level"]) for r in got if r["name"])
    assert named == Counter({
        (1, "a", "first", "linked", 0): 1, (1, "a", "again", "repeated", None): 1, (-1, "a", "minus one", "linked", 0): 1, (None, "a", "no conversation", "pending", 0): 2,
        (1, None, "no id", "pending", 1): 2, (1, "", "empty id", "linked", 0): 1, (1, "x", "loop", "cyclic", None): 1, (1, None, "after a loop", "cyclic", None): 1,
    })
    assert Counter(r["state"] for r in got) == {"linked": 3, "repeated": 1, "pending": 4, "cyclic": 2, "orphan": 7, "repeated result": 2}


def test_long_chain_of_calls(spark):
    rows = [(1, f"c{i}", 500 - i, "t", "{}", f"c{i - 1}") for i in range(300)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, pos long, name string, arguments string, after string")
    results = spark.createDataFrame([], "conv_id long, call_id string, pos long, content string")
    schemas = spark.createDataFrame([], "name string, kinds map<string,string>, required array<string>")
    got = sorted(toolcalls.linked_calls(calls, results, schemas).collect(), key=lambda r: r["place"])
    assert [r["call_id"] for r in got] == [f"c{i}" for i in range(300)] and [r["level"] for r in got] == list(range(300))


def test_edited_hash_is_of_utf8(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "éa"), (2, "üb")], "doc_id long, text string")
    got = {r["doc_id"]: r["h"] for r in fingerprints.edited_pairs(df).select("doc_id", F.sha2(F.col("edited"), 256).alias("h")).collect()}
    assert got == {2: hashlib.sha256("üé".encode()).hexdigest(), 1: hashlib.sha256("éü".encode()).hexdigest()}

"""Token alignment, source divergence and language identification against brute force and held-out accuracy."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import alignment, divergence, langid, queries  # noqa: E402
from tidemark.llm.queries_sql import SQL  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


# Token alignment


def groups_by_offsets(a, b, text):
    """Groups by the definition, encoded by the tokenizers themselves; none where bytes differ."""
    if not text:
        return []
    ids = a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
    data = (" " + text).encode()
    if any(b"".join(side.tokens[i] for i in x) != data for side, x in zip((a, b), ids, strict=True)):
        return []
    ends = [np.cumsum([len(side.tokens[i]) for i in x]).tolist() for side, x in zip((a, b), ids, strict=True)]
    groups, begin = [], 0
    for stop in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(x, end, strict=True) if begin < e <= stop] for x, end in zip(ids, ends, strict=True)))
        begin = stop
    return groups


def expected_links(texts):
    """Digest columns by row number, worked out from all links of all texts."""
    a, b = alignment.ByteLevel(FILES[0], FILES[2]), alignment.Pieces(FILES[1])
    groups = [groups_by_offsets(a, b, t) for t in texts]
    links = [[(x, y) for left, right in g for x in left for y in right] for g in groups]
    count = Counter(p for found in links for p in set(found))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for g, found in zip(groups, links, strict=True):
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(found), sum(count[p] == most[p[0]] for p in found),
            sum(count[p] for p in found), hashlib.sha256(listed.encode()).hexdigest() if g else "",
        ))
    return out, groups


ODD = [
    None, "", " ", "  \n ", "a", "the cat", "the cat", "naïve café — 東京 😀 text", "x▁y has the mark itself", "<|endoftext|> and <s> </s> <0x41>", "tab\tand\r\nlines\n\n\nend ",
    "á combining", "ﬁ ligature ① ２", " nbsp　wide", "\x00zero\x01", "1234567 89 3.14", "don't I'll we've", "🏳️‍🌈 flags", "word " * 300, " leading and   many    blanks",
]


def test_links_equal_brute_force_on_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    monkeypatch.setattr(alignment, "STEP_BYTES", 60)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)], "doc_id int, text string, block int").repartition(3)
    rows = {r["doc_id"]: tuple(r)[1:] for r in alignment.linked(docs, *FILES).collect()}
    expected, groups = expected_links(ODD)
    assert [rows[i] for i in range(len(ODD))] == expected
    assert expected[8] == (0, 0, 0, 0, 0, 0, "")  # the mark decodes to a space, so the bytes differ
    found = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in alignment.token_groups(docs, *FILES).collect()}
    assert [found[i] for i in range(len(ODD))] == groups


def test_links_with_windows_forgotten(spark, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 5)
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(ODD)], "doc_id string, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in alignment.linked(docs, *FILES).collect()}
    assert [rows[str(i)] for i in range(len(ODD))] == expected_links(ODD)[0]


def test_links_of_repeated_and_null_ids_and_of_no_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one")], "doc_id long, text string")
    rows = alignment.linked(docs, *FILES).collect()
    assert sorted((r["doc_id"] is None, r["n_groups"]) for r in rows) == [(False, 2), (False, 2), (True, 1)]
    one = next(r for r in rows if r["doc_id"] is None)
    assert one["count_sum"] == 3 * one["n_links"]
    assert alignment.linked(docs.limit(0), *FILES).collect() == []


def test_a_long_text_without_blanks_and_a_long_run_of_blanks(spark):
    texts = ["ab" * 1500, " " * 6000 + "x", "longword" * 200 + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in alignment.linked(docs, *FILES).collect()}
    assert [rows[i] for i in range(3)] == expected_links(texts)[0]


@tables
def test_alignment_query_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    rows = {r["doc_id"]: r for r in queries.op11_token_alignment(spark, SF).collect()}
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert [tuple(rows[i][n] for n in names) for i, _ in docs] == expected_links([t for _, t in docs])[0]


# Source divergence


def audited(rows, min_docs=30, top=50):
    """The audit by its definition, in Python's integers."""
    import re

    docs = [(lang or "", source or "", [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(w for x, _, words in docs if x == lang for w in set(words))
        kept = {w for w, n in held.items() if n >= min_docs}
        count = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, words in docs:
            if x == lang:
                count[s].update(w for w in words if w in kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (c.total() + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in count if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def as_rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_divergence_equals_the_definition(spark, monkeypatch):
    draw = random.Random(5)
    words = ["a", "Bb", "CCC", "ééé", "straße", "ÄÖ", "word", "longerword", "exactly8", "nine_nine", "sixteenletters16", "seventeenletterssev", "x" * 40, "日本語のとても長い言葉", "z" * 33, "It's", "i.e."]
    rows = []
    for _ in range(400):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["s1", "s1", "s1", "s2", "s3", None])
        rows.append((lang, source, " ".join(draw.choices(words, k=draw.randint(0, 30)))))
    rows += [("en", "empty", ""), ("en", "void", None), ("xx", "a", "rare words"), ("xx", "b", "rare"), ("yy", "alone", "none"), *[("en", "s1", "the same text again")] * 40]
    docs = spark.createDataFrame([(i, t, lang, s, "clash", 1, "p") for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int, part string").repartition(5)
    expected = audited(rows)
    assert any(r[2] == "term" for r in expected)
    for limits in ((4 << 20, 1_500_000, 1024), (100, 10, 3)):
        for name, value in zip(("STEP_BYTES", "HELD_TERMS", "PART_TERMS"), limits, strict=True):
            monkeypatch.setattr(divergence, name, value)
        assert as_rows(divergence.divergence(docs)) == expected


def test_divergence_keeps_only_the_first_terms(spark):
    rows = [("en", f"s{i % 2}", " ".join(f"w{'abcdefghij'[j]}" for j in range(10) if (i + j) % 2 or j < 3)) for i in range(80)]
    docs = spark.createDataFrame([(t, lang, s) for lang, s, t in rows], "text string, lang string, source string")
    assert as_rows(divergence.divergence(docs, top=2)) == audited(rows, top=2)


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_radix_order_is_stable():
    draw = np.random.default_rng(1)
    high, low = draw.integers(0, 3, 5000).astype(np.uint32), draw.integers(0, 1 << 63, 5000).astype(np.uint64) >> np.uint64(50)
    assert divergence.radix_order([high, low]).tolist() == np.lexsort((np.arange(5000), low, high)).tolist()


@tables
def test_divergence_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    sql = sorted(con.sql(SQL["op12_source_divergence"]).fetchall())
    assert as_rows(queries.op12_source_divergence(spark, SF)) == sql
    assert sql == audited(duckdb.sql(f"select lang, source, text from '{SF}/documents.parquet'").fetchall())


# Language identification


def spoken(seed, n):
    """Labelled texts of three invented languages."""
    draw = random.Random(seed)
    syllables = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["schk", "rög", "urt", "enz"], "cc": ["ção", "nhe", "lha", "ém"]}
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(syllables))
        rows.append((i, " ".join("".join(draw.choices(syllables[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(1, 30))), lang))
    return rows


def test_languages_are_told_apart_and_odd_texts_have_a_result(spark):
    train = spark.createDataFrame([*spoken(1, 300), (900, None, "aa"), (901, "12 34 !!", "bb"), (902, "balomi", None)], "doc_id long, text string, lang string")
    model = langid.fit_model(train)
    assert model.langs == ["aa", "bb", "cc"] and 0 < (model.weights[:-1] != 0).mean() < 0.5
    wanted = spoken(2, 200)
    odd = [(1000, None, ""), (1001, "", ""), (1002, "123 -- !?", ""), (1003, "😀 ♥", ""), (1004, "b" * 300_000, ""), (None, "schkurt rögenz", "bb"), (1, "ta", "aa"), (1, "ta", "aa"), (1005, "𝕬 schkurt 𐍈", "bb")]
    docs = spark.createDataFrame([(*r, 7, 0.5) for r in wanted + odd], "doc_id long, text string, truth string, `odd.na``me` int, score double")
    rows = langid.identified(docs, model).collect()
    assert len(rows) == len(wanted) + len(odd) and set(rows[0].asDict()) == {"doc_id", "text", "truth", "odd.na`me", "lang_pred", "score"}
    right = sum(r["truth"] == r["lang_pred"] for r in rows if r["truth"])
    assert right >= 0.97 * (len(wanted) + 4)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and (letters or r["score"] == 0)
    assert langid.identified(docs.limit(0), model).collect() == []


def test_nothing_learned_and_one_language(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    none = langid.fit_model(docs)
    assert langid.identified(docs, none).select("lang_pred", "score").collect() == [("und", 0.0)]
    one = langid.fit_model(spark.createDataFrame([(1, "abc", "qq")], docs.schema))
    assert langid.identified(docs, one).select("lang_pred", "score").collect() == [("qq", 1.0)]


def test_document_frequencies_cover_all_rows(spark):
    rows = spoken(3, 120)
    docs, frequency = langid.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    grams = langid.Grams()
    expected = Counter(b for _, t, _ in rows for b in grams.counts(t)[0].tolist())
    assert docs == 120 and {i: n for i, n in enumerate(frequency.tolist()) if n} == expected


def test_counts_are_the_same_by_both_ways(monkeypatch):
    grams = langid.Grams()
    text = "Ähnliche Wörter, ähnliche Wörter! " * 20
    few = grams.counts(text)
    monkeypatch.setattr(langid, "BUCKETS", 1 << 15)
    folded = grams.folded(text)
    assert few[1].sum() == sum((folded != 0).sum() if n == 1 else len(folded) - n + 1 for n in (1, 2, 3))
    many = grams.counts(text * 200)
    assert set(few[0]) <= set(many[0])


def test_temperature_calibrates():
    draw = np.random.default_rng(3)
    logits = draw.normal(size=(4000, 3))
    labels = np.array([draw.choice(3, p=p) for p in langid.softmax(logits)])
    assert math.isclose(langid.temperature(logits * 4, labels), 4, rel_tol=0.15)
    assert langid.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1


@tables
def test_language_query_on_held_out_documents(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = queries.op13_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)

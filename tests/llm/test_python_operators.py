"""Near-duplicates, BPE, URL filters and language-model scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import bpe, lm, neardup, urls
from tidemark.llm.components import components
from tidemark.llm.queries import tokenizer

DOCS = "doc_id long, text string, row int, sketch string, key string"


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots_of(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=3):
    """Groups of exact and near copies, texts around the threshold, a passage that many share, short and empty texts."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = ["", None, "   ", "one two", "ONE two", "one two three four five"]
    passage = fresh(60)
    for _ in range(40):
        texts.append(" ".join([*fresh(15), *passage, *fresh(15)]))
    base = fresh(200)
    for _ in range(60):  # a dense group
        w = list(base)
        for _ in range(rnd.randrange(1, 5)):
            w[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    for k in range(30):  # pairs at every likeness
        w = fresh(120)
        texts += [" ".join(w), " ".join(w[: 120 - k] + fresh(k))]
    texts += [texts[60]] * 20 + ["Big " * 3000, "big " * 3001]
    rnd.shuffle(texts)
    return texts


def test_near_duplicates(spark):
    texts = corpus()
    df = spark.createDataFrame([(i * 3, t, 1, "s", "k") for i, t in enumerate(texts)], DOCS).repartition(5)
    want = roots_of({i * 3: set_of(t) for i, t in enumerate(texts)})
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i * 3: len(set_of(t)) for i, t in enumerate(texts)}
    assert {i for i, r in got.items() if r["kept"]} == set(want.values())
    left = neardup.without_near_duplicates(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))


def test_large_buckets_of_several_components(spark):
    """Texts that share most of a passage without being linked, and a few that are, in one large bucket."""
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(160)]
    texts = [" ".join([*passage, *[f"u{i}_{k}" for k in range(45)]]) for i in range(60)]
    texts += [" ".join([*passage, *[f"u{i}_{k}" for k in range(40)], *[f"v{rnd.randrange(9**9)}" for _ in range(5)]]) for i in range(0, 60, 7)]
    df = spark.createDataFrame([(i, t, 1, "s", "k") for i, t in enumerate(texts)], DOCS)
    want = roots_of({i: set_of(t) for i, t in enumerate(texts)})
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == want


def test_near_duplicates_with_odd_ids(spark):
    same = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, same, 1, "", ""), (4, same, 1, "", ""), (4, same, 1, "", ""), (None, "alone here", 2, "", ""), (9, same + " more", 1, "", "")], DOCS)
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert [g[1] for g in got].count(4) == 4 and sum(g[2] for g in got) == 2
    assert neardup.without_near_duplicates(df).count() == 2
    assert neardup.near_duplicates(df.limit(0)).collect() == []
    assert neardup.without_near_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_with_clashing_columns_and_string_ids(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [("b", same, 1, 2, 3), ("a", same + " more", 4, 5, 6), (None, "alone here", 7, 8, 9), ("c", "", 10, 11, 12), ("c", "", 10, 11, 12)]
    df = spark.createDataFrame(rows, "doc_id string, text string, own_id int, kept_id int, whole int")
    out = neardup.without_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, df.where("doc_id IS NULL OR doc_id <> 'b'").distinct().collect()))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == {"a": "a", "b": "a", None: None, "c": "c"}


def test_registers_merge_and_estimate():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 4000).astype(np.uint64)
    for na, nb, common in ((900, 900, 800), (400, 700, 300), (50, 60, 40), (3, 3, 2), (2000, 1900, 100)):
        a, b = np.unique(pool[:na]), np.unique(pool[na - common : na - common + nb])
        ra, rb = neardup.registers(a), neardup.registers(b)
        assert (np.maximum(ra, rb) == neardup.registers(np.union1d(a, b))).all()
        j = neardup.likeness(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(j - true) <= 5 * math.sqrt(max(true * (1 - true), 0.01) / neardup.REGISTERS)


def test_components(spark):
    chain = [(i, i + 1) for i in range(500)]
    star = [(1000, 1001 + i) for i in range(200)]
    df = spark.createDataFrame(chain + star + [(5000, 4000)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(501)}, **{i: 1000 for i in range(1000, 1201)}, 5000: 4000, 4000: 4000}


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


BPE_TEXTS = [
    "", None, "hello world", "  two  spaces\n\n tabs\t\t", "ÀÉÎ straße ñandú 中文字符 🙂🙂", "don't we'll I'M", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40,
    "x1y22z333 #### $$$ !!", "<|endoftext|>", "a" + "\u0301" * 30, "é" * 500, "\x00\x01\x02",
]


def test_bpe(spark, library):
    df = spark.createDataFrame([(i, t, 1, "s", "k") for i, t in enumerate(BPE_TEXTS)], DOCS).withColumnRenamed("key", "n_tokens")
    got = {r["doc_id"]: r for r in bpe.encoded(df, *tokenizer()).collect()}
    for i, t in enumerate(BPE_TEXTS):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encoded(df.limit(0), *tokenizer()).collect() == []
    assert [r["ids"] for r in bpe.encoded_ids(df.where("doc_id = 4"), *tokenizer()).collect()] == [library.encode_ordinary(BPE_TEXTS[4])]


def test_bpe_appends_and_edits(library):
    encoder = bpe.PrefixEncoder(bpe.read_ranks(tokenizer()[0]))
    rnd = random.Random(2)
    for _ in range(60):
        data = bytes(rnd.choice(b"abcdeinorst") for _ in range(rnd.randrange(1, 40)))
        last = encoder.extend(data, [])
        more = bytes(rnd.choice(b"abcdeinorst\xc3\xa9") for _ in range(5))
        whole, grown = encoder.append(data, list(last), more)
        assert encoder.tokens(grown) == encoder.tokens(encoder.extend(whole, []))
        a = rnd.randrange(len(data))
        new, table = encoder.edit(data, last, a, min(len(data), a + 2), b"xyz")
        assert table == encoder.extend(new, [])
        assert [encoder.by_id[i] for i in encoder.tokens(table)] == encoder.merged(new)


URLS = [
    "http://a.example.org/es/x", "https://Example.ORG/en/12?x", "ftp://org/", "http://org", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/de", "nothing", None, "",
    "http://notorg/en/1", "http://a.b.example.org/en/2#f", "x://com/fr/y/../", "http://com/fr", "http://example.org/en/1", "http://?q=http://org/", "a://b://org/",
]
ALLOW, BLOCK = ["org/", "com/fr/", "both.net/"], ["example.org/es/", "example.org/en/1", "com/de/", "both.net/", "host.only"]


def judged_brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    best = None
    for verdict, entries in (("allow", ALLOW), ("block", BLOCK)):
        for e in entries:
            h, slash, p = e.partition("/")
            p = slash + p
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                best = max(best or (), (h.count("."), len(p), verdict, e))
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls(spark, limit):
    more = ["http://both.net/x", "http://a.host.only", "http://a.host.only/z?"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + more)], "page_id long, url string, rule string")
    rules = urls.rules_table(spark, ALLOW, BLOCK)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged_urls(pages, rules, max_trie_bytes=limit).collect()}
    assert got == {i: judged_brute(u) for i, u in enumerate(URLS + more)}
    assert urls.judged_urls(pages.limit(0), rules, max_trie_bytes=limit).collect() == []
    assert {r["verdict"] for r in urls.judged_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def bits_of(byte):
    return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]


def predictions(words):
    """Context and byte of every prediction of a text: the bytes before it, whatever word they are of."""
    data = b"".join(w + b" " for w in words) + b"\n"
    for i in range(len(data)):
        yield (b" " * lm.DEPTH + data[:i])[-lm.DEPTH :], data[i]


def tree_brute(training):
    """Counts by (context, node) of every depth, and weighted probabilities, by recursion."""
    counts = {}
    for words in training:
        for ctx, byte in predictions(words):
            for d in range(lm.DEPTH + 1):
                for node, bit in bits_of(byte):
                    counts.setdefault((ctx[lm.DEPTH - d :], node), [0, 0])[bit] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    below = {}
    weighted = {}
    for d in range(lm.DEPTH, -1, -1):
        for (ctx, node), (a, b) in counts.items():
            if len(ctx) == d:
                own = kt(a, b)
                weighted[ctx, node] = own if d == lm.DEPTH else np.logaddexp(own, below[ctx, node]) - math.log(2)
                if d:
                    below[ctx[1:], node] = below.get((ctx[1:], node), 0.0) + weighted[ctx, node]

    def one(ctx, node, d=0):
        key = (ctx[lm.DEPTH - d :], node)
        a, b = counts[key]
        own = (b + 0.5) / (a + b + 1)
        deeper = (ctx[lm.DEPTH - d - 1 :], node)
        if d == lm.DEPTH:
            return own
        w = math.exp(kt(a, b) - math.log(2) - weighted[key])
        return w * own + (1 - w) * (one(ctx, node, d + 1) if deeper in counts else own)

    def score(words):
        total = 0.0
        for ctx, byte in predictions(words):
            for node, bit in bits_of(byte):
                p = one(ctx, node) if (b"", node) in counts else 0.5
                total += math.log10(p if bit else 1 - p)
        return total

    return score


def test_context_tree(spark):
    rnd = random.Random(4)
    parts = ["th", "er", "on", "an", "re", "he", "ü"]
    texts = [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(0, 40))) for _ in range(80)] + [None, "", "Zzz\tqq the THE", "the " * 3000 + "qqqq " * 300]
    ids = [*range(len(texts) - 1), None]
    df = spark.createDataFrame([(i, t, 1, "s", "k") for i, t in zip(ids, texts, strict=True)], DOCS).repartition(4)
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i in ids}
    training = Counter()
    for i, t in zip(ids, texts, strict=True):
        if not held[i]:
            training.update([*words_of(t), b""])
    n, v, score = sum(training.values()), len(training), tree_brute([words_of(t) for i, t in zip(ids, texts, strict=True) if not held[i]])
    got = {r["doc_id"]: r for r in lm.scored(df).collect()}
    for i, t in zip(ids, texts, strict=True):
        tokens, r = [*words_of(t), b""], got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(x in training for x in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((training[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens))
        assert r["score"] == pytest.approx(score(words_of(t)))
    assert lm.scored(df.limit(0)).collect() == []
    alone = [i for i in ids if held[i]][:1]
    only = lm.scored(df.where(f"doc_id = {alone[0]}")).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and only["score"] < 0


def test_context_tree_over_running_text(spark, monkeypatch):
    for name, n in (("BATCH", 700), ("CHUNK", 300), ("PART_BYTES", 100)):
        monkeypatch.setattr(lm, name, n)
    rnd = random.Random(5)
    words = ["a", "of", "ü", "letters", "longer-words", "It"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25))) for _ in range(60)]
    # The same words in another order, all in their order, and repeated rows.
    texts += [None, "", "a of letters", "letters of\ta", "a of It " * 300, "It of a " * 300] + ["of a letter"] * 40
    df = spark.createDataFrame([(i, t, 1, "s", "k") for i, t in enumerate(texts)], DOCS).repartition(3)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    score = tree_brute([words_of(t) for t, h in zip(texts, held, strict=True) if not h])
    got = {r["doc_id"]: r for r in lm.scored(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(score(words_of(t)))
        assert got[i]["code_length"] == pytest.approx(-score(words_of(t)) * math.log2(10) / (sum(len(w) + 1 for w in words_of(t)) + 1))
    assert lm.scored(df.limit(0)).collect() == []


def test_context_tree_is_better_on_unseen_text(spark):
    """With 10,000 documents; with a few hundred the word base, which gives any unknown word a share, is ahead."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sums = lm.scored(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert sums["s"] > sums["b"]


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 2.5, 10.5, 1e3, 1e9])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_scores_do_not_depend_on_how_files_are_cut(spark, monkeypatch):
    draw = random.Random(2)
    texts = ["".join(draw.choice("abc ") for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1, "s", "k") for i, t in enumerate(texts)], DOCS)
    whole = {r["doc_id"]: r for r in lm.scored(df.coalesce(1)).collect()}
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100", "parquet.block.size": "2000"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for name, n in (("BATCH", 1000), ("CHUNK", 700), ("PART_BYTES", 500)):
        monkeypatch.setattr(lm, name, n)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        cut = {r["doc_id"]: r for r in lm.scored(df.repartition(7)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert whole.keys() == cut.keys() == set(range(60))
    for i, r in whole.items():
        assert r["score"] == pytest.approx(cut[i]["score"], abs=1e-6) and r["base_score"] == pytest.approx(cut[i]["base_score"], abs=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (cut[i]["n_tokens"], cut[i]["n_known"], cut[i]["train_tokens"])


def test_packed_grams():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**56, 1000))
    for k in (keys, keys[:1], keys[:0]):
        got = lm._unpacked(lm._packed(k, np.arange(len(k)) % 7))
        assert (got[0] == k).all() and (got[1] == np.arange(len(k)) % 7).all() and len(got[0]) == len(k)
        price = -np.random.default_rng(4).random(len(k)).astype("f4")
        assert (lm._unpacked_prices(lm._packed_prices(price), len(k)) == price).all()

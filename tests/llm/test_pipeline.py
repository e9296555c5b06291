"""The corpus pipeline against what its stages promise, by brute force on a small table."""

import hashlib
import re
from collections import Counter

import tiktoken

import corpus_pipeline
from tidemark.llm import bpe
from tidemark.llm.queries import table, tokenizer

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pipeline(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    accepted = corpus_pipeline.quality_stage(spark, table(spark, SF, "documents"), SF)
    assert accepted.columns == table(spark, SF, "documents").columns
    kept = {r["doc_id"] for r in accepted.select("doc_id").collect()}
    sets = {d: shingles(docs[d]) for d in kept}
    # Only sets that share a shingle can be alike.
    least, holders = {d: d for d in kept}, {}
    for d in sorted(kept):
        for s in sets[d]:
            holders.setdefault(s, []).append(d)

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for d in sorted(kept):
        for other in {o for s in sets[d] for o in holders[s] if o < d}:
            if 100 * len(sets[d] & sets[other]) >= 75 * len(sets[d] | sets[other]):
                a, b = sorted((root(d), root(other)))
                least[b] = a
    first = {d for d in kept if root(d) == d}
    assert 0 < len(first) <= len(kept) <= len(docs)
    rows = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert rows and set(copies) <= first and max(copies.values()) <= 2
    assert len(copies) > len(first) / 2
    path, pattern = tokenizer()
    encoding = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in rows:
        ids = encoding.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()

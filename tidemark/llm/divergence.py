"""Audit of how far the sources of a language differ in their terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Bytes of text that are packed and sorted at once; distinct terms a task holds before it hands them on.
STEP_BYTES, HELD_TERMS = 4 << 20, 1_500_000
# Kept terms of a language that are compared in one task.
PART_TERMS = 1024

_BYTES = np.arange(256)
_LETTER = (_BYTES >= 0x80) | ((_BYTES | 0x20) >= ord("a")) & ((_BYTES | 0x20) <= ord("z"))
_LOWER = np.where(_LETTER & (_BYTES < 0x80), _BYTES | 0x20, _BYTES).astype(np.uint8)
_FIRST = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9)], np.uint64)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by unsigned ``keys``, the first one counting most: passes over 16-bit digits from the lowest on."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 8 * key.itemsize, 16):
            digit = ((key >> np.array(shift, key.dtype)) & np.array(0xFFFF, key.dtype)).astype(np.uint16)
            if len(digit) and digit.min() < digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def byte_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by group, then by bytes of a fixed width."""
    order = np.argsort(keys[1], kind="stable")
    return order[np.argsort(keys[0][order], kind="stable")]


def run_counted(keys: list[np.ndarray], sums: list[np.ndarray], docs: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of sorted ``keys`` and the sum of each of ``sums`` over their runs, with ``docs`` also the number of distinct ones in a run."""
    n = len(keys[0])
    if not n:
        return keys, [*sums, *([] if docs is None else [np.zeros(0, np.int64)])]
    new = np.zeros(n, bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    if docs is not None:
        fresh = new.copy()
        fresh[1:] |= docs[1:] != docs[:-1]
        sums = [*sums, fresh.astype(np.int64)]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(s, first) for s in sums]


class TermCounts:
    """Counts of (group, term) and of documents that hold them, in buckets by the length of the term.

    Terms of up to 8 bytes are one big-endian uint64, those of up to 16 two; both are radix-sorted and run-counted. Longer ones lie in
    buckets of the next power of two, padded with zero bytes (no term has any), and are sorted as bytes. Each step adds a sorted
    run per bucket; runs are merged by sorting them together.
    """

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[list[np.ndarray], list[np.ndarray]]]] = {}
        self.held = 0

    def add(self, texts: list[bytes], groups: np.ndarray) -> None:
        """Count the texts' terms; ``groups`` has the group of each text."""
        flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        letter = _LETTER[flat]
        edge = np.flatnonzero(np.diff(letter, prepend=False))
        begin, end = edge[::2], edge[1::2]
        size = end - begin
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
        lower = np.concatenate((_LOWER[flat], np.zeros(16, np.uint8)))
        eight = np.lib.stride_tricks.sliding_window_view(lower, 8)
        word = lambda at, n: eight[at].view(">u8").ravel().astype(np.uint64) & _FIRST[n]
        short, middle = size <= 8, (size > 8) & (size <= 16)
        self._run(8, [groups[doc[short]], word(begin[short], size[short])], doc[short], radix_order)
        at, n = begin[middle], size[middle]
        self._run(16, [groups[doc[middle]], word(at, np.full(len(at), 8)), word(at + 8, n - 8)], doc[middle], radix_order)
        long = np.flatnonzero(size > 16)
        width = 1 << np.ceil(np.log2(np.maximum(size[long], 1))).astype(np.int64)
        for w in np.unique(width).tolist():
            which = long[width == w]
            padded = np.zeros((len(which), w), np.uint8)
            for row, (x, y) in enumerate(zip(begin[which].tolist(), end[which].tolist(), strict=True)):
                padded[row, : y - x] = lower[x:y]
            self._run(w, [groups[doc[which]], padded.view(f"S{w}").ravel()], doc[which], byte_order)

    def _run(self, bucket: int, keys: list[np.ndarray], doc: np.ndarray, sort) -> None:
        if len(doc):
            order = sort(keys)
            keys = [k[order] for k in keys]
            run = run_counted(keys, [np.ones(len(doc), np.int64)], doc[order])
            self.runs.setdefault(bucket, []).append(run)
            self.held += len(run[0][0])

    def merge(self) -> None:
        """One run per bucket."""
        for bucket, runs in self.runs.items():
            if len(runs) > 1:
                keys, sums = ([np.concatenate(x) for x in zip(*side, strict=True)] for side in zip(*runs, strict=True))
                order = (radix_order if bucket <= 16 else byte_order)(keys)
                self.runs[bucket] = [run_counted([k[order] for k in keys], [s[order] for s in sums])]
        self.held = sum(len(r[0][0][0]) for r in self.runs.values())

    def rows(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """Group, term, occurrences and documents of each bucket, which then is empty."""
        self.merge()
        for bucket, [(keys, (n, docs))] in self.runs.items():
            words = keys[1].view(np.uint8).reshape(-1, bucket) if bucket > 16 else np.stack(keys[1:], axis=1).astype(">u8").view(np.uint8)
            used = words != 0
            offsets = np.concatenate(([0], np.cumsum(used.sum(axis=1))))
            term = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words[used])])
            yield keys[0].astype(np.int64), term.cast(pa.string()), n, docs
        self.runs, self.held = {}, 0


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: each task's counts, a row per distinct term while the task can hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, groups = TermCounts(), {}

        def rows() -> Iterator[pa.RecordBatch]:
            langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            for group, term, n, held in counts.rows():
                for i in range(0, len(n), 100_000):
                    part = slice(i, i + 100_000)
                    at = pa.array(group[part])
                    yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term[part], pa.array(n[part]), pa.array(held[part])], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.uint32)
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < STEP_BYTES:
                    size += len(texts[end])
                    end += 1
                counts.add(texts[at:end], group[at:end])
                at = end
                if counts.held > HELD_TERMS:
                    counts.merge()
                    if counts.held > HELD_TERMS // 2:
                        yield from rows()
        yield from rows()

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def smoothed(count: Column, total: Column, terms: Column, scale: int, extra: int) -> Column:
    """1 + floor(scale * (count + extra) / (total + extra * terms)) in exact integers."""
    whole = "decimal(38,0)"
    above = (count.cast(whole) + F.lit(extra)) * F.lit(scale).cast(whole)
    return F.call_function("div", above, (total.cast(whole) + terms.cast(whole) * F.lit(extra)).cast(whole)) + F.lit(1)


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, scale: int = 1_000_000_000, extra: int = 5) -> DataFrame:
    """How far each source of a language is from the others (part ``pair``), and its most over-represented terms (part ``term``).

    Terms are runs of A-Z, a-z and characters beyond ASCII, only A-Z lower-cased. A language keeps the terms that ``min_docs`` of its documents hold.
    A source's smoothed share of a kept term is p = 1 + floor(scale * (count + extra) / (N + extra * V)), N its occurrences of kept terms, V their number;
    the language's share q alike over all its documents. ``pair``: for each other source of the language the sum of the absolute differences of p over all kept
    terms (0 without any). ``term``: the kept terms that the source holds and whose p is above q, by p - q, the ``top`` first.

    Result: lang, source, part, item, value, rank (from 1 per lang, source and part; value descending, item ascending by its UTF-8 bytes).

    Each task counts whole texts (TermCounts) and hands on a row per distinct term, so that a hot source or term is summed before it is shuffled. Kept terms
    are compared in parts of about PART_TERMS: a task holds the shares of that many terms in all sources of one language and gives a sum per
    pair of sources, which are many only where the result is. All arithmetic is in integers.

    Null text, lang and source are ''. A language and source whose texts are all empty still takes part, with counts of 0. A very long text costs a task about
    20 times its bytes, a very long term up to four times its bytes. Repeated rows count as often as they occur. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = partial_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = stored(found, "divergence-counts")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = stored(kept.select(F.col("lang").alias("of_lang"), F.col("term").alias("of_term"), "total"), "divergence-kept")
    counts = found.join(kept, (F.col("lang") == F.col("of_lang")) & (F.col("term") == F.col("of_term"))).select("lang", "source", "term", "n", "total")
    counts = stored(counts, "divergence-kept-counts")
    # Small tables, written so that Spark knows their size: a row per language, and one per language and source.
    langs = kept.groupBy("of_lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("terms"))
    sums = counts.groupBy(F.col("lang").alias("sum_lang"), F.col("source").alias("sum_source")).agg(F.sum("n").alias("source_n"))
    groups = rows.select("lang", "source").distinct()
    groups = groups.join(sums, (F.col("lang") == F.col("sum_lang")) & (F.col("source") == F.col("sum_source")), "left").join(langs, F.col("lang") == F.col("of_lang"), "left")
    none = F.lit(0).cast("bigint")
    groups = stored(groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[F.coalesce(c, none).alias(c) for c in ("source_n", "lang_n", "terms")]), "divergence-groups")

    share = lambda n, total: smoothed(F.col(n), F.col(total), F.col("terms"), scale, extra)
    priced = counts.join(groups, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    priced = priced.select("lang", "source", "term", "terms", share("n", "source_n").alias("p"), share("total", "lang_n").alias("q"))

    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    parts = F.greatest(F.ceil(F.col("terms") / PART_TERMS), F.lit(1)).cast("bigint")
    left = priced.select("lang", F.pmod(F.xxhash64("term"), parts).alias("part_no"), "source", "term", "p")
    # The share of a term that a source doesn't hold; sources of a language without kept terms meet in one part.
    zero = F.when(F.col("terms") > 0, smoothed(none, F.col("source_n"), F.greatest("terms", F.lit(1)), scale, extra)).otherwise(none)
    right = groups.select("g_lang", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("g_part"), "g_source", zero.alias("zero"))

    def compare(shares: pa.Table, sources: pa.Table) -> pa.Table:
        names = sources.column("g_source").to_pylist()
        spot = {s: i for i, s in enumerate(names)}
        term = shares.column("term").combine_chunks().dictionary_encode()
        at = term.indices.to_numpy()
        table = np.repeat(sources.column("zero").to_numpy()[:, None], len(term.dictionary), axis=1)
        table[[spot[s] for s in shares.column("source").to_pylist()], at] = shares.column("p").to_numpy()
        lang = sources.column("g_lang")[0].as_py()
        one, two, value = [], [], []
        for i, name in enumerate(names[:-1]):
            one += [name] * (len(names) - i - 1)
            two += names[i + 1 :]
            value.append(np.abs(table[i + 1 :] - table[i]).sum(axis=1))
        values = np.concatenate(value) if value else np.empty(0, np.int64)
        return pa.table([pa.array([lang] * len(one), pa.string()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "value"])

    sums = left.groupBy("lang", "part_no").cogroup(right.groupBy("g_lang", "g_part")).applyInArrow(compare, "lang string, source string, item string, value bigint")
    sums = sums.groupBy("lang", F.least("source", "item").alias("one"), F.greatest("source", "item").alias("two")).agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("p"), "value")
    pairs = both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(over)

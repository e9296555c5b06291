"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Bytes of context. Contexts that share their latest SPLIT bytes lie in one task; what is above them is summed up by key.
DEPTH, SPLIT = 6, 3
BLANK, STOP = b" ", b"\n"
# Bytes of running text of a batch, and of it those whose grams are sorted at a time.
BATCH, CHUNK = 24_000_000, 3_000_000
# Bytes of text for each part of the grams; there are at most PARTS of them.
PART_BYTES, PARTS = 8_000_000, 2**20
# What a row of a batch holds.
GRAMS, TOKENS, TEXT = 0, 1, 2

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5 by Stirling's series at x + 7."""
    y = x + 7.0
    shift = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4)) + np.log((x + 5) * (x + 6))
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with ``a`` zeros and ``b`` ones."""
    most = int((a + b).max()) if len(a) else 0
    if most < len(a):
        n = np.arange(most + 1.0)
        half, whole = log_gamma(n + 0.5), log_gamma(n + 1)
        return half[a] + half[b] - np.log(np.pi) - whole[a + b]
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
    return keys[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def _bits(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The eight binary nodes (1 to 255) on the way to a byte and the bit taken at each."""
    byte = byte.astype(np.int64)
    for j in range(8):
        yield (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def _levels(context: np.ndarray, byte: np.ndarray, count: np.ndarray, top: int) -> list[tuple]:
    """Context-tree nodes from depth DEPTH up to ``top``: keys (context << 8 | node), zeros, ones, ln weighted.

    A context holds its latest byte highest, so that its parent, one byte shorter, is a prefix.
    """
    seen = count > 0
    context, byte, count = context[seen], byte[seen], count[seen]
    keys, zeros, ones = [], [], []
    for node, bit in _bits(byte):
        keys.append((context << 8) | node)
        zeros.append(np.where(bit == 0, count, 0))
        ones.append(np.where(bit == 1, count, 0))
    key, (a, b) = _summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
    out = [(key, a, b, log_kt(a, b))]
    for _ in range(DEPTH - 1, top - 1, -1):
        key, a, b, weighted = out[-1]
        key, (a, b, below) = _summed(((key >> 16) << 8) | (key & 255), a, b, weighted)
        out.append((key, a, b, np.logaddexp(log_kt(a, b), below) - np.log(2)))
    return out[::-1]


def _shares(level: tuple, leaf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a level, the weight of its own estimate against all below it, and the estimate of a one."""
    key, a, b, weighted = level
    own = np.ones(len(key)) if leaf else np.exp(np.minimum(log_kt(a, b) - np.log(2) - weighted, 0))
    return key, own, (b + 0.5) / (a + b + 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _log10_bytes(context: np.ndarray, byte: np.ndarray, shares: list[tuple]) -> np.ndarray:
    """log10 probability of each byte in its context: every bit mixes the estimates of all depths on its path.

    At depth d a node keeps its weight of what is left and hands the rest down. Where training has not seen
    the next deeper context, the rest goes to the last estimate seen.
    """
    total = np.zeros(len(context))
    for node, bit in _bits(byte):
        mix, rest, last, alive = np.zeros(len(context)), np.ones(len(context)), np.full(len(context), 0.5), np.ones(len(context), bool)
        for depth, (keys, own, one) in enumerate(shares):
            at, found = _find(keys, ((context >> (8 * (DEPTH - depth))) << 8) | node)
            alive &= found
            w, p = np.where(alive, own[at] if len(own) else 0.0, 0.0), np.where(alive, one[at] if len(one) else last, last)
            mix += rest * w * p
            rest *= 1 - w
            last = p
        mix += rest * last
        total += np.log10(np.where(bit == 1, mix, 1 - mix))
    return total


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray]:
    parts = [[b.column(n).to_numpy() for n in names] for b in batches]
    return [np.concatenate(p) if parts else np.empty(0, np.int64) for p in (list(zip(*parts, strict=True)) or [()] * len(names))]


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """Fold 0 of the CRC-32 of doc_id as text (null: of no bytes) is not learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers and their counts: the steps between them and the counts, their bytes of a place together, compressed."""
    step, n = np.diff(keys, prepend=0).astype("<i8"), counts.astype("<i4")
    raw = step.view(np.uint8).reshape(-1, 8).T.tobytes() + n.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=12 * size, codec="zstd", asbytes=True), np.uint8)
    step = np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view("<i8").ravel()
    return np.cumsum(step), np.ascontiguousarray(raw[8 * size :].reshape(4, size).T).view("<i4").ravel().astype(np.int64)


def _packed_prices(price: np.ndarray) -> bytes:
    """4-byte numbers, their bytes of a place together, compressed."""
    return pa.compress(price.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked_prices(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, size).T).view("<f4").ravel()


def _part(context, parts: int):
    """The part of a context's latest SPLIT bytes: a number or an array."""
    return (((context * 2654435761) & 0xFFFFFFFF) >> 8) % parts


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of the texts, some at a time, and the number of the text of each.

    A gram is the DEPTH bytes before a position, the latest highest, then the byte there; blanks stand for what lies before a text.
    """
    flat = np.frombuffer(BLANK * DEPTH + b"".join(BLANK * DEPTH + t for t in texts), np.uint8)
    ends = np.cumsum([len(t) + DEPTH for t in texts])
    begins = np.concatenate(([0], ends[:-1])) + DEPTH
    for low in range(0, int(ends[-1]), CHUNK):
        high = min(low + CHUNK, int(ends[-1]))
        wide = flat[low : high + DEPTH].astype(np.int64)
        gram = np.zeros(high - low, np.int64)
        for k in range(1, DEPTH + 1):
            gram = (gram << 8) | wide[DEPTH - k : len(wide) - k]
        gram = (gram << 8) | wide[DEPTH:]
        first, last = np.searchsorted(ends, (low, high - 1), side="right")
        doc = np.repeat(np.arange(first, last + 1), np.diff(np.minimum(ends[first : last + 1], high), prepend=low))
        real = np.arange(low, high) >= begins[doc]
        yield gram[real], doc[real]


def batches_of(docs: DataFrame, parts: int) -> DataFrame:
    """The rows of all batches: kind, batch, part, data, doc_id.

    Columns of ``docs``: doc_id, text, train, start (a number per partition). A batch is a run of a task's documents of BATCH bytes or little more. TEXT rows
    are its running texts: the lower-cased words with a blank after each, then the end. GRAMS rows are its distinct grams of a part with their counts in
    training, TOKENS rows its distinct tokens likewise; the empty word is the end of a text.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(kind: int, batch: int, part: list, data: list, doc_id: list) -> pa.RecordBatch:
            n = len(data)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.int32()), pa.array([batch] * n, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary()), pa.array(doc_id, pa.int64())],
                names=["kind", "batch", "part", "data", "doc_id"],
            )

        def emit(held: list, train: list, texts: list, words: dict, batch: int) -> Iterator[pa.RecordBatch]:
            yield block(TEXT, batch, [0] * len(held), texts, held)
            unseen, found = ~np.array(train, bool), []
            for gram, doc in _grams(texts):
                found.append(np.unique((gram << 1) | unseen[doc], return_counts=True))
            key, (n,) = _summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
            gram, (n,) = _summed(key >> 1, np.where(key & 1, 0, n))
            part = _part(gram >> 8 * (DEPTH + 1 - SPLIT), parts)
            order = np.argsort(part, kind="stable")
            gram, n, part = gram[order], n[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            yield block(GRAMS, batch, part[cuts[:-1]].tolist(), [_packed(gram[i:j], n[i:j]) for i, j in itertools.pairwise(cuts)], [None] * (len(cuts) - 1))
            dealt: dict[int, list] = {}
            for w in words:
                dealt.setdefault(zlib.crc32(w) % parts, []).append(w)
            data = [np.array([words[w] for w in ws], "<i8").tobytes() + BLANK.join(ws) for ws in dealt.values()]
            data = [len(ws).to_bytes(8, "little") + d for ws, d in zip(dealt.values(), data, strict=True)]
            yield block(TOKENS, batch, list(dealt), data, [None] * len(data))

        held, train, texts, words, size, number = [], [], [], Counter(), 0, None
        for rb in rows:
            for doc_id, text, t, start in zip(*(rb.column(c).to_pylist() for c in ("doc_id", "text", "train", "start")), strict=True):
                number = start if number is None else number
                ws = (text or "").encode().translate(_LOWER).split()
                texts.append(b"".join(w + BLANK for w in ws) + STOP)
                ws.append(b"")
                words.update(ws if t else dict.fromkeys(ws, 0))
                held.append(doc_id)
                train.append(t)
                size += len(texts[-1])
                if size >= BATCH:
                    yield from emit(held, train, texts, words, number)
                    held, train, texts, words, size, number = [], [], [], Counter(), 0, number + 1
        if held:
            yield from emit(held, train, texts, words, number)

    return docs.select("doc_id", "text", "train", "start").mapInArrow(run, "kind int, batch bigint, part int, data binary, doc_id bigint")


def _words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    return data[8 + 8 * size :].split(BLANK), np.frombuffer(data[8 : 8 + 8 * size], "<i8")


def token_counts(table: DataFrame, parts: int) -> DataFrame:
    """TOKENS rows with the corpus counts of their tokens (batch, data), and a row per task with the sum and the number of counts above 0 (n, v)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("data", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
        held, counts = [], {}
        for rb in rows:
            for batch, data in zip(rb.column("batch").to_pylist(), rb.column("data").to_pylist(), strict=True):
                held.append((batch, data))
                for w, n in zip(*(lambda ws, n: (ws, n.tolist()))(*_words(data)), strict=True):
                    counts[w] = counts.get(w, 0) + n
        for batch, data in held:
            ws, _ = _words(data)
            n = np.array([counts[w] for w in ws], "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([batch], [data[:8] + n + BLANK.join(ws)], [0], [0]), schema.types, strict=True)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([None], [None], [sum(counts.values())], [sum(n > 0 for n in counts.values())]), schema.types, strict=True)], schema=schema)

    return table.where(F.col("kind") == TOKENS).select("batch", "part", "data").repartitionById(parts, "part").mapInArrow(run, "batch bigint, data binary, n bigint, v bigint")


def _merged(runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of runs and their counts; never more than twice the distinct ones and a few million are held."""
    keys, counts, held, least = [], [], 0, 4_000_000
    for k, n in runs:
        keys.append(k)
        counts.append(n)
        held += len(k)
        if held > least:
            key, (n,) = _summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held, least = [key], [n], len(key), 2 * len(key) + 4_000_000
    key, (n,) = _summed(np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *counts]))
    return key, n


def upper_nodes(table: DataFrame, parts: int) -> DataFrame:
    """Nodes above depth SPLIT. Rows of a part hold the nodes one level above it that its grams can need (data: keys, weights, estimates).

    Rows of part -1 are shares of the sums of depth SPLIT - 2 (key, a, b, below).
    """

    def below(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, count = _merged(_unpacked(d) for rb in rows for d in rb.column("data").to_pylist())
        if count.any():
            key, a, b, weighted = _levels(gram >> 8, gram & 255, count, SPLIT)[0]
            key, (a, b, under) = _summed(((key >> 16) << 8) | (key & 255), a, b, weighted)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, a, b, under)], names=["key", "a", "b", "below"])

    def level(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["part", "key", "a", "b", "below", "data"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        key, a, b, under = _columns(rows, ("key", "a", "b", "below"))
        if not len(key):
            return
        order = np.argsort(key)
        key, a, b, under = key[order], a[order], b[order], under[order]
        here = (key, a, b, np.logaddexp(log_kt(a, b), under) - np.log(2))
        up, sums = _summed(((key >> 16) << 8) | (key & 255), a, b, here[3])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.full(len(up), -1), up, *sums, [None] * len(up)), types, strict=True)], names=names)
        _, own, one = _shares(here, False)
        context, of = np.unique(key >> 8, return_inverse=True)
        pairs = np.unique(_part((context[:, None] << 8) | np.arange(256), parts) * len(context) + np.arange(len(context))[:, None])
        part, at = pairs // len(context), pairs % len(context)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        for i, j in itertools.pairwise(cuts):
            wanted = np.zeros(len(context), bool)
            wanted[at[i:j]] = True
            mine = wanted[of]
            data = b"".join(x[mine].tobytes() for x in (key, own, one))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((int(part[i]), None, None, None, None, data), types, strict=True)], names=names)

    runs = table.where(F.col("kind") == GRAMS).select("part", "data").repartitionById(parts, "part")
    sums = runs.mapInArrow(below, "key bigint, a bigint, b bigint, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("a", "b", "below")])
    return sums.repartition(F.shiftright("key", 8)).mapInArrow(level, "part int, key bigint, a bigint, b bigint, below double, data binary")


def gram_prices(table: DataFrame, upper: DataFrame, parts: int) -> DataFrame:
    """batch, data and price of the GRAMS rows: the log10 probabilities of their grams, as 4-byte numbers.

    Only the sums of the nodes at depth 1 (at most 256 * 255) pass the driver; a part's nodes at depth 2 lie with its grams.
    """
    sums = sorted(upper.where("part < 0").groupBy("key").agg(F.sum("a"), F.sum("b"), F.sum("below")).collect())
    key, a, b = (np.array([r[k] for r in sums], np.int64) for k in range(3))
    one = (key, a, b, np.logaddexp(log_kt(a, b), np.array([r[3] for r in sums], float)) - np.log(2))
    key, (a, b, below) = _summed(key & 255, a, b, one[3])
    root = (key, a, b, np.logaddexp(log_kt(a, b), below) - np.log(2))
    tops = table.sparkSession.sparkContext.broadcast([_shares(root, False), _shares(one, False)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes = [], [np.empty((3, 0))]
        for rb in rows:
            for batch, data in zip(rb.column("batch").to_pylist(), rb.column("data").to_pylist(), strict=True):
                if batch is None:
                    nodes.append(np.frombuffer(data, np.int64).reshape(3, -1))
                else:
                    held.append((batch, data))
        if not held:
            return
        nodes = np.concatenate([x.astype(np.int64) for x in nodes], axis=1)
        nodes = np.ascontiguousarray(nodes[:, np.argsort(nodes[0])])
        gram, count = _merged(_unpacked(d) for _, d in held)
        levels = _levels(gram >> 8, gram & 255, count, SPLIT)
        shares = [*tops.value, (nodes[0], nodes[1].view(float), nodes[2].view(float)), *[_shares(x, k == len(levels) - 1) for k, x in enumerate(levels)]]
        price = np.concatenate([_log10_bytes(g >> 8, g & 255, shares) for g in np.array_split(gram, len(gram) // 200_000 + 1)]).astype("<f4")
        for batch, data in held:
            wanted = _unpacked(data)[0]
            mine = _packed_prices(price[np.searchsorted(gram, wanted)])
            # Counts have done their work.
            data = _packed(wanted, np.zeros(len(wanted), int))
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([data], pa.binary()), pa.array([mine], pa.binary())], names=["batch", "data", "price"])

    runs = table.where(F.col("kind") == GRAMS).select("part", "batch", "data")
    above = upper.where("part >= 0").select("part", F.lit(None).cast("bigint").alias("batch"), "data")
    return runs.union(above).repartitionById(parts, "part").mapInArrow(run, "batch bigint, data binary, price binary")


def scored(docs: DataFrame) -> DataFrame:
    """Scores of every document under a unigram base and the context-tree model learned from the training folds.

    Tokens are the lower-cased (A-Z) words and one end per text. base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) per token. The model is
    context-tree weighting over the bytes of the running text, its words with a blank after each, then the end, with binary-decomposed bytes. A byte's
    contexts are the up to DEPTH bytes before it, across words; blanks stand for what lies before a text. Each bit mixes the Krichevsky-Trofimov
    estimates of all depths by their weights; where training has not seen the next deeper context, the rest of the weight goes to the last estimate seen.
    ``score`` is the text's log10 probability (grams' prices are rounded to 4-byte numbers, an error of 1e-7 of the score at most), code_length its bits per byte.

    The texts are read once into batches, whose distinct grams and tokens are counted before they are shuffled; prices go back to the batches, and the
    grams of the texts are cut a second time. What this needs grows with the corpus and stays distributed; a very long text is a batch of its own, whose
    grams are sorted CHUNK bytes at a time.

    Null and empty texts hold one token, the end. Null doc_ids belong to the fold of the empty string; repeated rows are
    scored, and learned from, as often as they occur; without training documents c, N and V are 0 and
    every bit has probability 1/2. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (~held_out(F.col("doc_id"))).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(max(size // PART_BYTES, 8), PARTS)
    table = stored(batches_of(rows.withColumn("start", F.spark_partition_id().cast("bigint") * 2**20), parts), "lm-batches")
    tokens = stored(token_counts(table, parts), "lm-tokens")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    prices = gram_prices(table, stored(upper_nodes(table, parts), "lm-nodes"), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "n_known", "base", "score", "bytes"]

        def emit(ids: list, texts: list, keys: np.ndarray, price: np.ndarray, base: dict) -> pa.RecordBatch:
            score, per = np.zeros(len(texts)), []
            for gram, doc in _grams(texts):
                order = np.argsort(gram)
                score += np.bincount(doc[order], price[np.searchsorted(keys, gram[order])], len(texts))
            for t in texts:
                of = [base[w] for w in t.split()] + [base[b""]]
                per.append((len(of), len(of) - of.count(-1.0), sum(of)))
            columns = (ids, *zip(*per, strict=True), score, [len(t) for t in texts])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        now, keys, price, base, ids, texts, size = None, [], [], {}, [], [], 0
        for rb in batches:
            for batch, kind, data, priced, doc_id in zip(*(rb.column(c).to_pylist() for c in ("batch", "kind", "data", "price", "doc_id")), strict=True):
                if texts and (batch != now or size >= CHUNK):
                    yield emit(ids, texts, keys, price, base)
                    ids, texts, size = [], [], 0
                if batch != now:
                    now, keys, price, base = batch, [], [], {}
                if kind == GRAMS:
                    keys.append(_unpacked(data)[0])
                    price.append(_unpacked_prices(priced, len(keys[-1])))
                elif kind == TOKENS:
                    ws, n = _words(data)
                    base.update(zip(ws, np.log10(n + 0.1).tolist(), strict=True))
                else:
                    if isinstance(keys, list):
                        keys, price = np.concatenate(keys), np.concatenate(price).astype(float)
                        order = np.argsort(keys)
                        keys, price = keys[order], price[order]
                    ids.append(doc_id)
                    texts.append(data)
                    size += len(data)
        if texts:
            yield emit(ids, texts, keys, price, base)

    none = F.lit(None)
    every = [
        prices.select("batch", F.lit(GRAMS).alias("kind"), "data", "price", none.cast("bigint").alias("doc_id")),
        tokens.where(F.col("batch").isNotNull()).select("batch", F.lit(TOKENS).alias("kind"), "data", none.cast("binary").alias("price"), none.cast("bigint").alias("doc_id")),
        table.where(F.col("kind") == TEXT).select("batch", "kind", "data", none.cast("binary").alias("price"), "doc_id"),
    ]
    both = reduce(DataFrame.union, every).repartition(max(8, size // BATCH), "batch").sortWithinPartitions("batch", "kind")
    sums = both.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, bytes bigint")
    norm = float(np.log10(total["n"] + 0.1 * (total["v"] + 1)))
    return sums.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total["n"]).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("bytes")).alias("code_length"),
    )

"""Near-duplicate documents: SetSketch registers, banded, estimated jointly, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import stored
from tidemark.llm.components import components

REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
TOP = 2**16 - 1
SHINGLE = 5
# A link: PERCENT * union <= 100 * intersection.
PERCENT = 75
# Estimates are off by a standard deviation of at most sqrt(J (1 - J) / REGISTERS); a pair is verified unless it lies five of them below.
MARGIN = 5.0
# Buckets up to this size are compared in pairs, larger ones with their first member, then in blocks where needed.
SMALL = 8
BLOCK = 256
KEPT_WORDS = 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit shingle hashes of a text, sorted; remembers word hashes up to KEPT_WORDS."""

    def __init__(self, size: int = SHINGLE) -> None:
        import xxhash

        self.size, self.known, self.hash = size, {}, xxhash.xxh3_64_intdigest

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode().translate(_LOWER).split()

    def of(self, text: str | None) -> np.ndarray:
        known, ids = self.known, []
        for w in self.words(text):
            h = known.get(w)
            if h is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                h = known[w] = self.hash(w)
            ids.append(h)
        if not ids:
            return np.empty(0, np.uint64)
        h = np.array(ids, np.uint64)
        n = len(h) - self.size + 1
        if n < 1:
            # The whole sequence as one shingle; its length keeps it apart from others.
            whole = len(ids)
            for x in ids:
                whole = (whole * int(_GOLD) + x) % 2**64
            return mixed_bits(np.array([whole], np.uint64))
        out = h[:n].copy()
        for k in range(1, self.size):
            out *= _GOLD
            out += h[k : n + k]
        return np.unique(mixed_bits(out))


def registers(shingles: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of a non-empty set; those of a union are the larger of both.

    An element's m values are exponentially distributed and spaced: the j-th lies in the j-th of m intervals
    of equal probability, and a permutation drawn from the element deals them to the registers. A register is
    floor(1 - log_b(smallest value)). Values ascend with j, so the first few intervals suffice as soon as every
    register has a value; else all are used.
    """
    n = len(shingles)
    steps = min(m, -(-17 * m // n) + 1)
    stride = (mixed_bits(shingles ^ _M1) | np.uint64(1))[:, None]
    start = mixed_bits(shingles ^ _M2)[:, None]
    while True:
        j = np.arange(steps, dtype=np.uint64)[None, :]
        draw = (mixed_bits(shingles[:, None] + (j + np.uint64(1)) * _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        survival = (m - j.astype(np.float64) - draw) / m
        place = ((stride * j + start) & np.uint64(m - 1)).astype(np.int64)
        best = np.zeros(m)
        np.maximum.at(best, place.ravel(), survival.ravel())
        if steps == m or best.min() > 0:
            break
        steps = m
    x = -np.log(np.clip(best, 1e-300, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likeness(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Maximum-likelihood Jaccard likeness from how often a's register is above and below b's, and both set sizes."""
    u = na / (na + nb)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + (m - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        a, b = low + (high - low) / 3, high - (high - low) / 3
        right = value(a) < value(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def least_estimate(m: int = REGISTERS) -> float:
    j = PERCENT / 100
    return j - MARGIN * (j * (1 - j) / m) ** 0.5


def id_of(docs: DataFrame) -> Column:
    """doc_id as bigint where it is a whole number, else as it is given."""
    return F.col("doc_id").cast("bigint") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.col("doc_id")


def sketched(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n (set size), set_a and set_b (128-bit hash of the set), sketch and bands.

    Without words n is 0, and sketch and bands are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler()
        salts = mixed_bits(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64))
        for batch in batches:
            n, sets, sketches, bands = [], [], [], []
            last: tuple | None = None
            for text in batch.column("text").to_pylist():
                if last is None or last[0] != text:
                    s = shingler.of(text)
                    r = registers(s) if len(s) else None
                    last = (
                        text, len(s), np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64),
                        None if r is None else r.tobytes(), None if r is None else mixed_bits(r.view(np.uint64) ^ salts).view(np.int64),
                    )
                n.append(last[1])
                sets.append(last[2])
                sketches.append(last[3])
                bands.append(last[4])
            pair = np.array(sets, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "set_a", "set_b", "sketch", "bands"],
            )

    rows = docs.select(id_of(docs).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, n bigint, set_a bigint, set_b bigint, sketch binary, bands array<bigint>")
    return out.withColumn("row", F.monotonically_increasing_id())


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate may reach the threshold."""
    side = lambda x: sketches.select(F.col("row").alias(f"{x}_row"), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_s"))
    both = pairs.join(side("a"), F.col("a") == F.col("a_row")).join(side("b"), F.col("b") == F.col("b_row"))
    least = least_estimate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("a_s", "b_s"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("a_n", "b_n"))
            j = likeness((x > y).sum(1), (x < y).sum(1), na, nb)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(j >= least))

    # Sizes alone rule a pair out if the smaller set is too small for the larger.
    both = both.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * PERCENT)
    return both.select("a", "b", "a_n", "b_n", "a_s", "b_s").mapInArrow(run, "a bigint, b bigint")


def _texts(rows: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """row and text of the wanted rows (one column, row; distinct)."""
    ids = sketches.join(rows, "row").select("row", F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"))
    own = docs.select(id_of(docs).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    hit = own.join(ids, (own["text_hash"] == ids["hash_"]) & own["doc_id"].eqNullSafe(ids["id_"])).select("row", "text")
    return stored(hit, "dup-texts")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Links u, v: the pairs (written table) whose full shingle sets reach the threshold."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), sketches, docs)
    side = lambda x: texts.select(F.col("row").alias(f"{x}_row"), F.col("text").alias(f"{x}_t"))
    both = pairs.join(side("a"), F.col("a") == F.col("a_row")).join(side("b"), F.col("b") == F.col("b_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, own = Shingler(), None, None
        for batch in batches:
            hit = []
            b_ids = batch.column("b").to_pylist()
            for b, s, t in zip(b_ids, batch.column("a_t"), batch.column("b_t"), strict=True):
                if b != held:  # the join brings the rows of a b together
                    held, own = b, shingler.of(t.as_py())
                other = shingler.of(s.as_py())
                both = len(np.intersect1d(own, other, assume_unique=True))
                hit.append(100 * both >= PERCENT * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(hit, pa.bool_()))

    return both.select("a", "b", "a_t", "b_t").mapInArrow(run, "u bigint, v bigint")


def _linked_in_blocks(rows: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Links u, v between different components in large buckets (columns key, row, root, size).

    Members are dealt to blocks by hash; a task compares two blocks at a time. A pair is looked at in the first
    band that it shares; what the estimate lets through is verified on the full sets right there, so that
    neither pairs nor candidates are ever written. Of the links between the same two components a
    pair of blocks gives one.
    """
    texts = _texts(rows.select("row").distinct(), sketches, docs).select(F.col("row").alias("t_row"), "text")
    about = stored(sketches.join(texts, F.col("row") == F.col("t_row")).select("t_row", "n", "sketch", "text"), "dup-about")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    dealt = rows.select("key", "row", "root", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = stored(dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "row", "root"), "dup-dealt")
    dealt = dealt.join(about, F.col("row") == F.col("t_row")).drop("t_row")
    least = least_estimate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        salts = mixed_bits(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64))

        def links(key: int, group: list) -> pa.RecordBatch:
            mine, row, root, n = (np.array([g[k] for g in group], np.int64) for k in range(4))
            s = np.frombuffer(b"".join([g[4] for g in group]), np.uint16).reshape(len(group), -1)
            bands = mixed_bits(s.view(np.uint64) ^ salts)
            at = int(np.flatnonzero(bands[0].view(np.int64) == key)[0])
            low = np.flatnonzero(mine == mine.min())
            high = np.flatnonzero(mine != mine.min())
            high = high if len(high) else low
            sets: dict[int, np.ndarray] = {}
            out: dict[tuple[int, int], tuple[int, int]] = {}
            for i in low:
                k = high[root[high] != root[i]]
                k = k[(row[k] > row[i]) | (mine[k] != mine[i])]
                k = k[~(bands[k, :at] == bands[i, :at]).any(1)]
                k = k[np.minimum(n[k], n[i]) * 100 >= np.maximum(n[k], n[i]) * PERCENT]
                if not len(k):
                    continue
                more, less = (s[i] > s[k]).sum(1), (s[i] < s[k]).sum(1)
                near = likeness(more, less, np.full(len(k), float(n[i])), n[k].astype(float)) >= least
                for j in k[near]:
                    pair = (min(root[i], root[j]), max(root[i], root[j]))
                    if pair in out:
                        continue
                    for x in (i, j):
                        if x not in sets:
                            sets[x] = shingler.of(group[x][5])
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                        out[pair] = (row[i], row[j])
            found = np.array(list(out.values()), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        held, group = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "x", "y", "mine", "row", "root", "n", "sketch", "text")]
            for key, x, y, *rest in zip(*cols, strict=True):
                if (key, x, y) != held:
                    if group:
                        yield links(held[0], group)
                    held, group = (key, x, y), []
                group.append(rest)
        if group:
            yield links(held[0], group)

    sorted_ = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return sorted_.select("key", "x", "y", "mine", "row", "root", "n", "sketch", "text").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, with its row number and text_hash.

    A-Z is lower-cased, words are runs without white space, a set holds the distinct runs of five words (fewer
    words: the whole sequence). Documents are linked where 100 * intersection >= 75 * union.

    1. Equal sets collapse into one (128-bit hash of the sorted set), whatever their number.
    2. SetSketch registers are cut into 32 bands of 4; sets that agree in a band share a bucket. Two sets at
       the threshold share none with probability (1 - 0.75 ** 4) ** 32 = 5e-6.
    3. Small buckets give all their pairs, larger ones pairs with their first member. What the joint estimate
       leaves is verified on the full sets.
    4. Larger buckets that still span several components are compared in blocks, across components.
    5. Links are contracted to components.

    Null or empty texts have no shingles and stand alone. Rows with a null doc_id are linked like others;
    component_id is the smallest doc_id of a component, null if it has none. Repeated rows are copies
    of each other. ``kept`` marks one row of each component, of the smallest doc_id. An empty table gives an empty
    result; other columns are ignored. doc_id may have any type with an order (whole numbers become bigint).
    All words of a text are held at once by the task that sketches it, however long it is.
    """
    sketches = stored(sketched(docs), "dup-sketches")
    sets = sketches.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("row").alias("set_row"))
    sets = stored(sets, "dup-sets")

    first = sketches.join(sets.select(F.col("set_row").alias("row")), "row").select("row", "n", "sketch", "bands", "doc_id", "text_hash")
    first = stored(first, "dup-first")
    banded = first.select("row", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("row").alias("h"), F.col("row").alias("row"))).alias("head")).where("size > 1")
    buckets = stored(buckets.select(F.col("key").alias("b_key"), "size", F.col("head.row").alias("head")), "dup-buckets")
    members = stored(banded.join(buckets, F.col("key") == F.col("b_key")).select("key", "row", "size", "head"), "dup-members")
    small = members.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    of_small = small.select(F.explode(F.flatten(F.transform("rows", lambda a: F.transform(F.filter("rows", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    of_large = members.where((F.col("size") > SMALL) & (F.col("row") != F.col("head"))).select(F.col("row").alias("a"), F.col("head").alias("b"))
    pairs = stored(of_small.unionByName(of_large).distinct(), "dup-pairs")
    likely = stored(_estimated(pairs, first), "dup-likely")
    links = stored(_verified(likely, first, docs), "dup-links")
    found = components(links)

    large = members.where(F.col("size") > SMALL).join(found, F.col("row") == F.col("node"), "left")
    large = stored(large.select("key", "row", "size", F.coalesce("root", "row").alias("root")), "dup-large")
    split = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("key").alias("s_key"))
    split = stored(split, "dup-split")
    if split.limit(1).count():
        rest = stored(large.join(split, F.col("key") == F.col("s_key")).select("key", "row", "size", "root"), "dup-rest")
        more = stored(_linked_in_blocks(rest, first, docs), "dup-links")
        if more.limit(1).count():
            links = stored(links.unionByName(more), "dup-links")
            found = components(links)

    rooted = sketches.select("row", "doc_id", "text_hash", "n", "set_a", "set_b").join(sets.withColumnRenamed("n", "n_").select(*[F.col(c).alias(f"{c}_") for c in ("set_a", "set_b")], "n_", "set_row"), (F.col("set_a") == F.col("set_a_")) & (F.col("set_b") == F.col("set_b_")) & (F.col("n") == F.col("n_")), "left")
    rooted = rooted.select("row", "doc_id", "text_hash", "n", F.coalesce("set_row", "row").alias("set_row"))
    rooted = rooted.join(found, F.col("set_row") == F.col("node"), "left")
    rooted = stored(rooted.select("row", "doc_id", "text_hash", "n", F.coalesce("root", "set_row").alias("root")), "dup-rooted")
    heads = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("head"))
    heads = stored(heads.select(F.col("root").alias("h_root"), F.col("head.id").alias("component_id"), F.col("head.row").alias("head_row")), "dup-heads")
    return rooted.join(heads, F.col("root") == F.col("h_root")).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("head_row")).alias("kept"), "row", "text_hash"
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; all its columns are kept.

    Columns travel in one struct, so any names may be among them. Of repeated rows, and of rows that agree in
    doc_id and text, one stays. Rows with a null doc_id, null or empty texts and empty tables are handled as by
    ``near_duplicates``: texts without words stand alone and stay.
    """
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(whole, id_of(docs).alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    hit = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash")))
    # Rows that agree in doc_id and text are copies; one of them stays. The join has brought them together.
    return hit.dropDuplicates(["own_id", "own_hash"]).select("whole.*")

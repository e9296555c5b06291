"""Names that are easily confused."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog.tables import AMBIGUOUS_ABBREVIATIONS, GENERIC_NAMES, SYNONYM_PAIRS
from tidemark.functions.regex import java
from tidemark.functions.text import dirname, stem


def file_names(files: DataFrame) -> DataFrame:
    """(project, dir, name) of every file."""
    return files.select("project", dirname(F.col("path")).alias("dir"), stem(F.col("path")).alias("name"))


# Characters of a directory's names that are compared with the rest of it at a time.
PIECE = 1 << 19
# Bytes of names read, keys sorted, pairs held and rows written at a time in a task.
BYTES, KEYS, PAIRS, ROWS = 1 << 20, 1 << 22, 1 << 22, 1 << 17
# Names up to this length are cut into characters at once, longer ones first into PARTS, and then each part into as many as FINER.
PLAIN, PARTS, FINER = 24, 8, 4
# Names behind one key from which on they are cut finer.
CROWD = 1024


def _pieces(names: DataFrame, piece: int) -> DataFrame:
    """Names as often as they take part in a comparison of a piece of their directory with longer or other names.

    Lengths of a directory with up to ``piece`` characters in all make a band, a band of more is dealt into pieces by a hash
    of the name. Names of a piece are ``kept``: they meet each other, those of later pieces of the band and, from the
    bands after it, names up to two characters longer. So any two names that may be similar meet exactly once.
    """
    sized = names.withColumn("length", F.length("name"))
    sizes = sized.groupBy("project", "dir", "length").agg((F.count(F.lit(1)) * F.first("length")).alias("chars"))
    by_length = Window.partitionBy("project", "dir").orderBy("length")
    before = F.coalesce(F.sum("chars").over(by_length.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = sizes.withColumn("band", F.floor(before / piece))
    bands = bands.withColumn("pieces", F.ceil(F.sum("chars").over(Window.partitionBy("project", "dir", "band")) / piece))
    shorter = F.collect_set(F.struct("band", "pieces")).over(by_length.rangeBetween(-2, -1))
    bands = bands.select("project", "dir", "length", "band", "pieces", F.filter(shorter, lambda s: s["band"] < F.col("band")).alias("shorter"))
    at = lambda band, piece, kept: F.struct(band.alias("band"), piece.alias("piece"), kept.alias("kept"))
    own = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("own")), lambda p: at(F.col("band"), p, p == F.col("own")))
    others = F.transform("shorter", lambda s: F.transform(F.sequence(F.lit(0).cast("bigint"), s["pieces"] - 1), lambda p: at(s["band"], p, F.lit(False))))
    dealt = sized.join(bands, ["project", "dir", "length"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("pieces")))
    return dealt.select("project", "dir", "name", F.inline(F.concat(own, F.flatten(others))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Names:
    """Names of a few pieces, with the hashes their keys are made of."""

    def __init__(self, names: pa.Array, group: np.ndarray) -> None:
        values = names.to_pylist()
        self.length = np.fromiter(map(len, values), np.int64, len(values))
        self.start = np.cumsum(self.length) - self.length
        self.point = np.frombuffer("".join(values).encode("utf-32-le"), "<u4")
        self.code = _mix(self.point.astype(np.uint64))
        self.group = _mix(group.astype(np.uint64))
        self.factor = _mix(np.arange(self.length.max(initial=0), dtype=np.uint64)) | np.uint64(1)

    def sums(self, rows: np.ndarray, shift: int, size: int) -> np.ndarray:
        """For each of ``size`` places of names of equal length, the sum over those before it, taken ``shift`` characters further on."""
        out = np.zeros((size + 1, len(rows)), np.uint64)
        first, last = max(0, -shift), min(size, int(self.length[rows[0]]) - shift)
        for p in range(first, size):
            if p < last:
                np.multiply(self.code[self.start[rows] + (p + shift)], self.factor[p], out=out[p + 1])
            out[p + 1] += out[p]
        return out

    def keys(self, rows: np.ndarray, size: int, moved: int, growth: int) -> Callable[[np.ndarray], np.ndarray]:
        """Hashes of the characters [0, lo), [hi, lo2) and [hi2, size), the second ones ``moved`` and the third ones ``growth`` further on."""
        left, middle, right = (self.sums(rows, shift, size) for shift in (0, moved, growth))
        right = self.group[rows] + right[size] - right

        def of(cut: np.ndarray) -> np.ndarray:
            lo, hi, lo2, hi2, salt = cut
            return left[lo] + middle[lo2] - middle[hi] + right[hi2] + _mix(salt.astype(np.uint64))[:, None]

        return of


    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Edit distances, 3 for more than two, of names of one length to names up to two characters longer."""
        size, more = int(self.length[x[0]]), int(self.length[y[0]])
        a, b = ([self.point[self.start[rows] + k] for k in range(n)] for rows, n in ((x, size), (y, more)))
        far = np.full(len(x), 3, np.uint8)
        # For each shift of y against x by up to two characters, the distance of what was read so far.
        row = [far, far, *(np.full(len(x), k, np.uint8) for k in range(3)), far]
        for i in range(size):
            below = far
            for k in range(5):
                j = i + k - 2
                if j >= more:
                    row[k] = far
                    continue
                best = np.minimum(row[k + 1], below) + np.uint8(1)
                if j >= 0:
                    best = np.minimum(best, row[k] + (a[i] != b[j]))
                below = row[k] = np.minimum(best, far)
        return row[2 + more - size]


def _cuts(length: int, parts: int) -> np.ndarray:
    """Every choice of parts for two edits to hide in, as (lo, hi, lo2, hi2, number); of one part for the one edit of names under five characters."""
    a, b = np.diag_indices(parts) if length < 5 else np.triu_indices(parts, 1)
    at = np.arange(parts + 1) * length // parts
    return np.array([at[a], at[a + 1], at[np.maximum(b, a + 1)], at[b + 1], np.arange(1, len(a) + 1)])


class _Keys(NamedTuple):
    """Keys of some rows of a round, the first of which is ``first``, one for each cut; ``always``: they meet those of all cuts."""

    first: int
    of: Callable[[np.ndarray], np.ndarray]
    cuts: np.ndarray
    always: bool = False


def _rounds(names: _Names, short: np.ndarray, long: np.ndarray, growth: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[_Keys]]]:
    """Keys by which names find each other: rows, whether a row stands for a shorter and for a longer name, and the keys.

    Between two left-out parts the text moved by the edits of the first one, by one character at most where both
    parts hold an edit; where both edits lie in one part, the choice with its neighbour has nothing in between.
    """
    length = int(names.length[short[0]])
    cuts = _cuts(length, parts)
    rows = np.concatenate((short, long))
    is_short = np.arange(len(rows)) < len(short)
    if growth == 0:
        either = np.union1d(short, long)
        roles = np.isin(either, short), np.isin(either, long)
        yield either, *roles, [_Keys(0, names.keys(either, length, 0, 0), cuts)]
        if length < 5:
            return
        if parts == length:
            # Of two edits that aren't replacements, one leaves a character out and one puts one in.
            at = np.arange(length)
            yield either, *roles, [_Keys(0, names.keys(either, length - 1, 0, 1), np.array([at, at, at, at, at * 0]), True)]
            return
    elif 5 <= length == parts <= PLAIN:
        whole = names.keys(short, length, 0, 0)
        if growth == 1:
            # One character replaced, x, and one put in, at place i: behind x or not.
            x, i = (v.ravel() for v in np.mgrid[:length, : length + 1])
            behind = np.array([x, x + 1, i, i, x + 1])[:, i > x]
            before = np.array([i, i, x, x + 1, x + 1])[:, i <= x]
            x = np.arange(length)
            left_out = np.array([x, x + 1, x + 1, x + 1, x + 1])
            for moved, found in ((0, behind), (1, before)):
                yield rows, is_short, ~is_short, [_Keys(0, whole, left_out), _Keys(len(short), names.keys(long, length, moved, 1), found)]
            return
        i, j = np.triu_indices(length + 2, 1)
        all_of_it = np.array([[length] * 4 + [0]]).T
        yield rows, is_short, ~is_short, [_Keys(0, whole, all_of_it, True), _Keys(len(short), names.keys(long, length, 1, 2), np.array([i, i, j - 1, j - 1, i * 0]))]
        return
    apart = cuts[:, cuts[2] > cuts[1]]
    moves = {0: (-1, 1), 1: (0, 1), 2: (1,)}[growth]
    for k, moved in enumerate(moves):
        chosen = cuts if growth and k == 0 else apart
        if chosen.size:
            yield rows, is_short, ~is_short, [_Keys(0, names.keys(short, length, 0, 0), chosen), _Keys(len(short), names.keys(long, length, moved, growth), chosen)]


def _packed(keys: list[_Keys], rows: int) -> Iterator[np.ndarray]:
    """Keys with the number of their row in the lower bits, about KEYS at a time; those that may meet come together."""
    bits = np.uint64(rows.bit_length())

    def made(own: _Keys, cuts: np.ndarray) -> np.ndarray:
        out = own.of(cuts)
        out >>= bits
        out <<= bits
        out |= np.arange(own.first, own.first + out.shape[1], dtype=np.uint64)
        return out.ravel()

    ahead = [made(k, k.cuts) for k in keys if k.always]
    dealt = [k for k in keys if not k.always]
    if not dealt:
        yield np.concatenate(ahead)
        return
    # Cuts of one number meet; where all have the same, the others are among those that are always there.
    numbers = [k.cuts[-1] if k.cuts[-1].any() else np.arange(k.cuts.shape[1]) for k in dealt]
    last = max(int(n.max(initial=0)) for n in numbers)
    step = max(1, KEYS * (last + 1) // max(1, sum(k.cuts.shape[1] * rows for k in dealt)))
    for begin in range(0, last + 1, step):
        chosen = [made(k, k.cuts[:, (n >= begin) & (n < begin + step)]) for k, n in zip(dealt, numbers)]
        yield np.concatenate([*ahead, *chosen])


def _runs(packed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and number of the key of all whose key isn't their own alone; the place is in the lower ``bits``."""
    packed.sort()
    key = packed >> np.uint64(bits)
    same = key[1:] == key[:-1]
    shared = np.zeros(len(packed), bool)
    shared[1:] = same
    shared[:-1] |= same
    key, place = key[shared], packed[shared] & np.uint64((1 << bits) - 1)
    return place.astype(np.int64), np.cumsum(np.diff(key, prepend=key[:1]) != 0)


def _crossed(x: np.ndarray, x_run: np.ndarray, y: np.ndarray, y_run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs, about PAIRS at a time; runs ascend."""
    first = np.searchsorted(y_run, x_run)
    n = np.searchsorted(y_run, x_run, "right") - first
    ends = np.cumsum(n)
    begin = 0
    while begin < len(x):
        # One row has at most as many partners as there are rows.
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        part = n[begin:end]
        offset = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        yield np.repeat(x[begin:end], part), y[np.repeat(first[begin:end], part) + offset]
        begin = end


def _once(pairs: list[np.ndarray]) -> np.ndarray:
    merged = np.concatenate(pairs) if pairs else np.empty(0, np.int64)
    merged.sort()
    return merged[np.diff(merged, prepend=-1) != 0]


def _alike(names: _Names, short: np.ndarray, long: np.ndarray, growth: int, crowd: int, same: bool) -> Iterator[np.ndarray]:
    """Pairs of names of one length with names longer by ``growth`` that share a key, each once: both rows in one number.

    ``same``: both are the same names, so that pairs of one length would come twice.
    """
    if not (len(short) and len(long)):
        return
    length = int(names.length[short[0]])
    a, b, parts, found, held = short, long, length if length <= PLAIN else PARTS, [], 0
    while len(a) and len(b):
        again = [np.zeros(len(names.length), bool) for _ in range(2)]
        for rows, is_short, is_long, keys in _rounds(names, a, b, growth, parts):
            for packed in _packed(keys, len(rows)):
                place, run = _runs(packed, len(rows).bit_length())
                x, y = is_short[place], is_long[place]
                if parts < length and len(run):
                    crowded = np.bincount(run[x], minlength=run[-1] + 1)[run] > crowd
                    for role, who in zip(again, (x, y)):
                        role[rows[place[who & crowded]]] = True
                    x, y = x & ~crowded, y & ~crowded
                for one, other in _crossed(rows[place[x]], run[x], rows[place[y]], run[y]):
                    if growth == 0 and same:
                        one, other = one[one < other], other[one < other]
                    found.append(one << 32 | other)
                    held += len(one)
                    if held > PAIRS:
                        found = [_once(found)]
                        held = len(found[0])
                        if held > PAIRS // 2 and len(short) > 1:
                            # Too many to hold: half of the shorter names at a time.
                            found.clear()
                            for half in np.array_split(short, 2):
                                yield from _alike(names, half, long, growth, crowd, same)
                            return
        a, b, parts = a[again[0][a]], b[again[1][b]], min(parts * FINER, length)
    yield _once(found)


def _candidates(names: _Names, kept: np.ndarray, fresh: np.ndarray, crowd: int) -> Iterator[np.ndarray]:
    """Pairs of kept names of which one is fresh, if all are, and of kept names with those that aren't."""
    rows = np.arange(len(kept))
    new, others = rows[kept & fresh], rows[~kept]
    for few, many, same in ((new, new, True), (rows[kept], others, False), (others, rows[kept], False)):
        by_length = {int(n): many[names.length[many] == n] for n in np.unique(names.length[many])}
        for n in np.unique(names.length[few]).tolist():
            short = few[names.length[few] == n]
            # The last turn looks for names shorter than a kept one; those as long were found before.
            for growth in range(int(many is not others and not same), 2 if n < 5 else 3):
                if n + growth in by_length:
                    yield from _alike(names, short, by_length[n + growth], growth, crowd, same)


def _paired(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the pieces, which come one after the other, each with its kept names first.

    Many small pieces are worked on together; of a large one only the kept names and some of the others are in memory.
    """
    keys = ("project", "dir", "band", "piece")
    waiting, old, more = [], 0, 0

    def work(table: pa.Table, end: int, old: int) -> Iterator[pa.RecordBatch]:
        rows = table.slice(0, end).combine_chunks().to_batches()[0]
        group = _starts(rows, keys)
        names = _Names(rows.column("name"), np.cumsum(group))
        kept = rows.column("kept").to_numpy(zero_copy_only=False)
        for found in _candidates(names, kept, np.arange(end) >= old, crowd):
            for k in range(0, len(found), ROWS):
                x, y = found[k : k + ROWS] >> 32, found[k : k + ROWS] & 0xFFFFFFFF
                distance = names.distances(x, y)
                near = (distance == 1) | ((distance == 2) & (names.length[x] >= 5))
                x, y = pa.array(x[near]), pa.array(y[near])
                columns = [rows.column("project").take(x), rows.column("dir").take(x), rows.column("name").take(x), rows.column("name").take(y)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(distance[near].astype(np.int32))], names=["project", "dir", "short", "long", "distance"])

    for batch in batches:
        waiting.append(batch)
        more += batch.column("name").nbytes
        if more < BYTES:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        batch = table.to_batches()[0]
        start, kept = _starts(batch, keys), batch.column("kept").to_numpy(zero_copy_only=False)
        # Up to here: the next row begins a piece or isn't kept.
        places = np.flatnonzero(start | ~kept)
        end = int(places[-1]) if len(places) else 0
        if end <= old:
            continue
        yield from work(table, end, old)
        first = int(np.flatnonzero(start[: end + 1])[-1])
        held = batch.slice(first, end - first)
        held = held.filter(pa.array(kept[first:end]))
        old, more = held.num_rows, 0
        waiting = [held, batch.slice(end)]
    if waiting and (table := pa.Table.from_batches(waiting)).num_rows > old:
        yield from work(table, table.num_rows, old)


def _starts(rows: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether a row is the first one of its keys."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for c in keys:
        out[1:] |= pc.not_equal(rows.column(c)[1:], rows.column(c)[:-1]).to_numpy(zero_copy_only=False)
    return out


def similar_names(names: DataFrame, crowd: int = CROWD, piece: int = PIECE) -> DataFrame:
    """Pairs of names in a directory one edit apart, or two when both have five characters.

    Only names are shuffled: directories are cut into pieces by the length of names, and a task compares a piece with
    what may be similar to it. There a name is cut into parts; two edits leave all parts but two whole, so the longer
    name of a pair holds the others of the shorter one, moved by no more characters than were put in or left out before
    them. Names meet under the hash of what is left without any two parts. Candidates are checked with the real edit distance.

    The parts of names up to ``PLAIN`` characters are single characters. Longer names are cut into eight parts; those that
    share a key with more than ``crowd`` others aren't paired under it but cut finer, at last into single characters. What
    then shares a key is bounded by the alphabet, whatever the number of names or the size of their directory.
    Names under three characters and null names are left out, repeated ones count once.
    """
    # Every name becomes hundreds of keys, so names aren't merged into few partitions for being small.
    spread = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = names.select("project", "dir", "name").where(F.col("project").isNotNull() & F.col("dir").isNotNull() & (F.length("name") >= 3)).distinct()
    keys = ("project", "dir", "band", "piece")
    dealt = _pieces(owned, piece).repartition(spread, *keys).sortWithinPartitions(*keys, F.desc("kept"))
    kinds = ", ".join(f"{c} {owned.schema[c].dataType.simpleString()}" for c in ("project", "dir"))
    pairs = dealt.mapInArrow(lambda batches: _paired(batches, crowd), f"{kinds}, short string, long string, distance int")
    return pairs.select("project", "dir", F.least("short", "long").alias("name_a"), F.greatest("short", "long").alias("name_b"), "distance")


def synonym_names(names: DataFrame, pairs: Sequence[tuple[str, str]] = SYNONYM_PAIRS) -> DataFrame:
    """How many name pairs of a directory mix two interchangeable words.

    Only the set of words a name contains matters, so names are first counted per
    word set (a bit mask). Pairing the few masks of a directory gives the exact
    number of name pairs per first matching word pair without building them.
    """
    words = sorted({w for pair in pairs for w in pair})
    bit = {w: 1 << i for i, w in enumerate(words)}
    mask = sum((F.when(F.col("name").contains(w), F.lit(b)).otherwise(F.lit(0)) for w, b in bit.items()), F.lit(0))
    masks = (
        names.withColumn("mask", mask).where(F.col("mask") > 0).groupBy("project", "dir", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("example"))
    )
    a = masks.select("project", "dir", F.col("mask").alias("ma"), F.col("n").alias("na"), F.col("example").alias("example_a"))
    b = masks.select("project", "dir", F.col("mask").alias("mb"), F.col("n").alias("nb"), F.col("example").alias("example_b"))
    both = a.join(b, ["project", "dir"]).where(F.col("ma") <= F.col("mb"))
    hit = None
    for i, (x, y) in enumerate(pairs):
        fits = (
            (F.col("ma").bitwiseAND(bit[x]) != 0) & (F.col("mb").bitwiseAND(bit[y]) != 0)
        ) | ((F.col("ma").bitwiseAND(bit[y]) != 0) & (F.col("mb").bitwiseAND(bit[x]) != 0))
        hit = F.when(fits, i) if hit is None else hit.when(fits, i)
    count = F.when(F.col("ma") == F.col("mb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    labels = F.array(*[F.lit(f"{x}/{y}") for x, y in pairs])
    return (
        both.withColumn("pair", hit).where(F.col("pair").isNotNull())
        .groupBy("project", "dir", "pair")
        .agg(F.sum(count).cast("bigint").alias("name_pairs"), F.least(F.min("example_a"), F.min("example_b")).alias("example"))
        .where(F.col("name_pairs") > 0)
        .withColumn("words", F.element_at(labels, F.col("pair") + 1))
        .select("project", "dir", "words", "name_pairs", "example")
    )


def generic_names(lines: DataFrame) -> DataFrame:
    """Exported functions and short variables whose name says nothing."""
    function = F.regexp_extract("line", java(r"^\s*export\s+(?:async\s+)?function\s+(\w+)"), 1)
    variable = F.regexp_extract("line", java(r"^\s*export\s+(?:const|let)\s+(\w+)\s*="), 1)
    named = lines.where(F.col("line").contains("export")).select(
        "project", "path", "line_no", function.alias("f"), variable.alias("v")
    )
    generic = F.lower("f").isin(*GENERIC_NAMES) | (F.lower("v").isin(*GENERIC_NAMES) & (F.length("v") <= 6))
    return named.where(generic).select(
        "project", "path", "line_no", F.when(F.col("f") != "", F.col("f")).otherwise(F.col("v")).alias("name")
    )


def ambiguous_abbreviations(
    files: DataFrame, column: Column | None = None, words: Sequence[str] = AMBIGUOUS_ABBREVIATIONS
) -> DataFrame:
    """Abbreviations in file names that could mean several things."""
    name = column if column is not None else stem(F.col("path"))
    parts = F.filter(F.split(F.lower(name), "[-_./]"), lambda s: s.isin(*words))
    return files.select("project", "path", F.explode(parts).alias("abbreviation"))

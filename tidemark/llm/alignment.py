"""Alignment of the tokens that two tokenizers cut from the same text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Text of a block, whose id pairs meet in one task, and of a step of work inside a block, in bytes.
BLOCK_BYTES, STEP_BYTES = 32 << 20, 2 << 20
# Windows whose alignment a worker keeps; beyond that it starts anew. It only bounds memory.
KEPT_WINDOWS = 400_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, all others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a tokenizer's JSON file; ``tokens`` holds the bytes of each id.

    Where every merge makes the next higher id, ids are ranks and the faster of two equal encoders is taken.
    Runs of characters that its pattern can't get through go to the other one.
    """

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        of = byte_characters()
        vocab = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.tokens[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        self.ranked = None
        if all(a < b for a, b in zip(made, made[1:], strict=False)) and len(made) + 256 == len(model["vocab"]):
            import tiktoken

            self.ranked = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks={self.tokens[i]: i for i in model["vocab"].values()}, special_tokens={})

    def encode(self, text: str) -> Sequence[int]:
        if self.ranked is None or re.search(r"\s{5000}", text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_to_numpy(text, disallowed_special=())


class Pieces:
    """Pieces with byte fallback from a model file; U+2581 in a piece is a space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Grown:
    """A one-dimensional array that grows at its end."""

    def __init__(self) -> None:
        self.room, self.size = np.zeros(1 << 16, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            self.room = np.concatenate((self.room[: self.size], np.zeros(self.size + len(values), np.int64)))
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


def _gathered(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the lists ``which`` in order, and the sizes of these lists; ``starts`` has the end behind."""
    size = starts[which + 1] - starts[which]
    at = np.arange(size.sum()) + np.repeat(starts[which] - (np.cumsum(size) - size), size)
    return flat[at], size


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, empty ones included."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Side:
    """Tables of one tokenizer's vocabulary: bytes, lengths, space marks, and its ids in decimal with each mark that can follow."""

    def __init__(self, coder: ByteLevel | Pieces, after: str) -> None:
        self.coder = coder
        self.length = np.array([len(t) for t in coder.tokens], np.int64)
        self.marked = np.array([t[:1] == b" " for t in coder.tokens])
        self.flat = np.frombuffer(b"".join(coder.tokens), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.length)))
        self.spelled = [f"{i}{mark}" for i in range(len(coder.tokens)) for mark in (",", after)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.starts, ids)[0]


class Windows:
    """Alignments of windows, known by the ids on both sides.

    A window lies between two anchors: shared ends of both sides before a token that begins with a space. Whether both sides have
    the same bytes, its groups and its links are worked out once; a text's groups are those of its windows in order. Pairs of ids that
    share a group get numbers.
    """

    def __init__(self, first: ByteLevel, second: Pieces) -> None:
        self.sides = (Side(first, "|"), Side(second, ";"))
        self.clear()

    def clear(self) -> None:
        self.codes: dict[tuple[bytes, bytes], int] = {}
        self.spelled: list[str] = []
        self.pairs: dict[int, int] = {}
        self.groups, self.links, self.starts, self.unequal = Grown(), Grown(), Grown(), Grown()
        self.starts.add(np.zeros(1, np.int64))

    def align(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Work out windows that are not known yet."""
        sizes = [np.array([len(k[side]) >> 2 for k in keys], np.int64) for side in (0, 1)]
        ids = [np.frombuffer(b"".join([k[side] for k in keys]), np.int32) for side in (0, 1)]
        ends = [np.cumsum(s.length[i]) for s, i in zip(self.sides, ids, strict=True)]
        bounds = ends[0][np.cumsum(sizes[0]) - 1]
        shared = np.intersect1d(*ends, assume_unique=True)
        of = [np.searchsorted(shared, e) for e in ends]  # each token's group
        here = [np.bincount(x, minlength=len(shared)) for x in of]
        window = np.searchsorted(bounds, shared)  # each group's window
        # Links: every A token of a group with each B token of it, in order.
        begin = np.concatenate(([0], np.cumsum(here[1])))
        right, fan = _gathered(ids[1], begin, of[0])
        pair = (np.repeat(ids[0].astype(np.int64), fan) << 32) | right
        distinct, place = np.unique(pair, return_inverse=True)
        known = self.pairs
        numbers = np.array([known.setdefault(p, len(known)) for p in distinct.tolist()], np.int64)
        per_window = np.bincount(window, weights=here[0] * here[1], minlength=len(keys)).astype(np.int64)
        self.starts.add(self.links.size + np.cumsum(per_window))
        self.links.add(numbers[place])
        self.groups.add(np.bincount(window, minlength=len(keys)))
        data = [s.bytes_of(i) for s, i in zip(self.sides, ids, strict=True)]
        self.unequal.add(np.diff(np.concatenate(([0], np.cumsum(data[0] != data[1])))[np.concatenate(([0], bounds))]) > 0)
        # Ids in decimal with the mark behind them: a comma, or what ends the side of a group.
        words, order = [], []
        for s, i, g, n in zip(self.sides, ids, of, here, strict=True):
            last = np.zeros(len(i), bool)
            last[np.cumsum(n) - 1] = True
            words += list(map(s.spelled.__getitem__, (2 * i.astype(np.int64) + last).tolist()))
            order.append(2 * g + (s is self.sides[1]))
        order = np.argsort(np.concatenate(order), kind="stable").tolist()
        words = list(map(words.__getitem__, order))
        to = np.cumsum(sizes[0] + sizes[1]).tolist()
        self.spelled += ["".join(words[x:y]) for x, y in zip([0, *to[:-1]], to, strict=True)]

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of tokens on both sides, the window codes of all texts in order, and the number of windows of each text.

        A text has none where a side's bytes are not those of a space and the text.
        """
        found = []
        for text in texts:
            a, b = (self.sides[0].coder.encode(" " + text), self.sides[1].coder.encode(text)) if text else ((), ())
            a, b = np.asarray(a, np.int32), np.asarray(b, np.int32)
            same = self.sides[0].length[a].sum() == self.sides[1].length[b].sum() and self.sides[0].bytes_of(a).tobytes() == (" " + text if text else "").encode()
            found.append((a, b) if same else (a[:0], b[:0]))
        sizes = [np.array([len(f[side]) for f in found], np.int64) for side in (0, 1)]
        if not sizes[0].any():
            return (*sizes, np.empty(0, np.int64), np.zeros(len(found), np.int64))
        ids = [np.concatenate([f[side] for f in found]) for side in (0, 1)]
        ends = [np.cumsum(s.length[i]) for s, i in zip(self.sides, ids, strict=True)]
        # Both sides have as many bytes of each text, so offsets in the joined texts are comparable; a text's end ends a window.
        spots = []
        for s, i, n in zip(self.sides, ids, sizes, strict=True):
            last = np.append(s.marked[i[1:]], True)
            last[np.cumsum(n)[n > 0] - 1] = True
            spots.append(np.flatnonzero(last))
        shared = np.intersect1d(ends[0][spots[0]], ends[1][spots[1]], assume_unique=True)
        cuts = [np.searchsorted(e, shared) + 1 for e in ends]
        slices = [[r[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)] for r, at in zip([i.tobytes() for i in ids], [(4 * c).tolist() for c in cuts], strict=True)]
        keys = list(zip(*slices, strict=True))
        known, first = self.codes, len(self.codes)
        codes = np.array([known.setdefault(k, len(known)) for k in keys], np.int64)
        if len(known) > first:
            fresh, at = np.unique(codes, return_index=True)
            self.align([keys[i] for c, i in zip(fresh.tolist(), at.tolist(), strict=True) if c >= first])
        windows = np.diff(np.searchsorted(cuts[0], np.cumsum(sizes[0]), side="right"), prepend=0)
        wrong = _sums(self.unequal.all[codes], windows) > 0
        if wrong.any():
            return self.of_texts([t if not w else "" for t, w in zip(texts, wrong, strict=True)])
        return (*sizes, codes, windows)


BLOCKS = (
    "block bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, windows binary, "
    "pairs array<bigint>, held array<int>, links binary, starts binary"
)


def _shared_windows(spark: SparkSession, first: str, second: str, pattern: str):
    """Lets workers load both vocabularies once and keep their windows for later tasks."""
    paths = spark.sparkContext.broadcast({"paths": (first, second)})

    def load() -> Windows:
        if "windows" not in paths.value:
            paths.value["windows"] = Windows(ByteLevel(first, pattern), Pieces(second))
        return paths.value["windows"]

    return load


def blocks(docs: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """Rows of documents and of blocks (BLOCKS, and doc_id with its type).

    A document's row holds its counts, its digest, and its windows as int32 pairs of window number in the block and times. A block's row
    (``pairs`` not null) holds the distinct id pairs linked in its documents (A id << 32 | B id), in how many of
    them each is ``held``, and the links of its windows: numbers into ``pairs``, from ``starts`` on.
    """
    load = _shared_windows(docs.sparkSession, first, second, pattern)
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = load(), None
        held, local, order, size, number = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, None

        def step(ids: pa.Array, texts: list[str], block: int) -> pa.RecordBatch:
            nonlocal held, local
            n_a, n_b, codes, windows = known.of_texts(texts)
            spelled, at, digests = known.spelled, 0, []
            listed = list(map(spelled.__getitem__, codes.tolist()))
            for n in windows.tolist():
                digests.append(hashlib.sha256("".join(listed[at : at + n])[:-1].encode()).hexdigest() if n else "")
                at += n
            # Distinct windows of each text and their times; then distinct pairs of each text.
            key, times = np.unique((np.repeat(np.arange(len(texts)), windows) << 32) | codes, return_counts=True)
            doc, code = key >> 32, key & 0xFFFFFFFF
            pair, links = _gathered(known.links.all, known.starts.all, code)
            distinct = np.unique((np.repeat(doc, links) << 32) | pair) & 0xFFFFFFFF
            held = np.append(held, np.zeros(len(known.pairs) - len(held), np.int64))
            held += np.bincount(distinct, minlength=len(held))
            # Windows are numbered in the block as they come.
            local = np.append(local, np.full(len(known.codes) - len(local), -1))
            new = np.unique(code[local[code] < 0])
            local[new] = np.arange(len(new)) + sum(map(len, order))
            order.append(new)
            per_doc = np.bincount(doc, minlength=len(texts))
            packed = np.empty((len(code), 2), np.int32)
            packed[:, 0], packed[:, 1] = local[code], times
            offsets = np.concatenate(([0], np.cumsum(8 * per_doc))).astype(np.int32)
            columns = [
                pa.array(np.full(len(texts), block)), pa.array(n_a), pa.array(n_b), pa.array(_sums(known.groups.all[code] * times, per_doc)),
                pa.array(_sums(links * times, per_doc)), pa.array(digests, pa.string()),
                pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]),
                *[pa.nulls(len(texts), f.type) for f in list(schema)[8:]],
            ]
            return pa.RecordBatch.from_arrays([ids, *columns], schema=schema)

        def close(block: int) -> pa.RecordBatch:
            nonlocal held, local, order, size
            flat, sizes = _gathered(known.links.all, known.starts.all, np.concatenate(order))
            pairs = np.flatnonzero(held)
            by_number = np.fromiter(known.pairs, np.int64, len(known.pairs))
            pairs = pairs[np.argsort(by_number[pairs])]
            renamed = np.zeros(len(held), np.int32)
            renamed[pairs] = np.arange(len(pairs))
            starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            row = [None, block, *[None] * 6, by_number[pairs].tolist(), held[pairs].tolist(), renamed[flat].tobytes(), starts.tobytes()]
            held, local, order, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
            if len(known.codes) > KEPT_WINDOWS:
                known.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([
                ("doc_id", batch.schema.field("doc_id").type), *[(n, pa.int64()) for n in ("block", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
                ("windows", pa.binary()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("links", pa.binary()), ("starts", pa.binary()),
            ])
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if number is None and batch.num_rows:
                number = batch.column("start")[0].as_py()
            at = 0
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and n < STEP_BYTES:
                    n += len(texts[end]) + 1
                    end += 1
                yield step(batch.column("doc_id").slice(at, end - at), texts[at:end], number)
                at, size = end, size + n
                if size >= BLOCK_BYTES or len(known.codes) > KEPT_WINDOWS:
                    yield close(number)
                    number += 1
        if size:
            yield close(number)

    rows = docs.select("doc_id", "text", (F.spark_partition_id().cast("bigint") * 2**20).alias("start"))
    return rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, {BLOCKS}")


def linked(docs: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """Tokens of both tokenizers per document, their groups and links, and how usual the links are in the corpus.

    ``first`` is the file of a byte-level BPE (A, encodes a space and the text), ``second`` of a piece model (B, which adds the space);
    special tokens' strings are plain text. Both are needed at their path on all executors. Byte offsets at which tokens of both sides end cut a text into groups; every A and
    B token of a group are linked. The count of an id pair is the number of documents that hold it linked, a pair is best if none of its A id has a higher count.

    Texts are split into windows at anchors (Windows), aligned once per distinct window. One pass encodes each text and keeps, by block of about BLOCK_BYTES, the windows of each
    document and the pairs of each window. Counts are summed over blocks by pair, joined back to the blocks' pairs, and meet the documents of a block in one task. Blocks are bounded
    by bytes (one text beyond it is a block by itself), so a hot pair is one row a block.

    Result: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of ``a1,a2|b1;a3|b2``). Texts that are null or empty, or that a side does not encode
    to the very bytes of a space and the text, have no tokens: zeros and ''. A very long text is held by one task, about 30 bytes of arrays per byte. Repeated rows and
    equal or null doc_ids are documents of their own; an empty table gives an empty result; other columns are ignored.
    """
    table = stored(blocks(docs, first, second, pattern), "aligned-blocks")
    held = table.where("pairs is not null")
    counts = held.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.held").alias("n"))
    known = stored(counts.groupBy("pair").agg(F.sum("n").alias("n")), "aligned-pairs").withColumn("a", F.shiftright("pair", 32))
    highest = known.groupBy("a").agg(F.max("n").alias("most"))  # a row per A id at most
    known = known.join(highest, "a").select(F.col("pair").alias("id_pair"), "n", (F.col("n") == F.col("most")).alias("best"))
    wanted = held.select("block", F.posexplode("pairs").alias("at", "pair"))
    priced = wanted.join(known, F.col("pair") == F.col("id_pair")).select(F.col("block").alias("of_block"), "at", "n", "best")

    def add(rows: pa.Table, prices: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        is_block = rows.column("pairs_held").to_numpy(zero_copy_only=False)
        kept = rows.filter(pa.array(~is_block))
        at, n, best = (prices.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "best"))
        price, top = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        price[at], top[at] = n, best
        block = rows.filter(pa.array(is_block))
        links = np.frombuffer(block.column("links")[0].as_py(), np.int32)
        size = np.diff(np.frombuffer(block.column("starts")[0].as_py(), np.int32)).astype(np.int64)
        of_window = [_sums(x[links], size) for x in (top, price)]
        sums = np.zeros((2, kept.num_rows), np.int64)
        for i, packed in enumerate(kept.column("windows").to_pylist()):
            if packed:
                window, times = np.frombuffer(packed, np.int32).reshape(-1, 2).T
                sums[:, i] = [int((x[window] * times).sum()) for x in of_window]
        out = kept.select([c for c in kept.column_names if c in keep])
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1])).select([*keep[:5], "n_best", "count_sum", keep[5]])

    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = table.select(*keep, "block", "windows", "links", "starts", F.col("pairs").isNotNull().alias("pairs_held"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return rows.groupBy("block").cogroup(priced.groupBy("of_block")).applyInArrow(add, schema)


def token_groups(docs: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """doc_id and the groups of each text in order, as arrays of A and B ids; texts without tokens (see ``linked``) have none."""
    load = _shared_windows(docs.sparkSession, first, second, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load()
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            listed = []
            for text in batch.column("text").to_pylist():
                if len(known.codes) > KEPT_WINDOWS:
                    known.clear()
                spelled = "".join([known.spelled[c] for c in known.of_texts([text or ""])[2].tolist()])
                sides = [g.split("|") for g in spelled.split(";")[:-1]]
                listed.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in sides])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(listed, kind)], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups array<struct<a:array<int>,b:array<int>>>")

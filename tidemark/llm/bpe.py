"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Pieces whose ids a worker keeps at hand; beyond that it starts anew. It only bounds memory.
KEPT_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file of base64 and number per line; its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Encodes one piece of bytes; keeps the last token of every prefix.

    The encoding of a prefix ends with exactly one token, and a token can follow another only if the pair,
    encoded by itself, stays that pair. So the last token of a prefix of length i is the one token t
    that ends there, is its own encoding, and may follow the last token of the prefix of length
    i - len(t). Appending bytes extends the table and leaves what it holds; an edit cuts the table at the
    first byte that changed.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.by_id = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._whole: dict[bytes, bool] = {}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        # Finds the tokens that end at each byte; bytes stand in it as the characters of the same number.
        self._ends = ahocorasick.Automaton()
        for token in ranks:
            self._ends.add_word(token.decode("latin-1"), token)
        self._ends.make_automaton()

    def merged(self, data: bytes) -> list[bytes]:
        """Encoding of a few bytes by its definition: join the neighbours of lowest rank, the leftmost first."""
        ranks, none = self.ranks, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while joined and (lowest := min(joined)) < none:
            best = joined.index(lowest)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
            del joined[best]
            for i in (best - 1, best):
                if 0 <= i < len(joined):
                    joined[i] = ranks.get(parts[i] + parts[i + 1], none)
        return parts

    def whole(self, token: bytes) -> bool:
        """The token is its own encoding."""
        if token not in self._whole:
            self._whole[token] = len(self.merged(token)) == 1
        return self._whole[token]

    def follows(self, left: bytes, right: bytes) -> bool:
        """The two tokens stay as they are when they are neighbours."""
        key = (left, right)
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            both = left + right
            found = self._pairs[key] = both not in self.ranks and self.merged(both) == [left, right]
        return found

    def extend(self, data: bytes, last: list[bytes]) -> list[bytes]:
        """``last[i]``: last token of ``data[:i + 1]``; filled up to the length of ``data``."""
        pairs, follows, whole = self._pairs, self.follows, self.whole
        done = len(last)
        # Of the tokens that end at a byte, the longest comes first.
        for at, token in self._ends.iter(data.decode("latin-1"), max(0, done - self.longest + 1)):
            if at < done:
                continue
            if at > done:
                break
            start = at + 1 - len(token)
            if whole(token):
                before = last[start - 1] if start else None
                found = start == 0 or pairs.get((before, token))
                if follows(before, token) if found is None else found:
                    last.append(token)
                    done += 1
        if done < len(data):
            raise ValueError(f"byte {data[done]} has no token")
        return last

    def append(self, data: bytes, last: list[bytes], more: bytes) -> tuple[bytes, list[bytes]]:
        """``data + more`` and its table; only the new prefixes are computed."""
        data += more
        return data, self.extend(data, last)

    def edit(self, data: bytes, last: list[bytes], start: int, end: int, by: bytes) -> tuple[bytes, list[bytes]]:
        """``data`` with [start, end) replaced and its table; prefixes before ``start`` stay."""
        data = data[:start] + by + data[end:]
        return data, self.extend(data, last[:start])

    def tokens(self, last: list[bytes]) -> list[int]:
        """Ids of the whole, read backwards from the last prefix."""
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(self.ranks[token])
            end -= len(token)
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token, as public tokenizers have it."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(self.extend(piece, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


class KnownPieces(dict):
    """Ids as text and decoded bytes of each piece; a piece that is missing is encoded."""

    def __init__(self, encoder: PrefixEncoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        ids = self.encoder.encode(piece.encode())
        found = (",".join(map(str, ids)), self.encoder.decode(ids))
        if len(self) >= KEPT_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` (all columns) with n_tokens, ids_sha256 and decoded_sha256 of the whole text.

    ``pattern`` cuts a text into pieces, each encoded by itself; there are no special tokens. ids_sha256 is over the decimal ids joined by
    commas, decoded_sha256 over the bytes that the ids decode to. The ranks are broadcast; the vocabulary
    bounds their size. Null and empty texts have no ids; repeated rows are encoded alike; an empty table gives an
    empty result; columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    # A broadcast value lives as long as the worker's process: it also keeps the known pieces for later tasks.
    shared = spark.sparkContext.broadcast({"ranks": read_ranks(ranks_path)})
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    rows = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces = regex.compile(pattern)
        known = shared.value.get("known")
        if known is None:
            known = shared.value["known"] = KnownPieces(PrefixEncoder(shared.value["ranks"]))

        for batch in batches:
            counts, id_hashes, text_hashes = [], [], []
            for text in batch.column("text").to_pylist():
                found = pieces.findall(text or "")
                ids, decoded = zip(*map(known.__getitem__, found), strict=True) if found else ((), ())
                listed = ",".join(ids)
                counts.append(listed.count(",") + 1 if ids else 0)
                id_hashes.append(hashlib.sha256(listed.encode()).hexdigest())
                text_hashes.append(hashlib.sha256(b"".join(decoded)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())],
                names=[*batch.schema.names, *new],
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema)


def encoded_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, the ids of the text as an array, and ``text`` decoded from them."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoder, pieces = PrefixEncoder(ranks.value), regex.compile(pattern)
        for batch in batches:
            ids = [[i for p in pieces.findall(t or "") for i in encoder.encode(p.encode())] for t in batch.column("text").to_pylist()]
            texts = [encoder.decode(x).decode() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")

"""Per-file work on source text: masking, functions, tokens, clones.

Reading code needs a small automaton per file, so these operators map pandas
batches; everything across files (matching, merging, scoring) is Spark's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions.regex import java
from tidemark.session import written

# A comment, a string literal (one token each), a word, or a single sign.
_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<text>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)"
    r"|(?P<word>\w+)|(?P<sign>[^\w\s])",
    re.DOTALL,
)
_IMPORT = re.compile(r"^[ \t]*(?:import\b[^;'\"]*|export\b[^;'\"=({]*(?:\{[^}]*\})?[^;'\"=({]*\bfrom\s*)(['\"])[^'\"\n]*\1[ \t]*;?", re.MULTILINE)
_FUNCTION_STARTS = tuple(
    re.compile(p, re.ASCII)
    for p in (
        # fixed values: what begins a function
        r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)",
        r"^(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\(",
        r"^(?:private|public|protected)?\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*(?::\s*\w[^{]*)?\{",
        r"^(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{",
    )
)
_NOT_FUNCTIONS = {"if", "for", "while", "switch", "catch", "with", "return", "await", "typeof", "new", "super"}
_LITERAL = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`")
_BRANCH = re.compile(r"\b(?:if|else if|else|switch|for|while|do|catch)\b|&&|\|\|")
_TERNARY = re.compile(r"\?.*:")
MAX_FUNCTION_LINES = 60
MAX_COMPLEXITY = 15


def blank(text: str) -> str:
    """Spaces for everything but line breaks."""
    return re.sub(r"[^\n]", " ", text)


def blank_imports(source: str) -> str:
    return _IMPORT.sub(lambda m: blank(m.group(0)), source)


def tokenise(source: str) -> list[tuple[str, int]]:
    """(token, line) pairs without comments; a literal is one token."""
    out = []
    line, seen = 1, 0
    for found in _TOKEN.finditer(source):
        line += source.count("\n", seen, found.start())
        seen = found.start()
        if found.lastgroup != "comment":
            out.append((found.group(0), line))
    return out


def mask(source: str, comments: bool = True, strings: bool = True) -> str:
    """Blank comments and/or literals, keeping every position and line."""

    def replace(found: re.Match) -> str:
        if found.lastgroup == "comment" and comments:
            return blank(found.group(0))
        if found.lastgroup == "text" and strings:
            return blank(found.group(0))
        return found.group(0)

    return _TOKEN.sub(replace, source)


def mask_text(files: DataFrame, comments: bool = True, strings: bool = True) -> DataFrame:
    """Files with comments and/or string literals blanked."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask(t, comments, strings), na_action="ignore")

    return files.withColumn("content", masked("content"))


def mask_html(files: DataFrame) -> DataFrame:
    """HTML with the bodies of scripts and styles removed and comments and drawings blanked."""
    content = F.col("content")
    for tag in ("script", "style"):
        content = F.regexp_replace(content, rf"(?is)<{tag}\b([^>]*)>.*?</{tag}>", f"<{tag}$1></{tag}>")
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<svg\b.*?</svg>"):
        # Only the line breaks of a blanked piece matter to line numbers.
        pieces = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
        content = F.aggregate(
            F.array_distinct(pieces),
            content,
            lambda text, piece: F.replace(text, piece, F.regexp_replace(piece, r"[^\n]", " ")),
        )
    return files.withColumn("content", content)


def _starts(line: str) -> str | None:
    """Name of the function a line begins, if any."""
    found = next((m for m in (p.match(line) for p in _FUNCTION_STARTS) if m), None)
    return found.group(1) if found and found.group(1) not in _NOT_FUNCTIONS else None


def functions_of(source: str) -> list[tuple[str, int, int, int]]:
    """(name, start line, lines, complexity) of the functions found.

    Works on arrays over the lines of the file: ``level`` is the running brace depth
    after each line. A function ends on the first later line whose level is back to
    what it was before the function began.
    """
    lines = source.split("\n")
    stripped = [line.strip() for line in lines]
    plain = [_LITERAL.sub("", re.sub(r"//.*$", "", line)) for line in lines]
    level = np.cumsum([p.count("{") - p.count("}") for p in plain])
    points = np.cumsum([bool(_BRANCH.search(s)) + (bool(_TERNARY.search(s)) and not s.startswith("//")) for s in stripped])
    out: list[tuple[str, int, int, int]] = []
    free_from = 0  # nested functions belong to the one around them
    for start, line in enumerate(stripped):
        name = _starts(line) if start >= free_from else None
        if name is None:
            continue
        base, scored = (level[start - 1], points[start - 1]) if start else (0, 0)
        back = np.flatnonzero(level[start + 1 :] <= base)
        if not len(back):
            break  # never closed: nothing after it can be told apart
        end = start + 1 + int(back[0])
        out.append((name, start + 1, end - start + 1, int(points[end] - scored)))
        free_from = end + 1
    return out


def functions(files: DataFrame) -> DataFrame:
    """Every function with its length and cognitive complexity."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files_ in batches:
            rows = [
                (p, f, *fn)
                for p, f, text in zip(files_["project"], files_["path"], files_["content"])
                for fn in functions_of(text or "")
            ]
            yield pd.DataFrame(rows, columns=["project", "path", "name", "line_no", "lines", "complexity"])

    schema = "project string, path string, name string, line_no int, lines int, complexity int"
    return files.select("project", "path", "content").mapInPandas(per_batch, schema)


def complexity_findings(functions_: DataFrame) -> DataFrame:
    """Long and complex functions; the subject is the function, not its size."""
    limits = F.array_compact(
        F.array(
            F.when(
                F.col("lines") > MAX_FUNCTION_LINES,
                F.struct(F.lit("long-function").alias("rule"), F.concat("name", F.lit(": "), "lines", F.lit(f" lines (max {MAX_FUNCTION_LINES})")).alias("message")),
            ),
            F.when(
                F.col("complexity") > MAX_COMPLEXITY,
                F.struct(F.lit("high-complexity").alias("rule"), F.concat("name", F.lit(": complexity "), "complexity", F.lit(f" (max {MAX_COMPLEXITY})")).alias("message")),
            ),
        )
    )
    return functions_.select("project", "path", "line_no", "name", F.explode(limits).alias("_f")).select(
        "project", "path", "line_no", F.lit("complexity").alias("check"), "_f.rule", F.lit("warning").alias("severity"),
        "_f.message", F.concat_ws("#", "path", "name").alias("subject"), F.lit(0).alias("seq"),
    )


_MULTIPLIERS = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)),
    (np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)),
)


def _window_hashes(codes: np.ndarray, width: int, multipliers: tuple) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` codes (doubling, so log2(width) passes)."""
    left_by, right_by = multipliers

    def join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        x = (a ^ (a >> np.uint64(29))) * left_by + b * right_by + np.uint64(salt)
        return x ^ (x >> np.uint64(32))

    total, covered, power, size, left = None, 0, codes, 1, width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if total is None:
                    total, covered = power, size
                else:
                    n = len(codes) - covered - size + 1
                    total = join(total[:n], power[covered : covered + n], covered + size)
                    covered += size
            left >>= 1
            if left:
                n = len(codes) - 2 * size + 1
                power = join(power[:n], power[size : size + n], 2 * size)
                size *= 2
    return total[: len(codes) - width + 1]


# Of _TOKEN only what may hold white space or words: comments and literals. Over bytes, where every one begins and ends at the same character as over text.
_SPAN = re.compile(
    rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"?|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?|`[^`\\]*(?:\\.[^`\\]*)*`?",
    re.DOTALL,
)
_SPACE, _WORD, _SIGN, _MORE, _UNKNOWN = range(5)
# Bytes of text that are scanned at a time, and of a token whose code is made eight bytes at a time.
CHUNK, LONG = 1 << 20, 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers mixed one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """The kinds of the characters met so far: space, part of a word, or a sign; with them texts are cut into tokens, many at a time."""

    def __init__(self) -> None:
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self.ascii = bytes(self._kind(np.arange(128)).tolist()) + bytes(128)

    def _kind(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds == _UNKNOWN).any():
            for point in np.unique(points[kinds == _UNKNOWN]).tolist():
                sign = chr(point)
                self.kinds[point] = _WORD if re.match(r"\w", sign) else _SPACE if re.match(r"\s", sign) else _SIGN
            kinds = self.kinds[points]
        return kinds

    def _bytes_kinds(self, joined: bytes, data: np.ndarray) -> np.ndarray:
        """The kind of every byte; a sign of several bytes has its kind at the first."""
        kinds = np.frombuffer(bytearray(joined).translate(self.ascii), np.uint8)
        leads = np.flatnonzero(data >= 0xC0)
        if len(leads):
            for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
                at = leads[(data[leads] >= low) & (data[leads] < high)]
                if len(at):
                    points = data[at].astype(np.int32) & bits
                    for k in range(1, size):
                        points = points << 6 | data[at + k] & 0x3F
                    kind = self._kind(np.minimum(points, 0x10FFFF))
                    kinds[at] = kind
                    kind = np.where(kind == _SIGN, np.uint8(_MORE), kind)
                    for k in range(1, size):
                        kinds[at + k] = kind
        return kinds

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """64-bit code and line of every token of UTF-8 texts that :func:`tokenise` finds outside of imports, and where each text's tokens begin (and end)."""
        texts = [blank_imports(t.decode()).encode() if b"import" in t or b"export" in t else t for t in texts]
        joined = b"\n".join([*texts, bytes(8)])
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        begins = np.concatenate(([0], ends[:-1]))
        kinds = self._bytes_kinds(joined, data)
        kinds[len(joined) - 8 :] = _SPACE
        for i, text in enumerate(texts):
            if any(sign in text for sign in (b'"', b"'", b"`", b"//", b"/*")):
                for found in _SPAN.finditer(joined, begins[i], ends[i] - 1):
                    start, end = found.span()
                    comment = joined[start] == ord("/")
                    kinds[start:end] = _SPACE if comment else _MORE
                    if not comment:
                        kinds[start] = _SIGN
        word = kinds == _WORD
        more = kinds == _MORE
        more[1:] |= word[1:] & word[:-1]
        starts = np.flatnonzero((word | (kinds == _SIGN)) & ~more)
        inside = kinds != _SPACE
        stops = np.flatnonzero(inside[:-1] & ~more[1:]) + 1
        breaks = np.flatnonzero(data == ord("\n"))
        lines = np.repeat(np.arange(1, len(breaks) + 2, dtype=np.int32), np.diff(np.searchsorted(starts, breaks), prepend=0, append=len(starts)))
        bounds = np.searchsorted(starts, np.concatenate((begins, [len(joined)])))
        lines -= np.repeat(np.searchsorted(breaks, begins).astype(np.int32), np.diff(bounds))
        return self._codes(joined, starts, stops - starts), lines, bounds

    def _codes(self, joined: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
        masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        with np.errstate(over="ignore"):
            codes = _mixed((eight[starts] & masks[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            at, done = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
            while len(at):
                codes[at] = _mixed(codes[at] * np.uint64(0xD6E8FEB86659FD93) + (eight[starts[at] + done] & masks[np.minimum(sizes[at] - done, 8)]))
                done += 8
                at = at[sizes[at] > done]
        for i in np.flatnonzero(sizes > LONG).tolist():
            codes[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
        return codes

    def token_arrays(self, source: str) -> tuple[np.ndarray, np.ndarray]:
        """Code and line of every token of one text."""
        return self.tokens([source.encode("utf-8", "surrogatepass")])[:2]


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of a batch with about ``CHUNK`` bytes of text, and their texts."""
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    cut = np.cumsum([len(t) for t in texts]) // CHUNK
    edges = [0, *(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), len(texts)]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end > start:
            yield batch.slice(start, end - start), texts[start:end]


def _whole(bounds: np.ndarray, width: int) -> np.ndarray:
    """Of the windows over texts joined together, whether each lies in one text."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    count = max(len(last) - width + 1, 0)
    return np.arange(count) + width <= last[:count]


# Bits of an anchor; the texts' bytes for which a bucket of anchors is made.
ANCHOR_BITS = 47
ANCHORED = 1 << 26


def _anchors(codes: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """The anchor of every window, and how many windows in a row one place of an anchor has at most.

    An anchor is the least hash of the runs of half the width in a window, taken together with the window's owner.
    Equal windows have the same anchor, and windows side by side mostly share theirs.
    """
    half = (width + 1) // 2
    least, size, most = _window_hashes(codes, half, _MULTIPLIERS[0]), 1, width - half + 1
    with np.errstate(over="ignore"):
        least = _mixed(least)
        while 2 * size <= most:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < most:
            least = np.minimum(least[: len(least) - (most - size)], least[most - size :])
        return _mixed(least ^ owners[: len(least)]) >> np.uint64(64 - ANCHOR_BITS), most


def _anchor_buckets(files: DataFrame, width: int, buckets: int) -> DataFrame:
    """The distinct anchors of each ``text`` of an ``owner``, dealt to ``buckets``, packed as a row per batch and bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for batch in batches:
            texts, anchors = [], []
            for part, contents in _chunks(batch, "content"):
                codes, _, bounds = known.tokens(contents)
                if len(codes) < width:
                    continue
                file = np.repeat(np.arange(len(contents)), np.diff(bounds))
                found, most = _anchors(codes, part.column("owner").to_numpy().view(np.uint64)[file], width)
                at = np.flatnonzero(_whole(bounds, width))
                file, found = file[at], found[at]
                starts = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (file[1:] != file[:-1])))[: len(found)])
                long = np.diff(starts, append=len(found)) > most
                text, found = part.column("text").to_numpy().view(np.uint64)[file[starts]], found[starts]
                file = file[starts]
                order = np.lexsort((found, file))
                text, found, long, file = text[order], found[order], long[order], file[order]
                # The last bit tells that the text itself has the anchor in several places.
                first = np.concatenate(([True], (found[1:] != found[:-1]) | (file[1:] != file[:-1])))[: len(found)]
                several = np.bincount(np.cumsum(first) - 1, 1 + long, minlength=0) > 1
                texts.append(text[first])
                anchors.append(found[first] << np.uint64(1) | several.astype(np.uint64))
            if not texts:
                continue
            text, anchor = np.concatenate(texts), np.concatenate(anchors)
            bucket = ((anchor >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((anchor, text, bucket))
            text, anchor, bucket = text[order], anchor[order], bucket[order]
            new = np.concatenate(([True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])))[: len(text)]
            text, anchor, bucket = text[new], anchor[new], bucket[new]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.unique(bucket).tolist():
                part = slice(ends[b], ends[b + 1])
                planes = [x[part].view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes() for x, k in ((text, 8), (anchor, 6))]
                yield pa.RecordBatch.from_pydict({"bucket": [b], "texts": planes[:1], "anchors": planes[1:]}, schema)

    schema = pa.schema([("bucket", pa.int32()), ("texts", pa.binary()), ("anchors", pa.binary())])
    return files.select("content", "text", "owner").mapInArrow(deal, "bucket int, texts binary, anchors binary")


def _repeated(table: pa.Table) -> pa.Table:
    """The anchors of a bucket that several texts have, or one text in several places, each with these texts."""
    columns = []
    for name, size in (("texts", 8), ("anchors", 6)):
        parts = [np.frombuffer(x, np.uint8).reshape(size, -1) for x in table.column(name).to_pylist()]
        wide = np.zeros((sum(p.shape[1] for p in parts), 8), np.uint8)
        wide[:, :size] = np.concatenate(parts, axis=1).T
        columns.append(wide.view(np.uint64).ravel())
    text, anchor = columns
    several, anchor = (anchor & np.uint64(1)).astype(bool), anchor >> np.uint64(1)
    order = np.lexsort((text, anchor))
    text, anchor, several = text[order], anchor[order], several[order]
    first = np.ones(len(text), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    other = np.ones(len(text), bool)
    other[1:] = first[1:] | (text[1:] != text[:-1])
    group = np.cumsum(first) - 1
    kept = (np.bincount(group, other) > 1) | (np.bincount(group, several) > 0)
    at = np.flatnonzero(kept[group] & other)
    return pa.table({"text": text[at].view(np.int64), "anchor": anchor[at].view(np.int64)})


def token_table(files: DataFrame, width: int) -> DataFrame:
    """Each file of ``width`` tokens or more with a 64-bit ``code`` and the ``line`` of every token.

    Where files have a list of ``anchors``, ``kept`` has a byte for each window, 1 where its anchor is in the list; without a list all windows are kept.
    Of ``copied`` files the ``digest`` is that of the lines from the first to the last token.
    """
    narrowed = "anchors" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for batch in batches:
            for part, contents in _chunks(batch, "content"):
                codes, lines, bounds = known.tokens(contents)
                sizes = np.diff(bounds)
                rows = np.flatnonzero(sizes >= width)
                of_kept = np.repeat(sizes >= width, sizes)
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes[rows]))).astype(np.int32))
                columns = [part.column(c).take(pa.array(rows)) for c in ("project", "path", "content")]
                columns += [pa.ListArray.from_arrays(ends, pa.array(x[of_kept], kind)) for x, kind in ((codes.view(np.int64), pa.int64()), (lines, pa.int32()))]
                if narrowed:
                    kept = np.ones(max(len(codes) - width + 1, 0), np.uint8)
                    if len(kept):
                        listed = part.column("anchors")
                        every = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                        owners = np.repeat(part.column("owner").to_numpy().view(np.uint64), sizes)
                        unlisted = np.repeat(listed.is_null().to_numpy(zero_copy_only=False) & ~part.column("copied").to_numpy(zero_copy_only=False), sizes)
                        kept = (np.isin(_anchors(codes, owners, width)[0], every) | unlisted[: len(kept)]).astype(np.uint8)
                    masks = [kept[bounds[i] : bounds[i + 1] - width + 1].tobytes() for i in rows]
                    copied = part.column("copied").take(pa.array(rows))
                    digests = [_snippet_digest(contents[i].split(b"\n")[lines[bounds[i]] - 1 : lines[bounds[i + 1] - 1]]) if c else None for i, c in zip(rows.tolist(), copied.to_pylist(), strict=True)]
                    columns += [pa.array(masks, pa.binary()), copied, pa.array(digests, pa.string()), pa.array([m.count(1) for m in masks], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["project", "path", "content", "code", "line"] + ["kept", "copied", "digest", "windows"] * narrowed
    schema = "project string, path string, content string, code array<bigint>, line array<int>"
    asked = ["project", "path", "content"] + ["anchors", "copied", "owner"] * narrowed
    return files.select(*asked).mapInArrow(run, schema + ", kept binary, copied boolean, digest string, windows bigint" * narrowed)


# Windows that one task sorts at a time.
BUCKET = 1 << 21
_WINDOW = np.dtype([("hash", "<u8"), ("tag", "<u2"), ("file", "<u4"), ("pos", "<u4")])


def _window_buckets(tokens: DataFrame, width: int, buckets: int) -> DataFrame:
    """The windows of all files (the ``kept`` ones, if there is such a column) dealt to ``buckets`` by their hash, a row per batch of files and bucket.

    A row has the files whose windows it holds, whether each is ``copied``, and for each window 80 bits of hash, its place among these files and its position.
    """
    narrowed = "kept" in tokens.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column("code").offsets.to_numpy().astype(np.int64)
            codes = batch.column("code").values.to_numpy().view(np.uint64)[bounds[0] : bounds[-1]]
            bounds -= bounds[0]
            if len(codes) < width:
                continue
            at = np.flatnonzero(_whole(bounds, width))
            if narrowed:
                at = at[np.frombuffer(b"".join(batch.column("kept").to_pylist()), np.uint8) > 0]
            file = np.repeat(np.arange(batch.num_rows, dtype=np.uint32), np.diff(bounds))[at]
            rows = np.empty(len(at), _WINDOW)
            rows["hash"] = _window_hashes(codes, width, _MULTIPLIERS[0])[at]
            rows["tag"] = _window_hashes(codes, width, _MULTIPLIERS[1])[at] >> np.uint64(48)
            rows["file"], rows["pos"] = file, at - bounds[file]
            copied = batch.column("copied") if narrowed else pa.array([False] * batch.num_rows)
            bucket = ((rows["hash"] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
            rows = rows[np.argsort(bucket, kind="stable")]
            ends = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
            for b in range(buckets):
                part = rows[ends[b] : ends[b + 1]].copy()
                if len(part):
                    used, part["file"] = np.unique(part["file"], return_inverse=True)
                    names = [batch.column(c).take(pa.array(used)).to_pylist() for c in ("project", "path")]
                    part["file"] = np.diff(part["file"], prepend=np.uint32(0))
                    # Byte by byte, as the upper bytes of files and positions are nearly all zero and compress.
                    packed = part.view(np.uint8).reshape(-1, _WINDOW.itemsize).T.tobytes()
                    yield pa.RecordBatch.from_pydict({"bucket": [b], "projects": [names[0]], "paths": [names[1]], "copied": [copied.take(pa.array(used)).to_pylist()], "windows": [packed]}, schema)

    text = pa.list_(pa.string())
    schema = pa.schema([("bucket", pa.int32()), ("projects", text), ("paths", text), ("copied", pa.list_(pa.bool_())), ("windows", pa.binary())])
    asked = ["project", "path", "code"] + ["kept", "copied"] * narrowed
    return tokens.select(*asked).mapInArrow(deal, "bucket int, projects array<string>, paths array<string>, copied array<boolean>, windows binary")


def _links(table: pa.Table, width: int) -> pa.Table:
    """Links between the windows of a bucket and the first place of each, as distinct diagonals of two files.

    A copied file that is itself the first place of a window has the diagonal 0 with itself.
    """
    names, chunks, copied = {}, [], {}
    for projects, paths, flags, packed in zip(*(table.column(c).to_pylist() for c in ("projects", "paths", "copied", "windows")), strict=True):
        local = np.array([names.setdefault(n, len(names)) for n in zip(projects, paths, strict=True)], np.uint32)
        copied |= zip(local.tolist(), flags, strict=True)
        rows = np.frombuffer(packed, np.uint8).reshape(_WINDOW.itemsize, -1).T.copy().view(_WINDOW).ravel()
        rows["file"] = local[np.cumsum(rows["file"])]
        chunks.append(rows)
    rows = np.concatenate(chunks)
    # Files in the order of project and path as bytes, as Spark orders strings.
    order = sorted(names, key=lambda n: (n[0].encode(), n[1].encode()))
    rank = np.empty(len(order), np.uint32)
    rank[[names[n] for n in order]] = np.arange(len(order))
    project = np.cumsum([i > 0 and order[i][0] != order[i - 1][0] for i in range(len(order))])
    own = np.array([copied[names[n]] for n in order], bool)
    file = rank[rows["file"]]
    place = file.astype(np.uint64) << np.uint64(32) | rows["pos"]
    kind = project[file].astype(np.uint64) << np.uint64(16) | rows["tag"]
    with np.errstate(over="ignore"):
        key = rows["hash"] ^ _mixed(kind + np.uint64(1))
    by = np.argsort(key)
    new = np.diff(key[by], prepend=~key[by[:1]]) != 0
    if ((kind[by][1:] != kind[by][:-1]) & ~new[1:]).any():
        # Different windows under one key: in the order of all that tells them apart.
        by = np.lexsort((kind, rows["hash"]))
        new = (np.diff(rows["hash"][by], prepend=~rows["hash"][by[:1]]) != 0) | (np.diff(kind[by], prepend=~kind[by[:1]]) != 0)
    starts = np.flatnonzero(new)
    times = np.diff(starts, append=len(by))
    # Windows that occur once are most of them, and their own first places.
    alone = np.unique(file[by[starts[times == 1]]])
    by, times = by[np.repeat(times > 1, times)], times[times > 1]
    place = place[by]
    origin = np.repeat(np.minimum.reduceat(place, np.cumsum(times) - times) if len(times) else place, times)
    files = place >> np.uint64(32) << np.uint64(32) | origin >> np.uint64(32)
    shift = (place & np.uint64(0xFFFFFFFF)).astype(np.int64) - (origin & np.uint64(0xFFFFFFFF)).astype(np.int64)
    file = (place >> np.uint64(32)).astype(np.int64)
    linked = (place >> np.uint64(32) != origin >> np.uint64(32)) | (shift >= width) | ((shift == 0) & own[file])
    alone = alone[own[alone]].astype(np.uint64)
    files, shift = np.concatenate((files[linked], alone << np.uint64(32) | alone)), np.concatenate((shift[linked], np.zeros(len(alone), np.int64)))
    by = np.lexsort((shift, files))
    files, shift = files[by], shift[by]
    new = np.ones(len(by), bool)
    new[1:] = (files[1:] != files[:-1]) | (shift[1:] != shift[:-1])
    files, shift = files[new], shift[new]
    here, there = (files >> np.uint64(32)).astype(np.int64), (files & np.uint64(0xFFFFFFFF)).astype(np.int64)
    column = lambda at, part: pa.array([n[part] for n in order], pa.string()).take(pa.array(at))
    return pa.table({"project": column(here, 0), "path": column(here, 1), "origin_path": column(there, 1), "shift": pa.array(shift, pa.int32())})


# Places of parts on diagonals that are compared at a time; diagonals up to which each is compared as a whole.
RUN_CELLS = 1 << 20
FEW = 24


def maximal_runs(here: np.ndarray, there: np.ndarray, shifts: list[int], width: int) -> list[tuple[int, int, int]]:
    """First and last window and shift of every run of windows of ``width`` codes at p in ``here`` and p - shift in ``there`` that are equal, apart from those inside another run.

    Of runs over the same positions the least shift stays.
    """
    find = _runs_along if len(shifts) <= FEW else _runs_by_parts
    start, end, shift = find(here, there, shifts, width)
    long = end - start >= width
    start, stop, shift = start[long], end[long] - width, shift[long]
    order = np.lexsort((shift, -stop, start))
    start, stop, shift = start[order], stop[order], shift[order]
    kept = stop > np.concatenate(([-1], np.maximum.accumulate(stop)))[: len(stop)]
    return list(zip(start[kept].tolist(), stop[kept].tolist(), shift[kept].tolist(), strict=True))


def _runs_along(here: np.ndarray, there: np.ndarray, shifts: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and shift of the runs of equal codes, each diagonal compared from end to end."""
    starts, ends, of = [], [], []
    for shift in shifts:
        low, high = max(shift, 0), min(len(here), len(there) + shift)
        same = np.zeros(high - low + 2, bool)
        np.equal(here[low:high], there[low - shift : high - shift], out=same[1:-1])
        edges = np.flatnonzero(same[1:] != same[:-1]) + low
        starts.append(edges[::2])
        ends.append(edges[1::2])
        of.append(np.full(len(edges) // 2, shift))
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(of)


def _runs_by_parts(here: np.ndarray, there: np.ndarray, shifts: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and shift of the runs of equal codes of at least ``width`` (and some shorter ones), many diagonals at a time.

    A run has an equal part of half the width that begins at a multiple of ``step``, and parts side by side are of one run; only what
    lies before its first and behind its last part is compared code by code.
    """
    half = (width + 1) // 2
    step = min(half, width - half + 1)
    here_at, there_at = (_window_hashes(x.view(np.uint64), half, _MULTIPLIERS[0]) for x in (here, there))
    parts = np.arange(0, len(here_at), step)
    runs, many = [], max(1, RUN_CELLS // len(parts))
    for k in range(0, len(shifts), many):
        shift = np.array(shifts[k : k + many], np.int64)
        other = parts - shift[:, None]
        equal = np.zeros((len(shift), len(parts) + 2), bool)
        equal[:, 1:-1] = (here_at[parts] == there_at[np.clip(other, 0, len(there_at) - 1)]) & (other >= 0) & (other < len(there_at))
        row, first = np.nonzero(equal[:, 1:] & ~equal[:, :-1])
        last = np.nonzero(equal[:, :-1] & ~equal[:, 1:])[1] - 1
        shift, start, end = shift[row], parts[first], parts[last] + half
        for back in (True, False):
            at = (start[:, None] - 1 - np.arange(step)) if back else (end[:, None] + np.arange(step))
            other = at - shift[:, None]
            same = (here[np.clip(at, 0, len(here) - 1)] == there[np.clip(other, 0, len(there) - 1)]) & (at >= 0) & (at < len(here)) & (other >= 0) & (other < len(there))
            more = np.where(same.all(axis=1), step, np.argmin(same, axis=1))
            start, end = (start - more, end) if back else (start, end + more)
        runs.append((start, end, shift))
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def _snippet_digest(lines: list[bytes]) -> str:
    """Twelve hex digits of the SHA-1 of lines with their white space made single blanks."""
    return hashlib.sha1(b" ".join(b"\n".join(lines).split())).hexdigest()[:12]


def clones(files: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Duplicated token runs of at least ``min_tokens``, one row per maximal clone of two files (or of a file with itself).

    Every window is linked to the first place its tokens occur in the project, not to every other copy, so n copies of a block give n - 1
    clones instead of n². A link names a diagonal: a file, its origin, and how far the positions are apart. On each such diagonal the two files are
    then compared from end to end, so that a clone is as long as the texts agree, also where some of its windows
    occurred in a third file before. Runs inside another run of the same two files are left out. A window that overlaps its own
    origin is repetition inside a run of equal tokens and is not linked.

    Most windows occur once. Equal windows have equal anchors, one of which stands for about thirteen windows side by side, so first only anchors are shuffled;
    windows are made where an anchor occurs in several texts of a project, or in several places of one. They are packed, a row for each batch of files and bucket of
    hashes, so a window takes 18 bytes before compression; a task sorts the windows of a bucket. Files with the same text as another one of their project are left to the first
    of them: no first place lies in the others, and they have the clones of the first with other files, besides one over the whole text
    where some window occurs in the first file first. Paths that come in several rows are not taken together so.
    A pair of files is a row with the arrays of both: a task holds one pair at a time,
    and n near copies of one origin are n rows. ``digest`` is that of the clone's whole lines with white space made single blanks.
    """
    owned = files.select("project", "path", "content").dropna().withColumn("_md5", F.unhex(F.md5(F.encode("content", "UTF-8"))))
    names = owned.groupBy("project", "path").agg(F.count(F.lit(1)).alias("rows"), F.min("_md5").alias("md5"), F.sum(F.octet_length("content")).alias("size"))
    names = written(names, "clone-names")
    cores = files.sparkSession.sparkContext.defaultParallelism
    buckets = max(cores, -(-(names.agg(F.sum("size")).first()[0] or 0) // ANCHORED))
    keyed = owned.select("content", F.xxhash64("project", "_md5").alias("text"), F.xxhash64("project").alias("owner"))
    repeated = _anchor_buckets(keyed, min_tokens, buckets).groupBy("bucket").applyInArrow(_repeated, "text bigint, anchor bigint")
    repeated = repeated.groupBy("text").agg(F.collect_list("anchor").alias("anchors"))
    alone = names.where("rows = 1")
    firsts = alone.groupBy("project", "md5").agg(F.min("path").alias("path"), (F.count(F.lit(1)) > 1).alias("copied"))
    chosen = (
        firsts.withColumn("text", F.xxhash64("project", "md5")).join(repeated, "text", "left").where(F.col("copied") | F.col("anchors").isNotNull())
        .select("project", "path", "copied", "anchors")
        .unionByName(names.where("rows > 1").select("project", "path", F.lit(False).alias("copied")), allowMissingColumns=True)
    )
    # Written, so that Spark knows its size and sends it to the files where it is small.
    chosen = written(chosen, "clone-files")
    tokens = written(token_table(owned.join(chosen, ["project", "path"]).withColumn("owner", F.xxhash64("project")), min_tokens), "clone-tokens")
    windows = tokens.agg(F.sum("windows")).first()[0] or 0
    dealt = _window_buckets(tokens, min_tokens, max(cores, -(-windows // BUCKET)))
    links = dealt.groupBy("bucket").applyInArrow(lambda table: _links(table, min_tokens), "project string, path string, origin_path string, shift int")
    pairs = links.groupBy("project", "path", "origin_path").agg(F.collect_set("shift").alias("shifts"))
    pairs = written(pairs, "clone-pairs")
    found = written(_compared(tokens, pairs, min_tokens), "clone-runs")
    first_there = pairs.where((F.col("path") == F.col("origin_path")) & F.array_contains("shifts", 0)).select("project", "path", F.lit(True).alias("_first"))
    whole = (
        tokens.where("copied").join(first_there, ["project", "path"], "left").where(F.col("_first") | (F.col("windows") <= F.size("code") - min_tokens))
        .select(
            "project", "path", F.col("path").alias("origin_path"), "digest", F.get("line", F.lit(0)).alias("start_line"), F.get("line", F.size("line") - 1).alias("end_line"),
            F.get("line", F.lit(0)).alias("origin_line"), F.size("code").alias("tokens"),
        )
        .withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
    )
    copies = alone.join(firsts.where("copied").withColumnRenamed("path", "first_path"), ["project", "md5"]).where(F.col("path") != F.col("first_path"))
    theirs = found.where(F.col("path") != F.col("origin_path")).unionByName(whole).withColumnRenamed("path", "first_path")
    return found.unionByName(theirs.join(copies.select("project", "first_path", "path"), ["project", "first_path"]).select(found.columns))


def _compared(tokens: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The maximal runs of each pair of files along its diagonals."""
    of_others = pairs.withColumn("shifts", F.when(F.col("path") == F.col("origin_path"), F.array_remove("shifts", 0)).otherwise(F.col("shifts"))).where(F.size("shifts") > 0)
    origins = tokens.select("project", F.col("path").alias("origin_path"), *[F.col(c).alias(f"origin_{c}") for c in ("code", "line")])
    both = of_others.join(origins, ["project", "origin_path"]).join(tokens, ["project", "path"])
    columns = ["project", "path", "origin_path", "content", "shifts", "code", "line", "origin_code", "origin_line"]
    names = ["project", "path", "origin_path", "digest", "start_line", "end_line", "origin_line", "tokens", "lines"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                project, path, origin_path, content = (batch.column(k)[i].as_py() for k in range(4))
                shifts, codes, lines, origin_codes, origin_lines = (batch.column(k)[i].values.to_numpy() for k in range(4, 9))
                text, digests = content.encode().split(b"\n"), {}
                for start, stop, shift in maximal_runs(codes, origin_codes, shifts.tolist(), width):
                    begin, end = int(lines[start]), int(lines[stop + width - 1])
                    if (begin, end) not in digests:
                        digests[begin, end] = _snippet_digest(text[begin - 1 : end])
                    rows.append((project, path, origin_path, digests[begin, end], begin, end, int(origin_lines[start - shift]), stop - start + width, end - begin + 1))
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)), schema)

    text, number = pa.string(), pa.int32()
    schema = pa.schema(list(zip(names, (text, text, text, text, number, number, number, number, number), strict=True)))
    return both.select(*columns).mapInArrow(compare, "project string, path string, origin_path string, digest string, start_line int, end_line int, origin_line int, tokens int, lines int")


def clone_findings(clones_: DataFrame) -> DataFrame:
    """Findings whose subject is the sorted pair of paths and the digest of the copied tokens.

    The digest is that of the copied lines, so moved lines and other white space leave it alone.
    """
    pair = F.array_join(F.array_sort(F.array("path", "origin_path")), "|")
    return clones_.select(
        "project", "path", F.col("start_line").alias("line_no"),
        F.lit("duplication").alias("check"), F.lit("duplicate-code").alias("rule"), F.lit("warning").alias("severity"),
        F.concat(F.lit("Duplicate ("), F.col("lines").cast("string"), F.lit(" lines) of "), "origin_path").alias("message"),
        F.concat_ws("|", pair, "digest").alias("subject"),
        F.lit(0).alias("seq"),
    )


def duplication_scores(files: DataFrame, clones_: DataFrame) -> DataFrame:
    """100 minus the share of lines that lie in a clone, each line counted once.

    Our own definition: the matched engine's formula is not public.
    """
    total = files.groupBy("project").agg(F.sum(F.size(F.split("content", "\n"))).alias("lines"))
    # Of each clone the lines behind all that begin before it.
    before = Window.partitionBy("project", "path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end_line") - F.greatest(F.max("end_line").over(before), F.col("start_line") - 1))
    spans = clones_.select("project", "path", "start_line", "end_line").distinct()
    covered = spans.withColumn("fresh", fresh).groupBy("project").agg(F.sum("fresh").alias("copied"))
    both = total.join(covered, "project", "left").withColumn("copied", F.coalesce("copied", F.lit(0)))
    return both.withColumn("score", S.round_half_up(S.clamp(100 - F.col("copied") / F.col("lines") * 100)))


def duplicate_files(files: DataFrame) -> DataFrame:
    """Groups of files with the same text: size and first path."""
    return (
        files.groupBy(F.sha2("content", 256).alias("digest"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.concat_ws("/", "project", "path")).alias("first_path"))
        .where(F.col("copies") > 1)
    )


def duplicate_blocks(files: DataFrame, n: int = 6) -> DataFrame:
    """Blocks of ``n`` lines that occur more than once, with their first place."""
    lines = F.transform(F.split("content", "\n"), lambda l: F.trim(l))
    last = F.size("_l") - n + 1
    blocks = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.struct(i.alias("start"), F.sha1(F.array_join(F.slice("_l", i, n), "\n")).alias("digest"))
    )
    spread = (
        files.select("project", "path", lines.alias("_l")).where(last >= 1).select("project", "path", F.explode(blocks).alias("_b"))
        .select("project", "path", "_b.start", "_b.digest")
    )
    place = F.struct(F.concat_ws("/", "project", "path").alias("file"), "start")
    return (
        spread.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("_p"))
        .where(F.col("copies") > 1)
        .select("digest", "copies", F.col("_p.file").alias("first_file"), F.col("_p.start").cast("bigint").alias("first_line"))
    )


def extract_scripts(files: DataFrame) -> DataFrame:
    """Script bodies of single-file components joined by newlines; the raw text is kept."""
    bodies = F.filter(F.regexp_extract_all("content", F.lit(java(r"<script[^>]*>(.*?)</script>", "is")), F.lit(1)), lambda b: b != "")
    return files.withColumn("raw_content", F.col("content")).withColumn(
        "content", F.when(F.size(bodies) > 0, F.array_join(bodies, "\n")).otherwise(F.col("content"))
    )

"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Buckets of n-grams, and the longest n-gram.
BUCKETS, LONGEST = 1 << 15, 3
# Labelled documents the weights are learned from, at most (one per language at least). Document frequencies cover all.
FIT_ROWS = 4000
UNDETERMINED = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def letter_table() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for every other character."""
    table = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        if (c := chr(i)).isalpha():
            table[i] = ord(c.lower()[0])
    return table


class Grams:
    """Hashed counts of the n-grams of 1 to LONGEST letters, where all between two words is one blank."""

    def __init__(self) -> None:
        self.letters = letter_table()

    def folded(self, text: str) -> np.ndarray:
        """Lower-case letters and single blanks (0) between, before and behind words; no entry without a letter."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(code) and code.max() >= 1 << 16:
            found, at = np.unique(code, return_inverse=True)
            known = np.array([(ord(c.lower()[0]) if (c := chr(x)).isalpha() else 0) for x in found.tolist()], np.uint32)
            folded = known[at]
        else:
            folded = self.letters[code]
        if not folded.any():
            return folded[:0]
        folded = np.concatenate((np.zeros(1, np.uint32), folded, np.zeros(1, np.uint32)))
        return folded[np.append(True, (folded[1:] != 0) | (folded[:-1] != 0))]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the text's n-grams, ascending, and how often each occurs; none for a text without a letter."""
        folded = self.folded(text or "")
        hashed = []
        for n in range(1, LONGEST + 1):
            size = len(folded) - n + 1
            if size <= 0:
                break
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h = (h ^ folded[k : k + size]) * _MIX[k]
                h ^= h >> np.uint32(15)
            hashed.append((h & np.uint32(BUCKETS - 1))[folded[:size] != 0] if n == 1 else h & np.uint32(BUCKETS - 1))
        if not hashed:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        joined = np.concatenate(hashed)
        if len(joined) < BUCKETS // 8:
            return np.unique(joined.astype(np.int64), return_counts=True)
        n = np.bincount(joined, minlength=BUCKETS)
        at = np.flatnonzero(n)
        return at, n[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a text's buckets, of length 1: (1 + ln n) idf."""
    v = (1 + np.log(n)) * idf[at]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FollowTheLeader:
    """FTRL-proximal learner of a multinomial logistic regression; l1 and l2 make the elastic net.

    A weight is 0 until the sum of its gradients leaves [-l1, l1]. The last row holds the intercepts, which are not penalised.
    """

    def __init__(self, features: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = (at == len(self.z) - 1)[:, None]
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 0.0, self.l2)
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        gap = softmax(x @ w)
        gap[label] -= 1
        g = x[:, None] * gap
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The T between 1/50 and 50 that makes softmax(logits / T) most likely for the labels, by golden-section search on ln T.

    Each label stands for itself with n + 1 parts of n + 2 and for all others with one, so that a faultless sample doesn't claim certainty.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    wanted = np.full(logits.shape, 1 / (len(labels) + 2) / (logits.shape[1] - 1))
    wanted[np.arange(len(labels)), labels] = (len(labels) + 1) / (len(labels) + 2)
    loss = lambda t: -(wanted * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum()
    low, high, part = -np.log(50), np.log(50), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class LanguageModel:
    """``langs`` and, for buckets with a weight, its row in ``weights``; the last row holds the intercepts."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether the CRC-32 of doc_id as text (null: of no bytes) falls into the fold that is not learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many of them each bucket occurs. At most BUCKETS sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, docs = Grams(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[grams.counts(text)[0]] += 1
                docs += 1
        at = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total[at[:-1]], docs))], names=["bucket", "docs"])

    docs, out = 0, np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket bigint, docs bigint").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect():
        if row["bucket"] < 0:
            docs = row["docs"]
        else:
            out[row["bucket"]] = row["docs"]
    return docs, out


def fit_model(labelled: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = 4) -> LanguageModel:
    """A model of the ``lang`` of ``text``; rows where either is null, or the text has no letter, teach nothing.

    Document frequencies come from all rows. Weights are learned from about ``fit_rows`` rows at most: of each language the same number, chosen by a hash
    of doc_id and text, all where it has fewer. One task learns from their counts (at most BUCKETS each): four fifths teach the weights, one fifth the temperature. The driver holds the
    document frequencies and the weights that are not 0, at most BUCKETS for each language.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("draw"))
    docs, frequency = document_frequencies(rows)
    idf = np.log((1 + docs) / (1 + frequency)) + 1
    per_lang = stored(rows.groupBy(F.col("lang").alias("of_lang")).agg(F.count("*").alias("rows")), "langid-langs")
    each = max(1, fit_rows // max(1, per_lang.count()))
    # A hash is a uniform number: keeping those below each / rows leaves about ``each`` of every language.
    share = (F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))) * F.col("rows") < each
    drawn = rows.join(per_lang, F.col("lang") == F.col("of_lang")).where(share).select("lang", "text", "draw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [grams.counts(t) for t in batch.column("text").to_pylist()]
            at, n = ([f[k].astype(np.int32).tobytes() for f in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "draw", "at", "n"])

    def learn(sample: pa.Table) -> pa.Table:
        sample = sample.filter(pa.array([len(x) > 0 for x in sample.column("at").to_pylist()], pa.bool_())).sort_by([("draw", "ascending"), ("lang", "ascending"), ("at", "ascending")])
        langs = sorted(set(sample.column("lang").to_pylist()), key=str.encode)
        label = [langs.index(x) for x in sample.column("lang").to_pylist()]
        at = [np.frombuffer(x, np.int32) for x in sample.column("at").to_pylist()]
        x = [weighted(i, np.frombuffer(n, np.int32), idf) for i, n in zip(at, sample.column("n").to_pylist(), strict=True)]
        apart = np.arange(len(at)) % 5 == 4
        learner = FollowTheLeader(BUCKETS, len(langs))
        for _ in range(epochs):
            for i in np.flatnonzero(~apart):
                learner.learn(at[i], x[i], label[i])
        w = learner.weights(np.arange(BUCKETS + 1))
        logits = np.array([x[i] @ w[at[i]] + w[-1] for i in np.flatnonzero(apart)]).reshape(-1, len(langs))
        heat = temperature(logits, np.array(label)[apart])
        some = np.flatnonzero(w.any(axis=1))
        rows = [(int(i), w[i].tolist(), None, None) for i in some] + [(-1, None, langs, heat)]
        return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema(list(zip(names, kinds, strict=True))))

    names, kinds = ("bucket", "weights", "langs", "heat"), (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.float64())
    counts = drawn.mapInArrow(count, "lang string, draw bigint, at binary, n binary")
    learned = counts.groupBy().applyInArrow(learn, "bucket bigint, weights array<double>, langs array<string>, heat double").collect()
    head = next((r for r in learned if r["bucket"] == -1), None)
    langs = list(head["langs"]) if head else []
    weights = np.zeros((BUCKETS + 1, len(langs)))
    for row in learned:
        if row["bucket"] >= 0:
            weights[row["bucket"]] = row["weights"]
    return LanguageModel(langs, idf, weights, head["heat"] if head else 1.0)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (all columns) with lang_pred and score, the calibrated probability of it (0 to 1); only the text is looked at.

    Texts that are null or have no letter, and all texts where the model knows no language, are ``und`` with score 0. Whole texts count, a very
    long one costs about 40 bytes per character in its task. Repeated rows are judged alike, an empty table gives an empty result, columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf, model.weights, model.heat))
    rows = docs.drop("lang_pred", "score")
    # Columns go by number, since names may hold dots or backticks.
    plain, text_at = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]), rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        known, idf, weights, heat = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(text_at).to_pylist():
                at, n = grams.counts(text)
                if not len(at) or not known:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                p = softmax((weighted(at, n, idf) @ weights[at] + weights[-1]) / heat)
                best = int(p.argmax())
                langs.append(known[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields], "lang_pred string", "score double"])
    return plain.mapInArrow(run, schema).toDF(*rows.columns, "lang_pred", "score")

"""Continuous scans with Structured Streaming.

Each job has a batch twin among the operators; replaying the same rows, in any order and cut into any
micro-batches within the patience of the watermark, must give the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.catalog.rules import SECRETS, Pack
from tidemark.functions.redaction import redacted
from tidemark.operators.rules import scan_lines, to_lines


def continuous_scan(files: DataFrame, pack: Pack = SECRETS) -> DataFrame:
    """Findings of arriving files with their line redacted; stateless."""
    found = scan_lines(to_lines(files), pack)
    return found.withColumn("line", redacted(F.col("line")))


def _dealt(rows: DataFrame, ts: str, patience: str, span: str) -> DataFrame:
    """``rows`` with ``at``, the time in microseconds, and ``closes``, the millisecond at which the row's stretch of time ends.

    The watermark runs ``patience`` behind the newest row. The watched column itself goes: Spark would drop rows behind
    the watermark without a trace, here the processors see them and report them as late.
    """
    length = _micros(span)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    closes = ((F.floor(at / length) + 1) * (length // 1000)).cast("bigint")
    return rows.withColumn("_watched", F.col(ts).cast("timestamp")).withWatermark("_watched", patience).withColumn("at", at).withColumn("closes", closes).drop("_watched")


def _micros(length: str) -> int:
    return int(pd.Timedelta(length) / pd.Timedelta(microseconds=1))


LANES = 256
# Lanes of the stretches: rows of many keys are held together, so that calls and round trips to the state don't grow with the number of keys.
STRETCH_LANES = 1024


def _lane(count: int, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(count)).alias("lane")


def _in_order(rows) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


class _Stretch(StatefulProcessor):
    """Holds the rows of one lane of keys and stretch of time until the watermark passes its end, then hands them on key by key in order, all at once.

    A row that comes for a stretch already closed is late: it changes nothing and goes out as such. Memory and state of a
    lane are bounded by a stretch, and a busy key's stretches lie in different tasks. Rows begin with project and check.
    """

    held_schema = ""
    columns: tuple[str, ...] = ()

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"project {self.kind}, check string, {self.held_schema}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields = [tuple(row[c] for c in ("project", "check", *self.columns)) for row in rows]
        if key[-1] <= timerValues.getCurrentWatermarkInMs():
            yield from self._by_key(self.late, key, fields)
        else:
            if not self.held.exists():
                self.handle.registerTimer(key[-1])
            self.held.appendList(fields)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = [tuple(r) for r in self.held.get()]
        self.held.clear()
        yield from self._by_key(self.closed, key, rows)

    def _by_key(self, found, key, rows: list[tuple]) -> Iterator[Row]:
        for (project, check), own in groupby(_in_order(rows), lambda r: r[:2]):
            yield from found((project, check, key[-1]), [r[2:] for r in own])

    def late(self, key, rows: list[tuple]) -> list[Row]:
        raise NotImplementedError

    def closed(self, key, rows: list[tuple]) -> list[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


KEY = ("key_project", "key_check", "lane")


def _keyed(rows: list[tuple], closes: int) -> list[tuple]:
    """Rows with their stretch and the key under which the chain takes them; a row begins with kind, project and check."""
    return [(*r, closes, r[1], r[2], 0) if r[0] in EDGES else (*r, closes, None, None, 1 + zlib.crc32(f"{r[1]} {r[2]} {closes}".encode()) % LANES) for r in rows]


EDGES = ("edge", "first", "last")


class _Chain(StatefulProcessor):
    """Joins the stretches of a key: the edge of one is compared with what the one before ended with.

    Edges have lane 0 and their key; all edges that one advance of the watermark closes come in one micro-batch, and later ones only close later.
    All other rows have no key, are spread over LANES lanes and pass.
    """

    row: Row

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[-1]:
            for row in rows:
                yield self.row(*[row[c] for c in self.row])
        else:
            edges = sorted(rows, key=lambda r: r["closes"])
            yield from self.joined(key, [list(g) for _, g in groupby(edges, lambda r: r["closes"])])

    def joined(self, key, stretches: list[list[Row]]) -> list[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


SCORE_COLUMNS = ("kind", "project", "check", "at", "scan_id", "before", "after")
SCORE_ROW = "kind string, project {0}, check string, at bigint, scan_id bigint, before bigint, after bigint"


class ScoreStretch(_Stretch):
    held_schema = "at bigint, scan_id bigint, score bigint"
    columns = ("at", "scan_id", "score")

    def late(self, key, rows):
        return self._rows(key, [("late", *key[:2], at, scan_id, None, score) for at, scan_id, score in rows])

    def closed(self, key, rows):
        changes = [("change", *key[:2], at, scan_id, a, b) for (_, _, a), (at, scan_id, b) in zip(rows, rows[1:], strict=False) if a != b]
        # The edge carries the first scan, and in ``before`` the last score.
        return self._rows(key, [*changes, ("edge", *key[:2], rows[0][0], rows[0][1], rows[-1][2], rows[0][2])])

    def _rows(self, key, rows):
        out = Row(*SCORE_COLUMNS, "closes", *KEY)
        return [out(*r) for r in _keyed(rows, key[2])]


class ScoreChain(_Chain):
    row = Row(*SCORE_COLUMNS)

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "score bigint", self.ttl_ms)

    def joined(self, key, stretches):
        stored, out = self.last.get(), []
        known, last = stored is not None, None if stored is None else stored[0]
        for [edge] in stretches:
            if known and edge["after"] != last:
                out.append(self.row("change", edge["project"], edge["check"], edge["at"], edge["scan_id"], last, edge["after"]))
            known, last = True, edge["before"]
        self.last.update((last,))
        return out


def live_delta(scans: DataFrame, patience: str = "1 hour", span: str = "1 day", ttl_ms: int | None = None) -> DataFrame:
    """Every score change per (project, check) in the order of (scan_ts, scan_id), however the scans arrive.

    Scans are held until the watermark (``patience`` behind the newest scan) passes the end of their stretch of length ``span``. Result: kind (change, or
    late for a scan whose stretch was closed when it came; its score is in ``after``), project, check, scan_ts, scan_id, before, after, delta. What a
    stretch holds is emitted once and in order; a scan sent again counts as one of equal score. The last score of a key expires by ``ttl_ms``
    of processing time. Needs the RocksDB state store.
    """
    kept = scans.select("project", "check", "scan_ts", "scan_id", "score")
    kind = kept.schema["project"].dataType.simpleString()
    row = SCORE_ROW.format(kind)
    closed = _dealt(kept, "scan_ts", patience, span).select("*", _lane(STRETCH_LANES, "project", "check")).groupBy("lane", "closes").transformWithState(
        ScoreStretch(kind), outputStructType=f"{row}, closes bigint, key_project {kind}, key_check string, lane bigint", outputMode="append", timeMode="EventTime"
    )
    joined = closed.groupBy(*KEY).transformWithState(
        ScoreChain(ttl_ms), outputStructType=row, outputMode="append", timeMode="ProcessingTime" if ttl_ms else "None"
    )
    return joined.select(
        "kind", "project", "check", F.timestamp_micros("at").alias("scan_ts"), "scan_id", "before", "after", (F.col("after") - F.col("before")).alias("delta")
    )


FINDING_COLUMNS = ("kind", "project", "check", "at", "scan_id", "fingerprint", "copies")
FINDING_ROW = "kind string, project {0}, check string, at bigint, scan_id bigint, fingerprint string, copies bigint"


def _gaps(before: dict, now: dict) -> list[tuple]:
    """kind, fingerprint and copies of what differs between two snapshots."""
    gaps = [(f, now.get(f, 0) - before.get(f, 0)) for f in sorted(now.keys() | before.keys())]
    return [("introduced" if n > 0 else "fixed", f, abs(n)) for f, n in gaps if n]


class FindingStretch(_Stretch):
    held_schema = "at bigint, scan_id bigint, fingerprint string"
    columns = ("at", "scan_id", "fingerprint")

    def late(self, key, rows):
        return self._rows(key, [("late", *key[:2], *r, 1) for r in rows])

    def closed(self, key, rows):
        scans: dict[tuple, dict] = {}
        for at, scan_id, fingerprint in rows:
            counts = scans.setdefault((at, scan_id), {})
            if fingerprint is not None:
                counts[fingerprint] = counts.get(fingerprint, 0) + 1
        order, out = list(scans), []
        for a, b in zip(order, order[1:], strict=False):
            out += [(kind, *key[:2], *b, f, n) for kind, f, n in _gaps(scans[a], scans[b])]
        # The edges: both outer snapshots, with a row of no copies so that a clean one is there.
        for kind, scan in (("first", order[0]), ("last", order[-1])):
            out += [(kind, *key[:2], *scan, f, n) for f, n in [(None, 0), *scans[scan].items()]]
        return self._rows(key, out)

    def _rows(self, key, rows):
        out = Row(*FINDING_COLUMNS, "closes", *KEY)
        return [out(*r) for r in _keyed(rows, key[2])]


class FindingChain(_Chain):
    """The last snapshot is a map fingerprint -> copies, one entry at a time, of which only what differs is written back."""

    row = Row(*FINDING_COLUMNS)

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "fingerprint string", "n bigint", self.ttl_ms)
        self.seen = handle.getValueState("seen", "at bigint", self.ttl_ms)

    def joined(self, key, stretches):
        known = self.seen.exists()
        stored = {k[0]: v[0] for k, v in self.counts.iterator()} if known else {}
        before, out = stored, []
        for edge in stretches:
            sides = {kind: {r["fingerprint"]: r["copies"] for r in edge if r["kind"] == kind and r["copies"]} for kind in ("first", "last")}
            first = next(r for r in edge if r["kind"] == "first")
            if known:
                out += [self.row(kind, first["project"], first["check"], first["at"], first["scan_id"], f, n) for kind, f, n in _gaps(before, sides["first"])]
            known, before = True, sides["last"]
        for fingerprint in stored.keys() - before.keys():
            self.counts.removeKey((fingerprint,))
        for fingerprint, n in before.items():
            if stored.get(fingerprint) != n:
                self.counts.updateValue((fingerprint,), (n,))
        self.seen.update((stretches[-1][0]["closes"],))
        return out


def live_finding_delta(findings: DataFrame, patience: str = "1 hour", span: str = "1 day", ttl_ms: int | None = None) -> DataFrame:
    """What each scan of a (project, check) fixed and introduced against the scan before it, as multisets of fingerprints.

    Input rows: project, check, scan_ts, scan_id, fingerprint (null: the scan ran clean); all rows of a scan have its scan_ts. Order, lateness and state are
    those of :func:`live_delta`. Result: kind (fixed, introduced, or late), project, check, scan_ts, scan_id, fingerprint, copies.
    """
    kept = findings.select("project", "check", "scan_ts", "scan_id", "fingerprint")
    kind = kept.schema["project"].dataType.simpleString()
    row = FINDING_ROW.format(kind)
    closed = _dealt(kept, "scan_ts", patience, span).select("*", _lane(STRETCH_LANES, "project", "check")).groupBy("lane", "closes").transformWithState(
        FindingStretch(kind), outputStructType=f"{row}, closes bigint, key_project {kind}, key_check string, lane bigint", outputMode="append", timeMode="EventTime"
    )
    joined = closed.groupBy(*KEY).transformWithState(
        FindingChain(ttl_ms), outputStructType=row, outputMode="append", timeMode="ProcessingTime" if ttl_ms else "None"
    )
    return joined.select("kind", "project", "check", F.timestamp_micros("at").alias("scan_ts"), "scan_id", "fingerprint", "copies")


class ScoreWindow(StatefulProcessor):
    """Sums of one window and lane of projects until the watermark passes its end; what comes later goes out as late."""

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getListState("sums", f"project {self.kind}, scans bigint, lowest bigint, total bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sums = self._joined((r["project"], r["scans"], r["lowest"], r["total"]) for r in rows)
        if key[-1] <= timerValues.getCurrentWatermarkInMs():
            yield from self._rows("late", key, sums)
        else:
            if not self.sums.exists():
                self.handle.registerTimer(key[-1])
            self.sums.appendList(sums)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sums = self._joined(tuple(r) for r in self.sums.get())
        self.sums.clear()
        yield from self._rows("window", key, sums)

    def _joined(self, parts) -> list[tuple]:
        """One row per project."""
        sums: dict = {}
        for project, scans, lowest, total in parts:
            n, low, all_ = sums.get(project, (0, None, None))
            if lowest is not None:
                low, all_ = (lowest, total) if low is None else (min(low, lowest), all_ + total)
            sums[project] = (n + scans, low, all_)
        return [(project, *s) for project, s in sums.items()]

    def _rows(self, kind: str, key, sums: list[tuple]) -> Iterator[Row]:
        out = Row("kind", "project", "start", "scans", "lowest", "total")
        for project, *found in sums:
            yield out(kind, project, key[1], *found)

    def close(self) -> None:
        pass


def live_trend(scans: DataFrame, length: str, slide: str | None = None, patience: str = "1 hour") -> DataFrame:
    """Score windows per project, each emitted once when the watermark (``patience`` behind the newest scan) has passed its end.

    Result: kind, project, window_start, scans, lowest, total. kind is window, or late: scans that came for a window already closed, summed per micro-batch. So the scans of
    all rows and of the windows still open add up to those read (times the windows each scan lies in, with ``slide``). Scans without a time lie in no window. Each task sums its
    rows by window before they are shuffled. Needs the RocksDB state store.
    """
    long, step = _micros(length), _micros(slide or length)
    at = F.unix_micros(F.col("scan_ts").cast("timestamp"))
    last = F.floor(at / step) * step
    starts = F.filter(F.sequence(last - (-(-long // step) - 1) * step, last, F.lit(step).cast("bigint")), lambda s: s + long > at)
    rows = scans.where(F.col("scan_ts").isNotNull()).withColumn("_watched", F.col("scan_ts").cast("timestamp")).withWatermark("_watched", patience)
    rows = rows.select("project", F.explode(starts).alias("start"), "score")
    kind = rows.schema["project"].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["project", "start"]).aggregate([([], "count_all"), ("score", "min"), ("score", "sum")])
            sums = sums.select(["project", "start", "count_all", "score_min", "score_sum"]).rename_columns(["project", "start", "scans", "lowest", "total"])
            yield from sums.combine_chunks().to_batches()

    parts = rows.mapInArrow(summed, f"project {kind}, start bigint, scans bigint, lowest bigint, total bigint")
    parts = parts.withColumn("closes", F.floor((F.col("start") + long) / 1000).cast("bigint"))
    windows = parts.select("*", _lane(LANES, "project")).groupBy("lane", "start", "closes").transformWithState(
        ScoreWindow(kind), outputStructType=f"kind string, project {kind}, start bigint, scans bigint, lowest bigint, total bigint", outputMode="append", timeMode="EventTime"
    )
    return windows.select("kind", "project", F.timestamp_micros("start").alias("window_start"), "scans", "lowest", "total")


def regression_alerts(changes: DataFrame, drop: int) -> DataFrame:
    """Changes of :func:`live_delta` that lost at least ``drop`` points."""
    return changes.where(F.col("delta") <= -drop)


def unique_scans(scans: DataFrame, within: str = "1 hour") -> DataFrame:
    """Scans without re-sent copies of the same scan id."""
    return scans.withWatermark("scan_ts", within).dropDuplicatesWithinWatermark(["project", "check", "scan_id"])


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write an append stream to parquet; both folders must be shared by the cluster."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

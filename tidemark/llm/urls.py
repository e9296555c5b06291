"""URL filters: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lowered

# Serialised rules up to this size are broadcast as a trie; more are joined.
MAX_TRIE_BYTES = 32 << 20
RULE_COLUMNS = "host string, path string, verdict string"
OUT = "host string, path string, rule string, verdict string"


def rules_table(spark: SparkSession, allow: list[str], block: list[str]) -> DataFrame:
    """Entries such as ``example.org/es/`` as rows; the host runs up to the first ``/``."""
    rows = [(e.partition("/")[0].lower(), "/" + e.partition("/")[2] if "/" in e else "", v) for v, es in (("allow", allow), ("block", block)) for e in es]
    return spark.createDataFrame(rows, RULE_COLUMNS)


class Trie:
    """Rules by reversed host labels, then by path segments; the last piece of a path may be a part of a segment.

    ``find`` walks host and path once and returns the rule with most host labels, then the longest
    path; where an entry stands on both lists, block wins.
    """

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            hit = (host + path, verdict)
            if not path:
                self._put(node, None, hit)
                continue
            *whole, last = path[1:].split("/")
            node = node.setdefault(("path",), {})
            for segment in whole:
                node = node.setdefault(segment, {})
            parts = node.setdefault(("parts",), {})
            self._put(parts, last, hit)

    @staticmethod
    def _put(node: dict, key: str | None, hit: tuple[str, str]) -> None:
        if node.get(key, ("", ""))[1] != "block":
            node[key] = hit

    @staticmethod
    def _in_path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        if not path.startswith("/"):
            return None
        for segment in path[1:].split("/"):
            parts = node.get(("parts",))
            if parts:
                for k in range(len(segment), -1, -1):
                    if segment[:k] in parts:
                        best = parts[segment[:k]]
                        break
            node = node.get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(("path",))
            best = (below and self._in_path(below, path)) or node.get(None) or best
        return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judged_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``default`` where no rule fits.

    A rule fits its host and all subdomains if the path starts with the rule's path. Rules whose total size is at
    most ``max_trie_bytes`` are broadcast as a trie; larger lists are joined on the host suffixes and path
    prefixes of the distinct URLs. Both give the same rows. A null url, one without ``://`` or an empty one has
    empty host and path and takes the default; repeated rows are judged alike; rules with a null host, path or verdict are no rules; an empty
    table gives an empty result; other columns are ignored.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0))).first()[0]
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return _by_trie(parts, rules, default) if size <= max_trie_bytes else _by_join(parts, rules, default)


def _by_trie(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    spark = parts.sparkSession
    shipped = spark.sparkContext.broadcast([tuple(r) for r in rules.select("host", "path", "verdict").collect()])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shipped.value)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [trie.find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return parts.mapInArrow(judge, f"page_id {parts.schema['page_id'].dataType.simpleString()}, {OUT}")


def _by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    urls = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))
    keys = urls.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps")).select("host", "path", "h", F.explode("ps").alias("p"))
    # Of an entry on both lists only the block stays.
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.col("host").alias("rh"), F.col("path").alias("rp"), "verdict")
    hits = keys.join(one, (F.col("h") == F.col("rh")) & (F.col("p") == F.col("rp")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), "verdict"), F.struct(F.size(F.split("rh", r"\.")), F.length("rp"))).alias("best"))
    joined = parts.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

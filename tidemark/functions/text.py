"""Scalar column functions on paths, names, messages and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.regex import java

NUL = "\x00"


def normalise_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``; a missing path is the empty string."""
    slashes = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    return F.trim(F.regexp_replace(slashes, r"^\./", ""))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, java(r"\s+"), " "))


def normalise_message(message: Column) -> Column:
    return F.lower(squeeze(F.coalesce(message, F.lit(""))))


def short_hash(*parts: Column, digits: int = 16) -> Column:
    """Leading hex digits of the SHA-1 of the NUL-joined parts (null = empty)."""
    filled = [F.coalesce(p, F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws(NUL, *filled)), 1, digits)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory part, ``.`` for a top-level file."""
    cut = F.regexp_replace(path, r"/[^/]*\z", "")
    return F.when(F.contains(path, F.lit("/")), cut).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Extension with its dot, empty when there is none."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*\z", "")


def identifier_segments(name: Column) -> Column:
    """``apiKey_2`` -> ``[api, key, 2]``."""
    snake = F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.filter(F.split(snake, "[_.-]+"), lambda s: s != "")


def humanise_id(name: Column) -> Column:
    """``avgTokensPerFile`` -> ``Avg Tokens Per File`` (other letters kept)."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), "[-_]+", " ")
    return F.array_join(
        F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10**6))),
        " ",
    )


def metric_unit(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("score"), "score")
        .when(low.contains("duration") | low.endswith("ms"), "ms")
        .when(low.contains("percent") | low.endswith("pct") | low.contains("ratio"), "percent")
        .when(low.contains("bytes") | low.contains("size"), "bytes")
        .otherwise("count")
    )


def metric_trend(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike("score|coverage|passed"), "higher-is-better")
        .when(low.rlike("error|warning|issue|failed"), "lower-is-better")
        .otherwise("neutral")
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warning", "warning").otherwise("note")


def major_version(version: Column) -> Column:
    return F.substring_index(version, ".", 1)


def matches_glob(path: Column, pattern: Column) -> Column:
    """Finding filters: ``dir/**`` prefix, ``*suffix``, else plain prefix."""
    return (
        F.when(F.endswith(pattern, F.lit("/**")), F.startswith(path, F.substr(pattern, F.lit(1), F.length(pattern) - 2)))
        .when(F.startswith(pattern, F.lit("*")), F.endswith(path, F.substr(pattern, F.lit(2))))
        .otherwise(F.startswith(path, pattern))
    )


def first_json_object(text: Column) -> Column:
    """The text from the first ``{`` on; ``from_json`` ignores what follows the object."""
    at = F.instr(text, "{")
    return F.when(at > 0, F.substr(text, at))


def months_between_days(later: Column, earlier: Column) -> Column:
    """Age in months of thirty days."""
    return F.datediff(later, earlier) / F.lit(30.0)


def repo_slug(url: Column) -> Column:
    """``owner/name`` of a git remote."""
    return F.regexp_extract(url, r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?\z", 1)

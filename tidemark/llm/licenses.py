"""License scans with a positional index over rare template words."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lowered

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases whose consecutive words count as a place, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# label, template text, phrases of which one must stand at its place in the template.
TEMPLATES = (
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
)
MIN_SCORE = 0.8
VOCABULARY = tuple(sorted({w for _, t, _ in TEMPLATES for w in t.split()}))


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters a-z and characters beyond ASCII; null gives none."""
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def word_idf(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each template word over all documents.

    The vocabulary bounds what comes back: one row per word of the templates and one total.
    """
    known = docs.select(F.explode(F.array_append(F.array_distinct(F.filter(tokens(F.col("text")), lambda w: w.isin(*VOCABULARY))), F.lit(""))).alias("w"))
    counts = {r["w"]: r["n"] for r in known.groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.pop("", 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in VOCABULARY}


def rare_words(idf: dict[str, float], template: str) -> list[str]:
    """A template's rarer half by IDF, ties in spelling order; these words are its index keys."""
    own = sorted(set(template.split()), key=lambda w: (-idf[w], w))
    return own[: max(2, len(own) // 2)]


def _or(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _phrase_at(ws: Column, start: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.get(ws, start + k) == w, F.lit(False)) for k, w in enumerate(words)])


def _phrase_starts(words: list[str]) -> Callable[[Column], Column]:
    return lambda i: _phrase_at(F.col("ws"), i, words)


def _starts(keys: list[str], words: list[str]) -> Column:
    """Where a template would start, by each of its index keys in the text: file position less template position."""
    none = F.array().cast("array<int>")
    ws = F.col("ws")

    def of(i: Column) -> Column:
        postings = F.when(F.lit(False), none)
        for key in keys:
            postings = postings.when(F.get(ws, i) == key, F.array(*[F.lit(k) for k, w in enumerate(words) if w == key]))
        return F.transform(postings.otherwise(none), lambda k: i - k)

    return F.flatten(F.transform("spots", of))


def _place(label: str, words: list[str], phrases: tuple[str, ...]) -> Callable[[Column], Column]:
    """Agreement of a template with the text at a start, and whether a mandatory phrase stands at its place."""
    ws = F.col("ws")

    def of(start: Column) -> Column:
        same = [F.coalesce((F.get(ws, start + k) == w).cast("int"), F.lit(0)) for k, w in enumerate(words)]
        at = []
        for phrase in phrases:
            part = phrase.split()
            k = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
            at.append(_phrase_at(ws, start + k, part))
        return F.struct(F.lit(label).alias("label"), start.alias("start"), (reduce(lambda a, b: a + b, same) / len(words)).alias("score"), _or(at).alias("phrase"))

    return of


def scanned(docs: DataFrame, idf: dict[str, float], min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, places of the base phrases, labels, hits and score of every document.

    Every index word of the file is looked up in the postings of the templates (word, template, position),
    so no template hides another. Each file position minus a posting position is a place where the template
    would start; a place counts once, however many words vote for it. There every word of the template is compared at its relative position; the share that
    agrees is the place's score. A template's label is given where the score reaches ``min_score`` and a mandatory phrase stands at its
    place. ``hits`` holds (label, start, score) of these; ``score`` is the best of them, 1 if a
    base phrase stands in the text and none is better.

    Null and empty texts have no words, no labels and score 0. Repeated rows are scanned alike; an empty
    table gives an empty result; other columns are ignored.
    """
    df = docs.select("doc_id", tokens(F.col("text")).alias("ws"))
    n = F.size("ws")
    # Positions of licence words only; all further work is on these.
    spots = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("ws", i).isin(*index_keys(idf), *[p.split()[0] for p, _ in BASE]))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("spots", spots)
    base = [F.filter("spots", _phrase_starts(p.split())) for p, _ in BASE]
    df = df.select("doc_id", "ws", "spots", *[b.alias(f"base_{k}") for k, b in enumerate(base)])
    hits = [F.filter(F.transform(F.array_distinct(_starts(rare_words(idf, t), t.split())), _place(label, t.split(), phrases)), lambda h: h["phrase"] & (h["score"] >= min_score)) for label, t, phrases in TEMPLATES]
    places = F.concat(*[F.col(f"base_{k}") for k in range(len(BASE))])
    df = df.select(
        "doc_id", F.size("ws").cast("bigint").alias("n_words"), places.alias("places"), F.concat(*hits).alias("hits"),
        F.array_compact(F.array(*[F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)])).alias("base"),
    )
    best = F.array_max(F.transform("hits", lambda h: h["score"]))
    return df.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("hits", lambda h: h["label"])))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.transform("hits", lambda h: F.struct(h["label"].alias("label"), h["start"].alias("start"), h["score"].alias("score"))).alias("hits"),
    )


def index_keys(idf: dict[str, float]) -> list[str]:
    """Index keys of all templates."""
    return sorted({w for _, t, _ in TEMPLATES for w in rare_words(idf, t)})

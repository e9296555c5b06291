"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Labelled documents the rules are fitted on, taken in hash order of doc_id.
FIT_ROWS = 20_000
FEATURES = (
    "n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "shout_share", "bang_per_word", "echo_share",
    "distinct_share", "bar_share",
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with its base counts and the features the rules may test.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal
    an earlier line), n_repeat_words (words lying in a three-word window that the text holds at
    least twice), all exact over the whole text; then one share or mean per feature, 0 where there is no word.
    A null text counts as empty. Columns of the same names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in docs.columns if c not in ("ws_", "windows_", "starts_")]
    df = docs.select(*[F.col(f"`{c}`") for c in own], words_of(F.col("text")).alias("ws_"))
    n = F.size("ws_")
    window = lambda i: F.struct(
        F.concat_ws(" ", F.get("ws_", i), F.get("ws_", i + 1), F.get("ws_", i + 2)).alias("w"), i.alias("i")
    )
    windows = F.when(n >= 3, F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), window))).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    df = df.withColumn("windows_", windows)
    # Equal windows are neighbours after sorting; what has an equal neighbour starts a repeated stretch of three words.
    near = lambda x, k: (F.get("windows_", k - 1)["w"] == x["w"]) | (F.get("windows_", k + 1)["w"] == x["w"])
    starts = F.array_sort(F.transform(F.filter("windows_", lambda x, k: F.coalesce(near(x, k), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("starts_", starts)
    covered = F.transform("starts_", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts_", k + 1) - p, F.lit(3))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    per = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    echoes = F.size(F.filter("ws_", lambda w, k: F.coalesce(w == F.get("ws_", k - 1), F.lit(False))))
    shouts = F.size(F.filter("ws_", lambda w: (F.upper(w) == w) & (F.lower(w) != w)))
    df = df.select(
        *[F.col(f"`{c}`") for c in own if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES)],
        n.cast("bigint").alias("n_words"), F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        count(SYMBOLS).cast("bigint").alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_repeat_words"),
        F.size(lines).alias("lines_"), per(shouts).alias("shout_share"), per(count("!")).alias("bang_per_word"), per(echoes).alias("echo_share"),
        per(F.size(F.array_distinct("ws_"))).alias("distinct_share"), per(count("|")).alias("bar_share"),
    )
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0))
    return df.withColumns({
        "mean_word": per_word("word_chars"), "symbols_per_word": per_word("n_symbols"), "repeat_share": per_word("n_repeat_words"),
        "dup_line_share": F.when(F.col("lines_") > 0, F.col("n_dup_lines") / F.col("lines_")).otherwise(F.lit(0.0)),
    }).drop("lines_")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) < self.threshold

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.threshold) == self.at_least


Rule = tuple[Condition, ...]


def learn_rules(rows: list[dict], precision: float = 0.97, least: int = 3, cuts: int = 32, most_conditions: int = 4) -> list[Rule]:
    """An ordered list of conjunctions that reject, from rows with the features and ``bad``.

    Sequential covering: two rows of three grow a rule, condition by condition, by information
    gain over bad rows; the third prunes its last conditions as long as that doesn't lower
    (bad - good) / (bad + good); a rule whose precision over all remaining rows is at least
    ``precision`` with ``least`` bad rows is kept and the rows it covers are taken away; else
    learning ends. Thresholds are the middles between neighbouring quantiles of the bad and of all
    rows that remain. No bad row gives no rule.
    """
    import math

    rules: list[Rule] = []
    left = list(rows)
    while sum(r["bad"] for r in left) >= least:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        rule, covered = [], grow
        while len(rule) < most_conditions:
            p0 = sum(r["bad"] for r in covered)
            if p0 == 0 or p0 == len(covered):
                break
            best, best_gain = None, 0.0
            base = math.log2(p0 / len(covered))
            for f in FEATURES:
                values = sorted((r[f], r["bad"]) for r in covered)
                n = len(values)
                bad_values = [v for v, b in values if b]
                marks = {values[min(n - 1, n * k // cuts)][0] for k in range(1, cuts)} | {bad_values[min(len(bad_values) - 1, len(bad_values) * k // cuts)] for k in range(cuts + 1)}
                below = 0
                bad_below = 0
                i = 0
                for mark in sorted(marks):
                    while i < n and values[i][0] < mark:
                        bad_below += values[i][1]
                        i += 1
                    below = i
                    # Halfway to the nearest smaller value leaves room on both sides of the cut.
                    cut = mark if i == 0 else (mark + values[i - 1][0]) / 2
                    for at_least, p, t in ((True, p0 - bad_below, n - below), (False, bad_below, below)):
                        if p and t < n:
                            gain = p * (math.log2(p / t) - base)
                            if gain > best_gain + 1e-12:
                                best, best_gain = Condition(f, at_least, float(cut)), gain
            if best is None:
                break
            rule.append(best)
            covered = [r for r in covered if best.holds(r)]

        def worth(conditions: list[Condition], rows: list[dict]) -> tuple[float, int, int]:
            hit = [r for r in rows if all(c.holds(r) for c in conditions)]
            bad = sum(r["bad"] for r in hit)
            return ((2 * bad - len(hit)) / len(hit) if hit else -1.0), bad, len(hit)

        while len(rule) > 1 and worth(rule[:-1], prune)[0] >= worth(rule, prune)[0]:
            rule.pop()
        if not rule:
            break
        _, bad, hits = worth(rule, left)
        if bad < least or bad < precision * hits:
            break
        rules.append(tuple(rule))
        left = [r for r in left if not all(c.holds(r) for c in rule)]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from at most ``fit_rows`` labelled documents, taken in hash order of doc_id.

    Rows without doc_id or quality are no examples; a document labelled twice differently is bad.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality_"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("doc_id", "label_id_")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id_"))
    stats = with_statistics(texts.select("doc_id", "text", "quality_")).select("doc_id", "quality_", *FEATURES)
    rows = [r.asDict() | {"bad": int(r["quality_"] == 0)} for r in stats.limit(2 * fit_rows).collect()]
    rows.sort(key=lambda r: tuple(r[f] for f in ("doc_id", *FEATURES)))
    return learn_rules(rows)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), 0 if none does: an ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics of every document with base_failed, rule (0: none) and kept.

    Null and empty texts have no word and fail the base rule; repeated rows are judged alike; an
    empty table gives an empty result.
    """
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns.

    The judged rows are written first: a filter moved below the statistics would make the optimizer unfold them
    for every condition, and evaluate them anew for every word.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    clear = docs.withColumns({f"own_{k}_": n for k, n in enumerate(names)}).select("text", *[f"own_{k}_" for k in range(len(names))])
    held = judged(clear, rules).select(
        *[f"own_{k}_" for k in range(len(names))], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept"
    )
    return stored(held, "quality-judged").where("kept").select(*[F.col(f"own_{k}_").alias(c) for k, c in enumerate(docs.columns)])

"""Chat formatting: linking tool calls to their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, with_running

# JSON kind -> pattern of the type that a parsed value of this kind has.
KINDS = {
    "string": "STRING", "integer": r"BIGINT|DECIMAL\([0-9]+,0\)", "number": r"BIGINT|DOUBLE|DECIMAL\(.*\)", "boolean": "BOOLEAN",
    "object": "OBJECT<.*>", "array": "ARRAY<.*>",
}

# A JSON string, a number, or what stands between them.
JSON_PIECES = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def canonical(json: Column) -> Column:
    """JSON with sorted keys, no blanks and one form of each number; null if it is no JSON (an object that repeats a key is none).

    Numbers of equal value are written alike: whole ones below 1e37 as plain digits (1.0, 1e0 and 10e-1 as 1, -0 as 0),
    others with a fraction or an exponent as the double nearest to them.
    """
    text = F.to_json(F.try_parse_json(json))
    pieces = F.regexp_extract_all(text, F.lit(JSON_PIECES), F.lit(0))
    written = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^-?[0-9]"), _number(p)).otherwise(p)), "")
    return F.when(text.rlike(r"[0-9][.eE]|-0"), written).otherwise(text)


def _number(piece: Column) -> Column:
    double = piece.try_cast("double")
    whole = F.when(piece.rlike("^-?[0-9]+$"), piece.try_cast("decimal(38,0)")).when(
        (F.abs(double) < 1e37) & (double == F.rint(double)), double.try_cast("decimal(38,0)")
    )
    plain = F.when(F.isnan(double) | (F.abs(double) == float("inf")), piece).otherwise(double.cast("string"))
    return F.coalesce(whole.cast("string"), F.when(piece.rlike("[.eE]"), plain), piece)


def argument_errors(arguments: Column, kinds: Column, required: Column) -> Column:
    """What is wrong with the arguments against a schema, sorted; empty if nothing is.

    ``kinds`` maps parameters to JSON kinds, ``required`` lists those that must be given; a JSON null is not
    given. Errors: ``no object`` (or no JSON), ``no schema`` (unknown tool), ``unknown x``, ``kind x``, ``missing x``.
    """
    parsed = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    types = F.transform_values(parsed, lambda k, v: F.schema_of_variant(v))
    given = F.map_filter(types, lambda k, t: t != "VOID")
    fits = lambda k, t: F.coalesce(_or_else([(kinds[k] == kind) & t.rlike(f"^({p})$") for kind, p in KINDS.items()]), F.lit(False))
    unknown = F.transform(F.filter(F.map_keys(types), lambda k: ~F.map_contains_key(kinds, k)), lambda k: F.concat(F.lit("unknown "), k))
    wrong = F.transform(F.map_keys(F.map_filter(given, lambda k, t: F.map_contains_key(kinds, k) & ~fits(k, t))), lambda k: F.concat(F.lit("kind "), k))
    missing = F.transform(F.filter(required, lambda k: ~F.map_contains_key(given, k)), lambda k: F.concat(F.lit("missing "), k))
    return (
        F.when(kinds.isNull(), F.array(F.lit("no schema")))
        .when(parsed.isNull(), F.array(F.lit("no object")))
        .otherwise(F.array_sort(F.concat(unknown, wrong, missing)))
    )


def _or_else(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of distinct calls: 0 without a known predecessor, else one more than ``after``.

    Pointers double each round, so a chain of n calls takes log2(n) rounds, each a join of two written
    tables. A call on a cycle, or behind one, has a null level.
    """
    known = calls.select(F.col("conv_id").alias("kc"), F.col("call_id").alias("ka"))
    linked = calls.join(known, (F.col("conv_id") == F.col("kc")) & (F.col("after") == F.col("ka")), "left")
    state = stored(linked.select("conv_id", "call_id", F.col("ka").alias("ptr"), F.col("ka").isNotNull().cast("bigint").alias("level")), "call-level")
    total = state.count()
    for _ in range(max(1, total).bit_length() + 1):
        if state.where("ptr IS NOT NULL").limit(1).count() == 0:
            return state.select("conv_id", "call_id", "level")
        other = state.select(F.col("conv_id").alias("oc"), F.col("call_id").alias("oa"), F.col("ptr").alias("optr"), F.col("level").alias("olevel"))
        joined = state.join(other, (F.col("conv_id") == F.col("oc")) & (F.col("ptr") == F.col("oa")), "left")
        state = stored(joined.select("conv_id", "call_id", F.col("optr").alias("ptr"), (F.col("level") + F.coalesce("olevel", F.lit(0))).alias("level")), "call-level")
    return state.select("conv_id", "call_id", F.when(F.col("ptr").isNull(), F.col("level")).alias("level"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, further: bool = False) -> DataFrame:
    """One row per call, and per result without a call, in topological order of each conversation.

    ``calls``: conv_id, call_id, pos, name, arguments (JSON), after (the call whose result it uses, or null).
    ``results``: conv_id, call_id, pos, content. ``schemas``: name, kinds (map), required (array).
    Returns conv_id, place (from 0), level, call_id, name, state, errors, n_results, json.

    Of several calls with one identifier in a conversation the one with the smallest pos counts, the others are
    ``repeated``; of several results the first is linked and n_results tells how many there are. With ``further`` every
    further result of a call is a row of its own (``repeated result``, n_results 0), else it is only counted. States:
    ``linked``, ``pending`` (no result), ``cyclic``, ``repeated``, ``repeated result``, ``orphan`` (a result without call, each a row with n_results 1).
    Calls are ordered by level, then pos, then what follows; cyclic ones, repeated ones and rows of results come last. ``json`` holds sorted keys
    without blanks; arguments that are no JSON are kept as a string. Rows with a null conv_id or call_id can't be linked: each is a pending
    call (cyclic if the call it comes after is) or an orphan, and those with a null conv_id have places of their own. Empty tables give an
    empty result; other columns are ignored.
    """
    ids = [F.col("conv_id").cast("bigint").alias("conv_id"), "call_id", F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos")]
    key, known = ["conv_id", "call_id"], "conv_id IS NOT NULL AND call_id IS NOT NULL"
    calls = stored(calls.select(*ids, "name", "arguments", "after", F.monotonically_increasing_id().alias("row")), "calls")
    results = stored(results.select(*ids, "content", F.monotonically_increasing_id().alias("row")), "results")
    first = calls.where(known).groupBy(*key).agg(
        F.min(F.struct("pos", "row")).alias("at"), F.min_by(F.struct("name", "arguments", "after"), F.struct("pos", "row")).alias("call")
    ).select(*key, "at.pos", "at.row", "call.*")
    first = stored(first, "calls-first")
    answers = results.where(known).groupBy(*key).agg(F.min(F.struct("pos", "content", "row")).alias("answer"), F.count("*").alias("n_results"))
    answers = stored(answers.select(*key, "answer.content", F.col("answer.row").alias("answer_row"), "n_results"), "answers")
    levels = call_levels(first)
    state = F.when(F.col("level").isNull(), "cyclic").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    main = first.join(levels, key).join(answers.drop("answer_row"), key, "left").withColumn("state", state)
    again = calls.where(known).join(first.select("row"), "row", "left_anti").withColumn("state", F.lit("repeated"))
    before = levels.select(F.col("conv_id").alias("bc"), F.col("call_id").alias("ba"), F.col("level").alias("before"))
    loose = calls.where(f"NOT ({known})").join(before, (F.col("conv_id") == F.col("bc")) & (F.col("after") == F.col("ba")), "left")
    loose = loose.withColumn("level", F.when(F.col("ba").isNull(), F.lit(0)).otherwise(F.col("before") + 1).cast("bigint")).drop("bc", "ba", "before")
    loose = loose.withColumn("n_results", F.lit(None).cast("bigint")).withColumn("state", state)
    met = results.join(first.select(*key, F.lit(True).alias("called")), key, "left")
    rows = [again, loose, met.where("called IS NULL").drop("called").withColumn("state", F.lit("orphan")).withColumn("n_results", F.lit(1).cast("bigint"))]
    if further:
        more = met.where("called").drop("called").join(answers.select(F.col("answer_row").alias("row")), "row", "left_anti")
        rows.append(more.withColumn("state", F.lit("repeated result")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows, main)
    checked = rows.join(schemas.select(F.col("name").alias("tool"), "kinds", "required"), F.col("name") == F.col("tool"), "left")
    errors = F.when(F.col("state").isin("orphan", "repeated result"), F.array().cast("array<string>")).otherwise(argument_errors(F.col("arguments"), F.col("kinds"), F.coalesce("required", F.array().cast("array<string>"))))
    checked = checked.select(
        "conv_id", F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(-1)).alias("conv"), "call_id", "pos", "row", "name", "arguments", "after", "level", "content", F.coalesce("n_results", F.lit(0)).alias("n_results"), "state",
        errors.alias("errors"), (F.col("level").isNull() | (F.col("state") == "repeated")).alias("last"),
    )
    ordered = with_running(checked, ["no_conv", "conv", "last", "level", "pos", "state", "call_id", "row"], "call-order", by=["no_conv", "conv"], rank="place")
    json = F.concat(
        F.lit('{"after":'), _quoted("after"), F.lit(',"arguments":'), F.when(F.col("arguments").isNull(), "null").otherwise(F.coalesce(canonical(F.col("arguments")), _quoted("arguments"))),
        F.lit(',"errors":'), F.to_json("errors"), F.lit(',"id":'), _quoted("call_id"), F.lit(',"name":'), _quoted("name"),
        F.lit(',"result":'), _quoted("content"), F.lit(',"state":'), _quoted("state"), F.lit("}"),
    )
    return ordered.select("conv_id", "place", "level", "call_id", "name", "state", "errors", "n_results", json.alias("json"))


def _quoted(name: str) -> Column:
    """A string column as JSON text, null as null."""
    return F.when(F.col(name).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))

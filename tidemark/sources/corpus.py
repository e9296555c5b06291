"""Where files, pages, scans and events come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.tables import MAX_SOURCE_BYTES
from tidemark.functions import scoring as S
from tidemark.session import spread


def read_corpus(spark: SparkSession, path: str, root: str, max_bytes: int | None = MAX_SOURCE_BYTES) -> DataFrame:
    """Every file below ``path`` with its text; ``root`` is cut off the paths.

    The first directory below the root is the project. Length is filtered before
    the content column is touched, so larger files are never decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    relative = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(root.rstrip("/") + "/"), "")
    return raw.select(
        F.split(relative, "/")[0].alias("project"),
        F.regexp_replace(relative, r"^[^/]*/", "").alias("path"),
        F.col("length").alias("size"),
        F.decode("content", "UTF-8").alias("content"),
    )


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def size_capped(files: DataFrame, max_bytes: int = MAX_SOURCE_BYTES) -> DataFrame:
    """Files small enough for source checks."""
    return files.where(F.octet_length("content") <= max_bytes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` seen as text files: the source is the project, the language a directory."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text"))
    return docs.select(
        F.col("source").alias("project"),
        F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("text").alias("content"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` seen as HTML files of a static site: the host is the project."""
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("project"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("url_path"),
        F.col("html").alias("content"),
    )


def event_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` seen as scan history: user = project, event type = check, value = score."""
    return scans_from_events(table(spark, sf_dir, "events"))


def scans_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("scan_id"),
        F.col("user_id").alias("project"),
        F.col("event_type").alias("check"),
        F.col("ts").alias("scan_ts"),
        S.round_half_up(S.clamp(F.col("value"))).alias("score"),
    )


def event_number() -> Column:
    """The number carried in an event's ``props``."""
    return F.get_json_object("props", "$.k").cast("int")


def _module(number: Column) -> Column:
    """Directory and name of the module with this number, without extension."""
    return F.concat(F.lit("pkg"), F.pmod(number, F.lit(10)).cast("string"), F.lit("/mod"), number.cast("string"))


def event_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files written from ``events``: one module per user, one line per distinct (type, number).

    Clicks become static imports, views type imports, purchases dynamic imports,
    errors a try block and signups an exported function. A module has at most
    (types x numbers) lines however many events its user has: the lines are made
    distinct before they are gathered.
    """
    events = table(spark, sf_dir, "events")
    facts = events.select("user_id", "event_type", event_number().alias("k")).distinct()
    k = F.col("k").cast("string")
    target = F.concat(F.lit("../"), _module(F.col("k")))
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("import { m"), k, F.lit(" } from '"), target, F.lit("';")))
        .when(F.col("event_type") == "view", F.concat(F.lit("import type { T"), k, F.lit(" } from '"), target, F.lit("';")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("const lazy"), k, F.lit(" = () => import('"), target, F.lit("'); if (!lazy"), k, F.lit(") throw new Error('gone');")))
        .when(F.col("event_type") == "error", F.concat(F.lit("try { run"), k, F.lit("(); } catch (e) {}")))
        .otherwise(
            F.concat(
                F.when(F.pmod(F.col("k"), F.lit(2)) == 0, F.concat(F.lit("// step "), k, F.lit("\n"))).otherwise(""),
                F.lit("export function step"), k,
                F.lit("(el) { el.innerHTML = JSON.parse(body); return null; } // TODO check as any"),
            )
        )
    )
    rows = facts.select("user_id", "event_type", "k", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("event_type", "k", "line")))
    return rows.groupBy("user_id").agg(ordered.alias("_l")).select(
        F.lit("app").alias("project"),
        F.concat(_module(F.col("user_id")), F.lit(".ts")).alias("path"),
        F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("content"),
    )


def event_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files of the modules whose user ever bought for more than 150, from ``events``."""
    events = table(spark, sf_dir, "events")
    tested = events.where((F.col("event_type") == "purchase") & (F.col("value") > 150)).select("user_id").distinct()
    facts = events.join(tested, "user_id", "left_semi").select("user_id", "event_type", event_number().alias("k")).distinct()
    k = F.col("k").cast("string")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("it('m"), k, F.lit("', () => { expect(m"), k, F.lit("()).toBe(1); });")))
        .when(F.col("event_type") == "view", F.concat(F.lit("vi.mock('../"), _module(F.col("k")), F.lit("');")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("it('p"), k, F.lit("', () => { assert.ok(p"), k, F.lit("()); });")))
        .when(F.col("event_type") == "error", F.concat(F.lit("it.skip('e"), k, F.lit("', () => {});")))
        .otherwise(F.concat(F.lit("it('s"), k, F.lit("', () => { expect(s"), k, F.lit("()).toMatchSnapshot(); });")))
    )
    rows = facts.select("user_id", "event_type", "k", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("event_type", "k", "line")))
    return rows.groupBy("user_id").agg(ordered.alias("_l")).select(
        F.lit("app").alias("project"),
        F.concat(_module(F.col("user_id")), F.lit(".test.ts")).alias("path"),
        F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("content"),
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges from ``events``: module = user, imported module = number, layer = event type."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "type").when(F.col("event_type") == "purchase", "dynamic").otherwise("static")
    return (
        events.select(F.col("user_id").cast("bigint").alias("src"), event_number().cast("bigint").alias("dst"), kind.alias("kind"))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )


# Directory of a document, by its source; gives the path policy something to decide.
SOURCE_DIRECTORIES = {
    "src0": "src", "src1": "node_modules/pkg", "src2": "dist", "src3": "src/tests", "src4": "docs",
    "src5": ".yarn/cache", "src6": "vendor/lib", "src7": "packages/a/src", "src8": "packages/b/src",
    "src9": "coverage", "src10": "src/.cache", "src11": "legacy/old", "src12": "scripts", "src13": "packages/a",
    "src14": "assets", "src15": "public", "src16": "config", "src17": "build", "src18": "test", "src19": "lib",
}
LANGUAGE_ENDINGS = {"en": ".ts", "fr": ".min.js", "de": ".html", "es": ".md"}


def policy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` spread over typical directories: the language is the project."""
    docs = table(spark, sf_dir, "documents")
    directory = F.element_at(F.create_map(*[F.lit(x) for p in SOURCE_DIRECTORIES.items() for x in p]), F.col("source"))
    ending = F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGE_ENDINGS.items() for x in p]), F.col("lang"))
    secretive = F.col("text").rlike('token = "')
    name = F.when(secretive, F.concat(F.lit(".env."), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.coalesce(ending, F.lit(".txt")))
    )
    return docs.select(
        F.col("lang").alias("project"),
        F.concat_ws("/", F.coalesce(directory, F.lit("misc")), name).alias("path"),
        F.col("n_chars").alias("size"),
    )

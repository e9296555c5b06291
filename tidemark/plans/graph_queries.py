"""Queries on the import graph written from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import graph as G
from tidemark.operators import textmetrics as M
from tidemark.plans.registry import named
from tidemark.plans.views import EDGES, with_views
from tidemark.sources.corpus import event_edges, event_modules, event_tests, table
from tidemark.functions.text import dirname

_PAIRS = EDGES + ", pairs AS (SELECT DISTINCT src, dst FROM edges), nodes AS (SELECT DISTINCT src AS node FROM pairs UNION SELECT DISTINCT dst FROM pairs)"
GRAPH = with_views(_PAIRS)
_DEGREES = (
    "deg AS (SELECT node, (SELECT count(*) FROM pairs WHERE dst = node) AS fan_in, (SELECT count(*) FROM pairs WHERE src = node) AS fan_out FROM nodes)"
)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def directory(node):
    """Nodes lie in ten directories, by their last digit."""
    return F.concat(F.lit("pkg"), F.pmod(node, F.lit(10)).cast("string"))


@named("degrees", with_views(_PAIRS, _DEGREES) + "SELECT * FROM deg")
def degrees(spark, sf_dir):
    edges = event_edges(spark, sf_dir)
    return G.degrees(nodes_of(edges), edges)


@named(
    "coupling",
    with_views(_PAIRS, _DEGREES) + """SELECT *, fan_in >= greatest(3, floor((SELECT count(*) FROM nodes) * 0.5)) AS god, fan_out > 10 AS high_fan_out, fan_in > 5 AND fan_out > 5 AS connector FROM deg""",
)
def coupling(spark, sf_dir):
    edges = event_edges(spark, sf_dir)
    return G.coupling(nodes_of(edges), edges)


@named("mutual_edges", GRAPH + "SELECT a.src AS a, a.dst AS b FROM pairs a JOIN pairs b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_edges(spark, sf_dir):
    return G.mutual_edges(event_edges(spark, sf_dir))


@named(
    "structure_matrix",
    GRAPH + "SELECT a.src AS row, a.dst AS col, b.src IS NOT NULL AS mutual FROM pairs a LEFT JOIN pairs b ON a.src = b.dst AND a.dst = b.src",
)
def structure_matrix(spark, sf_dir):
    return G.structure_matrix(event_edges(spark, sf_dir))


_DIRS = """d AS (SELECT src, dst, 'pkg' || (src % 10) AS s, 'pkg' || (dst % 10) AS t FROM pairs),
  stab AS (SELECT dir, CAST(sum(o) AS BIGINT) AS ce, CAST(sum(i) AS BIGINT) AS ca FROM (SELECT s AS dir, 1 AS o, 0 AS i FROM d UNION ALL SELECT t, 0, 1 FROM d) GROUP BY dir),
  inst AS (SELECT *, floor(ce::DOUBLE / greatest(1, ce + ca) * 100 + 0.5) / 100 AS instability, CASE WHEN ce::DOUBLE / greatest(1, ce + ca) > 0.7 THEN 'unstable' WHEN ce::DOUBLE / greatest(1, ce + ca) < 0.3 THEN 'stable' ELSE 'balanced' END AS role FROM stab)"""


@named("instability", with_views(_PAIRS, _DIRS) + "SELECT * FROM inst")
def instability(spark, sf_dir):
    return G.directory_degrees(event_edges(spark, sf_dir), directory)


@named(
    "architecture_assessment",
    with_views(_PAIRS, _DIRS) + """, r AS (SELECT s, t, a.instability AS si, b.instability AS ti FROM d JOIN inst a ON a.dir = s JOIN inst b ON b.dir = t),
    per AS (SELECT s, count(*) AS total, count(*) FILTER (s = t) AS internal, count(*) FILTER (s <> t AND ti >= 0.35) AS crossing, count(*) FILTER (s <> t AND ti >= 0.35 AND si > 0.5 AND ti > 0.5) AS violations FROM r GROUP BY s),
    tot AS (SELECT CAST(sum(total) AS BIGINT) AS edges, CAST(floor(sum(crossing)::DOUBLE / sum(total) * 100 + 0.5) AS BIGINT) AS cross_coupling,
      CAST(floor(avg(internal::DOUBLE / total) * 100 + 0.5) AS BIGINT) AS cohesion, CAST(sum(violations) AS BIGINT) AS violations FROM per),
    l AS (SELECT *, CASE WHEN violations = 0 THEN 'clean' WHEN violations < 5 THEN 'mixed' ELSE 'tangled' END AS layering FROM tot)
    SELECT *, CASE WHEN cross_coupling > 80 OR layering = 'tangled' THEN 'poor' WHEN cross_coupling > 60 OR layering = 'mixed' THEN 'fair' WHEN cross_coupling > 40 OR cohesion < 20 THEN 'good' ELSE 'excellent' END AS rating FROM l""",
)
def architecture_assessment(spark, sf_dir):
    return G.assessment(event_edges(spark, sf_dir), directory)


@named(
    "architecture_pattern",
    """SELECT source AS project, count(DISTINCT lang) AS dirs, CASE WHEN count(DISTINCT lang) >= 3 THEN 'modular' WHEN count(DISTINCT lang) = 2 THEN 'two-tier' ELSE 'flat' END AS pattern FROM documents GROUP BY source""",
)
def architecture_pattern(spark, sf_dir):
    dirs = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("lang").alias("dir")).distinct()
    return G.architecture_pattern(dirs)


@named(
    "tested_directories",
    """WITH p AS (SELECT 'pkg' || (user_id % 10) AS dir, user_id, bool_or(event_type = 'purchase' AND value > 150) AS paired FROM events GROUP BY user_id)
    SELECT dir, count(*) AS files, count(*) FILTER (paired) AS tested, CAST(floor(count(*) FILTER (paired)::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS percent FROM p GROUP BY dir""",
)
def tested_directories(spark, sf_dir):
    modules = event_modules(spark, sf_dir).select("project", "path")
    pairing = M.test_pairing(modules.unionByName(event_tests(spark, sf_dir).select("project", "path")))
    return G.coverage_map(modules.withColumn("dir", dirname(F.col("path"))), pairing).drop("project")


def _cycles_sql(layer: str) -> str:
    return (
        EDGES + f", e AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ({layer}))"
        + ", reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)"
        + ", rings AS (SELECT a.src AS node, max(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"
        + " SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM rings"
    )


@named("cycles_static", "WITH RECURSIVE " + _cycles_sql("'static'"))
def cycles_static(spark, sf_dir):
    return G.strongly_connected(event_edges(spark, sf_dir).where("kind = 'static'"))


@named("cycles_dynamic", "WITH RECURSIVE " + _cycles_sql("'static', 'dynamic'"))
def cycles_dynamic(spark, sf_dir):
    """Cycles of the graph that also counts deferred imports."""
    return G.strongly_connected(event_edges(spark, sf_dir).where("kind IN ('static', 'dynamic')"))


@named("cycles_type_only", "WITH RECURSIVE " + _cycles_sql("'type'"))
def cycles_type_only(spark, sf_dir):
    return G.strongly_connected(event_edges(spark, sf_dir).where("kind = 'type'"))


@named(
    "architecture_score",
    with_views(_PAIRS, _DEGREES) + """, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (fan_in >= greatest(3, floor((SELECT count(*) FROM nodes) * 0.5))) AS gods, count(*) FILTER (fan_in = 0) AS orphans,
      count(*) FILTER (fan_out > 10) AS fan, count(*) FILTER (fan_in > 5 AND fan_out > 5) AS conn FROM deg)
    SELECT CAST(n AS BIGINT) AS modules, gods, orphans, fan AS high_fan_out, conn AS connectors, CAST(floor(greatest(0, least(100, 100 - least(15, gods / n * 100) - least(10, orphans / n * 50) - least(15, fan / n * 80) - least(10, conn / n * 60))) + 0.5) AS BIGINT) AS score FROM c""",
)
def architecture_score(spark, sf_dir):
    """Score of the graph apart from its cycles."""
    edges = event_edges(spark, sf_dir)
    c = G.coupling(nodes_of(edges), edges).agg(
        F.count(F.lit(1)).alias("modules"), F.count_if("god").alias("gods"), F.count_if(F.col("fan_in") == 0).alias("orphans"),
        F.count_if("high_fan_out").alias("high_fan_out"), F.count_if("connector").alias("connectors"),
    )
    score = S.architecture_score(F.lit(0), F.col("gods"), F.col("orphans"), F.col("high_fan_out"), F.col("connectors"), F.col("modules"))
    return c.withColumn("score", score)

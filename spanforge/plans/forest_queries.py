"""The joint forest against a tree that SQL grows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import forest as Fo
from spanforge.plans.base import QUERIES, ORACLE_SQL, r6, scratch

#: Fixed cut points of the two features.
EDGES = [[8.5, 16.5, 24.5, 32.5, 40.5], [1000.0, 1200.0, 1400.0, 1600.0, 1800.0]]

_PART = "SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, round((p_size * 1.5 + p_partkey % 3) * 1048576)::BIGINT AS y0, round((p_size + 2.0) * 1048576)::BIGINT AS y1, round(p_retailprice / 100 * 1048576)::BIGINT AS y2 FROM part"


def _level(name: str, src: str) -> str:
    """CTEs of the best cut of every node of ``src`` (node, a bin of each feature, labels): ``<name>`` has node, f, b, or nulls."""
    gain = lambda w, s: f"(0.0 + pow(({s.format(0)})::DOUBLE, 2) + pow(({s.format(1)})::DOUBLE, 2) + pow(({s.format(2)})::DOUBLE, 2)) / ({w})::DOUBLE"
    return f"""
{name}_h AS (SELECT node, 0 AS f, ba AS b, count(*) AS w, sum(y0)::HUGEINT AS s0, sum(y1)::HUGEINT AS s1, sum(y2)::HUGEINT AS s2 FROM {src} GROUP BY ALL UNION ALL SELECT node, 1, bb, count(*), sum(y0), sum(y1), sum(y2) FROM {src} GROUP BY ALL),
{name}_c AS (SELECT node, f, b, sum(w) OVER u AS lw, sum(s0) OVER u AS l0, sum(s1) OVER u AS l1, sum(s2) OVER u AS l2, sum(w) OVER a AS aw, sum(s0) OVER a AS a0, sum(s1) OVER a AS a1, sum(s2) OVER a AS a2 FROM {name}_h WINDOW u AS (PARTITION BY node, f ORDER BY b ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, f)),
{name}_g AS (SELECT *, CASE WHEN lw >= 2 AND aw - lw >= 2 THEN {gain("lw", "l{0}")} + {gain("aw - lw", "a{0} - l{0}")} - {gain("aw", "a{0}")} END AS gain FROM {name}_c),
{name} AS (SELECT node, f, b FROM {name}_g WHERE gain > 1.048576 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)"""


def _binned(values: list[float], c: str) -> str:
    return " + ".join(f"({c} > {v})::INT" for v in values)


def joint_forest(spark, sf_dir: str):
    """One tree of depth two for three sides at once, over all parts; saved, read back and asked."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("double")
    rows = p.select("p_partkey", size.alias("a"), F.col("p_retailprice").alias("b"), (size * 1.5 + F.col("p_partkey") % 3).alias("length_in"), (size + 2.0).alias("width_in"), (F.col("p_retailprice") / 100).alias("height_in"), (F.col("p_partkey") % 5 != 0).alias("object_available"))
    made = Fo.fit_forest(rows, ["a", "b"], ["length_in", "width_in", "height_in"], key="p_partkey", trees=1, depth=2, edges=EDGES, sampled=False)
    path = scratch(spark, "forest")
    Fo.save(made, spark, path)
    out = Fo.answers(Fo.load(spark, path), rows.drop("length_in", "width_in", "height_in"), path=path)
    return out.select("p_partkey", *[r6(f"predicted_box.{c}").alias(c) for c in ("length_in", "width_in", "height_in")], F.array_join("warnings", ",").alias("warnings"), r6(F.element_at("feature_snapshot", F.lit("a"))).alias("seen_a"))


QUERIES["joint_forest"] = joint_forest
ORACLE_SQL["joint_forest"] = f"""
WITH r AS ({_PART}), n0 AS (SELECT *, 1 AS node, {_binned(EDGES[0], "a")} AS ba, {_binned(EDGES[1], "b")} AS bb FROM r),{_level("c1", "n0")},
n1 AS (SELECT n0.* EXCLUDE (node), CASE WHEN c1.f IS NULL THEN 1 WHEN (CASE c1.f WHEN 0 THEN ba ELSE bb END) > c1.b THEN 3 ELSE 2 END AS node, c1.f IS NOT NULL AS open FROM n0 LEFT JOIN c1 ON c1.node = n0.node),
n1o AS (SELECT * FROM n1 WHERE open),{_level("c2", "n1o")},
n2 AS (SELECT n1.* EXCLUDE (node), CASE WHEN c2.f IS NULL THEN n1.node WHEN (CASE c2.f WHEN 0 THEN ba ELSE bb END) > c2.b THEN 2 * n1.node + 1 ELSE 2 * n1.node END AS node FROM n1 LEFT JOIN c2 ON c2.node = n1.node),
v AS (SELECT node, sum(y0) / count(*) / 1048576 AS v0, sum(y1) / count(*) / 1048576 AS v1, sum(y2) / count(*) / 1048576 AS v2 FROM n2 GROUP BY node)
SELECT p_partkey, round(v0, 6) AS length_in, round(v1, 6) AS width_in, round(v2, 6) AS height_in, CASE WHEN p_partkey % 5 = 0 THEN 'object_unavailable' ELSE '' END AS warnings, round(a, 6) AS seen_a FROM n2 JOIN v ON v.node = n2.node"""

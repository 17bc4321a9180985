"""The library's registered queries: QUERIES by name, ORACLE with their DuckDB SQL.

Many run on the hierarchy tree: a root, the regions, the nations and the customers, with ids -1, 1000000 +
region, 2000000 + nation and the customer's key, so that plain joins give what the tree operators must return.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treefuse.functions import evaluate, matrices, weights
from treefuse.operators import fusion, hierarchy, rooted_tree
from treefuse.operators.spanning_tree import spanning_tree, spanning_tree_of_features
from treefuse.plans import bicluster, path, sparse
from treefuse.shared import cut, cut_dir, rounded, row_numbers, tidy
from treefuse.sources.matrix import Fit, read_fit, samples, write_fit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = tidy(f)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Inputs.

TREE_SQL = """
nodes AS (
  SELECT -1::BIGINT AS id, NULL::BIGINT AS up, NULL::DOUBLE AS x
  UNION ALL SELECT 1000000 + r_regionkey, -1, r_regionkey * 100.0 FROM region
  UNION ALL SELECT 2000000 + n_nationkey, 1000000 + n_regionkey, n_nationkey * 10.0 FROM nation
  UNION ALL SELECT c_custkey, 2000000 + c_nationkey, c_acctbal FROM customer
), e AS (
  SELECT least(id, up) AS u, greatest(id, up) AS v, id, up, 1 + (abs(id) % 7) AS dist FROM nodes WHERE up IS NOT NULL
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, node_id, parent_id, x (a number) of the hierarchy tree."""
    root = spark.range(1).select(F.lit(-1).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(None).cast("double").alias("x"))
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000000).cast("bigint"), F.lit(-1).cast("bigint"), (F.col("r_regionkey") * 100.0).cast("double"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000000).cast("bigint"), (F.col("n_regionkey") + 1000000).cast("bigint"), (F.col("n_nationkey") * 10.0).cast("double"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint"), (F.col("c_nationkey") + 2000000).cast("bigint"), F.col("c_acctbal").cast("double"))
    return root.union(region).union(nation).union(customer).select(F.lit(0).alias("g"), "node_id", "parent_id", "x")


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree_nodes(spark, sf_dir).where("parent_id is not null")
    return rows.select("g", F.least("node_id", "parent_id").alias("u"), F.greatest("node_id", "parent_id").alias("v"), (1.0 + F.abs("node_id") % 7).cast("double").alias("dist"))


def weighted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooted_tree.with_shape(rooted_tree.rooted(weights.gaussian(tree_edges(spark, sf_dir), 10.0)))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance and revenue of each supplier, both standardised."""
    spend = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("spend"))
    rows = table(spark, sf_dir, "supplier").join(spend, F.col("s_suppkey") == F.col("k"), "left").select("s_suppkey", F.col("s_acctbal").alias("a"), F.coalesce("spend", F.lit(0.0)).alias("b"))
    m = rows.agg(*(f(c).alias(n + c) for c in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = rows.crossJoin(F.broadcast(m)).select("s_suppkey", *(F.coalesce((F.col(c) - F.col("m" + c)) / F.nullif("s" + c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in "ab"))
    return samples(scaled, "s_suppkey", ["a", "b"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"))


# Matrices.


@query("SELECT i - 1 AS feature_idx, sum(embedding[i]::DOUBLE * (vec_id + 1))::DECIMAL(30, 4)::DOUBLE AS checksum, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY i")
def matrix_transpose(spark, sf_dir):
    rows = matrices.transpose(vectors(spark, sf_dir))
    total = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rows.select(F.col("feature_idx").cast("bigint").alias("feature_idx"), total.cast("decimal(30,4)").cast("double").alias("checksum"), F.size("values").cast("bigint").alias("n"))


@query("""
WITH v AS (SELECT unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem)
SELECT p, round(value, 6) AS value FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p, unnest(quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0])) AS value FROM v)
""")
def matrix_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = matrices.quantiles(samples(rows, "id", ["l_quantity", "l_discount", "l_tax"]), (0.0, 0.25, 0.5, 0.75, 1.0))
    return found.select("p", rounded("value").alias("value"))


@query("SELECT i, round(lo + (hi - lo) * i / 10, 6) AS value FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), range(0, 11) t(i)")
def matrix_breaks(spark, sf_dir):
    rows = matrices.breaks(samples(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"]), 11)
    return rows.select(F.col("i").cast("bigint").alias("i"), rounded("value").alias("value"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice FROM lineitem ORDER BY md5('1:' || (l_orderkey * 10 + l_linenumber)), id LIMIT 1000")
def sample_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return matrices.sample_rows(rows.select("id", "l_extendedprice"), "id", 1000, seed=1)


@query("SELECT row_number() OVER (ORDER BY label, vec_id) AS pos, vec_id, label FROM embeddings")
def ordered_rows(spark, sf_dir):
    return row_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id")


# Spanning trees.


@query("""
WITH RECURSIVE pts AS (
  SELECT s_suppkey AS id, s_acctbal AS x, coalesce(s, 0) AS y FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
), z AS (
  SELECT id, coalesce((x - avg(x) OVER ()) / nullif(stddev_pop(x) OVER (), 0), 0) AS x, coalesce((y - avg(y) OVER ()) / nullif(stddev_pop(y) OVER (), 0), 0) AS y FROM pts
), prim AS (
  SELECT 0 AS step, [min(id)] AS seen, NULL::DOUBLE AS d2 FROM z
  UNION ALL
  SELECT step + 1, list_append(seen, best.id), best.d2 FROM (
    SELECT p.step, p.seen, (SELECT min(struct_pack(d2 := (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), id := b.id)) FROM z a, z b WHERE list_contains(p.seen, a.id) AND NOT list_contains(p.seen, b.id)) AS best FROM prim p
  ) WHERE best IS NOT NULL
)
SELECT row_number() OVER (ORDER BY d2) AS rank, round(sqrt(d2), 6) AS dist FROM prim WHERE d2 IS NOT NULL
""")
def mst_rows(spark, sf_dir):
    return ranked_lengths(spanning_tree(suppliers(spark, sf_dir), block_rows=40))


@query(ORACLE["mst_rows"].replace("AS d2 FROM z\n", "AS d2, NULL::BIGINT AS u, NULL::BIGINT AS v FROM z\n").replace("best.d2 FROM (", "best.d2, best.u, best.v FROM (").replace(", id := b.id)", ", u := least(a.id, b.id), v := greatest(a.id, b.id), id := b.id)").replace("SELECT row_number() OVER (ORDER BY d2) AS rank, round", "SELECT u, v, round"))
def mst_edges(spark, sf_dir):
    """The tree's edges themselves: one total order makes them unique."""
    return spanning_tree(suppliers(spark, sf_dir), block_rows=40).select("u", "v", rounded("dist").alias("dist"))


def ranked_lengths(edges: DataFrame) -> DataFrame:
    return row_numbers(edges.select("dist"), "dist", name="rank").select("rank", rounded("dist").alias("dist"))


ONE_D = "SELECT c_custkey AS id, c_acctbal AS x FROM customer"


@query(f"SELECT row_number() OVER (ORDER BY d) AS rank, round(d, 6) AS dist FROM (SELECT x - lag(x) OVER (ORDER BY x, id) AS d FROM ({ONE_D})) WHERE d IS NOT NULL")
def mst_rows_1d(spark, sf_dir):
    return ranked_lengths(spanning_tree(samples(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"]), block_rows=400))


@query(ORACLE["mst_rows_1d"])
def mst_rows_1d_rounds(spark, sf_dir):
    """The same tree by Boruvka rounds of joins alone: no task holds a group's edges."""
    return ranked_lengths(spanning_tree(samples(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"]), block_rows=400, task_edges=0))


@query("SELECT 0::BIGINT AS differing")
def mst_pruned_equals_naive(spark, sf_dir):
    points = samples(table(spark, sf_dir, "part"), "p_partkey", ["p_retailprice", "p_size"])
    a, b = (cut(spanning_tree(points, block_rows=500, prune=p).select("u", "v")) for p in (True, False))
    return a.subtract(b).unionByName(b.subtract(a)).agg(F.count(F.lit(1)).alias("differing"))


@query("""
WITH RECURSIVE cells AS (SELECT vec_id, i AS f, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
d AS (SELECT a.f AS fa, b.f AS fb, sum((a.v - b.v) * (a.v - b.v)) AS d2 FROM cells a JOIN cells b USING (vec_id) WHERE a.f != b.f GROUP BY ALL),
prim AS (
  SELECT 0 AS step, [1::BIGINT] AS seen, NULL::DOUBLE AS d2
  UNION ALL
  SELECT step + 1, list_append(seen, best.f), best.d2 FROM (
    SELECT p.step, p.seen, (SELECT min(struct_pack(d2 := d.d2, f := d.fb)) FROM d WHERE list_contains(p.seen, fa) AND NOT list_contains(p.seen, fb)) AS best FROM prim p
  ) WHERE best IS NOT NULL
)
SELECT row_number() OVER (ORDER BY d2) AS rank, round(sqrt(d2), 6) AS dist FROM prim WHERE d2 IS NOT NULL
""")
def mst_columns(spark, sf_dir):
    return ranked_lengths(spanning_tree_of_features(vectors(spark, sf_dir), tile=24))


# Weights and rooted trees.


@query(f"WITH {TREE_SQL} SELECT u, v, round(sqrt(dist * dist / avg(dist * dist) OVER ()), 6) AS dist FROM e")
def edge_normalise(spark, sf_dir):
    return weights.normalise(tree_edges(spark, sf_dir)).select("u", "v", rounded("dist").alias("dist"))


@query(f"WITH {TREE_SQL} SELECT median(dist * dist)::DOUBLE AS bandwidth FROM e")
def bandwidth_median(spark, sf_dir):
    return weights.bandwidth(tree_edges(spark, sf_dir)).select("bandwidth")


@query(f"WITH {TREE_SQL} SELECT u, v, round(exp(-dist * dist / 10.0::DOUBLE), 6) AS weight FROM e")
def edge_weights(spark, sf_dir):
    return weights.gaussian(tree_edges(spark, sf_dir), 10.0).select("u", "v", rounded("weight").alias("weight"))


@query(f"WITH {TREE_SQL} SELECT node, count(*) AS n, min(nbr) AS low, max(nbr) AS high, sum(dist)::DOUBLE AS total FROM (SELECT u AS node, v AS nbr, dist FROM e UNION ALL SELECT v, u, dist FROM e) GROUP BY node")
def adjacency(spark, sf_dir):
    rows = weights.adjacency_lists(tree_edges(spark, sf_dir))
    total = F.aggregate("neighbours.dist", F.lit(0.0), lambda s, v: s + v)
    return rows.select("node", F.size("neighbours").cast("bigint").alias("n"), F.array_min("neighbours.nbr").alias("low"), F.array_max("neighbours.nbr").alias("high"), total.alias("total"))


SHAPE_SQL = f"""
WITH RECURSIVE {TREE_SQL}, anc AS (SELECT id, id AS a FROM nodes UNION ALL SELECT anc.id, n.up FROM anc JOIN nodes n ON anc.a = n.id WHERE n.up IS NOT NULL),
size AS (SELECT a AS id, count(*) AS subtree_size FROM anc GROUP BY a),
dep AS (SELECT id, count(*) - 1 AS depth FROM anc GROUP BY id),
kids AS (SELECT up AS id, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
near AS (SELECT e.up AS id, arg_min(s.subtree_size, (e.dist, e.id)) AS nearest FROM e JOIN size s USING (id) GROUP BY e.up),
shape AS (
  SELECT n.id AS node_id, n.up AS parent_id, coalesce(n_children, 0) AS n_children, subtree_size, depth, coalesce(e.dist, 0)::DOUBLE AS dist,
    CASE WHEN n.up IS NULL THEN CASE WHEN n_children = 1 THEN 3 ELSE 4 END ELSE least(coalesce(n_children, 0), 2) END::INTEGER AS node_type,
    CASE WHEN n.up IS NULL THEN CASE WHEN n_children <= 1 THEN 1 ELSE 1 + nearest END ELSE subtree_size END AS side,
    CASE WHEN n.up IS NULL THEN 0 ELSE exp(-e.dist * e.dist / 10.0::DOUBLE) END AS edge_weight, (SELECT count(*) FROM nodes) AS n
  FROM nodes n JOIN size USING (id) JOIN dep USING (id) LEFT JOIN kids USING (id) LEFT JOIN near USING (id) LEFT JOIN e ON e.id = n.id
)
"""


@query(SHAPE_SQL + "SELECT node_id, parent_id, depth, subtree_size FROM shape")
def rooted_tree_rows(spark, sf_dir):
    tree = rooted_tree.with_depth(weighted_tree(spark, sf_dir))
    return tree.select("node_id", "parent_id", F.col("depth").cast("bigint").alias("depth"), "subtree_size")


@query(SHAPE_SQL + "SELECT node_id, parent_id, subtree_size FROM shape")
def rooted_tree_tour(spark, sf_dir):
    """The same tree rooted by its Euler tour in Spark."""
    return rooted_tree.rooted(weights.gaussian(tree_edges(spark, sf_dir), 10.0), task_edges=0).select("node_id", "parent_id", "subtree_size")


@query(SHAPE_SQL + "SELECT node_id, n_children, node_type FROM shape")
def node_types(spark, sf_dir):
    return weighted_tree(spark, sf_dir).select("node_id", "n_children", "node_type")


@query(SHAPE_SQL + "SELECT node_id, subtree_size, least(side, n - side) AS balance FROM shape")
def subtree_balance(spark, sf_dir):
    return weighted_tree(spark, sf_dir).select("node_id", "subtree_size", "balance")


@query(SHAPE_SQL + """, q AS (SELECT quantile_cont(edge_weight, 0.1) AS f FROM shape WHERE least(side, n - side) < 10)
SELECT node_id, round(CASE WHEN least(side, n - side) < 10 AND parent_id IS NOT NULL THEN greatest(edge_weight, f) ELSE edge_weight END, 6) AS edge_weight FROM shape, q""")
def outlier_floor(spark, sf_dir):
    return weights.outlier_floor(weighted_tree(spark, sf_dir)).select("node_id", rounded("edge_weight").alias("edge_weight"))


# Solving and contracting.


def solve_nodes(spark, sf_dir):
    rows = tree_nodes(spark, sf_dir)
    return rows.select("g", "node_id", "parent_id", F.when(F.col("parent_id").isNull(), 0.0).otherwise(1.0).alias("edge_weight"), F.lit(1.0).alias("node_weight"), F.array(F.coalesce("x", F.lit(0.0))).alias("x"))


def _solve_sql(nodes: str) -> str:
    """node_id, theta of the hierarchy tree by bisection, from nodes(id, up, x, l: the bound of the edge to the parent)."""
    return f"""
WITH RECURSIVE p AS ({nodes}),
nb AS (  -- bounds of each nation, by bisection on its derivative with its customers' clipped ones
  SELECT id * 2 + s AS k, id, up, x, CASE s WHEN 0 THEN -l ELSE l END AS target, -1e6::DOUBLE AS lo, 1e6::DOUBLE AS hi, 0 AS step FROM p, (VALUES (0), (1)) v(s) WHERE id >= 2000000
  UNION ALL
  SELECT b.k, any_value(b.id), any_value(b.up), any_value(b.x), any_value(b.target),
    CASE WHEN any_value((lo + hi) / 2 - b.x) + coalesce(sum(greatest(-c.l, least(c.l, (lo + hi) / 2 - c.x))), 0) < any_value(b.target) THEN any_value((lo + hi) / 2) ELSE any_value(lo) END,
    CASE WHEN any_value((lo + hi) / 2 - b.x) + coalesce(sum(greatest(-c.l, least(c.l, (lo + hi) / 2 - c.x))), 0) < any_value(b.target) THEN any_value(hi) ELSE any_value((lo + hi) / 2) END, any_value(step) + 1
  FROM nb b LEFT JOIN p c ON c.up = b.id WHERE step < 70 GROUP BY b.k
),
nation_b AS (SELECT id, any_value(up) AS up, any_value(x) AS x, min(lo) FILTER (target < 0) AS lb, max(lo) FILTER (target > 0) AS ub FROM nb WHERE step = 70 GROUP BY id),
rb AS (
  SELECT id * 2 + s AS k, id, x, CASE s WHEN 0 THEN -l ELSE l END AS target, -1e6::DOUBLE AS lo, 1e6::DOUBLE AS hi, 0 AS step FROM p, (VALUES (0), (1)) v(s) WHERE id >= 1000000 AND id < 2000000
  UNION ALL
  SELECT k, any_value(id), any_value(x), any_value(target), CASE WHEN any_value(mid - x) + coalesce(sum(m), 0) < any_value(target) THEN any_value(mid) ELSE any_value(lo) END,
    CASE WHEN any_value(mid - x) + coalesce(sum(m), 0) < any_value(target) THEN any_value(hi) ELSE any_value(mid) END, any_value(step) + 1
  FROM (
    SELECT b.k, n.id AS nid, any_value(b.id) AS id, any_value(b.x) AS x, any_value(target) AS target, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid, any_value(step) AS step,
      CASE WHEN n.id IS NULL THEN 0 ELSE greatest(-any_value(n.l), least(any_value(n.l), any_value((lo + hi) / 2 - n.x) + coalesce(sum(greatest(-c.l, least(c.l, (lo + hi) / 2 - c.x))), 0))) END AS m
    FROM rb b LEFT JOIN p n ON n.up = b.id LEFT JOIN p c ON c.up = n.id WHERE step < 70 GROUP BY b.k, n.id
  ) GROUP BY k
),
region_b AS (SELECT id, any_value(x) AS x, min(lo) FILTER (target < 0) AS lb, max(lo) FILTER (target > 0) AS ub FROM rb WHERE step = 70 GROUP BY id),
root AS (
  SELECT -1e6::DOUBLE AS lo, 1e6::DOUBLE AS hi, 0 AS step
  UNION ALL
  SELECT CASE WHEN d < 0 THEN mid ELSE lo END, CASE WHEN d < 0 THEN hi ELSE mid END, step + 1 FROM (
    SELECT any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid, any_value(step) AS step, any_value(mid) + sum(greatest(-l, least(l, own + inner_))) AS d FROM (
      SELECT r.id, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid, any_value(step) AS step, any_value(l) AS l, any_value(mid - r.x) AS own, sum(m) AS inner_ FROM (
        SELECT r.id, n.id AS nid, any_value(r.x) AS x, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid, any_value(step) AS step, any_value(r.l) AS l,
          CASE WHEN n.id IS NULL THEN 0 ELSE greatest(-any_value(n.l), least(any_value(n.l), any_value((lo + hi) / 2 - n.x) + coalesce(sum(greatest(-c.l, least(c.l, (lo + hi) / 2 - c.x))), 0))) END AS m
        FROM root CROSS JOIN (SELECT * FROM p WHERE id >= 1000000 AND id < 2000000) r LEFT JOIN p n ON n.up = r.id LEFT JOIN p c ON c.up = n.id WHERE step < 70 GROUP BY r.id, n.id
      ) r GROUP BY r.id
    )
  ) WHERE step IS NOT NULL
),
t0 AS (SELECT lo AS t FROM root WHERE step = 70),
t1 AS (SELECT id, greatest(lb, least(ub, t)) AS t FROM region_b, t0),
t2 AS (SELECT n.id, greatest(lb, least(ub, t1.t)) AS t FROM nation_b n JOIN t1 ON t1.id = n.up),
t3 AS (SELECT c.id, greatest(c.x - c.l, least(c.x + c.l, t2.t)) AS t FROM p c JOIN t2 ON t2.id = c.up WHERE c.id < 1000000 AND c.id >= 0)
SELECT id AS node_id, round(t, 6) + 0.0 AS theta FROM (SELECT -1 AS id, t FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)
"""


@query(f"WITH {TREE_SQL} SELECT * FROM ({_solve_sql('SELECT id, up, coalesce(x, 0) AS x, 500.0::DOUBLE AS l FROM nodes')})")
def tree_solve(spark, sf_dir):
    return fusion.solve(solve_nodes(spark, sf_dir), 500.0).select("node_id", rounded(F.get("theta", F.lit(0))).alias("theta"))


@query(ORACLE["tree_solve"])
def tree_solve_in_pieces(spark, sf_dir):
    """The same solution with no more than about 200 nodes in a task."""
    return fusion.solve(solve_nodes(spark, sf_dir), 500.0, task_cells=200).select("node_id", rounded(F.get("theta", F.lit(0))).alias("theta"))


@query("SELECT (i - 1)::INTEGER AS feature_idx, 0::BIGINT AS violations FROM range(1, 65) t(i)")
def tree_solve_certificate(spark, sf_dir):
    nodes = path.start_nodes(vectors(spark, sf_dir))
    return fusion.certificate(cut(fusion.solve(nodes, 0.02)), nodes, 0.02).select("feature_idx", "violations")


def fused_tree(spark, sf_dir):
    """Customers with a negative balance are fused with their nations, even nations with their regions."""
    fused = F.when(F.col("node_id") < 0, False).when(F.col("node_id") < 1000000, F.col("x") < 0).when(F.col("node_id") >= 2000000, F.col("node_id") % 2 == 0).otherwise(False)
    return tree_nodes(spark, sf_dir).withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn("fused", fused)


FUSED_SQL = f"""
WITH {TREE_SQL}, f AS (
  SELECT id, up, coalesce(x, 0) AS x, CASE WHEN id < 0 THEN false WHEN id < 1000000 THEN coalesce(x, 0) < 0 WHEN id >= 2000000 THEN id % 2 = 0 ELSE false END AS fused FROM nodes
), r AS (SELECT f.id, f.up, f.x, CASE WHEN NOT f.fused THEN f.id WHEN p.fused THEN p.up ELSE p.id END AS rep FROM f LEFT JOIN f p ON p.id = f.up)
"""


@query(FUSED_SQL + "SELECT a.id AS node_id, coalesce(abs(a.x - b.x) <= 100, false) AS fused FROM f a LEFT JOIN f b ON b.id = a.up")
def fused_edges(spark, sf_dir):
    rows = fused_tree(spark, sf_dir).select("g", "node_id", "parent_id", F.array("x").alias("theta"))
    return fusion.fused_edges(rows, 100.0).select("node_id", "fused")


@query(FUSED_SQL + "SELECT id AS node_id, rep AS rep_id FROM r")
def representatives(spark, sf_dir):
    return fusion.representatives(fused_tree(spark, sf_dir)).select("node_id", "rep_id")


@query(FUSED_SQL + "SELECT rep AS rep_id, sum(1 + abs(id) % 3)::DOUBLE AS weight, round(sum(x * (1 + abs(id) % 3)) / sum(1 + abs(id) % 3), 4) + 0.0 AS x FROM r GROUP BY rep")
def contract_nodes(spark, sf_dir):
    rows = fused_tree(spark, sf_dir)
    nodes = rows.select("g", "node_id", (1.0 + F.abs("node_id") % 3).alias("node_weight"), F.array("x").alias("x"))
    return fusion.contract_nodes(nodes, fusion.representatives(rows)).select("rep_id", "weight", rounded(F.get("x", F.lit(0)), 4).alias("x"))


@query(FUSED_SQL + """, k AS (SELECT a.id AS node_id, b.rep AS parent_id, a.x AS edge_weight FROM r a LEFT JOIN r b ON b.id = a.up WHERE a.id = a.rep),
c AS (SELECT parent_id AS node_id, count(*) AS n FROM k WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT node_id, k.parent_id, edge_weight, coalesce(n, 0) AS n_children, (CASE WHEN k.parent_id IS NULL THEN CASE WHEN n = 1 THEN 3 ELSE 4 END ELSE least(coalesce(n, 0), 2) END)::INTEGER AS node_type FROM k LEFT JOIN c USING (node_id)""")
def contract_tree(spark, sf_dir):
    rows = fused_tree(spark, sf_dir)
    tree = rows.select("g", "node_id", "parent_id", F.col("x").alias("edge_weight"))
    return fusion.contract_tree(tree, fusion.representatives(rows)).drop("g")


# Paths.

LAMBDAS = [0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4, 12.8, 25.6, 51.2, 102.4, 1e6]


def supplier_fit(spark, sf_dir) -> tuple[DataFrame, Fit]:
    points = suppliers(spark, sf_dir)
    return points, path.fit_path(points, LAMBDAS)


@query()
def level_counts(spark, sf_dir):
    return path.level_counts(supplier_fit(spark, sf_dir)[1])


@query()
def path_pointers(spark, sf_dir):
    return path.fit_path(vectors(spark, sf_dir), [0.001, 0.01, 0.1, 1.0, 10.0]).pointers.drop("g")


@query("SELECT count(*) AS samples, round(avg(c_acctbal), 4) AS centre FROM customer")
def path_end(spark, sf_dir):
    points = samples(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])
    fit = path.fit_path(points, [1.0, 100.0, 1e12], bandwidth=1e6)  # so wide that no weight vanishes
    end = fit.levels.agg(F.max("level")).first()[0]
    rows = path.expand(points, fit, [end])
    return rows.groupBy(F.round(F.get("theta", F.lit(0)), 4).alias("centre")).agg(F.count(F.lit(1)).alias("samples"))


@query()
def path_expand(spark, sf_dir):
    points, fit = supplier_fit(spark, sf_dir)
    return path.expand(points, fit, [1, 5, 9]).select("level", "sample_id", *(rounded(F.get("theta", F.lit(i))).alias(f"theta{i}") for i in (0, 1)))


@query(f"SELECT min(node_id) AS first, count(*) AS n FROM ({ORACLE['tree_solve']}) GROUP BY theta")
def single_lambda_labels(spark, sf_dir):
    nodes = tree_nodes(spark, sf_dir).select("g", F.col("node_id").alias("sample_id"), F.array(F.coalesce("x", F.lit(0.0))).alias("x"))
    found = path.fit_one(nodes, 500.0, edges=tree_edges(spark, sf_dir), bandwidth=1e15, norm=False)  # so wide that all weights are 1
    return found.groupBy("label").agg(F.min("sample_id").alias("first"), F.count(F.lit(1)).alias("n")).drop("label")


# The hierarchy tree at several penalties, with two features: a node joins its parent where both agree. In SQL a level is
# one bisection a feature over the whole tree, where the edges of those who have joined before have no bound.

TREE_LAMBDAS = [100.0, 500.0, 2000.0, 20000.0, 1e6]
FEATURES = ("coalesce(x, 0)", "abs(coalesce(x, 0))")


def _both(lam: float, x: tuple[str, str], bound: str, source: str) -> str:
    one, two = (_solve_sql(f"SELECT id, up, {v} AS x, {bound} AS l FROM {source}") for v in x)
    return f"SELECT {lam}::DOUBLE AS \"lambda\", a.node_id, a.theta AS t0, b.theta AS t1 FROM ({one}) a JOIN ({two}) b USING (node_id)"


def _tree_path_sql(lambdas) -> str:
    parts = ["f0 AS (SELECT 0 AS level, 0.0::DOUBLE AS \"lambda\", id, up, coalesce(x, 0) AS x, false AS fused FROM nodes)"]
    for k, lam in enumerate(lambdas, 1):
        solved = _both(lam, FEATURES, f"CASE WHEN fused THEN 1e15 ELSE {lam} END::DOUBLE", f"f{k - 1}")
        parts += [
            f"th{k} AS MATERIALIZED ({solved})",
            f"f{k} AS MATERIALIZED (SELECT {k} AS level, a.\"lambda\", n.id, n.up, n.x, coalesce(abs(a.t0 - b.t0) < 1e-5 AND abs(a.t1 - b.t1) < 1e-5, false) AS fused FROM f{k - 1} n JOIN th{k} a ON a.node_id = n.id LEFT JOIN th{k} b ON b.node_id = n.up)",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, len(lambdas) + 1))
    return f"""
WITH RECURSIVE {TREE_SQL}, {", ".join(parts)}, f AS MATERIALIZED ({every}),
rep AS (SELECT level, id, id AS rep FROM f WHERE up IS NULL UNION ALL SELECT f.level, f.id, CASE WHEN f.fused THEN rep.rep ELSE f.id END FROM f JOIN rep ON rep.id = f.up AND rep.level = f.level),
c AS (SELECT level, any_value("lambda") AS "lambda", count(*) FILTER (NOT fused) AS n_out, count(*) AS n FROM f GROUP BY level)
"""


TREE_PATH_SQL = _tree_path_sql(TREE_LAMBDAS)


def tree_points(spark, sf_dir):
    return tree_nodes(spark, sf_dir).select("g", F.col("node_id").alias("sample_id"), F.array(F.coalesce("x", F.lit(0.0)), F.abs(F.coalesce("x", F.lit(0.0)))).alias("x"))


def tree_path(spark, sf_dir, **options) -> tuple[DataFrame, Fit]:
    points = tree_points(spark, sf_dir)
    return points, path.follow(path.start_nodes(points, 1e15, norm=False, edges=tree_edges(spark, sf_dir)), TREE_LAMBDAS, **options)


@query(TREE_PATH_SQL + "SELECT * FROM (SELECT level, \"lambda\", coalesce(lag(n_out) OVER (ORDER BY level), n) AS n_in, n_out FROM c) WHERE n_in > 1")
def tree_path_counts(spark, sf_dir):
    """Levels of a path on a whole tree between its ends, in two features."""
    return path.level_counts(tree_path(spark, sf_dir)[1]).drop("g")


@query(ORACLE["tree_path_counts"])
def tree_path_counts_in_spark(spark, sf_dir):
    """The same levels as Spark jobs; trees of more than 1000 nodes are solved in pieces."""
    return path.level_counts(tree_path(spark, sf_dir, task_cells=0, solve_cells=1000)[1]).drop("g")


@query(TREE_PATH_SQL + "SELECT level, id AS sample_id, rep AS rep_id FROM rep WHERE level <= 4")
def tree_path_clusters(spark, sf_dir):
    """Who is with whom at each level: pointers, followed to their end."""
    points, fit = tree_path(spark, sf_dir)
    each = [path.compose(points, fit.pointers, level).select(F.lit(level).alias("level"), "sample_id", "rep_id") for level in range(1, 5)]
    return reduce(DataFrame.unionByName, each)


@query(TREE_PATH_SQL + """SELECT level, id AS sample_id, round(avg(x) OVER w + 3.3e-7, 5) + 0.0 AS theta0, round(avg(abs(x)) OVER w + 3.3e-7, 5) + 0.0 AS theta1
FROM rep JOIN f USING (level, id) WHERE level <= 4 WINDOW w AS (PARTITION BY level, rep)""")
def tree_path_means(spark, sf_dir):
    """Cluster means at each level; moved a little, so that means of cents don't lie half-way between two rounded values."""
    points, fit = tree_path(spark, sf_dir)
    means = path.expand(points, fit, [1, 2, 3, 4])
    return means.select("level", "sample_id", *(rounded(F.get("theta", F.lit(i)) + 3.3e-7, 5).alias(f"theta{i}") for i in (0, 1)))


@query(f"WITH {TREE_SQL} SELECT \"lambda\", min(node_id) AS first, count(*) AS n FROM ({' UNION ALL '.join(_both(v, FEATURES, f'{v}::DOUBLE', 'nodes') for v in TREE_LAMBDAS)}) GROUP BY \"lambda\", t0, t1")
def several_lambda_labels(spark, sf_dir):
    """Single penalties side by side, in the same jobs."""
    found = path.fit_each(tree_points(spark, sf_dir), TREE_LAMBDAS, edges=tree_edges(spark, sf_dir), bandwidth=1e15, norm=False)
    return found.groupBy("lambda", "label").agg(F.min("sample_id").alias("first"), F.count(F.lit(1)).alias("n")).drop("label")


# A star: all suppliers hang on the first one. Its levels can be solved in closed form: the centre's value is
# where a sum of clipped differences is 0, which is found between two of its breakpoints.

STAR_LAMBDAS = [200.0, 800.0, 2000.0, 1e6]


def star_fit(spark, sf_dir, lambdas=STAR_LAMBDAS, **options) -> tuple[DataFrame, Fit]:
    points = samples(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"])
    centre = points.agg(F.min("sample_id").alias("u"))
    edges = points.crossJoin(F.broadcast(centre)).where("sample_id != u").select("g", "u", F.col("sample_id").alias("v"), F.lit(1.0).alias("dist"))
    return points, path.follow(path.start_nodes(points, 1e15, norm=False, edges=edges), lambdas, **options)


def _star_sql(lambdas) -> str:
    parts = ["WITH l0 AS (SELECT s_suppkey::BIGINT AS id, s_acctbal AS x FROM supplier WHERE s_suppkey > (SELECT min(s_suppkey) FROM supplier))",
             "r0 AS (SELECT s_suppkey::BIGINT AS id, 1.0::DOUBLE AS w, s_acctbal AS m FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier))"]
    for k, lam in enumerate(lambdas, 1):
        i = k - 1
        parts += [
            f"b{k} AS (SELECT x - {lam} AS b FROM l{i} UNION SELECT x + {lam} FROM l{i} UNION SELECT m FROM r{i})",
            f"f{k} AS (SELECT b, any_value(w) * (b - any_value(m)) + sum(greatest(-{lam}, least({lam}, b - x))) AS f FROM b{k}, r{i}, l{i} GROUP BY b)",
            f"lo{k} AS (SELECT b, f FROM f{k} WHERE f <= 0 ORDER BY b DESC LIMIT 1), hi{k} AS (SELECT b, f FROM f{k} WHERE f >= 0 ORDER BY b LIMIT 1)",
            f"t{k} AS (SELECT CASE WHEN a.b = c.b THEN a.b ELSE a.b - a.f * (c.b - a.b) / (c.f - a.f) END AS t FROM lo{k} a, hi{k} c)",
            f"z{k} AS (SELECT id, x FROM l{i}, t{k} WHERE abs(t - x) <= {lam})",
            f"l{k} AS (SELECT id, x FROM l{i} WHERE id NOT IN (SELECT id FROM z{k}))",
            f"r{k} AS (SELECT any_value(r.id) AS id, any_value(w) + count(z.id) AS w, (any_value(w * m) + coalesce(sum(z.x), 0)) / (any_value(w) + count(z.id)) AS m FROM r{i} r LEFT JOIN z{k} z ON true)",
            f"c{k} AS (SELECT {k} AS level, {lam}::DOUBLE AS lambda, (SELECT count(*) FROM l{i}) + 1 AS n_in, (SELECT count(*) FROM l{k}) + 1 AS n_out)",
        ]
    return ", ".join(parts)


STAR_SQL, STAR_LEVELS = _star_sql(STAR_LAMBDAS), range(1, len(STAR_LAMBDAS) + 1)
COUNTS = " UNION ALL ".join(f"SELECT * FROM c{k} WHERE n_in > 1" for k in STAR_LEVELS)
STAR_POINTERS = STAR_SQL + " " + " UNION ALL ".join(
    f"SELECT {k} AS level, id AS node_id, CASE WHEN id IN (SELECT id FROM z{k}) THEN (SELECT id FROM r{k}) ELSE id END AS rep_id FROM (SELECT id FROM l{k - 1} UNION ALL SELECT id FROM r{k - 1}), c{k} WHERE n_in > n_out" for k in STAR_LEVELS
)
STAR_MEANS = STAR_SQL + " " + " UNION ALL ".join(
    f"SELECT {k} AS level, s_suppkey::BIGINT AS sample_id, round(CASE WHEN s_suppkey IN (SELECT id FROM l{k}) THEN s_acctbal ELSE (SELECT m FROM r{k}) END, 5) + 0.0 AS theta FROM supplier" for k in STAR_LEVELS[:3]
)


@query(f"{STAR_SQL} {COUNTS}")
def star_level_counts(spark, sf_dir):
    return path.level_counts(star_fit(spark, sf_dir)[1]).drop("g")


@query(f"{_star_sql([2000.0, 1e6])} SELECT * FROM c1 UNION ALL SELECT * FROM c2")
def star_level_counts_in_spark(spark, sf_dir):
    """Levels as Spark jobs, solved in pieces of about 50 nodes: no task holds the tree."""
    return path.level_counts(star_fit(spark, sf_dir, [2000.0, 1e6], task_cells=0, solve_cells=50)[1]).drop("g")


@query(STAR_POINTERS)
def star_pointers(spark, sf_dir):
    return star_fit(spark, sf_dir)[1].pointers.drop("g")


@query(STAR_MEANS)
def star_expand(spark, sf_dir):
    points, fit = star_fit(spark, sf_dir)
    return path.expand(points, fit, list(STAR_LEVELS[:3])).select("level", "sample_id", rounded(F.get("theta", F.lit(0)), 5).alias("theta"))


@query(STAR_MEANS)
def fit_round_trip(spark, sf_dir):
    """A fit written as tables and read again."""
    points, fit = star_fit(spark, sf_dir)
    folder = f"{cut_dir(spark)}/fit-{uuid.uuid4().hex}"
    write_fit(fit, folder)
    return path.expand(points, read_fit(spark, folder), list(STAR_LEVELS[:3])).select("level", "sample_id", rounded(F.get("theta", F.lit(0)), 5).alias("theta"))


@query()
def lambda_search(spark, sf_dir):
    best, tried = path.search_lambda(suppliers(spark, sf_dir), step=20.0, least_step=2.0)
    return spark.createDataFrame([(best, lam, n) for lam, n in tried], "lambda_max double, lambda double, clusters bigint")


# On the star the clusters at any penalty follow from the centre's value there; the search only looks at multiples
# of 62.5 below its ceiling.
@query("""
WITH RECURSIVE l AS (SELECT s_acctbal AS x FROM supplier WHERE s_suppkey > (SELECT min(s_suppkey) FROM supplier)),
r AS (SELECT s_acctbal AS m FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)),
grid AS (SELECT i * 62.5::DOUBLE AS lam FROM range(1, 225) g(i)),
b AS (SELECT lam, x - lam AS b FROM l, grid UNION SELECT lam, x + lam FROM l, grid UNION SELECT lam, m FROM r, grid),
f AS (SELECT lam, b, any_value(b - m) + sum(greatest(-lam, least(lam, b - x))) AS f FROM b, r, l GROUP BY lam, b),
t AS (
  SELECT lam, CASE WHEN lo = hi THEN lo ELSE lo - flo * (hi - lo) / (fhi - flo) END AS t
  FROM (SELECT lam, max(b) FILTER (f <= 0) AS lo, min(b) FILTER (f >= 0) AS hi, max(f) FILTER (f <= 0) AS flo, min(f) FILTER (f >= 0) AS fhi FROM f GROUP BY lam)
),
n AS (SELECT lam, count(DISTINCT round(greatest(x - lam, least(x + lam, t)), 7)) + max((abs(t - x) > lam)::INTEGER) * 0 AS leaves, bool_or(abs(t - x) <= lam) AS joined FROM t, l GROUP BY lam),
clusters AS (SELECT lam, leaves + CASE WHEN joined THEN 0 ELSE 1 END AS n FROM n),
walk AS (
  SELECT 1 AS i, 1000.0::DOUBLE AS lam, 1000.0::DOUBLE AS stride, false AS collapsed, NULL::BIGINT AS n, false AS done
  UNION ALL
  SELECT i + 1, CASE WHEN c.n > 1 THEN w.lam + s ELSE w.lam - s END, s, w.collapsed OR c.n = 1, c.n, c.n = 1 AND s < 50
  FROM walk w JOIN clusters c ON c.lam = w.lam, LATERAL (SELECT CASE WHEN w.collapsed OR c.n = 1 THEN w.stride / 2 ELSE w.stride END AS s) WHERE NOT done AND w.stride >= 50 AND i < 100
)
SELECT b.lam + b.stride AS lambda_max, a.lam AS lambda, b2.n AS clusters FROM walk a JOIN walk b2 ON b2.i = a.i + 1, (SELECT lam, stride FROM walk ORDER BY i DESC LIMIT 1) b
""")
def star_lambda_search(spark, sf_dir):
    points = samples(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"])
    centre = points.agg(F.min("sample_id").alias("u"))
    edges = points.crossJoin(F.broadcast(centre)).where("sample_id != u").select("g", "u", F.col("sample_id").alias("v"), F.lit(1.0).alias("dist"))
    best, tried = path.search_lambda(points, edges=edges, bandwidth=1e15, norm=False)
    return spark.createDataFrame([(best, lam, n) for lam, n in tried], "lambda_max double, lambda double, clusters bigint")


@query("""
SELECT event_type, count(*)::DOUBLE AS users, round(avg(n), 5) AS n, round(avg(v), 5) AS v FROM (SELECT event_type, user_id, count(*) AS n, coalesce(avg(value), 0) AS v FROM events GROUP BY ALL) GROUP BY event_type
""")
def fit_per_group(spark, sf_dir):
    per_user = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("v"))
    fit = path.group_fits(per_user, "user_id", ["n", "v"], "event_type", [0.5, 5.0, 50.0, 1e12], bandwidth=1e6)  # so wide that no weight vanishes
    end = fit.coordinates.groupBy("g").agg(F.max_by(F.struct("weight", "x"), "level").alias("e"))  # the last level leaves one cluster
    return end.select(F.col("g").alias("event_type"), F.col("e.weight").alias("users"), *(rounded(F.get("e.x", F.lit(i)), 5).alias(c) for i, c in enumerate("nv")))


# Sparse and two-sided fits.


@query("""
WITH RECURSIVE c AS (SELECT i - 1 AS feature_idx, sqrt(sum(embedding[i]::DOUBLE * embedding[i])) AS y FROM embeddings, range(1, 65) t(i) GROUP BY i),
s AS (
  SELECT feature_idx, y, 0 AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS v, 1e308::DOUBLE AS low, 0 AS idle FROM c
  UNION ALL
  SELECT feature_idx, y, i + 1, CASE WHEN idle2 >= 10 THEN x ELSE new_x END, x + (u - x) / t, least(low, loss), idle2 FROM (
    SELECT *, CASE WHEN loss < low THEN u ELSE x END AS new_x, CASE WHEN loss < low THEN 0 ELSE idle + 1 END AS idle2 FROM (
      SELECT *, ((1 - u) * y) ** 2 / 2 + 0.5 * abs(u) * y AS loss FROM (
        SELECT *, step * greatest(0, 1 - 0.5 / (abs(step) * y)) AS u FROM (SELECT *, 2.0::DOUBLE / (i + 2) AS t, ((1 - 2.0::DOUBLE / (i + 2)) * x + 2.0::DOUBLE / (i + 2) * v + 1) / 2 AS step FROM s WHERE i < 100 AND idle < 10)
      )
    )
  )
)
SELECT feature_idx, round(arg_max(x, i), 6) + 0.0 AS factor FROM s GROUP BY feature_idx
""")
def column_shrink(spark, sf_dir):
    return sparse.column_shrink(matrices.transpose(vectors(spark, sf_dir)), 0.5).select(F.col("feature_idx").cast("bigint").alias("feature_idx"), rounded("factor").alias("factor"))


HALVED = "WITH r AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, list_transform(embedding, lambda v: v::DOUBLE / 2) AS u FROM embeddings), f AS (SELECT range AS i FROM range(1, 65))"


def halved(spark, sf_dir):
    return vectors(spark, sf_dir).withColumnRenamed("sample_id", "node_id").withColumn("u", F.transform("x", lambda v: v / 2))


@query(HALVED + """, a AS (SELECT vec_id, sum((x[i] - u[i]) ** 2) / 2 AS e, sqrt(sum(u[i] ** 2)) AS n FROM r, f GROUP BY vec_id),
b AS (SELECT vec_id, sum(abs(u[f.i] - u[g.i])) AS d FROM r, f, f g WHERE f.i < g.i GROUP BY vec_id)
SELECT round(sum(e + 2 * d + 3 * n), 4) AS loss FROM a JOIN b USING (vec_id)""")
def sparse_loss(spark, sf_dir):
    return sparse.sparse_objective(halved(spark, sf_dir), 2.0, 3.0).select(F.round("loss", 4).alias("loss"))


@query(HALVED + """, a AS (SELECT sum((x[i] - u[i]) ** 2) / 2 AS e FROM r, f), b AS (SELECT sum(abs(u[f.i] - u[g.i])) AS d FROM r, f, f g WHERE f.i < g.i),
c AS (SELECT sum(abs(r.u[i] - s.u[i])) AS d FROM r, r s, f WHERE r.vec_id < s.vec_id)
SELECT round(a.e + 2 * b.d + 3 * c.d, 3) AS loss FROM a, b, c""")
def bi_loss(spark, sf_dir):
    return bicluster.bi_objective(halved(spark, sf_dir), 2.0, 3.0).select(F.round("loss", 3).alias("loss"))


@query("SELECT (i - 1)::INTEGER AS feature_idx FROM embeddings, range(1, 65) t(i) GROUP BY i HAVING sum(CASE WHEN i % 3 = 0 THEN 0 ELSE embedding[i]::DOUBLE END) != 0")
def nonzero_features(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("u", F.transform("x", lambda v, i: F.when((i + 1) % 3 == 0, 0.0).otherwise(v)))
    return sparse.nonzero_features(rows)


@query()
def sparse_path(spark, sf_dir):
    return sparse.fit_sparse(vectors(spark, sf_dir), [0.01, 0.1, 1.0], [0.2, 0.4, 0.8]).levels.drop("g")


@query()
def sparse_features(spark, sf_dir):
    points = vectors(spark, sf_dir)
    fit = sparse.fit_sparse(points, [0.01, 0.1], [0.3, 0.45])
    wide = sparse.expand_features(path.expand(points, fit, [1, 2]), fit.features, 64)
    return wide.groupBy("level").agg(F.max(F.size(F.filter("theta", lambda v: v.isNotNull()))).alias("features"), F.count(F.lit(1)).alias("samples"))


@query()
def bi_path(spark, sf_dir):
    return bicluster.fit_bi(vectors(spark, sf_dir), [0.1, 1.0], [0.1, 1.0]).levels.drop("g")


@query()
def bi_expand(spark, sf_dir):
    points = vectors(spark, sf_dir)
    fit = bicluster.fit_bi(points, [0.5], [0.5])
    return bicluster.expand_blocks(points, fit, 1).groupBy(rounded("theta").alias("theta")).agg(F.count(F.lit(1)).alias("cells"))


# With one of the two penalties at 0, or so large that it leaves one value, the alternation has a closed form.

COLUMNS_SQL = "c AS (SELECT (i - 1)::INTEGER AS feature_idx, sqrt(sum(embedding[i]::DOUBLE ** 2)) AS norm, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i)"
LOW, HIGH = "(SELECT quantile_disc(norm, 0.25) + 1e-9 FROM c)", "(SELECT quantile_disc(norm, 0.75) + 1e-9 FROM c)"


def norm_quantiles(spark, sf_dir) -> list[float]:
    norms = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.sqrt(F.sum(F.col("v").cast("double") ** 2)).alias("n"))
    return [q + 1e-9 for q in norms.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY n)").alias("a"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY n)").alias("b")).first()]


def shrunk_fit(spark, sf_dir) -> tuple[DataFrame, Fit]:
    """Nothing fuses, and the shrinkage's recursion leaves columns with a norm above twice gamma."""
    points = vectors(spark, sf_dir)
    return points, sparse.fit_sparse(points, [0.0, 0.0], [q / 2 for q in norm_quantiles(spark, sf_dir)])


@query(f"WITH {COLUMNS_SQL}, n AS (SELECT count(*) AS n FROM embeddings) SELECT level, 0.0::DOUBLE AS lambda, n AS n_in, n AS n_out, features FROM n, (SELECT 1 AS level, count(*) FILTER (norm > {LOW}) AS features FROM c UNION ALL SELECT 2, count(*) FILTER (norm > {HIGH}) FROM c)")
def sparse_levels_shrunk(spark, sf_dir):
    _, fit = shrunk_fit(spark, sf_dir)
    return fit.levels.join(fit.features.groupBy("level").agg(F.count(F.lit(1)).alias("features")), "level").select("level", "lambda", "n_in", "n_out", "features")


@query(f"WITH {COLUMNS_SQL} SELECT level, feature_idx FROM (SELECT 1 AS level, feature_idx FROM c WHERE norm > {LOW} UNION ALL SELECT 2, feature_idx FROM c WHERE norm > {HIGH})")
def sparse_kept_features(spark, sf_dir):
    return shrunk_fit(spark, sf_dir)[1].features.select("level", "feature_idx")


@query(f"WITH {COLUMNS_SQL} SELECT vec_id, feature_idx, round(CASE WHEN norm > {HIGH} THEN embedding[feature_idx + 1]::DOUBLE END, 5) + 0.0 AS theta FROM embeddings, c")
def sparse_expand(spark, sf_dir):
    points, fit = shrunk_fit(spark, sf_dir)
    wide = sparse.expand_features(path.expand(points, fit, [2]), fit.features, 64)
    return wide.select(F.col("sample_id").alias("vec_id"), F.posexplode("theta").alias("feature_idx", "theta")).withColumn("theta", rounded("theta", 5))


@query(f"WITH {COLUMNS_SQL} SELECT 1::BIGINT AS n_out, (SELECT count(*) FROM embeddings)::DOUBLE AS weight, feature_idx, round(mean, 5) + 0.0 AS mean FROM c")
def sparse_fused(spark, sf_dir):
    """All rows fuse and nothing is shrunk."""
    return fused_means(spark, sf_dir)


def fused_means(spark, sf_dir, **options) -> DataFrame:
    fit = sparse.fit_sparse(vectors(spark, sf_dir), [1e9], [0.0], bandwidth=1e6, **options)
    kept = row_numbers(fit.features.select("feature_idx"), "feature_idx")
    cells = fit.coordinates.select("weight", F.posexplode("x").alias("i", "mean")).join(kept, F.col("i") + 1 == F.col("pos"))
    return cells.crossJoin(fit.levels.select("n_out")).select("n_out", "weight", "feature_idx", rounded("mean", 5).alias("mean"))


@query("SELECT s AS side, n AS nodes, n - 1 AS edges, 1::BIGINT AS roots FROM (SELECT 's' AS s, count(*) AS n FROM embeddings UNION ALL SELECT 'f', max(len(embedding)) FROM embeddings)")
def bi_tree_sizes(spark, sf_dir):
    rows, columns = bicluster.bi_trees(vectors(spark, sf_dir))
    both = rows.select(F.lit("s").alias("side"), "parent_id").unionByName(columns.select(F.lit("f").alias("side"), "parent_id"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("nodes"), F.count("parent_id").alias("edges"), F.count(F.when(F.col("parent_id").isNull(), 1)).alias("roots"))


@query(ORACLE["mst_columns"].replace("SELECT row_number() OVER (ORDER BY d2) AS rank, round(sqrt(d2), 6) AS dist FROM prim WHERE d2 IS NOT NULL", "SELECT row_number() OVER (ORDER BY d2 DESC) AS rank, round(exp(-d2 / (SELECT median(d2) FROM prim)), 6) AS weight FROM prim WHERE d2 IS NOT NULL"))
def bi_tree_weights(spark, sf_dir):
    """The features' tree of a two-sided fit, its weights not lifted (the floor is their smallest)."""
    columns = bicluster.bi_trees(vectors(spark, sf_dir), prob_thresh=0.0, depth_f=0)[1].where("parent_id is not null")
    return row_numbers(columns.select("edge_weight"), "edge_weight", name="rank").select("rank", rounded("edge_weight").alias("weight"))


def bi_means(spark, sf_dir, lam: float, gamma: float, **options) -> DataFrame:
    points = vectors(spark, sf_dir)
    fit = bicluster.fit_bi(points, [lam], [gamma], bandwidth_s=1e6, bandwidth_f=1e6, **options)  # so wide that no weight vanishes
    return bicluster.expand_blocks(points, fit, 1)


@query("SELECT (i - 1)::BIGINT AS feature_idx, count(*) AS cells, round(avg(embedding[i]::DOUBLE), 5) + 0.0 AS low, round(avg(embedding[i]::DOUBLE), 5) + 0.0 AS high FROM embeddings, range(1, 65) t(i) GROUP BY i")
def bi_rows_fused(spark, sf_dir):
    """All samples fuse and no feature does: a cell is its column's mean."""
    return bi_means(spark, sf_dir, 1e9, 0.0).groupBy("feature_idx").agg(F.count(F.lit(1)).alias("cells"), rounded(F.min("theta"), 5).alias("low"), rounded(F.max("theta"), 5).alias("high"))


@query("SELECT vec_id AS sample_id, 64::BIGINT AS cells, round(m, 5) + 0.0 AS low, round(m, 5) + 0.0 AS high FROM (SELECT vec_id, list_avg(list_transform(embedding, lambda v: v::DOUBLE)) AS m FROM embeddings)")
def bi_columns_fused(spark, sf_dir):
    """All features fuse and no sample does: a cell is its row's mean."""
    return bi_means(spark, sf_dir, 0.0, 1e9).groupBy("sample_id").agg(F.count(F.lit(1)).alias("cells"), rounded(F.min("theta"), 5).alias("low"), rounded(F.max("theta"), 5).alias("high"))


@query("SELECT count(*) AS cells, round(avg(v), 6) + 0.0 AS low, round(avg(v), 6) + 0.0 AS high FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)")
def bi_all_fused(spark, sf_dir):
    return bi_means(spark, sf_dir, 1e9, 1e9).agg(F.count(F.lit(1)).alias("cells"), rounded(F.min("theta")).alias("low"), rounded(F.max("theta")).alias("high"))


@query(ORACLE["bi_rows_fused"])
def bi_rows_fused_in_spark(spark, sf_dir):
    """The same with alternations as Spark jobs: no task holds the matrix."""
    return bi_means(spark, sf_dir, 1e9, 0.0, task_cells=0).groupBy("feature_idx").agg(F.count(F.lit(1)).alias("cells"), rounded(F.min("theta"), 5).alias("low"), rounded(F.max("theta"), 5).alias("high"))


@query(ORACLE["sparse_fused"])
def sparse_fused_in_spark(spark, sf_dir):
    """The same with alternations as Spark jobs: a task holds the tree and a block of features."""
    return fused_means(spark, sf_dir, task_cells=0)


def vectors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), F.col("label"))


NORMS_SQL = "n AS (SELECT label, (i - 1)::INTEGER AS feature_idx, sqrt(sum(embedding[i]::DOUBLE ** 2)) AS norm FROM embeddings, range(1, 65) t(i) GROUP BY label, i)"


@query(f"WITH {NORMS_SQL} SELECT label, feature_idx FROM n WHERE norm > (SELECT quantile_disc(norm, 0.5) + 1e-9 FROM n)")
def sparse_features_per_group(spark, sf_dir):
    """A fit for each label of the vectors, all at once: nothing fuses, and each loses features of its own."""
    norms = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.sqrt(F.sum(F.col("v").cast("double") ** 2)).alias("n"))
    middle = norms.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)")).first()[0] + 1e-9
    fit = sparse.fit_sparse(vectors_by_label(spark, sf_dir), [0.0], [middle / 2])
    return fit.features.select(F.col("g").alias("label"), "feature_idx")


@query("SELECT label, (i - 1)::BIGINT AS feature_idx, count(*) AS cells, round(avg(embedding[i]::DOUBLE), 5) + 0.0 AS low, round(avg(embedding[i]::DOUBLE), 5) + 0.0 AS high FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def bi_rows_fused_per_group(spark, sf_dir):
    """A two-sided fit for each label: the samples of a label fuse and no feature does."""
    points = vectors_by_label(spark, sf_dir)
    fit = bicluster.fit_bi(points, [1e9], [0.0], bandwidth_s=1e6, bandwidth_f=1e6)
    cells = bicluster.expand_blocks(points, fit, 1).groupBy(F.col("g").alias("label"), "feature_idx")
    return cells.agg(F.count(F.lit(1)).alias("cells"), rounded(F.min("theta"), 5).alias("low"), rounded(F.max("theta"), 5).alias("high"))


# Labels and hierarchies, on pointers that follow the hierarchy tree: customers to nations to regions to the root.


def tree_fit(spark, sf_dir) -> Fit:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.col("c_nationkey").alias("n")).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r")), "n")
    by_n, by_r = c.groupBy("n").agg(F.min("k").alias("kn"), F.min("r").alias("r")), c.groupBy("r").agg(F.min("k").alias("kr"))
    top = c.agg(F.min("k").alias("k0"))
    g, level = F.lit(0).alias("g"), lambda i: F.lit(i).alias("level")
    p1 = c.join(by_n.drop("r"), "n").select(g, level(1), F.col("k").alias("node_id"), F.col("kn").alias("rep_id"))
    p2 = by_n.join(by_r, "r").select(g, level(2), F.col("kn").alias("node_id"), F.col("kr").alias("rep_id"))
    p3 = by_r.join(top).select(g, level(3), F.col("kr").alias("node_id"), F.col("k0").alias("rep_id"))
    pointers = cut(p1.unionByName(p2).unionByName(p3))
    counts = pointers.groupBy("g", "level").agg(F.count(F.lit(1)).alias("n_in"), F.countDistinct("rep_id").alias("n_out"))
    levels = cut(counts.select("g", "level", (F.col("level") * 10.0).cast("double").alias("lambda"), F.lit(None).cast("double").alias("gamma"), "n_in", "n_out"))
    return Fit(levels, pointers, None)


CUSTOMERS = "c AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, c_mktsegment AS seg, c_acctbal AS bal FROM customer JOIN nation ON n_nationkey = c_nationkey)"
FIT_SQL = f"""
WITH {CUSTOMERS}, bn AS (SELECT n, min(k) AS kn, min(r) AS r FROM c GROUP BY n), br AS (SELECT r, min(k) AS kr FROM c GROUP BY r),
ptr AS (
  SELECT 1 AS level, k AS node_id, kn AS rep_id FROM c JOIN bn USING (n)
  UNION ALL SELECT 2, kn, kr FROM bn JOIN br USING (r) UNION ALL SELECT 3, kr, (SELECT min(k) FROM c) FROM br
)
"""


def customers(spark, sf_dir):
    return samples(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])


@query(FIT_SQL + "SELECT node_id, (SELECT min(kn) FROM bn) AS rep_id, 3 AS level, 40.0::DOUBLE AS height FROM (SELECT DISTINCT rep_id AS node_id FROM ptr WHERE level = 2)")
def force_merge(spark, sf_dir):
    fit = tree_fit(spark, sf_dir)
    short = Fit(fit.levels.where("level <= 2"), fit.pointers.where("level <= 2"), None)
    whole = hierarchy.force_merge(short, 2.0)
    return whole.pointers.where("level = 3").join(whole.levels.select("level", F.col("lambda").alias("height")), "level").select("node_id", "rep_id", "level", "height")


@query(FIT_SQL + ", l AS (SELECT level, count(*) AS n FROM ptr GROUP BY level) SELECT greatest(1, least(coalesce(min(level) FILTER (n < 100), max(level)), max(level) - 1))::INTEGER AS level FROM l")
def start_level(spark, sf_dir):
    return hierarchy.start_level(tree_fit(spark, sf_dir).levels).select(F.col("level").cast("int").alias("level"))


@query(FIT_SQL + "SELECT k AS sample_id, kr AS rep_id FROM c JOIN br USING (r)")
def compose_pointers(spark, sf_dir):
    return path.compose(customers(spark, sf_dir), tree_fit(spark, sf_dir).pointers, 2).select("sample_id", "rep_id")


@query(FIT_SQL + "SELECT k AS sample_id, label FROM c JOIN (SELECT r, row_number() OVER (ORDER BY kr)::INTEGER AS label FROM br) USING (r)")
def labels_small_k(spark, sf_dir):
    return hierarchy.labels(customers(spark, sf_dir), tree_fit(spark, sf_dir), 5).select("sample_id", "label")


@query(FIT_SQL + "SELECT k AS sample_id, label FROM c JOIN (SELECT n, row_number() OVER (ORDER BY kn)::INTEGER AS label FROM bn) USING (n)")
def labels_large_k(spark, sf_dir):
    return hierarchy.many_labels(customers(spark, sf_dir), tree_fit(spark, sf_dir), 20).select("sample_id", "label")


MERGES = FIT_SQL + """, leaf AS (SELECT kn, row_number() OVER (ORDER BY kn) AS leaf FROM bn),
m2 AS (SELECT kr, kn, leaf, row_number() OVER (PARTITION BY kr ORDER BY kn) AS i, count(*) OVER (PARTITION BY kr) AS m FROM bn JOIN br USING (r) JOIN leaf USING (kn)),
e2 AS (SELECT kr, m, sum(m - 1) OVER (ORDER BY kr) AS last FROM (SELECT DISTINCT kr, m FROM m2)),
s2 AS (
  SELECT last - m2.m + 1 + (CASE WHEN i = 1 THEN 1 ELSE i - 1 END) AS step, -leaf AS l, CASE WHEN i = 1 THEN -lead(leaf) OVER (PARTITION BY kr ORDER BY i) ELSE last - m2.m + i - 1 END AS r, 20.0::DOUBLE AS height
  FROM m2 JOIN e2 USING (kr) QUALIFY i != 2 AND m2.m > 1
), top AS (
  SELECT kr, coalesce(CASE WHEN m > 1 THEN last END, -(SELECT leaf FROM leaf WHERE kn = kr)) AS name FROM e2
), n3 AS (SELECT kr, name, name = max(name) OVER () AS base, max(name) OVER () AS big FROM top),
s3 AS (
  SELECT (SELECT max(step) FROM s2) + row_number() OVER (ORDER BY kr) AS step, name AS l, CASE WHEN row_number() OVER (ORDER BY kr) = 1 THEN big ELSE (SELECT max(step) FROM s2) + row_number() OVER (ORDER BY kr) - 1 END AS r, 30.0::DOUBLE AS height
  FROM n3 WHERE NOT base
), merges AS (SELECT * FROM s2 UNION ALL SELECT * FROM s3)
"""


def tree_merges(spark, sf_dir):
    fit = tree_fit(spark, sf_dir)
    after = fit.levels.select("g").distinct().withColumn("level", F.lit(1))
    return hierarchy.merge_table(fit.pointers, fit.levels, after)


@query(MERGES + "SELECT step::BIGINT AS step, l::BIGINT AS \"left\", r::BIGINT AS \"right\", height FROM merges")
def merge_table(spark, sf_dir):
    return tree_merges(spark, sf_dir).select("step", "left", "right", "height")


@query(MERGES.replace("WITH c AS", "WITH RECURSIVE c AS") + """, walk AS (
  SELECT max(step) AS node, 'a' AS way FROM merges
  UNION ALL SELECT CASE side WHEN 'a' THEN l ELSE r END, way || side FROM walk JOIN merges ON step = node, (VALUES ('a'), ('b')) v(side)
)
SELECT row_number() OVER (ORDER BY way)::INTEGER AS pos, (-node)::BIGINT AS leaf FROM walk WHERE node < 0""")
def leaf_order(spark, sf_dir):
    return hierarchy.leaf_order(tree_merges(spark, sf_dir)).select("pos", "leaf")


@query(ORACLE["leaf_order"])
def leaf_order_by_joins(spark, sf_dir):
    """The same order with no task that holds a group's merges."""
    return hierarchy.leaf_order(tree_merges(spark, sf_dir), task_merges=0).select("pos", "leaf")


@query(MERGES.replace("WITH c AS", "WITH RECURSIVE c AS") + """, walk AS (
  SELECT max(step) AS node, 'a' AS way FROM merges
  UNION ALL SELECT CASE side WHEN 'a' THEN l ELSE r END, way || side FROM walk JOIN merges ON step = node, (VALUES ('a'), ('b')) v(side)
)
SELECT row_number() OVER (ORDER BY way)::INTEGER AS pos, r AS label FROM walk JOIN leaf ON leaf = -node JOIN bn USING (kn)""")
def leaf_labels(spark, sf_dir):
    names = tree_fit(spark, sf_dir).pointers.where("level = 2").select("g", "node_id")
    region = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("node_id"), F.col("n_regionkey").alias("label"))
    leaves = names.withColumn("leaf", F.row_number().over(Window.partitionBy("g").orderBy("node_id")).cast("bigint")).join(region, "node_id")
    return hierarchy.leaf_labels(hierarchy.leaf_order(tree_merges(spark, sf_dir)), leaves).select("pos", "label")


@query(f"WITH {CUSTOMERS}, t AS (SELECT n, seg, count(*) AS m, min(k) AS f FROM c GROUP BY ALL) SELECT n::BIGINT AS nation, arg_min(seg, struct_pack(a := -m, b := f)) AS mode FROM t GROUP BY n")
def cluster_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), "c_mktsegment", "c_custkey")
    return hierarchy.mode(rows, ["nation"], "c_mktsegment", "c_custkey")


@query(FIT_SQL + """, t AS (SELECT kr, seg, count(*) AS m, min(k) AS f FROM c JOIN br USING (r) GROUP BY ALL), md AS (SELECT kr, arg_min(seg, struct_pack(a := -m, b := f)) AS mode FROM t GROUP BY kr)
SELECT kr AS rep_id, count(*) AS n, round(avg(bal), 6) AS x, any_value(mode) AS mode FROM c JOIN br USING (r) JOIN md USING (kr) GROUP BY kr""")
def cluster_summary(spark, sf_dir):
    truth = table(spark, sf_dir, "customer").select(F.lit(0).alias("g"), F.col("c_custkey").cast("bigint").alias("sample_id"), F.col("c_mktsegment").alias("label"))
    found, _, _ = hierarchy.summary(customers(spark, sf_dir), truth, tree_fit(spark, sf_dir))
    return found.select("rep_id", "n", rounded(F.get("x", F.lit(0))).alias("x"), "mode")


@query(FIT_SQL + "SELECT k AS sample_id, greatest(1, i - 2)::INTEGER AS label FROM c JOIN (SELECT r, row_number() OVER (ORDER BY kr) AS i FROM br) USING (r)")
def summary_labels(spark, sf_dir):
    """The start level's five regions cut into three: the first three are merged first."""
    truth = table(spark, sf_dir, "customer").select(F.lit(0).alias("g"), F.col("c_custkey").cast("bigint").alias("sample_id"), F.col("c_mktsegment").alias("label"))
    return hierarchy.summary(customers(spark, sf_dir), truth, tree_fit(spark, sf_dir), k=3)[2].select("sample_id", "label")


@query(MERGES + "SELECT step::BIGINT AS step, round(ln(height) / ln(10), 6) AS height FROM merges")
def log_heights(spark, sf_dir):
    return hierarchy.log_heights(tree_merges(spark, sf_dir), 10.0).select("step", rounded("height").alias("height"))


@query("WITH t AS (SELECT label, (label * 3 + 1) % 10 AS found, vec_id % 7 = 0 AS wrong FROM embeddings) SELECT round(1 - avg(wrong::INTEGER), 6) AS accuracy FROM t")
def label_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("g"), F.col("vec_id").alias("sample_id"), "label")
    found = rows.withColumn("label", F.when(F.col("sample_id") % 7 == 0, F.lit(99)).otherwise((F.col("label") * 3 + 1) % 10))
    return evaluate.accuracy(found, rows).select(F.round("accuracy", 6).alias("accuracy"))

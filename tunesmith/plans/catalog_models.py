"""Surrogate-model queries. M2's aggregation and the least-squares model (M5) are checked by SQL; fits of trees and
processes are rows-only, with invariants in tests/test_models.py.

Histories are aggregates of lineitem per part setting (the trial-history role); candidates are
the whole part grid.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunesmith.operators import space as G
from tunesmith.operators import surrogate as M
from tunesmith.plans.catalog_space import PART_DIMS, SPACE_SQL, part_candidates, part_settings, part_space
from tunesmith.plans.registry import query
from tunesmith.session import materialize
from tunesmith.sources.tables import table


def ix_features(df: DataFrame, ix: str = "ix", out: str = "features") -> DataFrame:
    """Encoded setting (value positions) as the model feature vector (as the reference's converter)."""
    return df.withColumn(out, array_to_vector(F.transform(ix, lambda x: x.cast("double"))))


def setting_history(spark: SparkSession, sf_dir: str, sp: G.Space, dims: list[str], label) -> DataFrame:
    """One history row per setting of ``dims``: the mean of ``label`` over its lineitems."""
    part = table(spark, sf_dir, "part").select("p_partkey", *[F.col(c).cast("string").alias(c) for c in dims])
    li = table(spark, sf_dir, "lineitem")
    j = li.join(part, li["l_partkey"] == part["p_partkey"])
    agg = j.groupBy(*dims).agg(F.avg(label).alias("label"))
    return ix_features(G.encode(agg, sp, dims))


def _sub_space(spark, sf_dir, dims):
    return G.load_space(G.space_from_columns(table(spark, sf_dir, "part"), "part", dims), "part")


@query("forest_mu_sigma")
def forest_mu_sigma(spark, sf_dir):
    """M1 + M2: 100-tree forest on the per-setting history; mu and sigma for every grid setting."""
    sp = G.load_space(part_space(spark, sf_dir), "part")
    hist = setting_history(spark, sf_dir, sp, ["p_brand", "p_type", "p_size"], F.col("l_discount") * 10)
    model = M.forest_regressor().fit(hist)
    grid = ix_features(G.enumerate_grid(spark, sp))
    return M.forest_mu_sigma(model, grid)


LEAF_SQL = "WITH " + SPACE_SQL + """,
c AS (SELECT e.p_partkey, e.i0, e.i1, e.i2, avg(l.l_discount) * 10 AS y FROM enc e JOIN lineitem l ON l.l_partkey = e.p_partkey
      GROUP BY e.p_partkey, e.i0, e.i1, e.i2),
f0 AS (SELECT i0, avg(y) AS m, var_pop(y) AS v FROM c GROUP BY i0), f1 AS (SELECT i1, avg(y) AS m, var_pop(y) AS v FROM c GROUP BY i1),
f2 AS (SELECT i2, avg(y) AS m, var_pop(y) AS v FROM c GROUP BY i2),
x AS (SELECT p_partkey, (f0.m + f1.m + f2.m) / 3 AS mu, (f0.v + f0.m * f0.m + f1.v + f1.m * f1.m + f2.v + f2.m * f2.m) / 3 AS sq
      FROM c JOIN f0 USING (i0) JOIN f1 USING (i1) JOIN f2 USING (i2))
SELECT p_partkey, round(mu, 6) AS mu, round(sqrt(greatest(sq - mu * mu, 0)), 6) AS sigma FROM x"""


@query("leaf_mu_sigma", LEAF_SQL)
def leaf_mu_sigma(spark, sf_dir):
    """M2 on a given leaf table: three trees that split parts by brand, type and size; a part's mu and sigma from its leaves."""
    sp = G.load_space(part_space(spark, sf_dir), "part")
    mu = part_candidates(spark, sf_dir).select(F.col("grid_id").alias("p_partkey"), F.col("mu").alias("y"))
    parts = materialize(part_settings(spark, sf_dir, sp).select("p_partkey", "ix").join(mu, "p_partkey"), "leaf-parts")
    cells = parts.select(F.posexplode("ix").alias("tree", "value"), "y")
    leaves = cells.groupBy("tree", "value").agg(F.avg("y").alias("leaf_mean"), F.var_pop("y").alias("leaf_var"))
    # leaves of a tree are numbered without gaps, though not every value has parts
    number = F.row_number().over(Window.partitionBy("tree").orderBy("value")) - 1  # rows: values of one dimension
    leaves = materialize(leaves.withColumn("leaf_ix", number), "leaves")
    numbers = leaves.select("tree", "value", "leaf_ix")
    at = parts.select("p_partkey", F.posexplode("ix").alias("tree", "value")).join(numbers, ["tree", "value"])
    assigned = at.groupBy("p_partkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", "leaf_ix"))), lambda x: x["leaf_ix"]).alias("leaf"))
    found = M.mu_sigma_of_leaves(assigned, M.shared_leaves(leaves, len(PART_DIMS)), "p_partkey")
    return found.select("p_partkey", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


TIME_DIMS = PART_DIMS


def _normal_equations_sql() -> str:
    """Least squares of three inputs by the normal equations of the centred columns (inverse by cofactors)."""
    s = {(a, b): f"s{min(a, b)}{max(a, b)}" for a in range(3) for b in range(3)}

    def cof(i, j):
        r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        return f"({'-' if (i + j) % 2 else ''}({s[r[0], c[0]]} * {s[r[1], c[1]]} - {s[r[0], c[1]]} * {s[r[1], c[0]]}))"

    covs = ", ".join([f"covar_pop(i{a}, i{b}) AS s{a}{b}" for a in range(3) for b in range(a, 3)] + [f"covar_pop(i{a}, y) AS c{a}" for a in range(3)]
                     + [f"avg(i{a}) AS a{a}" for a in range(3)] + ["avg(y) AS ay"])
    det = " + ".join(f"{s[0, j]} * {cof(0, j)}" for j in range(3))
    betas = ", ".join(f"({' + '.join(f'{cof(j, i)} * c{j}' for j in range(3))}) / ({det}) AS b{i}" for i in range(3))
    return "WITH " + SPACE_SQL + f""",
h AS (SELECT e.i0, e.i1, e.i2, avg(l.l_quantity / 10) AS y FROM enc e JOIN lineitem l ON l.l_partkey = e.p_partkey GROUP BY e.i0, e.i1, e.i2),
m AS (SELECT {covs} FROM h),
b AS (SELECT *, {betas} FROM m),
d AS (SELECT g.grid_id, (g.grid_id // sb.stride) % sb.len AS i0, (g.grid_id // st.stride) % st.len AS i1, (g.grid_id // ss.stride) % ss.len AS i2
      FROM g, strides sb, strides st, strides ss WHERE sb.dim = 0 AND st.dim = 1 AND ss.dim = 2)
SELECT grid_id, round(ay + b0 * (i0 - a0) + b1 * (i1 - a1) + b2 * (i2 - a2), 6) AS seconds FROM d, b"""


def _time_fit(spark, sf_dir, regressor):
    sp = _sub_space(spark, sf_dir, TIME_DIMS)
    hist = setting_history(spark, sf_dir, sp, TIME_DIMS, F.col("l_quantity") / 10)
    hist = M.held(hist)
    model = regressor.fit(hist)
    hist.unpersist()
    grid = ix_features(G.enumerate_grid(spark, sp))
    return model.transform(grid).select("grid_id", F.col("prediction").alias("seconds"))


@query("linear_time_model", _normal_equations_sql())
def linear_time_model(spark, sf_dir):
    """M5: least-squares time model on the per-setting history, predicted for the whole grid."""
    return _time_fit(spark, sf_dir, M.linear_regressor()).withColumn("seconds", F.round("seconds", 6))


@query("boosted_time_model")
def boosted_time_model(spark, sf_dir):
    """M6: gradient-boosted time model (100 rounds, depth 20, min leaf 3) on the same history."""
    return _time_fit(spark, sf_dir, M.boosted_regressor())


@query("extra_trees_mu_sigma")
def extra_trees_mu_sigma(spark, sf_dir):
    """M3 (+M2 law of total variance): extra-trees surrogate on the per-setting history, every grid setting."""
    sp = G.load_space(part_space(spark, sf_dir), "part")
    hist = setting_history(spark, sf_dir, sp, ["p_brand", "p_type", "p_size"], F.col("l_discount") * 10)
    model = M.fit_score_surrogate("extra forest", hist, "label")
    return model.mu_sigma(ix_features(G.enumerate_grid(spark, sp)))


@query("gp_mu_sigma")
def gp_mu_sigma(spark, sf_dir):
    """M4: Gaussian process (constant x Matern-5/2 ARD, 2 restarts) on the per-(brand, type)
    history (its learner works on one task's n x n system); mu and sigma over that grid."""
    dims = PART_DIMS[:2]
    sp = _sub_space(spark, sf_dir, dims)
    hist = setting_history(spark, sf_dir, sp, dims, F.col("l_discount") * 10)
    model = M.fit_score_surrogate("gp", hist, "label")
    return model.mu_sigma(ix_features(G.enumerate_grid(spark, sp)))


@query("adaboost_time_model")
def adaboost_time_model(spark, sf_dir):
    """M7: AdaBoost.R2 time model (50 rounds of depth-3 trees, weighted median) on the per-setting history."""
    sp = _sub_space(spark, sf_dir, TIME_DIMS)
    hist = setting_history(spark, sf_dir, sp, TIME_DIMS, F.col("l_quantity") / 10)
    model = M.fit_time_surrogate("adaboost", hist, "label")
    return model.predict(ix_features(G.enumerate_grid(spark, sp)), "grid_id", "seconds")

"""Search-space and acquisition queries (planes P-B): G1-G14, A1-A8, E13, E15.

The space of the `part` queries has three dimensions taken from the data: the distinct
p_brand, p_type and p_size values (ordered by value). Candidate statistics (mu, sigma,
predicted seconds) are aggregates of `lineitem` per part.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesmith.functions import stats as S
from tunesmith.functions.readable import python_str
from tunesmith.operators import acquisition as A
from tunesmith.operators import space as G
from tunesmith.plans.catalog_trials import TRIAL_LOG_SQL, RAW_SQL, trial_log
from tunesmith.plans.registry import query
from tunesmith.plans.spec import ALIASES, decoded
from tunesmith.sources.tables import table
from tunesmith.sources.trial_log import raw_trials_from_events

D = 6
PART_DIMS = ["p_brand", "p_type", "p_size"]
INCUMBENT = 0.5  # foreign incumbent (A11) used by the candidate-table queries


def part_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.space_from_columns(table(spark, sf_dir, "part"), "part", PART_DIMS)


def part_settings(spark: SparkSession, sf_dir: str, sp: G.Space) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    return G.encode(p, sp)


SPACE_SQL = """sp AS (
  SELECT 0 AS dim, 'p_brand' AS param, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS ix, v AS value
  FROM (SELECT DISTINCT p_brand AS v FROM part)
  UNION ALL
  SELECT 1, 'p_type', CAST(row_number() OVER (ORDER BY v) - 1 AS INT), v FROM (SELECT DISTINCT p_type AS v FROM part)
  UNION ALL
  SELECT 2, 'p_size', CAST(row_number() OVER (ORDER BY v) - 1 AS INT), CAST(v AS VARCHAR) FROM (SELECT DISTINCT p_size AS v FROM part)),
lens AS (SELECT dim, count(*) AS len FROM sp GROUP BY dim),
strides AS (SELECT l.dim, l.len,
                   CAST(coalesce((SELECT product(l2.len) FROM lens l2 WHERE l2.dim > l.dim), 1) AS BIGINT) AS stride
            FROM lens l),
g AS (SELECT unnest(range(0, (SELECT CAST(product(len) AS BIGINT) FROM lens))) AS grid_id),
enc AS (
  SELECT p.p_partkey, b.ix AS i0, t.ix AS i1, s.ix AS i2,
         b.ix * (SELECT stride FROM strides WHERE dim = 0) + t.ix * (SELECT stride FROM strides WHERE dim = 1)
           + s.ix * (SELECT stride FROM strides WHERE dim = 2) AS grid_id
  FROM part p
  JOIN sp b ON b.dim = 0 AND b.value = p.p_brand
  JOIN sp t ON t.dim = 1 AND t.value = p.p_type
  JOIN sp s ON s.dim = 2 AND s.value = CAST(p.p_size AS VARCHAR))"""


@query("grid_size", "WITH " + SPACE_SQL + """
SELECT 'part' AS model, CAST(product(len) AS BIGINT) AS grid_size, count(*) AS n_dims,
       least(150, CAST(product(len) AS BIGINT)) AS draw_samples, least(100, CAST(product(len) AS BIGINT)) AS n_iter
FROM lens""")
def grid_size(spark, sf_dir):
    """G1 + G13: product of the dimension lengths, and the sample / iteration caps."""
    return G.caps(G.grid_size(part_space(spark, sf_dir)))


@query("grid_enumerate", "WITH " + SPACE_SQL + """
SELECT g.grid_id, b.value AS p_brand, t.value AS p_type, s.value AS p_size
FROM g
JOIN strides sb ON sb.dim = 0 JOIN sp b ON b.dim = 0 AND b.ix = (g.grid_id // sb.stride) % sb.len
JOIN strides st ON st.dim = 1 JOIN sp t ON t.dim = 1 AND t.ix = (g.grid_id // st.stride) % st.len
JOIN strides ss ON ss.dim = 2 JOIN sp s ON s.dim = 2 AND s.ix = (g.grid_id // ss.stride) % ss.len""")
def grid_enumerate(spark, sf_dir):
    """Every setting of the grid decoded from spark.range by mixed radix."""
    sp = G.load_space(part_space(spark, sf_dir), "part")
    return G.decode(G.enumerate_grid(spark, sp), sp).drop("ix")


@query("grid_encode", "WITH " + SPACE_SQL + "\nSELECT p_partkey, grid_id FROM enc")
def grid_encode(spark, sf_dir):
    """Each part's (brand, type, size) setting -> its grid_id."""
    sp = G.load_space(part_space(spark, sf_dir), "part")
    return part_settings(spark, sf_dir, sp).select("p_partkey", "grid_id")


@query("grid_neighbors", "WITH " + SPACE_SQL + """,
tried AS (SELECT DISTINCT grid_id, i0, i1, i2 FROM enc)
SELECT t.grid_id, 'p_brand' AS param, t.grid_id + (s.ix - t.i0) * st.stride AS neighbor_id
FROM tried t JOIN sp s ON s.dim = 0 AND s.ix <> t.i0 JOIN strides st ON st.dim = 0
UNION ALL
SELECT t.grid_id, 'p_type', t.grid_id + (s.ix - t.i1) * st.stride
FROM tried t JOIN sp s ON s.dim = 1 AND s.ix <> t.i1 JOIN strides st ON st.dim = 1
UNION ALL
SELECT t.grid_id, 'p_size', t.grid_id + (s.ix - t.i2) * st.stride
FROM tried t JOIN sp s ON s.dim = 2 AND s.ix <> t.i2 JOIN strides st ON st.dim = 2""")
def grid_neighbors(spark, sf_dir):
    """All Hamming-1 neighbours of every tried (part) setting."""
    sp = G.load_space(part_space(spark, sf_dir), "part")
    tried = part_settings(spark, sf_dir, sp).select("grid_id", "ix").distinct()
    return G.neighbors(tried, sp).select("grid_id", "param", "neighbor_id")


@query("grid_untried", "WITH " + SPACE_SQL + """
SELECT grid_id FROM g WHERE grid_id NOT IN (SELECT grid_id FROM enc)""")
def grid_untried(spark, sf_dir):
    """Grid settings that no part has tried (anti join)."""
    sp = G.load_space(part_space(spark, sf_dir), "part")
    return G.untried(G.enumerate_grid(spark, sp), part_settings(spark, sf_dir, sp)).select("grid_id")


@query("experiment_matrix", """
SELECT CAST(n.n_nationkey AS VARCHAR) AS task, CAST(r.r_regionkey AS BIGINT) AS seed, m.method
FROM (SELECT DISTINCT n_nationkey FROM nation) n, (SELECT DISTINCT r_regionkey FROM region) r,
     (SELECT DISTINCT event_type AS method FROM events) m""")
def experiment_matrix(spark, sf_dir):
    """Tasks (nations) x seeds (regions) x methods (event types), enumerated as a grid."""
    m = G.experiment_matrix(spark, {
        "task": table(spark, sf_dir, "nation").select("n_nationkey"),
        "seed": table(spark, sf_dir, "region").select("r_regionkey"),
        "method": table(spark, sf_dir, "events").select("event_type"),
    })
    return m.select("task", F.col("seed").cast("long").alias("seed"), "method")


# ---- G8-G10 on lineitem with punched holes ------------------------------------------------

def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in feature table: lineitem with deterministic missing values (FIXTURES.md)."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(k % 10 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus")


FEATURES_SQL = """f AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus
  FROM lineitem)"""
FEATURE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
META_SQL = FEATURES_SQL + """,
miss AS (SELECT (CASE WHEN l_quantity IS NULL OR isnan(l_quantity) THEN 1 ELSE 0 END)
              + (CASE WHEN l_extendedprice IS NULL OR isnan(l_extendedprice) THEN 1 ELSE 0 END)
              + (CASE WHEN l_discount IS NULL OR isnan(l_discount) THEN 1 ELSE 0 END)
              + (CASE WHEN l_tax IS NULL OR isnan(l_tax) THEN 1 ELSE 0 END)
              + (CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END)
              + (CASE WHEN l_linestatus IS NULL THEN 1 ELSE 0 END) AS m FROM f),
meta AS (SELECT CAST(sum(m) AS BIGINT) > 0 AS any_missing, true AS any_categorical,
                CAST(sum(m) AS BIGINT) AS n_missing, count(*) AS n_rows FROM miss)"""


def _meta(spark, sf_dir):
    return G.meta_features(lineitem_features(spark, sf_dir).select(*FEATURE_COLS))


@query("meta_features", "WITH " + META_SQL + "\nSELECT * FROM meta")
def meta_features(spark, sf_dir):
    """Any missing cell / any categorical column in one aggregation pass."""
    return _meta(spark, sf_dir)


CONDITIONAL_SQL = META_SQL + """,
items AS (
  SELECT 0 AS pos, CASE WHEN any_missing THEN '["DualImputer"]' ELSE 'null' END AS value FROM meta
  UNION ALL SELECT 1, CASE WHEN NOT any_missing AND any_categorical THEN '["OneHotEncoder"]' END FROM meta
  UNION ALL SELECT 2, CASE WHEN any_missing AND any_categorical THEN '["DualImputer", "OneHotEncoder"]' END FROM meta
  UNION ALL SELECT 3, CASE WHEN any_missing THEN '["DualImputer", "PCA"]' ELSE '["PCA"]' END FROM meta),
cond AS (
  SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS ix, value,
         CASE WHEN value = 'null' THEN 'none' ELSE 'list' END AS value_type
  FROM items WHERE value IS NOT NULL)"""


@query("conditional_space", "WITH " + CONDITIONAL_SQL + "\nSELECT * FROM cond")
def conditional_space(spark, sf_dir):
    """The @preprocessor alternatives kept by the table's meta-features."""
    return G.conditional_preprocessors(_meta(spark, sf_dir))


# ---- G8 / G11 on every nation as a table with flags of its own -------------------------------

NATION_FLAGS_SQL = """fl AS (SELECT n_nationkey, n_nationkey % 2 = 0 AS any_missing, n_nationkey % 3 = 0 AS any_categorical FROM nation)"""


def nation_flags(spark, sf_dir):
    """Stand-in meta-features: all four combinations of the two flags occur."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", (k % 2 == 0).alias("any_missing"), (k % 3 == 0).alias("any_categorical"))


@query("conditional_items", "WITH " + NATION_FLAGS_SQL + """,
items AS (
  SELECT n_nationkey, 0 AS pos, CASE WHEN any_missing THEN '["DualImputer"]' ELSE 'null' END AS value FROM fl
  UNION ALL SELECT n_nationkey, 1, CASE WHEN NOT any_missing AND any_categorical THEN '["OneHotEncoder"]' END FROM fl
  UNION ALL SELECT n_nationkey, 2, CASE WHEN any_missing AND any_categorical THEN '["DualImputer", "OneHotEncoder"]' END FROM fl
  UNION ALL SELECT n_nationkey, 3, CASE WHEN any_missing THEN '["DualImputer", "PCA"]' ELSE '["PCA"]' END FROM fl)
SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY pos) - 1 AS INT) AS ix, value,
       CASE WHEN value = 'null' THEN 'none' ELSE 'list' END AS value_type
FROM items WHERE value IS NOT NULL""")
def conditional_items(spark, sf_dir):
    """The rule table evaluated for many tables at once, all flag combinations among them."""
    return G.conditional_items(nation_flags(spark, sf_dir), G.PREPROCESSOR_RULES, ["n_nationkey"])


# Preprocessing pairs of the generated specs, by the dotted names that users know.
DI_PAIR = ["extra.dual_imputer.DualImputer", {"strategy_numerical": "median"}]
OHE_PAIR = ["sklearn.preprocessing.OneHotEncoder", {"handle_unknown": "ignore", "sparse": False}]
PC_PAIR = ["sklearn.decomposition.PCA", {}]
SPEC_RULES = (G.Rule(DI_PAIR, "any_missing", (None,)), G.Rule(OHE_PAIR, "not any_missing and any_categorical"),
              G.Rule([DI_PAIR, OHE_PAIR], "any_missing and any_categorical"), G.Rule([DI_PAIR, PC_PAIR], "any_missing", (PC_PAIR,)))
SPEC_HEAD = '{"estimator": ["sklearn.ensemble.RandomForestClassifier", {"n_jobs": -1, "random_state": '
SPEC_PARAMS = '}], "params": {"n_estimators": [8, 16, 512], "criterion": ["gini", "entropy"], "max_depth": [8, null], "bootstrap": [true, false], "!@preprocessor": ['


def nation_specs(spark, sf_dir):
    """(n_nationkey, spec): a generated JSON spec of the forest for every nation."""
    items = G.conditional_items(nation_flags(spark, sf_dir), SPEC_RULES, ["n_nationkey"])
    listed = items.groupBy("n_nationkey").agg(F.sort_array(F.collect_list(F.struct("ix", "value"))).alias("items"))  # at most four
    text = F.array_join(F.transform("items", lambda x: x["value"]), ", ")
    return listed.select("n_nationkey", F.concat(F.lit(SPEC_HEAD), F.col("n_nationkey").cast("string"), F.lit(SPEC_PARAMS), text, F.lit("]}}")).alias("spec"))


def _decoded_sql() -> str:
    di, ohe, pc = (json.dumps(x) for x in (DI_PAIR, OHE_PAIR, PC_PAIR))
    names = " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in ALIASES.items())
    return "WITH " + NATION_FLAGS_SQL + f""",
it AS (
  SELECT n_nationkey, 0 AS pos, CASE WHEN any_missing THEN '{di}' ELSE 'null' END AS value FROM fl
  UNION ALL SELECT n_nationkey, 1, CASE WHEN NOT any_missing AND any_categorical THEN '{ohe}' END FROM fl
  UNION ALL SELECT n_nationkey, 2, CASE WHEN any_missing AND any_categorical THEN '[{di}, {ohe}]' END FROM fl
  UNION ALL SELECT n_nationkey, 3, CASE WHEN any_missing THEN '[{di}, {pc}]' ELSE '{pc}' END FROM fl),
specs AS (SELECT n_nationkey, CAST('{SPEC_HEAD}' || n_nationkey || '{SPEC_PARAMS}' || string_agg(value, ', ' ORDER BY pos) || ']}}}}' AS JSON) AS spec
          FROM it WHERE value IS NOT NULL GROUP BY n_nationkey),
nodes AS (SELECT s.n_nationkey, t.fullkey, t.path AS above, t.type, t.value FROM specs s, json_tree(s.spec) t),
stages AS (
  SELECT n_nationkey, fullkey, CASE value->>'$[0]' {names} ELSE value->>'$[0]' END AS stage, value->'$[1]' AS params
  FROM nodes WHERE type = 'ARRAY' AND json_array_length(value) = 2 AND json_type(value, '$[0]') = 'VARCHAR' AND json_type(value, '$[1]') = 'OBJECT'),
found AS (
  SELECT s.n_nationkey, s.fullkey, s.stage, p.key AS param, CAST(p.value AS VARCHAR) AS value FROM stages s, json_each(s.params) p
  UNION ALL SELECT n_nationkey, fullkey, stage, NULL, NULL FROM stages WHERE len(json_keys(params)) = 0
  UNION ALL SELECT n_nationkey, fullkey, NULL, NULL, CAST(value AS VARCHAR) FROM nodes
    WHERE type NOT IN ('ARRAY', 'OBJECT') AND starts_with(above, '$.params.')
      AND NOT EXISTS (SELECT 1 FROM stages g WHERE g.n_nationkey = nodes.n_nationkey AND starts_with(nodes.fullkey, g.fullkey || '[')))
SELECT n_nationkey, replace(replace(fullkey, '"', ''), '!', '') AS path, stage, param, value FROM found"""


@query("decoded_config", _decoded_sql())
def decoded_config(spark, sf_dir):
    """Every nation's generated spec decoded against the registry into (path, stage, parameter, value) rows."""
    return decoded(nation_specs(spark, sf_dir), ["n_nationkey"])


_RF_ROWS = []
for _d, (_p, _vals) in enumerate(G.RF_PARAMS.items()):
    for _i, _v in enumerate(_vals):
        _RF_ROWS.append(f"('RandomForestClassifier', {_d}, '{_p}', {_i}, '{G.value_text(_v)}', '{G.value_type(_v)}')")
CONFIG_SQL = CONDITIONAL_SQL + f""",
fixed(model, dim, param, ix, value, value_type) AS (VALUES {", ".join(_RF_ROWS)}),
cs AS (
  SELECT model, CAST(dim AS INT) AS dim, param, CAST(ix AS INT) AS ix, value, value_type FROM fixed
  UNION ALL
  SELECT 'RandomForestClassifier', {len(G.RF_PARAMS)}, '@preprocessor', ix, value, value_type FROM cond)"""


@query("config_space", "WITH " + CONFIG_SQL + "\nSELECT * FROM cs")
def config_space(spark, sf_dir):
    """Random-forest space + conditional preprocessor dimension chosen from meta-features."""
    return G.config_space(spark, _meta(spark, sf_dir))


@query("readable_space", "WITH " + CONFIG_SQL + """
SELECT param, ix, CASE WHEN value_type = 'bool' AND value = 'true' THEN 'True' WHEN value_type = 'bool' THEN 'False'
                       WHEN value_type = 'none' THEN 'None' ELSE value END AS readable FROM cs""")
def readable_space(spark, sf_dir):
    """P5: the readable form of every value of the live space."""
    cs = G.config_space(spark, _meta(spark, sf_dir))
    return cs.select("param", "ix", python_str(F.col("value"), F.col("value_type")).alias("readable"))


@query("config_grid_size", "WITH " + CONFIG_SQL + """,
l AS (SELECT model, dim, count(*) AS len FROM cs GROUP BY model, dim)
SELECT model, CAST(product(len) AS BIGINT) AS grid_size, count(*) AS n_dims FROM l GROUP BY model""")
def config_grid_size(spark, sf_dir):
    """G1 on the live configuration: 1,149,120 or 1,723,680 settings."""
    return G.grid_size(G.config_space(spark, _meta(spark, sf_dir)))


# ---- A1-A6 on part candidates -------------------------------------------------------------

def part_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in surrogate output: mu, sigma and predicted seconds per part from lineitem aggregates."""
    li = table(spark, sf_dir, "lineitem")
    stats = li.groupBy("l_partkey").agg(
        (F.avg("l_discount") * 10).alias("mu"),
        (F.stddev_pop("l_tax") * 10).alias("sigma"),
        ((F.avg("l_quantity") - 20) / 10).alias("seconds"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("grid_id"))
    return parts.join(stats, parts["grid_id"] == stats["l_partkey"], "inner").drop("l_partkey")


def _min_time(spark, sf_dir) -> float:
    return table(spark, sf_dir, "lineitem").agg(F.min("l_quantity") / 10).first()[0]


CANDS_SQL = f"""c AS (
  SELECT p.p_partkey AS grid_id, avg(l.l_discount) * 10 AS mu, stddev_pop(l.l_tax) * 10 AS sigma,
         (avg(l.l_quantity) - 20) / 10 AS seconds
  FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey),
mt AS (SELECT min(l_quantity) / 10 AS min_time FROM lineitem),
z AS (SELECT *, mu - ({INCUMBENT!r} + {S.DEFAULT_XI!r}) AS d,
             (mu - ({INCUMBENT!r} + {S.DEFAULT_XI!r})) / CASE WHEN sigma > {S.DEGENERATE_SIGMA!r} THEN sigma END AS zz
      FROM c),
e AS (SELECT grid_id, mu, sigma, seconds,
             CASE WHEN sigma <= {S.DEGENERATE_SIGMA!r} THEN -1.0
                  ELSE d * {S.normal_cdf_sql('zz')} + sigma * {S.normal_pdf_sql('zz')} END AS ei,
             CASE WHEN seconds <= 0 THEN (SELECT min_time FROM mt) ELSE seconds END AS secs
      FROM z)"""


def _scored(spark, sf_dir, mode="ei"):
    c = part_candidates(spark, sf_dir)
    mt = None if mode == "ei" else _min_time(spark, sf_dir)
    return A.score(c, INCUMBENT, mode=mode, min_time=mt, out="ei" if mode == "ei" else mode)


@query("expected_improvement", "WITH " + CANDS_SQL + """
SELECT grid_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(ei, 6) AS ei FROM e""")
def expected_improvement(spark, sf_dir):
    """EI of every candidate against a foreign incumbent; sigma <= 1e-5 -> -1."""
    return _scored(spark, sf_dir).select("grid_id", *[F.round(c, D).alias(c) for c in ("mu", "sigma", "ei")])


@query("ei_per_second", "WITH " + CANDS_SQL + """
SELECT grid_id, round(ei / secs, 6) AS ei_per_second FROM e""")
def ei_per_second(spark, sf_dir):
    """A3/A5: EI per predicted second (non-positive predictions -> smallest observed time)."""
    return _scored(spark, sf_dir, "ei_per_second").select("grid_id", F.round("ei_per_second", D).alias("ei_per_second"))


@query("ei_per_root_second", "WITH " + CANDS_SQL + """
SELECT grid_id, round(ei / sqrt(secs), 6) AS ei_per_root_second FROM e""")
def ei_per_root_second(spark, sf_dir):
    """A4: EI per square root of the predicted seconds."""
    return _scored(spark, sf_dir, "ei_per_root_second").select(
        "grid_id", F.round("ei_per_root_second", D).alias("ei_per_root_second"))


@query("ei_argmax", "WITH " + CANDS_SQL + """
SELECT grid_id, round(ei, 6) AS ei FROM e ORDER BY ei DESC, grid_id LIMIT 1""")
def ei_argmax(spark, sf_dir):
    """The candidate with the highest EI (ties -> smallest grid_id), by a max_by aggregate."""
    best = A.argmax(_scored(spark, sf_dir), "ei", "grid_id")
    return best.select("grid_id", F.round("ei", D).alias("ei"))


# ---- E15 / E13 on the trial log -----------------------------------------------------------

CROSS_SQL = "WITH " + RAW_SQL + """,
inc AS (SELECT max(score) AS best FROM b),
c AS (SELECT method AS model, user_id AS setting, avg(score) AS mu, stddev_pop(score) AS sigma
      FROM (SELECT b.*, e.user_id FROM b JOIN events e ON e.event_id = b.event_id) GROUP BY method, user_id),
z AS (SELECT *, mu - ((SELECT best FROM inc) + (-0.01)) AS d,
             (mu - ((SELECT best FROM inc) + (-0.01))) / CASE WHEN sigma > 1e-05 THEN sigma END AS zz FROM c),
e AS (SELECT model, setting,
             CASE WHEN sigma <= 1e-05 THEN -1.0 ELSE d * """ + S.normal_cdf_sql("zz") + " + sigma * " + S.normal_pdf_sql("zz") + """ END AS ei
      FROM z),
pm AS (SELECT model, setting, ei FROM (
         SELECT *, row_number() OVER (PARTITION BY model ORDER BY ei DESC, setting) AS rn FROM e) WHERE rn = 1)
SELECT model, setting, round(ei, 6) AS ei,
       row_number() OVER (ORDER BY ei DESC, model) = 1 AS chosen
FROM pm"""


@query("cross_model_argmax", CROSS_SQL)
def cross_model_argmax(spark, sf_dir):
    """Per model the best candidate against the global incumbent, and the model chosen."""
    raw = raw_trials_from_events(spark, sf_dir, more=["user_id"])
    best = raw.agg(F.max("score")).first()[0]
    cands = raw.groupBy(F.col("method").alias("model"), F.col("user_id").alias("setting")).agg(
        F.avg("score").alias("mu"), F.stddev_pop("score").alias("sigma"))
    scored = A.score(cands, best)
    per_model = A.argmax(scored, "ei", key="setting", by=["model"])
    out = A.cross_model_argmax(per_model, model_order="model")
    return out.select("model", "setting", F.round("ei", D).alias("ei"), "chosen")


DROP_SQL = TRIAL_LOG_SQL + """,
r AS (SELECT method, task, seed, success,
             coalesce(CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (
               PARTITION BY method, task, seed ORDER BY iteration
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rnd
      FROM trial_log),
f AS (SELECT method, task, seed, rnd, count(*) AS n FROM r WHERE NOT success AND rnd < 8 GROUP BY method, task, seed, rnd),
bad AS (SELECT method, task, seed, min(rnd) AS failed_round FROM f WHERE n >= 3 GROUP BY method, task, seed)
SELECT k.method, k.task, k.seed, b.failed_round, b.failed_round IS NOT NULL AS dropped
FROM (SELECT DISTINCT method, task, seed FROM trial_log) k
LEFT JOIN bad b ON b.method = k.method AND b.task = k.task AND b.seed = k.seed"""


@query("drop_failed_models", DROP_SQL)
def drop_failed_models(spark, sf_dir):
    """Runs whose preparation (8 rounds, 3 attempts each) has a round without success."""
    out = A.failed_prep_rounds(trial_log(spark, sf_dir), ["method", "task", "seed"], n_rounds=8, max_retries=3)
    return out.select("method", "task", "seed", "failed_round", "dropped")


# ---- A8 hill climb on the part grid -------------------------------------------------------

def _dim_weights(part: DataFrame, col: str) -> DataFrame:
    return part.groupBy(F.col(col).cast("string").alias(col)).agg(
        F.round(F.avg("p_retailprice") / 1000, 9).alias(f"w_{col}"))


LS_SQL = "WITH " + SPACE_SQL + """,
wb AS (SELECT p_brand AS v, round(avg(p_retailprice) / 1000, 9) AS w FROM part GROUP BY p_brand),
wt AS (SELECT p_type AS v, round(avg(p_retailprice) / 1000, 9) AS w FROM part GROUP BY p_type),
ws AS (SELECT CAST(p_size AS VARCHAR) AS v, round(avg(p_retailprice) / 1000, 9) AS w FROM part GROUP BY p_size),
dec AS (
  SELECT g.grid_id, (g.grid_id // sb.stride) % sb.len AS i0, (g.grid_id // st.stride) % st.len AS i1,
         (g.grid_id // ss.stride) % ss.len AS i2
  FROM g, strides sb, strides st, strides ss WHERE sb.dim = 0 AND st.dim = 1 AND ss.dim = 2),
scored AS (
  SELECT d.grid_id, d.i0, d.i1, d.i2, round(wb.w + wt.w + ws.w, 9) AS score
  FROM dec d
  JOIN sp b ON b.dim = 0 AND b.ix = d.i0 JOIN wb ON wb.v = b.value
  JOIN sp t ON t.dim = 1 AND t.ix = d.i1 JOIN wt ON wt.v = t.value
  JOIN sp s ON s.dim = 2 AND s.ix = d.i2 JOIN ws ON ws.v = s.value),
nb AS (
  SELECT t.grid_id, t.grid_id + (s.ix - t.i0) * st.stride AS nid FROM scored t JOIN sp s ON s.dim = 0 AND s.ix <> t.i0 JOIN strides st ON st.dim = 0
  UNION ALL
  SELECT t.grid_id, t.grid_id + (s.ix - t.i1) * st.stride FROM scored t JOIN sp s ON s.dim = 1 AND s.ix <> t.i1 JOIN strides st ON st.dim = 1
  UNION ALL
  SELECT t.grid_id, t.grid_id + (s.ix - t.i2) * st.stride FROM scored t JOIN sp s ON s.dim = 2 AND s.ix <> t.i2 JOIN strides st ON st.dim = 2),
best AS (
  SELECT grid_id, nid, nscore FROM (
    SELECT n.grid_id, n.nid, sc.score AS nscore,
           row_number() OVER (PARTITION BY n.grid_id ORDER BY sc.score DESC, n.nid) AS rn
    FROM nb n JOIN scored sc ON sc.grid_id = n.nid) WHERE rn = 1),
starts AS (SELECT DISTINCT e.grid_id, sc.score FROM enc e JOIN scored sc ON sc.grid_id = e.grid_id)
SELECT * FROM (
  WITH RECURSIVE path(start_id, step, grid_id, score) AS (
    SELECT grid_id, 0, grid_id, score FROM starts
    UNION ALL
    SELECT p.start_id, p.step + 1, b.nid, b.nscore FROM path p JOIN best b ON b.grid_id = p.grid_id WHERE b.nscore > p.score)
  SELECT start_id, CAST(step AS INT) AS step, grid_id, round(score, 6) AS score FROM path)"""


@query("local_search_paths", LS_SQL)
def local_search_paths(spark, sf_dir):
    """Hill climb from every tried setting to the best Hamming-1 neighbour while it improves."""
    part = table(spark, sf_dir, "part")
    sp = G.load_space(part_space(spark, sf_dir), "part")
    grid = G.decode(G.enumerate_grid(spark, sp), sp)
    for c in PART_DIMS:
        grid = grid.join(_dim_weights(part, c), c, "inner")
    scored = grid.select("grid_id", F.round(F.col("w_p_brand") + F.col("w_p_type") + F.col("w_p_size"), 9).alias("score"))
    starts = part_settings(spark, sf_dir, sp).select("grid_id").distinct().join(scored, "grid_id")
    paths = A.local_search(starts, scored, sp, value="score")
    return paths.select("start_id", F.col("step").cast("int").alias("step"), "grid_id", F.round("score", D).alias("score"))


def feistel_sql(x: str, a: str, b: str, seed: int) -> str:
    """The rounds of ``G.nth_draw`` over a number, in SQL."""
    def key(k, half):
        return f"CAST('0x' || substr(md5('{seed}:{k}:' || h[{half}]), 1, 15) AS BIGINT)"

    rounds = [f"[(h[1] + {key(k, 2)}) % {a}, h[2]]" if k % 2 == 0 else f"[h[1], (h[2] + {key(k, 1)}) % {b}]" for k in range(G.ROUNDS)]
    sql = f"[{x} % {a}, {x} // {a}]"
    for r in rounds:
        sql = f"list_transform([{sql}], lambda h: {r})[1]"
    return f"list_transform([{sql}], lambda h: h[2] * {a} + h[1])[1]"


def draws_sql(size: str, count: str, seed: int) -> str:
    """CTE ``firsts`` (draw, grid_id): the first draws of a grid; a number outside walks on."""
    return f"""dom AS (SELECT {size} AS size, CAST(floor(sqrt({size} - 1)) AS BIGINT) + 1 AS a),
domain AS (SELECT size, a, CAST(ceil(size / a) AS BIGINT) AS b FROM dom),
firsts AS (
  WITH RECURSIVE walk(draw, x, steps) AS (
    SELECT i, {feistel_sql('i', 'a', 'b', seed)}, 0 FROM domain, (SELECT unnest(range(0, CAST({count} AS BIGINT))) AS i)
    UNION ALL
    SELECT draw, {feistel_sql('x', 'a', 'b', seed)}, steps + 1 FROM walk, domain WHERE x >= size)
  SELECT draw, x AS grid_id FROM walk, domain WHERE x < size)"""


@query("grid_sample", "WITH " + SPACE_SQL + """,
n AS (SELECT CAST(product(len) AS BIGINT) AS size FROM lens),
""" + draws_sql("(SELECT size FROM n)", "(SELECT least(size, 20000) FROM n)", 2589731706) + """,
picks AS (SELECT * FROM firsts WHERE grid_id NOT IN (SELECT grid_id FROM enc) ORDER BY draw LIMIT 150)
SELECT g.grid_id, g.draw, b.value AS p_brand, t.value AS p_type, s.value AS p_size
FROM picks g
JOIN strides sb ON sb.dim = 0 JOIN sp b ON b.dim = 0 AND b.ix = (g.grid_id // sb.stride) % sb.len
JOIN strides st ON st.dim = 1 JOIN sp t ON t.dim = 1 AND t.ix = (g.grid_id // st.stride) % st.len
JOIN strides ss ON ss.dim = 2 JOIN sp s ON s.dim = 2 AND s.ix = (g.grid_id // ss.stride) % ss.len""")
def grid_sample(spark, sf_dir):
    """G3/G4/G5 + G13: 150 untried settings of the part grid by seeded draws; the grid is not enumerated."""
    sp = G.load_space(part_space(spark, sf_dir), "part")
    return G.decode(G.draw(spark, sp, min(150, sp.size), 2589731706, part_settings(spark, sf_dir, sp)), sp).drop("ix")


@query("grid_size_large", """
SELECT 'orders' AS model, (SELECT count(DISTINCT l_orderkey) FROM lineitem) * (SELECT count(DISTINCT l_partkey) FROM lineitem) AS grid_size,
       2 AS n_dims""")
def grid_size_large(spark, sf_dir):
    """G1 on dimensions of as many values as the data has: every order key times every part key."""
    return G.grid_size(G.space_from_columns(table(spark, sf_dir, "lineitem"), "orders", ["l_orderkey", "l_partkey"]))

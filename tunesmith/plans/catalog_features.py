"""Feature-table queries (plane P-A): imputation, scaling, encoding, folds and splits.

Missing values are punched deterministically into lineitem / customer (FIXTURES.md): the
driver tables contain none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesmith.operators import features as FE
from tunesmith.operators import scores
from tunesmith.plans.catalog_space import FEATURES_SQL, lineitem_features
from tunesmith.plans.registry import query
from tunesmith.sources.tables import table

D = 6
IMPUTE_COLS = ["l_quantity", "l_discount"]


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in: customer with holes in a categorical code (nation) and a numeric column."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey",
                    F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
                    F.when(k % 8 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    "c_mktsegment")


CUSTOMER_SQL = """c AS (
  SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
         CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment
  FROM customer)"""


def _impute_lineitem(spark, sf_dir, strategy):
    f = lineitem_features(spark, sf_dir).select("l_orderkey", "l_linenumber", *IMPUTE_COLS)
    fills = FE.fill_values(f, IMPUTE_COLS, strategy)
    out = FE.apply_fill(f, fills)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, D).alias(c) for c in IMPUTE_COLS])


def _impute_sql(agg_q: str, agg_d: str) -> str:
    return "WITH " + FEATURES_SQL + f"""
SELECT l_orderkey, l_linenumber,
       round(coalesce(l_quantity, (SELECT {agg_q} FROM f)), 6) AS l_quantity,
       round(coalesce(l_discount, (SELECT {agg_d} FROM f)), 6) AS l_discount
FROM f"""


@query("impute_mean", _impute_sql("avg(l_quantity)", "avg(l_discount)"))
def impute_mean(spark, sf_dir):
    """F2-F4 mean strategy on lineitem columns with holes."""
    return _impute_lineitem(spark, sf_dir, "mean")


@query("impute_median", _impute_sql("median(l_quantity)", "median(l_discount)"))
def impute_median(spark, sf_dir):
    """F4 median strategy: exact median (average of the two middle values)."""
    return _impute_lineitem(spark, sf_dir, "median")


MODE_SQL = "WITH " + CUSTOMER_SQL + """,
m AS (SELECT c_nationkey AS v FROM (SELECT c_nationkey, count(*) AS n FROM c WHERE c_nationkey IS NOT NULL
                                    GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 1))
SELECT c_custkey, coalesce(c_nationkey, (SELECT v FROM m)) AS c_nationkey FROM c"""


@query("impute_mode", MODE_SQL)
def impute_mode(spark, sf_dir):
    """F4 most_frequent strategy (ties -> smallest value) on a categorical code."""
    c = customer_features(spark, sf_dir).select("c_custkey", "c_nationkey")
    return FE.apply_fill(c, FE.fill_values(c, ["c_nationkey"], "most_frequent"))


DUAL_SQL = "WITH " + CUSTOMER_SQL + """,
m AS (SELECT c_nationkey AS v FROM (SELECT c_nationkey, count(*) AS n FROM c WHERE c_nationkey IS NOT NULL
                                    GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 1))
SELECT c_custkey, coalesce(c_nationkey, (SELECT v FROM m)) AS c_nationkey,
       round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM c)), 6) AS c_acctbal, c_mktsegment
FROM c"""


@query("dual_impute", DUAL_SQL)
def dual_impute(spark, sf_dir):
    """DualImputer (categorical most_frequent, numeric median) keeps column order."""
    c = customer_features(spark, sf_dir)
    model = FE.DualImputer(categorical=["c_nationkey"], numerical=["c_acctbal"]).fit(c)
    out = model.transform(c)
    return out.select("c_custkey", "c_nationkey", F.round("c_acctbal", D).alias("c_acctbal"), "c_mktsegment")


SCALE_COLS = ["l_quantity", "l_extendedprice"]


@query("standard_scale", """
SELECT l_orderkey, l_linenumber,
       round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT CASE WHEN stddev_pop(l_quantity) = 0 THEN 1 ELSE stddev_pop(l_quantity) END FROM lineitem), 6) AS l_quantity,
       round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT CASE WHEN stddev_pop(l_extendedprice) = 0 THEN 1 ELSE stddev_pop(l_extendedprice) END FROM lineitem), 6) AS l_extendedprice
FROM lineitem""")
def standard_scale(spark, sf_dir):
    """centre and divide by the population standard deviation."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return FE.standard_scale(li, SCALE_COLS).select("l_orderkey", "l_linenumber", *[F.round(c, D).alias(c) for c in SCALE_COLS])


@query("robust_scale", """
WITH q AS (SELECT median(l_quantity) AS mq, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iq,
                  median(l_extendedprice) AS me, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS ie
           FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round((l_quantity - q.mq) / CASE WHEN q.iq = 0 THEN 1 ELSE q.iq END, 6) AS l_quantity,
       round((l_extendedprice - q.me) / CASE WHEN q.ie = 0 THEN 1 ELSE q.ie END, 6) AS l_extendedprice
FROM lineitem, q""")
def robust_scale(spark, sf_dir):
    """F8: centre on the exact median and divide by the exact inter-quartile range."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return FE.robust_scale(li, SCALE_COLS).select("l_orderkey", "l_linenumber", *[F.round(c, D).alias(c) for c in SCALE_COLS])


@query("one_hot", """
WITH cats AS (
  SELECT 'o_orderstatus' AS col, v FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)
  UNION ALL SELECT 'o_orderpriority', v FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
SELECT o.o_orderkey, c.col || '=' || c.v AS feature,
       CASE WHEN (c.col = 'o_orderstatus' AND o.o_orderstatus = c.v) OR (c.col = 'o_orderpriority' AND o.o_orderpriority = c.v)
            THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value
FROM orders o, cats c""")
def one_hot(spark, sf_dir):
    """dense one-hot encoding of the categorical order columns (long form)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return FE.one_hot_long(o, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


ENCODED = ["o_orderstatus", "o_orderpriority", "o_orderdate"]


def _orders_to_encode(spark, sf_dir):
    """Two small categorical columns with holes, and one with a value for every order date."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(k % 9 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"))


@query("one_hot_sparse", """
WITH h AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS o_orderpriority,
                  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders),
x AS (SELECT o_orderkey, 'o_orderstatus' AS "column", o_orderstatus AS v FROM h
      UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM h
      UNION ALL SELECT o_orderkey, 'o_orderdate', o_orderdate FROM h),
d AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) - 1 AS position, count(*) AS n FROM x
      WHERE v IS NOT NULL GROUP BY "column", v)
SELECT x.o_orderkey, x."column", d.position, d.n FROM x JOIN d ON d."column" = x."column" AND d.v = x.v""")
def one_hot_sparse(spark, sf_dir):
    """the ones of a one-hot encoding by a stored dictionary (position and count of each value), without labels on the driver."""
    o = _orders_to_encode(spark, sf_dir)
    dictionary = FE.categories(o, ENCODED)
    ones = FE.one_hot_sparse(o, ["o_orderkey"], ENCODED, dictionary)
    return ones.join(dictionary.select("column", "position", "n"), ["column", "position"]).select("o_orderkey", "column", "position", "n")


POLY_COLS = ["l_quantity", "l_discount"]


@query("polynomial", """
SELECT l_orderkey, l_linenumber, CAST(1 AS DOUBLE) AS bias, l_quantity, l_discount,
       round(l_quantity * l_quantity, 6) AS l_quantity_pow2, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount,
       round(l_discount * l_discount, 6) AS l_discount_pow2
FROM lineitem""")
def polynomial(spark, sf_dir):
    """degree-2 polynomial features with the bias column."""
    li = table(spark, sf_dir, "lineitem")
    terms = FE.polynomial_terms(POLY_COLS, 2, True)
    return li.select("l_orderkey", "l_linenumber", *[F.round(e, D).alias(n) for n, e in terms])


# ---- E2 / E3 / S2 ------------------------------------------------------------------------

DOC_LABELS_SQL = """dl AS (SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


@query("stratified_folds", "WITH " + DOC_LABELS_SQL + """
SELECT doc_id, quality, CAST(ntile(3) OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS INT) AS fold FROM dl""")
def stratified_folds(spark, sf_dir):
    """3 stratified folds of the labelled documents (imbalanced binary target)."""
    dl = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return FE.stratified_folds(dl, "quality", 3, ["doc_id"]).select("doc_id", "quality", "fold")


@query("fold_accuracy", """
WITH f AS (SELECT vec_id, label, CAST(ntile(10) OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS fold,
                  (list_position(embedding, list_max(embedding)) - 1) % 10 AS prediction
           FROM embeddings)
SELECT fold, count(*) AS n_rows, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM f GROUP BY fold""")
def fold_accuracy(spark, sf_dir):
    """E2 + E3: accuracy per stratified fold of a rule-based prediction (arg-max of all dims, modulo the classes)."""
    e = table(spark, sf_dir, "embeddings")
    e = e.withColumn("prediction", (F.array_position("embedding", F.array_max("embedding")) - 1) % 10)
    f = FE.stratified_folds(e, "label", 10, ["vec_id"])
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), D).alias("accuracy"))


@query("auc_by_class", """
WITH x AS (SELECT vec_id, label, unnest(range(0, 10)) AS class, unnest(embedding[1:10]) AS score FROM embeddings),
r AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rk FROM x),
s AS (SELECT class, count(*) FILTER (label = class) AS positives, count(*) AS rows, sum(rk) FILTER (label = class) AS ranks FROM r GROUP BY class)
SELECT CAST(class AS INT) AS class, positives, rows,
       round((ranks - positives * (positives + 1) / 2.0) / (positives * (rows - positives)), 6) AS auc FROM s""")
def auc_by_class(spark, sf_dir):
    """Exact area under the ROC curve of every class against the rest, the first ten components being the scores."""
    e = table(spark, sf_dir, "embeddings")
    return scores.auc_by_class(e, F.col("label"), F.slice("embedding", 1, 10)).withColumn("auc", F.round("auc", D))


RATES_SQL = """WITH p AS (SELECT label AS y, (list_position(embedding, list_max(embedding)) - 1) % 10 AS z FROM embeddings),
c AS (SELECT c AS class, (SELECT count(*) FROM p WHERE y = c AND z = c) AS tp, (SELECT count(*) FROM p WHERE y <> c AND z = c) AS fp,
             (SELECT count(*) FROM p WHERE y = c AND z <> c) AS fn FROM (SELECT DISTINCT y AS c FROM p UNION SELECT DISTINCT z FROM p))
SELECT CAST(class AS DOUBLE) AS class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp + fn AS BIGINT) AS support,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""


@query("class_rates", RATES_SQL)
def class_rates(spark, sf_dir):
    """Precision, recall and F1 of every class of a rule-based prediction, from one count by (label, prediction)."""
    e = table(spark, sf_dir, "embeddings").withColumn("prediction", (F.array_position("embedding", F.array_max("embedding")) - 1) % 10)
    found = scores.rates(scores.class_counts(e))
    return found.select("class", "tp", "fp", "fn", "support", *[F.round(c, D).alias(c) for c in ("precision", "recall", "f1")])


@query("predefined_splits", """
WITH s AS (SELECT e.vec_id, f.fold, CASE WHEN f.fold = CAST(e.vec_id % 10 AS INT) THEN 'test' ELSE 'train' END AS role
           FROM embeddings e, (SELECT unnest(range(0, 10)) AS fold) f)
SELECT CAST(fold AS INT) AS fold, role, count(*) AS n_rows FROM s GROUP BY fold, role""")
def predefined_splits(spark, sf_dir):
    """The explicit 10-fold split table of the embeddings (rows per fold and role)."""
    e = table(spark, sf_dir, "embeddings")
    s = FE.predefined_splits(e, "vec_id", F.col("vec_id") % 10, 10)
    return s.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"))


@query("predefined_split_rows", """
SELECT e.vec_id, CAST(f.fold AS INT) AS fold, CASE WHEN f.fold = CAST(e.vec_id % 10 AS INT) THEN 'test' ELSE 'train' END AS role
FROM embeddings e, (SELECT unnest(range(0, 10)) AS fold) f""")
def predefined_split_rows(spark, sf_dir):
    """Every row of the explicit 10-fold split table."""
    return FE.predefined_splits(table(spark, sf_dir, "embeddings"), "vec_id", F.col("vec_id") % 10, 10)


HOLES_SQL = """h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)"""


def _orders_with_holes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 9 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 4 != 0, F.col("o_totalprice")).alias("o_totalprice"))


@query("dual_impute_strings", "WITH " + HOLES_SQL + """,
m AS (SELECT o_orderpriority AS v FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority,
       round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM h)), 6) AS o_totalprice FROM h""")
def dual_impute_strings(spark, sf_dir):
    """A text column by its most frequent value, a numeric one by its median."""
    df = _orders_with_holes(spark, sf_dir)
    out = FE.DualImputer(categorical=["o_orderpriority"], numerical=["o_totalprice"]).fit(df).transform(df)
    return out.select("o_orderkey", "o_orderpriority", F.round("o_totalprice", D).alias("o_totalprice"))


@query("one_hot_unknown", "WITH " + HOLES_SQL + """,
cats AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS slot FROM
         (SELECT DISTINCT o_orderpriority AS v FROM h WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '5-LOW'))
SELECT o_orderkey, slot, CASE WHEN o_orderpriority = v THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value FROM h, cats""")
def one_hot_unknown(spark, sf_dir):
    """F6 in a search pipeline: fitted without one category; it and missing values are all zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from tunesmith.plans.registry_ml import FeatureSpec, ModelConfig, build_pipeline
    df = _orders_with_holes(spark, sf_dir)
    spec = FeatureSpec(numeric=[], categorical=["o_orderpriority"])
    stages = build_pipeline(ModelConfig("LogisticRegression", {}), {"@preprocessor": ["OneHotEncoder"]}, spec, 0).getStages()[:-1]
    fitted = Pipeline(stages=stages).fit(df.where("o_orderpriority <> '5-LOW'"))
    return fitted.transform(df).select("o_orderkey", F.posexplode(vector_to_array("__assembled")).alias("slot", "value"))


@query("string_labels", """
SELECT c_custkey AS row_id, c_acctbal, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS label FROM customer""")
def string_labels(spark, sf_dir):
    """A text label as codes in alphabetical order."""
    from tunesmith.sources.features import labelled_table
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return labelled_table(c, label="c_mktsegment", row_id="c_custkey")[0]


@query("pca_project", """
WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings),
m AS (SELECT j, avg(v) AS mean FROM x GROUP BY j)
SELECT vec_id, round(sum((v - mean) * (v - mean)), 4) AS squared_norm FROM x JOIN m USING (j) GROUP BY vec_id""")
def pca_project(spark, sf_dir):
    """centred PCA of the 64-dim embeddings, all components; the squared norm of each row's projection
    is its squared distance from the mean (free of the components' signs)."""
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    out = FE.pca_project(e, "features", 64)
    norm = sum((F.col(f"pc_{i}") * F.col(f"pc_{i}") for i in range(1, 64)), F.col("pc_0") * F.col("pc_0"))
    return out.select("vec_id", F.round(norm, 4).alias("squared_norm"))

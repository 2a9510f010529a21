"""Exact quantiles of many groups and columns in two scans.

1. A quantile sketch of each group and column (one partially aggregated state) brackets every wanted rank between
   two values: the sketch's answers a little below and a little above it. Groups of few rows need none.
2. One more scan counts the values below each bracket and keeps only those inside, by value: about ``4 / ACCURACY`` of the
   rows, or one row where a value repeats. A prefix scan over the kept counts finds the two order statistics.

So no task holds a group, and a value that fills a third of the table is one count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunesmith import session
from tunesmith.operators.scan import running

#: Ranks of the sketch are off by at most n / ACCURACY; brackets reach twice as far. Groups of up to so many rows are kept whole.
ACCURACY = 2000


def present(df: DataFrame, c: str) -> Column:
    """A column as double; NaN and NULL both mean missing."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def grouped_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float],
                      accuracy: int = ACCURACY) -> DataFrame:
    """(by..., column, prob, value): quantiles of every column in every group, with linear interpolation between order
    statistics (numpy, SQL ``quantile_cont``).

    A group without a present value of a column has no row for it. NULL is a group of its own. ``cols`` and
    ``probs`` are few; each is a column of the scan. An empty table gives no rows.
    """
    by, margin = list(by), 2.0 / accuracy
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *[present(df, c).alias(f"__c{i}") for i, c in enumerate(cols)])
    wanted = [(i, float(p)) for i in range(len(cols)) for p in probs]
    # 1. brackets, if any group is large enough to need them
    sketch = not by or rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > accuracy).limit(1).count() > 0
    aggs = []
    for i in range(len(cols)):
        inner = sorted({q for _, p in wanted for q in (p - margin, p + margin) if 0.0 < q < 1.0})
        aggs += [F.count(f"__c{i}").alias(f"__n{i}"), F.min(f"__c{i}").alias(f"__min{i}"), F.max(f"__c{i}").alias(f"__max{i}")]
        aggs += [F.percentile_approx(f"__c{i}", [*inner], accuracy).alias(f"__q{i}")] if inner and sketch else []
    stats = rows.groupBy(*keys).agg(*aggs)
    for j, (i, p) in enumerate(wanted):
        low = F.lit(float("-inf")) if p - margin <= 0 or not sketch else F.col(f"__q{i}")[inner.index(p - margin)]
        high = F.lit(float("inf")) if p + margin >= 1 or not sketch else F.col(f"__q{i}")[inner.index(p + margin)]
        few = F.col(f"__n{i}") <= accuracy  # neighbouring ranks lie further apart than the margin: all values stay
        stats = stats.withColumns({f"__lo{j}": F.when(few, float("-inf")).otherwise(low), f"__hi{j}": F.when(few, float("inf")).otherwise(high)})
    bounds = [f"__{side}{j}" for j in range(len(wanted)) for side in ("lo", "hi")]
    stats = session.materialize(stats.select(*keys, *[f"__n{i}" for i in range(len(cols))], *bounds), "quantile-brackets")
    # 2. counts below and values inside
    if by:
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
        joined = rows.join(stats.select(*[F.col(k).alias(f"{k}_") for k in keys], *bounds), same)
    else:
        row = stats.first()
        joined = rows if row is None else rows.select("*", *[F.lit(row[b]).cast("double").alias(b) for b in bounds])
        if row is None:
            joined = rows.select("*", *[F.lit(None).cast("double").alias(b) for b in bounds])
    cells = [F.struct(F.lit(-1).alias("j"), F.lit(None).cast("double").alias("v"))]
    cells += [F.when((F.col(f"__c{i}") >= F.col(f"__lo{j}")) & (F.col(f"__c{i}") <= F.col(f"__hi{j}")), F.struct(F.lit(j).alias("j"), F.col(f"__c{i}").alias("v")))
              for j, (i, _) in enumerate(wanted)]
    below = [(F.col(f"__c{i}") < F.col(f"__lo{j}")).alias(f"__b{j}") for j, (i, _) in enumerate(wanted)]
    spread = joined.select(*keys, *below, F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    base = F.col("cell.j") == -1
    counted = spread.groupBy(*keys, F.col("cell.j").alias("j"), F.col("cell.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(base & F.col(f"__b{j}")).alias(f"__b{j}") for j in range(len(wanted))])
    counted = session.materialize(counted, "quantile-counts")
    found = running(counted.where("j >= 0").select(*keys, "j", "v", "n"), [*keys, "j"], ["v"], [("upto", "sum", "n")])
    # the ranks around p * (n - 1), less what lies below the bracket
    names = F.array(*[F.struct(F.lit(j).alias("tj"), F.lit(cols[i]).alias("column"), F.lit(p).alias("prob"), F.lit(i).alias("i")) for j, (i, p) in enumerate(wanted)])
    n_of = F.array(*[F.col(f"__n{i}") for i in range(len(cols))])
    targets = stats.select(*[F.col(k).alias(f"{k}_") for k in keys], n_of.alias("ns"), F.explode(names).alias("w")) \
        .select(*[f"{k}_" for k in keys], "w.*", (F.col("w.prob") * (F.get("ns", F.col("w.i")) - 1)).alias("h"))
    under = counted.where("j = -1").select(*[F.col(k).alias(f"{k}_") for k in keys], F.posexplode(F.array(*[F.col(f"__b{j}") for j in range(len(wanted))])).alias("tj", "below"))
    on_targets = [F.col("t.tj") == F.col("u.tj"), *[F.col(f"t.{k}_").eqNullSafe(F.col(f"u.{k}_")) for k in keys]]
    targets = targets.alias("t").join(under.alias("u"), on_targets).select("t.*", "below")
    near = found.join(targets, [F.col("j") == F.col("tj"), *[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]])
    upto = F.col("below") + F.col("upto")
    ends = near.groupBy(*keys, "column", "prob", "h", "below").agg(
        F.min(F.when(upto > F.floor("h"), F.col("v"))).alias("lo"), F.min(F.when(upto > F.ceil("h"), F.col("v"))).alias("hi"))
    # the sketch's bound says that no rank lies outside its bracket; a wrong answer would be silent, so it is looked at
    held = (F.col("below") <= F.floor("h")) & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    value = F.when(held, F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo"))) \
        .otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    return ends.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "column", "prob", value.alias("value"))


def pivoted(quantiles: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row a group with the value of each column, for quantiles of one probability."""
    return quantiles.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols])

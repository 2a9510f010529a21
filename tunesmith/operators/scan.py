"""Skew-safe running aggregates (segmented prefix scans).

Running best score, cumulative time, iteration numbers, running means, step fill
("last value so far") and cumulative counts for exact quantiles are all prefix scans over
an ordered group. A plain ``Window.partitionBy(group).orderBy(...)`` puts a whole group
into one task, so a single hot run (a third of the log) would land on one executor.

``running`` takes one path for groups of all sizes. Rows of a group belong to chunks of about ``rows_per_chunk`` rows,
in order; each chunk is scanned by itself (window by group and chunk), the chunks' totals are added up (a
table of one row for each group and chunk) and joined back. A group that fits has one chunk. Rows of larger groups are
dealt by range over (group, order keys, a number of the row), whose boundaries Spark samples from the rows
themselves, and are stored with their range as chunk: so neither outliers nor equal, NULL or NaN keys fill a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith import session

KINDS = ("sum", "max", "min", "count", "last", "mean")


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_DEFAULTS = {
    T.StringType: "", T.BooleanType: False, T.TimestampType: "1970-01-01 00:00:00",
    T.TimestampNTZType: "1970-01-01 00:00:00", T.DateType: "1970-01-01",
}


def _group_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add ``__gv{i}`` (value or a typed default) and ``__gn{i}`` (is-null) per group column."""
    keys = []
    for i, k in enumerate(by):
        dtype = df.schema[k].dataType
        if not df.schema[k].nullable:
            df = df.withColumn(f"__gv{i}", F.col(k))
            keys.append(f"__gv{i}")
            continue
        default = _DEFAULTS.get(type(dtype), 0)
        df = df.withColumn(f"__gv{i}", F.coalesce(F.col(k), F.lit(default).cast(dtype)))
        df = df.withColumn(f"__gn{i}", F.col(k).isNull())
        keys += [f"__gv{i}", f"__gn{i}"]
    return df, keys


def _cut(rows: DataFrame, keys: list[str], order: list[str], target: int) -> DataFrame:
    """``rows`` with ``__chunk``: 0 in groups of at most ``target`` rows, else the row's range.

    The ranges of the large groups are stored: both the scan and the totals read them, and boundaries that
    were sampled anew could differ.
    """
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > target)
    n = large.agg(F.sum("__n")).first()[0]
    whole = rows.withColumn("__chunk", F.lit(0))
    if n is None:
        return whole
    large = session.materialize(large.select(*keys), "scan-large-groups")
    ranges = max(2, -(-n // target))
    cut = rows.join(large, keys, "left_semi").withColumn("__row", F.monotonically_increasing_id()) \
        .repartitionByRange(ranges, *keys, *order, "__row").withColumn("__chunk", F.spark_partition_id()).drop("__row")
    return whole.join(large, keys, "left_anti").unionByName(session.materialize(cut, "scan-chunks"))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence,
    specs: Sequence[tuple],
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add running aggregates to ``df``.

    Parameters
    ----------
    by:     group columns (may be empty: one global order).
    order:  order columns / Columns, of any type that Spark orders, ascending with NULL first; ties must be
            broken by the caller for determinism.
    specs:  ``(name, kind, column)`` with kind in sum/max/min/count/last/mean; ``column``
            may be None for ``count`` (row number). ``last`` = last non-null value so far.
    rows_per_chunk: chunk size; defaults to the session setting ``tunesmith.scan.rowsPerChunk``.

    The frame is ``ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW`` in every case.
    """
    by = list(by)
    order = [_as_col(o) for o in order]
    if not order:
        raise ValueError("running() needs at least one order column")
    if not by:  # one global order: a constant group key keeps every join an equi-join
        return running(df.withColumn("__all", F.lit(0)), ["__all"], order, specs, rows_per_chunk).drop("__all")
    target = int(rows_per_chunk or session.rows_per_chunk(df.sparkSession))

    # Materialise every input expression once, so later stages reference plain columns.
    base_cols = df.columns
    inputs: list[tuple[str, str, str | None]] = []  # (name, kind, input column)
    # Group keys as plain non-null columns (value-or-default, is-null flag): every later
    # equi-join and window then uses exactly the same keys, so the big side keeps the
    # partitioning of the (group, chunk) exchange and NULL groups stay distinct.
    prepared, gkeys = _group_keys(df, by)
    for i, (name, kind, col) in enumerate(specs):
        if kind not in KINDS:
            raise ValueError(f"unknown running kind {kind!r}")
        if col is None:
            if kind != "count":
                raise ValueError(f"{kind} needs a column")
            inputs.append((name, kind, None))
            continue
        tmp = f"__in{i}"
        prepared = prepared.withColumn(tmp, _as_col(col))
        inputs.append((name, kind, tmp))
    order_names = []
    for j, o in enumerate(order):
        tmp = f"__ord{j}"
        prepared = prepared.withColumn(tmp, o)
        order_names.append(tmp)
    # 1. the chunk of every row.
    chunked = _cut(prepared, gkeys, order_names, target)

    # 2. local scan inside each chunk.
    ordered = [F.col(o).asc_nulls_first() for o in order_names]
    w = Window.partitionBy(*gkeys, "__chunk").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def local_expr(kind, col):
        if kind == "count":
            return F.count(F.lit(1) if col is None else F.col(col)).over(w)
        if kind in ("sum", "mean"):
            return F.sum(col).over(w)
        if kind == "max":
            return F.max(col).over(w)
        if kind == "min":
            return F.min(col).over(w)
        return F.last(col, ignorenulls=True).over(w)

    local = chunked
    for name, kind, col in inputs:
        local = local.withColumn(f"__loc_{name}", local_expr(kind, col))
        if kind == "mean":
            local = local.withColumn(f"__locn_{name}", F.count(col).over(w))

    # 3. chunk totals (same partitioning as the window -> no new exchange) and their prefix.
    def total_expr(kind, col):
        if kind == "count":
            return F.count(F.lit(1) if col is None else F.col(col))
        if kind in ("sum", "mean"):
            return F.sum(col)
        if kind == "max":
            return F.max(col)
        if kind == "min":
            return F.min(col)
        return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*[F.col(o) for o in order_names])))

    aggs = []
    for name, kind, col in inputs:
        aggs.append(total_expr(kind, col).alias(f"__tot_{name}"))
        if kind == "mean":
            aggs.append(F.count(col).alias(f"__totn_{name}"))
    totals = local.groupBy(*gkeys, "__chunk").agg(*aggs)
    wp = Window.partitionBy(*gkeys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)

    def prefix_expr(kind, c):
        if kind in ("sum", "count", "mean"):
            return F.sum(c).over(wp)
        if kind == "max":
            return F.max(c).over(wp)
        if kind == "min":
            return F.min(c).over(wp)
        return F.last(c, ignorenulls=True).over(wp)

    offsets = totals
    for name, kind, col in inputs:
        offsets = offsets.withColumn(f"__off_{name}", prefix_expr(kind, F.col(f"__tot_{name}")))
        if kind == "mean":
            offsets = offsets.withColumn(f"__offn_{name}", F.sum(f"__totn_{name}").over(wp))
    offsets = offsets.select(*gkeys, "__chunk", *[c for c in offsets.columns if c.startswith("__off")])

    # 4. combine.
    out = local.join(offsets, on=[*gkeys, "__chunk"], how="left")
    final = []
    for name, kind, col in inputs:
        loc, off = F.col(f"__loc_{name}"), F.col(f"__off_{name}")
        if kind == "count":
            expr = loc + F.coalesce(off, F.lit(0))
        elif kind == "sum":
            expr = F.when(loc.isNull(), off).when(off.isNull(), loc).otherwise(loc + off)
        elif kind == "mean":
            s = F.when(loc.isNull(), off).when(off.isNull(), loc).otherwise(loc + off)
            n = F.col(f"__locn_{name}") + F.coalesce(F.col(f"__offn_{name}"), F.lit(0))
            expr = F.when(n > 0, s / n)
        elif kind == "max":
            expr = F.greatest(loc, off)
        elif kind == "min":
            expr = F.least(loc, off)
        else:
            expr = F.coalesce(loc, off)
        final.append(expr.alias(name))
    keep = [c for c in base_cols if c not in {n for n, _, _ in inputs}]
    return out.select(*keep, *final)


def plain_running(df: DataFrame, by: Sequence[str], order: Sequence, specs: Sequence[tuple]) -> DataFrame:
    """Reference implementation with one window per group (used by tests as the baseline)."""
    order = [_as_col(o).asc_nulls_first() for o in order]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    for name, kind, col in specs:
        c = None if col is None else _as_col(col)
        if kind == "count":
            e = F.count(F.lit(1) if c is None else c).over(w)
        elif kind == "sum":
            e = F.sum(c).over(w)
        elif kind == "mean":
            e = F.avg(c).over(w)
        elif kind == "max":
            e = F.max(c).over(w)
        elif kind == "min":
            e = F.min(c).over(w)
        else:
            e = F.last(c, ignorenulls=True).over(w)
        out = out.withColumn(name, e)
    return out

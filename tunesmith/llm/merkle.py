"""Merkle manifest of a dataset: one hash tree per group, one tree over the groups' roots, a proof per row.

Only every ``span``-th level of a tree is stored (the leaves are level 0). What lies between is made
twice and kept never: once when the next stored level is computed, and once when proofs are read, where each
aligned subtree of at most ``2 ** span`` stored nodes makes its missing interior nodes anew, emits the
siblings on every path and forgets them. Proofs go from the top down: a stored node's path above itself
meets the subtree below it in one cogroup, so a task holds one subtree and one path at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.session import materialize

#: Levels between two stored ones: a subtree has at most 1,024 nodes at its foot.
SPAN = 10

PATH = T.ArrayType(T.StructType([T.StructField("digest", T.StringType()), T.StructField("left", T.BooleanType())]))


def digest_of(*values: Column) -> Column:
    """Lowercase hex SHA-256 over the values: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with ``idx``, their place (from 0) within the group by ``order`` (nulls first), and ``n``, its size.

    Rows are dealt by range over (group, order, a tie-breaker) and stored in order, each with its partition and
    seat there; the few (group, partition) runs are summed up and joined back. No group meets in one
    task: a group of a third of all rows lies in a third of the ranges, also where all its rows are equal.
    """
    tie = F.monotonically_increasing_id().alias("_tie")
    keys = [*group, *order, "_tie"]
    seated = df.select("*", tie).repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys) \
        .drop("_tie").withColumn("_seat", F.monotonically_increasing_id())
    seated = materialize(seated, name).withColumn("_part", F.shiftright("_seat", 33))
    runs = seated.groupBy(*group, "_part").agg(F.min("_seat").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*group)
    runs = runs.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), "_first",
                       (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).alias("_before"),
                       F.sum("_rows").over(whole).alias("n"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = seated.join(runs, same)
    return out.select(*df.columns, (F.col("_seat") - F.col("_first") + F.col("_before")).alias("idx"), "n")


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def subtree(digests: list[str], levels: int) -> list[list[str]]:
    """The levels of an aligned subtree, from its foot; a run is two neighbours, the last one may be alone."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([_h("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return out


def _height(n: int) -> int:
    return (n - 1).bit_length()


@dataclass
class Tree:
    """Stored levels: (g, idx, n, digest), n being the group's number of nodes at that level; level 0 has further columns."""

    levels: list[DataFrame]
    span: int


def build(leaves: DataFrame, span: int = SPAN, name: str = "merkle") -> Tree:
    """The tree of every group of ``leaves`` (g, idx, n, digest, more); each level is stored before the next is read."""

    def top(key, rows):
        rows = rows.sort_by("idx")
        n = rows["n"][0].as_py()
        made = subtree(rows["digest"].to_pylist(), min(span, _height(n)))
        return pa.table({"g": [key[0].as_py()], "idx": [key[1].as_py()], "n": [-(-n // (1 << span))], "digest": made[-1]}, schema=up)

    up = pa.schema([("g", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    levels = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        nodes = levels[-1].select("g", F.shiftright("idx", span).alias("block"), "idx", "n", "digest")
        levels.append(materialize(nodes.groupBy("g", "block").applyInArrow(top, "g long, idx long, n long, digest string"), name))
        largest = -(-largest // (1 << span))
        if largest <= 1:
            return Tree(levels, span)


def paths(tree: Tree, above: DataFrame, name: str = "merkle-paths") -> DataFrame:
    """Leaves with their path: [(sibling's digest or null, whether it lies left)] from the leaf to the end of ``above``.

    ``above`` (g, path, more) continues the path of each group's root; its further columns come along.
    A null digest is a level at which the node had no sibling.
    """
    span = tree.span
    lower = above.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(tree.levels) - 2, -1, -1):
        nodes = tree.levels[k].withColumn("block", F.shiftright("idx", span))
        kept = [f for f in nodes.schema if f.name not in ("g", "block", "idx", "n", "digest")] if k == 0 else []
        more = [f for f in lower.schema if f.name not in ("g", "block", "path")]
        schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("digest", T.StringType()),
                               *kept, T.StructField("path", PATH), *more])
        names, carried, given = [f.name for f in schema], [f.name for f in kept], [f.name for f in more]

        def extract(left, right):
            left = left.sort_by("idx").combine_chunks()
            made = subtree(left["digest"].to_pylist(), min(span, _height(left["n"][0].as_py())))
            rest = right["path"][0].as_py()
            rest_digests, rest_left = [p["digest"] for p in rest], [p["left"] for p in rest]
            digests, sides, ends = [], [], [0]
            for i in range(len(left)):
                for j, row in enumerate(made[:-1]):
                    at = (i >> j) ^ 1
                    digests.append(row[at] if at < len(row) else None)
                    sides.append(at < (i >> j))
                digests += rest_digests
                sides += rest_left
                ends.append(len(digests))
            steps = pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(sides, pa.bool_())], ["digest", "left"])
            cols = {"g": left["g"], "idx": left["idx"], "digest": left["digest"], **{c: left[c] for c in carried},
                    "path": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)}
            for c in given:
                cols[c] = pa.array([right[c][0].as_py()] * len(left), right.schema.field(c).type)
            return pa.table([cols[c] for c in names], names=names)

        found = nodes.groupBy("g", "block").cogroup(lower.groupBy("g", "block")).applyInArrow(extract, schema)
        lower = found if k == 0 else materialize(found.select("g", F.col("idx").alias("block"), "path", *given), name)
    return lower


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    def step(acc, p):
        sibling = F.coalesce(p["digest"], F.lit(""))
        return F.sha2(F.when(p["left"], F.concat(sibling, acc)).otherwise(F.concat(acc, sibling)), 256)

    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None,
             span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: id, leaf, path, subroot, root and the columns of ``keep``.

    A leaf hashes ``columns``. Leaves of one group ascend by ``order`` (null first; rows that share it by their
    leaf, so equal rows are leaves each); two neighbours make a node, the last one alone if need be, until one is
    left, the group's subroot. The subroots, ordered by group (null first, bytewise), make the root alike.

    Null and empty values, very long texts and nulls as group or id hash as ``digest_of`` says. Other
    columns of ``docs`` are not read. An empty table gives no rows.
    """
    kept = keep or {}
    rows = docs.select(F.col(order).alias("_order"), F.col(group).alias("_group"), digest_of(*[F.col(c) for c in columns]).alias("digest"),
                       *[c.alias(f"_keep_{name}") for name, c in kept.items()])
    leaves = numbered(rows, ["_group"], ["_order", "digest"], "merkle-leaves")
    groups = numbered(leaves.where("idx = 0").select("_group"), [], ["_group"], "merkle-groups")
    groups = materialize(groups.select(F.col("_group").alias("_of"), F.col("idx").alias("g"), F.col("n").alias("groups")), "merkle-groups")
    leaves = materialize(leaves.join(groups.select("_of", "g"), F.col("_group").eqNullSafe(F.col("_of"))).drop("_of", "_group"), "merkle-leaves")
    tree = build(leaves, span)
    roots = tree.levels[-1].select("g", F.col("digest").alias("subroot")).join(groups.select("g", "groups"), "g") \
        .select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.col("groups").alias("n"), F.col("subroot").alias("digest"))
    over = build(materialize(roots, "merkle-subroots"), span, "merkle-root")
    end = over.levels[-1].select("g", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = materialize(paths(over, end).select(F.col("idx").alias("g"), "path", F.col("digest").alias("subroot"), "root"), "merkle-paths")
    found = paths(tree, above)
    return found.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "path", "subroot", "root",
                        *[F.col(f"_keep_{name}").alias(name) for name in kept])


def proof_digest(path: Column) -> Column:
    """SHA-256 over the digests of all siblings on a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda p: p["digest"]), ""), 256)

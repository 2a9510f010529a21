"""Exact deduplication by content hash, with byte comparison inside the hash groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of ASCII white space; a lone space is already what it would be replaced by, so it is not matched.
WHITE_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; every run of ``[\\x20\\x09-\\x0D]`` as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUNS, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit MD5 of the normalised text *and* the text itself, so a hash
    collision cannot merge different texts. Copies collapse inside each map task before the one
    shuffle that carries texts; a text held by a third of all rows is one row per task there. The
    classes are joined back to (id, hash) rows, a join that adaptive execution splits when hot.

    Null texts count as empty and are copies of each other. ``keep_id`` is the smallest non-null id
    of the class (null where all its ids are null); exactly one row of a class has ``kept``: among
    rows that share the smallest id, one of them. Other columns of ``docs`` are not read.
    An empty table gives no rows.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    keyed = rows.select("id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("s"), "norm")
    classes = keyed.groupBy("h", "s", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")) \
        .select("h", "s", "keep_id", "group_size")
    # rows that share id and text are counted, so that one of them can stay
    members = keyed.groupBy("id", "h", "s").agg(F.count(F.lit(1)).alias("n"))
    out = members.join(classes, ["h", "s"])
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")
    out = out.select("id", "s", "keep_id", "group_size", nth)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )

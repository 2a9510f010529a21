"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a common neighbour within ceil(r/2) bits of one and
floor(r/2) bits of the other. So every distinct fingerprint emits all variants within half the
radius; fingerprints that emit a common variant are the only candidates, and none is missed. A
variant's bucket holds at most as many fingerprints as a ball has variants (65 for r = 2), however
many documents are copies of each other, since copies are one fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm.components import connected_components
from tunesmith.llm.line_dedup import doc_key
from tunesmith.session import materialize

SEED = 42
BITS = 64
_CHUNK = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles: A-Z lower-cased, words between ASCII white space, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    n = len(starts)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])]
        octets = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long; null and wordless texts give 0."""
    kind = docs.schema[id_col].dataType

    def scan(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema)


def _masks(radius: int) -> list[int]:
    out = []
    for bits in combinations(range(BITS), radius):
        m = sum(1 << b for b in bits)
        out.append(m - (1 << BITS) if m >= 1 << (BITS - 1) else m)
    return out


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join every pair at most ``max_bits`` apart.

    Not every pair is listed, but all fingerprints of a variant's bucket are linked to its smallest
    inner member, so the components are those of all pairs. Each link is verified by its bit count.
    """
    outer, inner = (max_bits + 1) // 2, max_bits // 2
    distinct = fps.select("fp").where("fp is not null").distinct()
    ball = [(level, m) for level in range(outer + 1) for m in _masks(level)]
    inner_masks = F.array(*[F.lit(m).cast("long") for level, m in ball if level <= inner])
    variants = distinct.select("fp", F.explode(inner_masks).alias("m"), F.lit(True).alias("inner"))
    if outer > inner:
        outer_masks = F.array(*[F.lit(m).cast("long") for level, m in ball if level > inner])
        variants = variants.union(distinct.select("fp", F.explode(outer_masks).alias("m"), F.lit(False).alias("inner")))
    variants = variants.select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), "fp", "inner")
    hub = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("variant"))
    pairs = variants.select("fp", hub.alias("hub")).where("hub is not null and hub <> fp")
    return pairs.select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")).distinct() \
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable over links, the row's own included. Null and
    wordless texts have fingerprint zero and are linked like any other. Rows that repeat an id stay
    rows; null ids are never a component's smallest id (a component of null ids only has null).
    Other columns are not read; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(links(fps, max_bits))
    # one row per distinct fingerprint: its root, and the smallest id under that root
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    owners = rooted.join(lows, "root").select("fp", "component_id")
    return fps.join(owners, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component stays.

    Rows are told apart by id and text, so rows that repeat an id count each for its own text. The first
    row of a component stays: the one with the smallest id (nulls last), then the smallest hash of id
    and text. Rows that share both are interchangeable, and one of them stands for all; a null text
    counts as an empty one there. Rows with a null id go like others when a near copy stays.
    """
    k1, k2 = doc_key(id_col, text_col)
    named = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("id"), k1, k2)
    keyed = docs.select(named.alias("key"), F.col(text_col).alias("text"))
    found = near_duplicates(keyed, "key", "text", shingle, max_bits)
    same = [F.col(f"key.{c}") == F.col(f"component_id.{c}") for c in ("z", "k1", "k2")]
    stay = found.where(same[0] & same[1] & same[2]).select("key.z", "key.k1", "key.k2").distinct()
    packed = docs.select(named.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) \
        .select("key.z", "key.k1", "key.k2", "row")
    kept = packed.join(stay, ["z", "k1", "k2"], "left_semi").groupBy("z", "k1", "k2").agg(F.first("row").alias("row"))
    return kept.select("row.*")

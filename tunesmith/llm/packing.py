"""Best-fit packing planned on the histogram of lengths.

The plan never sees documents, only how many pieces of each length there are (at most ``capacity``
rows on the driver). Best-fit decreasing over these counts yields runs of equal slots; each run is
expanded on the executors to one row per slot, and pieces take slots by joining on (length, rank
within length).
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.session import materialize

#: Parts that the pieces of one length are ranked in, so that a length with most of the rows is no single task.
RANK_PARTS = 256
SLOT_ROWS = 100_000  # slots of one length, rank run and place that one row stands for at most

Run = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over counts: runs (length, first rank, slots, first sequence, offset).

    Slots of a run have ranks and sequences that count up together. Each length takes the fullest open
    sequences that still hold it; what is left opens new ones, filled with as many as fit.
    """
    room: list[int] = []  # the sizes of free space there are, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges (first sequence, how many)
    runs: list[Run] = []
    new = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in open_:
                open_[space] = []
                insort(room, space)
            open_[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit into {capacity}")
        at = bisect_left(room, length)
        while left and at < len(room):
            space = room[at]
            while left and open_.get(space):
                first, n = open_[space].pop()
                take = min(n, left)
                runs.append((length, rank, take, first, capacity - space))
                rank, left = rank + take, left - take
                if take < n:
                    open_[space].append((first + take, n - take))
                put(space - length, first, take)
            if not open_[space]:
                del open_[space]
                room.remove(space)
            at = bisect_left(room, length)
        each = capacity // length
        full, rest = divmod(left, each)
        for sequences, held in ((full, each), (1 if rest else 0, rest)):
            if sequences:
                for k in range(held):
                    runs.append((length, rank, sequences, new, k * length))
                    rank += sequences
                put(capacity - held * length, new, sequences)
                new += sequences
    return runs


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", rank_parts: int = RANK_PARTS) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset (its place there, gapless from 0).

    ``pieces`` must give the same rows whenever it is read (a stored table); ``length_col`` counts
    1 to ``capacity`` in every row. Which of several pieces of one length takes which slot follows
    a hash of the row, ties in any order. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    taken = {c.lower() for c in pieces.columns}
    if clash := taken & {"sequence_id", "offset", "_part", "_rank"}:
        raise ValueError(f"columns {sorted(clash)} of the pieces clash with the result's")
    length = F.col(length_col).cast("long")
    counts = {r["l"]: r["n"] for r in pieces.groupBy(length.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in counts:
        raise ValueError("a piece has no length")
    runs = plan(counts, capacity)
    schema = "l long, first_rank long, slots long, first_sequence long, offset long"
    # a run of equal slots is cut into pieces before it becomes rows, so that no task holds a long run
    cut = F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOT_ROWS).cast("long"))
    slots = spark.createDataFrame(runs, schema).select("*", F.explode(cut).alias("from")) \
        .repartition(max(1, -(-sum(counts.values()) // SLOT_ROWS))) \
        .select("l", "first_rank", "first_sequence", "offset",
                F.explode(F.sequence(F.col("from"), F.least("slots", F.col("from") + SLOT_ROWS) - 1)).alias("k")) \
        .select(F.col("l").alias("_l"), (F.col("first_rank") + F.col("k")).alias("_r"),
                (F.col("first_sequence") + F.col("k")).alias("sequence_id"), F.col("offset").alias("offset"))
    # rank within length = rank within (length, part) + pieces of that length in the parts before
    keys = [F.col(f"`{c}`") for c in pieces.columns if dict(pieces.dtypes)[c] in ("bigint", "int", "string", "smallint")]
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64(length, *keys), F.lit(rank_parts)))
    sizes = parted.groupBy(length.alias("_pl"), F.col("_part").alias("_pp")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_pl", "_pp", (F.sum("n").over(Window.partitionBy("_pl").orderBy("_pp")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(length, "_part").orderBy(*keys)) - 1
    ranked = parted.withColumn("_in", inside)
    ranked = ranked.join(before, (length == F.col("_pl")) & (F.col("_part") == F.col("_pp"))) \
        .withColumn("_rank", F.col("_before") + F.col("_in"))
    return ranked.join(slots, (length == F.col("_l")) & (F.col("_rank") == F.col("_r"))) \
        .select(*[F.col(f"`{c}`") for c in pieces.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Token pieces of all documents packed into sequences of at most ``capacity`` tokens.

    One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. A document is its
    token ids and ``end_id``; only a longer one than ``capacity`` is cut. Null and empty texts are one
    piece of one token; rows that repeat are packed each; null ids stay null; other columns are not
    read; an empty table gives no rows.
    """
    from tunesmith.llm.bpe import token_pieces

    pieces = materialize(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity)

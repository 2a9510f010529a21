"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

1. Lines that are equal after trimming and lower-casing become one row of a distinct-line table, stored
   in buckets of the line's hash, so that later steps join it without moving texts again.
2. MinHash signatures of character shingles: a line's shingles are exploded and reduced to minima where
   the line is stored (no shuffle). Each minimum is taken under its own XOR mask of one 64-bit hash.
3. Bands of the signature are shuffled; lines that share a band are candidates. Each links to the
   smallest line of its bucket, in two levels with salt, so a hot bucket is no single task and no
   pairs of a bucket are enumerated.
4. Links are verified by the exact Jaccard similarity of the shingle sets. Where a link fails, a pair of
   the bucket may be alike that was not linked; so the members of such buckets get finer bands of
   fresh minima, whose stars are verified likewise.
5. Where a bucket of either kind still holds several components, the lines outside its largest one meet
   all lines of other components there. Sketches of the shingle sets bound a pair's difference from below
   inside that join, so only pairs that may be alike leave it. Lines of buckets with very many such
   lines, and lines too long for a sketch, are joined on their rarest shingles instead (prefix filter).
   Neither misses an alike pair, so every one that shares a band of step 3 ends in one component.
6. Distributed union-find; of each component the first line in the order of documents stays.
"""

from __future__ import annotations

import gc
import random
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunesmith.llm.components import connected_components
from tunesmith.llm.features import free_names
from tunesmith.session import ensure_checkpoint_dir, materialize, release

SHINGLE = 8        # characters
SIMILARITY = 0.8
BANDS, ROWS = 6, 3        # a pair of similarity 0.8 / 0.85 / 0.9 shares a band with probability 0.986 / 0.997 / 0.9996
FINE_BANDS, FINE_ROWS = 8, 4  # for members of buckets with a failed link: 0.985 / 0.997 / 0.9998
SALT = 64          # parts of a band's bucket on the first level
WORDS = 16         # longs of a line's sketch
SKETCHED = WORDS * 64 * 9 // 4  # shingles; the sketches of longer lines differ in too few bits to tell them apart
OUTSIDE = 1 << 14  # lines of a bucket outside its largest component that are met one by one; of more, rare shingles are joined
MEETINGS = 1 << 24  # pairs of a bucket that are met in one task
# Shingle counts are kept by slots of their hash; they only order shingles, so a shared slot loses nothing. But where slots hold
# many shingles each, rare ones look frequent and chance neighbours share a prefix: so their number follows that of the shingles.
SHINGLES_A_SLOT, LEAST_SLOTS, MOST_SLOTS = 8, 1 << 18, 1 << 25
BLOCK = 1 << 12    # slots a row of the table of counts, a byte each: 32 MB at most

_draw = random.Random(0x11E5)
_MASKS = [_draw.getrandbits(64) - (1 << 63) for _ in range(BANDS * ROWS + FINE_BANDS * FINE_ROWS)]


BLANKS = " \t\r\f\x0b"  # at the ends of a line these do not count
_WORD = r"[\p{L}\p{N}]"


def _norm(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(BLANKS)))


def doc_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a document by its id and text, so that rows that only share the id stay apart."""
    parts = (F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *parts).alias("k2")]


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, pos, norm, h1, h2) of every line that holds a letter or digit; the others take no part."""
    lines = docs.select(F.col(id_col).alias("id"), *doc_key(id_col, text_col),
                        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    # most lines show a letter or digit at once; only others are searched whole
    lines = lines.where(F.substring("line", 1, 16).rlike(_WORD) | F.col("line").rlike(_WORD))
    lines = lines.select("id", "k1", "k2", "pos", _norm(F.col("line")).alias("norm"))
    return lines.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(7), "norm")})


def _shingle_hash(units: Column, at: Column) -> Column:
    """Hash of the shingle that starts at character ``at`` (from 0) of a UTF-16 binary."""
    return F.xxhash64(F.substring(units, at * 2 + 1, F.lit(2 * SHINGLE)))


def _last_start(units: Column) -> Column:
    return F.greatest((F.octet_length(units) / 2).cast("int") - SHINGLE, F.lit(0))


def shingle_set(norm: Column) -> Column:
    """The distinct shingles of a line; a line shorter than a shingle is one shingle.

    One pass of a look-ahead pattern: slices of a long line by position would each copy or scan it.
    """
    found = F.regexp_extract_all(norm, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.when(F.length(norm) < SHINGLE, F.array(norm)).otherwise(F.array_distinct(found))


def _surrogates(norm: Column) -> Column:
    return norm.rlike(r"[\x{10000}-\x{10FFFF}]")


def _hash_set(norm: Column) -> Column:
    """The distinct shingles of a line as hashes of their UTF-16, whose units are characters but for surrogates."""
    # as a lambda's variable the encoded line is made once, not for every shingle
    units = F.transform(F.array(F.encode(norm, "UTF-16BE")),
                        lambda u: F.transform(F.sequence(F.lit(0), _last_start(u)), lambda i: _shingle_hash(u, i)))
    others = F.transform(shingle_set(norm), lambda x: F.xxhash64(F.encode(x, "UTF-16BE")))
    return F.array_distinct(F.when(_surrogates(norm), others).otherwise(units[0]))


def _signatures(lines: DataFrame, masks: list[int], whole: bool) -> DataFrame:
    """(h1, m0, m1, ...): the minimum of a line's shingle hashes under each mask, by one pass over its shingles.

    Unless ``whole``, only the lowest eighth or fourth of the range of hashes is looked at in lines that have many places;
    a minimum is null where no shingle is there, else it is that of all shingles.
    """
    share = F.when(F.length("norm") < 128, F.lit((1 << 63) - 1)).when(F.length("norm") < 256, F.lit(-(1 << 62))).otherwise(F.lit(-(3 << 61)))
    starts = lines.select("h1", F.encode("norm", "UTF-16BE").alias("u"), share.alias("to"))
    starts = starts.select("h1", "u", "to", F.explode(F.sequence(F.lit(0), _last_start(F.col("u")))).alias("i"))
    hashed = starts.select("h1", "to", _shingle_hash(F.col("u"), F.col("i")).alias("s"))
    low = "" if whole else " filter (where (s ^ {0}L) <= to)"
    return hashed.groupBy("h1").agg(*[F.expr(("min(s ^ {0}L)" + low).format(m)).alias(f"m{j}") for j, m in enumerate(masks)])


def _bands(lines: DataFrame, bands: int, rows: int, masks: list[int]) -> tuple[DataFrame, list[DataFrame]]:
    """(band, h1): hashed bands of the MinHash signature of every distinct line, and the stored tables that they are in."""
    def keyed(signatures: DataFrame) -> DataFrame:
        keys = [F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)]
        full = reduce(Column.__and__, [F.col(f"m{j}").isNotNull() for j in range(len(masks))])
        return signatures.select("h1", F.when(full, F.array(*keys)).alias("keys"))

    stored = [materialize(keyed(_signatures(lines, masks, False)), "line-bands")]
    missing = stored[0].where("keys is null").select("h1")  # lines that repeat a few shingles
    if missing.limit(1).count():
        again = lines.join(missing.hint("shuffle_hash"), "h1", "left_semi")
        stored.append(materialize(keyed(_signatures(again, masks, True)), "line-bands"))
    return reduce(DataFrame.union, stored).select(F.explode("keys").alias("band"), "h1"), stored


def _stars(bands: DataFrame) -> DataFrame:
    """(band, h1, hub): each line of a shared bucket with the smallest line of its salted part, and the
    parts' smallest lines with the bucket's."""
    low = F.min("h1").over(Window.partitionBy("band", F.pmod("h1", F.lit(SALT))))
    parts = bands.select("band", "h1", low.alias("hub1"))
    hub = F.min("h1").over(Window.partitionBy("band"))
    tops = parts.where("h1 = hub1").select("band", "h1", hub.alias("hub"))
    return parts.where("h1 <> hub1").select("band", "h1", F.col("hub1").alias("hub")).union(tops.where("h1 <> hub"))


def _pairs(stars: DataFrame) -> DataFrame:
    return stars.select(F.least("h1", "hub").alias("a"), F.greatest("h1", "hub").alias("b")).distinct()


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets, as 64-bit hashes, are similar enough."""
    # the pairs are hashed, or every join would sort the texts of all lines
    left = pairs.hint("shuffle_hash").join(lines.select(F.col("h1").alias("a"), F.col("norm").alias("na")), "a")
    both = left.hint("shuffle_hash").join(lines.select(F.col("h1").alias("b"), F.col("norm").alias("nb")), "b")
    # the row numbers keep the filter from being pushed below, where it would compute sets and intersections again
    number = F.monotonically_increasing_id()
    sets = both.select("a", "b", _hash_set(F.col("na")).alias("x"), _hash_set(F.col("nb")).alias("y"), number.alias("r1"))
    sizes = sets.select("a", "b", "r1", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"),
                        number.alias("r2"))
    return sizes.where((F.col("c") >= SIMILARITY * (F.col("n") - F.col("c"))) & (F.col("r1") >= 0) & (F.col("r2") >= 0)).select("a", "b")


def _open_buckets(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, h1, root, other, parts, hot): the lines of all buckets whose members are in more than one component, lone lines as
    their own root.

    ``other`` says that a line is outside the bucket's largest component, ``hot`` that very many are; in ``parts`` the rest is met.
    A bucket of two lines has one link, which was compared.
    """
    lines = links.select("band", "h1").union(links.select("band", F.col("hub").alias("h1"))).distinct()
    low = roots.select(F.col("node").alias("h1"), F.col("root").alias("r"))
    members = materialize(lines.join(low, "h1", "left").select("band", "h1", F.coalesce("r", "h1").alias("root")), "line-members")
    by_root = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
    split = by_root.groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("m"),
                                        (F.sum("c") - F.max("c")).alias("out")).where("out > 0 and m > 2")
    split = split.select("band", "main", F.ceil(F.col("m") * F.col("out") / MEETINGS).cast("int").alias("parts"), (F.col("out") > OUTSIDE).alias("hot"))
    split = materialize(split, "line-split")
    found = members.join(split, "band").select("band", "h1", "root", (F.col("root") != F.col("main")).alias("other"), "parts", "hot")
    found = materialize(found, "line-open")
    release(members, split)
    return found


def _sketches(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, n, w0, w1, ...): of every line of ``members`` (h1) its number of shingles and, by slots of their hash, whether it is odd.

    Where the slots of two lines differ, at least one shingle is in one line only.
    """
    rows = lines.join(members.hint("shuffle_hash"), "h1").select("h1", F.explode(_hash_set(F.col("norm"))).alias("s"))
    bit, word = "shiftleft(1L, cast(s & 63 as int))", f"shiftrightunsigned(s, 6) % {WORDS}"
    words = [F.expr(f"coalesce(bit_xor({bit}) filter (where {word} = {w}), 0L)").alias(f"w{w}") for w in range(WORDS)]
    return rows.groupBy("h1").agg(F.count(F.lit(1)).cast("int").alias("n"), *words)


def _meeting(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): every pair of lines of different components in a bucket of ``members`` that may be alike by the sketches.

    Lines of n and m shingles are alike only if at most (n + m) / 9 are in one of them alone, so no more slots may differ.
    Pairs of two lines longer than ``SKETCHED`` are left out. A pair leaves only the first of its buckets.
    """
    of_line = members.groupBy("h1").agg(F.collect_set("band").alias("bands"))
    rows = members.join(sketches.join(of_line, "h1"), "h1")
    x = rows.withColumn("part", F.pmod(F.xxhash64("h1"), F.col("parts").cast("long")).cast("int"))
    y = rows.where("other").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    differ = " + ".join(f"bit_count(x.w{w} ^ y.w{w})" for w in range(WORDS))
    close = F.expr(
        "x.band = y.band and x.part = y.part and x.root <> y.root and (not x.other or x.h1 < y.h1)"
        f" and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) and least(x.n, y.n) <= {SKETCHED}"
        f" and 9 * ({differ}) <= x.n + y.n and not exists(x.bands, e -> e < x.band and array_contains(y.bands, e))")
    return x.alias("x").join(y.alias("y"), close).select(F.least("x.h1", "y.h1").alias("a"), F.greatest("x.h1", "y.h1").alias("b"))


def _end_of_step(*tables: DataFrame) -> None:
    """Delete tables of steps that are over, and let the driver's garbage collection free their shuffle files."""
    release(*tables)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def _slots(texts: DataFrame) -> int:
    """Slots for the shingle counts of the lines, a multiple of ``BLOCK``."""
    shingles = texts.agg(F.sum(F.length("norm"))).first()[0] or 0
    return -(-min(max(shingles // SHINGLES_A_SLOT, LEAST_SLOTS), MOST_SLOTS) // BLOCK) * BLOCK


def _counts_by_block(found: DataFrame, slots: int) -> DataFrame:
    """(block, f): the rows of every slot as a byte on a logarithmic scale, exact up to 8; slots without rows as 0."""
    every = found.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("c"))
    counts = found.select("slot", F.lit(1).alias("c")).union(every).groupBy("slot").agg(F.sum("c").alias("c"))
    level = F.least(F.floor(6 * F.log2(F.greatest("c", F.lit(1)))), F.lit(127)).cast("byte")
    counts = counts.select(F.shiftright("slot", BLOCK.bit_length() - 1).alias("block"), F.struct("slot", level.alias("f")).alias("x"))
    return counts.groupBy("block").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["f"]).alias("f"))


def _prefixes(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(s, h1, root, n, i): the rarest shingles of every line of ``members`` (h1, root): hash, the line's number of
    shingles and the shingle's place from 0 in the order (count, hash).

    Lines of n and m shingles are alike only if they share o >= 4/9 (n + m) of them; their first common shingle
    in that order then is at places i <= n - o and j <= m - o. As o >= 4/5 n, the first n / 5 + 1 places are enough.
    A line's shingles stay in its bucket: they are made for the counts and once more to be put in order, and
    only the prefixes leave the task.
    """
    texts = lines.join(members.hint("shuffle_hash"), "h1").select("h1", "root", "norm", F.monotonically_increasing_id().alias("r"))
    # units of UTF-16 are characters but for surrogates; both ways hash a shingle's UTF-16
    surrogates = _surrogates(F.col("norm"))
    kept = F.col("r") >= 0  # the row number keeps the filters from being pushed below, where they would search all lines
    units = texts.where(~surrogates & kept).select("h1", "root", F.encode("norm", "UTF-16BE").alias("u"))
    at = units.select("h1", "root", "u", F.explode(F.sequence(F.lit(0), _last_start(F.col("u")))).alias("i"))
    plain = at.select("h1", "root", _shingle_hash(F.col("u"), F.col("i")).alias("s")).distinct()
    others = texts.where(surrogates & kept).select("h1", "root", F.explode(shingle_set(F.col("norm"))).alias("x")) \
        .select("h1", "root", F.xxhash64(F.encode("x", "UTF-16BE")).alias("s"))
    slots = _slots(texts)
    slot = F.pmod("s", F.lit(slots)).cast("int")
    counts = materialize(_counts_by_block(plain.select(slot.alias("slot")).union(others.select(slot.alias("slot"))), slots), "line-counts")
    line = Window.partitionBy("h1")

    def head(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("block", F.shiftright(slot, BLOCK.bit_length() - 1)).join(F.broadcast(counts), "block")
        ranked = ranked.select("s", "h1", "root", F.get("f", F.pmod(slot, F.lit(BLOCK))).alias("f"))
        ranked = ranked.select("s", "h1", "root", F.count(F.lit(1)).over(line).cast("int").alias("n"), (F.row_number().over(line.orderBy("f", "s")) - 1).alias("i"))
        return ranked.where("5 * (n - i) >= 4 * n")

    out = materialize(head(plain).union(head(others)), "line-prefixes")
    release(counts)
    return out


def _sharing_rare(prefixes: DataFrame) -> DataFrame:
    """(a, b): every pair of lines of different components that may be alike by ``_prefixes``.

    Of the o >= 4/9 (n + m) shingles that alike lines of n >= m shingles share, the first l are at places i < n - o + l and
    j < m - o + l. So the shared ones among these places are counted, and l of them are asked for: chance neighbours
    that share one rare shingle, whose number grows with the square of the input, are never compared. l is m / 36, or less
    where the places of the longer line end at its prefix (i <= n / 5); the smaller line's places then are among its first 5/36 m + 1.
    A shingle's largest component is not joined with itself.
    """
    by_root = prefixes.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c"))
    main = by_root.groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
    main = materialize(main.select("s", "main"), "line-shared")
    rows = materialize(prefixes.join(main, "s").withColumn("other", F.col("root") != F.col("main")).drop("main"), "line-shared")
    _end_of_step(prefixes)
    small = rows.where("36 * (n - i) >= 31 * n")
    least = "greatest(1, least(y.n div 36, (4 * (x.n + y.n) + 8) div 9 + 1 - (4 * x.n + 4) div 5))"
    # one way round for lines of equal size, or they would count twice
    close = (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & F.expr(
        "(y.n < x.n or y.n = x.n and y.h1 < x.h1) and 5 * y.n >= 4 * x.n"
        f" and x.i < x.n - (4 * (x.n + y.n) + 8) div 9 + {least} and y.i < y.n - (4 * (x.n + y.n) + 8) div 9 + {least}")
    found = None
    for y, x in ((small.where("other"), rows), (small.where("not other"), rows.where("other"))):
        part = x.alias("x").join(y.alias("y"), close).select(F.least("x.h1", "y.h1").alias("a"), F.greatest("x.h1", "y.h1").alias("b"),
                                                             F.expr(least).alias("l"))
        found = part if found is None else found.union(part)
    found = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("l").alias("l")).where("shared >= l")
    found = materialize(found.select("a", "b"), "line-rare")
    release(main, rows)
    return found


def _distinct_lines(occ: DataFrame) -> tuple[DataFrame, str]:
    """Stored table (h1, norm, first, n) in buckets of h1; lines whose 64-bit hashes collide are left out (they stay)."""
    spark = occ.sparkSession
    name = f"distinct_lines_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tunesmith-tables/{name}"
    distinct = occ.groupBy("h1").agg(
        F.max("norm").alias("norm"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "k1", "k2", "pos")).alias("first"),
        F.count(F.lit(1)).alias("n"), F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo = hi").drop("lo", "hi")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct.write.bucketBy(buckets, "h1").option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._materialized_at = path
    return out, name


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, dropped): for each document with dropped lines its key and their sorted positions from 0.

    Of lines whose 64-bit hashes collide (two of 10**9 lines with a chance of 3 %) none is dropped. See ``deduplicate_lines`` for what counts as a line and which line stays.
    """
    occ = occurrences(docs, id_col, text_col)
    lines, name = _distinct_lines(occ)
    _end_of_step(occ)
    cut = BANDS * ROWS
    bands, stored = _bands(lines, BANDS, ROWS, _MASKS[:cut])
    links = materialize(_stars(bands), "line-links")
    _end_of_step(*stored)
    edges = materialize(_verified(_pairs(links), lines), "line-edges")
    # lines of buckets in which a link failed, once more in finer buckets
    kept = edges.select(F.col("a").alias("ea"), F.col("b").alias("eb"))
    failed = links.join(kept, (F.least("h1", "hub") == F.col("ea")) & (F.greatest("h1", "hub") == F.col("eb")), "left_anti")
    open_bands = failed.select("band").distinct()
    members = links.join(open_bands, "band", "left_semi")
    members = materialize(members.select("h1").union(members.select(F.col("hub").alias("h1"))).distinct(), "line-members")
    again = lines.join(members.hint("shuffle_hash"), "h1", "left_semi")
    bands, stored = _bands(again, FINE_BANDS, FINE_ROWS, _MASKS[cut:])
    finer_links = materialize(_stars(bands), "line-links")
    _end_of_step(members, *stored)
    more = materialize(_verified(_pairs(finer_links).join(_pairs(links), ["a", "b"], "left_anti"), lines), "line-edges")
    roots = materialize(connected_components(edges.union(more)), "line-roots")
    _end_of_step(edges, more)
    # what a hub did not stand for: lines of buckets with several components
    both = links.union(finer_links)
    still = _open_buckets(both, roots)
    sketches = materialize(_sketches(still.select("h1").distinct(), lines), "line-sketches")
    met = materialize(_meeting(still.where("not hot"), sketches), "line-met")
    # those that are too many or too long, by their rarest shingles
    rest = still.where("hot").select("h1", "root").union(still.join(sketches.where(f"n > {SKETCHED}"), "h1").select("h1", "root"))
    rest = materialize(rest.distinct(), "line-rest")
    _end_of_step(still, sketches)
    found = [met]
    if rest.limit(1).count():
        found.append(_sharing_rare(_prefixes(rest, lines)))
    unseen = reduce(DataFrame.union, found).distinct().join(_pairs(both), ["a", "b"], "left_anti")
    last = materialize(_verified(unseen, lines), "line-edges")
    _end_of_step(links, finer_links, rest, *found)
    if last.limit(1).count():
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(last)
        roots = materialize(connected_components(joined), "line-roots")
    # the first occurrence of each component, or of a lone line's class with copies
    linked = lines.select("h1", "first", "n").join(roots.withColumnRenamed("node", "h1"), "h1", "left")
    linked = materialize(linked.where("n > 1 or root is not null").select("h1", F.coalesce("root", "h1").alias("root"), "first"), "line-classes")
    firsts = materialize(linked.groupBy("root").agg(F.min("first").alias("stays")), "line-firsts")
    stays = materialize(linked.join(firsts, "root").select("h1", "stays"), "line-stays")
    lost = occ.select("k1", "k2", "pos", "h1").join(stays, "h1") \
        .where("k1 <> stays.k1 or k2 <> stays.k2 or pos <> stays.pos") \
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    lost = materialize(lost, "line-dropped")
    release(last, roots, linked, firsts, stays)
    docs.sparkSession.sql(f"drop table {name}")
    release(lines)
    return lost


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their dropped lines taken out of the text, all columns kept.

    A line ends at a newline. Lines that are equal without blanks, tabs and the like at the ends and lower-cased, or whose sets of
    8-character shingles have a Jaccard similarity of 0.8 or more, are linked (MinHash candidates,
    exact check); of each component the first line stays, in the order of document id (nulls last),
    then document, then position. Lines without a letter or digit always stay. A document may lose all its
    lines; its row stays with an empty text. Null texts stay null. Rows with the same id and text
    are one document here: each keeps the lines that the document keeps. An empty table gives no rows.
    """
    lost = dropped_lines(docs, id_col, text_col)
    a, b, dropped = free_names(docs.columns, "k1", "k2", "dropped")
    keep = F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(dropped, i))
    columns = [F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n")).alias(text_col)
               if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    named = lost.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("dropped").alias(dropped))
    k1, k2 = doc_key(id_col, text_col)
    return docs.join(named, (k1 == F.col(a)) & (k2 == F.col(b)), "left").select(*columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, dropped (positions from 0, sorted).

    A null text has one empty line, like an empty one. See ``deduplicate_lines`` for the rest.
    """
    lost = dropped_lines(docs, id_col, text_col)
    n_lines = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    rows = docs.select(F.col(id_col).alias("id"), *doc_key(id_col, text_col), n_lines.cast("long").alias("n_lines"))
    out = rows.join(lost, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))

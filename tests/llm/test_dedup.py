import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF001
from tunesmith.llm import components, exact_dedup, line_dedup, simhash


def union(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)]
    edges += [(900, i) for i in range(1000, 1100)] + [(5, 5), (5, None), (None, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == union({x for e in real for x in e}, real)
    assert components.connected_components(df.limit(0)).count() == 0


# exact dedup

def test_exact_edge_rows(edge, empty):
    got = sorted(tuple(r)[:4] for r in exact_dedup.exact_duplicates(edge).where("doc_id is not null").collect())
    assert got == [(1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True),
                   (6, 6, 1, True), (7, 7, 1, True), (8, 1, 4, False), (9, 9, 1, True)]
    lone = exact_dedup.exact_duplicates(edge).where("doc_id is null").first()
    assert lone.keep_id is None and lone.kept
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_one_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([(7, "a b")] * 3 + [(9, "a\n\nb")], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(7, 7, 4, False), (7, 7, 4, False), (7, 7, 4, True), (9, 7, 4, False)]


def test_exact_plan_is_native(edge):
    plan = exact_dedup.exact_duplicates(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# SimHash

def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: fingerprint(r.text) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = union(fps, links)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_simhash_links_every_close_pair(spark, radius):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(25)]
    for _ in range(6):
        fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for f in rng.sample(fps, 12)]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.links(df, radius).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in links)
    close = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    assert union(signed, links) == union(signed, close)


def test_simhash_edge_rows(edge, empty):
    got = simhash.near_duplicates(edge).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 11
    assert {by_id[i].component_id for i in (1, 2, 8)} == {1}
    assert {by_id[i].fingerprint for i in (3, 4, 5)} == {"0" * 16} and by_id[5].component_id == 3
    assert by_id[None].component_id is None
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 9]
    assert simhash.keep_one(empty).count() == 0


# lines

def shingles(line):
    n = line.strip(" \t\r\f\x0b").lower()
    return {n[i:i + 8] for i in range(max(len(n) - 7, 1))}


def brute_lines(rows):
    """Dropped (doc_id, position) pairs by comparing all lines with each other."""
    lines = [(i, p, line) for i, t in rows for p, line in enumerate((t or "").split("\n")) if any(c.isalnum() for c in line)]
    sets = [shingles(x[2]) for x in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2)
             if (c := len(sets[a] & sets[b])) and c >= 0.8 * (len(sets[a]) + len(sets[b]) - c)]
    root = union(range(len(lines)), links)
    return {lines[k][:2] for k in range(len(lines)) if root[k] != k}


def test_lines_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id < 120")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = brute_lines(rows)
    got = {(r.doc_id, p) for r in line_dedup.line_report(docs).collect() for p in r.dropped}
    assert got <= want
    assert len(got) >= 0.98 * len(want)  # candidates come from MinHash bands


def test_lines_find_planted_near_copies(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=30)) for _ in range(150)]
    near = [re.sub(r"\S+", "changed", line, count=1) for line in base]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(base)] + [(1000 + i, line.upper()) for i, line in enumerate(near)],
                               "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    assert all(got[i].n_dropped == 0 for i in range(150))
    assert sum(got[1000 + i].n_dropped for i in range(150)) >= 148


def test_lines_edge_rows(edge, empty):
    out = line_dedup.deduplicate_lines(edge)
    assert out.columns == edge.columns
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=lambda x: (x[0], x[1] or ""))
    assert [i for i, _ in got] == [0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    text = dict(got)
    assert text[1] and text[2] == "" and text[3] is None and text[4] == "" and text[5] == " \t\n "
    assert text[8].startswith("the  quick")  # inner white space is part of the shingles: too short a line to be 0.8 alike
    assert text[9] == "Größe ñandú 日本語 😀 line\nline\nline two"
    assert line_dedup.deduplicate_lines(empty).count() == 0 and line_dedup.line_report(empty).count() == 0


def test_lines_plan_is_native(spark, edge):
    plan = line_dedup.line_report(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_find_alike_pairs_inside_templated_families(spark):
    """Long shared boilerplate, short differing part: lines share bands with many others that are not alike."""
    rng = random.Random(11)
    pick = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    rows = []
    for differing in (27, 34):  # strangers of a family at a Jaccard similarity of about 0.77 and 0.73
        boilerplate = pick(190)
        for _ in range(60):
            own = pick(differing)
            rows += [boilerplate + own, boilerplate + own[:-4] + pick(4)]
    rows = [(i, t) for i, t in enumerate(rows)]
    want = brute_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, p) for r in line_dedup.line_report(df).collect() for p in r.dropped}
    assert len(want) == 120 and got == want


def test_lines_equal_but_for_white_space_at_the_ends(spark):
    rows = [(1, "a=1\nbody line"), (2, "a=1\r\n\tbody line\r"), (3, "\x0b a=1 \f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, p) for r in line_dedup.line_report(df).collect() for p in r.dropped}
    assert got == brute_lines(rows) == {(2, 0), (2, 1), (3, 0)}


def test_simhash_keeps_one_row_of_each_component_where_ids_repeat(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(3, b), (5, "zz " + a), (5, b), (7, c), (7, "a " + d), (None, c), (None, "zzz " + a), (9, c), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {t: fingerprint(t) for _, t in rows}
    texts = sorted(fps)
    root = union(texts, [(x, y) for x, y in itertools.combinations(texts, 2) if (fps[x] ^ fps[y]).bit_count() <= 2])
    want = {}
    for i, t in rows:
        want[root[t]] = min(want.get(root[t], (True, 0)), (i is None, i or 0))
    got = simhash.keep_one(df).collect()
    assert sorted((root[r.text], (r.doc_id is None, r.doc_id or 0)) for r in got) == sorted(want.items())


def test_lines_of_a_table_with_clashing_names(spark):
    rows = [(1, "a line that stays here\nsecond", 5, "x", "y"), (2, "a line that stays here\nthird", 6, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped int, k1 string, _dropped string")
    got = line_dedup.deduplicate_lines(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.dropped) for r in got.collect()) == [(1, rows[0][1], 5), (2, "third", 6)]


def test_lines_that_share_a_few_rare_shingles_are_no_candidates(spark):
    """pipeline, op7: chance neighbours grew with the square of the lines; alike pairs of all sizes stay candidates."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(45)]
    base = [[rng.choice(words) for _ in range(rng.randrange(60, 130))] for _ in range(150)]
    texts = []
    for k, line in enumerate(base):
        other = list(line)
        if k % 2:
            other = other[:len(other) - len(other) * (k % 11) // 44]  # shorter by up to a fourth
        for at in rng.sample(range(len(other)), len(other) * (k % 7) // 90):
            other[at] = "".join(rng.choices("qrstuvwxyz", k=6))
        texts += [" ".join(line), " ".join(other) + " q"]
    texts += ["short one here", "short one here.", "tiny"]
    sets = [shingles(t) for t in texts]
    pairs = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2)}
    alike = {(a, b) for a, b in pairs if (c := len(sets[a] & sets[b])) and c >= 0.8 * (len(sets[a]) + len(sets[b]) - c)}
    df = spark.createDataFrame(list(enumerate(texts)), "h1 long, norm string")
    prefixes = line_dedup._prefixes(df.select("h1", F.col("h1").alias("root")), df)
    got = {(r.a, r.b) for r in line_dedup._sharing_rare(prefixes).collect()}
    strangers = {(a, b) for a, b in got if a // 2 != b // 2}
    assert len(alike) > 80 and alike <= got
    assert len(strangers) < 100


def test_shingle_counts_keep_their_resolution_as_lines_grow(spark):
    """pipeline, op7: with a fixed number of slots, rare shingles of a large table looked as frequent as others."""
    def slots(chars):
        return line_dedup._slots(spark.createDataFrame([("x" * 50_000,)] * (chars // 50_000), "norm string"))

    assert slots(50_000) == line_dedup.LEAST_SLOTS
    assert 1.9 * slots(4_000_000) < slots(8_000_000) < 2.1 * slots(4_000_000)
    assert slots(8_000_000) * line_dedup.SHINGLES_A_SLOT >= 8_000_000
    rows = [0] * 3 + [4095] * 2 + [4096] * 9 + [12_000] * 700 + [16_383]
    counts = line_dedup._counts_by_block(spark.createDataFrame([(x,) for x in rows], "slot int"), 16_384)
    got = {r.block: r.f for r in counts.collect()}
    assert sorted(got) == [0, 1, 2, 3] and {len(f) for f in got.values()} == {4096}
    level = {s: got[s // 4096][s % 4096] for s in (0, 1, 4095, 4096, 12_000, 16_383)}
    assert level[1] == level[16_383] == 0 < level[4095] < level[0] < level[4096] < level[12_000]
    assert sum(sum(f) for f in got.values()) == sum(level.values())


def crowd(rng, members, changed):
    """Lines of one template with some words of their own, every third a near copy of another: most are alike to 0.6 to 0.85."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base, lines = [word() for _ in range(50)], []
    for k in range(members):
        line = lines[rng.randrange(len(lines))].split(" ") if k % 3 == 2 else list(base)
        for at in rng.sample(range(50), 1 if k % 3 == 2 else rng.choice(changed)):
            line[at] = word()
        lines.append(" ".join(line))
    return lines


def odd_lines(rng):
    """Pairs of very short, repetitive and long lines, and of lines with characters beyond 16 bits."""
    repeats = "abcdefghij " * 30
    long = " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(500))
    beyond = "".join(chr(0x1F600 + rng.randrange(60)) + rng.choice("abc ") for _ in range(120))
    return ["tiny", "Tiny.", repeats + "x", repeats + "abcdefghij y", long, long[:-300] + "z" * 20, long[:-1200], "q" + beyond, beyond + " q"]


def test_lines_of_crowded_buckets_are_compared_only_where_sketches_allow(spark, monkeypatch):
    """F1, F2 (pipeline, op7): lines alike to 0.7 to 0.8 were compared one by one, with the square of their number."""
    rng = random.Random(8)
    rows = list(enumerate(crowd(rng, 150, (3, 4)) + crowd(rng, 60, (1, 2, 3)) + odd_lines(rng)))
    compared, verified = [], line_dedup._verified

    def counted(pairs, lines):
        compared.append(pairs.count())
        return verified(pairs, lines)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, p) for r in line_dedup.line_report(df).collect() for p in r.dropped}
    assert got == brute_lines(rows)
    sets = [shingles(t) for _, t in rows]
    near = sum((c := len(x & y)) >= 0.75 * (len(x) + len(y) - c) for x, y in itertools.combinations(sets, 2))
    assert compared[-1] < near / 4


@pytest.mark.parametrize("limits", [{"OUTSIDE": 3}, {"SKETCHED": 300}, {"MEETINGS": 40}])
def test_lines_of_hot_buckets_and_long_lines(spark, monkeypatch, limits):
    """Buckets met in parts, and lines that the rarest shingles join instead, lose no pair either."""
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(9)
    rows = list(enumerate(crowd(rng, 90, (2, 3, 4)) + odd_lines(rng)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, p) for r in line_dedup.line_report(df).collect() for p in r.dropped}
    assert got == brute_lines(rows)


def test_sketches_bound_the_difference_of_shingle_sets(spark):
    rng = random.Random(10)
    texts = crowd(rng, 40, (1, 4, 12)) + odd_lines(rng)[:-2]
    df = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(texts)], "h1 long, norm string")
    got = {r.h1: r for r in line_dedup._sketches(df.select("h1"), df).collect()}
    sets = [shingles(t) for t in texts]
    assert [got[i].n for i in range(len(texts))] == [len(x) for x in sets]
    tight = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        slots = sum(((got[i][f"w{w}"] ^ got[j][f"w{w}"]) & (1 << 64) - 1).bit_count() for w in range(line_dedup.WORDS))
        assert slots <= len(sets[i] ^ sets[j])
        tight += slots > 0.6 * len(sets[i] ^ sets[j])
    assert tight > 600


def test_minima_of_a_part_of_the_hashes_are_those_of_all(spark):
    """F2 (op7): every shingle was compared under all masks; lines that repeat a few shingles are read once more."""
    rng = random.Random(12)
    texts = crowd(rng, 30, (1, 4)) + [t.lower() for t in odd_lines(rng)] + ["ab" * 300, "x" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "h1 long, norm string")
    masks = line_dedup._MASKS[:18]
    whole = {tuple(r) for r in line_dedup._signatures(df, masks, True).collect()}
    part = {tuple(r) for r in line_dedup._signatures(df, masks, False).collect()}
    short = {r for r in part if None in r}
    assert part - short < whole and {r[0] for r in short} >= {len(texts) - 2, len(texts) - 1}
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{3 * b + r}") for r in range(3)]) for b in range(6)]
    want = line_dedup._signatures(df, masks, True).select(F.explode(F.array(*keys)).alias("band"), "h1")
    got, stored = line_dedup._bands(df, 6, 3, masks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    line_dedup.release(*stored)

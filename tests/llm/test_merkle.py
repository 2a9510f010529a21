import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm.conftest import EDGE_ROWS
from tests.oracle import duck
from tunesmith.llm import catalog, merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(nodes):
    """Root and, for each node, its path [(sibling or None, left)]."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append((nodes[other] if other < len(nodes) else None, other < i))
        at = [i // 2 for i in at]
        nodes = [h("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain_manifest(rows):
    """(id, leaf, subroot, root, path) of every row by plain trees."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf_of(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    sub = {g: tree([leaf for _, leaf in groups[g]]) for g in names}
    root, upper = tree([sub[g][0] for g in names])
    return sorted(((i, leaf, sub[g][0], root, sub[g][1][k] + upper[n]) for n, g in enumerate(names) for k, (i, leaf) in enumerate(groups[g])), key=str)


def found(df, **options):
    rows = merkle.manifest(df, COLUMNS, **options).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in rows), key=str)


@pytest.mark.parametrize("span", [1, 2, 3, 10])
def test_any_span_gives_the_plain_tree(spark, span):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 75").union(
        spark.createDataFrame([(None, "t", None, "s", 1), (-3, None, "zz", None, None), (-3, "x", "zz", None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    assert found(docs, span=span) == plain_manifest([r.asDict() for r in docs.collect()])


def test_edge_rows(edge, empty):
    assert found(edge, span=2) == plain_manifest([r.asDict() for r in edge.collect()])
    assert len(found(edge)) == len(EDGE_ROWS)
    assert merkle.manifest(empty, COLUMNS).count() == 0


def test_one_row_is_its_own_root(edge):
    (i, leaf, subroot, root, path), = found(edge.where("doc_id = 9"))
    assert leaf == subroot == root and path == []


def test_paths_lead_to_the_root_and_tampering_shows(spark):
    rows = catalog.QUERIES["op13_merkle_manifest"](spark, SF01).collect()
    con = duck(SF01)
    import zlib
    n_chars = dict(con.execute("select doc_id, n_chars from documents").fetchall())
    for r in rows:
        hit = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and n_chars[r.doc_id] is not None
        assert r.verified == (not hit) and (r.folded_root == r.root) == r.verified
    assert sum(not r.verified for r in rows) > 50 and len({r.root for r in rows}) == 1


def test_numbered_rows_of_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2990, F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
                                    F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("v"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.numbered(rows, ["g"], ["v"], "test-numbered").collect()
        sizes = merkle.numbered(rows, ["g"], ["v"], "test-numbered").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 3000 and len(sizes) > 1 and old
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.idx, r.v, r.n))
    for g, found_rows in by.items():
        found_rows.sort()
        assert [x[0] for x in found_rows] == list(range(len(found_rows))) and {x[2] for x in found_rows} == {len(found_rows)}
        keys = [(x[1] is not None, x[1] or 0) for x in found_rows]
        assert keys == sorted(keys)

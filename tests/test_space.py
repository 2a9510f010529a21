"""Grid invariants: enumeration is a bijection, neighbour counts, anti-join, config sizes."""

from pyspark.sql import functions as F

from tunesmith.operators import space as G

from .conftest import SF001


def test_grid_roundtrip_and_neighbors(spark):
    sp = G.load_space(G.space_from_dict(spark, "m", {"a": [1, 2, 3], "b": ["x", "y"], "c": [True, False, None, 0.5]}), "m")
    assert sp.size == 24
    grid = G.decode(G.enumerate_grid(spark, sp), sp)
    enc = G.encode(grid.select("grid_id", "a", "b", "c").withColumnRenamed("grid_id", "orig"), sp)
    assert enc.where(F.col("orig") != F.col("grid_id")).count() == 0
    nb = G.neighbors(G.enumerate_grid(spark, sp), sp)
    per = {r["grid_id"]: r["count"] for r in nb.groupBy("grid_id").count().collect()}
    assert set(per.values()) == {(3 - 1) + (2 - 1) + (4 - 1)}
    # every neighbour differs in exactly one position
    nbix = nb.withColumn("nix", sp.digits(F.col("neighbor_id")))
    diff = nbix.select(F.aggregate(F.zip_with("ix", "nix", lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, b: a + b).alias("d"))
    assert {r[0] for r in diff.distinct().collect()} == {1}


def test_untried_leaves_no_tried(spark):
    sp = G.load_space(G.space_from_dict(spark, "m", {"a": list(range(10)), "b": list(range(7))}), "m")
    grid = G.enumerate_grid(spark, sp)
    tried = G.draw(spark, sp, 5, 3)
    left = G.untried(grid, tried)
    assert left.count() == 65 and left.join(tried, "grid_id").count() == 0


def test_live_config_sizes(spark):
    base = 7 * 2 * 9 * 6 * 19 * 20 * 2
    assert base == 574_560
    for missing, cat, alts in [(False, False, 2), (True, False, 2), (False, True, 3), (True, True, 3)]:
        meta = spark.createDataFrame([(missing, cat)], "any_missing boolean, any_categorical boolean")
        size = G.grid_size(G.config_space(spark, meta)).first()["grid_size"]
        assert size == base * alts


def test_experiment_matrix(spark):
    m = G.experiment_matrix(spark, {"task": spark.createDataFrame([(12,), (14,)], "t int"),
                                    "seed": spark.createDataFrame([(1,), (2,), (3,)], "s long"),
                                    "method": spark.createDataFrame([("A",), ("B",)], "m string")})
    assert m.count() == 12 and m.distinct().count() == 12


def test_a_dimension_of_150000_values(spark):
    df = spark.range(150_000).select(F.col("id").alias("a"), F.concat(F.lit("v"), (F.col("id") % 7)).alias("b"))
    space = G.space_from_columns(df, "m", ["a", "b"])
    assert G.grid_size(space).first()["grid_size"] == 150_000 * 7
    sp = G.load_space(space, "m")
    got = G.decode(G.draw(spark, sp, 20, 1), sp).collect()
    assert all(int(r["a"]) == r["ix"][0] and r["b"] == f"v{r['ix'][1]}" for r in got)


def test_ids_beyond_doubles_and_draws_from_a_huge_grid(spark):
    sp = G.load_space(G.space_from_dict(spark, "m", {f"p{k}": list(range(1000)) for k in range(5)} | {"q": list(range(100))}), "m")
    assert sp.size == 10**17
    gid = 12345678901234567
    ix = spark.createDataFrame([(gid,)], "g long").select(sp.digits(F.col("g"))).first()[0]
    assert ix == [123, 456, 789, 12, 345, 67] and sp.setting(gid)["q"] == ("67", "int")
    tried = G.draw(spark, sp, 3, 9)
    rows = G.draw(spark, sp, 150, 9, tried).collect()
    assert len({r["grid_id"] for r in rows}) == 150
    assert [r["grid_id"] for r in G.draw(spark, sp, 153, 9).orderBy("draw").collect()][3:] == [r["grid_id"] for r in sorted(rows, key=lambda r: r["draw"])]


def test_draws_of_a_used_up_grid(spark):
    sp = G.load_space(G.space_from_dict(spark, "m", {"a": [1, 2, 3]}), "m")
    assert sorted(r["grid_id"] for r in G.draw(spark, sp, 10, 1).collect()) == [0, 1, 2]
    assert G.draw(spark, sp, 1, 1, G.draw(spark, sp, 3, 5)).count() == 0


def _order(spark, size, seed):
    rows = spark.range(size).select(G.nth_draw(F.col("id"), size, seed).alias("g"), "id").orderBy("id").collect()
    return [r["g"] for r in rows]


def test_draws_are_a_permutation(spark):
    for size in (1, 2, 3, 4, 5, 6, 7, 13, 64, 97, 1000, 4099):
        assert sorted(_order(spark, size, 5)) == list(range(size))
    a, b = _order(spark, 1000, 5), _order(spark, 1000, 6)
    assert a != b and a[:20] != sorted(a[:20])
    # no place is favoured: the mean of the first hundred draws is near the middle
    assert abs(sum(a[:100]) / 100 - 500) < 120


def test_the_last_settings_of_a_large_grid(spark):
    sp = G.load_space(G.space_from_dict(spark, "m", {"a": list(range(1197)), "b": list(range(1440))}), "m")
    assert sp.size == 1_723_680
    left = sorted(r["grid_id"] for r in G.draws(spark, sp, sp.size - 10, 99, 4).collect())
    tried = G.enumerate_grid(spark, sp).where(~F.col("grid_id").isin(left)).select("grid_id")
    got = G.draw(spark, sp, 150, 4, tried).collect()
    assert sorted(r["grid_id"] for r in got) == left and [r["draw"] for r in got] == list(range(sp.size - 10, sp.size))


def test_conditional_items_of_all_flags(spark):
    rules = [G.Rule(["A"], "m", (None,)), G.Rule("B", "m and c"), G.Rule(["C"], "n > 2"), G.Rule("D", "c", ("E",))]
    meta = spark.createDataFrame([(1, True, True, 3), (2, True, False, None), (3, False, True, 2), (4, False, False, 9)], "k int, m boolean, c boolean, n int")
    got = {}
    for r in G.conditional_items(meta, rules, ["k"]).orderBy("k", "ix").collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert got == {1: ['["A"]', '"B"', '["C"]', '"D"'], 2: ['["A"]', '"E"'], 3: ["null", '"D"'], 4: ["null", '["C"]', '"E"']}

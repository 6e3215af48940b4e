"""Gene-order operators: literal cases, brute force and invariants."""

import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karyospark import catalog
from karyospark.functions import color
from karyospark.operators import components, coords, fusion, fusion_trials, groups, hits, lineage, mixing, order, peaks, permute, scans, stats, validate
from karyospark.plans import fixtures

PAIR = "query_species string, target_species string, qseqid string, sseqid string, pident double, evalue double, bitscore double"


def random_hits(seed, n=60):
    rng = random.Random(seed)
    rows = {}
    for q, t in (("A", "B"), ("B", "A")):
        for _ in range(n):
            x, y = f"{q}{rng.randrange(12)}", f"{t}{rng.randrange(12)}"
            rows[q, t, x, y] = (q, t, x, y, float(rng.randrange(3)), float(rng.randrange(3)), float(rng.randrange(6)))
    return list(rows.values())


@pytest.mark.parametrize("seed", range(3))
def test_strict_hits_are_one_to_one_and_within_permissive_or_best(spark, seed):
    rows = hits.rbh_strict(spark.createDataFrame(random_hits(seed), PAIR)).collect()
    assert rows
    assert len({r.qseqid for r in rows}) == len({r.sseqid for r in rows}) == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_links_give_what_hits_of_both_directions_give(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"A{rng.randrange(12)}", f"B{rng.randrange(12)}") for _ in range(70)})
    links = [("A", "B", a, b, *(float(rng.randrange(n)) for n in (3, 3, 4, 3, 3, 4))) for a, b in pairs]
    df = spark.createDataFrame(links, PAIR + ", back_pident double, back_evalue double, back_bitscore double")
    rows = spark.createDataFrame([(*r[:4], *r[4:7]) for r in links] + [(r[1], r[0], r[3], r[2], *r[7:]) for r in links], PAIR)
    for by_links, by_hits in ((hits.permissive_links, hits.rbh_permissive), (hits.single_pass_links, hits.rbh_single_pass), (hits.strict_links, hits.rbh_strict)):
        want = sorted(map(tuple, by_hits(rows).select(*hits.LINK).collect()))
        assert want and sorted(map(tuple, by_links(df).collect())) == want


def test_links_are_moved_once_for_each_direction(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3, 5, 9.0, 0.5, 2.0), (1, 3, 5, 8.0, 0.0, 4.0), (2, 3, 6, 7.0, 0.0, 1.0)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = [("C", "P"), ("P", "S"), ("S", "C"), ("C", "S")]
    links = fixtures.links(spark, str(tmp_path), pairs)
    plan = links._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan parquet") == 2 and plan.count("Exchange") == 1  # one more for the join where no table is small
    got = {(r.qseqid, r.sseqid): (r.bitscore, r.back_bitscore, r.pident) for r in links.collect()}
    assert got == {("C7", "P3"): (9.0, 8.0, 4.0), ("C7", "S5"): (9.0, 8.0, 4.0), ("P3", "S5"): (9.0, 8.0, 4.0), ("C8", "P3"): (7.0, 7.0, 1.0), ("C8", "S6"): (7.0, 7.0, 1.0), ("P3", "S6"): (7.0, 7.0, 1.0)}


LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_discount double, l_quantity double"


def odd_lines(spark, path, seed, prices):
    """Order lines with ties, nulls, lines without order and orders without customer or lines."""
    rng = random.Random(seed)
    some = lambda *xs: rng.choice(xs)
    orders = [(k, rng.randrange(9) if rng.random() < 0.95 else None) for k in range(60)] + [(3, 4)]
    lines = [(rng.randrange(66) if rng.random() < 0.97 else None, rng.randrange(12), rng.randrange(5) if rng.random() < 0.97 else None, float(rng.randrange(prices)) * 700 if rng.random() < 0.95 else None, some(0.0, 0.1, 0.2, 0.2, None), float(rng.randrange(50))) for _ in range(400)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").repartition(3).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, LINES).repartition(3).write.parquet(f"{path}/lineitem.parquet")


@pytest.mark.parametrize(("few", "prices"), [(0, 6), (100_000, 5000)])
def test_top_links_give_what_all_links_give(spark, tmp_path, monkeypatch, few, prices):
    odd_lines(spark, tmp_path, prices, prices)
    monkeypatch.setattr(fixtures, "FEW_ROWS", few)
    pairs = [(q, t) for q in "CPS" for t in "CPS" if q != t]
    links = fixtures.links(spark, str(tmp_path), pairs).cache()
    tops = {pident: fixtures.top_links(spark, str(tmp_path), pairs, pident).cache() for pident in (False, True)}
    if prices > 6:
        assert 0 < tops[False].count() < links.count() / 2
    for of, pident in ((hits.permissive_links, False), (hits.single_pass_links, False), (hits.strict_links, True)):
        want = sorted(map(tuple, of(links).select(*hits.LINK).collect()), key=str)
        assert want and sorted(map(tuple, of(tops[pident]).select(*hits.LINK).collect()), key=str) == want


def rows_shuffled(spark):
    store, double = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.jvm.double
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(double, 0), None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("pident", [False, True])
def test_lines_behind_their_genes_best_are_not_moved(spark, tmp_path, monkeypatch, pident):
    """Many lines a gene: fewer rows are shuffled than there are lines, where lines went to P, to S and to their order."""
    rng = random.Random(7)
    n = 20_000
    spark.createDataFrame([(k, k % 40) for k in range(400)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(rng.randrange(400), rng.randrange(50), rng.randrange(20), rng.random() * 90_000, rng.randrange(10) / 100, 1.0) for _ in range(n)], LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(fixtures, "FEW_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = rows_shuffled(spark)
        links = fixtures.top_links(spark, str(tmp_path), [(q, t) for q in "CPS" for t in "CPS" if q != t], pident).count()
        moved = sum(r for k, r in rows_shuffled(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert links and moved < n


@pytest.mark.parametrize("query", ["annotate_coords", "assign_breakchrom", "filter_scaffolds"])
def test_pairwise_tables_move_fewer_rows_than_lines(spark, tmp_path, monkeypatch, query):
    """Many lines a gene, some without order: the result of the SQL, and fewer rows shuffled than lines."""
    rng = random.Random(13)
    n, path = 20_000, str(tmp_path)
    spark.createDataFrame([(k, k % 40) for k in range(398)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(rng.randrange(400), rng.randrange(50), rng.randrange(20), float(rng.randrange(90_000)), rng.randrange(4) / 4, float(rng.randrange(50))) for _ in range(n)], LINES).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 5) for k in range(40)], "c_custkey bigint, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(k, k % 5) for k in range(20)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(k, f"Brand#{k % 4}") for k in range(50)], "p_partkey bigint, p_brand string").write.parquet(f"{path}/part.parquet")
    monkeypatch.setattr(fixtures, "FEW_ROWS", 10)  # fewer than genes, more than lines' orders that are missing
    monkeypatch.setattr(fixtures, "CLASSES", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = rows_shuffled(spark)
        df = catalog.QUERIES[query](spark, path)
        got = sorted(map(tuple, df.collect()), key=str)
        moved = sum(r for k, r in rows_shuffled(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[query]})").fetchall()
    assert want and got == sorted(want, key=str)
    assert moved < n


@pytest.mark.parametrize("query", ["annotate_coords", "assign_breakchrom", "filter_scaffolds"])
def test_pairwise_tables_move_orders_once(spark, tmp_path, monkeypatch, query):
    """Many orders, few of them with lines: the result of the SQL, and orders shuffled once, where lines of P took their customers in a second pass."""
    rng = random.Random(17)
    n, path = 10_000, str(tmp_path)
    spark.createDataFrame([(k, k % 40) for k in range(n)], "o_orderkey bigint, o_custkey bigint").coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(rng.randrange(300), rng.randrange(50), rng.randrange(20), float(rng.randrange(90_000)), rng.randrange(4) / 4, float(rng.randrange(50))) for _ in range(3000)], LINES).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 5) for k in range(40)], "c_custkey bigint, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(k, k % 5) for k in range(20)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(k, f"Brand#{k % 4}") for k in range(50)], "p_partkey bigint, p_brand string").write.parquet(f"{path}/part.parquet")
    monkeypatch.setattr(fixtures, "FEW_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = rows_shuffled(spark)
        df = catalog.QUERIES[query](spark, path)
        got = sorted(map(tuple, df.collect()), key=str)
        moved = sum(r for k, r in rows_shuffled(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[query]})").fetchall()
    assert want and got == sorted(want, key=str)
    assert n < moved < 1.5 * n


def test_links_are_moved_once_to_their_target(spark):
    """Links that lie by query: a row each is shuffled for the marks of the target."""
    n = 3000
    rows = [("A", "B", f"A{k % 900}", f"B{k % 700}", float(k % 7), float(k % 5), 1.0, float(k % 6), float(k % 4), 1.0) for k in range(n)]
    links = lineage.cut(spark.createDataFrame(rows, PAIR + ", back_pident double, back_evalue double, back_bitscore double"))
    before = rows_shuffled(spark)
    marked = hits.mutual_marks(links, ["-bitscore", "evalue"])
    moved = sum(r for k, r in rows_shuffled(spark).items() if k not in before)
    assert marked.count() and moved <= 2 * n


def test_classes_of_keys_keep_every_line_at_a_top(spark, monkeypatch):
    """Few classes, so that keys share them; a gene with null scores alone lets them all through."""
    rng = random.Random(11)
    lines = [(rng.randrange(30), float(rng.randrange(90)) * 1000 if rng.random() < 0.9 else None) for _ in range(600)] + [(99, None), (99, None), (None, 5000.0)]
    want = [(k, p) for k, p in lines if k is not None and p == max((x for j, x in lines if j == k and x is not None), default=None)]
    rows = spark.createDataFrame(lines, "k bigint, price double")
    tops = rows.where("k IS NOT NULL").groupBy("k").agg(F.min(fixtures._behind(F.col("price"))).alias("_fore"))
    monkeypatch.setattr(fixtures, "CLASSES", 5)
    for few in (0, 1000):
        monkeypatch.setattr(fixtures, "FEW_ROWS", few)
        got = fixtures._at_top(rows, "k", tops, {"fore": F.col("price")}).select("k", "price").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_as_taking_one_row_at_a_time(spark, seed):
    rng = random.Random(seed)
    rows = list({(f"q{rng.randrange(15)}", f"s{rng.randrange(15)}", float(rng.randrange(4)), float(rng.randrange(4))) for _ in range(80)})
    left, want = sorted(rows, key=lambda r: (r[2], -r[3], r[0], r[1])), []
    while left:
        best = left[0]
        want.append(best)
        left = [r for r in left if r[0] != best[0] and r[1] != best[1]]
    got = hits.greedy_one_to_one(spark.createDataFrame(rows, "qseqid string, sseqid string, evalue double, bitscore double"), 10.0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_path_is_no_nway_ortholog(spark):
    edges = [("A", "B", "a1", "b1"), ("B", "C", "b1", "c1"), ("A", "B", "a2", "b2"), ("A", "C", "a2", "c2"), ("B", "C", "b2", "c2")]
    df = spark.createDataFrame(edges, "query_species string, target_species string, qseqid string, sseqid string")
    assert [tuple(r) for r in hits.nway_rbh(df, ["C", "A", "B"]).collect()] == [("rbh3way_A_B_C_1", "a2", "b2", "c2")]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_components_of_paths_and_stars(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(100 + n, 200 + i) for i in range(n)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**dict.fromkeys(range(n + 1), 0), **dict.fromkeys([100 + n, *range(200, 200 + n)], min(100 + n, 200))}


def test_components_of_a_long_path(spark):
    """Stretches of the path are contracted where they lie; what is left settles in few rounds."""
    path = spark.range(300_000).selectExpr("id AS a", "id + 1 AS b")
    labels, rounds = components.settled_components(path)
    assert labels.count() == 300_001 and labels.where("root <> 0").isEmpty() and rounds < 8
    names = path.selectExpr("concat('n', a) AS a", "concat('n', b) AS b").where("a < 'n2'")
    assert components.connected_components(names).select("root").distinct().count() == names.selectExpr("a AS x").union(names.selectExpr("b AS x")).distinct().count() - names.count()


@pytest.mark.parametrize("seed", range(5))
def test_least_labels(seed):
    rng = np.random.default_rng(seed)
    n = 400
    i, j = rng.integers(0, n, (2, 50 * (seed + 1)))
    label = components.least_labels(n, i, j)
    want = np.arange(n)
    for _ in range(n):
        low = np.minimum(want[i], want[j])
        np.minimum.at(want, i, low)
        np.minimum.at(want, j, low)
    assert (label == want).all()


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fisher_tail_against_enumeration(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(60):
        n = rng.randint(2, 30)
        r, c = rng.randint(1, n), rng.randint(1, n)
        x = rng.randint(max(0, r + c - n), min(r, c))
        cases.append((x, r, c, n))
    cases.append((3, 4, 4, 8))
    df = spark.createDataFrame(cases, "x bigint, r bigint, c bigint, n bigint")
    for (x, r, c, n), row in zip(cases, df.select(F.exp(stats.hypergeometric_tail("x", "r", "c", "n")).alias("p")).collect(), strict=True):
        want = sum(math.comb(c, k) * math.comb(n - c, r - k) for k in range(x, min(r, c) + 1)) / math.comb(n, r)
        assert row.p == pytest.approx(want)
    assert row.p == pytest.approx(17 / 70)


def test_fisher_counts_all_possible_pairs_and_is_not_capped(spark):
    rows = [("x1", "y1")] * 2 + [("x2", "y2")] * 2
    out = {(r.a, r.b): r.p for r in stats.fisher_pairs(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()}
    assert out[("x1", "y1")] == pytest.approx(4 / 6)


def test_break_statistic_at_a_planted_break(spark):
    rows = [(f"r{i}", "p", "X" if i < 22 else "Y", i) for i in range(45)]
    df = spark.createDataFrame(rows, "rbh string, A_breakchrom string, B_breakchrom string, A_break_ix bigint")
    d = [r.A_D for r in stats.break_statistic(df, "A", "B").orderBy("A_break_ix").collect()]
    assert d[21] == pytest.approx(math.sqrt(2)) == max(d)
    assert d[-1] == 0 and d[0] == pytest.approx(1.0)
    alone = spark.createDataFrame([("r", "p", "X", 0)], "rbh string, A_breakchrom string, B_breakchrom string, A_break_ix bigint")
    assert stats.break_statistic(alone, "A", "B").first().A_D == 0


@pytest.mark.parametrize("n", [1, 19, 20, 40, 41, 300])
def test_sides_of_a_break_against_counting(n):
    rng = random.Random(n)
    codes = [rng.randrange(-1, 6) for _ in range(n)]
    want = []
    for k in range(n):
        left = codes[k - 19 : k + 1] if k >= 19 else []
        right = codes[k + 1 : k + 21] if k + 20 <= n - 1 else []
        want.append(0 if k == n - 1 else sum((left.count(c) - right.count(c)) ** 2 for c in range(6)))
    assert stats.side_squares(np.array(codes), np.arange(n), n).tolist() == want
    assert stats.side_squares(np.array(codes)[5:], np.arange(5, n), n)[20:].tolist() == want[25:]  # a block with its halo


def test_break_statistic_makes_no_lists(spark):
    df = spark.createDataFrame([("r", "a", 0, "b", 0)], "rbh string, A_breakchrom string, A_break_ix long, B_breakchrom string, B_break_ix long")
    plan = stats.break_statistic(df, "A", "B")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambdafunction(size" not in plan


def test_breaks_are_half_open(spark):
    breaks = spark.createDataFrame([("A", "s", 10)], "species string, scaf string, break_pos bigint")
    rbh = spark.createDataFrame([("1", "s", 9), ("2", "s", 10), ("3", "t", 5)], "rbh string, A_scaf string, A_pos bigint")
    got = {r.rbh: r.A_breakchrom for r in coords.assign_breakchrom(rbh, breaks, "A").collect()}
    assert got == {"1": "s:0-10", "2": "s:10-end", "3": "t:0-end"}


def test_alpha_walks_down_to_the_last_rate(spark):
    fdr = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.1), (4, 0.0), (5, 0.0)], "size bigint, alpha double")
    sizes = spark.createDataFrame([("a", 3), ("b", 7), ("c", 4)], "A_scaf string, count bigint")
    got = {r.A_scaf: (r.alpha, r.alpha_type) for r in groups.attach_alpha(sizes, fdr).collect()}
    assert got == {"a": (0.1, "equal_to"), "b": (0.1, "less_than"), "c": (0.1, "less_than")}
    wide = spark.createDataFrame([("a", 10**8), ("b", 10**8 + 5), ("c", 2), ("d", 3)], "A_scaf string, count bigint")
    steps = spark.createDataFrame([(3, 0.5), (10**8, 0.01), (5 * 10**8, 0.001)], "size bigint, alpha double")
    got = {r.A_scaf: (r.alpha, r.alpha_type) for r in groups.attach_alpha(wide, steps).collect()}
    assert got == {"a": (0.01, "equal_to"), "b": (0.01, "less_than"), "c": (None, "less_than"), "d": (0.5, "equal_to")}
    assert groups.attach_alpha(wide, steps.limit(0)).where("alpha IS NULL").count() == 4


def test_merge_keeps_the_fullest_row_of_a_gene(spark):
    cols = "rbh string, A_gene string, A_scaf string, B_gene string, B_scaf string"
    one = spark.createDataFrame([("1", "a", "s", "b", "t"), ("2", "a2", "s", None, None)], cols)
    two = spark.createDataFrame([("3", "a", "s", "b", "t", "c"), ("4", "a3", "s", "b", "t", None)], f"{cols}, C_gene string")
    got = [(r.A_gene, r.B_gene, r.C_gene, r.rbh) for r in groups.merge_rbh([one, two], ["A", "B"]).collect()]
    assert got == [("a", "b", "c", "mer_A_B_C_1")]


def test_drawn_states_agree_with_ranked_permutations(spark):
    rng = random.Random(1)
    rows = [(f"r{i:03}", f"a{rng.randrange(3)}", f"b{rng.randrange(3)}", None if i == 7 else f"c{rng.randrange(2)}") for i in range(31)]
    df = spark.createDataFrame(rows, "rbh string, A_scaf string, B_scaf string, C_scaf string")
    n, species = 300, ["A", "B", "C"]
    drawn = permute.drawn_state(df, species, n).cache()
    ranked = permute.drawn_state(df, species, n, drawn_tuples=0).cache()
    for state in (drawn, ranked):
        assert permute.trials_of(state) == n
        for key in ("A_scaf", "B_scaf", "C_scaf"):  # every permutation keeps the scaffolds' own counts
            own = {r[0]: r[1] * n for r in df.dropna().groupBy(key).count().collect()}
            assert {r[key]: r.n for r in state.where("kind = 'tuple'").groupBy(key).agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()} == own
    share = lambda s: {r["size"]: r.alpha for r in groups.fdr_table(permute.size_observations(s), n).collect()}
    ours, theirs = share(drawn), share(ranked)
    assert all(abs(ours.get(k, 0) - theirs.get(k, 0)) < 0.15 for k in {*ours, *theirs})
    kept = lambda s: sorted(map(str, s.collect()))
    assert kept(drawn) == kept(permute.drawn_state(df.repartition(3), species, n))
    parts = [permute.drawn_state(df, species, k, first=f) for f, k in ((0, 120), (120, 180))]
    assert kept(permute.merge_states(*parts)) == kept(drawn)
    assert kept(permute.merge_states(*[permute.drawn_state(df, species, 2, first=f, drawn_tuples=0) for f in (0, 2)])) == kept(permute.drawn_state(df, species, 4, drawn_tuples=0))
    assert kept(permute.drawn_state(df, species, n, tuples=False)) == kept(drawn.where("kind <> 'tuple'"))
    sizes = spark.createDataFrame([("a0", "b0", "c0", 1), ("a0", "b0", "x", 2), ("a1", "b1", "c1", 30)], "A_scaf string, B_scaf string, C_scaf string, count bigint")
    p = {r["count"]: (r.p, r.p_family) for r in permute.combo_significance(sizes, drawn, species).collect()}
    own = drawn.where("kind = 'tuple' AND A_scaf = 'a0' AND B_scaf = 'b0' AND C_scaf = 'c0'").agg(F.sum("n")).first()[0]
    assert p[1] == (own / n, 1.0) and p[2] == (1 / n, 1.0) and p[30] == (1 / n, 1 / n)
    none = permute.drawn_state(df.limit(0), species, 2)
    assert permute.size_observations(none).count() == 0 and permute.trials_of(none) == 2


def test_runs_of_many_genes_take_little_room():
    r = mixing._runs(6 * 10**8, 4 * 10**8)
    assert len(r) < 3 * 10**6
    p = np.exp(mixing._runs_ln(6 * 10**8, 4 * 10**8, r))
    assert p.sum() == pytest.approx(1, abs=1e-4) and (p * r).sum() / p.sum() == pytest.approx(2 * 0.24 * 10**9 + 1, rel=1e-9)


@pytest.mark.parametrize("part", [1, 7, 1000])
def test_mixing_of_many_groups(spark, part):
    rng = random.Random(part)
    rows = [(s, f"g{i:03}", rng.randrange(150), f"L{rng.randrange(9)}" if i % 5 else None) for s in ("x", "y") for i in range(120)]
    df = spark.createDataFrame(rows, "scaf string, gene string, pos bigint, gene_group string").withColumn("species", F.lit("A"))
    got = {(r.scaf, r.gene_group_a, r.gene_group_b): (r.n_a, r.n_b, r.changes) for r in mixing.mixing_value(df, part=part).collect()}
    want = {}
    for s in ("x", "y"):
        along = [g for _, _, _, g in sorted((r for r in rows if r[0] == s and r[3]), key=lambda r: (r[2], r[1]))]
        for a, b in itertools.combinations(sorted(set(along)), 2):
            letters = [g for g in along if g in (a, b)]
            if min(letters.count(a), letters.count(b)) >= 3:
                want[s, a, b] = (letters.count(a), letters.count(b), sum(x != y for x, y in itertools.pairwise(letters)))
    assert got == want and len(want) > 40


def test_drawn_tables_are_uniform_permutations():
    """Two species with two scaffolds each: the count of one cell is hypergeometric."""
    counts = np.zeros(6, int)
    for t in range(4000):
        codes, sizes = permute.draw_counts(np.random.default_rng(t), [np.array([5, 7]), np.array([4, 8])])
        cell = sizes[(codes[0] == 0) & (codes[1] == 0)]
        counts[cell[0] if len(cell) else 0] += 1
    want = [math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4) for k in range(5)] + [0]
    assert np.abs(counts / 4000 - want).max() < 0.03


def test_tally_adds_up(monkeypatch):
    monkeypatch.setattr(permute, "HELD", 50)
    rng, tally, want = np.random.default_rng(0), permute.Tally(), {}
    for _ in range(200):
        keys = rng.integers(0, 300, rng.integers(0, 9))
        tally.add(keys)
        for k in keys.tolist():
            want[k] = want.get(k, 0) + 1
    keys, times = tally.sums()
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want


@pytest.mark.parametrize("part", [1, 2, 100])
def test_mixing_of_known_strings(spark, part):
    texts = {"apart": "AAABBB", "mixed": "ABABAB", "long": "BBAABABBBA"}
    rows = [(s, "c", f"{s}{i}", i, g) for s, text in texts.items() for i, g in enumerate(text)]
    df = spark.createDataFrame(rows, "species string, scaf string, gene string, pos bigint, gene_group string")
    got = {r.species: (r.n_a, r.n_b, r.changes, r.m) for r in mixing.mixing_value(df, part=part).collect()}
    assert got == {"apart": (3, 3, 1, 0.0), "mixed": (3, 3, 5, 2.0), "long": (4, 6, 5, pytest.approx(4 / 3.8))}
    tight = {r.species: (r.n_a, r.n_b, r.changes) for r in mixing.mixing_value(df, compress=True, part=part).collect()}
    assert tight == {"apart": (1, 1, 1), "mixed": (3, 3, 5), "long": (3, 3, 5)}
    strings = {}
    for r in sorted(mixing.gene_strings(df, part=part).collect(), key=lambda r: (r.species, r.part)):
        strings[r.species] = strings.get(r.species, "") + r.genestring
    assert strings == texts


def test_suppression_of_clusters_is_that_of_the_whole():
    def plain(ix, d, window):
        stays = np.ones(len(ix), bool)
        while True:
            near = (np.abs(ix[:, None] - ix[None, :]) < window) & stays[None, :]
            full = int(np.argmax(near.sum(1)))
            members = np.flatnonzero(near[full])
            if len(members) < 2:
                return stays
            best = members[np.lexsort((ix[members], -d[members]))[0]]
            stays[members] = False
            stays[best] = True

    rng = np.random.default_rng(1)
    for _ in range(200):
        ix = np.sort(rng.choice(200, 40, replace=False))
        d = rng.integers(0, 9, 40).astype(float)
        stays, done = peaks.settled(ix, d, np.ones(40, bool), 7, -np.inf, np.inf)
        assert done and (stays == plain(ix, d, 7)).all()
        # stretches settle what they can, in turns half a stretch apart
        stays, shift, rounds, all_done = np.ones(40, bool), 0, 0, False
        while not all_done:
            all_done = True
            for block in np.unique((ix + shift) // 100):
                part = (ix + shift) // 100 == block
                low = block * 100 - shift
                low, high = (low if ix[0] < low else -np.inf), (low + 100 if ix[-1] >= low + 100 else np.inf)
                stays[part], done = peaks.settled(ix[part], d[part], stays[part], 7, low, high)
                all_done &= done
            shift, rounds = 50 - shift, rounds + 1
            assert rounds < 12
        assert (stays == plain(ix, d, 7)).all()


def test_one_scaffold_over_many_stretches(spark):
    """Evenly spaced peaks are settled from the left, however many tasks hold them."""
    rng = np.random.default_rng(2)
    ix = np.concatenate([np.arange(0, 3000, 10), np.sort(rng.choice(np.arange(3100, 9000), 900, replace=False))])
    d = rng.integers(0, 50, len(ix)).astype(float)
    df = spark.createDataFrame([("s", int(i), float(x)) for i, x in zip(ix, d, strict=True)], "scaf string, ix bigint, d double")
    stays, _ = peaks.settled(ix, d, np.ones(len(ix), bool), 20, -np.inf, np.inf)
    got = sorted(r.ix for r in peaks.suppress(df, ["scaf"], 20, span=1500).collect())
    assert got == ix[stays].tolist()
    assert sorted(r.ix for r in peaks.suppress(df, ["scaf"], 20).collect()) == got


def one_scaffold(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"r{i:04}", f"g{i:04}", "s" if i % 9 else None, None if not i % 9 else "s:0-300" if i % 3 else "s:300-end", int(p), f"x{int(o)}") for i, (p, o) in enumerate(zip(rng.integers(0, 400, n), rng.integers(0, 4, n), strict=True))]
    rows = [(r, g, sc, None if sc is None else ("s:0-200" if p < 200 else "s:200-end"), p, o) for r, g, sc, _, p, o in rows]
    return spark.createDataFrame(rows, "rbh string, A_gene string, A_scaf string, A_breakchrom string, A_pos bigint, B_breakchrom string")


def test_one_scaffold_over_many_parts(spark, monkeypatch):
    """Ranks, sliding counts and steps are those of whole windows where a scaffold is cut into parts and blocks."""
    monkeypatch.setattr(scans, "BLOCK_RANKS", 25)
    df = one_scaffold(spark, 700, 4)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert scans.sorted_parts(df, ["A_scaf", "A_pos", "A_gene"]).select("_part").distinct().count() > 5
        rows = coords.gene_index(df, "A").cache()
        over = lambda *keys: W.partitionBy(*keys).orderBy("A_pos", "A_gene")
        whole = df.withColumn("A_ix", F.row_number().over(over("A_scaf")) - 1).withColumn("A_break_ix", F.row_number().over(over("A_breakchrom")) - 1)
        assert sorted(map(str, rows.collect())) == sorted(map(str, whole.select(rows.columns).collect()))
        got = {r.rbh: r.A_D for r in stats.break_statistic(rows, "A", "B").collect()}
        assert len(got) == 700
        pieces = {}
        for r in sorted(rows.collect(), key=lambda r: r.A_break_ix):
            pieces.setdefault(r.A_breakchrom, []).append(r)
        for piece in pieces.values():
            for i, r in enumerate(piece):
                left = [x.B_breakchrom for x in piece[i - 19 : i + 1]] if i >= 19 else []
                right = [x.B_breakchrom for x in piece[i + 1 : i + 21]] if i + 20 <= len(piece) - 1 else []
                want = 0.0 if i == len(piece) - 1 else math.sqrt(sum(((left.count(c) - right.count(c)) / 20) ** 2 for c in {*left, *right}))
                assert got[r.rbh] == pytest.approx(want)
        genes = df.where("A_scaf IS NOT NULL").select(F.col("A_scaf").alias("scaf"), F.col("A_gene").alias("gene"), F.col("A_pos").alias("start"), (F.col("A_pos") + 3).alias("stop"))
        bars = {r.gene: r for r in stats.d_bars(genes, spark.createDataFrame([("s", 500, 10)], "scaf string, len bigint, offset bigint")).collect()}
        along = sorted(genes.collect(), key=lambda r: (r.start, r.stop, r.gene))
        for i, r in enumerate(along):
            left = (along[i - 1].stop + r.start) / 2 + 10 if i else 10
            right = (r.stop + along[i + 1].start) / 2 + 10 if i + 1 < len(along) else 510
            assert (bars[r.gene].left, bars[r.gene].right) == (left, right)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_auto_breaks_against_plain_python(spark, monkeypatch):
    """The whole of it, signals to suppression, on one scaffold in blocks and on a second one."""
    monkeypatch.setattr(scans, "BLOCK_RANKS", 30)
    monkeypatch.setattr(peaks, "SPAN", 200)
    rng = np.random.default_rng(8)
    values = {s: np.round(np.abs(np.sin(np.arange(n) / 7)) + rng.uniform(0, 0.6, n), 3) for s, n in (("s", 900), ("t", 40))}
    hand = [("s", 450, 9.0), ("s", 452, 0.1), ("t", 39, 0.2)]

    def rule(found, window):
        found = centres = sorted(set(found))
        while True:
            held = [sum(abs(a[0] - b[0]) < window for b in found) for a in centres]
            if not found or max(held) < 2:
                return found
            at = centres[held.index(max(held))]
            members = [b for b in found if abs(at[0] - b[0]) < window]
            best = min(members, key=lambda b: (-b[1], b[0]))
            found = [b for b in found if b not in members or b == best]

    want = set()
    for scaf, d in values.items():
        above = lambda v, by: np.where(~(by < np.nanmedian(by)), v, np.nan)
        raw = above(d, d)
        mean = np.full(len(d), np.nan)
        mean[1:-1] = (raw[:-2] + raw[1:-1] + raw[2:]) / 3
        steps = {n: above(np.diff(v, prepend=np.nan), v) for n, v in (("mean_step", mean), ("raw_step", raw))}
        found = []
        for v in (mean, raw, *steps.values()):
            at = np.flatnonzero(~np.isnan(v))
            runs = [r for r in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(r) > 1]
            found += rule([(int(max(r, key=lambda i: (d[i], -i))), float(max(d[r]))) for r in runs], 20)
        found += [(i, x) for s, i, x in hand if s == scaf]
        want |= {(scaf, *p) for p in rule(found, 5)}
    rows = spark.createDataFrame([(s, i, float(x)) for s, v in values.items() for i, x in enumerate(v)], "A_scaf string, A_ix bigint, A_D double")
    manual = spark.createDataFrame(hand, "scaf string, ix bigint, d double")
    got = {(r.scaf, r.ix, r.d) for r in peaks.auto_breaks(rows, "A", manual).collect()}
    assert got == want and ("s", 450, 9.0) in got


def test_fisher_tails():
    for n, r, c in ((12, 5, 7), (30, 11, 4), (40, 40, 6), (25, 20, 22), (9, 0, 3), (60, 30, 30)):
        ways = [math.comb(r, t) * math.comb(n - r, c - t) for t in range(max(0, r + c - n), min(r, c) + 1)]
        low = max(0, r + c - n)
        xs = np.arange(low, min(r, c) + 1)
        got = stats.ln_tail(xs, *(np.full(len(xs), v) for v in (r, c, n)))
        want = [math.log(sum(ways[k:]) / math.comb(n, c)) for k in range(len(ways))]
        assert np.allclose(got, want, rtol=1e-11, atol=1e-13)


def test_fisher_tails_at_a_thousand_million_genes():
    """Nearly a Poisson draw with mean 1, and a far tail against exact logarithms of whole numbers."""
    n, r = 10**9, 31_623
    xs = np.arange(1, 12)
    got = stats.ln_tail(xs, np.full(11, r), np.full(11, r), np.full(11, n))
    mean = r * r / n
    want = [math.log(1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(x))) for x in xs[:6]]
    assert np.allclose(got[:6], want, rtol=2e-3) and (np.diff(got) < 0).all()
    big, half = np.array([10**9]), np.array([5 * 10**8])
    near = stats.ln_tail(half // 2, half, half, big)[0]
    assert near == pytest.approx(math.log(0.5), abs=1e-4)
    sd = math.sqrt(10**9 / 16)
    assert stats.ln_tail(half // 2 + int(6 * sd), half, half, big)[0] == pytest.approx(math.log(math.erfc(6 / math.sqrt(2)) / 2), rel=1e-3)


def test_a_falling_chain_of_hits_is_taken_to_its_end(spark):
    chain = [(f"q{i // 2}", f"s{(i + 1) // 2}", float(i), 1.0) for i in range(24)]
    df = spark.createDataFrame([(q, s, e * 1e-9, b) for q, s, e, b in chain], "qseqid string, sseqid string, evalue double, bitscore double")
    used, want = set(), []
    for q, s, _, _ in chain:
        if q not in used and s not in used:
            want.append((q, s))
            used |= {q, s}
    assert sorted((r.qseqid, r.sseqid) for r in hits.greedy_one_to_one(df).collect()) == sorted(want)


def test_a_long_chain_takes_few_joins(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("concat('q', id div 2) AS qseqid", "concat('s', (id + 1) div 2) AS sseqid", "id * 1e-12D AS evalue", "1.0D AS bitscore")
    taken, joins = hits.greedy_rounds(chain)
    assert {r.qseqid for r in taken.collect()} == {f"q{i}" for i in range(n // 2)} and joins < 30


@pytest.mark.parametrize("seed", range(4))
def test_greedy_is_that_of_one_row_after_the_other(spark, seed):
    rng = random.Random(seed)
    rows = {(f"q{rng.randrange(9)}", f"s{rng.randrange(12)}", rng.randrange(5) * 1e-9, float(rng.randrange(3))) for _ in range(70)}
    used, want = set(), []
    for q, s, e, b in sorted(rows, key=lambda r: (r[2], -r[3], r[0], r[1])):
        if not {q, s} & used:
            want.append((q, s, e, b))
            used |= {q, s}
    df = spark.createDataFrame(sorted(rows), "qseqid string, sseqid string, evalue double, bitscore double")
    assert sorted(map(tuple, hits.greedy_one_to_one(df).collect())) == sorted(want)


@pytest.mark.parametrize(("a", "b"), [(3, 3), (1, 4), (2, 5)])
def test_runs_distribution_is_exact(a, b):
    r = mixing._runs(a, b)
    assert r.tolist() == list(range(2, a + b + 1))
    with np.errstate(all="ignore"):
        p = np.exp(mixing._runs_ln(a, b, r))
    strings = set(itertools.permutations("A" * a + "B" * b))
    runs = [1 + sum(x != y for x, y in itertools.pairwise(s)) for s in strings]
    assert p == pytest.approx([runs.count(k) / len(strings) for k in range(2, a + b + 1)])
    assert sum(p) == pytest.approx(1)
    mean = sum(q * k for k, q in zip(range(1, a + b), p, strict=True))
    assert mean == pytest.approx(2 * a * b / (a + b))


FUSED = "A_scaf string, B_scaf string, C_scaf string, D_scaf string, count bigint"


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([("o3", "b2", "c", "d", 5), ("o14", "b5", "c", "d", 9), ("o3", "b5", "c", "d", 5)], ["o14b5", "o3b2"]),
        ([("o3", "b11", "c", "d", 5), ("o3", "b2", "c", "d", 5), ("o5", "b6", "c", "d", 6), ("o2", "b9", "c", "d", 5)], ["o2b9", "o5b6"]),
        ([("o1", "b1", "c", "d", 5), ("o1", "b2", "c", "d", 5)], []),
    ],
)
def test_outgroup_duplicates(spark, rows, kept):
    out = fusion.resolve_outgroup_dups(spark.createDataFrame(rows, FUSED), "A", "B", "C", "D")
    assert sorted(r.A_scaf + r.B_scaf for r in out.collect()) == kept


def test_pairs_mix_only_where_they_should(spark):
    ends = ", ".join(f"{s}_{e} bigint" for s in "CD" for e in ("lo", "hi"))
    rows = [("o1", "b1", "c", "d", 5, 0, 10, 0, 10), ("o2", "b1", "c", "d", 5, 0, 10, 0, 10), ("o3", "b3", "c", "d", 119, 5, 9, 5, 9), ("o4", "b4", "c", "d", 20, 8, 30, 50, 60)]
    out = fusion.fusion_pairs(spark.createDataFrame(rows, f"{FUSED}, {ends}"), "A", "B", "C", "D").collect()
    mixed = {(r.A_scaf_1, r.A_scaf_2) for r in out if r.mixed}
    assert len(out) == 6 and mixed == {("o1", "o4"), ("o2", "o4"), ("o3", "o4")}


def test_dot_plot_order_keeps_linked_scaffolds_together(spark):
    pairs = [("x1", "y2", 0.01), ("x2", "y1", 0.01), ("x3", "y2", 0.02), ("x2", "y3", 0.5), ("x4", "y1", 0.9)]
    df = spark.createDataFrame(pairs, "x_scaf string, y_scaf string, p double")
    sizes = spark.createDataFrame([("x1", 0), ("x2", 1), ("x3", 2), ("x4", 3)], "scaf string, rank bigint")
    x, y = order.dotplot_order(df, sizes, df.select("x_scaf", "y_scaf", F.lit(1.0).alias("mean_ix")))
    names = lambda d: [r.scaf for r in d.orderBy("rank").collect()]
    assert names(x) == ["x1", "x3", "x2", "x4"]
    assert names(y) == ["y2", "y1", "y3"]


def test_validation_shows_three_examples(spark):
    df = spark.createDataFrame([(f"p{i}", "s", "?", "1", "2") for i in range(5)], "protein string, scaf string, strand string, start string, stop string")
    assert [tuple(r) for r in validate.validate_chrom(df).collect()] == [("strand", 5, ["p0", "p1", "p2"])]
    assert validate.validate_chrom(df.limit(0)).count() == 0


def test_unwrap_undoes_grouping(spark):
    rows = [(f"r{i}", f"a{i}", f"s{i % 3}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "rbh string, A_gene string, A_scaf string, A_pos bigint")
    for size in (None, 3):
        grouped = groups.group_by_scaffolds(df, ["A"], size).cache()
        back = groups.unwrap_groups(grouped).select(df.columns)
        assert sorted(map(tuple, back.collect())) == sorted(rows)
        for r in grouped.collect():
            mine = sorted(x for x in rows if x[2] == r.A_scaf)
            at = slice(3 * r.part, 3 * r.part + 3) if size else slice(None)
            assert r["count"] == len(mine) and r.rbh == [x[0] for x in mine[at]] and r.A_pos == [x[3] for x in mine[at]]


def test_break_peaks(spark):
    base = lambda n: np.random.default_rng(n).uniform(0, 0.2, n).tolist()
    d = base(60) + [0.2, 0.5, 1.2, 0.6, 0.3] + base(61) + [0.3, 0.9, 0.4] + base(5)
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(d)], "A_scaf string, A_ix bigint, A_D double")
    got = {r.ix for r in peaks.auto_breaks(rows, "A").collect()}
    assert {62, 127} <= got
    assert peaks.auto_breaks(rows.limit(0), "A").count() == 0
    stays, _ = peaks.settled(np.array([1, 3, 10, 12, 40]), np.array([1.0, 2.0, 3.0, 3.0, 0.1]), np.ones(5, bool), 20, -np.inf, np.inf)
    assert stays.tolist() == [False, False, True, False, True]


def test_degree_orthologs_count_dropped_partners(spark):
    rows = [("A", "B", "a1", "b1"), ("A", "C", "a1", "c1"), ("B", "C", "b1", "c1")]  # complete
    rows += [("A", "B", "a2", "b2"), ("A", "C", "a2", "c9"), ("B", "C", "b2", "c2"), ("A", "C", "a3", "c2")]  # a2-b2-c2, whose ends have their other partners elsewhere
    rows += [("A", "B", "a4", "b4"), ("B", "C", "b4", "c4")]  # ends without another partner
    edges = spark.createDataFrame(rows, "query_species string, target_species string, qseqid string, sseqid string")
    genes = lambda mode: {(r.A_gene, r.B_gene, r.C_gene) for r in hits.nway_rbh(edges, list("ABC"), mode).collect()}
    assert genes("strict") == {("a1", "b1", "c1")}
    assert genes("degree") == {("a1", "b1", "c1"), ("a2", "b2", "c2")}


def test_runs_of_a_query_start_again(spark):
    queries = "aaabbbaaac"
    rows = spark.createDataFrame(list(enumerate(queries)), "line int, qseqid string")
    got = sorted((r.line, r.place) for r in hits.top_hits_by_run(rows, "line", 2).collect())
    assert got == [(0, 1), (1, 2), (3, 1), (4, 2), (6, 1), (7, 2), (9, 1)]
    assert hits.top_hits_by_run(rows.where("line < 0"), "line").count() == 0


def test_colors_are_those_of_all_hashes_made_in_steps(spark):
    def want(key, tries):
        found = [f"#{hashlib.md5(f'{key}:{i}'.encode()).hexdigest()[:6]}" for i in range(tries)]
        for c in found:
            r, g, b = (int(c[k : k + 2], 16) for k in (1, 3, 5))
            bright, grey = (299 * r + 587 * g + 114 * b) / 1000, (max(r, g, b) - min(r, g, b)) / max(r, g, b, 1)
            if 127 < bright < 300 and 0.3 < grey < 0.8:
                return c
        return found[0]

    keys = spark.range(300).selectExpr("concat('k', id) key")
    for tries in (1, 3, 64):
        shown = keys.select("key", color.assign_color(F.col("key"), tries).alias("c"))
        assert all(r.c == want(r.key, tries) for r in shown.collect())
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce" in plan and plan.count("lambdafunction") > 4  # steps, not one list of 64


def test_column_orders(spark):
    columns = ["z", "B_scaf", "A_pos", "alpha_type", "count", "rbh", "A_gene", "gene_group", "alpha", "y_A"]
    table = spark.createDataFrame([tuple("x" * len(columns))], columns)
    assert groups.order_group_columns(table, ["A", "B"]).columns == ["rbh", "gene_group", "count", "alpha", "alpha_type", "A_gene", "A_pos", "B_scaf", "y_A", "z"]
    assert groups.order_profile_columns(table, ["B"], ["A"]).columns == ["rbh", "alpha", "alpha_type", "count", "gene_group", "y_A", "z", "B_scaf", "A_gene", "A_pos"]


def test_protein_checks_name_three_examples(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, seq string")
    twice = frame([(f"p{k % 4}", f"S{k}") for k in range(8)])
    with pytest.raises(ValueError, match="more than once, such as p0, p1, p2$"):
        validate.check_proteins(twice)
    same = frame([("a", "S"), ("b", "S"), ("c", "T")])
    with pytest.raises(ValueError, match="such as b$"):
        validate.check_proteins(same)
    validate.check_proteins(same, "pass")
    with pytest.raises(ValueError, match="not keep"):
        validate.check_proteins(same, "keep")
    with pytest.raises(ValueError, match="gene_group"):
        validate.require_columns(same, ["id", "gene_group"])


def test_compressed_null_against_all_strings(spark):
    def value(letters):
        runs = 1 + sum(a != b for a, b in zip(letters, letters[1:], strict=False))
        a, b = (runs + 1) // 2, runs // 2
        return None if runs == 2 else (runs - 2) / (2 * a * b / runs - 1)

    for n_a, n_b in ((1, 2), (3, 3), (4, 3)):
        values = [value("".join("A" if k in at else "B" for k in range(n_a + n_b))) for at in map(set, itertools.combinations(range(n_a + n_b), n_a))]
        runs = n_a + n_b
        own = value(("AB" * runs)[:runs])
        row = mixing.mixing_null(spark.createDataFrame([(n_a, n_b, runs - 1, own)], "n_a long, n_b long, changes long, m double"), compress=True).first()
        counted = {round(v, 9): sum(u is not None and abs(u - v) < 1e-9 for u in values) for v in values if v is not None}
        assert counted[round(row["mode"], 9)] == max(counted.values())
        assert row.p_value_unmixed == pytest.approx(sum(v is not None and v <= own + 1e-9 for v in values) / len(values))
    empty = mixing.mixing_null(spark.createDataFrame([(1, 1, 1, None)], "n_a long, n_b long, changes long, m double"), compress=True).first()
    assert empty["mode"] is None and empty.p_value_unmixed is None


def test_hits_color_where_no_id_is_known(spark):
    long = spark.createDataFrame([("r1", "A", "g1"), ("r2", "A", "g2")], "rbh string, species string, gene string")
    names = lambda gene, group: spark.createDataFrame([(gene, group, "#00FF00")], "gene string, gene_group string, color string")
    found = lambda ids: {r.rbh: r.gene_group for r in order.color_by_ids_or_hits(long, ids, names("g2", "hit"), ["A"]).collect()}
    assert found(names("g1", "id")) == {"r1": "id", "r2": "None"}
    assert found(names("g7", "id")) == {"r1": "None", "r2": "hit"}


def planted_orthologs(n, seed, scaffolds=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u = rng.randrange(scaffolds)
        row = [f"r{i:04}"]
        for s in "ABCD":
            scaf = u // (2 if s in "CD" else 1) if rng.random() < 0.7 else rng.randrange(scaffolds)
            row += [f"{s}{scaf}", rng.randrange(60)]
        rows.append(tuple(row))
    return rows


ORTHOLOGS = "rbh string, " + ", ".join(f"{s}_scaf string, {s}_pos bigint" for s in "ABCD")


@pytest.mark.parametrize("seed", range(3))
def test_fusion_batches_equal_the_joins(spark, monkeypatch, seed):
    df = spark.createDataFrame(planted_orthologs(400, seed), ORTHOLOGS).repartition(3).cache()
    columns = ["trial", "hyp", *fusion.METRICS]
    rows = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    for s in "BD":
        want = rows(fusion.fusion_null(df, list("ABCD"), s, 4))
        assert rows(fusion_trials.fusion_null_batches(df, list("ABCD"), [s], 4, ranked=True)) == want
        assert any(r[4] for r in want)
    monkeypatch.setattr(fusion_trials, "BATCH_ROWS", 10)
    assert rows(fusion_trials.fusion_null_batches(df, list("ABCD"), ["D"], 2, first=2)) == [r for r in want if r[0] >= 2]


def test_fusion_batches_continue(spark):
    df = spark.createDataFrame([*planted_orthologs(300, 7), ("x", None, 1, "B1", 1, "C1", 1, "D1", 1)], ORTHOLOGS)
    run = lambda n, first=0: sorted(map(tuple, fusion_trials.fusion_null_batches(df.repartition(2 + n), list("ABCD"), ["B", "C"], n, first).collect()))
    whole = run(5)
    assert len(whole) == 5 * 2 * 3 and sorted(run(2) + run(3, 2)) == whole
    assert fusion_trials.fusion_null_batches(df.limit(0), list("ABCD"), ["B"], 2).count() == 0


def test_chunks_deal_every_code_and_its_ends():
    """Ends from border orthologs alone, or from all, follow the same law as plain permutations."""
    pos, counts = np.array([[5, 1, 4, 2, 3, 0, 9, 6, 7, 8], range(10)]), np.array([4, 2, 0, 4])
    law = {}
    for name, reach in (("plain", 10), ("border", 1)):
        chunk, rng = fusion_trials.Chunk(pos, reach), np.random.default_rng(5)
        assert bool(len(chunk.rest)) == (name == "border")
        seen = law[name] = {}
        for _ in range(20000):
            spans = tuple(chunk.spans(rng, counts)[:, [0, 1, 3]].ravel().tolist())
            assert all(spans[k] <= spans[k + 3] for k in (0, 1, 2, 6, 7, 8))
            seen[spans[:6]] = seen.get(spans[:6], 0) + 1
    for s in {**law["plain"], **law["border"]}:
        a, b = (x.get(s, 0) for x in law.values())
        assert abs(a - b) < 5 * math.sqrt(a + b + 1)


def test_fusion_trials_by_chunk(spark, monkeypatch):
    df = spark.createDataFrame(planted_orthologs(600, 5), ORTHOLOGS)
    monkeypatch.setattr(fusion_trials, "BATCH_ROWS", 10)
    monkeypatch.setattr(fusion_trials, "CHUNKED_ROWS", 10)
    monkeypatch.setattr(fusion_trials, "CHUNK", 20)
    joins = []
    monkeypatch.setattr(fusion_trials, "fusion_null", lambda *a: joins.append(a))
    run = lambda n, first=0: sorted(map(tuple, fusion_trials.fusion_null_batches(df.repartition(2 + n), list("ABCD"), ["B", "D"], n, first).collect()))
    whole = run(40)
    assert len(whole) == 40 * 2 * 3 and not joins and sorted(run(1) + run(39, 1)) == whole
    monkeypatch.undo()
    batches = fusion_trials.fusion_null_batches(df, list("ABCD"), ["B", "D"], 40).collect()
    for s in "BD":
        for m in (3, 4, 5, 6):  # largest tuple, largest grouping, all, groupings
            values = [np.array([r[m] for r in rows if r[0] == s], float) for rows in (whole, batches)]
            assert abs(values[0].mean() - values[1].mean()) < 5 * np.hypot(*(v.std() for v in values)) / np.sqrt(40) + 1e-9


def test_fusion_kernel_with_many_tuples(monkeypatch):
    """Sorting codes instead of counting in an array changes nothing."""
    rng = np.random.default_rng(3)
    codes, pos = rng.integers(0, 5, (4, 900)), rng.integers(0, 100, (4, 900))
    dense = fusion_trials.Trials(codes, pos, 2)
    sparse = fusion_trials.Trials(codes, pos, 2)
    monkeypatch.setattr(fusion_trials, "DENSE", 0)
    monkeypatch.setattr(fusion_trials, "DENSE_SHARE", 0)
    got = [sparse.groups(c, codes[c]) for c in (1, 2, 3)]
    monkeypatch.undo()
    for c, (names, count, spans) in zip((1, 2, 3), got, strict=True):
        other = dense.groups(c, codes[c])
        assert (names == other[0]).all() and (count == other[1]).all() and all((a == b).all() for x, y in zip(spans, other[2], strict=True) for a, b in zip(x, y, strict=True))


def test_coloring_deals_counted_parts(spark, monkeypatch):
    long = spark.createDataFrame([(f"r{k}", s, f"{s}g{k}") for k in range(40) for s in "AB"], "rbh string, species string, gene string")
    names = spark.createDataFrame([(f"{s}g{k}", f"L{s}{k % 3}", "#00000" + str(k % 2)) for k in range(30) for s in "AB" if (k + ord(s)) % 2], "gene string, gene_group string, color string")
    run = lambda: order.color_by_lg(long, names, ["A", "B"])
    whole = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(order, "TASK_ROWS", 10)
    assert run().rdd.getNumPartitions() == 9
    assert sorted(map(tuple, run().collect())) == whole and ("r35", "None", "#000000") in whole


def test_numbered_rows_are_not_moved_again(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.col("id").alias("v")).repartition(3)
    out = hits.number_rows(df, ["k"], keep=["v"])
    assert out.columns == ["v", "number"] and "row_number" not in out._jdf.queryExecution().sparkPlan().toString()
    assert all(r.number == r.v * 7 % 500 + 1 for r in out.collect())

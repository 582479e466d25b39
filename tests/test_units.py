"""Hand-computed values, statistics and invariants of the set-overlap operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setwise.config import EPSILON_GRID, Config, flip_rate
from setwise.functions import mathx
from setwise.functions.prng import digest, hash_rank
from setwise.operators import answer, exact, minhash, oue, tails, tree
from setwise.sources import text
from setwise.streaming import reports


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*values):
    return [F.lit(float(v)) for v in values]


def test_normal_tail_against_the_library(spark):
    rows = spark.range(-600, 601).select((F.col("id") / 100.0).alias("z"), mathx.ccdf(F.col("id") / 100.0).alias("t")).collect()
    assert max(abs(r["t"] - 0.5 * math.erfc(r["z"] / math.sqrt(2))) for r in rows) < 1e-7


def test_gaussian_tail_steps(spark):
    assert value(spark, mathx.gaussian_tail(*lits(3, 0), F.lit(3))) == 1.0
    assert value(spark, mathx.gaussian_tail(*lits(2.4, 0), F.lit(3))) == 0.0
    assert value(spark, mathx.gaussian_tail(*lits(0, 1), F.lit(0))) == 1.0
    assert value(spark, mathx.gaussian_tail(*lits(2.5, 1), F.lit(3))) == pytest.approx(0.5, abs=1e-7)


def test_hash_choices_of_the_grid():
    assert [Config(epsilon=e).hash_choices for e in EPSILON_GRID] == [1, 1, 1, 1, 2, 2, 3, 3, 4, 4]
    assert Config(epsilon=4, budget="split").report_epsilon == 2


def test_parsers(spark):
    lines = spark.createDataFrame([(1, "1,2,2,3"), (2, ",5,,6,"), (3, "   "), (4, ","), (5, " 7 , 8 ")], "uid bigint, value string")
    assert {r["uid"]: r["items"] for r in text.parse_baskets(lines).collect()} == {1: [1, 2, 3], 2: [5, 6], 4: [], 5: [7, 8]}
    asked = spark.createDataFrame([(1, "2 4,5,6"), (2, "3"), (3, "")], "qid bigint, value string")
    assert {r["qid"]: (r["threshold"], r["items"]) for r in text.parse_queries(asked).collect()} == {1: (2, [4, 5, 6]), 2: (3, [])}


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("3,17\n\n5\n")
    (tmp_path / "q.txt").write_text("1 3\n2\n")
    (tmp_path / "f.txt").write_text("0.5\n0.25\n0.125\n")
    assert sorted(r["items"] for r in text.read_baskets(spark, str(tmp_path / "b.txt")).collect()) == [[3, 17], [5]]
    assert text.read_queries(spark, str(tmp_path / "q.txt")).count() == 2
    assert [r["freq"] for r in text.read_frequencies(spark, str(tmp_path / "f.txt"), 2).orderBy("qid").collect()] == [0.5, 0.25]
    with pytest.raises(Exception, match="fewer"):
        text.read_frequencies(spark, str(tmp_path / "f.txt"), 4).collect()


def test_exact_counts_edges(spark):
    pairs = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 2)], "uid bigint, item int")
    asked = spark.createDataFrame([(1, 0, [9]), (2, 1, []), (3, 2, [0, 1]), (4, 1, [1, 1]), (5, 5, [0, 1, 2]), (6, -1, [])], "qid bigint, threshold int, items array<int>")
    got = {r["qid"]: r["true_count"] for r in exact.overlap_counts(pairs, asked).collect()}
    assert got == {1: 3, 2: 0, 3: 1, 4: 2, 5: 0, 6: 3}


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1.0, 10, 12, 100), (1.0, 0, 3, 100), (1.0, 1, 900, 100)], "epsilon double, true_count int, est_count int, users int")
    r = exact.metrics(rows).first()
    assert r["mse"] == pytest.approx((0.02**2 + 0.03**2 + 8.99**2) / 3)
    assert r["mre"] == pytest.approx((0.2 + 100) / 3) and r["mre_positive"] == pytest.approx((0.2 + 100) / 2)


def test_hash_rank_is_the_global_order(spark):
    rows = hash_rank(spark.range(5000).select(F.col("id").alias("uid")).repartition(7).withColumn("d", digest(1, "x", "uid")), "d", "uid").collect()
    ordered = sorted(rows, key=lambda r: (r["d"], r["uid"]))
    assert [r["rank"] for r in ordered] == list(range(1, 5001))


@pytest.mark.parametrize("users,blocks", [(1000, 8), (5, 8), (8, 8), (1, 4)])
def test_cohorts_cover_everyone(spark, users, blocks):
    rows = oue.cohorts(spark.range(users).select(F.col("id").alias("uid")), 0.2, blocks, 7).collect()
    assert len(rows) == users and sum(r["role"] == "underlying" for r in rows) == int(users * 0.2)
    sizes = {}
    for r in rows:
        if r["role"] == "tree":
            sizes.setdefault(r["block_id"], []).append((r["pos"], r["block_size"]))
    for positions in sizes.values():
        assert sorted(p for p, _ in positions) == list(range(1, len(positions) + 1)) and {s for _, s in positions} == {len(positions)}


def test_reports_are_unbiased(spark):
    users = spark.range(2000).select(F.col("id").alias("uid"), (F.col("id") % 4).alias("value"))
    scores = []
    for seed in range(12):
        for r in oue.aggregate(oue.reports(users, F.lit(6), 1.0, seed, "t", ["uid"]), 1.0, []).collect():
            true = 500 if r["y"] < 4 else 0
            q = flip_rate(1.0)
            scores.append((r["est_count"] - true) / (math.sqrt(true * 0.25 + (2000 - true) * q * (1 - q)) / (0.5 - q)))
    assert abs(np.mean(scores)) < 4 / math.sqrt(len(scores)) and 0.6 < np.var(scores) < 1.5


def test_simulated_aggregates_are_unbiased(spark):
    counts = spark.range(2000).select(F.col("id").alias("y"), F.lit(300).alias("t"), F.lit(1000).alias("n"))
    rows = oue.simulated_aggregate(counts, 2.0, 1, "s", []).collect()
    assert abs(np.mean([r["est_count"] for r in rows]) - 300) < 4 * np.std([r["est_count"] for r in rows]) / math.sqrt(2000)


def test_smoothing(spark):
    rows = spark.createDataFrame([(0, 6.0), (1, 5.0), (2, -3.0), (3, 0.5)], "y int, c double")
    clip = {r["y"]: r["c"] for r in oue.smooth(rows, "c", F.lit(10.0), [], "clip").collect()}
    assert sum(clip.values()) == pytest.approx(10) and clip[2] == 0 and clip[0] == pytest.approx(6 / 11.5 * 10)
    norm = {r["y"]: r["c"] for r in oue.smooth(rows, "c", F.lit(10.0), [], "normsub").collect()}
    assert norm == pytest.approx({0: 5.5, 1: 4.5, 2: 0.0, 3: 0.0})
    assert {r["c"] for r in oue.smooth(rows, "c", F.lit(10.0), [], "none").collect()} == {6.0, 5.0, -3.0, 0.5}


def test_pair_ids_are_row_major(spark):
    for size in (2, 3, 6, 11):
        wanted, i = {}, 1
        for a in range(size):
            for b in range(a + 1, size):
                wanted[(a, b)] = i
                i += 1
        rows = spark.createDataFrame(list(wanted), "a int, b int").select("a", "b", oue.pair_id(F.col("a"), F.col("b"), F.lit(size)).alias("i")).collect()
        assert {(r["a"], r["b"]): r["i"] for r in rows} == wanted


def test_signatures_agree_as_often_as_jaccard(spark):
    sets = spark.createDataFrame([(1, i) for i in range(0, 60)] + [(2, i) for i in range(20, 80)], "uid bigint, item int")
    rows = minhash.signatures(sets, ["uid"], 400, 3).collect()
    by = {(r["uid"], r["ell"]): r["winner"] for r in rows}
    rate = np.mean([by[1, e] == by[2, e] for e in range(400)])
    assert abs(rate - 0.5) < 4 * 0.5 / 20
    array = value(spark, minhash.signature_array(F.array(*[F.lit(i) for i in range(60)]), 400, 3))
    assert array == [by[1, e] for e in range(400)]
    assert value(spark, minhash.signature_array(F.array().cast("array<int>"), 3, 3)) == [-1, -1, -1]


def test_chain_by_hand():
    w = np.array([[0, 5, 1, 0], [5, 0, 2, 0], [1, 2, 0, 0], [0, 0, 0, 0]], float)
    assert tree.chain_order(w) == [1, 0, 2, 3]


def test_mutual_information_by_hand(spark):
    independent = tree.mutual_information(*lits(0.4, 0.5, 0.2))
    assert value(spark, independent) == pytest.approx(0.0, abs=1e-12)
    assert value(spark, tree.mutual_information(*lits(0.5, 0.5, 0.5))) == pytest.approx(math.log(2))


def test_inverse_variance(spark):
    f, v = answer.combine(*lits(0.2, 0.01, 0.6, 0.03))
    assert value(spark, f) == pytest.approx(0.3) and value(spark, v) == pytest.approx(0.0075)
    f, v = answer.combine(*lits(0.2, math.inf, 0.6, 0.03))
    assert (value(spark, f), value(spark, v)) == (0.6, 0.03)
    f, v = answer.combine(*lits(0.2, 0.01, 0.6, 0))
    assert (value(spark, f), value(spark, v)) == (0.2, 0.01)


def test_variance_and_sampling_error_by_hand(spark):
    e = math.exp(1.0)
    assert value(spark, tails.oue_variance(F.lit(100), 1.0)) == pytest.approx(4 * e / (e - 1) ** 2 / 100)
    q = flip_rate(2.0)
    assert value(spark, tails.sampling_mse(*lits(0.3, 1, 1000), 2.0)) == pytest.approx((0.3 * 0.25 + 0.7 * q * (1 - q)) / (0.5 - q) ** 2 / 1000)


def test_static_tree_partitions_items():
    nodes = tree.static_tree(25, 2, 10)
    for n in nodes:
        children = [c for c in nodes if c.parent_id == n.node_id]
        if children:
            assert [i for c in children for i in range(c.lo, c.hi)] == list(range(n.lo, n.hi))
    spent = tree.uniform_allocation(nodes, 1000)
    assert spent[0][0] == 333 and all(a + b <= 1000 for a, b in spent.values())


def test_node_selection_against_brute_force(spark):
    rnd = random.Random(4)
    for round_ in range(4):
        sets, parents, depths = {0: list(range(24))}, {0: None}, {0: 0}
        todo = [0]
        while todo:
            n = todo.pop(0)
            if len(sets[n]) >= 4 and depths[n] < 4 and (n == 0 or rnd.random() < 0.8):
                items = sets[n][:]
                rnd.shuffle(items)
                cut = rnd.randint(1, len(items) - 1)
                for part in (items[:cut], items[cut:]):
                    new = len(sets)
                    sets[new], parents[new], depths[new] = part, n, depths[n] + 1
                    todo.append(new)
        nodes = spark.createDataFrame([(n, parents[n], depths[n], len(s)) for n, s in sets.items()], "node_id int, parent_id int, depth int, size int")
        node_items = spark.createDataFrame([(n, i) for n, s in sets.items() for i in s], "node_id int, item int")
        queries = [(q, rnd.randint(1, 3), rnd.sample(range(26), rnd.randint(1, 9))) for q in range(25)]
        got = {}
        for r in answer.select_nodes(spark.createDataFrame(queries, "qid bigint, threshold int, items array<int>"), node_items, nodes, 4).collect():
            got.setdefault(r["qid"], set()).add((r["role"], r["node_id"]))
        for q, t, asked in queries:
            want, taken = set(), set()
            covering = [n for n in sets if set(asked) <= set(sets[n])]
            if covering:
                want.add(("full", min(covering, key=lambda n: (-depths[n], n))))
            for n in sorted(sets, key=lambda n: (-depths[n], n)):
                r = set(asked) & set(sets[n])
                if n != 0 and n not in covering and len(r) >= t and r and not r & taken:
                    want.add(("partial", n))
                    taken |= r
            assert got.get(q, set()) == want, (round_, q)


def test_histograms_and_answers_stay_in_bounds(spark):
    rnd = random.Random(2)
    pairs = spark.createDataFrame(sorted({(u, rnd.randrange(12)) for u in range(400) for _ in range(4)}), "uid bigint, item int")
    items = spark.createDataFrame([(i,) for i in range(12)], "item int")
    config = Config(epsilon=8.0, hashes=16, max_depth=1, min_child=3)
    built = tree.grow(pairs, items, config)
    for hist in (built.oue_hist, built.minhash_hist):
        sums = hist.groupBy("node_id").agg(F.sum("freq").alias("s"), F.count("*").alias("bins")).collect()
        assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    assert all(r["n"] <= config.hash_choices + 1 for r in built.minhash_hist.groupBy("node_id").agg(F.count("*").alias("n")).collect())
    queries = spark.createDataFrame([(1, 0, [1]), (2, 1, []), (3, 1, [1, 2, 3]), (4, 2, [99, 98]), (5, 3, list(range(12)))], "qid bigint, threshold int, items array<int>")
    got = {r["qid"]: r["f_hat"] for r in answer.answers(built, queries).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[4] == 0.0 and all(0 <= v <= 1 for v in got.values())
    assert answer.spent_epsilon(built) == 16.0
    again = {r["qid"]: r["f_hat"] for r in answer.answers(tree.grow(pairs.repartition(9), items, config), queries).collect()}
    assert again == pytest.approx(got)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("uid"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 5).alias("y"), (F.col("id") % 3 == 0).cast("int").alias("bit"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = reports.read_reports(spark, str(tmp_path / "in"), 1)
    assert stream.isStreaming
    reports.run_available(reports.estimates(stream, 1.0), "est", str(tmp_path / "c1"))
    batch = reports.estimates(spark.read.parquet(str(tmp_path / "in")), 1.0)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("est")) == key(batch)
    reports.run_available(reports.windowed_estimates(stream, 1.0), "win", str(tmp_path / "c2"), "complete")
    assert key(spark.table("win")) == key(reports.windowed_estimates(spark.read.parquet(str(tmp_path / "in")), 1.0))


def test_pair_numbers_and_pairs_are_inverse(spark):
    """All pairs of small domains, and the edges of domains of thousands of items."""
    sizes = [2, 3, 7, 60]
    rows = [(k, y) for k in sizes for y in range(0, k * (k - 1) // 2 + 1)]
    for k in (5298, 100_000):
        top = k * (k - 1) // 2
        rows += [(k, y) for y in (0, 1, 2, k - 1, k, k + 1, 2 * k - 3, 2 * k - 2, top // 2, top - 2, top - 1, top)]
    table = spark.createDataFrame(rows, "size int, y bigint")
    a, b = oue.pair_of(F.col("y"), F.col("size"))
    back = table.withColumns({"a": a, "b": b}).withColumn("again", oue.pair_id(F.col("a"), F.col("b"), F.col("size"))).collect()
    assert all(r["again"] == r["y"] for r in back)
    assert all((r["a"] is None) == (r["y"] == 0) and (r["y"] == 0 or 0 <= r["a"] < r["b"] < r["size"]) for r in back)
    assert len({(r["size"], r["a"], r["b"]) for r in back}) == len(set(rows))


def test_drawn_aggregates_have_the_law_of_reports(spark):
    """Both ways estimate the same frequencies within their standard error; every element is there, also unseen ones."""
    n, domain = 6000, 8
    values = spark.range(n).select(F.col("id").alias("uid"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5).cast("int").alias("value"))
    true = {r["value"]: r["c"] / n for r in values.groupBy("value").agg(F.count("*").alias("c")).collect()}
    cells = spark.range(domain).withColumnRenamed("id", "y")
    drawn = oue.drawn_aggregate(values.select("value"), cells, 2.0, 7, "test", [])
    reported = oue.aggregate(oue.reports(values, F.lit(domain), 2.0, 7, "bits", ["uid"]), 2.0, [])
    q = flip_rate(2.0)
    error = 5 * math.sqrt(0.25 / n) / (0.5 - q)
    for made in (drawn, reported):
        got = {r["y"]: (r["est_freq"], r["n"]) for r in made.collect()}
        assert sorted(got) == list(range(domain)) and {v[1] for v in got.values()} == {n}
        assert all(abs(got[y][0] - true.get(y, 0.0)) < error for y in got)
    again = oue.drawn_aggregate(values.repartition(7).select("value"), cells.repartition(3), 2.0, 7, "test", [])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))


def test_keyed_blake_matches_hashlib(spark):
    import hashlib

    things = spark.createDataFrame([(e, i) for e in range(3) for i in range(20)], "ell int, item int")
    for r in minhash.hashed_output_blake(things, 11, 16).collect():
        digest = hashlib.blake2b(str(r["item"]).encode(), digest_size=8, key=f"11|{r['ell']}".encode()).digest()
        assert r["out"] == int.from_bytes(digest, "big") % 16


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    lines = [f"{i % 4} {i},{i + 1}" if i % 9 else " " for i in range(400)]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.txt").write_text("\n".join(lines[:300]) + "\n")
    (tmp_path / "q" / "b.txt").write_text("\n".join(lines[300:]) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = {r["qid"]: (r["threshold"], r["items"]) for r in text.read_queries(spark, str(tmp_path / "q")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    filled = [i for i in range(400) if i % 9]
    assert got == {n: (i % 4, [i, i + 1]) for n, i in enumerate(filled)}
    (tmp_path / "f.txt").write_text("0.5\n\n0.25\n 0.125 \n9\n")
    assert [(r["qid"], r["freq"]) for r in text.read_frequencies(spark, str(tmp_path / "f.txt"), 3).orderBy("qid").collect()] == [(0, 0.5), (1, 0.25), (2, 0.125)]


def test_guard_refuses_small_nodes(spark):
    nodes = spark.createDataFrame([(0, 25), (1, 2)], "node_id int, size int")
    assert {r["node_id"]: r["starts"] for r in tree.guarded(nodes, 2).collect()} == {0: [1, 13], 1: [1]}
    with pytest.raises(Exception, match="fanout"):
        tree.guarded(nodes, 3).collect()


def test_split_proposal_keeps_the_chain_together(spark):
    """Both sides of a proposed cut are runs of the greedy chain, and have the least size at least."""
    from setwise import catalog

    f = catalog.Fixture(spark, "/root/testdata/sf0.001", stored=True)
    made = {"pair_freq": f.pair_freq, "sizes": f.sizes, "winners": f.winners, "minhash_hist": f.minhash_hist}
    sides = {(r["node_id"], r["item"]): r["side"] for r in tree.proposals(made, f.node_items, f.probabilities, catalog.CONFIG).collect()}
    chain = tree.chains(tree.pmi_weights(f.pair_freq, f.node_p), f.sizes).join(f.node_items, ["node_id", "local_id"]).orderBy("node_id", "position").collect()
    for node in {n for n, _ in sides}:
        run = "".join(sides[node, r["item"]] for r in chain if r["node_id"] == node)
        assert run == "A" * run.count("A") + "B" * run.count("B") and min(run.count("A"), run.count("B")) >= catalog.CONFIG.min_child


def test_batch_signatures_are_signatures(spark):
    """Repeats, nulls, negative and very large items, a set of thousands, more items than are cached, more batches than one."""
    draw = random.Random(5)
    rows = [(u, "x" if u % 2 else None, draw.randrange(-50, 50) * 10**15) for u in range(300) for _ in range(1 + u % 7)] * 2
    rows += [(300, "x", i) for i in range(7000)] + [(301, "x", None), (302, "x", None), (302, "x", 4)]
    things = spark.createDataFrame(rows, "uid bigint, kind string, item bigint")
    plain = minhash.signatures(things.where("item is not null"), ["uid", "kind"], 7, 3).collect()
    assert sorted(map(str, minhash.batch_signatures(things, ["uid", "kind"], 7, 3).collect())) == sorted(map(str, plain))
    few = things.where("uid < 20 and item is not null")
    assert sorted(map(str, minhash.batch_signatures(few, ["uid", "kind"], 400, 3).collect())) == sorted(map(str, minhash.signatures(few, ["uid", "kind"], 400, 3).collect()))
    many = spark.range(9000).select(F.floor(F.col("id") / 2).alias("uid"), F.col("id").cast("int").alias("item"))
    got, wanted = minhash.batch_signatures(many, ["uid"], 300, 3), minhash.signatures(many, ["uid"], 300, 3)
    assert got.schema["winner"].dataType == wanted.schema["winner"].dataType
    assert got.count() == 4500 * 300 and not got.exceptAll(wanted.withColumn("ell", F.col("ell"))).count()


def test_user_signatures_are_not_shuffled_by_hash(spark):
    """Users' sets are shuffled and sorted, never a row for each user and hash function."""
    from setwise import catalog

    plan = catalog.h4_batch_user_signatures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.split("\n") if "Generate" in line or "Exchange" in line or "Sort " in line]
    assert "Generate" in rows[0] and sum("Generate" in line for line in rows) == 1


def test_runs_of_cells_have_the_law_of_single_draws(spark, monkeypatch):
    """Every cell once, also in several runs; its rows and the histogram are the same draws; law and smoothing are those of single cells."""
    monkeypatch.setattr(oue, "RUN", 1000)
    n, cells, epsilon = 400, 20_500, 2.0
    q = flip_rate(epsilon)
    values = spark.range(n).select(F.lit(3).alias("node_id"), F.when(F.col("id") < 300, 20_000).otherwise(F.col("id") % 50 * 400).alias("value"))
    domains = spark.createDataFrame([(3, cells), (4, 10)], "node_id int, cells bigint")  # nobody is in node 4
    runs = oue.cell_runs(values, domains, 7, "test", ["node_id"])
    assert runs.count() == 21
    rows = sorted((r["node_id"], r["y"], r["ones"]) for r in oue.run_cells(runs, epsilon).collect())
    assert [r[:2] for r in rows] == [(3, y) for y in range(cells)]
    hist = oue.run_histogram(runs, epsilon)
    counted = {}
    for _, _, ones in rows:
        counted[ones] = counted.get(ones, 0) + 1
    assert {r["ones"]: r["cells"] for r in hist.collect()} == counted and {r["n"] for r in hist.collect()} == {n}
    ones = np.array([r[2] for r in rows])
    true = {r["value"]: r["c"] for r in values.groupBy("value").agg(F.count("*").alias("c")).collect()}
    free = ones[[y not in true for y in range(cells)]]
    spread = math.sqrt(n * q * (1 - q))
    assert abs(free.mean() - n * q) < 4 * spread / math.sqrt(len(free)) and abs(free.var() / spread**2 - 1) < 0.06
    assert abs(np.corrcoef(free[:-1], free[1:])[0, 1]) < 4 / math.sqrt(len(free))
    assert abs(ones[20_000] - 150 - (n - 300) * q) < 5 * math.sqrt(75 + 100 * q)
    again = oue.cell_runs(values.repartition(5), domains.repartition(3), 7, "test", ["node_id"])
    assert sorted((r["node_id"], r["y"], r["ones"]) for r in oue.run_cells(again, epsilon).collect()) == rows
    wide = hist.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("cells").cast("int")))).drop("i")
    for mode in ("none", "clip", "normsub"):
        single = {r["ones"]: r["est_freq"] for r in oue.smooth(wide, "est_freq", F.lit(1.0), ["node_id"], mode).collect()}
        assert {r["ones"]: r["est_freq"] for r in oue.smooth_histogram(hist, "est_freq", F.lit(1.0), ["node_id"], mode).collect()} == pytest.approx(single)


def test_pairs_of_a_hundred_thousand_items_are_all_estimated(spark):
    """More cells than an array holds."""
    size = 100_000
    items = spark.range(size).select(F.lit(0).alias("node_id"), F.col("id").cast("int").alias("item"), F.col("id").cast("int").alias("local_id"))
    users = spark.range(40).select(F.lit(0).alias("node_id"), F.col("id").alias("uid"))
    pairs = users.select("uid", F.explode(F.array(*[(F.col("uid") * 997 * k % size).cast("int") for k in (1, 2)])).alias("item")).distinct()
    sizes = spark.createDataFrame([(0, size)], "node_id int, size int")
    _, made = oue.pair_runs(pairs, users, items, sizes, Config(epsilon=5.0, draws="aggregate"))
    got = made.agg(F.sum("cells").alias("c"), F.sum(F.col("freq") * F.col("cells")).alias("f"), F.max("n").alias("n")).first()
    assert got["c"] == 1 + size * (size - 1) // 2 and got["f"] == pytest.approx(1) and got["n"] == 40


def test_drawn_pair_frequencies_are_counted_by_their_histogram(spark):
    items = spark.range(40).select(F.lit(0).alias("node_id"), F.col("id").cast("int").alias("item"), F.col("id").cast("int").alias("local_id"))
    users = spark.range(200).select(F.lit(0).alias("node_id"), F.col("id").alias("uid"))
    pairs = users.select("uid", F.explode(F.array(F.lit(3), F.lit(5), (F.col("uid") % 40).cast("int"))).alias("item")).distinct()
    sizes, config = spark.createDataFrame([(0, 40)], "node_id int, size int"), Config(epsilon=5.0, draws="aggregate")
    rows = oue.pair_frequencies(pairs, users, items, sizes, config).collect()
    assert {(r["a"], r["b"]) for r in rows} == {(a, b) for b in range(40) for a in range(b)} | {(None, None)} and len(rows) == 781
    assert max(rows, key=lambda r: r["freq"])[1:3] == (3, 5) and sum(r["freq"] for r in rows) == pytest.approx(1)
    counted = {}
    for r in rows:
        counted[round(r["freq"], 9)] = counted.get(round(r["freq"], 9), 0) + 1
    made = oue.pair_runs(pairs, users, items, sizes, config)[1].groupBy(F.round("freq", 9).alias("f")).agg(F.sum("cells").alias("c")).collect()
    assert {r["f"]: r["c"] for r in made} == counted


def test_one_draw_a_bit_serves_every_epsilon(spark):
    """The grid has what each epsilon's own reports give, and a plan of one draw; fewer hash choices are the first of more."""
    from setwise.functions.prng import uniform

    epsilons = (0.5, 2.0, 5.0)
    values = spark.range(400).select(F.col("id").alias("uid"), (F.col("id") % 3).cast("int").alias("value"), (F.col("id") % 2).cast("int").alias("g"))
    wide = values.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    grid = oue.aggregate_grid(wide, F.col("value") == F.col("y"), uniform(7, "bits", "uid", "y"), epsilons, ["g"])
    assert grid._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    for e in epsilons:
        own = oue.aggregate(oue.reports(values, F.lit(6), e, 7, "bits", ["uid"]).join(values.select("uid", "g"), "uid"), e, ["g"])
        got = grid.where(F.col("epsilon") == e).drop("epsilon").select(*own.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect())) and got.count() == 12
    users = values.select(F.lit(1).alias("node_id"), "uid")
    most, few = (minhash.chosen_hashes(users, Config(epsilon=e, hashes=16)) for e in (8.0, 4.0))
    assert sorted(map(tuple, most.where("choice < 2").collect())) == sorted(map(tuple, few.collect())) and most.count() == 1600

"""Registered queries over the default baskets, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EPSILON_GRID, Config, flip_rate
from .functions import mathx
from .functions.mathx import ccdf_sql, r6
from .functions.prng import digest_sql, uniform_sql
from .operators import answer, exact, minhash, oue, tails, tree
from .plans import evaluate
from .plans.oracles import CONFIG, SMALLEST, sql
from .plans.oracles import r6 as s6
from .sources import tables, text
from .storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Q, QH = flip_rate(CONFIG.report_epsilon), flip_rate(CONFIG.hash_epsilon)
SEED = CONFIG.seed


def register(oracle: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return add


class Fixture:
    """The default baskets with a static partition; every table is described on first use.

    With ``stored``, tables that several steps of an answer read are written once, in place of being computed
    by each of them.
    """

    STORED = ("pairs", "queries", "cohort", "node_items", "sizes", "hist", "pair_freq", "oue_hist", "winners", "bins", "minhash_hist", "cross", "asked", "alpha")

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False, config: Config = CONFIG):
        self.spark, self.sf_dir, self.config = spark, sf_dir, config
        self.scratch = Scratch(spark, "build") if stored else None
        self.items, pairs = tables.brand_baskets(spark, sf_dir)
        self._made: dict[str, DataFrame] = {"pairs": self.scratch.save(pairs, "pairs") if stored else pairs}

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name not in made:
            made[name] = getattr(type(self), f"_{name}")(self)
            if self.scratch is not None and name in self.STORED:
                made[name] = self.scratch.save(made[name], name)
        return made[name]

    #: Made of no report, so the same at every epsilon.
    EXACT = ("pairs", "cohort", "queries", "users", "static", "nodes", "node_items", "sizes", "node_users", "first", "second", "leaves", "selected", "asked")

    def at_epsilons(self, epsilons: Iterable[float]) -> dict[float, Fixture]:
        """The same baskets and partition with reports of other epsilons. Exact tables are shared, and every report is
        drawn once: each epsilon's estimates and winners are rows of stored tables."""
        configs = {e: replace(self.config, epsilon=e) for e in epsilons}
        grid = sorted({c.report_epsilon for c in configs.values()})
        shared = {name: getattr(self, name) for name in self.EXACT}
        rows = {
            "hist": oue.noisy_histogram(self.pairs, self.cohort, 25, self.config, grid),
            "pair_freq": oue.pair_frequencies(self.pairs, self.node_users, self.node_items, self.sizes, self.config, grid),
            "oue_hist": oue.intersection_histogram(self.pairs, self.first, self.node_items, self.sizes, self.config, grid),
            "cross": oue.cross_node_frequencies(self.pairs, self.cohort, self.leaves, self.config, grid),
        }
        stored = {name: self.scratch.save(df, f"{name}-grid") for name, df in rows.items()}
        most = max(configs.values(), key=lambda c: c.hash_choices)
        winners = self.scratch.save(minhash.node_signatures(self.pairs, self.second, self.node_items, most), "winners-grid")
        out = {}
        for e, config in configs.items():
            made = {name: df.where(F.col("epsilon") == config.report_epsilon).drop("epsilon") for name, df in stored.items()}
            made["winners"] = winners.where(F.col("choice") < config.hash_choices)
            out[e] = Fixture.__new__(Fixture)
            out[e].__dict__ |= self.__dict__ | {"config": config, "_made": shared | made}
        return out

    def _queries(self):
        return tables.default_queries(self.spark, self.items)

    def _users(self):
        return self.pairs.select("uid").distinct()

    def _cohort(self):
        return oue.cohorts(self.users, self.config.alpha, self.config.blocks, SEED)

    def _static(self):
        return tree.static_tables(self.spark, tree.static_tree(25, 2, SMALLEST), self.items)

    def _nodes(self):
        return self.static[0]

    def _node_items(self):
        return self.static[1]

    def _sizes(self):
        return minhash.node_sizes(self.node_items)

    def _node_users(self):
        return oue.node_users(self.cohort, self.nodes)

    def _first(self):
        return oue.first_half(self.node_users)

    def _second(self):
        return oue.second_half(self.node_users)

    def _hist(self):
        return oue.noisy_histogram(self.pairs, self.cohort, 25, self.config)

    def _probabilities(self):
        return tails.item_probabilities(self.hist)

    def _pair_freq(self):
        return oue.pair_frequencies(self.pairs, self.node_users, self.node_items, self.sizes, self.config)

    def _oue_hist(self):
        return oue.intersection_histogram(self.pairs, self.first, self.node_items, self.sizes, self.config)

    def _winners(self):
        return minhash.node_signatures(self.pairs, self.second, self.node_items, self.config)

    def _bins(self):
        return minhash.user_bins(self.winners, minhash.set_signatures(self.node_items, ["node_id"], self.config), self.sizes, self.config)

    def _minhash_hist(self):
        return minhash.bin_histogram(self.bins)

    def _leaves(self):
        numbered = self.nodes.where("is_leaf").select("node_id", (F.row_number().over(tree.Window.orderBy("node_id")) - 1).alias("leaf"))
        return self.node_items.join(F.broadcast(numbered), "node_id").select("node_id", "item", "leaf")

    def _cross(self):
        return oue.cross_node_frequencies(self.pairs, self.cohort, self.leaves, self.config)

    def _node_p(self):
        return tree.node_probabilities(self.node_items, self.probabilities)

    def _chain(self):
        local = minhash.prefix_order(self.node_items, self.hist).join(self.node_items, ["node_id", "item"])
        return local.select("node_id", "local_id", (F.col("position") - 1).alias("position"))

    def _build(self):
        return tree.Build(self.config, self.cohort.count(), 0, self.hist, self.nodes, self.node_items, self.sizes, self.pair_freq, self.oue_hist, self.minhash_hist, self.winners, self.bins, self.cross)

    def _selected(self):
        return answer.select_nodes(self.queries, self.node_items, self.nodes, 2)

    def _asked(self):
        wanted = self.queries.select("qid", "threshold", F.explode("items").alias("item"))
        return self.selected.join(wanted, "qid").join(F.broadcast(self.node_items.select("node_id", "item")), ["node_id", "item"]).select("role", "node_id", "qid", "threshold", "item")

    def _full_asked(self):
        return self.asked.where("role = 'full'").drop("role")

    def _partial_asked(self):
        return self.asked.where("role = 'partial'").drop("role")

    def _alpha(self):
        return answer.query_alpha(self.build, self.asked.drop("role"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


# sources and sinks


def _file(lines: DataFrame, order: str, name: str) -> str:
    """A folder of text files with the column ``value`` in that order; blank lines stand before every seventh line."""
    path = f"{Scratch(lines.sparkSession, 'files').root}/{name}.txt"
    spaced = F.when(F.col(order) % 7 == 0, F.concat(F.lit(" \n\n"), F.col("value"))).otherwise(F.col("value"))
    lines.orderBy(order).select(spaced.alias("value")).write.text(path)
    return path


def _sorted_items(items: str) -> Column:
    return F.array_join(F.sort_array(items).cast("array<string>"), " ").alias("items")


@register(sql("select row_number() over (order by uid) - 1 as uid, items from (select uid, array_to_string(list_sort(list(item)), ' ') as items from bi group by uid)"))
def s1_basket_scan(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    lines = tables.baskets_of(f.pairs).select("uid", F.concat(F.lit(" "), F.array_join(F.col("items").cast("array<string>"), ",, "), F.lit(",")).alias("value"))
    return text.read_baskets(spark, _file(lines, "uid", "baskets")).select("uid", _sorted_items("items"))


@register(sql("select qid - 1 as qid, threshold, array_to_string(list_sort(list(item)), ' ') as items from q join qi using (qid) group by qid, threshold"))
def s2_query_scan(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    lines = f.queries.select("qid", F.concat(F.col("threshold").cast("string"), F.lit("  "), F.array_join(F.col("items").cast("array<string>"), ",")).alias("value"))
    return text.read_queries(spark, _file(lines, "qid", "queries")).select("qid", "threshold", _sorted_items("items"))


@register(sql(f"select qid - 1 as qid, {s6('true_count / users')} as freq from truth where qid <= 15"))
def s3_truth_scan(spark, sf_dir):
    """A file with a line more for every query than there are queries; only the first 15 count."""
    f = Fixture(spark, sf_dir)
    lines = exact.overlap_counts(f.pairs, f.queries).select("qid", r6(F.col("true_count") / F.col("users")).cast("string").alias("value"))
    return text.read_frequencies(spark, _file(lines, "qid", "truth"), 15).select("qid", r6(F.col("freq")).alias("freq"))


@register(sql("select qid - 1 as qid, threshold, true_count, users, round(true_count / users, 6) + 0e0 as given from truth"))
def s1_file_workload(spark, sf_dir):
    """Baskets, queries and frequencies from text files, end to end: the exact counts and the file's frequency of each query."""
    f = Fixture(spark, sf_dir)
    baskets = tables.baskets_of(f.pairs).select("uid", F.array_join(F.col("items").cast("array<string>"), ",").alias("value"))
    asked = f.queries.select("qid", F.concat_ws(" ", F.col("threshold").cast("string"), F.array_join(F.col("items").cast("array<string>"), ",")).alias("value"))
    truth = exact.overlap_counts(f.pairs, f.queries).select("qid", r6(F.col("true_count") / F.col("users")).cast("string").alias("value"))
    users = text.read_baskets(spark, _file(baskets, "uid", "baskets"))
    queries = text.read_queries(spark, _file(asked, "qid", "queries"))
    counted = exact.overlap_counts(users.select("uid", F.explode("items").alias("item")), queries)
    given = text.read_frequencies(spark, _file(truth, "qid", "truth"), 20)
    return counted.join(given, "qid").select("qid", "threshold", "true_count", "users", r6(F.col("freq")).alias("given"))


# exact queries

_TRUTH = sql("select qid, threshold, true_count, users from truth")


@register(_TRUTH)
def e1_exact_threshold_count(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return exact.overlap_counts(f.pairs, f.queries)


@register(sql("select qid, threshold, true_count from truth"))
def e1_exact_small_batch(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return exact.overlap_counts_small(tables.baskets_of(f.pairs), f.queries)


@register(sql(f"select qid, threshold from q order by {digest_sql(SEED, 'query_sample', 'qid')}, qid limit 7"))
def e2_query_sample(spark, sf_dir):
    return exact.sample_queries(Fixture(spark, sf_dir).queries, 7, SEED).select("qid", "threshold")


#: Answers from the static partition, built anew for each epsilon of the grid.
_SWEEP_SQL = " union all ".join(
    f"select {e!r}::double as epsilon, qid, true_count, users, round_even(f_hat * users, 0)::bigint as est_count from ({sql('select qid, f_hat, true_count, users from answers_ join truth using (qid)', replace(CONFIG, epsilon=e))})"
    for e in EPSILON_GRID
)
#: An application's sweeps: five queries read them.
_swept: dict[tuple[str, str], DataFrame] = {}


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epsilon, qid, true_count, users, est_count: what depends on no epsilon is made once, and all of it once an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _swept:
        base = Fixture(spark, sf_dir, stored=True)
        truth = base.scratch.save(exact.overlap_counts(base.pairs, base.queries), "truth")
        fixtures = base.at_epsilons(EPSILON_GRID)

        def one(epsilon: float) -> DataFrame:
            f = fixtures[epsilon]
            got = answer.answers(f.build, f.queries).join(truth.select("qid", "true_count", "users"), "qid")
            return base.scratch.save(got.select("qid", "true_count", "users", exact.estimated_count(F.col("f_hat"), F.col("users")).alias("est_count")), "swept")

        _swept[key] = exact.sweep(EPSILON_GRID, one)
    return _swept[key]


@register(f"select qid, epsilon, est_count, true_count from ({_SWEEP_SQL})")
def e3_estimated_count(spark, sf_dir):
    return _sweep(spark, sf_dir).select("qid", "epsilon", "est_count", "true_count")


_MSE_SQL = "avg(((true_count - est_count) / users) * ((true_count - est_count) / users))"
_MRE_SUM_SQL = "sum(case when true_count > 0 then least(100, abs(est_count - true_count) / true_count) else 0 end)"


@register(f"select epsilon, {s6(_MSE_SQL)} as mse from ({_SWEEP_SQL}) group by epsilon")
def e4_mse(spark, sf_dir):
    return rounded(exact.metrics(_sweep(spark, sf_dir)), "mse").select("epsilon", "mse")


@register(f"select epsilon, {s6(_MRE_SUM_SQL + ' / count(*)')} as mre, {s6(_MRE_SUM_SQL + ' / greatest(1, count(*) filter (true_count > 0))')} as mre_positive from ({_SWEEP_SQL}) group by epsilon")
def e5_mre(spark, sf_dir):
    return rounded(exact.metrics(_sweep(spark, sf_dir)), "mre", "mre_positive").select("epsilon", "mre", "mre_positive")


@register(f"select epsilon, count(*) as answers, sum(est_count)::bigint as est_total, sum(true_count)::bigint as true_total from ({_SWEEP_SQL}) group by epsilon")
def e6_epsilon_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).groupBy("epsilon").agg(F.count("*").alias("answers"), F.sum("est_count").alias("est_total"), F.sum("true_count").alias("true_total"))


@register(f"select epsilon, {s6(_MSE_SQL)} as mse, {s6(_MRE_SUM_SQL + ' / count(*)')} as mre from ({_SWEEP_SQL}) group by epsilon")
def s4_metrics_sink(spark, sf_dir):
    """Written as Parquet and read back."""
    path = f"{Scratch(spark, 'metrics').root}/metrics"
    text.write_metrics(rounded(exact.metrics(_sweep(spark, sf_dir)), "mse", "mre").select("epsilon", "mse", "mre"), path)
    return spark.read.parquet(path)


@register()
def e7_experiment(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    _, metrics = evaluate.evaluate(f.pairs, f.items, f.queries, CONFIG, (5.0,))
    return metrics


# frequency oracle


@register(sql("select uid, value, y, bit from item_bits"))
def f1_oue_reports(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    under = f.pairs.join(f.cohort.where("role = 'underlying'").select("uid"), "uid", "left_semi")
    return oue.reports(oue.sample_item(under, SEED).withColumnRenamed("item", "value"), F.lit(25), CONFIG.report_epsilon, SEED, "item_bits", ["uid"])


@register(sql(f"select y, ones, n, {s6('est_count')} as est_count, {s6('est_count / n')} as est_freq from item_agg"))
def f2_oue_aggregate(spark, sf_dir):
    return rounded(oue.aggregate(f1_oue_reports(spark, sf_dir), CONFIG.report_epsilon, []), "est_count", "est_freq")


@register(sql(f"select i, j, {s6('f')} as est_freq from leaf_agg"))
def f3_oue_two_dimensions(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return rounded(oue.leaf_pair_estimates(f.pairs, f.cohort, f.leaves, CONFIG), "est_freq").select("i", "j", "est_freq")


@register(sql(f"select y, {s6('case when sum(greatest(est_count, 0)) over () > 0 then greatest(est_count, 0) * n / sum(greatest(est_count, 0)) over () else 0 end')} as clipped from item_agg"))
def f4_smoothing(spark, sf_dir):
    made = oue.aggregate(f1_oue_reports(spark, sf_dir), CONFIG.report_epsilon, [])
    return rounded(oue.smooth(made, "est_count", F.col("n"), [], "clip").select("y", F.col("est_count").alias("clipped")), "clipped")


@register(sql("select uid, item from item_sample"))
def f5_item_sample(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return oue.sample_item(f.pairs.join(f.cohort.where("role = 'underlying'").select("uid"), "uid", "left_semi"), SEED)


@register(sql(f"select item, {s6('noisy_count')} as noisy_count from hist"))
def f6_noisy_item_hist(spark, sf_dir):
    return rounded(Fixture(spark, sf_dir).hist.select("item", "noisy_count"), "noisy_count")


@register(sql("select node_id, uid, a, b from pair_sample"))
def f7_pair_sample(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return oue.sample_pair(oue.in_node(f.pairs, f.node_users, f.node_items), SEED, "pair_sample", ["node_id", "uid"], "local_id")


@register(sql("select node_id, a, b, y as pair_id from pair_names"))
def f8_pair_id(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    one, two = (f.node_items.select("node_id", F.col("local_id").alias(k)) for k in "ab")
    return one.join(two, "node_id").where("a < b").join(F.broadcast(f.sizes), "node_id").select("node_id", "a", "b", oue.pair_id(F.col("a"), F.col("b"), F.col("size")).alias("pair_id"))


@register(sql(f"select node_id, a, b, {s6('freq')} as freq from pair_freq"))
def f9_pair_frequency(spark, sf_dir):
    return rounded(Fixture(spark, sf_dir).pair_freq, "freq")


@register(sql(f"select node_i, node_j, {s6('freq')} as freq from cross_"))
def f10_cross_node_frequency(spark, sf_dir):
    return rounded(Fixture(spark, sf_dir).cross, "freq")


@register(sql(f"select node_id, k, {s6('freq')} as freq, n from oue_hist"))
def f11_intersection_hist(spark, sf_dir):
    return rounded(Fixture(spark, sf_dir).oue_hist, "freq")


@register()
def f2_oue_aggregate_simulated(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    under = f.pairs.join(f.cohort.where("role = 'underlying'").select("uid"), "uid", "left_semi")
    sampled = oue.sample_item(under, SEED)
    total = sampled.agg(F.count("*").alias("n"))
    counts = sampled.groupBy(F.col("item").alias("y")).agg(F.count("*").alias("t"))
    return oue.simulated_aggregate(counts.join(F.broadcast(total)), CONFIG.report_epsilon, SEED, "item_simulated", [])


def _customer_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Config]:
    """(items, pairs, config) of a domain of thousands of items, too many for single reports."""
    scratch = Scratch(spark, "parts")
    bought = tables.customer_parts(spark, sf_dir).distinct()
    items = scratch.save(tables.encode_items(bought), "items")
    pairs = bought.join(items, "raw_key").select("uid", "item")  # too many items to broadcast
    return items, scratch.save(pairs, "pairs"), replace(CONFIG, draws="aggregate")


_PARTS_SQL = f"""with bought as (select distinct o_custkey as uid, l_partkey from lineitem join orders on l_orderkey = o_orderkey),
  k as (select count(distinct l_partkey) as k, count(distinct uid) as u from bought),
  sized as (select i::int as node_id, case i when 0 then k when 1 then (k + 1) // 2 else k - (k + 1) // 2 end as size, (u - floor(u * {CONFIG.alpha}))::bigint // {CONFIG.blocks} as n from k, range(0, 3) t(i))
select node_id, 1 + size * (size - 1) // 2 as cells, n, 1e0 as whole from sized"""


@register(_PARTS_SQL)
def f9_pair_frequency_of_parts(spark, sf_dir):
    """Pair frequencies of all parts and of their halves: every cell is estimated, and a node's add up to 1.

    The cells are counted by their estimate, of the same draws that ``oue.pair_frequencies`` gives a row a cell.
    """
    items, pairs, config = _customer_parts(spark, sf_dir)
    domain = items.count()
    nodes, node_items = tree.static_tables(spark, tree.static_tree(domain, 2, domain), items)
    scratch = Scratch(spark, "parts")
    node_items = scratch.save(node_items, "node_items")
    users = scratch.save(oue.node_users(oue.cohorts(pairs.select("uid").distinct(), config.alpha, config.blocks, SEED), nodes), "users")
    _, freq = oue.pair_runs(pairs, users, node_items, minhash.node_sizes(node_items), config)
    counted = freq.groupBy("node_id").agg(F.sum("cells").alias("cells"), r6(F.sum(F.col("freq") * F.col("cells"))).alias("whole"))
    return counted.join(users.groupBy("node_id").agg(F.count("*").alias("n")), "node_id").select("node_id", "cells", "n", "whole")


# MinHash


@register(sql(f"select ell, item, row_number() over (partition by ell order by {digest_sql(SEED, 'perm', 'ell', 'item')}, item) - 1 as rank from items, ells"))
def h1_rank_table(spark, sf_dir):
    return minhash.rank_table(Fixture(spark, sf_dir).items, CONFIG.hashes, SEED)


@register(sql("select node_id, uid, ell, winner from winners"))
def h2_user_signatures(spark, sf_dir):
    return Fixture(spark, sf_dir).winners.drop("choice")


@register(sql(f"select node_id, ell, target, (('0x' || substr({digest_sql(SEED, 'out', 'ell', 'target')}, 1, 8))::bigint % 16) as bucket from node_sig"))
def h3_hashed_output(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    full = minhash.set_signatures(f.node_items, ["node_id"], CONFIG)
    return full.withColumn("bucket", minhash.hashed_output(SEED, "ell", "target", 16))


@register()
def h3_hashed_output_blake(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    full = minhash.set_signatures(f.node_items, ["node_id"], CONFIG)
    return minhash.hashed_output_blake(full.withColumnRenamed("target", "item"), SEED, 16)


@register(sql(f"select uid, ell, arg_min(item, {digest_sql(SEED, 'perm', 'ell', 'item')}) as winner from bi, ells group by uid, ell"))
def h4_batch_user_signatures(spark, sf_dir):
    return minhash.batch_signatures(Fixture(spark, sf_dir).pairs, ["uid"], CONFIG.hashes, SEED)


@register(sql(f"select qid, ell, arg_min(item, {digest_sql(SEED, 'perm', 'ell', 'item')}) as winner from qi, ells group by qid, ell"))
def h5_query_signatures(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    slots = minhash.signature_array(F.col("items"), CONFIG.hashes, SEED)
    return f.queries.select("qid", F.posexplode(slots).alias("ell", "winner"))


@register(sql("select node_id, uid, ell from chosen"))
def h7_hash_choice(spark, sf_dir):
    return minhash.chosen_hashes(Fixture(spark, sf_dir).second, CONFIG).drop("choice")


@register(sql(f"select node_id, uid, ell, target, ({uniform_sql(SEED, 'hash_bits', 'node_id', 'uid', 'ell', 'target')} < case when winner = target then 0.5 else {QH!r} end)::int as bit from winners join node_sig using (node_id, ell)"))
def h8_perturbed_reports(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    full = minhash.set_signatures(f.node_items, ["node_id"], CONFIG)
    return f.winners.join(full, ["node_id", "ell"]).withColumn("bit", minhash.report_bit(CONFIG, "target")).select("node_id", "uid", "ell", "target", "bit")


@register(sql(f"select node_id, uid, {s6('j')} as j, k from bins"))
def h9_debiased_jaccard(spark, sf_dir):
    return rounded(Fixture(spark, sf_dir).bins, "j")


@register(sql(f"select node_id, k, {s6('freq')} as freq, n from mh_hist"))
def h10_minhash_histogram(spark, sf_dir):
    return rounded(Fixture(spark, sf_dir).minhash_hist, "freq")


@register(sql("select node_id, item, position from prefix"))
def h11_prefix_order(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return minhash.prefix_order(f.node_items, f.hist)


@register(sql("select node_id, item, local_id from ni"))
def h12_local_domain(spark, sf_dir):
    return Fixture(spark, sf_dir).node_items


@register(sql("select distinct nu.node_id, uid, coalesce(ni.local_id, nodes.size) as local_id from bi join nu using (uid) join nodes on nodes.node_id = nu.node_id left join ni on ni.node_id = nu.node_id and ni.item = bi.item"))
def h13_localized_sets(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return minhash.localized(f.pairs, f.node_users, f.node_items, f.sizes)


@register(sql(f"select node_id, qid, {s6('avg(j)')} as mean_j from q_j group by node_id, qid"))
def h14_mean_jaccard(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    local = f.asked.join(F.broadcast(f.node_items), ["node_id", "item"])
    return rounded(minhash.mean_jaccard(f.winners, minhash.set_signatures(local, ["node_id", "qid"], CONFIG), CONFIG, ["node_id", "qid"]), "mean_j")


# tree


@register(sql("select uid from under"))
def t1_underlying_cohort(spark, sf_dir):
    return Fixture(spark, sf_dir).cohort.where("role = 'underlying'").select("uid")


@register(sql("select uid, block_id, pos, block_size from cohort where role = 'tree'"))
def t2_user_blocks(spark, sf_dir):
    return Fixture(spark, sf_dir).cohort.where("role = 'tree'").select("uid", "block_id", "pos", "block_size")


@register(sql("select node_id, count(*) as users, count(*) filter (pos <= round_even(block_size * 0.5, 0)) as direct from nu group by node_id"))
def t3_node_halves(spark, sf_dir):
    return Fixture(spark, sf_dir).node_users.groupBy("node_id").agg(F.count("*").alias("users"), F.count_if(F.col("pos") <= F.rint(F.col("block_size") * 0.5)).alias("direct"))


_ESTIMATES_SQL = f"""select node_id, 'pair' as part, coalesce(a, -1)::bigint as x, coalesce(b, -1)::bigint as y, {s6('freq')} as freq from pair_freq
  union all select node_id, 'direct', k, -1, {s6('freq')} from oue_hist union all select node_id, 'minhash', k, -1, {s6('freq')} from mh_hist"""


@register(sql(_ESTIMATES_SQL))
def t3_node_estimates(spark, sf_dir):
    """All that a node's users report: pairs from the whole block, sizes from one half, MinHash from the other."""
    f = Fixture(spark, sf_dir)
    made = tree.estimate_nodes(f.pairs, f.cohort, f.nodes, f.node_items, CONFIG)
    named = lambda df, part, x, y: df.select("node_id", F.lit(part).alias("part"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), r6(F.col("freq")).alias("freq"))
    pairs = named(made["pair_freq"], "pair", F.coalesce("a", F.lit(-1)), F.coalesce("b", F.lit(-1)))
    return pairs.unionByName(named(made["oue_hist"], "direct", F.col("k"), F.lit(-1))).unionByName(named(made["minhash_hist"], "minhash", F.col("k"), F.lit(-1)))


@register()
def t4_split_proposal(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    made = {"pair_freq": f.pair_freq, "sizes": f.sizes, "winners": f.winners, "minhash_hist": f.minhash_hist}
    return tree.proposals(made, f.node_items, f.probabilities, CONFIG)


@register(sql(f"select node_id, a, b, {s6('w')} as w from pmi"))
def t4a_pmi_weights(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return rounded(tree.pmi_weights(f.pair_freq, f.node_p), "w")


@register(sql(f"select node_id, local_id, {s6('s')} as s, row_number() over (partition by node_id order by round(s, 6) desc, local_id) = 1 as is_start from (select node_id, local_id, sum(w) as s from (select node_id, a as local_id, w from pmi union all select node_id, b, w from pmi) group by node_id, local_id)"))
def t4b_item_strength(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return rounded(tree.strengths(tree.pmi_weights(f.pair_freq, f.node_p)), "s")


_CHAIN_SQL = """select node_id, local_id, position from (
  with recursive known as (select node_id, a as x, b as y, round(w, 9) as w from pmi where a is not null union all select node_id, b, a, round(w, 9) from pmi where a is not null),
  strong as (select node_id, local_id, coalesce(sum(w), 0) as s from ni left join known using (node_id) where known.x is null or known.x = ni.local_id group by node_id, local_id),
  walk as (
    select node_id, 0 as position, first(local_id order by s desc, local_id) as local_id, [first(local_id order by s desc, local_id)] as seen from strong group by node_id
    union all
    select node_id, position + 1, best, list_append(seen, best) from (
      select k.node_id, k.position, k.seen,
        case when max(coalesce(e.w, 0)) > 0 then first(t.local_id order by coalesce(e.w, 0) desc, t.local_id) else first(t.local_id order by t.s desc, t.local_id) end as best
      from walk k join strong t on t.node_id = k.node_id and not list_contains(k.seen, t.local_id)
      left join known e on e.node_id = k.node_id and e.x = k.local_id and e.y = t.local_id group by k.node_id, k.position, k.seen)
  ) select node_id, local_id, position from walk)"""


@register(sql(_CHAIN_SQL))
def t4c_greedy_chain(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return tree.chains(tree.pmi_weights(f.pair_freq, f.node_p), f.sizes)


@register(sql("select node_id, b, side, ell, target from cut_sig"))
def t4d_cut_signatures(spark, sf_dir):
    return tree.cut_signatures(Fixture(spark, sf_dir).chain, CONFIG)


@register(sql(f"select node_id, b, side, {s6('p0')} as p0 from shares"))
def t4e_empty_share(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return rounded(tree.empty_shares(f.winners, tree.cut_signatures(f.chain, CONFIG), f.sizes, CONFIG), "p0")


_MI_TERM = "case when c{0} > 1e-12 and {1} > 1e-12 and {2} > 1e-12 then c{0} * ln(c{0} / ({1} * {2})) else 0 end"
_MI_SQL = f"""select node_id, b, p0a, p0b, p00, {_MI_TERM.format('00', 'p0a', 'p0b')} + {_MI_TERM.format('01', 'p0a', '(1 - p0b)')} + {_MI_TERM.format('10', '(1 - p0a)', 'p0b')} + {_MI_TERM.format('11', '(1 - p0a)', '(1 - p0b)')} as mi
  from (select *, p00 / (p00 + p01 + p10 + p11) as c00, p01 / (p00 + p01 + p10 + p11) as c01, p10 / (p00 + p01 + p10 + p11) as c10, p11 / (p00 + p01 + p10 + p11) as c11
  from (select *, greatest(0, 1 - p00 - p01 - p10) as p11 from (select *, greatest(0, p0a - p00) as p01, greatest(0, p0b - p00) as p10
  from (select node_id, b, p0a, p0b, coalesce((select freq from mh_hist h where h.node_id = s.node_id and k = 0), 0) as p00 from (select node_id, b, max(p0) filter (side = 'A') as p0a, max(p0) filter (side = 'B') as p0b from shares group by node_id, b) s))))"""


@register(sql(f"select node_id, b, {s6('mi')} as mi from ({_MI_SQL}) where p0a is not null and p0b is not null"))
def t4f_mutual_information(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    shares = tree.empty_shares(f.winners, tree.cut_signatures(f.chain, CONFIG), f.sizes, CONFIG)
    both = shares.groupBy("node_id", "b").agg(F.max(F.when(F.col("side") == "A", F.col("p0"))).alias("p0a"), F.max(F.when(F.col("side") == "B", F.col("p0"))).alias("p0b")).where("p0a is not null and p0b is not null")
    zero = f.minhash_hist.where("k = 0").select("node_id", F.col("freq").alias("p00"))
    mi = tree.mutual_information(F.col("p0a"), F.col("p0b"), F.coalesce("p00", F.lit(0.0)))
    return both.join(zero, "node_id", "left").select("node_id", "b", r6(mi).alias("mi"))


@register(sql(f"select node_id, arg_min(b, round(mi, 9) * 1e9 * 1000 + b) as b, {s6('min(mi)')} as mi from ({_MI_SQL}) join nodes using (node_id) where p0a is not null and p0b is not null and b >= {CONFIG.min_child} and b <= size - {CONFIG.min_child} group by node_id"))
def t4g_best_cut(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    shares = tree.empty_shares(f.winners, tree.cut_signatures(f.chain, CONFIG), f.sizes, CONFIG)
    return rounded(tree.cuts(shares, f.minhash_hist, f.sizes, CONFIG), "mi")


@register(sql(f"select node_id, item, case when rn <= {CONFIG.min_child} + floor({uniform_sql(SEED, 'random_cut', 'node_id')} * (size - {2 * CONFIG.min_child} + 1)) then 'A' else 'B' end as side from (select node_id, item, size, row_number() over (partition by node_id order by {digest_sql(SEED, 'random_split', 'node_id', 'item')}) as rn from ni) where size > {2 * CONFIG.min_child}"))
def t5_random_split(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return tree.random_cuts(f.node_items, f.sizes, CONFIG)


@register()
def t6_split_error(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    samples = tree.split_samples(f.node_items, f.sizes, CONFIG)
    return tree.split_errors(samples, tree.random_cuts(f.node_items, f.sizes, CONFIG), f.probabilities, answer.pair_items(f.build), 6, f.users.count(), CONFIG)


@register()
def t7_dynamic_growth(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return tree.grow(f.pairs, f.items, CONFIG).nodes


@register(sql("select node_id, parent_id, depth, block_id, size, is_leaf from nodes"))
def t8_static_tree(spark, sf_dir):
    return Fixture(spark, sf_dir).nodes


_ALLOCATION_SQL = """select node_id, allocated, left_over from (
  with recursive up as (select node_id as below, node_id from nodes union all select up.below, n.parent_id from up join nodes n using (node_id) where n.parent_id is not null),
  tall as (select up.node_id, max(b.depth) - any_value(n.depth) + 1 as height from up join nodes b on b.node_id = up.below join nodes n on n.node_id = up.node_id group by up.node_id),
  given as (
    select node_id, u // height as allocated, u - u // height as left_over from nodes join tall using (node_id), (select count(*) as u from users) where parent_id is null
    union all select n.node_id, g.left_over // t.height, g.left_over - g.left_over // t.height from given g join nodes n on n.parent_id = g.node_id join tall t on t.node_id = n.node_id
  ) select node_id, allocated::bigint as allocated, left_over::bigint as left_over from given)"""


@register(sql(_ALLOCATION_SQL))
def t9_uniform_allocation(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    rows = tree.uniform_allocation(tree.static_tree(25, 2, SMALLEST), f.users.count())
    return spark.createDataFrame([(n, a, b) for n, (a, b) in rows.items()], "node_id int, allocated bigint, left_over bigint")


@register(sql("select node_id, size, array_to_string(range(1, size, size // 2), ' ') as starts from nodes"))
def t15_node_guard(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return tree.guarded(f.nodes, 2).select("node_id", "size", F.array_join(F.col("starts").cast("array<string>"), " ").alias("starts"))


@register(sql("select node_id, depth, row_number() over (order by depth, node_id) as position from nodes"))
def t10_breadth_first(spark, sf_dir):
    return tree.breadth_first(Fixture(spark, sf_dir).nodes).select("node_id", "depth", "position")


@register(sql("select l.node_id, b.block_id from (select b::int as block_id, row_number() over (order by b) - 1 as n from range(0, 19) t(b) where b not in (select block_id from nodes)) b join (select node_id, row_number() over (order by node_id) - 1 as i, count(*) over () as leaves from nodes where is_leaf) l on l.i = b.n % l.leaves"))
def t11_spread_blocks(spark, sf_dir):
    return tree.spread_blocks(Fixture(spark, sf_dir).nodes, 19)


@register(sql(f"select node_id, k, {s6('sum(freq * n) / any_value(total)')} as freq, any_value(total)::bigint as n from (select node_id, k, freq, n from oue_hist union all select node_id, k, freq, n from mh_hist) join (select node_id, sum(n) as total from (select distinct node_id, 'o' as part, n from oue_hist union all select distinct node_id, 'm', n from mh_hist) group by node_id) using (node_id) group by node_id, k"))
def t12_merged_histograms(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    parts = f.oue_hist.withColumn("part", F.lit("o")).unionByName(f.minhash_hist.withColumn("part", F.lit("m")))
    return rounded(tree.merged_histograms(parts), "freq")


_LIFT_SQL = "select node_id, a, b, lift, row_number() over (partition by node_id order by round(lift, 6), a, b) as rank from (select pf.node_id, a, b, greatest(freq, 0) / greatest(x.p * y.p, 1e-12) as lift from pair_freq pf join np x on x.node_id = pf.node_id and x.local_id = a join np y on y.node_id = pf.node_id and y.local_id = b)"


@register(sql(f"select node_id, a, b, {s6('ln(1 + lift)')} as log_lift, rank from ({_LIFT_SQL})"))
def t13_pair_lifts(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return tree.pair_lifts(f.pair_freq, f.node_p, f.sizes).select("node_id", "a", "b", r6(F.log1p("lift")).alias("log_lift"), "rank")


@register(sql(f"select node_id, local_id, score, row_number() over (partition by node_id order by score desc, local_id) as position from (select node_id, local_id, sum(points)::bigint as score from (select node_id, unnest([a, b]) as local_id, count(*) over (partition by node_id) - (rank - 1) as points from ({_LIFT_SQL})) group by node_id, local_id)"))
def t14_lift_order(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return tree.order_from_lifts(tree.pair_lifts(f.pair_freq, f.node_p, f.sizes))


@register("select * from (values (0.1e0, 1), (0.5e0, 1), (1e0, 1), (2e0, 1), (3e0, 2), (4e0, 2), (5e0, 3), (6e0, 3), (7e0, 4), (8e0, 4)) t(epsilon, hash_choices)")
def t16_hash_choices(spark, sf_dir):
    return spark.createDataFrame([(e, Config(epsilon=e).hash_choices) for e in EPSILON_GRID], "epsilon double, hash_choices int")


# tails


def _grid(spark: SparkSession, values: Column) -> DataFrame:
    return spark.range(1).select(F.explode(values).alias("i"))


@register(f"select i, {s6(ccdf_sql('z'))} as tail from (select i::int as i, i / 10e0 as z from range(-60, 61) t(i))")
def g0_normal_tail(spark, sf_dir):
    return _grid(spark, F.sequence(F.lit(-60), F.lit(60))).select("i", r6(mathx.ccdf(F.col("i") / 10.0)).alias("tail"))


#: mu and var of each query in its node.
_PAIR_TAIL_ROWS = """
  select m.*, greatest(1e-9, v + 2 * coalesce(cov, 0)) as var from (
    select node_id, qid, threshold, sum(p) as mu, sum(p * (1 - p)) as v from (select a.*, coalesce(p, 0) as p from asked_ a left join p using (item)) group by all
  ) m left join (
    select x.node_id, x.qid, sum(g.freq - coalesce(px.p, 0) * coalesce(py.p, 0)) as cov
    from asked_ x join asked_ y on x.node_id = y.node_id and x.qid = y.qid and x.role = y.role and x.item < y.item
    join pair_freq g on g.node_id = x.node_id and g.item_a = x.item and g.item_b = y.item
    left join p px on px.item = x.item left join p py on py.item = y.item group by x.node_id, x.qid
  ) c using (node_id, qid)"""
_PAIR_TAIL_SQL = (
    f"select node_id, qid, threshold, {s6('mu')} as mu, {s6('var')} as var, {s6(ccdf_sql('z'))} as tail "
    f"from (select *, (threshold - 0.5 - mu) / sqrt(var) as z from ({_PAIR_TAIL_ROWS}))"
)


@register(sql(_PAIR_TAIL_SQL))
def g1_pair_tail(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    pairs = answer.pair_items(f.build).join(f.asked.select("node_id", "qid").distinct(), "node_id")
    return rounded(tails.pair_tail(f.asked.drop("role"), f.probabilities, pairs, ["node_id", "qid"]), "mu", "var", "tail")


@register(f"select i, t, {s6('case when t <= 0 then 1 when var <= 1e-12 then (mu >= t - 0.5)::int else ' + ccdf_sql('z') + ' end')} as tail from (select *, (t - 0.5 - mu) / sqrt(greatest(var, 1e-12)) as z from (select i::int as i, t::int as t, i / 4e0 as mu, (i % 3) * 0.3e0 as var from range(0, 20) a(i), range(-1, 5) b(t)))")
def g2_gaussian_tail(spark, sf_dir):
    rows = _grid(spark, F.sequence(F.lit(0), F.lit(19))).withColumn("t", F.explode(F.sequence(F.lit(-1), F.lit(4))))
    return rows.select("i", "t", r6(mathx.gaussian_tail(F.col("i") / 4.0, (F.col("i") % 3) * F.lit(0.3), F.col("t"))).alias("tail"))


@register(f"select i, g, {s6(f'(1 - 1e0 / g) * p * (1 - p) * g / 1000e0 + g / 1000e0 * (p * 0.25 + (1 - p) * {QH!r} * (1 - {QH!r})) / ((0.5 - {QH!r}) * (0.5 - {QH!r}))')} as mse from (select i::int as i, g::int as g, i / 10e0 as p from range(0, 11) a(i), range(1, 8) b(g))")
def g3_sampling_mse(spark, sf_dir):
    rows = _grid(spark, F.sequence(F.lit(0), F.lit(10))).withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return rows.select("i", "g", r6(tails.sampling_mse(F.col("i") / 10.0, F.col("g"), F.lit(1000.0), CONFIG.hash_epsilon)).alias("mse"))


_PLAIN_TAIL_SQL = "select *, (threshold - 0.5 - mu) / sqrt(var) as z from (select node_id, qid, threshold, sum(coalesce(p, 0)) as mu, greatest(1e-9, sum(coalesce(p, 0) * (1 - coalesce(p, 0)))) as var from asked_ left join p using (item) group by node_id, qid, threshold)"


@register(sql(f"select node_id, qid, {s6('t * t')} as error from (select *, {ccdf_sql('z')} as t from ({_PLAIN_TAIL_SQL}))"))
def g4_reconstruction_error(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    plain = tails.independent_tail(f.asked.drop("role"), f.probabilities, ["node_id", "qid"])
    return plain.select("node_id", "qid", r6(tails.reconstruction_error(F.col("tail"))).alias("error"))


_MIXED_ERROR_SQL = f"""select node_id, qid, {s6("case when r = 0 then 0 when r < threshold then t * t else coalesce(var, 0) end")} as error
  from (select node_id, qid, threshold, {ccdf_sql("z")} as t from (select *, (threshold - 0.5 - mu) / sqrt(var) as z from ({_PAIR_TAIL_ROWS})))
  join (select node_id, qid, count(*) as r from asked_ group by node_id, qid) using (node_id, qid) left join (select node_id, qid, var from mix_mh) using (node_id, qid)"""


@register(sql(_MIXED_ERROR_SQL))
def g5_reconstruction_error_mixed(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    asked = f.asked.drop("role")
    pairs = answer.pair_items(f.build).join(asked.select("node_id", "qid").distinct(), "node_id")
    tail = tails.pair_tail(asked, f.probabilities, pairs, ["node_id", "qid"])
    mixture = tails.mixed(f.minhash_hist, f.alpha).select("node_id", "qid", "var")
    counted = asked.groupBy("node_id", "qid").agg(F.count("*").alias("r"))
    rows = tail.drop("var").join(mixture, ["node_id", "qid"], "left").join(counted, ["node_id", "qid"])
    error = tails.reconstruction_error_mixed(F.col("r"), F.col("threshold"), F.col("tail"), F.coalesce("var", F.lit(0.0)))
    return rows.select("node_id", "qid", r6(error).alias("error"))


@register(sql(f"select node_id, qid, k, {s6('alpha')} as alpha from alpha"))
def g6_minhash_alpha(spark, sf_dir):
    return rounded(Fixture(spark, sf_dir).alpha, "alpha")


_SHARE_SQL = "select t.node_id, t.qid, case when mass > 0 then greatest(0, least(1, mu / mass)) else 0 end as w, least(0.2, 0.5 * greatest(0, var / plain - 1)) as rho from (select m.*, greatest(1e-9, v) as plain, greatest(1e-9, v + 2 * coalesce(cov, 0)) as var from (select node_id, qid, sum(coalesce(p, 0)) as mu, sum(coalesce(p, 0) * (1 - coalesce(p, 0))) as v from asked_ left join p using (item) group by node_id, qid) m left join (select x.node_id, x.qid, sum(g.freq - coalesce(px.p, 0) * coalesce(py.p, 0)) as cov from asked_ x join asked_ y on x.node_id = y.node_id and x.qid = y.qid and x.role = y.role and x.item < y.item join pair_freq g on g.node_id = x.node_id and g.item_a = x.item and g.item_b = y.item left join p px on px.item = x.item left join p py on py.item = y.item group by x.node_id, x.qid) c using (node_id, qid)) t join (select node_id, sum(p) as mass from np group by node_id) using (node_id)"


def _share(f: Fixture) -> DataFrame:
    pairs = answer.pair_items(f.build).join(f.asked.select("node_id", "qid").distinct(), "node_id")
    return tails.query_share(f.asked.select("node_id", "qid", "item"), f.node_items, f.probabilities, pairs)


_GAUSS_SQL = f"select node_id, qid, k, case when threshold <= 0 then 1 when k < threshold or w <= 0 then 0 when w >= 1 then 1 when v <= 1e-12 then (k * w >= threshold - 0.5)::int else {ccdf_sql('z')} end as a from (select *, (threshold - 0.5 - k * w) / sqrt(greatest(v, 1e-12)) as z from (select *, k * w * (1 - w) * greatest(1 + (k - 1) * rho, 1e-9) as v from (select s.node_id, s.qid, threshold, w, rho, unnest(range(0, size + 1))::int as k from ({_SHARE_SQL}) s join asked_c using (node_id, qid) join nodes using (node_id))))"


def _gauss(f: Fixture) -> DataFrame:
    counted = f.asked.select("node_id", "qid", "threshold").distinct()
    grid = counted.join(_share(f), ["node_id", "qid"]).join(F.broadcast(f.sizes), "node_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("size"))))
    return grid.select("node_id", "qid", "k", tails.alpha_gauss(F.col("k"), F.col("w"), F.col("rho"), F.col("threshold")).alias("a"))


@register(sql(f"select node_id, qid, k, {s6('a')} as alpha from ({_GAUSS_SQL})"))
def g7_gaussian_alpha(spark, sf_dir):
    return _gauss(Fixture(spark, sf_dir)).select("node_id", "qid", "k", r6(F.col("a")).alias("alpha"))


@register(sql(f"select node_id, qid, {s6('a')} as alpha from ({_GAUSS_SQL}) where k = 3"))
def g8_gaussian_alpha_given_k(spark, sf_dir):
    return _gauss(Fixture(spark, sf_dir)).where("k = 3").select("node_id", "qid", r6(F.col("a")).alias("alpha"))


@register(sql(f"select node_id, qid, {s6('w')} as w, {s6('rho')} as rho from ({_SHARE_SQL})"))
def g9_query_share(spark, sf_dir):
    return rounded(_share(Fixture(spark, sf_dir)), "w", "rho")


@register(sql(f"select g.node_id, g.qid, g.k, {s6('0.75 * a + 0.25 * coalesce(alpha, 0)')} as alpha from ({_GAUSS_SQL}) g left join alpha using (node_id, qid, k)"))
def g10_blended_alpha(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    both = _gauss(f).join(f.alpha, ["node_id", "qid", "k"], "left")
    return both.select("node_id", "qid", "k", r6(tails.blended_alpha(F.col("a"), F.coalesce("alpha", F.lit(0.0)), 0.25)).alias("alpha"))


@register(sql(f"select node_id, qid, {s6('f')} as f from mix_mh"))
def g11_histogram_mix(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return rounded(tails.mixed(f.minhash_hist, f.alpha), "f").select("node_id", "qid", "f")


@register(sql("select node_id, qid, round(var, 9) + 0e0 as var from mix_mh"))
def g12_mix_variance(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    return tails.mixed(f.minhash_hist, f.alpha).select("node_id", "qid", (F.round("var", 9) + F.lit(0.0)).alias("var"))


@register(sql("select node_id, n, round(v, 9) + 0e0 as var from n_oue"))
def g13_oue_variance(spark, sf_dir):
    counted = Fixture(spark, sf_dir).oue_hist.groupBy("node_id").agg(F.max("n").alias("n"))
    return counted.select("node_id", "n", (F.round(tails.oue_variance(F.col("n"), CONFIG.report_epsilon), 9) + F.lit(0.0)).alias("var"))


_HYPER_SQL = "select a.node_id, a.qid, coalesce(sum(freq * exp(lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(size - r + 1) - lgamma(k - x + 1) - lgamma(size - r - k + x + 1) - lgamma(size + 1) + lgamma(k + 1) + lgamma(size - k + 1))), 0) as f from (select node_id, qid, threshold, c as r, size from asked_c join nodes using (node_id)) a left join (select node_id, k, freq, x from oue_hist, unnest(range(0, k + 1)) t(x)) h on h.node_id = a.node_id and h.x >= a.threshold and h.x <= a.r and h.k - h.x <= a.size - a.r group by a.node_id, a.qid"


@register(sql(f"select node_id, qid, {s6('f')} as f from ({_HYPER_SQL})"))
def g14_hypergeometric_threshold(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    asked = f.asked.groupBy("node_id", "qid", "threshold").agg(F.count("*").cast("int").alias("r"))
    return rounded(tails.partial_threshold(f.oue_hist, f.sizes, asked, 25), "f")


@register(sql(f"select node_id, threshold, {s6('sum(case when k >= threshold then freq else 0 end)')} as f from oue_hist, (select t::int as threshold from range(0, 5) x(t)) group by node_id, threshold"))
def g15_upper_tail(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    thresholds = f.sizes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("threshold"))
    return rounded(tails.upper_tail(f.oue_hist, thresholds), "f")


@register(sql(_PAIR_TAIL_SQL.replace("select node_id, qid, threshold,", "select node_id, qid, threshold as least_held,", 1)))
def g16_partial_tail(spark, sf_dir):
    return g1_pair_tail(spark, sf_dir).withColumnRenamed("threshold", "least_held")


# answers


@register(sql("select qid, node_id, role from selected"))
def q1_node_selection(spark, sf_dir):
    return Fixture(spark, sf_dir).selected


@register(sql("select qid, node_id, case when r < threshold then -1 when r = asked and r = size then 0 when r = asked then 2 else 1 end as class from qn"))
def q2_intersection_class(spark, sf_dir):
    f = Fixture(spark, sf_dir)
    shared = answer.query_nodes(f.queries, f.node_items, f.nodes)
    return shared.select("qid", "node_id", answer.classify(F.col("r"), F.col("asked"), F.col("size"), F.col("threshold")).alias("class"))


@register(sql(f"select node_id, qid, {s6('f')} as f, round(var, 9) + 0e0 as var from full_"))
def q3_full_component(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    return rounded(answer.full_component(f.build, f.full_asked, f.alpha), "f").withColumn("var", F.round("var", 9) + F.lit(0.0))


@register(sql(f"select node_id, qid, k, {s6('freq')} as freq, n from hybrid"))
def q4_hybrid_histogram(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    return rounded(answer.hybrid_histogram(f.build, f.partial_asked, f.alpha), "freq")


@register(sql(f"select qid, {s6('f')} as f, round(var, 9) + 0e0 as var from partial_"))
def q5_partial_component(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    return rounded(answer.partial_component(f.build, f.partial_asked, f.alpha), "f").withColumn("var", F.round("var", 9) + F.lit(0.0))


@register(sql("select qid, node_u, node_v, item_a, item_b, round(freq, 9) + 0e0 as freq from crossed"))
def q6_cross_pairs(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    made = answer.cross_pairs(f.partial_asked, f.cross, f.probabilities)
    return made.select("qid", "node_u", "node_v", "item_a", "item_b", (F.round("freq", 9) + F.lit(0.0)).alias("freq"))


@register(sql("select qid, item_a, item_b, round(freq, 9) + 0e0 as freq from global_"))
def q7_global_pairs(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    made = answer.global_pairs(answer.asked_pairs(f.partial_asked, f.build), answer.cross_pairs(f.partial_asked, f.cross, f.probabilities))
    return made.withColumn("freq", F.round("freq", 9) + F.lit(0.0))


@register(sql(f"select qid, {s6('f_full')} as f_full, {s6('f_partial')} as f_partial, {s6('f_hat')} as f_hat from answers_"))
def q8_private_answers(spark, sf_dir):
    f = Fixture(spark, sf_dir, stored=True)
    return rounded(answer.answers(f.build, f.queries), "f_full", "f_partial", "f_hat").select("qid", "f_full", "f_partial", "f_hat")

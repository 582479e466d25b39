"""Tail probabilities and variances as column expressions over per-(node, query) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEEP_RATE, Config, flip_rate
from ..functions.mathx import ccdf, clip01, gaussian_tail, log_choose, log_factorial_array
from .minhash import similarities


def item_probabilities(hist: DataFrame, underlying: Column | None = None) -> DataFrame:
    """item, p = clip(noisy_count / max(1, underlying users))."""
    n = F.greatest(F.lit(1), underlying if underlying is not None else F.col("n"))
    return hist.select("item", clip01(F.col("noisy_count") / n).alias("p"))


def pair_tail(asked: DataFrame, probabilities: DataFrame, pair_freq: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, mu, var, tail: Gaussian tail of the number of held items, with pair covariances.

    ``asked``: *keys, threshold, item; ``pair_freq``: *keys, item_a < item_b, freq (missing pairs add
    nothing). Items without an estimate have probability 0. Variance at least 1e-9; thresholds up to 0 give 1.
    """
    known = asked.join(F.broadcast(probabilities), "item", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    single = known.groupBy(*keys, "threshold").agg(F.sum("p").alias("mu"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))
    one, two = (known.select(*keys, F.col("item").alias(f"item_{k}"), F.col("p").alias(f"p_{k}")) for k in "ab")
    both = one.join(two, keys).where("item_a < item_b").join(pair_freq, [*keys, "item_a", "item_b"])
    covariance = both.groupBy(*keys).agg(F.sum(F.col("freq") - F.col("p_a") * F.col("p_b")).alias("cov"))
    out = single.join(covariance, keys, "left").withColumn("var", F.greatest(F.lit(1e-9), F.col("v") + 2 * F.coalesce("cov", F.lit(0.0))))
    tail = F.when(F.col("threshold") <= 0, F.lit(1.0)).otherwise(ccdf((F.col("threshold") - F.lit(0.5) - F.col("mu")) / F.sqrt("var")))
    return out.select(*keys, "threshold", "mu", "var", tail.alias("tail"))


def independent_tail(asked: DataFrame, probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """The same without pairs."""
    known = asked.join(F.broadcast(probabilities), "item", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    out = known.groupBy(*keys, "threshold").agg(F.sum("p").alias("mu"), F.greatest(F.lit(1e-9), F.sum(F.col("p") * (1 - F.col("p")))).alias("var"))
    tail = F.when(F.col("threshold") <= 0, F.lit(1.0)).otherwise(ccdf((F.col("threshold") - F.lit(0.5) - F.col("mu")) / F.sqrt("var")))
    return out.select(*keys, "threshold", "mu", "var", tail.alias("tail"))


def sampling_mse(p: Column, groups: Column, users: Column, hash_epsilon: float) -> Column:
    """Noise and sampling error of a frequency ``p`` when ``users`` are shared by ``groups`` nodes."""
    q = flip_rate(hash_epsilon)
    share = groups / users
    noise = (p * 0.25 + (1 - p) * q * (1 - q)) / (KEEP_RATE - q) ** 2
    return (F.lit(1.0) - F.lit(1.0) / groups) * p * (1 - p) * share + share * noise


def reconstruction_error(tail: Column) -> Column:
    """Squared independent tail: what a node that can't see the query's structure may miss."""
    return F.pow(tail, 2)


def reconstruction_error_mixed(asked: Column, threshold: Column, tail: Column, mixture_variance: Column) -> Column:
    """Older form: nothing asked costs nothing; too few items give the squared pair tail; otherwise the variance of
    the histogram mixture counts."""
    return F.when(asked == 0, F.lit(0.0)).when(asked < threshold, F.pow(tail, 2)).otherwise(mixture_variance)


def query_share(asked: DataFrame, node_items: DataFrame, probabilities: DataFrame, pair_freq: DataFrame) -> DataFrame:
    """node_id, qid, w, rho: the query's share of its node's item mass, and over-dispersion min(0.2, excess / 2),
    the excess being the pair covariances over the independent variance."""
    mass = node_items.join(F.broadcast(probabilities), "item", "left").groupBy("node_id").agg(F.sum(F.coalesce("p", F.lit(0.0))).alias("mass"))
    tail = pair_tail(asked.withColumn("threshold", F.lit(1)), probabilities, pair_freq, ["node_id", "qid"])
    plain = independent_tail(asked.withColumn("threshold", F.lit(1)), probabilities, ["node_id", "qid"]).select("node_id", "qid", F.col("var").alias("plain"))
    both = tail.join(plain, ["node_id", "qid"]).join(F.broadcast(mass), "node_id")
    excess = F.greatest(F.lit(0.0), F.col("var") / F.col("plain") - 1)
    return both.select("node_id", "qid", F.when(F.col("mass") > 0, clip01(F.col("mu") / F.col("mass"))).otherwise(F.lit(0.0)).alias("w"), F.least(F.lit(0.2), 0.5 * excess).alias("rho"))


def alpha_gauss(k: Column, w: Column, rho: Column, threshold: Column) -> Column:
    """P(at least ``threshold`` of the query's items | ``k`` of the node's) as a Gaussian tail of k draws of share w,
    over-dispersed by rho."""
    variance = k * w * (1 - w) * F.greatest(1 + (k - 1) * rho, F.lit(1e-9))
    sure = F.when(threshold <= 0, F.lit(1.0)).when((k < threshold) | (w <= 0), F.lit(0.0)).when(w >= 1, F.lit(1.0))
    return sure.otherwise(gaussian_tail(k * w, variance, threshold))


def alpha_minhash(winners: DataFrame, bins: DataFrame, targets: DataFrame, asked: DataFrame, config: Config) -> DataFrame:
    """node_id, qid, k, alpha: share of the users in bin k whose report looks like a hit.

    ``targets``: node_id, qid, ell, target (query signatures); ``asked``: node_id, qid, threshold, c (query items).
    Similarity j gives x = j (k + c) / (1 + j), at most min(k, c); a hit has x >= threshold. Bins below the
    threshold and bins without users are left out: their alpha is 0.
    """
    near = similarities(winners, targets, config, ["node_id", "qid"])
    at = near.join(bins.select("node_id", "uid", "k"), ["node_id", "uid"]).join(F.broadcast(asked), ["node_id", "qid"])
    x = F.when(F.col("j") <= 0, F.lit(0.0)).otherwise(F.col("j") * (F.col("k") + F.col("c")) / (1 + F.col("j")))
    hit = F.least(F.greatest(x, F.lit(0.0)), F.least("k", "c").cast("double")) >= F.col("threshold")
    return at.where(F.col("k") >= F.col("threshold")).groupBy("node_id", "qid", "k").agg(F.avg(hit.cast("double")).alias("alpha"))


def blended_alpha(gauss: Column, minhash: Column, eta: float) -> Column:
    return (1 - eta) * gauss + eta * minhash


def mixed(hist: DataFrame, alpha: DataFrame) -> DataFrame:
    """node_id, qid, f = clip(sum of freq x alpha), var = max(0, (sum freq alpha^2 - f^2) / n).

    ``hist``: node_id (and qid, if it depends on the query), k, freq, n.
    """
    keys = ["node_id", "qid", "k"] if "qid" in hist.columns else ["node_id", "k"]
    joined = alpha.join(hist, keys)
    out = joined.groupBy("node_id", "qid").agg(F.sum(F.col("freq") * F.col("alpha")).alias("s"), F.sum(F.col("freq") * F.col("alpha") * F.col("alpha")).alias("s2"), F.max("n").alias("n"))
    return out.select("node_id", "qid", clip01(F.col("s")).alias("f"), F.greatest(F.lit(0.0), (F.col("s2") - clip01(F.col("s")) * clip01(F.col("s"))) / F.col("n")).alias("var"))


def oue_variance(n: Column, epsilon: float) -> Column:
    """Variance of an OUE frequency over ``n`` users; infinite without users."""
    import math

    e = math.exp(epsilon)
    return F.when(n > 0, F.lit(4 * e / (e - 1) ** 2) / n).otherwise(F.lit(float("inf")))


def partial_threshold(hist: DataFrame, sizes: DataFrame, asked: DataFrame, largest: int) -> DataFrame:
    """node_id, qid, f: hypergeometric P(at least t of the query's r items | k of the node's K), mixed over the histogram.

    ``asked``: node_id, qid, threshold, r. ``largest``: the largest K.
    """
    table = log_factorial_array(largest)
    rows = hist.join(F.broadcast(sizes), "node_id").join(F.broadcast(asked), "node_id").where((F.col("freq") != 0) & (F.least("k", "r") >= F.col("threshold")))
    x = rows.withColumn("lf", table).withColumn("x", F.explode(F.sequence(F.greatest(F.col("threshold"), F.lit(0)), F.least("k", "r").cast("int"))))
    ways = log_choose(F.col("r"), F.col("x"), F.col("lf")) + log_choose(F.col("size") - F.col("r"), F.col("k") - F.col("x"), F.col("lf")) - log_choose(F.col("size"), F.col("k"), F.col("lf"))
    hits = x.groupBy("node_id", "qid").agg(F.sum(F.col("freq") * F.coalesce(F.exp(ways), F.lit(0.0))).alias("f"))
    return asked.select("node_id", "qid").join(hits, ["node_id", "qid"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))


def upper_tail(hist: DataFrame, thresholds: DataFrame) -> DataFrame:
    """node_id, threshold, f: histogram mass from the threshold up. ``thresholds``: node_id, threshold."""
    return thresholds.join(hist, "node_id").groupBy("node_id", "threshold").agg(F.sum(F.when(F.col("k") >= F.col("threshold"), F.col("freq")).otherwise(F.lit(0.0))).alias("f"))


def normalised(hist: DataFrame, by: list[str]) -> DataFrame:
    whole = F.sum("freq").over(Window.partitionBy(*by))
    return hist.withColumn("freq", F.when(whole > 0, F.col("freq") / whole).otherwise(F.lit(0.0)))

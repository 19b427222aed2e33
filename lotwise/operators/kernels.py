"""Rank and scalar statistics as DataFrame to DataFrame functions, each over any list of keys.

Scores are first gathered by value, so that ties cost nothing and rows shrink before they move; running sums are in two
levels (see running), so that a key with very many units spreads over tasks. A weight is a multiplicity: bootstraps
need no repeated rows.
"""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.running import running, value_buckets


def by_value(df: DataFrame, keys: list[str], score: str, y: str, weight: str | None = None) -> DataFrame:
    """(keys, v, p, n): positives and negatives at each value, NULL scores left out."""
    w = F.col(weight) if weight else F.lit(1)
    return df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("v")).agg(F.sum(F.col(y) * w).cast("bigint").alias("p"), F.sum((1 - F.col(y)) * w).cast("bigint").alias("n"))


def cumulated(df: DataFrame, keys: list[str], score: str, y: str, weight: str | None = None) -> DataFrame:
    """by_value with the running sums cp and cn up to each value, itself included."""
    return running(by_value(df, keys, score, y, weight), keys, value_buckets(F.col("v")), ["v"], {"cp": F.col("p"), "cn": F.col("n")})


def roc_auc(df: DataFrame, keys: list[str], score: str = "value", y: str = "y", weight: str | None = None, one_class: float | None = 0.5) -> DataFrame:
    """(keys, n1, n0, auc): the share of pairs in order, ties a half; one_class where a class is missing."""
    c = cumulated(df, keys, score, y, weight)
    won = F.sum(F.col("p") * (F.lit(2) * F.col("cn") - F.col("n")))
    out = c.groupBy(*keys).agg(F.sum("p").alias("n1"), F.sum("n").alias("n0"), won.alias("_won"))
    auc = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("_won").cast("double") / (F.lit(2.0) * F.col("n1") * F.col("n0"))).otherwise(F.lit(one_class).cast("double"))
    return out.withColumn("auc", auc).drop("_won")


def hanley_error(auc: Column, n1: Column, n0: Column) -> Column:
    """Standard error of an AUC after Hanley and McNeil; the variance is at least 1e-12."""
    q1, q2 = auc / (F.lit(2.0) - auc), F.lit(2.0) * auc * auc / (F.lit(1.0) + auc)
    var = (auc * (F.lit(1.0) - auc) + (n1 - 1) * (q1 - auc * auc) + (n0 - 1) * (q2 - auc * auc)) / (n1 * n0)
    return F.sqrt(F.greatest(var, F.lit(1e-12)))


def auc_with_error(df: DataFrame, keys: list[str], **how) -> DataFrame:
    """roc_auc with its standard error se; both NULL where a class is missing."""
    out = roc_auc(df, keys, one_class=None, **how)
    return out.withColumn("se", F.when(F.col("auc").isNotNull(), hanley_error(F.col("auc"), F.col("n1"), F.col("n0"))))


def average_precision(df: DataFrame, keys: list[str], score: str = "value", y: str = "y") -> DataFrame:
    """(keys, ap): sum of recall steps times precision over the distinct scores, from the highest; not interpolated."""
    c = cumulated(df, keys, score, y)
    all_ = c.groupBy(*keys).agg(F.sum("p").alias("n1"), F.sum("n").alias("n0"))
    j = c.join(all_, keys) if keys else c.crossJoin(all_)
    tp, fp = F.col("n1") - F.col("cp") + F.col("p"), F.col("n0") - F.col("cn") + F.col("n")
    return j.groupBy(*keys).agg(F.sum(F.when(F.col("n1") > 0, F.col("p") / F.col("n1") * tp / (tp + fp))).alias("ap"))


def cochran_q(effects: DataFrame, keys: list[str], a: str = "auc", s: str = "se") -> DataFrame:
    """(keys, k, mean, q, df, i2) of effects with standard errors; NULL where fewer than two blocks have one."""
    w = F.when(F.col(a).isNotNull() & F.col(s).isNotNull(), F.lit(1.0) / (F.col(s) * F.col(s)))
    sums = effects.groupBy(*keys).agg(F.count(w).alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col(a)).alias("swa"))
    j = effects.join(sums, keys).withColumn("_m", F.col("swa") / F.col("sw"))
    q = j.groupBy(*keys, "k").agg(F.first("_m").alias("mean"), F.sum(w * (F.col(a) - F.col("_m")) * (F.col(a) - F.col("_m"))).alias("q"))
    enough = F.col("k") >= 2
    q = q.withColumn("df", F.when(enough, F.col("k") - 1)).withColumn("mean", F.when(enough, F.col("mean"))).withColumn("q", F.when(enough, F.col("q")))
    return q.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).when(F.col("q").isNotNull(), 0.0))


def bh_adjust(df: DataFrame, keys: list[str], p: str = "p", tie: str = "sensor_id") -> DataFrame:
    """df with p_adj, Benjamini and Hochberg's adjusted p; a missing p counts as 1 and isn't in the family."""
    own = Window.partitionBy(*keys)
    there = F.col(p).isNotNull() & ~F.isnan(p)
    m, r = F.count(F.when(there, 1)).over(own), F.row_number().over(own.orderBy(F.when(there, F.col(p)).asc_nulls_last(), tie))
    raw = df.withColumn("_raw", F.when(there, F.col(p) * m / r))
    back = own.orderBy(F.when(there, F.col(p)).desc_nulls_first(), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("p_adj", F.when(there, F.least(F.min("_raw").over(back), F.lit(1.0))).otherwise(1.0)).drop("_raw")


def bh_reject(df: DataFrame, keys: list[str], alpha: float, p: str = "p", tie: str = "sensor_id") -> DataFrame:
    """(keys, m, n_reject, cutoff) of the step-up rule; a missing p counts as 1 and is in the family."""
    own = Window.partitionBy(*keys)
    q = df.withColumn("_p", F.coalesce(F.when(~F.isnan(p), F.col(p)), F.lit(1.0)))
    q = q.withColumn("_r", F.row_number().over(own.orderBy("_p", tie))).withColumn("_m", F.count("*").over(own))
    q = q.withColumn("_ok", F.col("_p") <= F.lit(alpha) * F.col("_r") / F.col("_m"))
    return q.groupBy(*keys).agg(F.max("_m").alias("m"), F.coalesce(F.max(F.when(F.col("_ok"), F.col("_r"))), F.lit(0)).cast("bigint").alias("n_reject"), F.max(F.when(F.col("_ok"), F.col("_p"))).alias("cutoff"))


def ks_two_sample(df: DataFrame, keys: list[str], group: str, value: str = "value", least: int = 10) -> DataFrame:
    """(keys, n_a, n_b, ks, p): rows with group 1 against those with 0; with fewer than ``least`` on a side NULL and 1.

    p is Kolmogorov's asymptotic series at sqrt(n_a n_b / (n_a + n_b)) times the statistic.
    """
    c = cumulated(df.withColumn("_g", F.col(group).cast("int")), keys, value, "_g")
    sizes = c.groupBy(*keys).agg(F.sum("p").alias("n_a"), F.sum("n").alias("n_b"))
    gap = F.max(F.abs(F.col("cp") / F.col("n_a") - F.col("cn") / F.col("n_b")))
    both = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    out = c.join(sizes, keys).filter((F.col("n_a") > 0) & (F.col("n_b") > 0)).groupBy(*keys).agg(gap.alias("_d"))
    out = sizes.join(out, keys, "left").withColumn("ks", F.when(both, F.col("_d"))).drop("_d")
    return out.withColumn("p", F.coalesce(kolmogorov(F.col("ks") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))), F.lit(1.0)))


def kolmogorov(t: Column) -> Column:
    """P(K > t): the alternating series, and 1 where t is too small for it."""
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + sign(k) * F.exp(F.lit(-2.0) * k * k * t * t))
    return F.when(t.isNull(), None).when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) * series)))


def chi2_tail(x: Column, df: int) -> Column:
    """P(X > x), in closed form; for an odd number of degrees of freedom with the tail of the normal distribution."""
    if df <= 0:
        raise ValueError(f"{df} degrees of freedom")
    if df % 2:
        term, total = F.sqrt(x / F.lit(2.0)) / F.lit(math.gamma(1.5)), F.lit(0.0)
        for i in range(1, (df - 1) // 2 + 1):
            total = total + term
            term = term * x / F.lit(2.0 * i + 1)
        return F.lit(2.0) * normal_tail(F.sqrt(x)) + F.exp(-x / F.lit(2.0)) * total
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * x / F.lit(2.0 * i)
        total = total + term
    return F.exp(-x / F.lit(2.0)) * total


def chi2_homogeneity(counts: DataFrame, block: str, p: str, n: str) -> DataFrame:
    """(chi2, df) of blocks against two classes, from counts(block, p, n)."""
    all_ = counts.agg(F.sum(p).alias("_p"), F.sum(n).alias("_n"), F.count("*").alias("_k"))
    j = counts.crossJoin(F.broadcast(all_))
    size, total = F.col(p) + F.col(n), F.col("_p") + F.col("_n")
    e1, e0 = size * F.col("_p") / total, size * F.col("_n") / total
    part = F.try_divide((F.col(p) - e1) * (F.col(p) - e1), e1) + F.try_divide((F.col(n) - e0) * (F.col(n) - e0), e0)
    return j.agg(F.sum(part).alias("chi2"), (F.max("_k") - 1).alias("df"))


def t_tails(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t for whole degrees of freedom, by its finite sums for odd and even ones."""
    a = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(a) * F.cos(a)
    state = lambda total, term: F.struct(total.alias("total"), term.alias("term"))

    def step(odd: int):
        def add(s, i):
            over = F.lit(2.0) * i / (F.lit(2.0) * i + 1) if odd else (F.lit(2.0) * i - 1) / (F.lit(2.0) * i)
            return state(s["total"] + s["term"], s["term"] * c2 * over)

        terms = F.floor((df - 1) / 2) if odd else F.floor(df / 2)
        steps = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, state(F.lit(0.0), F.lit(1.0)), add, lambda s: s["total"])

    inside = F.when(df % 2 == 1, (a + F.sin(a) * F.cos(a) * step(1)) * F.lit(2 / math.pi)).otherwise(F.sin(a) * step(0))
    return F.when(df >= 1, F.greatest(F.lit(0.0), F.lit(1.0) - inside))


def normal_quantile(p: float) -> float:
    """The normal quantile, for parameters rather than columns."""
    return statistics.NormalDist().inv_cdf(p)


def t_quantile(df: Column) -> Column:
    """97.5 % quantile of Student's t for 1 or more degrees of freedom: exact for 1 and 2, else refined from the
    normal quantile by Hill's expansion; within 1e-4 from 3 on, where a table of it is looked up."""
    table = F.array(*[F.lit(x) for x in _t_table(200)])
    return F.when(df < 1, None).when(df <= 200, F.element_at(table, F.greatest(df, F.lit(1)).cast("int"))).otherwise(1.959963984540054 + 2.372 / df)


def _t_table(n: int) -> list[float]:
    """Quantiles by bisection of the exact distribution function, whose finite sums differ for odd and even df."""
    import math

    def cdf(t: float, k: int) -> float:
        a = math.atan(t / math.sqrt(k))
        c2, total, term = math.cos(a) ** 2, 0.0, 1.0
        if k % 2:
            for i in range(1, (k - 1) // 2 + 1):
                total += term
                term *= c2 * 2 * i / (2 * i + 1)
            return 0.5 + (a + math.sin(a) * math.cos(a) * total) / math.pi
        for i in range(1, k // 2 + 1):
            total += term
            term *= c2 * (2 * i - 1) / (2 * i)
        return 0.5 + math.sin(a) * total / 2

    out = []
    for k in range(1, n + 1):
        low, high = 1.0, 20.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if cdf(mid, k) < 0.975 else (low, mid)
        out.append(low)
    return out


def mean_ci(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, n, mean, sd, low, high): a t interval; of one value the value itself, with sd 0; NaN is left out."""
    v = F.when(~F.isnan(x), F.col(x))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.when(F.count(v) == 1, 0.0)).alias("sd"))
    half = F.when(F.col("n") > 1, t_quantile(F.col("n") - 1) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


#: Up to so many rows, and without ties, rank tests count all outcomes instead of taking the normal distribution.
EXACT, EXACT_SIDE = 50, 8


def subset_sums(n: Column, most: Column) -> Column:
    """An array with, at place s + 1, how many subsets of 1 to n add up to s, for s from 0 to most."""
    start = F.transform(F.sequence(F.lit(0), most), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    step = lambda acc, k: F.transform(acc, lambda c, i: c + F.when(i >= k, F.element_at(acc, F.greatest(i - k + 1, F.lit(1)))).otherwise(0.0))
    return F.aggregate(F.sequence(F.lit(1), n), start, step)


def sized_subset_sums(k: Column, n: Column) -> Column:
    """An array with, at place j * (k * (n - k) + 1) + u + 1, how many subsets of j of the numbers 1 to n have a sum of
    u more than the least one, j (j + 1) / 2, for j from 0 to k and u from 0 to k (n - k)."""
    width = k * (n - k) + 1
    start = F.transform(F.sequence(F.lit(0), (k + 1) * width - 1), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def step(acc: Column, r: Column) -> Column:
        def more(c: Column, i: Column) -> Column:
            j, u = F.floor(i / width), i % width
            back = u - (r - j)  # the number r in j-th place is r - j over the least
            return c + F.when((j >= 1) & (r >= j) & (back >= 0), F.element_at(acc, (F.greatest((j - 1) * width + back, F.lit(0)) + 1).cast("int"))).otherwise(0.0)

        return F.transform(acc, more)

    return F.aggregate(F.sequence(F.lit(1), n), start, step)


def tail_from(counts: Column, low: Column, high: Column) -> Column:
    """The sum of an array of counts from place low to place high."""
    return F.aggregate(F.slice(counts, low, high - low + 1), F.lit(0.0), lambda s, c: s + c)


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """(keys, n1, n0, u, effect, z, p): group 1 greater than group 0; p one-sided, of all outcomes where a side has at most
    EXACT_SIDE rows, EXACT rows are there in all and no two are equal, else normal with ties and continuity."""
    g = by_value(df.withColumn("_g", F.col(group).cast("int")), keys, value, "_g")
    ties = g.groupBy(*keys).agg(F.sum(F.pow((F.col("p") + F.col("n")).cast("double"), F.lit(3.0)) - (F.col("p") + F.col("n"))).alias("_t"))
    a = roc_auc(df.withColumn("_g", F.col(group).cast("int")), keys, value, "_g", one_class=None)
    j = a.join(ties, keys) if keys else a.crossJoin(ties)
    n = (F.col("n1") + F.col("n0")).cast("double")
    u = F.col("auc") * F.col("n1") * F.col("n0")
    sd = F.sqrt(F.col("n1") * F.col("n0") / F.lit(12.0) * (n + 1 - F.col("_t") / (n * (n - 1))))
    z = F.try_divide(u - F.col("n1") * F.col("n0") / F.lit(2.0) - F.lit(0.5), sd)
    whole = F.col("n1") * F.col("n0")
    few = (F.col("_t") == 0) & (F.least("n1", "n0") <= EXACT_SIDE) & (F.least("n1", "n0") >= 1) & (n <= EXACT)
    # U has the same distribution with the sides exchanged; k of n is what may have an array.
    k = F.when(few, F.least("n1", "n0")).otherwise(1).cast("int")
    size = F.when(few, F.col("n1") + F.col("n0")).otherwise(2).cast("int")
    last = (k * (k * (size - k) + 1)).cast("int")
    j = j.withColumn("_u", F.round(u).cast("int")).withColumn("_counts", F.slice(sized_subset_sums(k, size), last + 1, k * (size - k) + 1))
    exact = tail_from(F.col("_counts"), F.col("_u") + 1, whole.cast("int") + 1) / tail_from(F.col("_counts"), F.lit(1), whole.cast("int") + 1)
    return j.select(*keys, "n1", "n0", u.alias("u"), F.col("auc").alias("effect"), z.alias("z"), F.when(few, exact).otherwise(normal_tail(z)).alias("p"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) after Abramowitz and Stegun 7.1.26 (error under 1.5e-7)."""
    # Fixed values of the published approximation.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(1.4142135623730951)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = t * (F.lit(c) + poly)
    upper = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def wilcoxon(df: DataFrame, keys: list[str], d: str, tie: str) -> DataFrame:
    """(keys, n, w, p): signed-rank sum of the positive differences, zeros left out, ties by mean rank; p is two-sided, of
    all signs where there are at most EXACT differences, none 0 and no two of one size, else normal with the correction
    for ties."""
    zeros = df.groupBy(*keys).agg(F.count(F.when(F.col(d) == 0, 1)).alias("_zeros"))
    own = df.filter((F.col(d) != 0) & F.col(d).isNotNull()).withColumn("_a", F.abs(d))
    v = own.groupBy(*keys, "_a").agg(F.count("*").alias("_c"), F.sum((F.col(d) > 0).cast("int")).alias("_pos"))
    r = running(v, keys, value_buckets(F.col("_a")), ["_a"], {"_cum": F.col("_c")})
    rank = F.col("_cum") - (F.col("_c") - 1) / F.lit(2.0)
    c = F.col("_c").cast("double")
    out = r.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(rank * F.col("_pos")).alias("w"), F.sum(c * c * c - c).alias("_t"))
    out = out.join(zeros, keys) if keys else out.crossJoin(zeros)
    n = F.col("n").cast("double")
    z = F.try_divide(F.abs(F.col("w") - n * (n + 1) / 4), F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48))
    few = (F.col("n") <= EXACT) & (F.col("_t") == 0) & (F.col("_zeros") == 0)
    size = F.when(few, F.col("n")).otherwise(1).cast("int")
    most = (size * (size + 1) / 2).cast("int")
    # the smaller of both tails: sums up to the lesser of w and what is left of all ranks
    low = F.least(F.round("w"), most - F.round("w")).cast("int")
    out = out.withColumn("_most", most).withColumn("_low", F.when(few, low).otherwise(0)).withColumn("_counts", subset_sums(size, most))
    exact = F.lit(2.0) * tail_from(F.col("_counts"), F.lit(1), F.col("_low") + 1) / F.pow(F.lit(2.0), n)
    return out.withColumn("p", F.least(F.lit(1.0), F.when(few, exact).otherwise(F.lit(2.0) * normal_tail(z)))).drop("_t", "_zeros", "_most", "_low", "_counts")


def concordant(df: DataFrame, keys: list[str], item: str, x: str, y: str) -> DataFrame:
    """(keys, pairs, concordant) over unordered pairs of a small table."""
    b = df.select(*keys, F.col(item).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    j = df.join(b, keys).filter(F.col(item) < F.col("_i")) if keys else df.crossJoin(b).filter(F.col(item) < F.col("_i"))
    return j.groupBy(*keys).agg(F.count("*").alias("pairs"), F.count(F.when((F.col("_x") - F.col(x)) * (F.col("_y") - F.col(y)) > 0, 1)).alias("concordant"))


def top(df: DataFrame, keys: list[str], score: Column, k: int, tie: str = "sensor_id") -> DataFrame:
    """The k rows of each key with the highest score, ties by ``tie``, with their rank ``rnk``."""
    own = Window.partitionBy(*keys).orderBy(score.desc_nulls_last(), tie)
    return df.withColumn("rnk", F.row_number().over(own)).filter(F.col("rnk") <= k)



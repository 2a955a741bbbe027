"""Statistics over decision logs, as Spark jobs."""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.operators import scale


def majority_labels(annotations: DataFrame, key, raters=3) -> DataFrame:
    """Majority action per item, and metric and dimensions among the raters who answer; raters per item are few."""
    refusals = F.sum(F.when(F.col("action") == "refuse", 1).otherwise(0))
    answer = F.col("action") == "answer"
    g = annotations.groupBy(key).agg((refusals * 2 > F.count(F.lit(1))).alias("_r"), F.mode(F.when(answer, F.col("metric")), True).alias("m"), F.mode(F.when(answer, F.col("dims")), True).alias("d"))
    pick = lambda c: F.when(F.col("_r"), "").otherwise(F.col(c))
    return g.select(key, F.when(F.col("_r"), "refuse").otherwise("answer").alias("m_action"), pick("m").alias("m_metric"), pick("d").alias("m_dims"))


# --- tests and intervals ------------------------------------------------------------------------


def mcnemar_p(b, c) -> Column:
    """Exact two-sided binomial p of two discordant counts.

    Terms are summed outward from the middle, relative to it, for 18 standard deviations: what lies beyond is under
    1e-70. So the work grows with the root of the counts.
    """
    b, c = F.col(b).cast("long"), F.col(c).cast("long")
    n, low = b + c, F.least(b, c)
    middle = F.floor(n / 2)
    reach = F.least(middle, F.ceil(9 * F.sqrt(n.cast("double"))) + 50)

    def step(acc, i):
        k, t = middle - i, acc["t"]
        return F.struct((t * k / (n - k + 1)).alias("t"), (acc["half"] + t).alias("half"), (acc["tail"] + F.when(k <= low, t).otherwise(0.0)).alias("tail"))

    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("half"), F.lit(0.0).alias("tail"))
    whole = lambda a: 2 * a["half"] - F.when(n % 2 == 0, 1.0).otherwise(0.0)
    p = F.aggregate(F.sequence(F.lit(0).cast("long"), reach), start, step, lambda a: 2 * a["tail"] / whole(a))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def wilson(ok: Column, n: Column, z=1.959963984540054) -> Column:
    """95 % interval of a share as struct(lo, hi); null without cases."""
    p, zz = ok / n, z * z
    centre, den = p + zz / (2 * n), 1 + zz / n
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.struct(((centre - half) / den).alias("lo"), ((centre + half) / den).alias("hi")))


def fisher_p(a, b, c, d) -> Column:
    """Two-sided exact p of a 2×2 table: two passes over the support that keep only running sums.

    The support is taken 18 standard deviations to each side of its mean: what lies beyond is under 1e-60.
    """
    a, b, c, d = (F.col(x).cast("long") for x in (a, b, c, d))
    n, row, col = a + b + c + d, a + b, a + c
    lo, hi = F.greatest(F.lit(0).cast("long"), row + col - n), F.least(row, col)
    d_n, d_row, d_col = (x.cast("double") for x in (n, row, col))
    mean = d_row * d_col / F.greatest(d_n, F.lit(1.0))
    reach = 18 * F.sqrt(mean * (d_n - d_row) / F.greatest(d_n, F.lit(1.0)) * (d_n - d_col) / F.greatest(d_n - 1, F.lit(1.0))) + 50
    lo, hi = F.greatest(lo, F.floor(mean - reach)), F.least(hi, F.ceil(mean + reach))
    xs = F.sequence(lo, hi)
    ln = lambda v: F.ln(v.cast("double"))
    move = lambda lp, x: F.when(x < hi, lp + ln(row - x) + ln(col - x) - ln(x + 1) - ln(n - row - col + x + 1)).otherwise(lp)
    first = F.aggregate(
        xs, F.struct(F.lit(0.0).alias("lp"), F.lit(-1e300).alias("top"), F.lit(-1e300).alias("obs")),
        lambda s, x: F.struct(move(s["lp"], x).alias("lp"), F.greatest(s["top"], s["lp"]).alias("top"), F.when(x == a, s["lp"]).otherwise(s["obs"]).alias("obs")))
    second = F.aggregate(
        xs, F.struct(F.lit(0.0).alias("lp"), F.lit(0.0).alias("all"), F.lit(0.0).alias("le")),
        lambda s, x: F.struct(
            move(s["lp"], x).alias("lp"), (s["all"] + F.exp(s["lp"] - F.col("_f.top"))).alias("all"),
            (s["le"] + F.when(s["lp"] <= F.col("_f.obs") + 1e-9, F.exp(s["lp"] - F.col("_f.top"))).otherwise(0.0)).alias("le")),
        lambda s: F.least(F.lit(1.0), s["le"] / s["all"]))
    return first, second


def with_fisher(df: DataFrame, a, b, c, d, name="p") -> DataFrame:
    first, second = fisher_p(a, b, c, d)
    return df.withColumn("_f", first).withColumn(name, second).drop("_f")


def uniform(text: Column, part=0) -> Column:
    """A number in (0, 1) from eight hex digits of an md5."""
    return (F.conv(F.substring(F.md5(text), 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def poisson_table(rates: DataFrame, rate="units") -> DataFrame:
    """(rate, lo, cdf, steps): the distribution function of each whole rate from `lo` on, exact but for rounding, ten deviations wide.

    Probabilities are running sums of ln(rate / k), scaled by their largest: nothing over- or underflows at any rate.
    """
    r = F.col(rate)
    reach = F.ceil(10 * F.sqrt(r.cast("double"))).cast("bigint") + 20
    cells = rates.select(r.cast("bigint").alias(rate)).distinct().select(rate, F.greatest(F.lit(0), r - reach).alias("lo"), (r + reach).alias("hi"))
    cells = cells.select(rate, "lo", F.explode(F.sequence("lo", "hi")).alias("k"))
    upto = W.partitionBy(rate).orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    logs = cells.withColumn("s", F.sum(F.when(F.col("k") > F.col("lo"), F.ln(r / F.col("k"))).otherwise(0.0)).over(upto))
    mass = logs.withColumn("p", F.exp(F.col("s") - F.max("s").over(W.partitionBy(rate))))
    cum = mass.withColumn("c", F.sum("p").over(upto))
    whole = cum.withColumn("c", F.col("c") / F.max("c").over(W.partitionBy(rate)))
    table = whole.groupBy(rate, "lo").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    return table.withColumn("steps", halvings("cdf"))


def halvings(array) -> Column:
    """The steps of a binary search in an array: powers of two, falling."""
    most = F.ceil(F.log2(F.size(array) + 1)).cast("int")
    return F.transform(F.sequence(most, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2.0), i).cast("int"))


def below(cdf: Column, steps: Column, u: Column) -> Column:
    """How many entries of an ascending array are smaller than u."""
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cdf, at + step - 1) < u, at + step).otherwise(at))


#: Replicates that one row draws.
REPLICATES_AT_ONCE = 500


def bootstrap_interval(kinds: DataFrame, keys, replicates, seed, width=0.001) -> DataFrame:
    """95 % interval of a resampled mean difference.

    `kinds` has the distinct (n, diff) of the resampled units with their number `units`. Units of one kind are
    interchangeable, so their total weight in a replicate is one Poisson draw, whatever their number: the quantile of a
    uniform number, looked up in the distribution function of the rate, by the same rule for every rate.
    """
    keys = list(keys)
    # few kinds, many replicates: deal the replicates over the cores
    parts = -(-replicates // REPLICATES_AT_ONCE)
    k = kinds.join(poisson_table(kinds), "units").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    k = k.repartition(max(kinds.sparkSession.sparkContext.defaultParallelism, 1), "part", "n", "diff")
    first = F.col("part") * REPLICATES_AT_ONCE
    reps = F.sequence(first + 1, F.least(first + REPLICATES_AT_ONCE, F.lit(replicates)))
    k = k.withColumn("head", F.concat_ws("|", F.lit(str(seed)), *keys, F.lit(""))).withColumn("tail", F.concat_ws("|", F.lit(""), "n", "diff"))
    k = scale.fenced(k, "head", "tail")
    text = lambda rep: F.concat("head", rep.cast("string"), "tail")
    draws = F.transform(reps, lambda rep: F.struct(rep.alias("rep"), (F.col("lo") + below(F.col("cdf"), F.col("steps"), uniform(text(rep)))).alias("w")))
    w = k.select(*keys, "n", "diff", F.explode(draws).alias("d")).select(*keys, "n", "diff", "d.*")
    per = w.groupBy(*keys, "rep").agg(F.round(F.sum(F.col("w") * F.col("diff")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0)), 9).alias("x"))
    ranks = scale.value_ranks(per, "x", keys, width)
    at = lambda q: scale.value_at(F.floor(F.lit(q) * (F.col("total") - 1)) + 1)
    return ranks.groupBy(*keys).agg(at(0.025).alias("lo"), at(0.975).alias("hi"))


def unit_kinds(df: DataFrame, keys, cluster, a, b) -> DataFrame:
    """Distinct (n, diff) of clusters of paired outcomes, and how many clusters have them."""
    per = df.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(b).cast("int") - F.col(a).cast("int")).alias("diff"))
    return per.groupBy(*keys, "n", "diff").agg(F.count(F.lit(1)).alias("units"))


def contingency(df: DataFrame, keys, a, b) -> DataFrame:
    x, y = F.col(a), F.col(b)
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), yes(x & y).alias("both"), yes(x & ~y).alias("left_only"), yes(~x & y).alias("right_only"), yes(~x & ~y).alias("neither"),
        F.round((yes(x) - yes(y)) / F.count(F.lit(1)), 6).alias("delta"))


# --- agreement ----------------------------------------------------------------------------------


def fleiss_kappa(votes: DataFrame, item, answer, keys=()) -> DataFrame:
    """Multi-rater agreement; every item has the same number of raters. One category only counts as full agreement."""
    keys = list(keys)
    cells = votes.groupBy(*keys, item, answer).agg(F.count(F.lit(1)).alias("c"))
    items = cells.groupBy(*keys, item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    observed = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("ss") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("obs"), F.sum("r").alias("votes"))
    share = cells.groupBy(*keys, answer).agg(F.sum("c").alias("c"))
    if keys:
        share = share.join(observed.select(*keys, "votes"), keys).groupBy(*keys).agg(F.sum(F.pow(F.col("c") / F.col("votes"), 2)).alias("exp"))
        j = observed.join(share, keys)
    else:
        share = share.agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), 2)).alias("exp")).withColumn("_k", F.lit(1))
        j = observed.withColumn("_k", F.lit(1)).join(share, "_k")
    kappa = F.when(F.col("exp") < 1, (F.col("obs") - F.col("exp")) / F.nullif(1 - F.col("exp"), F.lit(0.0))).otherwise(1.0)
    return j.select(*keys, "items", F.round(kappa, 6).alias("kappa"), F.round("obs", 6).alias("observed"), F.round("exp", 6).alias("expected"))


def cohen_kappa(votes: DataFrame, item, rater, answer, pairs) -> DataFrame:
    """Pairwise agreement of raters, from one row per item."""
    raters = sorted({r for p in pairs for r in p})
    wide = votes.groupBy(item).agg(*[F.max(F.when(F.col(rater) == r, F.col(answer))).alias(f"r_{r}") for r in raters])
    e = wide.select(F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"r_{a}").alias("a"), F.col(f"r_{b}").alias("b")) for a, b in pairs])).alias("x")).select("x.*").filter("a is not null and b is not null")
    sides = e.select("pair", F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")), F.struct(F.col("b").alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r")))).alias("x")).select("pair", "x.*")
    exp = sides.groupBy("pair", "v").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).groupBy("pair").agg((F.sum(F.col("l") * F.col("r")) / (F.sum("l") * F.sum("r"))).alias("exp"))
    obs = e.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("obs"))
    return obs.join(exp, "pair").select("pair", "n", F.round("obs", 6).alias("agreement"), F.round((F.col("obs") - F.col("exp")) / F.nullif(1 - F.col("exp"), F.lit(0.0)), 6).alias("kappa"))


def binding_agreement(votes: DataFrame, item, answer, key, none_of="E") -> DataFrame:
    """Unanimity, majority against the key, and abstaining votes; `key` is constant per item."""
    cells = votes.groupBy(item, answer).agg(F.count(F.lit(1)).alias("c"), F.max(key).alias("k"))
    per = cells.groupBy(item).agg(F.max_by(answer, "c").alias("top"), F.max("c").alias("c"), F.sum("c").alias("r"), F.max("k").alias("k"), F.sum(F.when(F.col(answer) == none_of, F.col("c")).otherwise(0)).alias("e"))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    all_agree, right = F.col("c") == F.col("r"), (F.col("c") * 2 > F.col("r")) & (F.col("top") == F.col("k"))
    return per.agg(F.count(F.lit(1)).alias("items"), rate(all_agree).alias("all_agree"), rate(right).alias("majority_right"), F.round(F.sum("e") / F.sum("r"), 6).alias("abstain_rate"),
                   F.sum(F.when(~all_agree | ~right, 1).otherwise(0)).alias("disagreements"))


# --- repeated samples ---------------------------------------------------------------------------


def sample_profile(samples: DataFrame, keys, answer_cols, k) -> DataFrame:
    """Modal answer of k samples (earliest on a tie), its count, the distinct answers and their entropy in bits."""
    cells = samples.groupBy(*keys, *answer_cols).agg(F.count(F.lit(1)).alias("c"), F.min("sample_idx").alias("at"))
    p = F.col("c") / F.lit(float(k))
    return cells.groupBy(*keys).agg(
        F.min_by(F.struct(*answer_cols), F.struct((-F.col("c")).alias("c"), "at")).alias("plurality"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("distinct_answers"),
        F.round(F.abs(F.sum(-p * F.log2(p))), 6).alias("entropy"))


def abstention_arms(cases: DataFrame, arms: dict, family) -> DataFrame:
    """Per arm and family (null: all): abstention, answered accuracy, error coverage, lift, false abstention, and Fisher's p.

    `cases` has c1 and full_ok; an arm abstains when c1 is below its limit.
    """
    e = cases.select(family, "c1", "full_ok", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(n).alias("limit")) for a, n in arms.items()])).alias("x"))
    e = e.select(F.col("x.arm").alias("arm"), family, (F.col("c1") < F.col("x.limit")).alias("abst"), "full_ok")
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ab, ok = F.col("abst"), F.col("full_ok")
    g = e.groupingSets([[F.col("arm"), F.col(family)], [F.col("arm")]], "arm", family).agg(
        F.count(F.lit(1)).alias("n"), yes(ab & ~ok).alias("a"), yes(~ab & ~ok).alias("b"), yes(ab & ok).alias("c"), yes(~ab & ok).alias("d"))
    div = lambda x, y: F.expr(f"({x}) / nullif({y}, 0)")
    g = with_fisher(g, "a", "b", "c", "d")
    overall = g.filter(F.col(family).isNull()).select("arm", div("a + c", "n").alias("_rate"))
    j = g.join(overall, "arm")
    r6 = lambda c: F.round(c, 6)
    return j.select("arm", family, "n", r6(div("a + c", "n")).alias("abstention"), r6(div("d", "b + d")).alias("answered_accuracy"), r6(div("a", "a + b")).alias("coverage"),
                    r6(div("a", "a + b") / F.nullif(F.col("_rate"), F.lit(0.0))).alias("lift"), r6(div("c", "c + d")).alias("false_abstention"), r6(F.col("p")).alias("p"))


def branch(cases: list, otherwise) -> Column:
    """First branch whose condition holds."""
    out = F.lit(otherwise)
    for cond, name in reversed(cases):
        out = F.when(cond, name).otherwise(out)
    return out


def cross_pass(passes: DataFrame, key, number, answer, ok) -> DataFrame:
    """Agreement over repeated passes: identical answers, strict majority, and flips against the first pass."""
    cells = passes.groupBy(key, answer).agg(F.count(F.lit(1)).alias("c"), F.max(ok).alias("ok"), F.min(number).alias("first"))
    per = cells.groupBy(key).agg(F.sum("c").alias("r"), F.max("c").alias("c"), F.max_by(F.struct(answer, "ok"), "c").alias("top"), F.min_by(answer, "first").alias("one"))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    major = F.col("c") * 2 > F.col("r")
    return per.agg(F.count(F.lit(1)).alias("n"), rate(F.col("c") == F.col("r")).alias("agree"), rate(major & F.col("top.ok")).alias("majority_right"),
                   F.sum(F.when(~major | (F.col(f"top.{answer}") != F.col("one")), 1).otherwise(0)).alias("flips"))

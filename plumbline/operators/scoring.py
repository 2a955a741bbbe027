"""Scores and diagnostics over decision logs."""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as X
from plumbline.operators import scale


def yes(c) -> Column:
    """Rows where the condition holds."""
    return F.sum(F.when(c, 1).otherwise(0))


def rate(c) -> Column:
    return F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)


def guarded(num, den) -> Column:
    """Ratio over at least one."""
    return F.round(num / F.greatest(den, F.lit(1)), 6)


def same_set(a, b) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def flagged(df: DataFrame) -> DataFrame:
    """Correctness flags of predictions beside their gold columns (arrays pred_dimensions, expected_dimensions)."""
    pred, gold = F.col("pred_dimensions"), F.col("expected_dimensions")
    d = df.select(
        "*", ((F.col("action") == "refuse") | (F.col("pred_metric_id") == "")).alias("refused"), (F.col("expected_action") == "refuse").alias("expected_refusal"),
        (F.col("pred_metric_id") == F.col("expected_metric_id")).alias("metric_ok"), same_set(pred, gold).alias("dim_ok"), (F.size(F.array_except(gold, pred)) == 0).alias("dim_recall"))
    return d.withColumn("joint_ok", F.col("metric_ok") & F.col("dim_ok"))


def full_ok() -> Column:
    """Refusals right, or an answer with the right metric and dimensions."""
    return F.when(F.col("expected_refusal"), F.col("refused")).otherwise(~F.col("refused") & F.col("joint_ok"))


def score_columns(executed=None) -> list:
    tp, fp, fn = (yes(F.col("refused") & F.col("expected_refusal")), yes(F.col("refused") & ~F.col("expected_refusal")), yes(~F.col("refused") & F.col("expected_refusal")))
    cols = [
        F.count(F.lit(1)).alias("n"), rate(F.col("metric_ok")).alias("metric_accuracy"), rate(F.col("dim_ok")).alias("dimension_accuracy"),
        rate(F.col("dim_recall")).alias("dimension_recall"), rate(F.col("joint_ok")).alias("joint_accuracy"),
        guarded(tp, tp + fp).alias("refusal_precision"), guarded(tp, tp + fn).alias("refusal_recall"),
    ]
    if executed:
        answered = (F.col("action") == "answer") & (F.col("pred_metric_id") != "")
        cols.append(guarded(yes(answered & F.col(executed)), yes(answered)).alias("execution_rate"))
    return cols


def refusal_breakdown(flags: DataFrame, keys) -> DataFrame:
    """Refusal counts per category, over cases that refuse or should."""
    tp, fp, fn = (yes(F.col("refused") & F.col("expected_refusal")), yes(F.col("refused") & ~F.col("expected_refusal")), yes(~F.col("refused") & F.col("expected_refusal")))
    return flags.filter("refused OR expected_refusal").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), guarded(tp, tp + fp).alias("precision"), guarded(tp, tp + fn).alias("recall"))


def full_case(flags: DataFrame, keys) -> DataFrame:
    """Action-aware accuracy, exact and with a superset of the dimensions allowed."""
    action = F.col("refused") == F.col("expected_refusal")
    full = lambda dims: action & (F.col("expected_refusal") | (F.col("metric_ok") & dims))
    return flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), rate(action).alias("action"), rate(F.col("metric_ok")).alias("metric"), rate(F.col("dim_ok")).alias("exact_dim"),
        rate(F.col("dim_recall")).alias("lenient_dim"), rate(full(F.col("dim_ok"))).alias("exact_full"), rate(full(F.col("dim_recall"))).alias("lenient_full"))


def deduplicated(flags: DataFrame, keys, text, order):
    """First case of each repeated request per key when its labels agree; and the conflicting groups."""
    sig = F.concat_ws("\u0001", "expected_action", "expected_metric_id", F.array_join(F.sort_array("expected_dimensions"), ","))
    row = F.struct(*[c for c in flags.columns if c not in keys])
    g = flags.withColumn("_n", X.normalize(F.col(text))).groupBy(*keys, "_n").agg(F.min(sig).alias("_a"), F.max(sig).alias("_b"), F.min_by(row, order).alias("r"))
    agree = g.filter("_a = _b").select(*keys, "r.*")
    return agree, g.filter("_a <> _b").select(*keys, F.col("_n").alias("text"))


def trace_activity(checks: DataFrame, families, keys=()) -> DataFrame:
    """Active, passed, failed and inactive counts per check family; `checks` is a struct of structs."""
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"checks.{f}.active").alias("active"), F.col(f"checks.{f}.passed").alias("passed")) for f in families])
    e = checks.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
    return e.groupBy(*keys, "family").agg(
        yes(F.col("active")).alias("n_active"), yes(F.col("active") & F.col("passed")).alias("n_passed"), yes(F.col("active") & ~F.col("passed")).alias("n_failed"), yes(~F.col("active")).alias("n_inactive"))


def candidate_fate(df: DataFrame, keys) -> DataFrame:
    """Counts and shares of missing, right and wrong outcomes per candidate list size, plain and with the validator."""
    here, right = F.array_contains("retrieved", F.col("expected_metric_id")), F.col("joint_ok")
    fate = F.when(~here, "candidate_missing").when(right, "candidate_present_joint_correct").otherwise("candidate_present_final_wrong")
    strict = F.when(~here, "candidate_missing").when(right & F.col("validator_pass"), "candidate_present_md_correct_validator_pass").otherwise("candidate_present_final_error")
    cross = F.concat(F.lit("candidate_"), F.when(here, "present").otherwise("missing"), F.lit("__joint_"), F.when(right, "correct").otherwise("wrong"))
    rows = F.array(*[F.struct(F.lit(n).alias("part"), c.alias("fate")) for n, c in (("fate", fate), ("strict", strict), ("cross", cross))])
    e = df.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
    counts = e.groupBy(*keys, "part", "fate").agg(F.count(F.lit(1)).alias("n"))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    return counts.join(total, list(keys)).select(*keys, "part", "fate", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def failure_family(text="nl_query") -> Column:
    """Why a prediction differs from its gold, first reason that fits."""
    low = F.lower(text)
    refusal = F.when(low.rlike("raw|identifier|select |delete |drop "), "policy_refusal").otherwise("unsupported_or_refusal")
    wider = (F.size("expected_dimensions") > 0) & F.col("dim_recall") & ~F.col("dim_ok")
    return F.when(F.col("expected_refusal"), refusal).when(wider, "hierarchy_overexpansion").when(~F.col("metric_ok"), "metric_identity").otherwise("other")


def residual_failure(flags: DataFrame, keys) -> DataFrame:
    """Failures left although metric and dimensions were available, per mode and family (null family: all)."""
    d = flags.filter("NOT expected_refusal").withColumn("family", failure_family())
    got = F.col("metric_ok") & F.col("dim_recall")
    left = got & ~F.col("joint_ok")
    whole = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rate(got).alias("available"), guarded(yes(left), yes(got)).alias("residual"))
    parts = d.filter(left).groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n"))
    return whole.unionByName(parts, allowMissingColumns=True)


def ends(rounds: DataFrame, keys, cols) -> DataFrame:
    """First and last round of each case as structs."""
    s = F.struct(*cols)
    return rounds.groupBy(*keys).agg(F.min_by(s, "round").alias("first"), F.max_by(s, "round").alias("last"), F.count(F.lit(1)).alias("calls"))


def violation_census(rounds: DataFrame, key="request_id") -> DataFrame:
    """Per violation type: cases with it at the first and the last round, and how many were fixed."""
    e = ends(rounds, [key], ["violations"])
    each = lambda side, a, b: e.select(key, F.explode(F.array_distinct(f"{side}.violations")).alias("type"), F.lit(a).alias("f"), F.lit(b).alias("l"))
    both = each("first", 1, 0).union(each("last", 0, 1)).groupBy(key, "type").agg(F.max("f").alias("f"), F.max("l").alias("l"))
    fixed = yes((F.col("f") == 1) & (F.col("l") == 0))
    return both.groupBy("type").agg(F.sum("f").alias("at_first"), F.sum("l").alias("at_last"), fixed.alias("fixed"), guarded(fixed, F.sum("f")).alias("fix_rate"))


def invisible_errors(last: DataFrame) -> DataFrame:
    """Wrong final plans the validator accepts, by what is wrong."""
    kind = F.when(~F.col("metric_ok") & F.col("dim_ok"), "wrong_metric_only").when(F.col("metric_ok") & ~F.col("dim_ok"), "wrong_dimension_set_only").otherwise("wrong_metric_and_dimensions")
    return last.filter((F.size("violations") == 0) & ~F.col("joint_ok")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def state_by_round(rounds: DataFrame, keys, cols, upto) -> DataFrame:
    """State of each case as of every round: the latest usable prediction, or the sentinel when there is none."""
    s = F.struct(*cols)
    usable = lambda k: F.when(F.col("has_prediction") & (F.col("round") <= k), F.col("round"))
    g = rounds.groupBy(*keys).agg(*[F.max_by(s, usable(k)).alias(f"s{k}") for k in range(upto + 1)], *[F.max(usable(k)).alias(f"m{k}") for k in range(upto + 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(f"m{k}").isNotNull(), F.col(f"s{k}")).alias("s")) for k in range(upto + 1)]))
    e = g.select(*keys, each.alias("x")).select(*keys, "x.k", "x.s")
    none = F.array().cast("array<string>")
    sentinel = {"action": F.lit("answer"), "pred_metric_id": F.lit("__parse_error__"), "pred_dimensions": none}
    return e.select(*keys, "k", *[F.coalesce(f"s.{c}", sentinel[c]).alias(c) if c in sentinel else F.col(f"s.{c}").alias(c) for c in cols])


def transitions(first: Column, last: Column) -> list:
    return [yes(~first & last).alias("wrong_to_right"), yes(first & ~last).alias("right_to_wrong"), yes(first & last).alias("stayed_right"), yes(~first & ~last).alias("stayed_wrong")]


def refusal_composition(flags: DataFrame, keys, family) -> DataFrame:
    """Errors and how many of them are refusals of answerable requests; per family below."""
    error = ~F.col("joint_ok")
    false_refusal = error & F.col("refused") & ~F.col("expected_refusal")
    whole = flags.groupBy(*keys).agg(yes(error).alias("errors"), yes(false_refusal).alias("false_refusals"), F.round(yes(false_refusal) / F.nullif(yes(error), F.lit(0)), 6).alias("share"))
    parts = flags.filter(false_refusal).groupBy(*keys, family).agg(F.count(F.lit(1)).alias("false_refusals"))
    return whole.unionByName(parts, allowMissingColumns=True)


def cost(rounds: DataFrame, keys, case) -> DataFrame:
    per = rounds.groupBy(*keys, case).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"), F.sum(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("lat"),
        F.count(F.when(F.col("latency_ms") > 0, 1)).alias("lat_n"))
    return per.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.round(F.avg("calls"), 6).alias("calls_mean"), F.max("calls").alias("calls_max"), yes(F.col("calls") == 1).alias("resolved_first"),
        F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.round(F.sum("lat") / F.sum("lat_n"), 6).alias("latency_mean"))


def latency_percentiles(df: DataFrame, keys, value, width=10.0) -> DataFrame:
    """Median, floor-index p95 and p99, maximum and throughput; value in milliseconds."""
    r = scale.value_ranks(df, value, keys, width)
    last = F.col("total") - 1
    at = lambda q: scale.value_at(F.floor(F.lit(q) * last) + 1)
    mid = (scale.value_at(F.floor(last / 2) + 1) + scale.value_at(F.ceil(last / 2) + 1)) / 2
    ranks = r.groupBy(*keys).agg(F.round(mid, 6).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    sums = df.groupBy(*keys).agg(F.max(value).alias("max"), F.round(F.count(value) * 1000 / F.sum(value), 6).alias("per_second"))
    return ranks.join(sums, list(keys))


def nearest_rank(df: DataFrame, keys, value, width=10.0) -> DataFrame:
    r = scale.value_ranks(df, value, keys, width)
    at = lambda q: scale.value_at(F.greatest(F.ceil(F.lit(q) * F.col("total")), F.lit(1)))
    return r.groupBy(*keys).agg(
        F.max("total").alias("n"), F.round(F.sum(F.col("v") * F.col("n")) / F.max("total"), 6).alias("mean"), F.min("v").alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("max"))


def sql_shape_score(df: DataFrame, keys) -> DataFrame:
    """Equality of the shape of two queries: aggregate functions, measures, dimensions; recall of tables."""
    agg, measure, dim = (same_set(f"pred_{c}", f"gold_{c}") for c in ("aggs", "measures", "dims"))
    tables = F.size(F.array_except("gold_tables", "pred_tables")) == 0
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rate(F.col("parse_ok")).alias("parse_rate"), rate(agg).alias("agg_accuracy"), rate(measure).alias("measure_accuracy"),
                                 rate(dim).alias("dim_accuracy"), rate(tables).alias("table_recall"), rate(agg & measure & dim).alias("joint"))


def metric_census(df: DataFrame, signature, dims) -> DataFrame:
    """Distinct metric signatures with their case count and the union of their dimensions."""
    n = df.groupBy(signature).agg(F.count(F.lit(1)).alias("cases"))
    d = df.select(signature, F.explode(dims).alias("d")).distinct().groupBy(signature).agg(F.sort_array(F.collect_list("d")).alias("dims"))
    return n.join(d, signature, "left")


def verdict_drift(stored: DataFrame, recomputed: DataFrame, on) -> DataFrame:
    """Rows whose stored verdict or violation types differ from the recomputed ones."""
    a = stored.select(*on, F.col("passed").alias("old_pass"), F.sort_array("types").alias("old_types"))
    b = recomputed.select(*on, F.col("passed").alias("new_pass"), F.sort_array("types").alias("new_types"))
    return a.join(b, on).filter((F.col("old_pass") != F.col("new_pass")) | (F.col("old_types") != F.col("new_types")))


def scorer_crosscheck(mine: DataFrame, released: DataFrame, keys, metrics, within=1e-9) -> DataFrame:
    """Recomputed against released scores: the largest difference per key and whether it is one.

    Metrics that a release lacks (null) are not compared; a key it lacks altogether says so.
    """
    theirs = released.select(*keys, F.lit(True).alias("_known"), *[F.col(m).cast("double").alias(f"_{m}") for m in metrics])
    gaps = [F.abs(F.col(m) - F.col(f"_{m}")) for m in metrics]
    largest = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    status = F.when(F.col("_known").isNull(), "mode_not_in_released_results").when(F.coalesce("max_abs_diff", F.lit(0.0)) < within, "match").otherwise("MISMATCH")
    return mine.join(theirs, list(keys), "left").withColumn("max_abs_diff", largest).select(*keys, "max_abs_diff", status.alias("status"))


def id_digest(ids: DataFrame, key) -> DataFrame:
    """One digest of an id set that merges: the eight 32-bit parts of each id's sha256 are summed, then hashed with their number.

    Sums need no order, so no list of ids is held anywhere and digests of parts add up; it tells sets apart, not forgeries.
    """
    k = ids.select(F.sha2(F.col(key).cast("string"), 256).alias("h")).filter("h IS NOT NULL").distinct()
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    n = F.count(F.lit(1))
    return k.agg(n.alias("n"), F.sha2(F.concat_ws(",", n.cast("string"), *[part(i) for i in range(8)]), 256).alias("digest"))


def latest_record(df: DataFrame, key, error, seq, cols) -> DataFrame:
    """First record without an error per key, else the first one."""
    order = F.struct((F.coalesce(F.col(error), F.lit("")) != "").alias("bad"), F.col(seq).alias("seq"))
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def safety_metrics(df: DataFrame, keys=(), pred="pred", gold="gold") -> DataFrame:
    """Confusion and derived rates with `unsafe` as the positive class; a rate without cases is null."""
    p, g = F.col(pred), F.col(gold)
    tp, fp, fn, tn = (yes((p == a) & (g == b)) for a, b in (("unsafe", "unsafe"), ("unsafe", "safe"), ("safe", "unsafe"), ("safe", "safe")))
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rate(p == g).alias("accuracy"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    div = lambda a, b: F.round(F.expr(f"{a} / nullif({b}, 0)"), 6)
    return d.select("*", div("tp", "tp + fp").alias("precision"), div("tp", "tp + fn").alias("recall"), div("2 * tp", "2 * tp + fp + fn").alias("f1"), div("tn", "tn + fp").alias("specificity"))


def reliability_score(df: DataFrame, keys, weights: dict) -> DataFrame:
    """Weighted score of safe, unsafe and execution behaviour.

    `weights` are the penalty constants: all, safe, executed, half (cost of a wrong execution), scale.
    """
    secure = F.avg(F.when(F.col("pred") == F.col("gold"), 1.0).otherwise(0.0))
    safe = F.avg(F.when(F.col("gold") == "safe", F.when(F.col("pred") == "safe", 1.0).otherwise(0.0)))
    acc, run = F.avg("column_ok"), F.avg("exec_ok")
    w = {k: F.lit(float(v)) for k, v in weights.items()}
    lost = (1 - secure) * w["all"] - (1 - safe) * w["safe"]
    gain = run * w["executed"] - w["half"] * (acc - run) * w["executed"] - (1 - safe) * w["safe"]
    return df.groupBy(*keys).agg(F.round(secure, 6).alias("secure"), F.round(safe, 6).alias("safe_secure"), F.round(run, 6).alias("exec_acc"), F.round((gain - lost) / w["scale"], 6).alias("rs"))


def rank_list(df: DataFrame, score, name="mode") -> Column:
    """Aggregate: names by falling score, then name."""
    return F.transform(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(name).alias("m")))), lambda x: x["m"])

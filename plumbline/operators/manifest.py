"""From a semantic-model manifest to a governed metric catalog, its edges and bindings."""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as X
from plumbline.operators import joins as JN, metrics as M
from plumbline.session import checkpointed

# How a manifest aggregation is written in a formula.
AGG_SQL = {
    "sum": "SUM({x})", "count": "COUNT({x})", "count_distinct": "COUNT(DISTINCT {x})", "average": "AVG({x})", "max": "MAX({x})", "min": "MIN({x})",
    "sum_boolean": "SUM(CAST({x} AS INTEGER))", "median": "MEDIAN({x})", "percentile": "PERCENTILE_CONT({x}, {p})",
}
FIELDS = ["metric_id", "metric_type", "answerable", "formula", "allowed", "grain", "coverage", "numerator_nodes", "denominator_nodes"]


def none() -> Column:
    return F.array().cast("array<string>")


def time_dims(grain: Column) -> Column:
    return F.transform(M.grains_from(grain), lambda g: F.concat(F.lit("metric_time__"), g))


def rank(grain: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in M.GRAINS]), grain)


def grain_at(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in M.GRAINS]), position.cast("int"))


def formula_of(agg: Column, expr: Column, p: Column) -> Column:
    """Formula of a measure; null for an aggregation a contract cannot state."""
    out = F.lit(None).cast("string")
    for name, template in AGG_SQL.items():
        head, tail = template.split("{x}")
        text = F.concat(F.lit(head), expr, *([F.lit(", "), p, F.lit(")")] if "{p}" in tail else [F.lit(tail)]))
        out = F.when(F.lower(agg) == name, text).otherwise(out)
    return out


def base_metrics(models, entities, dimensions, measures, metrics) -> DataFrame:
    """Simple metrics, measures that define one themselves, and the kinds a contract cannot state."""
    prefix = models.select("model", "primary_entity")
    dims = dimensions.filter("type = 'categorical'").join(prefix, "model").select(
        F.col("model").alias("reachable"), F.concat_ws("__", "primary_entity", "name").alias("dim"))
    cat = JN.entity_reach(entities).join(dims, "reachable").groupBy("model").agg(F.collect_set("dim").alias("_cat"))
    named = metrics.filter("type = 'simple'").select("metric_id", "measure", "time_grain")
    own = measures.filter("create_metric").select(F.col("measure").alias("metric_id"), "measure", F.lit(None).cast("string").alias("time_grain"))
    simple = named.unionByName(own.join(named.select("metric_id"), "metric_id", "left_anti"))
    m = simple.join(measures, "measure").join(models.select("model", "agg_grain"), "model").join(cat, "model", "left")
    text = formula_of(F.col("agg"), F.col("expr"), F.lit("0.5"))
    least = grain_at(F.greatest(rank(F.col("agg_grain")), rank(F.coalesce("time_grain", "agg_grain"))))
    m = m.withColumn("formula", text).withColumn("grain", least)
    ok = F.col("formula").isNotNull()
    rows = m.select(
        "metric_id", F.lit("simple").alias("metric_type"), ok.alias("answerable"), F.coalesce("formula", F.lit("")).alias("formula"),
        F.when(ok, F.sort_array(F.concat(F.coalesce("_cat", none()), time_dims(F.col("grain"))))).otherwise(none()).alias("allowed"), "grain",
        F.when(ok, F.array(F.concat(F.lit("measure."), "measure"))).otherwise(none()).alias("coverage"), none().alias("numerator_nodes"), none().alias("denominator_nodes"))
    lost = metrics.filter("type in ('cumulative', 'conversion')").select(
        "metric_id", F.col("type").alias("metric_type"), F.lit(False).alias("answerable"), F.lit("").alias("formula"), none().alias("allowed"), F.lit("").alias("grain"),
        none().alias("coverage"), none().alias("numerator_nodes"), none().alias("denominator_nodes"))
    return rows.unionByName(lost)


def resolve(pending: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pending metrics all of whose inputs are resolved, combined from them.

    Allowed dimensions intersect, the coarsest grain wins, coverage adds up, one lost input loses the metric.
    """
    i = pending.select("metric_id", F.size("inputs").alias("_n"), F.explode("inputs").alias("i")).select("metric_id", "_n", F.col("i.alias").alias("alias"), F.col("i.name").alias("input"))
    r = resolved.select(F.col("metric_id").alias("input"), "answerable", "formula", "allowed", "grain", "coverage")
    g = i.join(r, "input").groupBy("metric_id", "_n").agg(
        F.count(F.lit(1)).alias("_have"), F.bool_and("answerable").alias("ok"), F.collect_list("allowed").alias("_allowed"),
        F.max(F.when(F.col("grain") != "", rank(F.col("grain"))).otherwise(1)).alias("_g"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("coverage")))).alias("_cov"),
        F.map_from_entries(F.collect_list(F.struct("alias", "input"))).alias("_in"), F.map_from_entries(F.collect_list(F.struct("alias", "formula"))).alias("_f"),
    ).filter("_have = _n")
    p = pending.join(g, "metric_id")
    ok, ratio = F.col("ok"), F.col("type") == "ratio"
    g = F.when(F.col("time_grain").isNull(), F.col("_g")).otherwise(F.greatest("_g", rank(F.col("time_grain"))))
    both = F.sort_array(F.reduce(F.slice("_allowed", 2, F.size("_allowed")), F.element_at("_allowed", 1), lambda a, b: F.array_intersect(a, b)))
    times = F.filter(both, lambda d: ~d.startswith("metric_time__"))
    allowed = F.when(F.col("time_grain").isNull(), both).otherwise(F.sort_array(F.concat(times, time_dims(grain_at(g)))))
    has = F.contains("expr", F.lit("/"))
    side = lambda n: F.regexp_extract_all(F.get(F.split("expr", "/", 2), F.lit(n)), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    nodes = lambda n: F.sort_array(F.array_distinct(F.filter(F.transform(side(n), lambda a: F.try_element_at(F.col("_in"), a)), lambda x: x.isNotNull())))
    pick = lambda name, n: F.when(ratio, F.array(F.element_at("_in", F.lit(name)))).when(has & ok, nodes(n)).otherwise(none())
    of = lambda name: F.element_at("_f", F.lit(name))
    text = F.when(ratio, F.concat(F.lit("("), of("numerator"), F.lit(") / NULLIF(("), of("denominator"), F.lit("), 0)"))).otherwise(F.col("expr"))
    return p.select(
        "metric_id", F.col("type").alias("metric_type"), ok.alias("answerable"), F.when(ok, text).otherwise("").alias("formula"), F.when(ok, allowed).otherwise(none()).alias("allowed"),
        F.when(ok, grain_at(g)).otherwise("").alias("grain"), F.when(ok, F.col("_cov")).otherwise(none()).alias("coverage"), pick("numerator", 0).alias("numerator_nodes"), pick("denominator", 1).alias("denominator_nodes"))


def contract_of_manifest(models, entities, dimensions, measures, metrics) -> DataFrame:
    """The metric catalog of a manifest; ratio and derived metrics resolve level by level."""
    done = checkpointed(base_metrics(models, entities, dimensions, measures, metrics))
    pending = checkpointed(metrics.filter("type in ('ratio', 'derived')"))
    while not pending.isEmpty():
        level = checkpointed(resolve(pending, done))
        if level.isEmpty():
            raise ValueError("metrics with unresolved inputs remain")
        done = done.unionByName(level)
        pending = checkpointed(pending.join(level.select("metric_id"), "metric_id", "left_anti"))
    return done


def edges_of(contract: DataFrame, parents: DataFrame, measures: DataFrame, models: DataFrame):
    """Typed edges and physical bindings of a metric catalog."""
    each = lambda c: contract.select("metric_id", F.explode(c).alias("x"))
    edge = lambda df, kind, src, dst: df.select(F.lit(kind).alias("edge_type"), src.alias("src"), dst.alias("dst"))
    m, x = F.col("metric_id"), F.col("x")
    policy = F.when(F.col("answerable"), X.lit_list(["sql_or_ddl_policy", "authorized_dimension_scope_policy"])).otherwise(X.lit_list(["undefined_or_unsupported_metric_policy"]))
    edges = (
        edge(each("allowed"), "measures_of", m, x).unionByName(edge(each("numerator_nodes"), "numerator_of", x, m)).unionByName(edge(each("denominator_nodes"), "denominator_of", x, m))
        .unionByName(edge(each(policy), "governed_by", m, x)).unionByName(edge(parents.filter("parent <> ''"), "rolls_up_to", F.col("child"), F.col("parent"))))
    where = measures.join(models.select("model", "physical"), "model").select(F.concat(F.lit("measure."), "measure").alias("x"), "physical")
    bindings = each("coverage").join(where, "x").select("metric_id", F.col("x").alias("dependency_node_id"), F.col("physical").alias("physical_node_id"))
    return edges, bindings


def inexpressible(metrics: DataFrame, dimensions: DataFrame, edges: DataFrame, all_dims: list) -> DataFrame:
    """(family, object, detail) rows a plain semantic layer cannot carry."""
    row = lambda df, family, obj, detail: df.select(F.lit(family).alias("family"), F.concat(*obj).alias("object"), detail.alias("detail"))
    metric = [F.lit("metric:"), F.col("metric_id")]
    denied = F.sort_array(F.array_except(X.lit_list(all_dims), F.col("allowed_dimensions")))
    served = metrics.filter("answerable")
    return (
        row(dimensions.filter("parent <> ''"), "granularity_hierarchy", [F.lit("dimension:"), F.col("child")], F.col("parent"))
        .unionByName(row(served.filter("contains(formula, 'NULLIF') AND contains(formula, '/')"), "formula_guard", metric, F.col("formula")))
        .unionByName(row(metrics.filter("NOT answerable"), "unsupported_metric_policy", metric, F.lit("refuse")))
        .unionByName(row(served.filter(F.size(denied) > 0), "metric_dimension_reachability", metric, F.array_join(denied, "|")))
        .unionByName(row(edges.filter("edge_type = 'governed_by' AND dst = 'aggregate_only_policy'"), "disclosure_policy", [F.lit("column:"), F.col("src")], F.col("dst")))
    )

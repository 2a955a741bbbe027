"""From accepted decisions to metric values: all plans of a request log in a few scans."""

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import metrics as M

# Sums each metric needs. Order-level metrics never go below the order, so they read one row per order.
LINE_SUMS = {
    "rev": "l_extendedprice * (1 - l_discount)", "qty": "l_quantity", "gross": "l_extendedprice",
    "ret": "l_quantity * is_return", "disc": "l_extendedprice * l_discount",
}
LINE_METRICS = {
    "revenue": "rev", "units": "qty", "average_unit_price": "gross / nullif(qty, 0)", "return_share": "ret / nullif(qty, 0)", "discount_amount": "disc",
}
ORDER_METRICS = {"order_count": "cast(orders as double)", "average_order_value": "rev / nullif(orders, 0)"}

def dimension_sets(plans: DataFrame) -> list:
    """The distinct dimension sets of a plan log: at most two to the power of the dimensions, whatever the log's size."""
    rows = plans.select("dims").distinct().collect()
    return sorted([d for d in r["dims"].split("|") if d] for r in rows)


def metric_rows(grouped: DataFrame, metrics: dict) -> DataFrame:
    """(dims, key, metric, value) of wide sums."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("value")) for m, e in metrics.items()]
    return grouped.select("dims", "key", F.explode(F.array(*pairs)).alias("x")).select("dims", "key", "x.*")


def values_of(plans: DataFrame, fact: DataFrame, dims: dict, parents=None) -> DataFrame:
    """Values of every (metric, dims) plan: one pass over lines and one over orders."""
    mine = lambda names: plans.filter(F.col("metric").isin(*names))
    lines, orders = mine(list(LINE_METRICS)), mine([*ORDER_METRICS, "customer_count"])
    by_line = M.grouping_sets(fact, dims, dimension_sets(lines), [(n, F.expr(e)) for n, e in LINE_SUMS.items()], parents)
    keep = [e for e in ("r_name", "n_name", "c_name", "c_mktsegment", "o_orderdate", "o_orderpriority")]
    heads = fact.groupBy("o_orderkey", "o_custkey", *keep).agg(F.sum(F.expr(LINE_SUMS["rev"])).alias("rev"))
    head_sets = dimension_sets(orders)
    by_order = M.grouping_sets(heads, dims, head_sets, [("rev", F.col("rev")), ("orders", F.lit(1))], parents)
    rows = metric_rows(by_line, LINE_METRICS).unionByName(metric_rows(by_order, ORDER_METRICS)).unionByName(buyers(heads, dims, dimension_sets(mine(["customer_count"]))))
    return plans.join(rows, ["metric", "dims"])


def buyers(heads: DataFrame, dims: dict, sets) -> DataFrame:
    """Distinct customers per dimension set, counted in place where the orders are dealt by customer; only counts move on."""
    used = sorted({d for s in sets for d in s})
    bit = {d: 1 << i for i, d in enumerate(used)}
    masks = F.array(*[F.lit(sum(bit[d] for d in s)) for s in sets]).cast("array<bigint>")
    in_set = lambda d: F.col("_set").bitwiseAND(F.lit(bit[d]).cast("long")) != 0
    base = heads.select("o_custkey", *[F.expr(dims[d]).alias(d) for d in used]).repartition("o_custkey").distinct()
    each = base.withColumn("_set", F.explode(masks))
    plan = F.concat_ws("|", *[F.when(in_set(d), F.lit(d)) for d in used])
    key = F.concat_ws("|", *[F.when(in_set(d), F.coalesce(F.col(d).cast("string"), F.lit(""))) for d in used])
    g = each.select("o_custkey", "_set", *[F.when(in_set(d), F.col(d)).alias(d) for d in used]).distinct()
    return g.groupBy(plan.alias("dims"), key.alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("customer_count"))


def execution_log(plans: DataFrame, values: DataFrame) -> DataFrame:
    """Per plan: it ran, how many rows it returns, and its highest value."""
    per = values.groupBy("metric", "dims").agg(F.count(F.lit(1)).alias("row_count"), F.max("value").alias("top_value"))
    return plans.join(per, ["metric", "dims"], "left").withColumn("execute_ok", F.col("row_count").isNotNull())

"""Accepted plans as grouped aggregates over fact tables."""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators import scale

# Time grains from fine to coarse, and strict containment (a week nests in nothing).
GRAINS = ["hour", "day", "week", "month", "quarter", "year"]
GRAIN_PARENT = {"hour": "day", "day": "month", "week": "", "month": "quarter", "quarter": "year", "year": ""}

# Groups that one task of a dealt fact holds, on average.
GROUPS_IN_TASK = 1_000_000


def simple_aggregates(value, flag) -> list:
    """The aggregates a metric may name, except the order statistics."""
    v = F.col(value)
    return [
        F.sum(v).alias("sum"), F.count(v).alias("count"), F.count_distinct(v).alias("count_distinct"), F.avg(v).alias("average"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.sum(F.col(flag).cast("int")).alias("sum_boolean"),
    ]


def percentiles(df: DataFrame, keys, value, fractions: dict, width=1.0) -> DataFrame:
    """Exact interpolated percentiles per key from ranks of distinct values; no group is gathered in one place."""
    ranks = scale.value_ranks(df, value, keys, width)
    at = lambda p: F.lit(p) * (F.col("total") - 1)
    out = []
    for name, p in fractions.items():
        lo, hi = scale.value_at(F.floor(at(p)) + 1), scale.value_at(F.ceil(at(p)) + 1)
        frac = F.max(at(p) - F.floor(at(p)))
        out.append((lo + (hi - lo) * frac).alias(name))
    return ranks.groupBy(*keys).agg(*out)


def ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


def star(lineitem, orders, customer, nation, region, part) -> DataFrame:
    """The sales fact with every dimension column; the planner broadcasts the sides it knows to be small."""
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyer = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
    head = orders.join(buyer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    lines = lineitem.join(part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    return lines.join(head, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("is_return", (F.col("l_returnflag") == "R").cast("int"))


def plan_group(fact: DataFrame, dims: dict, value: Column, top=20) -> DataFrame:
    """One accepted plan: dimensions, its value, highest first; without dimensions a single row."""
    if not dims:
        return fact.agg(value.alias("metric_value"))
    grouped = fact.groupBy(*[F.expr(e).alias(d) for d, e in dims.items()]).agg(value.alias("metric_value"))
    return grouped.orderBy(F.desc("metric_value"), *dims).limit(top)


def ancestors_of(d, parents: dict) -> list:
    """The coarser dimensions that a dimension determines, by a child-to-parent map."""
    out, at = [], parents.get(d)
    while at and at not in out:
        out.append(at)
        at = parents.get(at)
    return out


def cuboid_size(s, sizes: dict, rows, parents: dict) -> int:
    """Upper bound of the rows of a cuboid: the product of the distinct counts of its finest dimensions."""
    coarser_ones = {a for d in s for a in ancestors_of(d, parents)}
    n = 1
    for d in s - coarser_ones:
        n = min(rows, n * max(1, sizes[d]))
    return n


def cuboids(sets, sizes: dict, rows, parents=None, share=0.1) -> dict:
    """Which base cuboid each dimension set is rolled up from: base (a frozenset) -> its sets.

    The size of a cuboid is bounded by the product of the distinct counts of its finest dimensions, and by the rows of
    the fact; a base also holds what its dimensions determine. Sets merge into a base while it stays within `share` of
    the fact. Sets that are larger themselves are rolled up from one base of their union.
    """
    parents = parents or {}
    closed = lambda s: frozenset(s).union(*[ancestors_of(d, parents) for d in s])
    size = lambda s: cuboid_size(s, sizes, rows, parents)
    limit, large = max(1, rows * share), frozenset()
    small = []
    every = sorted({tuple(sorted(s)) for s in sets}, key=lambda s: (-size(closed(s)), s))
    for s in every:
        c = closed(s)
        if size(c) > limit:
            large |= c
        elif not any(c <= b for b in small):
            fits = [(size(b | c), i) for i, b in enumerate(small) if size(b | c) <= limit]
            if fits:
                small[min(fits)[1]] |= c
            else:
                small.append(c)
    out = {}
    for s in every:
        c = closed(s)
        base = large if size(c) > limit else min((b for b in small if c <= b), key=lambda b: (size(b), sorted(b)))
        out.setdefault(base, []).append(list(s))
    return out


def hubs(lattice: dict, sizes: dict, rows, parents: dict, share=0.1, least=1000) -> tuple:
    """(lattice, hub dimension -> its sets): the sets of a base above its share that have a dimension of many values.

    All sets with one such dimension are grouped in place once the fact is dealt by it, so the fact moves once for all of
    them and not once per set. What stays shares a base of what is left.
    """
    out, dealt = {}, {}
    for base, own in lattice.items():
        rest = own
        if cuboid_size(base, sizes, rows, parents) > max(1, rows * share):
            hub = lambda s: max(((sizes[d], d) for d in s), default=(0, None))
            for s in own:
                if hub(s)[0] >= least:
                    dealt.setdefault(hub(s)[1], []).append(s)
            rest = [s for s in own if hub(s)[0] < least]
            base = frozenset(d for s in rest for e in s for d in [e, *ancestors_of(e, parents)])
        if rest:
            out.setdefault(base, []).extend(rest)
    return out, dealt


def dimension_sizes(fact: DataFrame, dims: dict) -> tuple:
    """(rows, estimated distinct values per dimension) in one scan."""
    got = fact.agg(F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(F.expr(e)).alias(d) for d, e in dims.items()]).first()
    return got["_rows"], {d: got[d] for d in dims}


def grouping_sets(fact: DataFrame, dims: dict, sets, values, parents=None, share=0.1) -> DataFrame:
    """Every dimension set of a list in one scan, through a lattice of cuboids.

    The scan sums the fact into a few base cuboids (see `cuboids`); each set is then rolled up from the rows of its
    base, so the work that repeats per set is bounded by the base, not by the fact table. Sets that are nearly as large as
    the fact are grouped in place where the fact is dealt by their largest dimension (see `hubs`). `values` are (name, column)
    sums; `parents` maps a dimension to the coarser one it determines.
    """
    wanted = sorted({tuple(sorted(s)) for s in sets})
    used = sorted({d for s in wanted for d in s})
    if not used:
        one = fact.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(n) for n, c in values])
        return one.filter(F.lit(bool(wanted))).select(F.lit("").alias("dims"), F.lit("").alias("key"), *[n for n, _ in values])
    known = {d: p for d, p in (parents or {}).items() if p in dims}
    held = sorted({a for d in used for a in [d, *ancestors_of(d, known)]})
    rows, sizes = dimension_sizes(fact, {d: dims[d] for d in held})
    lattice, dealt = hubs(cuboids(wanted, sizes, rows, known, share), sizes, rows, known, share)
    bit = {d: 1 << i for i, d in enumerate(held)}
    mask = lambda s: sum(bit[d] for d in s)
    masks = lambda own: F.array(*[F.lit(mask(s)).cast("long") for s in own])
    in_set = lambda d: F.col("_set").bitwiseAND(F.lit(bit[d]).cast("long")) != 0
    keyed = fact.select(*[F.expr(dims[d]).alias(d) for d in held], *[c.alias(f"_v_{n}") for n, c in values])
    parts = []
    for hub, own in dealt.items():
        # as many partitions as keep the groups of one in memory
        each = keyed.repartition(1 + rows * len(own) // GROUPS_IN_TASK, F.col(hub)).withColumn("_set", F.explode(masks(own)))
        kept = each.select("_set", *[F.col(d) if d == hub else F.when(in_set(d), F.col(d)).alias(d) for d in held], *[f"_v_{n}" for n, _ in values])
        parts.append(kept.groupBy("_set", *held).agg(*[F.sum(f"_v_{n}").alias(n) for n, _ in values]))
    if lattice:
        grouped = keyed.groupingSets([[F.col(d) for d in sorted(b)] for b in lattice], *[F.col(d) for d in held])
        absent = lambda d: F.when(F.grouping(d) == 0, F.lit(bit[d]).cast("long")).otherwise(F.lit(0).cast("long"))
        base = grouped.agg(*[F.sum(f"_v_{n}").alias(n) for n, _ in values], sum((absent(d) for d in held), F.lit(0).cast("long")).alias("_base"))
        rolled = F.lit(None).cast("array<bigint>")
        for b, own in lattice.items():
            rolled = F.when(F.col("_base") == mask(b), masks(own)).otherwise(rolled)
        each = base.withColumn("_set", F.explode(rolled))
        kept = each.select("_set", *[F.when(in_set(d), F.col(d)).alias(d) for d in held], *[n for n, _ in values])
        parts.append(kept.groupBy("_set", *held).agg(*[F.sum(n).alias(n) for n, _ in values]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    plan = F.concat_ws("|", *[F.when(in_set(d), F.lit(d)) for d in held])
    key = F.concat_ws("|", *[F.when(in_set(d), F.coalesce(F.col(d).cast("string"), F.lit(""))) for d in held])
    return out.select(plan.alias("dims"), key.alias("key"), *[n for n, _ in values])


def coarser(a: str, b: str) -> str:
    return max(a, b, key=GRAINS.index)


def grains_from(least: Column) -> Column:
    """Grains at or above the least one, as an array."""
    every = F.array(*[F.lit(g) for g in GRAINS])
    return F.slice(every, F.array_position(every, least).cast("int"), len(GRAINS))


def truncated(ts: Column, grain: Column) -> Column:
    out = F.lit(None).cast("timestamp")
    for g in GRAINS:
        out = F.when(grain == g, F.date_trunc(g, ts)).otherwise(out)
    return out


def by_grain(df: DataFrame, ts, least: Column, keys=()) -> DataFrame:
    """Count and sum per period of every grain a row's metric may be asked at."""
    e = df.withColumn("grain", F.explode(grains_from(least))).withColumn("period", truncated(F.col(ts), F.col("grain")))
    parent = F.create_map(*[F.lit(x) for kv in GRAIN_PARENT.items() for x in kv])
    return e.groupBy(*keys, "grain", "period").agg(F.count(F.lit(1)).alias("n")).withColumn("parent", F.try_element_at(parent, F.col("grain")))


def on_spine(df: DataFrame, day, keys, value: Column, fill=0) -> DataFrame:
    """Daily values without gaps between each key's first and last day."""
    daily = df.groupBy(*keys, F.to_date(day).alias("day")).agg(value.alias("value"))
    spine = daily.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(daily, [*keys, "day"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def period_compare(series: DataFrame, period, keys, value, months=12) -> DataFrame:
    """A periodic metric beside its value the given months earlier."""
    before = series.select(*keys, F.add_months(period, months).alias(period), F.col(value).alias("previous"))
    return series.join(before, [*keys, period], "left")


def parity(a: DataFrame, b: DataFrame, checks: dict) -> DataFrame:
    """Named aggregates of two copies side by side."""

    def side(df, name):
        row = df.agg(*[c.cast("string").alias(k) for k, c in checks.items()])
        return row.unpivot([], list(checks), "check", name)

    return side(a, "left_value").join(side(b, "right_value"), "check").withColumn("match", F.col("left_value").eqNullSafe(F.col("right_value")))


def schema_tests(df: DataFrame, unique=(), not_null=()) -> DataFrame:
    """Failing rows per declared column test."""
    rows = F.count(F.lit(1))
    aggs = [(rows - F.count_distinct(c)).alias(f"unique:{c}") for c in unique]
    aggs += [(rows - F.count(c)).alias(f"not_null:{c}") for c in not_null]
    names = [f"unique:{c}" for c in unique] + [f"not_null:{c}" for c in not_null]
    return df.agg(*aggs).unpivot([], names, "test", "failures")


def table_profile(df: DataFrame, name, samples=3, clip=100) -> DataFrame:
    """One row per column: type, rows, filled rows, and the first distinct values in order."""
    from plumbline.functions import text as X

    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    counts = cells.groupBy("col").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("filled"))
    distinct = cells.filter("v is not null").distinct()
    few = scale.first_k(distinct, ["col"], ["v"], samples).groupBy("col").agg(F.sort_array(F.collect_list(X.clip(F.col("v"), clip))).alias("values"))
    types = F.create_map(*[F.lit(x) for kv in df.dtypes for x in kv])
    return counts.join(few, "col", "left").select(F.lit(name).alias("tbl"), "col", F.try_element_at(types, F.col("col")).alias("type"), "rows", "filled", "values")

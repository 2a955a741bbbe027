"""Logical joins: lookups, closures, tiered matches, pairings."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions import text as X
from plumbline.operators import scale
from plumbline.session import checkpointed


def same_keys(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Keys that only one of two inputs has, with the side that has it."""
    side = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(1))
    both = side(a, "l").join(side(b, "r"), key, "full_outer")
    return both.filter("l is null or r is null").select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def alias_join(texts: DataFrame, key, text, aliases: DataFrame, alias="alias") -> DataFrame:
    """Alias rows that occur in a text, for alias tables of any size.

    An alias meets the texts that have the one of its words (of its unusual characters, if it has any) that the fewest
    aliases share; the boundary rule is checked on what meets and occurs at all. Words that many aliases share thus bring
    none of them up that have a rarer one.
    """
    plain = F.col(alias).rlike("^[a-z0-9_ ]+$")
    words = lambda c: F.regexp_extract_all(c, F.lit("([a-z0-9_]+)"), F.lit(1))
    odd = lambda c: F.regexp_extract_all(c, F.lit("([^a-z0-9_ ])"), F.lit(1))
    parts = aliases.select(alias).filter(F.col(alias) != "").distinct().select(alias, F.explode(F.array_distinct(F.when(plain, words(alias)).otherwise(odd(alias)))).alias("_key"))
    shared = parts.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    keyed = parts.join(shared, "_key").groupBy(alias).agg(F.min(F.struct("_n", "_key"))["_key"].alias("_key"))
    probe = texts.select(key, text, F.explode(F.array_distinct(F.concat(words(text), odd(text)))).alias("_key"))
    # a pattern is made for each pair that it sees
    met = probe.join(keyed, "_key").filter(F.contains(F.col(text), F.col(alias)) & X.contains_alias(F.col(text), F.col(alias))).select(key, alias)
    return met.join(aliases, alias).select(key, *aliases.columns)


def not_allowed(requested: DataFrame, allowed: DataFrame, metric="metric_id", dim="dim") -> DataFrame:
    """Requested (metric, dimension) rows a metric does not allow; a metric that lists none allows all."""
    restricted = allowed.select(metric).distinct()
    return requested.join(restricted, metric, "left_semi").join(allowed.select(metric, dim).distinct(), [metric, dim], "left_anti")


def unknown_members(df: DataFrame, catalog: DataFrame, on) -> DataFrame:
    return df.join(catalog.select(on), on, "left_anti")


def closure(parents: DataFrame) -> DataFrame:
    """(child, ancestor, depth) of a parent table of any depth; a cycle ends where it closes.

    Paths double: every round joins all known paths end to end, so the rounds grow with the logarithm of the depth.
    """
    found = checkpointed(parents.filter("parent <> ''").select("child", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)))
    state = None
    while True:
        now = found.agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("steps")).first()
        if now == state:
            return found
        state = now
        behind = found.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("depth").alias("_more"))
        longer = found.join(behind, "ancestor").select("child", F.col("_next").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        found = checkpointed(found.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))


def finest(requested: DataFrame, closed: DataFrame, key, dim="dim") -> DataFrame:
    """Requested dimensions that are no ancestor of another one of the same request."""
    above = requested.join(closed.select(F.col("child").alias(dim), "ancestor"), dim).select(key, F.col("ancestor").alias(dim)).distinct()
    return requested.join(above, [key, dim], "left_anti")


def coverage_gaps(nodes: DataFrame, bindings: DataFrame, assets: DataFrame) -> DataFrame:
    """Required (metric, node) rows that are unbound, or bound to something that is no asset."""
    real = assets.select(F.col("semantic_node_id").alias("physical_node_id")).distinct().withColumn("_real", F.lit(True))
    b = bindings.select("metric_id", F.col("dependency_node_id").alias("node"), "physical_node_id", F.lit(True).alias("_bound"))
    j = nodes.join(b, ["metric_id", "node"], "left").join(real, "physical_node_id", "left")
    problem = F.when(F.col("_bound").isNull(), "missing_binding").when(F.col("_real").isNull(), "missing_physical_asset")
    return j.select("metric_id", "node", F.coalesce("physical_node_id", F.lit("")).alias("physical_node_id"), problem.alias("problem")).filter("problem is not null").distinct()


def edge_contract(metrics: DataFrame, edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per ratio metric: declared sets equal its typed edges; per covered metric: required nodes are bound."""
    side = lambda kind: F.collect_set(F.when(F.col("edge_type") == kind, F.col("src")))
    e = edges.filter(F.col("metric_id").isNotNull()).groupBy("metric_id").agg(side("numerator_of").alias("_n"), side("denominator_of").alias("_d"))
    b = bindings.groupBy("metric_id").agg(F.collect_set("dependency_node_id").alias("_b"))
    none = F.array().cast("array<string>")
    m = metrics.join(e, "metric_id", "left").join(b, "metric_id", "left")
    same = lambda want, have: F.sort_array(F.array_distinct(F.col(want))) == F.sort_array(F.coalesce(have, none))
    ok = F.when(F.col("scoped_ratio"), (F.size("numerator_nodes") > 0) & (F.size("denominator_nodes") > 0) & same("numerator_nodes", "_n") & same("denominator_nodes", "_d")).otherwise(True)
    return m.select("metric_id", ok.alias("edges_ok"), (F.size(F.array_except("coverage_nodes", F.coalesce("_b", none))) == 0).alias("bindings_ok"))


def entity_reach(entities: DataFrame) -> DataFrame:
    """(model, reachable) in one hop: the other side declares a shared entity primary or unique."""
    near = entities.select("entity", "model").distinct()
    far = entities.filter(F.col("type").isin("primary", "unique")).select("entity", F.col("model").alias("reachable")).distinct()
    return near.join(far, "entity").select("model", "reachable").distinct().union(entities.select("model", F.col("model").alias("reachable"))).distinct()


def mode_pair(scored: DataFrame, key, mode, a, b, value) -> DataFrame:
    """One row per case with the value under two modes; cases both modes have."""
    pick = lambda m: F.max(F.when(F.col(mode) == m, F.col(value)))
    return scored.filter(F.col(mode).isin(a, b)).groupBy(key).agg(pick(a).alias("left"), pick(b).alias("right")).filter("left is not null and right is not null")


def name_windows(name: Column) -> Column:
    """Every run of whole parts of a dotted, lower-case name."""
    parts = F.split(F.lower(name), r"\.")
    n = F.size(parts)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), ".")))
    return F.array_distinct(F.flatten(runs))


def window_match(names: DataFrame, name, targets: DataFrame, target) -> DataFrame:
    """Targets that equal a run of whole parts of a name."""
    w = names.withColumn("_w", F.explode(name_windows(F.col(name))))
    return w.join(targets.withColumn("_w", F.lower(target)), "_w").drop("_w").distinct()


#: Wishes, and catalog rows, of one name that stand in a block; a pair of blocks comes to the square of it.
TIER_BLOCK = 512


def listed(col) -> Column:
    """Aggregate: the distinct values as an array, null too."""
    return F.concat(F.collect_set(col), F.array_repeat(F.lit(None), F.max(F.col(col).isNull().cast("int"))))


def dealt(df: DataFrame, keys, of, weight="1") -> DataFrame:
    """Rows with `_s`, the block of about TIER_BLOCK (a row counts `weight`) that the hash of `of` deals them into within `keys`."""
    blocks = df.groupBy(*keys).agg(F.ceil(F.sum(F.expr(weight)) / TIER_BLOCK).cast("int").alias("_blocks")).hint("merge")
    return df.join(blocks, keys).withColumn("_s", F.pmod(F.xxhash64(*of), F.col("_blocks")).cast("int")).drop("_blocks")


def tiered_match(wanted: DataFrame, key, catalog: DataFrame, order, most=5) -> DataFrame:
    """Catalog rows for a (column, table) wish: exact table, else digits masked, else column only (first few).

    `catalog` has tbl, col and an order column; the first tier that finds something wins. Which tier settles a key follows
    from the distinct names alone. A common wish meets much of the catalog, so the result may grow as wishes times rows:
    wishes and rows of one name are dealt into blocks, pairs of blocks are spread over all tasks, and only there do they
    become rows. So what moves is linear in both tables, plus one row for some 500 found. Only keys with several wishes for
    one column can meet a row twice; theirs are told apart by table and column. Windows of names are far more bytes than the
    planner expects of their table, so they are merged, not broadcast.
    """
    at = ["_c", "_t"]
    in_tier = lambda n, name: F.concat(F.lit(f"{n} "), name)
    tier_of = F.substring("_t", 1, 1)

    rows = catalog.select("tbl", "col", order, F.lower("col").alias("_c")).filter("_c IS NOT NULL").distinct()
    groups = dealt(rows, ["_c", "tbl"], [order]).groupBy("_c", "tbl", "col", "_s").agg(listed(order).alias("_o")).withColumnRenamed("_s", "_g")
    names = rows.select("_c", "tbl").distinct()
    windows = lambda n, name: names.select("_c", F.explode(name_windows(name)).alias("_t"), "tbl").withColumn("_t", in_tier(n, F.col("_t")))

    w = wanted.select(key, F.lower("col").alias("_c"), F.lower("tbl").alias("_n")).filter("_c IS NOT NULL")
    asked = w.select("_c", "_n").distinct().withColumn("_t", F.explode(F.array(in_tier(1, F.col("_n")), in_tier(2, X.mask_digits(F.col("_n"))))))
    hits = windows(1, F.col("tbl")).union(windows(2, X.mask_digits(F.col("tbl")))).join(asked.select(*at).distinct().hint("merge"), at, "left_semi")
    name_in = lambda n: F.min(F.when(tier_of == str(n), F.col("_t"))).alias(f"_t{n}")
    found = asked.join(hits.select(*at).distinct().hint("merge"), at, "left_semi").groupBy("_c", "_n").agg(name_in(1), name_in(2))

    # a key that is null settles nothing
    exact, masked, any_ = F.col("_t1"), F.col("_t2"), F.lit("3 ")
    best = F.min(F.when(exact.isNotNull(), 1).when(masked.isNotNull(), 2).otherwise(3)).over(W.partitionBy(key))
    own = F.when(F.col("_best") == 1, exact).when(F.col("_best") == 2, masked).otherwise(any_)
    t = w.join(found, ["_c", "_n"], "left").withColumn("_best", best)
    t = t.select(key, "_c", F.explode(F.when(F.col(key).isNull(), F.array(exact, masked, any_)).otherwise(F.array(own))).alias("_t")).filter("_t IS NOT NULL")
    same = W.partitionBy(key, "_c", tier_of)
    t = t.withColumn("_several", F.min("_t").over(same) != F.max("_t").over(same))

    few = scale.first_k(catalog.withColumn("_c", F.lower("col")), ["_c"], [order], most).select("_c", "tbl", "col", order).distinct()
    loose = few.groupBy("_c", F.lit("3 ").alias("_t"), "tbl", "col").agg(listed(order).alias("_o"))
    held = hits.join(groups, ["_c", "tbl"]).select(*at, "tbl", "col", "_o", "_g").union(loose.withColumn("_g", F.lit(0)))
    held = dealt(held, at, ["tbl", "col", "_g"], "size(_o)").groupBy(*at, F.col("_s").alias("_g")).agg(F.collect_list(F.struct("tbl", "col", "_o")).alias("_r"))
    once = dealt(t.filter(~F.col("_several")), at, [key]).groupBy(*at, "_s").agg(listed(key).alias("_k"))
    # pairs are dealt by what they are pairs of: arrays may come in another order when a lost task runs again
    pairs = once.join(held.hint("merge"), at).select("_t", "_k", "_r", F.xxhash64(*at, "_s", "_g").alias("_p"))
    again = t.filter("_several").join(hits.hint("merge"), at).select(key, tier_of.alias("_t"), "_c", "tbl").distinct().join(groups, ["_c", "tbl"])
    pairs = pairs.union(again.select("_t", F.array(key), F.array(F.struct("tbl", "col", "_o")), F.xxhash64(key, "_t", "tbl", "col", "_g")))
    tasks = max(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted.sparkSession.sparkContext.defaultParallelism)
    tier = F.when(tier_of == "1", 1).when(tier_of == "2", 2).otherwise(3).alias("tier")
    flat = F.flatten(F.transform("_r", lambda r: F.transform(r["_o"], lambda o: F.struct(r["tbl"].alias("tbl"), r["col"].alias("col"), o.alias(order)))))
    return pairs.repartition(tasks, "_p").select(tier, "_k", F.inline(flat)).select(F.explode("_k").alias(key), "tbl", "col", order, "tier")


def similar_tables(columns: DataFrame, order) -> DataFrame:
    """Tables that differ only in digits and have the same columns, with the first of each family."""
    t = columns.groupBy("tbl").agg(F.sort_array(F.collect_set("col")).alias("_cols"), F.min(order).alias(order))
    fam = [X.remove_digits(F.col("tbl")).alias("stem"), F.sha2(F.array_join("_cols", "\u0001"), 256).alias("_f")]
    f = t.select("tbl", order, *fam)
    first = f.groupBy("stem", "_f").agg(F.min_by("tbl", order).alias("family"), F.count(F.lit(1)).alias("members"))
    return f.join(first, ["stem", "_f"]).select("tbl", "family", "members")


def contained_labels(labels: DataFrame, keys, label, gram=4, part="_part") -> DataFrame:
    """(keys, label, part) of all labels and the labels of the same keys that they contain, themselves included.

    A label is looked for where its rarest gram is: of its substrings of `gram` characters (a shorter label is its own) the
    one that the fewest labels of its keys have. So a label brings one row per character and length, not one per substring. Rows of grams compress so well that the
    planner takes them for small; they are merged, not broadcast.
    """
    size = F.length(label)
    cut = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(F.col(label), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    held = labels.filter(size > 0).select(*keys, label, F.explode(F.array_distinct(F.flatten(F.array(*[cut(n) for n in range(1, gram + 1)])))).alias("_g"))
    own = held.filter(F.length("_g") == F.least(size, F.lit(gram)))
    shared = held.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = own.join(shared.hint("merge"), [*keys, "_g"]).groupBy(*keys, F.col(label).alias(part)).agg(F.min(F.struct("_n", "_g"))["_g"].alias("_g"))
    return held.join(rarest.hint("merge"), [*keys, "_g"]).filter(F.col(label).contains(F.col(part))).select(*keys, label, part)


#: Rows of the containing side that one task pairs with all rows of a label.
PAIR_BLOCK = 4096


def relationships(columns: DataFrame, links: DataFrame) -> DataFrame:
    """Candidate foreign keys between tables of one database.

    Same type, equal or contained names once `id` carries its table's name, exactly one sole key side or any key
    on one side, not linked already. Contained names are found once per different label, see contained_labels.

    Pairs stream out of their join: a column knows the tables it is linked to, and a pair comes once by the way it is
    made, so only those of columns that are listed in several ways are told apart afterwards. Columns of a frequent label
    are dealt into blocks, each of which meets all that the label holds.
    """
    label = F.when(F.lower("col") == "id", F.concat("tbl", F.lit("_id"))).otherwise(F.lower("col"))
    c = columns.filter(F.length("col") > 1).select("db", "type", "tbl", "col", label.alias("label"), "is_pk", "sole_pk", "seq").distinct()
    near = contained_labels(c.select("db", "type", "label").distinct(), ["db", "type"], "label").hint("merge")
    linked = links.groupBy("db", F.col("fk_tbl").alias("tbl"), F.col("fk_col").alias("col")).agg(F.collect_set("pk_tbl").alias("linked")).hint("merge")
    c = c.withColumn("several", F.count(F.lit(1)).over(W.partitionBy("db", "tbl", "col")) > 1).join(linked, ["db", "tbl", "col"], "left")
    side = lambda df, p: df.select("db", "type", *[F.col(x).alias(f"{p}{x}") for x in ("tbl", "col", "label", "is_pk", "sole_pk", "seq", "several", "linked")])
    long = side(c, "l_").join(near.withColumnRenamed("label", "l_label"), ["db", "type", "l_label"])
    short = side(c, "s_").withColumnRenamed("s_label", "_part")
    blocks = long.groupBy("db", "type", "_part").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("_blocks")).hint("merge")
    long = long.join(blocks, ["db", "type", "_part"]).withColumn("_block", F.pmod(F.xxhash64("l_tbl", "l_col"), F.col("_blocks")).cast("int")).drop("_blocks")
    short = short.join(blocks, ["db", "type", "_part"]).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    # equal labels meet both ways round, which comes to the same unless two keys have no order
    is_key = lambda p: F.coalesce(f"{p}_is_pk", F.lit(False))
    again = (F.col("l_label") == F.col("_part")) & (~is_key("l") | (is_key("s") & F.coalesce(F.col("s_seq") < F.col("l_seq"), F.lit(False))))
    # the key side is the first table of the catalog that has one
    left_first = F.col("l_seq") < F.col("s_seq")
    from_left = F.when(F.col("l_is_pk") & F.col("s_is_pk"), left_first).otherwise(F.col("l_is_pk"))
    pick = lambda yes, no, x: F.when(from_left, F.col(f"{yes}_{x}")).otherwise(F.col(f"{no}_{x}"))

    def met(left, right):
        pairs = left.join(right.hint("merge"), ["db", "type", "_part", "_block"]).filter("l_tbl <> s_tbl AND NOT (l_sole_pk AND l_is_pk AND s_sole_pk AND s_is_pk) AND (l_is_pk OR s_is_pk)")
        out = pairs.filter(~again).select(
            "db", pick("l", "s", "tbl").alias("pk_tbl"), pick("l", "s", "col").alias("pk_col"), pick("s", "l", "tbl").alias("fk_tbl"), pick("s", "l", "col").alias("fk_col"), pick("s", "l", "linked").alias("_linked"))
        return out.filter(~F.coalesce(F.array_contains("_linked", F.col("pk_tbl")), F.lit(False))).drop("_linked")

    once, twice = (lambda df, p: df.filter(~F.col(f"{p}_several"))), (lambda df, p: df.filter(f"{p}_several"))
    return met(once(long, "l"), once(short, "s")).union(met(twice(long, "l"), short).union(met(once(long, "l"), twice(short, "s"))).distinct())


def next_in_group(df: DataFrame, keys, pos, bucket) -> DataFrame:
    """Each row with the next one of its group: the links that connect all pairs, without listing the pairs."""
    p = scale.positions(df, [pos], bucket, keys, "_p")
    nxt = p.select(*keys, (F.col("_p") - 1).alias("_p"), F.col(pos).alias("next"))
    return p.join(nxt, [*keys, "_p"]).drop("_p")


def pair_counts(df: DataFrame, keys) -> DataFrame:
    """How many pairs each group stands for."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg((n * (n - 1) / 2).cast("bigint").alias("pairs")).filter("pairs > 0")


def source_selection(errors: DataFrame, priority: dict) -> DataFrame:
    """Source with the fewest errors per database, then by source order."""
    rank = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    order = F.struct("errors", F.try_element_at(rank, F.col("source")).alias("p"))
    return errors.groupBy("db").agg(F.min_by("source", order).alias("source"), F.min("errors").alias("errors"))


def nested_expand(selected: DataFrame, nested: DataFrame, on="tbl") -> DataFrame:
    """A selected column with its nested leaves; a column without leaves stays itself."""
    n = nested.select(on, F.lower(F.split_part(F.col("leaf"), F.lit("."), F.lit(1))).alias("_c"), "leaf", F.contains("leaf", F.lit(".")).alias("_nested"))
    j = selected.withColumn("_c", F.lower("col")).join(n, [on, "_c"])
    return j.filter(F.col("_nested") | (F.col("leaf") == F.col("col"))).drop("_c", "_nested").distinct()

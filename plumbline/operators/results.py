"""Comparison of result sets held as cells (instance, candidate, row_no, col, value).

Columns with the same content are one class; a class is ranked and compared once, however many candidates hold it.
Classes are equal when their numbers, sorted, differ by no more than a tolerance and all else is the same.
"""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators import scale
from plumbline.session import checkpointed

CELL = ["instance", "candidate", "row_no", "col", "value"]
TOLERANCE = 1e-2


def content(*cols) -> Column:
    """Order-free fingerprint of a group of values: their number and two sums of independent hashes."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)"))
    return F.concat_ws("/", F.count(F.lit(1)).cast("string"), h(1).cast("string"), h(2).cast("string"))


def column_classes(cells: DataFrame, who: str, ordered=False, tol=TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(instance, who, col, cls) of all columns, and the pairs (instance, cls, other) of equal classes, both ways, not reflexive.

    Equal columns have means, least and greatest numbers within the tolerance: classes meet in buckets of means and their
    neighbours, and what meets is compared rank by rank. Order counts only if `ordered`.
    """
    c = cells.select("instance", who, "row_no", "col", "value").withColumn("num", F.col("value").try_cast("double"))
    at = []
    if ordered:
        c, at = scale.positions(c, ["row_no"], F.floor(F.col("row_no") / 65536), ["instance", who, "col"], "rank"), ["rank"]
    text = F.when(F.col("num").isNull(), F.coalesce("value", F.lit("\u0000")))
    # one row per column: what follows reads these, the cells only once more
    sig = checkpointed(c.groupBy("instance", who, "col").agg(
        content(F.coalesce("value", F.lit("\u0000")), *at).alias("cls"), content(F.coalesce(text, F.lit("\u0001")), *at).alias("texts"), F.count("num").alias("nums"),
        F.avg("num").alias("mean"), F.min("num").alias("least"), F.max("num").alias("most")))
    one = sig.groupBy("instance", "cls").agg(F.min(F.struct(who, "col")).alias("rep"), *[F.first(x).alias(x) for x in ("texts", "nums", "mean", "least", "most")]).filter("nums > 0")
    bucket = F.floor(F.col("mean") / (2 * tol))
    left = one.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = one.withColumn("_b", bucket).select("instance", "texts", "nums", "_b", F.col("cls").alias("other"), F.col("rep").alias("rep2"), F.col("least").alias("l2"), F.col("most").alias("m2"))
    ends = (F.abs(F.col("least") - F.col("l2")) <= tol) & (F.abs(F.col("most") - F.col("m2")) <= tol)
    pairs = left.join(right, ["instance", "texts", "nums", "_b"]).filter((F.col("cls") < F.col("other")) & ends).select("instance", "cls", "other", "nums", "rep", "rep2")
    # numbers of the classes that met, by rank: from one column of each
    side = lambda cls, rep: pairs.select("instance", F.col(cls).alias("cls"), F.col(f"{rep}.{who}").alias(who), F.col(f"{rep}.col").alias("col"))
    met = side("cls", "rep").unionByName(side("other", "rep2")).distinct()
    numbers = c.filter("num IS NOT NULL").join(met, ["instance", who, "col"]).select("instance", "cls", "num", *at)
    if not ordered:
        numbers = scale.positions(numbers, ["num"], F.floor(F.col("num") / 100.0), ["instance", "cls"], "rank")
    a = pairs.select("instance", "cls", "other", "nums").join(numbers, ["instance", "cls"])
    b = numbers.select("instance", F.col("cls").alias("other"), "rank", F.col("num").alias("num2"))
    ok = a.join(b, ["instance", "other", "rank"]).groupBy("instance", "cls", "other").agg(F.bool_and(F.abs(F.col("num") - F.col("num2")) <= tol).alias("ok"), (F.count(F.lit(1)) == F.max("nums")).alias("all"))
    equal = ok.filter("ok AND all").select("instance", F.explode(F.array(F.struct("cls", "other"), F.struct(F.col("other").alias("cls"), F.col("cls").alias("other")))).alias("x")).select("instance", "x.*")
    return sig.select("instance", who, "col", "cls"), checkpointed(equal)


def covered(wanted: DataFrame, offered: DataFrame, equal: DataFrame) -> DataFrame:
    """(instance, w, o): every class of the result w equals some class of the result o; both sides have one row per class."""
    alike = wanted.select("instance", "w", "cls", F.col("cls").alias("other")).unionByName(wanted.join(equal, ["instance", "cls"]).select("instance", "w", "cls", "other"))
    met = alike.join(offered.select("instance", "o", F.col("cls").alias("other")), ["instance", "other"]).groupBy("instance", "w", "o").agg(F.count_distinct("cls").alias("n"))
    want = wanted.groupBy("instance", "w").agg(F.count(F.lit(1)).alias("want"))
    return met.join(want, ["instance", "w"]).filter("n = want").select("instance", "w", "o")


def column_match(pred: DataFrame, gold: DataFrame, ordered=False, tol=TOLERANCE) -> DataFrame:
    """Per (instance, candidate): every gold column equals some predicted column within the tolerance; null equals null."""
    who = F.struct(F.lit(1).alias("side"), F.col("candidate").cast("long").alias("candidate"))
    both = pred.select("instance", who.alias("who"), "row_no", "col", "value").unionByName(
        gold.select("instance", F.struct(F.lit(0).alias("side"), F.lit(None).cast("long").alias("candidate")).alias("who"), "row_no", "col", "value"))
    columns, equal = column_classes(both, "who", ordered, tol)
    held = columns.select("instance", "who", "cls").distinct()
    right = covered(held.filter("who.side = 0").withColumnRenamed("who", "w"), held.filter("who.side = 1").withColumnRenamed("who", "o"), equal)
    sides = held.groupBy("instance").agg(F.bool_or(F.col("who.side") == 0).alias("asked"), F.collect_set(F.when(F.col("who.side") == 1, F.col("who.candidate"))).alias("c")).filter("asked")
    every = sides.select("instance", F.explode("c").alias("candidate"))
    found = right.select("instance", F.col("o.candidate").alias("candidate"), F.lit(True).alias("match"))
    return every.join(found, ["instance", "candidate"], "left").select("instance", F.col("candidate").cast(pred.schema["candidate"].dataType).alias("candidate"), F.coalesce("match", F.lit(False)).alias("match"))


def table_equal(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Per (instance, candidate): same shape, columns align by name or else by content, and the rows are the same multiset.

    Both sides are read together, once for the columns and once for the rows.
    """
    text = F.coalesce(F.col("value"), F.lit("\u0000"))
    kind = pred.schema["candidate"].dataType
    both = pred.select("instance", F.lit(False).alias("gold"), "candidate", "row_no", "col", text.alias("v")).unionByName(
        gold.select("instance", F.lit(True).alias("gold"), F.lit(None).cast(kind).alias("candidate"), "row_no", "col", text.alias("v")))
    shape = both.groupBy("instance", "gold", "candidate", "col").agg(content("v").alias("f"), F.count(F.lit(1)).alias("n")).groupBy("instance", "gold", "candidate").agg(
        F.sort_array(F.collect_list(F.struct("col", "f"))).alias("cols"), F.max("n").alias("rows"))
    sides = shape.groupBy("instance").agg(
        F.max(F.when(F.col("gold"), F.struct("cols", "rows"))).alias("g"), F.collect_list(F.when(~F.col("gold"), F.struct("candidate", "cols", "rows"))).alias("p"))
    j = sides.filter("g IS NOT NULL").select("instance", F.col("g.cols").alias("gcols"), F.col("g.rows").alias("grows"), F.explode("p").alias("p")).select("instance", "gcols", "grows", "p.*")
    names = F.transform("gcols", lambda c: c["col"])
    free = lambda used: F.filter("gcols", lambda c: ~F.array_contains(used, c["col"]))

    def step(used, c):
        by_name = F.array_contains(names, c["col"]) & ~F.array_contains(used, c["col"])
        other = F.get(F.filter(free(used), lambda o: o["f"] == c["f"]), F.lit(0))["col"]
        return F.array_append(used, F.when(by_name, c["col"]).otherwise(F.coalesce(other, F.lit("\u0000"))))

    mapped = F.aggregate("cols", F.array().cast("array<string>"), step)
    a = j.withColumn("mapped", mapped).withColumn("aligned", (F.col("rows") == F.col("grows")) & (F.size("cols") == F.size("gcols")) & ~F.array_contains(F.col("mapped"), "\u0000"))
    order = lambda gold, who, cols: F.struct(F.lit(gold).alias("gold"), who.cast(kind).alias("who"), cols.alias("order"))
    reads = F.array(order(False, F.col("candidate"), F.transform("cols", lambda c: c["col"])), order(True, F.lit(None), F.col("mapped")))
    need = a.filter("aligned").select("instance", "candidate", F.explode(reads).alias("x")).select("instance", "candidate", "x.*")
    rows = both.groupBy("instance", "gold", F.col("candidate").alias("who"), "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("r"))
    met = rows.join(need.withColumnsRenamed({"gold": "gold2", "who": "who2", "instance": "instance2"}),
                    (F.col("instance") == F.col("instance2")) & (F.col("gold") == F.col("gold2")) & F.col("who").eqNullSafe(F.col("who2")))
    line = F.array_join(F.transform("order", lambda c: F.try_element_at("r", c)), "\u0001")
    prints = met.groupBy("instance", "candidate", "gold").agg(content(line).alias("f")).groupBy("instance", "candidate").agg((F.count_distinct("f") == 1).alias("same"))
    return a.select("instance", "candidate").join(prints, ["instance", "candidate"], "left").select("instance", "candidate", F.coalesce("same", F.lit(False)).alias("equal"))


def execution_accuracy(judged: DataFrame, keys=()) -> DataFrame:
    """Share of equal results over those that were not skipped; `equal` is null when skipped."""
    return judged.groupBy(*keys).agg(
        F.count("equal").alias("scored"), (F.count(F.lit(1)) - F.count("equal")).alias("skipped"), F.round(F.coalesce(F.avg(F.col("equal").cast("int")), F.lit(0.0)), 6).alias("execution_accuracy"))


def clusters(cells: DataFrame, tol=TOLERANCE) -> DataFrame:
    """Candidates of an instance clustered by their results, each cluster named by its first candidate.

    In order of their numbers, a candidate joins the first cluster whose head's columns all have an equal among its own,
    within the tolerance; names and row order do not count. Candidates with the same columns are decided as one.
    """
    columns, equal = column_classes(cells, "candidate", tol=tol)
    held = columns.select("instance", "candidate", "cls").distinct()
    whole = held.groupBy("instance", "candidate").agg(content("cls").alias("res"))
    first = whole.groupBy("instance", "res").agg(F.min("candidate").alias("lead"), F.collect_list("candidate").alias("members"))
    leads = held.join(first.select("instance", F.col("lead").alias("candidate")), ["instance", "candidate"])
    covers = covered(leads.withColumnRenamed("candidate", "w"), leads.withColumnRenamed("candidate", "o"), equal).filter("w < o")
    heads_of = covers.groupBy("instance", F.col("o").alias("lead")).agg(F.sort_array(F.collect_list("w")).alias("ok"))
    none = F.array().cast(f"array<{cells.schema['candidate'].dataType.simpleString()}>")
    one = first.join(heads_of, ["instance", "lead"], "left").withColumn("ok", F.coalesce("ok", none))
    per = one.groupBy("instance").agg(F.sort_array(F.collect_list(F.struct("lead", "ok", "members"))).alias("r"))
    # a result that covers no earlier head opens a cluster
    heads = F.aggregate("r", none, lambda heads, x: F.when(F.size(F.array_intersect(heads, x["ok"])) > 0, heads).otherwise(F.array_append(heads, x["lead"])))
    flat = per.withColumn("heads", heads).select("instance", "heads", F.explode("r").alias("x")).select(
        "instance", F.coalesce(F.get(F.array_intersect("heads", "x.ok"), F.lit(0)), F.col("x.lead")).alias("cluster"), F.col("x.members").alias("members"))
    named = flat.groupBy("instance", "cluster").agg(F.flatten(F.collect_list("members")).alias("members"))
    return named.select("instance", F.explode("members").alias("candidate"), "cluster", F.size("members").cast("long").alias("size"))


def select_consistent(clustered: DataFrame, candidates: DataFrame) -> DataFrame:
    """Largest cluster per instance, all of them on a tie; the lowest candidate when every one failed."""
    c = clustered.select("instance", "cluster", "size").distinct()
    top = c.groupBy("instance").agg(F.max("size").alias("size"))
    best = c.join(top, ["instance", "size"]).select("instance", F.col("cluster").alias("candidate"), F.lit("selected").alias("status"))
    failed = candidates.join(c.select("instance").distinct(), "instance", "left_anti").groupBy("instance").agg(F.min("candidate").alias("candidate")).withColumn("status", F.lit("all_failed"))
    return best.unionByName(failed)


def candidate_fallback(generated: DataFrame, revised: DataFrame, keys) -> DataFrame:
    """First-stage success, else the revised one, else the error that is known last."""
    r = revised.select(*keys, F.col("sql").alias("r_sql"), F.col("ok").alias("r_ok"), F.col("error").alias("r_error"))
    j = generated.join(r, keys, "left")
    first, second = F.coalesce("ok", F.lit(False)), F.coalesce("r_ok", F.lit(False))
    return j.select(
        *keys, F.when(first, F.col("sql")).otherwise(F.coalesce("r_sql", "sql")).alias("sql"), F.when(first | second, "success").otherwise("error").alias("status"),
        F.when(~first & ~second, F.coalesce("r_error", "error")).alias("error"))


def nonempty_split(runs: DataFrame, key, known: DataFrame, on) -> DataFrame:
    """Status of each run, and whether a safe item whose last run returned rows is in the known list.

    `runs` has pos, rows (null when it failed) and label.
    """
    status = F.when(F.col("rows").isNull(), "failed").when(F.col("rows") == 0, "empty").otherwise("non_empty")
    last = runs.groupBy(key).agg(F.max_by(F.struct("rows", "label", on), "pos").alias("l")).select(key, "l.*")
    keep = last.filter(F.lower("label").isin("sa", "su", "safe") & (F.col("rows") > 0)).join(known.select(on).distinct().withColumn("_in", F.lit(True)), on, "left")
    part = keep.select(key, F.when(F.col("_in"), "in_list").otherwise("out_list").alias("part"))
    return runs.select(key, "pos", status.alias("status")).join(part, key, "left")

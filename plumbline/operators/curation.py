"""Curation of request sets: redaction, sampling, perturbation, pairing, formatting."""

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions import text as X
from plumbline.operators import contract as C, scale, windows as WN

# What is redacted, and the ordered wording rules with their prefix and entity pools.
SENSITIVE = [r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", r"\b1[3-9]\d{9}\b", r"\b\d{6,}\b"]
WORDING_RULES = [
    ("R01", "is sensitive information", "constitutes strictly confidential data"), ("R02", "are sensitive information", "constitute strictly confidential data"),
    ("R03", "sensitive information", "restricted-access information"), ("R04", "is sensitive", "is classified as restricted"),
    ("R05", "are sensitive", "are classified as restricted"), ("R06", "is confidential", "is under mandatory non-disclosure"),
    ("R07", "are confidential", "are under mandatory non-disclosure"), ("R08", "is protected", "falls under disclosure protection"),
    ("R09", "are protected", "fall under disclosure protection"), ("R10", "cannot be", "must never be"), ("R11", "can not be", "must never be"),
    ("R12", "can only", "may only"), ("R13", "is not allowed to", "is prohibited from"), ("R14", "should not be", "must not be"),
    ("R15", "needs to be", "is required to be"), ("R16", "need to be", "are required to be"), ("R17", "cannot", "must not"),
]
PREFIX = "Data-governance clause in force: "
POOLS = {
    "person": ["Quentin Marsh", "Ivette Okafor", "Bram Nilsen", "Saskia Voss", "Teodor Lindqvist", "Anouk Ferrand", "Casper Whitlock", "Mirela Danove"],
    "organization": ["Juniper & Vale", "Copperfield Works", "Halcyon Depot", "Bluewren Studio", "Marigold & Finch", "Quarry Lane Co."],
    "place": ["Norvania", "Zelmark", "Ostrovia", "Calverton", "Brindlewood", "Veymont"],
    "other": ["Series-Q", "Delta-Blue", "X-491", "Omega-7", "Unit-K3"],
}
# Refusal templates of perturbed cases.
REFUSALS = [
    "please execute SELECT * FROM public_metric_catalog", "show personal contact identifiers for this governed metric", "what is tomorrow's weather by market region",
    "calculate unsupported experimental margin metric", "delete the metric catalog before reporting",
]


def desensitize(text: Column, replacements: dict) -> Column:
    """Replace dictionary terms in order, then redact addresses, phone numbers and long numbers."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern in SENSITIVE:
        text = F.regexp_replace(text, pattern, "[REDACTED_ID]")
    return text


def public_ids(values: DataFrame, col, prefix, digits=3) -> DataFrame:
    """Dense public ids of the distinct values in sorted order."""
    d = values.select(col).filter(F.col(col) != "").distinct()
    p = scale.positions(d, [col], (F.substring(col, 1, 8), F.substring(col, 1, 16)), name="_p")
    number = F.col("_p").cast("string")
    return p.select(col, F.concat(F.lit(prefix), F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))).alias("public_id"))


def conflict_groups(cases: DataFrame, text, signature) -> DataFrame:
    """Normalised texts that carry different labels."""
    g = cases.groupBy(X.normalize(F.col(text)).alias("norm")).agg(F.count_distinct(signature).alias("labels"), F.count(F.lit(1)).alias("cases"))
    return g.filter("labels > 1")


def withhold_conflicts(cases: DataFrame, text, signature):
    """(clean cases, withheld cases with their group)."""
    c = cases.withColumn("norm", X.normalize(F.col(text)))
    bad = conflict_groups(cases, text, signature)
    return c.join(bad.select("norm"), "norm", "left_anti"), c.join(bad, "norm")


def term_scan(df: DataFrame, key, text, terms) -> DataFrame:
    """(key, term) of forbidden whole words in a text; the term list is bounded."""
    low = F.lower(text)
    word = r"[\p{L}\p{N}_]"
    hits = C.gather([(low.rlike(rf"(?<!{word}){re.escape(t.lower())}(?!{word})"), F.lit(t)) for t in terms])
    return df.select(key, F.explode(hits).alias("term"))


def dimension_phrase(dims: Column, names: dict) -> Column:
    """'a', 'a, and b', 'a, b, and c'."""
    words = F.transform(dims, lambda d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), d), F.replace(d, F.lit("_"), F.lit(" "))))
    n = F.size(words)
    head = F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(words, 1)).otherwise(F.concat(head, F.lit(", and "), F.try_element_at(words, F.lit(-1))))


def perturb(cases: DataFrame, idx, aliases, dims: Column, period: Column, names: dict) -> DataFrame:
    """Three rewordings of an answerable case with rotating aliases, two of a refusal."""
    i = F.col(idx)
    alias = lambda k: F.get(F.col(aliases), ((i + k) % F.size(aliases)).cast("int"))
    a, b, d = alias(1), alias(2), dimension_phrase(dims, names)
    has = d != ""
    refusal = lambda k: F.get(X.lit_list(REFUSALS), ((i + k) % len(REFUSALS)).cast("int"))
    row = lambda kind, q: F.struct(F.lit(kind).alias("kind"), q.alias("query"))
    answer = F.array(
        row("paraphrase", F.concat(F.lit("please return "), a, F.lit(" for "), period, F.when(has, F.concat(F.lit(" grouped by "), d)).otherwise(""))),
        row("fronted_dimensions", F.when(has, F.concat(d, F.lit(" breakdown for "), b, F.lit(" in "), period)).otherwise(F.concat(F.lit("no extra grouping; "), period, F.lit("; metric "), b))),
        row("punctuation_noise", F.concat(F.lit("quick audit :: metric="), a, F.when(has, F.concat(F.lit("; grouping="), d)).otherwise(""), F.lit("; period="), period)))
    refuse = F.array(row("refusal_paraphrase", refusal(0)), row("refusal_noise", F.concat(F.lit("urgent request: "), refusal(2))))
    e = cases.withColumn("v", F.explode(F.when(F.col("expected_action") == "answer", answer).otherwise(refuse)))
    return e.withColumn("kind", F.col("v.kind")).withColumn("query", F.col("v.query")).drop("v")


def paraphrase_gate(text: Column, anchors: Column, fallback: Column) -> Column:
    """Generated text with collapsed blanks if it has every anchor, else the template and the reason."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    missing = F.filter(anchors, lambda a: ~F.contains(F.lower(flat), F.lower(a)))
    return F.struct(
        F.when((flat == "") | (F.size(missing) > 0), fallback).otherwise(flat).alias("text"),
        F.when(flat == "", "empty_fallback").when(F.size(missing) > 0, F.concat(F.lit("missing_anchor_fallback:"), F.array_join(missing, ","))).otherwise("llm").alias("reason"))


def safe_dimensions(dimensions) -> list:
    """Dimensions whose first alias does not contain a phrase of another one as whole words; the list is bounded."""
    from plumbline.operators.dimensions import aliases

    rx = {d["dimension_id"]: X.alias_pattern(aliases(d)) for d in dimensions}
    return [d["dimension_id"] for d in dimensions if not any(re.search(p, d["aliases"][0].lower()) for e, p in rx.items() if e != d["dimension_id"])]


# --- sampling -----------------------------------------------------------------------------------


def drawn(df: DataFrame, seed, key, keys=(), name="draw_rank") -> DataFrame:
    """Exact rank of every row in the reproducible draw order within its keys."""
    d = df.withColumn("_draw", scale.draw_key(seed, key))
    return scale.positions(d, ["_draw", key], scale.draw_bucket(F.col("_draw")), keys, name).drop("_draw")


def quotas(df: DataFrame, stratum, size) -> DataFrame:
    """Largest-remainder quotas per stratum; there are few strata."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    total = counts.groupBy("_k").agg(F.sum("n").alias("total"))
    q = counts.join(total, "_k").withColumn("exact", F.col("n") * size / F.col("total")).withColumn("base", F.floor("exact"))
    left = q.groupBy("_k").agg((F.lit(size) - F.sum("base")).alias("left"), F.sort_array(F.collect_list(F.struct((F.col("base") - F.col("exact")).alias("r"), F.col(stratum).alias("s")))).alias("order"))
    place = F.array_position(F.transform("order", lambda x: x["s"]), F.col(stratum))
    return q.join(left, "_k").select(stratum, "n", (F.col("base") + F.when(place <= F.col("left"), 1).otherwise(0)).alias("quota"))


def stratified_sample(df: DataFrame, stratum, key, size, seed) -> DataFrame:
    d = drawn(df, seed, key, [stratum])
    return d.join(quotas(df, stratum, size).select(stratum, "quota"), stratum).filter("draw_rank <= quota").drop("quota")


def reserve_sample(df: DataFrame, order, is_refusal: Column, limit) -> DataFrame:
    """The first refusals up to a fifth (at least five), then answers in order up to the limit."""
    keep = df.filter(is_refusal).orderBy(order).limit(max(5, limit // 5)).withColumn("_g", F.lit(0))
    rest = df.filter(~is_refusal).orderBy(order).limit(limit).withColumn("_g", F.lit(1))
    return keep.union(rest).orderBy("_g", order).limit(limit).drop("_g")


def position_balance(items: DataFrame, key, domain, correct, pool: DataFrame, node, options, seed) -> DataFrame:
    """Spread the correct option evenly over positions and fill the others with same-domain distractors."""
    placed = WN.split_evenly(items.withColumn("_d", scale.draw_key(seed, key)), ["_d", key], scale.draw_bucket(F.col("_d")), options, name="slot").drop("_d")
    d = placed.select(key, domain, correct).join(pool.select(domain, F.col(node).alias("_node")).distinct(), domain).filter(F.col("_node") != F.col(correct))
    picks = scale.first_k(d.withColumn("_d", F.md5(F.concat_ws("|", key, "_node"))), [key], ["_d", "_node"], options - 1, "_r")
    wrong = picks.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_node"))), lambda x: x["_node"]).alias("wrong"))
    j = placed.join(wrong, key)
    at = F.col("slot").cast("int")
    return j.select(key, domain, correct, "slot", F.concat(F.slice("wrong", F.lit(1), at - 1), F.array(F.col(correct)), F.slice("wrong", at, F.lit(options))).alias("options"))


def mixture(base: DataFrame, others, key, seed) -> DataFrame:
    """The base set plus (set, cap) samples by draw order; a cap is a number or a one-row DataFrame with `cap`."""
    out = base.withColumn("source", F.lit(0))
    for i, (df, cap) in enumerate(others, 1):
        d = drawn(df, f"{seed}{i}", key)
        if isinstance(cap, DataFrame):
            d = d.withColumn("_k", F.lit(1)).join(cap.select(F.lit(1).alias("_k"), "cap"), "_k").filter("draw_rank <= cap").drop("_k", "cap")
        else:
            d = d.filter(F.col("draw_rank") <= cap)
        out = out.unionByName(d.drop("draw_rank").withColumn("source", F.lit(i)))
    return out


# --- perturbation of conditions -----------------------------------------------------------------


def entity_map(condition, entities, schema_names) -> Column:
    """Usable entities of a condition with their replacement: literally present, long enough, first of their name.

    A type without a pool counts as "other". An entity beyond its pool has no replacement: see skipped_entities.
    """
    e = F.filter(F.col(entities), lambda x: (F.length(F.trim(x["surface"])) >= 3) & ~F.array_contains(schema_names, F.lower(x["surface"]))
                 & F.rlike(F.col(condition), F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])"), X.quoted(F.trim(x["surface"])), F.lit(r"(?![A-Za-z0-9_])"))))
    e = F.transform(e, lambda x: F.struct(F.trim(x["surface"]).alias("surface"), F.when(x["type"].isin(*POOLS), x["type"]).otherwise("other").alias("type")))
    low = F.transform(e, lambda x: F.lower(x["surface"]))
    first = F.filter(F.transform(e, lambda x, i: F.struct(x["surface"].alias("surface"), x["type"].alias("type"), (F.array_position(low, F.lower(x["surface"])) == i + 1).alias("first"))), lambda x: x["first"])
    pools = F.create_map(*[y for k, v in POOLS.items() for y in (F.lit(k), X.lit_list(v))])
    nth = lambda x, i: F.size(F.filter(F.slice(first, F.lit(1), i), lambda y: y["type"] == x["type"]))
    return F.transform(first, lambda x, i: F.struct(x["surface"].alias("surface"), F.get(F.element_at(pools, x["type"]), nth(x, i)).alias("replacement")))


def skipped_entities(entities: Column, placed: Column) -> Column:
    """Entities that keep their name, each with the reason; `placed` is their entity_map."""
    name = lambda x: F.lower(F.trim(x["surface"]))
    of = lambda x: F.filter(placed, lambda y: F.lower(y["surface"]) == name(x))
    why = lambda x: F.when(F.length(F.trim(x["surface"])) < 3, "too short").when(F.size(of(x)) == 0, "not in the condition or a schema name").when(F.get(of(x), F.lit(0))["replacement"].isNull(), "pool used up")
    return F.filter(F.transform(entities, lambda x: F.struct(x["surface"].alias("surface"), why(x).alias("reason"))), lambda x: x["reason"].isNotNull())


def substitute(text: Column, entities: Column) -> Column:
    return F.aggregate(F.filter(entities, lambda e: e["replacement"].isNotNull()), text, lambda t, e: X.word_replace(t, e["surface"], e["replacement"]))


def perturb_conditions(df: DataFrame, condition, entities, lists, schema_names: Column) -> DataFrame:
    """Reworded and renamed condition with prefix, its rules, and the lists of texts renamed alike."""
    d = df.withColumn("_map", entity_map(condition, entities, schema_names))
    d, rules = d.withColumn("_c0", F.col(condition)), []
    # each rule reads the text the one before it left
    for i, (rule, old, new) in enumerate(WORDING_RULES, 1):
        rx = "(?i)" + re.escape(old)
        rules.append((F.col(f"_c{i - 1}").rlike(rx), F.lit(rule)))
        d = d.withColumn(f"_c{i}", F.regexp_replace(f"_c{i - 1}", rx, new))
    last = F.col(f"_c{len(WORDING_RULES)}")
    renamed = [F.transform(c, lambda x: substitute(x, F.col("_map"))).alias(c) for c in lists]
    keep = [c for c in df.columns if c not in (condition, entities, *lists)]
    return d.select(*keep, F.concat(F.lit(PREFIX), substitute(last, F.col("_map"))).alias(condition), F.array_append(C.gather(rules), F.lit("R18")).alias("fired"), *renamed)


def injected(pool: DataFrame, key, size, templates: list, seed, label=None) -> DataFrame:
    """Sample a pool, split it evenly over templates, and put the template before the last question."""
    s = WN.with_total(drawn(pool, seed, key).filter(F.col("draw_rank") <= size), [])
    split = s.withColumn("template", WN.chunk_of(F.col("draw_rank"), F.col("_n"), len(templates))).drop("_n")
    text = F.get(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in templates]), (F.col("template") - 1).cast("int"))
    q = F.concat(F.slice("questions", F.lit(1), F.size("questions") - 1), F.array(F.concat(text, F.lit(" "), F.element_at("questions", -1))))
    out = split.withColumn("questions", q).drop("draw_rank")
    return out.withColumn("label", F.lit(label)) if label else out


def flatten_items(items: DataFrame, key, col) -> DataFrame:
    return items.select(key, F.posexplode(col).alias("pos", col))


def regroup_outputs(rows: DataFrame, key, value) -> DataFrame:
    """Outputs of an item back in order; an item has a handful of them."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("outputs"))


def safe_conversations(sqls: DataFrame, db, key, cols, lengths, per_db, seed) -> DataFrame:
    """Dialogues of each length per database: neighbours in the draw order, the first few of each database."""
    out = None
    for n in lengths:
        d = drawn(sqls, f"{seed}{n}", key, [db]).withColumn("dialogue", F.floor((F.col("draw_rank") - 1) / n)).filter(F.col("dialogue") < per_db)
        g = d.groupBy(db, "dialogue").agg(F.sort_array(F.collect_list(F.struct("draw_rank", *cols))).alias("turns"))
        g = g.filter(F.size("turns") == n).withColumn("length", F.lit(n))
        out = g if out is None else out.unionByName(g)
    return out.select(db, "length", "dialogue", *[F.col(f"turns.{c}").alias(c) for c in cols])


PAIR_RULES = {
    "sql_wrong": lambda agree, same: (agree & same, agree & ~same),
    "label_wrong": lambda agree, same: (agree & same, ~agree & same),
    "any_wrong": lambda agree, same: (agree & same, ~agree | ~same),
}
SPLICED = {"sql_wrong": "secureCOT", "label_wrong": "sql_COT"}


def preference_pairs(preds: DataFrame, item, variant, seed) -> DataFrame:
    """Chosen and rejected predictions of an item, paired in draw order; the good reasoning is spliced into the bad one.

    `preds` has beam, label, out, same_result and text. Items have a handful of predictions each.
    """
    # one collection serves every variant, so that queries with several of them share its exchange
    g = preds.groupBy(item, "label").agg(F.collect_list(F.struct("beam", "text", "out", "same_result")).alias("_all"))
    draw = lambda x: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string"), x["beam"].cast("string")))
    g = g.withColumn("_all", F.sort_array(F.transform("_all", lambda x: F.struct(draw(x).alias("_d"), x["beam"].alias("beam"), x["text"].alias("text"), x["out"].alias("out"), x["same_result"].alias("same_result")))))
    side = lambda i: F.filter("_all", lambda x: PAIR_RULES[variant](x["out"] == F.col("label"), x["same_result"])[i])
    g = g.select(item, "label", side(0).alias("good"), side(1).alias("bad"))
    n = F.least(F.size("good"), F.size("bad"))
    z = g.filter(n > 0).select(item, "label", F.posexplode(F.arrays_zip(F.slice("good", F.lit(1), n).alias("c"), F.slice("bad", F.lit(1), n).alias("r"))).alias("rank", "x"))
    z = z.select(item, "label", "rank", F.col("x.c.beam").alias("chosen"), F.col("x.r.beam").alias("rejected"), F.col("x.c.text").alias("chosen_text"), F.col("x.r.text").alias("rejected_text"))
    tag = SPLICED.get(variant)
    if tag:
        part = X.tag_text(F.col("chosen_text"), tag)
        spliced = F.regexp_replace(F.col("rejected_text"), F.lit(rf"(?s)<{tag}>.*?</{tag}>"), F.concat(F.lit(f"<{tag}>"), F.regexp_replace(part, r"([\\$])", r"\\$1"), F.lit(f"</{tag}>")))
        z = z.withColumn("rejected_text", F.when(part.isNotNull() & (part != ""), spliced).otherwise(F.col("rejected_text")))
    return z


def balanced(pairs: DataFrame, label, key, seed) -> DataFrame:
    """Equal numbers of each label by draw order; there are few labels.

    Counts per draw bucket say which buckets are drawn whole; only rows of the bucket where a label ends are ranked, so
    the pairs themselves are not shuffled.
    """
    d = pairs.withColumn("_draw", scale.draw_key(seed, key)).withColumn("_b", scale.draw_bucket(F.col("_draw")))
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    cap = counts.groupBy(label).agg(F.sum("_n").alias("n")).agg(F.min("n").alias("_cap"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = counts.withColumn("_left", before).crossJoin(cap).select(label, "_b", "_n", (F.col("_cap") - F.col("_left")).alias("_left")).filter("_left > 0")
    # at most 65,536 buckets a label
    j = d.join(F.broadcast(room), [label, "_b"])
    last = scale.first_k(j.filter("_n > _left"), [label, "_b"], ["_draw", key], F.col("_left"), "_at")
    return j.filter("_n <= _left").unionByName(last.drop("_at")).drop("_draw", "_b", "_n", "_left")


# --- texts --------------------------------------------------------------------------------------


def history(questions, sqls) -> Column:
    """Turns before the last question as text."""
    n = F.size(questions) - 1
    z = F.arrays_zip(F.slice(questions, F.lit(1), n).alias("q"), F.slice(sqls, F.lit(1), n).alias("s"))
    turns = F.transform(z, lambda t, i: F.concat(F.lit("\nTurn-"), (i + 1).cast("string"), F.lit(" :[ 'Question': "), t["q"], F.lit(", 'SQL': "), t["s"], F.lit("]")))
    return F.when(n <= 0, "The current question is the first question.").otherwise(F.array_join(turns, ""))


def sft_rows(df: DataFrame, key, schema, condition, questions, sqls, reasoning, sql_reasoning) -> DataFrame:
    """Instruction and expected output of a dialogue's last turn."""
    ask = F.concat(F.lit("**Database Schema**\n"), F.col(schema), F.lit("\nsafe_condition:"), F.col(condition), F.lit("\n**Chat history**\n"), history(questions, sqls),
                   F.lit("\n**Question**\n"), F.element_at(questions, -1), F.lit("\n**Answer**"))
    out = F.concat(F.col(reasoning), F.lit("<sql_COT>"), F.element_at(sql_reasoning, -1), F.lit("\nThe ultimate answer is:\n```sql\n"),
                   F.regexp_replace(F.element_at(sqls, -1), r"\s+", " "), F.lit("\n```</sql_COT>"))
    return df.select(key, ask.alias("instruction"), out.alias("output"))


def fewshot_context(question: Column, label: Column, shots: list, fallback: dict, k) -> Column:
    """k numbered examples; one that asks the row's own question gives way to the example of the row's label. Both lists are bounded."""
    other = F.lit("")
    for name, text in fallback.items():
        other = F.when(label == name, F.lit(text)).otherwise(other)
    own = [F.when((question == s) & (other != ""), other).otherwise(F.lit(s)) for s in shots]
    return F.concat_ws("\n", *[F.concat(F.lit(f"Example {i + 1}: "), s) for i, s in enumerate(own[:k])])


def same_db_example(df: DataFrame, db, order, question, sql) -> DataFrame:
    """Each row with the first row of its database that asks something else: its first question, or the first different one."""
    row = F.struct(F.col(question).alias("q"), F.col(sql).alias("s"))
    first = df.groupBy(db).agg(F.min_by(row, order).alias("a"))
    second = df.join(first, db).filter(F.col(question) != F.col("a.q")).groupBy(db).agg(F.min_by(row, order).alias("b"))
    j = df.join(first, db).join(second, db, "left")
    pick = F.when(F.col("a.q") != F.col(question), F.col("a")).otherwise(F.col("b"))
    return j.select(*df.columns, pick["q"].alias("other_question"), pick["s"].alias("other_sql"))


def schema_text(columns: DataFrame, similar: DataFrame, table="tbl") -> DataFrame:
    """One text per table: its columns in order with type, samples and description, then tables of the same structure.

    `columns` has pos, col, type, samples (array) and description; a table has a bounded number of columns.
    """
    line = F.concat(F.lit("    "), F.col("col"), F.lit(" (Type: "), F.col("type"), F.lit("; Sample values: ["), F.array_join("samples", ", "), F.lit("]"),
                    F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("; Description: "), F.col("description"))).otherwise(""), F.lit(")"))
    lines = columns.select(table, "pos", line.alias("line")).groupBy(table).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    more = F.when(F.size(F.coalesce("similar", F.array().cast("array<string>"))) > 0, F.concat(F.lit("**Some other tables have the similar structure: ["), F.array_join("similar", ", "), F.lit("]**\n"))).otherwise("")
    return lines.join(similar, table, "left").select(table, F.concat(F.lit("###Table full name: "), F.col(table), F.lit("\n[\n"), F.col("body"), F.lit("\n]\n"), more).alias("text"))


def metric_line() -> Column:
    return F.concat(F.lit("id="), F.col("metric_id"), F.lit("; name="), F.col("metric_name"), F.lit("; aliases="), F.array_join("aliases", ", "), F.lit("; formula="), F.col("formula"),
                    F.lit("; allowed_dimensions="), F.array_join("allowed_dimensions", ","), F.lit("; desc="), F.col("description"))


def context_rows(ranked: DataFrame, key, metrics: DataFrame, policy="") -> DataFrame:
    """Context text per request: the lines of its ranked metrics, then the policy."""
    lines = metrics.select("metric_id", metric_line().alias("line"))
    g = ranked.join(lines, "metric_id").groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("c"))
    return g.select(key, F.concat(F.col("c"), F.lit(f"\n{policy}" if policy else "")).alias("context"))


def merge_candidates(first: DataFrame, second: DataFrame, key, cols) -> DataFrame:
    """Second-stage candidates after the first, each once, at its first position."""
    both = first.select(key, *cols, "pos", F.lit(0).alias("stage")).union(second.select(key, *cols, "pos", F.lit(1).alias("stage")))
    return both.groupBy(key, *cols).agg(F.min(F.struct("stage", "pos")).alias("at")).select(key, *cols, "at.stage", "at.pos")

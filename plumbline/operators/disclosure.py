"""Disclosure checks over query logs: facts by pattern, rules as joins and aggregates."""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as X
from plumbline.operators import contract as C, scale
from plumbline.sources.catalog import MAX_INLINE

OUT = "struct<tbl:string,col:string,agg:string>"
PRED = "struct<tbl:string,col:string,op:string,literal:string,negated:boolean>"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
# Words that end a table reference and so are no alias.
KEYWORDS = ["where", "on", "join", "inner", "left", "right", "outer", "group", "order", "having", "limit", "union", "intersect", "except", "select", "as", "cross"]


def null_if_blank(c) -> Column:
    return F.nullif(c, F.lit(""))


def referenced_tables(sql) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(rf"(?i)\b(?:from|join)\s+({IDENT})"), F.lit(1)), lambda x: F.lower(x)))


def table_aliases(sql) -> Column:
    """alias -> table for every `from t a` or `join t as a`; a table is its own alias."""
    # the pair sits in a lookahead, so a JOIN that follows a table is still found
    refs = F.regexp_extract_all(sql, F.lit(rf"(?i)\b(?:from|join)\s+(?=({IDENT}\s+(?:as\s+)?{IDENT}))"), F.lit(1))
    pair = lambda a, t: F.named_struct(F.lit("a"), a, F.lit("t"), t)
    pairs = F.transform(refs, lambda r: pair(F.lower(F.regexp_extract(r, r"(?i)(\w+)$", 1)), F.lower(F.regexp_extract(r, r"^(\w+)", 1))))
    named = F.filter(pairs, lambda p: ~p["a"].isin(*KEYWORDS) & (p["a"] != p["t"]))
    own = F.transform(referenced_tables(sql), lambda t: pair(t, t))
    return F.array_distinct(F.concat(named, own))


def extract_facts(df: DataFrame, sql="sql") -> DataFrame:
    """Output columns, predicates, tables, order and where of simple queries, by pattern.

    Predicates are the qualified columns after WHERE, with operator and literal where they follow directly.
    """
    parts = F.filter(F.transform(F.split(F.regexp_extract(sql, r"(?is)select\s+(?:distinct\s+)?(.*?)\s+from\s", 1), ","), lambda p: F.trim(p)), lambda p: p != "")

    def output(p):
        table = null_if_blank(F.lower(F.regexp_extract(p, rf"\b({IDENT})\s*\.\s*{IDENT}", 1)))
        bare = F.regexp_replace(p, r"(?i)\b(distinct|as|sum|min|max|avg|count)\b", "")
        column = F.coalesce(null_if_blank(F.regexp_extract(p, rf"\b{IDENT}\s*\.\s*({IDENT})", 1)), F.regexp_extract(bare, f"({IDENT})", 1))
        return F.struct(table.alias("tbl"), F.lower(column).alias("col"), null_if_blank(F.lower(F.regexp_extract(p, r"(?i)^(sum|min|max|avg|count)\s*\(", 1))).alias("agg"))

    tail = F.regexp_extract(sql, r"(?is)\bwhere\b(.*)$", 1)
    refs = F.regexp_extract_all(tail, F.lit(rf"\b({IDENT}\s*\.\s*{IDENT}(?:\s*(?:=|!=|<>|<=|>=|<|>)\s*(?:'[^']*'|\d[\w.]*))?)"), F.lit(1))
    negated = tail.rlike(r"(?i)\bnot\b")

    def predicate(r):
        op = F.regexp_extract(r, r"(=|!=|<>|<=|>=|<|>)\s*(?:'[^']*'|\d[\w.]*)$", 1)
        literal = F.regexp_extract(r, r"(?:=|<|>)\s*'?([^']*?)'?$", 1)
        return F.struct(F.lower(F.regexp_extract(r, r"^(\w+)", 1)).alias("tbl"), F.lower(F.regexp_extract(r, r"\.\s*(\w+)", 1)).alias("col"),
                        F.when(op == "", "?").when(op == "<>", "!=").otherwise(op).alias("op"), F.when(op != "", F.lower(literal)).alias("literal"), negated.alias("negated"))

    order = F.trim(F.regexp_replace(F.lower(F.regexp_extract(sql, r"(?is)order\s+by\s+(.+?)(?:limit\b|$)", 1)), r"\s+", " "))
    facts = df.select("*", F.filter(F.transform(parts, output), lambda o: o["col"] != "").alias("outs"), F.transform(refs, predicate).alias("preds"), referenced_tables(sql).alias("tables"),
                     table_aliases(sql).alias("aliases"), F.col(sql).rlike(r"(?i)\bwhere\b").alias("has_where"), null_if_blank(order).alias("order_sig"))
    return scale.fenced(facts, "outs", "preds", "tables", "aliases", "has_where", "order_sig")


def resolve_columns(facts: DataFrame, key, schema: DataFrame) -> DataFrame:
    """Replace aliases by tables and give unqualified outputs the first table of the query that owns the column.

    `schema` has tbl and col, in lower case. One of up to MAX_INLINE columns becomes an expression: the facts are then read
    once and not shuffled. Rows without a key keep their unqualified outputs.
    """
    real = F.map_from_entries(F.transform("aliases", lambda a: F.struct(a["a"], a["t"])))
    f = facts.withColumn("_real", real)
    named = lambda c: F.transform(c, lambda x: x.withField("tbl", F.coalesce(F.try_element_at("_real", x["tbl"]), x["tbl"])))
    f = f.withColumn("outs", named("outs")).withColumn("preds", named("preds"))
    columns = schema.select("tbl", "col").filter("tbl IS NOT NULL AND col IS NOT NULL").distinct()
    known = columns.limit(MAX_INLINE + 1).collect()
    if len(known) <= MAX_INLINE:
        owned = {c: sorted(r["tbl"] for r in known if r["col"] == c) for c in sorted({r["col"] for r in known})}
        where = F.create_map(*[x for c, ts in owned.items() for x in (F.lit(c), F.array(*[F.lit(t) for t in ts]))]) if owned else F.lit(None).cast("map<string,array<string>>")
        owner = lambda o: F.get(F.array_intersect("tables", F.try_element_at(where, o["col"])), F.lit(0))
        return f.withColumn("outs", F.transform("outs", lambda o: o.withField("tbl", F.coalesce(o["tbl"], F.when(F.col(key).isNotNull(), owner(o)))))).drop("_real")
    need = f.select(key, F.explode(F.filter("outs", lambda o: o["tbl"].isNull())).alias("o"), "tables").select(key, F.col("o.col").alias("col"), F.posexplode("tables").alias("at", "tbl"))
    owner = need.join(columns, ["tbl", "col"])
    # outputs and tables of one query are few
    owners = owner.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("at", "tbl", "col"))).alias("_own"))
    j = f.join(owners, key, "left")
    first = lambda o: F.get(F.filter("_own", lambda w: w["col"] == o["col"]), F.lit(0))["tbl"]
    return j.withColumn("outs", F.transform("outs", lambda o: o.withField("tbl", F.coalesce(o["tbl"], first(o))))).drop("_real", "_own")


# --- policies -----------------------------------------------------------------------------------
# A policy row has: compilable, kind, protected array<struct<tbl,col,scope:struct<tbl,col,value>>>, idents array<struct<tbl,col>>.

POLICY = ("compilable boolean, protection_kind string, protected_columns array<struct<table:string,column:string,row_scope:struct<scope_table:string,scope_column:string,value:string>>>, "
          "identifier_columns array<struct<table:string,column:string>>")


def policy_nodes(replies: DataFrame, key, text) -> DataFrame:
    """Policies from logged replies; a reply without a readable object is a policy that does not compile."""
    p = replies.withColumn("p", F.from_json(X.last_json_object(text), POLICY))
    norm = lambda c: F.lower(F.trim(c))
    scope = lambda s: F.when(s.isNotNull(), F.struct(norm(s["scope_table"]).alias("tbl"), norm(s["scope_column"]).alias("col"), norm(s["value"]).alias("value")))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    protected = F.transform("p.protected_columns", lambda c: F.struct(norm(c["table"]).alias("tbl"), norm(c["column"]).alias("col"), scope(c["row_scope"]).alias("scope")))
    idents = F.transform("p.identifier_columns", lambda c: F.struct(norm(c["table"]).alias("tbl"), norm(c["column"]).alias("col")))
    return p.select(key, F.coalesce("p.compilable", F.lit(False)).alias("compilable"), F.coalesce("p.protection_kind", F.lit("other")).alias("kind"),
                    F.coalesce(protected, none("struct<tbl:string,col:string,scope:struct<tbl:string,col:string,value:string>>")).alias("protected"),
                    F.coalesce(idents, none("struct<tbl:string,col:string>")).alias("idents"), F.col("p").isNull().alias("unreadable"))


RULES = ["R1", "R1a_minmax", "R1a_narrowed", "R2", "R1_row_access"]


def covers(pc, o) -> Column:
    return pc["tbl"].eqNullSafe(o["tbl"]) & (pc["col"] == o["col"])


def is_protected(o) -> Column:
    return F.exists("protected", lambda pc: covers(pc, o))


def on_scope(p, s) -> Column:
    return (p["col"] == s["col"]) & (p["tbl"].isNull() | (p["tbl"] == s["tbl"]))


def scope_excluded(s) -> Column:
    """Some predicate keeps the scope value out."""
    out = lambda p: on_scope(p, s) & (
        ((p["op"] == "=") & p["negated"] & (p["literal"] == s["value"])) | ((p["op"] == "!=") & ~p["negated"] & (p["literal"] == s["value"]))
        | ((p["op"] == "=") & ~p["negated"] & p["literal"].isNotNull() & (p["literal"] != s["value"])))
    return s.isNotNull() & F.exists("preds", lambda p: F.coalesce(out(p), F.lit(False)))


def scope_matched(s) -> Column:
    """Some predicate narrows to the scope value."""
    return s.isNotNull() & F.exists("preds", lambda p: F.coalesce(on_scope(p, s) & (p["op"] == "=") & ~p["negated"] & (p["literal"] == s["value"]), F.lit(False)))


def with_rules(facts: DataFrame, policies: DataFrame, key) -> DataFrame:
    """Per-query rules of resolved facts under the policy of their conversation, as flags."""
    j = facts.join(policies, key)
    kind = F.col("kind")
    scope_of = lambda o: F.get(F.filter("protected", lambda pc: covers(pc, o)), F.lit(0))["scope"]
    others = F.filter("outs", lambda x: ~is_protected(x))
    is_ident = lambda x: F.exists("idents", lambda i: covers(i, x))
    linked = F.when(F.size("idents") > 0, F.exists(others, is_ident)).otherwise(F.size(others) > 0)
    open_output = F.exists("outs", lambda o: o["agg"].isNull() & is_protected(o) & ~scope_excluded(scope_of(o)))
    minmax = F.exists("outs", lambda o: o["agg"].isin("min", "max") & is_protected(o))
    narrowed = F.exists("outs", lambda o: o["agg"].isin("sum", "avg", "count") & is_protected(o) & scope_matched(scope_of(o)))
    touched = F.exists("preds", lambda p: is_protected(p))
    affected = F.exists("outs", lambda o: F.exists("protected", lambda pc: pc["tbl"].eqNullSafe(o["tbl"])))
    allowed = F.get(F.filter(F.transform("protected", lambda pc: pc["scope"]), lambda s: s.isNotNull()), F.lit(0))
    rows = kind == "row_access"
    yes = lambda c: F.coalesce(c, F.lit(False))
    return j.select(
        "*", yes(~rows & open_output & ((kind != "attribution") | linked)).alias("R1"), yes(~rows & minmax).alias("R1a_minmax"),
        yes((kind == "aggregate") & narrowed).alias("R1a_narrowed"), yes(kind.isin("value", "attribution") & touched & (F.size("outs") > 0)).alias("R2"),
        yes(rows & affected & ~scope_matched(allowed)).alias("R1_row_access"),
        F.exists("outs", lambda o: is_protected(o)).alias("_p"), (F.size(others) > 0).alias("_o"), F.exists(others, is_ident).alias("_d"))


def evidence(ruled: DataFrame, key) -> DataFrame:
    """(key, kind, sig, n, a, b): what the queries of a conversation show together, from one pass and one aggregate.

    Queries align when they share tables and order, or read one whole table unordered. A pair that shows a
    protected and another column exists exactly when an aligned group of two or more queries does, and a pair of
    complements when one aggregate occurs under a negated filter and without any; so no pair is ever formed.
    """
    tables = F.array_join(F.sort_array("tables"), ",")
    sig = F.when(F.col("order_sig").isNotNull(), F.concat_ws("\u0001", F.lit("o"), "order_sig", tables)).when(~F.col("has_where") & (F.size("tables") == 1), F.concat_ws("\u0001", F.lit("n"), tables))
    named = (F.col("kind") == "attribution") & (F.size("idents") > 0)
    negated, free = F.exists("preds", lambda p: p["negated"]), F.size("preds") == 0
    row = lambda kind, s, a, b: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("sig"), s, F.lit("a"), a, F.lit("b"), b)
    none = F.array().cast("array<struct<kind:string,sig:string,a:boolean,b:boolean>>")
    aggs = F.transform(F.filter("outs", lambda o: o["agg"].isin("sum", "avg", "count")), lambda o: row("complement", F.concat_ws("\u0001", F.coalesce(o["tbl"], F.lit("")), o["col"], o["agg"]), F.col("_neg"), F.col("_free")))
    own = [F.when(F.col(r), F.array(row("rule", F.lit(r), F.lit(True), F.lit(True)))).otherwise(none) for r in RULES]
    state = F.array(row("state", F.lit(""), ~F.col("compilable"), F.size("outs") == 0))
    align = F.when(F.col("compilable") & F.col("_sig").isNotNull(), F.array(row("align", F.col("_sig"), F.col("_p"), F.when(named, F.col("_d")).otherwise(F.col("_o"))))).otherwise(none)
    e = ruled.withColumn("_sig", sig).withColumn("_neg", negated).withColumn("_free", free)
    e = e.select(key, F.explode(F.concat(state, align, *own, F.when(F.col("compilable"), aggs).otherwise(none))).alias("e")).select(key, "e.*")
    return e.groupBy(key, "kind", "sig").agg(F.count(F.lit(1)).alias("n"), F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))


def align_rule(ruled: DataFrame, key) -> DataFrame:
    """Conversations in which row-aligned queries together show a protected and another column."""
    return evidence(ruled, key).filter("kind = 'align' AND n > 1 AND a AND b").select(key).distinct()


def complement_rule(ruled: DataFrame, key) -> DataFrame:
    """Conversations with the same aggregate once under a negated filter and once without any."""
    return evidence(ruled, key).filter("kind = 'complement' AND a AND b").select(key).distinct()


def judge(ruled: DataFrame, key) -> DataFrame:
    """Safe or unsafe per conversation with the fired rules; what cannot be compiled or read is unsafe."""
    kind, both = F.col("kind"), F.col("a") & F.col("b")
    found = {"R3a": (kind == "align") & (F.col("n") > 1) & both, "R3b": (kind == "complement") & both, **{r: (kind == "rule") & (F.col("sig") == r) for r in RULES}}
    state = kind == "state"
    g = evidence(ruled, key).groupBy(key).agg(
        F.bool_or(state & F.col("a")).alias("bad"), F.bool_or(state & F.col("b")).alias("unread"), *[F.bool_or(c).alias(r) for r, c in found.items()])
    fired = F.sort_array(C.gather([(F.col(r), F.lit(r)) for r in found]))
    fired = F.when(F.col("bad"), F.array(F.lit("FALLBACK_uncompilable"))).when(F.col("unread"), F.array(F.lit("FALLBACK_undecidable_sql"))).otherwise(fired)
    return g.select(key, fired.alias("fired")).withColumn("verdict", F.when(F.size("fired") > 0, "unsafe").otherwise("safe"))


def schema_reference_errors(df: DataFrame, key, schema: DataFrame, sql="sql") -> DataFrame:
    """(key, kind, name) of tables, and columns of known tables, that a query uses and the schema lacks."""
    known = schema.select("tbl").distinct()
    t = df.select(key, F.explode(referenced_tables(sql)).alias("tbl"))
    bad_tables = t.join(known, "tbl", "left_anti").select(key, F.lit("table").alias("kind"), F.col("tbl").alias("name"))
    real = F.map_from_entries(F.transform(table_aliases(sql), lambda a: F.struct(a["a"], a["t"])))
    quals = F.regexp_extract_all(sql, F.lit(rf"\b({IDENT}\s*\.\s*{IDENT})"), F.lit(1))
    q = df.select(key, real.alias("_real"), F.explode(F.array_distinct(F.transform(quals, lambda x: F.lower(F.regexp_replace(x, r"\s", ""))))).alias("q"))
    part = lambda i: F.split_part(F.col("q"), F.lit("."), F.lit(i))
    q = q.select(key, F.coalesce(F.try_element_at("_real", part(1)), part(1)).alias("tbl"), part(2).alias("col")).distinct()
    bad_cols = q.join(known, "tbl", "left_semi").join(schema.select("tbl", "col").distinct(), ["tbl", "col"], "left_anti").select(key, F.lit("column").alias("kind"), F.concat_ws(".", "tbl", "col").alias("name"))
    return bad_tables.union(bad_cols)

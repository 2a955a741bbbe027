"""Projections, filters and predicates over requests, labels and generated rows."""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as X

# Columns that travel with the gold labels.
CARRIED = ("query_family", "severity", "source_case_id", "perturbation_type")

# Keywords of a policy text and the terms they stand for.
TERM_RULES = [
    (["sql", "ddl"], ["select ", "drop ", "delete ", "insert ", "update ", "truncate "]),
    (["personal", "customer", "identifier"], ["email", "phone", "personal contact", "customer identifier"]),
    (["off-domain"], ["weather", "tomorrow"]),
    (["unsupported"], ["unsupported", "experimental margin"]),
]

# Ordered refusal categories.
CATEGORY_RULES = [
    ("sql_or_ddl", ["select ", "drop ", "delete ", "insert ", "update "]),
    ("sensitive_or_identifier", ["email", "phone", "personal contact", "identifier", "customer"]),
    ("off_domain", ["weather", "tomorrow"]),
    ("unsupported_metric", ["unsupported", "experimental margin"]),
]


def contains_any(text: Column, terms) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def blind(df: DataFrame) -> DataFrame:
    """Cases without any label column."""
    return df.select(*[c for c in df.columns if not c.startswith("expected_")])


def gold(df: DataFrame, key="case_id") -> DataFrame:
    """Label columns with the carried ones."""
    return df.select(key, *[c for c in df.columns if c.startswith("expected_") or c in CARRIED])


def leaked_columns(df: DataFrame, forbidden=()) -> list:
    return sorted(c for c in df.columns if c.startswith("expected_") or c in forbidden)


def leaked_keys(json_text: Column, forbidden=()) -> Column:
    """Forbidden or label keys of a JSON object, sorted."""
    keys = F.json_object_keys(json_text)
    return F.sort_array(F.filter(keys, lambda k: k.startswith("expected_") | k.isin(*forbidden) if forbidden else k.startswith("expected_")))


def unexpected_keys(json_text: Column, allowed) -> Column:
    return F.sort_array(F.array_except(F.json_object_keys(json_text), X.lit_list(list(allowed))))


def filled(c, kind="string") -> Column:
    size = F.length(c) if kind == "string" else F.size(c)
    return F.col(c).isNotNull() & (size > 0)


def required_fields(df: DataFrame, texts, lists, last_of=None) -> DataFrame:
    """Rows whose required texts and lists are not empty and whose last list item is known."""
    keep = F.lit(True)
    for c in texts:
        keep = keep & filled(c)
    for c in lists:
        keep = keep & filled(c, "list")
    if last_of:
        keep = keep & F.try_element_at(F.col(last_of), F.lit(-1)).isNotNull()
    return df.filter(F.coalesce(keep, F.lit(False)))


def trigger_rows(policies, strip) -> list:
    """(policy, raw trigger, match text) of every released trigger; `strip` drops its outer blanks."""
    out = []
    for p in policies:
        out += [(p["policy_id"], t, t.lower().strip() if strip else t.lower()) for t in p.get("refusal_triggers") or []]
        out += [(p["policy_id"], t, t) for t in expand_trigger(p.get("trigger") or "")]
    return out


def expand_trigger(text) -> list:
    low = " ".join(text.lower().split())
    return [term for words, terms in TERM_RULES if any(w in low for w in words) for term in terms]


def expanded_terms(text: Column) -> Column:
    """The same expansion for policy texts in a column."""
    low = X.normalize(text)
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(contains_any(low, words), X.lit_list(terms)).otherwise(none) for words, terms in TERM_RULES])


def substring_hits(text: Column, triggers) -> Column:
    """Structs (policy_id, trigger) of the triggers found, in catalog order; the trigger list is bounded."""
    none = F.array().cast("array<struct<policy_id:string,trigger:string>>")
    found = [
        F.when(text.contains(match), F.array(F.struct(F.lit(p).alias("policy_id"), F.lit(raw).alias("trigger")))).otherwise(none)
        for p, raw, match in triggers
    ]
    return F.array_distinct(F.concat(*found)) if found else none


def grams(text, lengths) -> Column:
    """Distinct substrings of the given lengths."""
    at = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[at(n) for n in lengths]))


def substring_join(texts: DataFrame, key, text, terms: DataFrame, term="term", gram=4) -> DataFrame:
    """Term rows whose text occurs in a row's text, for term tables of any size and terms of any length.

    A term meets the texts that have its rarest gram: of its substrings of `gram` characters (a shorter term is its own)
    the one that the fewest texts have. A term with a gram that no text has meets none. The whole term is then looked
    for in the whole text.
    """
    known = terms.filter(F.length(term) > 0).select(term).distinct().withColumn("_g", F.least(F.length(term), F.lit(gram)))
    lengths = sorted(r[0] for r in known.select("_g").distinct().collect())  # `gram` numbers at most
    if not lengths:
        return texts.select(key).join(terms, F.lit(False)).select(key, *terms.columns)
    whole = F.coalesce(*[F.when(F.col("_g") == n, grams(term, [n])) for n in lengths])
    parts = known.select(term, F.explode(whole).alias("_key"))
    probe = texts.select(key, F.explode(grams(text, lengths)).alias("_key")).join(parts.select("_key").distinct(), "_key")
    held = probe.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    rarest = parts.join(held, "_key", "left").groupBy(term).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_key")).alias("r"))
    chosen = rarest.filter("r.n > 0").select(term, F.col("r._key").alias("_key"))
    near = probe.join(chosen, "_key").select(key, term).distinct()
    hit = near.join(texts.select(key, text), key).filter(F.col(text).contains(F.col(term))).select(key, term).distinct()
    return hit.join(terms, term).select(key, *terms.columns).distinct()


def exact_trigger(df: DataFrame, text, phrases: DataFrame, phrase="phrase") -> DataFrame:
    """Requests that equal a phrase after normalising both."""
    p = phrases.withColumn("_n", X.normalize(F.col(phrase))).dropDuplicates(["policy_id", "_n"])
    return df.withColumn("_n", X.normalize(F.col(text))).join(p, "_n").drop("_n")


def refusal_category(text: Column, action: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.when(action != "refuse", "answerable")
    for name, terms in CATEGORY_RULES:
        out = out.when(contains_any(low, terms), name)
    return out.otherwise("policy_denied")


def query_family(text: Column, action: Column, dims: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(action == "refuse", "policy_refusal")
        .when(low.contains("top10") | low.contains("top 10"), "ranking_topk")
        .when(F.size(dims) >= 2, "multi_dimension")
        .when(F.size(dims) == 1, "single_dimension")
        .otherwise("flat_metric")
    )


def key_like_columns(columns: DataFrame, used: DataFrame, on) -> DataFrame:
    """Columns named like keys that a request has not used yet."""
    return columns.filter(F.lower("column").rlike("id|name|code")).join(used, on, "left_anti")


def consistent(df: DataFrame, mapping: DataFrame, on) -> DataFrame:
    """Rows that agree with a reference mapping on every join column."""
    return df.join(mapping.select(*on).distinct(), on, "left_semi")


def sensitive_mention(df: DataFrame, protected: DataFrame, on, text="sql", columns="columns") -> DataFrame:
    """Rows whose text mentions none of the protected names of their database; one row per database on the right."""
    hit = F.exists(columns, lambda c: F.contains(F.col(text), c))
    return df.join(protected, on).filter(~hit).drop(columns)


def keyword_clean(df: DataFrame, text) -> DataFrame:
    """Drop WITH queries and collapse blanks."""
    return df.filter(~F.col(text).rlike(r"(?i)\bwith\b")).withColumn(text, F.trim(F.regexp_replace(text, r"\s+", " ")))


def columns_mentioned(listing: Column, text: Column) -> Column:
    """Every name of a bracketed list, without its parentheses, occurs in the text."""
    inner = F.trim(F.regexp_replace(listing, r"^\[|\]$", ""))
    names = F.transform(F.split(inner, ","), lambda c: F.trim(F.regexp_replace(c, r"\([^)]*\)", "")))
    return F.forall(names, lambda c: (c == "") | F.contains(text, c))


def value_in_column(df: DataFrame, results: DataFrame, on, value="value", cell="cell", tol=1e-6) -> DataFrame:
    """Rows whose value occurs among the cells of their result, as a number within `tol` or as text.

    Numbers meet in equal buckets two tolerances wide and their neighbours, so the match stays an equi join.
    """
    width = 2 * tol
    num = F.col("_num")
    bucket = F.floor(num / width)
    wanted = df.withColumn("_num", F.col(value).try_cast("double")).withColumn(
        "_key", F.when(num.isNull(), F.array(F.concat(F.lit("t"), F.col(value)))).otherwise(
            F.transform(F.array(bucket - 1, bucket, bucket + 1), lambda b: F.concat(F.lit("n"), b.cast("string")))))
    have = results.select(*on, F.col(cell).alias("_cell")).withColumn("_num", F.col("_cell").try_cast("double")).withColumn(
        "_key", F.when(num.isNull(), F.concat(F.lit("t"), F.col("_cell"))).otherwise(F.concat(F.lit("n"), bucket.cast("string"))))
    have = have.select(*on, "_key", F.col("_num").alias("_cellnum")).distinct()
    near = F.col("_num").isNull() | (F.abs(F.col("_num") - F.col("_cellnum")) < tol)
    hit = wanted.withColumn("_key", F.explode("_key")).join(have, [*on, "_key"]).filter(near)
    return df.join(hit.select(*on, value).distinct(), [*on, value], "left_semi")

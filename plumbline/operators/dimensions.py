"""What a request's dimensions amount to: which ones its text names, which are finest, unknown, and what they read.

Two forms with equal results. Inline, every dimension of a catalog is a column expression: no shuffle, for catalogs of
up to MAX_INLINE dimensions. Joined, the catalog is a table of any size: distinct texts meet an inverted index of the
aliases, distinct sets of dimensions meet the closed hierarchy, and both answers are joined back to the requests.
"""

import re

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as X
from plumbline.operators import joins as J
from plumbline.sources.catalog import MAX_INLINE, Catalog, rows_of

STRINGS = "array<string>"
FOUND = "array<struct<rank:int,dimension_id:string,domain_id:string>>"
#: What `with_sets` adds: dimensions that are no ancestor of another one, those the catalog lacks, the columns that the
#: finest ones read, and each dimension's ancestors.
SET = ["_resolved", "_unknown", "_dim_fields", "_above"]
SET_TYPES = [STRINGS, STRINGS, STRINGS, "array<struct<d:string,up:array<string>>>"]
TABLE = "dimension_id string, grain_rank int, domain_id string, ancestors array<string>, fields array<string>"


def none(kind=STRINGS) -> Column:
    return F.array().cast(kind)


def gather(cases, kind=STRINGS) -> Column:
    """Array of the values whose condition holds, in order; stays in generated code."""
    arrays = [F.when(cond, F.array(value)).otherwise(none(kind)) for cond, value in cases]
    return F.concat(*arrays) if arrays else none(kind)


def aliases(d) -> list:
    return [d["dimension_id"], d.get("name") or "", *(d.get("aliases") or [])]


def fields(catalog: Catalog) -> dict:
    """dimension -> identifiers its expression reads."""
    stop = set(X.SQL_WORDS + catalog.extra_sql_words)
    words = {}
    for d in catalog.dimensions:
        bare = re.sub(r"'[^']*'|\"[^\"]*\"", " ", d.get("sql") or "")
        words[d["dimension_id"]] = sorted({w.lower() for w in re.findall(r"[A-Za-z_]\w*", bare)} - stop)
    return words


def inline(catalog: Catalog, form="auto") -> bool:
    """Whether dimensions become expressions: by the size of the catalog, unless `form` says inline or joined."""
    return form == "inline" or (form == "auto" and len(catalog.dimensions) <= MAX_INLINE)


# --- the catalog as tables ----------------------------------------------------------------------


def table(spark, catalog: Catalog) -> DataFrame:
    """(dimension_id, grain_rank, domain_id, ancestors, fields) of a catalog held in lists."""
    from pyspark.sql.types import _parse_datatype_string

    up, reads = catalog.closure(), fields(catalog)
    rows = [dict(dimension_id=d["dimension_id"], grain_rank=d.get("grain_rank") or 0, domain_id=d.get("domain_id") or "", ancestors=up[d["dimension_id"]],
                 fields=reads[d["dimension_id"]]) for d in {d["dimension_id"]: d for d in catalog.dimensions}.values()]
    return rows_of(spark, rows, _parse_datatype_string(TABLE))


def table_of(dimensions: DataFrame, stop=tuple(X.SQL_WORDS)) -> DataFrame:
    """The same from a table of dimensions of any size (dimension_id, parent, sql, grain_rank, domain_id)."""
    closed = J.closure(dimensions.select(F.col("dimension_id").alias("child"), F.coalesce("parent", F.lit("")).alias("parent")))
    up = closed.groupBy(F.col("child").alias("dimension_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("ancestors"))
    return dimensions.join(up, "dimension_id", "left").select(
        "dimension_id", F.coalesce("grain_rank", F.lit(0)).alias("grain_rank"), F.coalesce("domain_id", F.lit("")).alias("domain_id"),
        F.coalesce("ancestors", none()).alias("ancestors"), F.sort_array(X.identifiers(F.col("sql"), stop)).alias("fields"))


def alias_table(spark, catalog: Catalog) -> DataFrame:
    """(alias, rank, dimension_id, domain_id), aliases as they are looked for in normalised texts."""
    from pyspark.sql.types import _parse_datatype_string

    rows = [dict(alias=" ".join(str(a).lower().split()), rank=d.get("grain_rank") or 0, dimension_id=d["dimension_id"], domain_id=d.get("domain_id") or "")
            for d in catalog.dimensions for a in aliases(d)]
    return rows_of(spark, [r for r in rows if r["alias"]], _parse_datatype_string("alias string, rank int, dimension_id string, domain_id string"))


# --- both forms ---------------------------------------------------------------------------------


def found_inline(scope: Column, catalog: Catalog) -> Column:
    """Dimensions named in a text, with their rank and domain, by rank and id."""
    cases = []
    for d in catalog.ranked_dimensions:
        row = F.struct(F.lit(d.get("grain_rank") or 0).alias("rank"), F.lit(d["dimension_id"]).alias("dimension_id"), F.lit(d.get("domain_id") or "").alias("domain_id"))
        cases.append((X.contains_any_alias(scope, aliases(d)), row))
    return gather(cases, FOUND)


def with_found(df: DataFrame, scope: str, catalog: Catalog, form="auto") -> DataFrame:
    """Add `_found`: the dimensions that a text names."""
    if inline(catalog, form):
        return df.withColumn("_found", found_inline(F.col(scope), catalog))
    texts = df.select(F.col(scope).alias("_text")).filter("_text <> ''").distinct()
    hits = J.alias_join(texts.select(F.col("_text").alias("_named"), "_text"), "_named", "_text", alias_table(df.sparkSession, catalog))
    found = hits.groupBy("_named").agg(F.sort_array(F.collect_set(F.struct("rank", "dimension_id", "domain_id"))).alias("_found"))
    joined = df.join(found, df[scope] == found["_named"], "left")
    return joined.select(*df.columns, F.coalesce("_found", none(FOUND)).alias("_found"))


def set_inline(requested: Column, catalog: Catalog) -> dict:
    """The columns of SET as expressions."""
    closure, reads = catalog.closure(), fields(catalog)
    has = lambda d: F.array_contains(requested, d)
    all_of = lambda chosen, values: [F.when(F.array_contains(chosen, k), X.lit_list(v)).otherwise(none()) for k, v in values.items() if v]
    shadowed, up = all_of(requested, closure), [(d, a) for d, a in sorted(closure.items()) if a]
    resolved = F.array_except(requested, F.concat(*shadowed)) if shadowed else F.array_distinct(requested)
    read = all_of(resolved, reads)
    above = gather([(has(d), F.struct(F.lit(d).alias("d"), X.lit_list(a).alias("up"))) for d, a in up], SET_TYPES[3])
    return dict(zip(SET, [resolved, F.array_except(requested, X.lit_list([d["dimension_id"] for d in catalog.dimensions])), F.concat(*read) if read else none(), above]))


def in_domain(found: Column, domain=None) -> Column:
    """Ids of the found dimensions of a domain, or of none; an empty domain sees all."""
    if domain is not None:
        found = F.filter(found, lambda d: (d["domain_id"] == "") | F.coalesce(domain, F.lit("")).isin("", d["domain_id"]))
    return F.transform(found, lambda d: d["dimension_id"])


def with_named(df: DataFrame, scope: str, domain: str, catalog: Catalog) -> DataFrame:
    """Joined form: add `_requested`, the dimensions of a domain that a text names, and the columns of SET for them.

    All of it is worked out for distinct texts and domains (neither is null), so that the rows themselves are joined once.
    """
    pairs = df.select(F.col(scope).alias("_text"), F.col(domain).alias("_in")).filter("_text <> ''").distinct()
    texts = pairs.groupBy("_text").agg(F.sort_array(F.collect_list("_in")).alias("_ins")).select(F.struct("_text", "_ins").alias("_named"), "_text")
    hits = J.alias_join(texts, "_named", "_text", alias_table(df.sparkSession, catalog))
    found = hits.groupBy("_named").agg(F.sort_array(F.collect_set(F.struct("rank", "dimension_id", "domain_id"))).alias("_found"))
    per = found.select(F.col("_named._text").alias("_text"), F.explode("_named._ins").alias("_in"), "_found")
    per = with_sets(per.select("_text", "_in", in_domain(F.col("_found"), F.col("_in")).alias("_requested")), "_requested", catalog, "joined")
    joined = df.join(per, (df[scope] == per["_text"]) & (df[domain] == per["_in"]), "left")
    return joined.select(*df.columns, *[F.coalesce(n, none(kind)).alias(n) for n, kind in zip(["_requested", *SET], [STRINGS, *SET_TYPES])])


def with_sets(df: DataFrame, requested: str, catalog: Catalog, form="auto") -> DataFrame:
    """Add the columns of SET for the dimensions in an array column (null: null, but for `_above`, which is empty)."""
    if inline(catalog, form):
        return df.select("*", *[c.alias(n) for n, c in set_inline(F.col(requested), catalog).items()])
    sets = df.select(F.col(requested).alias("_set")).filter("size(_set) > 0").distinct()
    one = sets.select("_set", F.explode(F.array_distinct("_set")).alias("dimension_id")).join(table(df.sparkSession, catalog), "dimension_id", "left")
    member = F.struct(F.col("dimension_id").alias("d"), F.col("ancestors").alias("up"), F.col("fields").alias("reads"))
    grouped = one.groupBy("_set").agg(F.sort_array(F.collect_list(member)).alias("_m"))
    known = F.filter("_m", lambda x: x["up"].isNotNull())
    shadowed = F.flatten(F.transform(known, lambda x: x["up"]))
    per = grouped.select("_set", F.array_except("_set", shadowed).alias("_resolved"), "_m", known.alias("_k")).select(
        "_set", "_resolved", F.array_except("_set", F.transform("_k", lambda x: x["d"])).alias("_unknown"),
        F.flatten(F.transform(F.filter("_k", lambda x: F.array_contains("_resolved", x["d"])), lambda x: x["reads"])).alias("_dim_fields"),
        F.transform(F.filter("_k", lambda x: F.size(x["up"]) > 0), lambda x: F.struct(x["d"].alias("d"), x["up"].alias("up"))).alias("_above"))
    joined = df.join(per, df[requested] == per["_set"], "left")
    blank = lambda n, kind: F.when(F.col(requested).isNotNull() | F.lit(n == "_above"), F.coalesce(n, none(kind))).alias(n)
    return joined.select(*df.columns, *[blank(n, kind) for n, kind in zip(SET, SET_TYPES)])

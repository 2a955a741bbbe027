"""Readers for catalogs, documents and listings; every absent file is an empty table."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.functions import text as X


def exists(spark: SparkSession, path) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def catalog_jsonl(spark, path, schema) -> DataFrame:
    """Typed rows of a JSON-lines catalog."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def json_doc(spark, path, schema) -> DataFrame:
    """Whole JSON documents, or an empty table of the same schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_snapshot(spark, path, numbers, whole, dates, limit=None) -> DataFrame:
    """CSV rows: a bad number becomes null, a bad whole number 0, a date keeps its first ten characters."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if limit:
        raw = raw.limit(limit)
    out = []
    for c in raw.columns:
        col = F.col(c)
        if c in numbers:
            col = col.try_cast("double")
        elif c in whole:
            col = F.coalesce(col.try_cast("double").cast("int"), F.lit(0))
        elif c in dates:
            col = F.substring(F.coalesce(col, F.lit("")), 1, 10)
        out.append(col.alias(c))
    return raw.select(*out)


def typed(df: DataFrame, types: dict) -> DataFrame:
    """Re-type every column."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


MANIFEST = (
    "semantic_models array<struct<name:string,"
    "measures:array<struct<name:string,agg:string,expr:string>>,"
    "entities:array<struct<name:string,type:string>>,"
    "dimensions:array<struct<name:string,type:string,grain:string>>>>,"
    "metrics array<struct<name:string,type:string,measure:string,numerator:string,denominator:string,expr:string,inputs:array<string>>>"
)


def manifest(df: DataFrame, text="manifest", key="manifest_id"):
    """Manifest JSON rows -> DataFrames of models, measures, entities, dimensions and metrics."""
    parsed = df.select(key, F.from_json(text, MANIFEST).alias("m"))
    models = parsed.select(key, F.explode("m.semantic_models").alias("s")).select(key, F.col("s.name").alias("model"), "s")
    part = lambda field: models.select(key, "model", F.explode(f"s.{field}").alias("x")).select(key, "model", "x.*")
    return {
        "models": models.select(key, "model"),
        "measures": part("measures"),
        "entities": part("entities"),
        "dimensions": part("dimensions"),
        "metrics": parsed.select(key, F.explode("m.metrics").alias("x")).select(key, "x.*"),
    }


def schema_doc(df: DataFrame) -> DataFrame:
    """(db_id, table_names, column_names[[index, name]]) -> one row per column of a real table."""
    cols = df.select("db_id", "table_names", F.posexplode("column_names").alias("pos", "c")).filter("c.table_idx >= 0")
    return cols.select("db_id", F.get("table_names", F.col("c.table_idx")).alias("table"), F.col("c.name").alias("column"), "pos")


def ddl_columns(df: DataFrame) -> DataFrame:
    """CREATE TABLE text -> (db_id, table, column, comment); lines of one document stay in one array."""
    blocks = df.select("db_id", F.posexplode(F.split("ddl", r"(?i)create\s+table\s+")).alias("block", "body")).filter("block > 0")
    table = X.clean_id(F.regexp_extract("body", r"^[`\"]?([^`\"(]+)[`\"]?\s*\(", 1))
    lines = blocks.select("db_id", "block", table.alias("table"), F.posexplode(F.split(F.regexp_replace("body", r"^[^\n]*\n", ""), "\n")).alias("pos", "raw"))
    line = F.trim("raw")
    col_part = F.trim(F.regexp_replace(F.regexp_extract(line, "^(.*?)(?:--|$)", 1), r",\s*$", ""))
    name = F.regexp_replace(F.regexp_extract(col_part, r"^(\S+)", 1), r"^[`\"\[\]]+|[`\"\[\]]+$", "")
    skip = line.startswith(")") | line.rlike(r"(?i)^(primary|foreign|unique|constraint)\s") | (col_part == "") | F.lower(name).isin("", "primary", "foreign")
    return lines.filter(~skip).select(
        "db_id", "table", X.clean_id(name).alias("column"), F.trim(F.regexp_extract(line, "--(.*)$", 1)).alias("comment"), "block", "pos"
    )


def schema_listing(df: DataFrame) -> DataFrame:
    """'table t , columns = [ t.c ( type | primary key ) , …]' -> one row per column with a key flag."""
    tables = df.select("db_id", F.explode(F.regexp_extract_all("listing", F.lit(r"(table\s+\w+\s*,\s*columns\s*=\s*\[[^\]]+\])"), F.lit(1))).alias("t"))
    cols = tables.select(
        "db_id", F.regexp_extract("t", r"table\s+(\w+)", 1).alias("table"),
        F.posexplode(F.regexp_extract_all("t", F.lit(r"([\w.]+\s*\([^)]*\))"), F.lit(1))).alias("pos", "c"),
    )
    return cols.select(
        "db_id", "table", F.element_at(F.split(F.trim(F.regexp_extract("c", r"^([\w.]+)", 1)), r"\."), -1).alias("column"),
        F.contains("c", F.lit("primary key")).alias("is_pk"), "pos",
    )


def concat_parts(parts) -> DataFrame:
    """Part files one after another; a column one part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def positional_pair(left: DataFrame, right: DataFrame, on="pos") -> DataFrame:
    """Zip two inputs by the row position they carry; the shorter one ends the result."""
    return left.join(right, on)

"""Writers of row files."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names; a local one only under a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="plumbline-")
    return f"{base}/{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path, mode="errorifexists"):
    """JSON lines with keys in alphabetical order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


#: Documents of one file.
DOCS_A_FILE = 1000


def write_docs(docs: DataFrame, key, text, path):
    """JSON documents, one of each key, as files that hold a list of some of them: their number does not become one of files."""
    one = docs.groupBy(key).agg(F.first(text, ignorenulls=True).alias("_d")).filter(F.col("_d").isNotNull())
    files = F.pmod(F.xxhash64(key), F.lit(-(-docs.count() // DOCS_A_FILE) or 1)).alias("_f")
    lists = one.groupBy(files).agg(F.concat(F.lit("["), F.array_join(F.collect_list("_d"), ",\n"), F.lit("]")).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)


def pending(df: DataFrame, log: DataFrame, key) -> DataFrame:
    """Rows whose key the log does not hold yet."""
    return df.join(log.select(key).distinct(), key, "left_anti")


def resume_append(df: DataFrame, path, key, run) -> DataFrame:
    """Append the rows the log at `path` lacks as one run; returns the whole log."""
    from plumbline.sources.readers import exists

    spark = df.sparkSession
    todo = pending(df, spark.read.parquet(path), key) if exists(spark, path) else df
    todo.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)
    return spark.read.parquet(path)

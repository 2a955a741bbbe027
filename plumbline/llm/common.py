"""What several operators share: reading, batches of documents, words, durable intermediate tables."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import checkpointed

#: Words are runs of anything but ASCII white space.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Bytes of one Arrow batch handed to Python, so that a batch of long texts stays small.
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, not by rows only."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(df: DataFrame, id_col="doc_id", text_col="text", key_col=None) -> DataFrame:
    """Just `doc_id` and `text` (null: empty), whatever else the table has; and `row_key`, a whole number, if asked for."""
    small_batches(df.sparkSession)
    key = [F.col(key_col).cast("long").alias("row_key")] if key_col else []
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *key)


def written(df: DataFrame) -> DataFrame:
    """The table written as Parquet below the shared folder, and read again."""
    import tempfile
    import uuid

    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """A copy in the shared folder: lineage ends here, and no executor's loss repeats the work."""
    return checkpointed(df)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def per_document(df: DataFrame, ddl: str, make, key_col=None) -> DataFrame:
    """`make()` runs once a task and returns a function of (doc_id, text) giving the cells after doc_id; `row_key` is last."""
    ddl = "doc_id long," + ddl + ",row_key long" * bool(key_col)
    schema = arrow_schema(ddl)

    def run(batches):
        row = make()
        for batch in batches:
            ids = batch.column(0)
            cells = [row(text) for text in batch.column(1).to_pylist()]
            columns = zip(*cells) if cells else [[] for _ in schema.names[1 : len(schema) - bool(key_col)]]
            made = [pa.array(list(c), k) for c, k in zip(columns, schema.types[1:])]
            yield pa.record_batch([ids.cast(pa.int64()), *made, *batch.columns[2:]], schema=schema)

    return text_of(df, key_col=key_col).mapInArrow(run, ddl)




def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how="inner", share=1000) -> DataFrame:
    """Join of rows (inner or left) to one row per key, with `n`, the rows of that key, that no hot key can clog.

    Keys with over 1/share of all rows are fewer than `share`, whatever the input's size, and are broadcast; the rest
    meet in a shuffle in which no key holds more than that share.
    """
    hot = F.broadcast(groups.filter(F.col("n") * share > total))
    cold = groups.filter(F.col("n") * share <= total)
    cols = [*rows.columns, *[c for c in groups.columns if c not in keys]]
    return rows.join(hot, keys).select(*cols).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how).select(*cols))


#: Bytes of text that a chunk of documents holds on average: what one call of a grouped function works on.
CHUNK_BYTES = 2 << 20


def chunked(df: DataFrame, id_col="doc_id", text_col="text", carry=()) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text, _0, _1, ...: the columns to carry): documents dealt into chunks by their hash; and how many.

    Steps that go over the texts again take the chunks from the same exchange: Spark reuses it, as the plans are equal.
    """
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // CHUNK_BYTES + 1
    cells = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *cells)
    return texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), "*"), n


def batch_of(schema: pa.Schema, rows: list) -> pa.Table:
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def whole_groups(batches):
    """Arrow batches sorted by their first column, cut anew so that no group of equal values is divided."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        if held is not None:
            table = pa.concat_tables([held, table])
        key = table.column(0).to_numpy()
        cut = int((key != key[-1]).sum()) if key[0] != key[-1] else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held

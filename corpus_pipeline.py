"""From raw documents to packed training sequences: each stage's Parquet output is the next one's input.

Every row is judged by its own text, whatever other rows have its id, or none: decisions are taken by id and a
fingerprint of the text. Only rows of one id and one text are the same to them; the near-duplicate stage leaves one of
those. It keeps rows with a null id, as texts that others are held against, and the repeated strings of rows that share
an id are no repeats of each other. Stages keep all columns of `documents`, in their order, extra ones too.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import documents, written
from plumbline.llm.decontamination import contaminated
from plumbline.llm.near_dedup import near_dedup
from plumbline.llm.packing import pack
from plumbline.llm.suffix_dedup import suffix_dedup
from plumbline.llm.toxicity import toxicity


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row_key, row): row_key is a fingerprint of the text, row all columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key"), F.struct(*docs.columns).alias("row"))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of `docs` but those whose (doc_id, row_key) is in `found`; null ids are equal to each other."""
    gone = found.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    rows = keyed(docs)
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left_anti").select("row.*")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; null and empty texts stay."""
    told = toxicity(keyed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), key_col="row_key")
    return without(docs, told.filter("predicted = 1"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (words of five, similarity of 0.8) the row with the smallest id.

    Of several rows with that id the one with the smallest fingerprint. Texts without words have no copies: all stay.
    """
    found = near_dedup(keyed(docs), words=5, percent=80, key_col="row_key").filter("doc_id IS NOT NULL")
    best = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("best")).select("best.*")
    # rows of one id and text are reduced before the join, so that no flood of them meets in one task
    # to the least of them by a hash of the whole row
    rows = keyed(docs).groupBy("doc_id", "row_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    kept = rows.join(best.distinct(), ["doc_id", "row_key"]).select("row.*")
    bare = keyed(docs).filter(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x09-\\x0d\\x20]"))
    return kept.unionByName(bare.select("row.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the characters of 50-byte strings that begin in a document with a smaller id too.

    n_chars follows the text. A document that loses everything stays as an empty text; a null text stays null.
    """
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("void"), F.struct(*rest).alias("rest")).alias("row"))
    found = suffix_dedup(whole, window=50, with_text=True, carry=["row"])
    text = F.when(~F.col("row.void"), F.col("cleaned"))
    out = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("cleaned")).otherwise(F.col("row.rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[out.get(c, F.col("row").getField("rest").getField(c)).alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contaminated(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key_col="row_key")
    return without(docs, found)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row per piece of a document."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: A language model, automata and a packing by linear program are not SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; an empty table gives no rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

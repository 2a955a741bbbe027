from plumbline.llm.common import durable
from plumbline.llm.queries import query
from plumbline.llm.warc import read_records, write_records


@query("op6_warc")
def op6(spark, folder):
    return read_records(durable(write_records(spark.read.parquet(f"{folder}/pages.parquet"))), in_order=True)

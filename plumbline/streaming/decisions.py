"""The decision step over a stream of requests: it keeps no state, so the batch operator runs unchanged."""

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.contract import compile_requests, contract_of
from plumbline.sources.catalog import Catalog


def decide_stream(spark: SparkSession, folder, schema, catalog: Catalog) -> DataFrame:
    """A streaming DataFrame of decisions for request files arriving in a folder."""
    requests = spark.readStream.schema(schema).parquet(folder)
    return compile_requests(requests, contract_of(spark, catalog), catalog)


def write_decisions(decisions: DataFrame, out, checkpoint):
    """Append decisions to a Parquet folder, exactly once, until the waiting files are done."""
    return decisions.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)

from plumbline.llm.common import documents
from plumbline.llm.queries import query
from plumbline.llm.sharding import shard


@query("op5_sharding")
def op5(spark, folder):
    return shard(documents(spark, folder), shards=40)

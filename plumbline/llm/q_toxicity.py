from plumbline.llm.common import documents
from plumbline.llm.queries import query
from plumbline.llm.toxicity import toxicity


@query("op10_toxicity")
def op10(spark, folder):
    return toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))

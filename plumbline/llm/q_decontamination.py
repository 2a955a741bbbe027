from plumbline.llm.common import documents
from plumbline.llm.decontamination import contaminated
from plumbline.llm.queries import query


@query("op4_decontamination")
def op4(spark, folder):
    return contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))

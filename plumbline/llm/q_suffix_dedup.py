from plumbline.llm.common import documents
from plumbline.llm.queries import query
from plumbline.llm.suffix_dedup import suffix_dedup


@query("op2_suffix_dedup")
def op2(spark, folder):
    return suffix_dedup(documents(spark, folder), window=50)

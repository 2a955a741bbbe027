import public_tokenizers

from plumbline.llm.common import documents
from plumbline.llm.packing import pack
from plumbline.llm.queries import query


@query("op8_packing")
def op8(spark, folder):
    return pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)

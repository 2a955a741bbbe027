import public_tokenizers

from plumbline.llm.common import documents
from plumbline.llm.queries import query
from plumbline.llm.token_counts import token_counts


@query("op3_token_counts")
def op3(spark, folder):
    return token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)

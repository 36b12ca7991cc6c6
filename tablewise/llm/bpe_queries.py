"""Query of the BPE encoding and decoding."""

import public_tokenizers

from tablewise.llm import bpe
from tablewise.llm.common import table
from tablewise.llm.registry import query


@query("op6_bpe_chunks")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

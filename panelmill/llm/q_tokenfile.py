from __future__ import annotations

import public_tokenizers

from . import tokenfile
from .common import read
from .registry import register

TOKENIZER = "byte_bpe_50k.json"


@register("op11_token_files")
def op11_token_files(spark, sf_dir):
    """Start, length and checksum of every document's ids, read back from Huffman-coded files."""
    path = tokenfile.scratch(spark)
    tokenfile.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return tokenfile.read(spark, path, ids=False)

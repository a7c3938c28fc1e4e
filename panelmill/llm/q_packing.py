from __future__ import annotations

import public_tokenizers

from . import packing
from .common import read
from .registry import register

TOKENIZER = "word_bpe_49k.json"


@register("op5_pack_sequences")
def op5_pack_sequences(spark, sf_dir):
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))

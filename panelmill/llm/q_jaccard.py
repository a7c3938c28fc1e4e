from __future__ import annotations

from . import jaccard
from .common import read
from .registry import register


@register("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    """Near-duplicate class and number of links of every document."""
    return jaccard.classes(read(spark, sf_dir, "documents")).drop("d", "e", "stays")

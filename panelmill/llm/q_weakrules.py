from __future__ import annotations

from . import weakrules
from .common import read
from .registry import register

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]


@register("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    """Counts, base rule and weakly supervised verdict of every document."""
    return weakrules.judge(read(spark, sf_dir, "documents")).select(*COLUMNS)

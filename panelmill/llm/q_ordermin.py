from __future__ import annotations

from . import ordermin
from .common import read
from .registry import register


@register("op6_fingerprints")
def op6_fingerprints(spark, sf_dir):
    """Order MinHash of every document and of its edited text."""
    return ordermin.fingerprints(read(spark, sf_dir, "documents"))

from __future__ import annotations

from . import licences
from .common import read
from .registry import register


@register("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    """Licence phrases and detections of every document."""
    return licences.scan(read(spark, sf_dir, "documents")).drop("found")

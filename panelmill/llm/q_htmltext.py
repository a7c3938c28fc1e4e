from __future__ import annotations

from . import htmltext
from .common import read
from .registry import register


@register("op3_main_text")
def op3_main_text(spark, sf_dir):
    """Main text of every page: page_id, url, text, n_chars."""
    return htmltext.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))

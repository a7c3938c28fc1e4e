"""Imports every query module, so that the registry is full."""

from . import q_htmltext, q_importance, q_infill, q_jaccard, q_langid, q_licences, q_mixing, q_ordermin, q_packing, q_repeats, q_rulefit, q_tokenfile, q_weakrules  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

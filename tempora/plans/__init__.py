"""Queries of the engine and their oracles, by name."""

from ..registry import ORACLES, QUERIES
from . import acoustic_queries, amend_queries, anchor_queries, audit_queries, brand_queries, compile_queries, cut_queries, draft_queries, film_queries, framing_queries, graphic_queries, measure_queries, move_queries, opening_queries, phrase_queries, speech_queries, staging_queries, stream_queries, timeline_queries

__all__ = ["ORACLES", "QUERIES", "acoustic_queries", "amend_queries", "anchor_queries", "audit_queries", "brand_queries", "compile_queries", "cut_queries", "draft_queries", "film_queries", "framing_queries", "graphic_queries", "measure_queries", "move_queries", "opening_queries", "phrase_queries", "speech_queries", "staging_queries", "stream_queries", "timeline_queries"]

"""The library's operators under one roof."""

from larkspur.functions.text import clean_text, first_truthy, match_text
from larkspur.functions.urls import canonical_url, dedupe_keys, state_key
from larkspur.operators.classify import classify_sources
from larkspur.operators.grounding import check_claims as grounding
from larkspur.operators.relational import clean_shared, coverage, enrich_with_budget, expect_parts, greedy_dedupe, merge_state, overlay
from larkspur.operators.scoring import Settings, score_postings
from larkspur.operators.state import BucketState, anti_join_seen, state_keys
from larkspur.sources.payloads import Mapping
from larkspur.sources.payloads import dispatch as normalise_payloads
from larkspur.streaming.postings import alert_once, carry_over, deliver_by_runs, delivered, first_alerts, notice_stream, notices, posting_stream, recent_alerts

__all__ = [
    "BucketState", "Mapping", "Settings", "alert_once", "anti_join_seen", "canonical_url", "carry_over", "classify_sources", "clean_shared", "clean_text", "coverage", "dedupe_keys", "deliver_by_runs", "delivered",
    "enrich_with_budget", "expect_parts", "first_alerts", "first_truthy", "greedy_dedupe", "grounding", "match_text", "merge_state", "normalise_payloads",
    "notice_stream", "notices", "overlay", "posting_stream", "recent_alerts", "score_postings", "state_key", "state_keys",
]

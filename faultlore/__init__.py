"""Explain log lines, sum up incidents and report API usage, on Spark tables and streams."""

from faultlore.catalogue import BUILTIN_RULES, Modifier, Rule, read_rule_file, read_rules, rules_from_json
from faultlore.operators.explaining import assess_logs, explain_logs, known_only
from faultlore.operators.incidents import (
    CORRELATIONS, Correlation, incident_summary, incident_timeline, incident_timeline_pages)
from faultlore.operators.matching import keyword_candidates, rank_candidates
from faultlore.operators.parsing import event_time, parse_log_line, reject_empty_logs, with_event_time
from faultlore.operators.rule_tables import match_rule_table, rule_index
from faultlore.operators.usage import attribute_requests, rate_limit_breaches, throttle_windows, usage_stats

__all__ = [
    "BUILTIN_RULES", "CORRELATIONS", "Correlation", "Modifier", "Rule", "assess_logs",
    "attribute_requests", "event_time", "explain_logs", "incident_summary",
    "incident_timeline", "incident_timeline_pages", "keyword_candidates", "known_only", "match_rule_table", "parse_log_line",
    "rank_candidates", "rate_limit_breaches", "read_rule_file", "read_rules", "reject_empty_logs", "rule_index", "rules_from_json",
    "throttle_windows", "usage_stats", "with_event_time",
]

"""Lines with expected results, as listed in FIXTURES.md, and a plain matcher."""

from __future__ import annotations

import math
import os
import re

from faultlore.catalogue import BUILTIN_RULES

_ROW = re.compile(
    r"\| (F\d+) \| `(.*?)` \| (\w+) \| ([\d.]+) \| (\w+) \| (\d+) \| (\w+) \| (.*?) \|")


def scored_lines():
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "FIXTURES.md")
    with open(path, encoding="utf-8") as fh:
        return [m.groups() for m in map(_ROW.match, fh) if m]


LINES = {row[0]: row[1] for row in scored_lines()}


def utf16(text: str) -> int:
    return len(text.encode("utf-16-be")) // 2


def brute_force(line: str, rules=BUILTIN_RULES):
    """Matching rules best first, by trying every regex on the line."""
    found = []
    for rank, rule in enumerate(rules, start=1):
        lengths = [utf16(m.group()) for rx in rule.patterns
                   if (m := re.compile(rx, re.I | re.A).search(line))]
        if not lengths:
            continue
        confidence = min(0.6 + max(lengths) / utf16(line) * 0.3, 0.95)
        hits = sum(k.lower() in line.lower() for k in rule.keywords)
        confidence = min(confidence + min(hits * 0.05, 0.15), 0.99)
        if any(c in line for c in rule.error_codes):
            confidence = min(confidence + 0.1, 0.99)
        found.append((math.floor(confidence * 100 + 0.5) / 100, -rank, rule.rule_id))
    return [(rule_id, confidence) for confidence, _, rule_id in sorted(found, reverse=True)]

"""Bring rule regexes to Spark: dialect, and the text any match must contain.

Rules are written in one plain dialect (no look-around, no back-references).
Java differs from it in what ``.``, ``\\s``, ``\\S`` and ``\\b`` cover, so these are spelt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

try:
    import re._parser as re_parser
except ImportError:  # its name before Python 3.11
    import sre_parse as re_parser

from faultlore.functions.text import NOT_SPACE, SPACE, WHITESPACE

_TOKEN = re.compile(r"\\.|\[\^?|\]|\.", re.S)
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_BEYOND_DIALECT = (re_parser.ASSERT, re_parser.ASSERT_NOT, re_parser.GROUPREF, re_parser.GROUPREF_EXISTS)


def in_dialect(rx: str) -> bool:
    """Whether the regex does without look-around and back-references."""
    def plain(item) -> bool:
        if isinstance(item, (list, tuple, re_parser.SubPattern)):
            return all(map(plain, item))
        return not any(item is op for op in _BEYOND_DIALECT)

    return plain(re_parser.parse(rx))


def spark_regex(rx: str, ignore_case: bool = True) -> str:
    """The same regex in the dialect of Spark's regex functions."""
    in_class = False

    def spell(m: re.Match) -> str:
        nonlocal in_class
        t = m.group()
        if t == r"\s":
            return WHITESPACE if in_class else SPACE
        if t == r"\S" and not in_class:
            return NOT_SPACE
        if t == r"\b" and not in_class:
            return _BOUNDARY
        if t.startswith("\\"):
            return t
        if t == "." and not in_class:
            return r"[^\n\r\u2028\u2029]"
        if t.startswith("["):
            if in_class:
                return "\\" + t
            in_class = True
        elif t == "]":
            in_class = False
        return t

    return ("(?i)" if ignore_case else "") + _TOKEN.sub(spell, rx)


def sql_text(value: str) -> str:
    """A regex as a raw string literal of Spark SQL."""
    return 'r"' + value.replace('"', r"\x22") + '"'


def required_text(rx: str) -> list[tuple[str, ...]]:
    """Lower-case literals every match contains: all groups, any one of each.

    ``a1\\s+(?:b1|c1)`` gives ``[("a1",), ("b1", "c1")]``.  A line that lacks
    them cannot match.  Empty if the regex requires no literal text.
    """
    return sorted({g for g in _groups(re_parser.parse(rx)) if min(map(len, g)) >= 2})


def _groups(items) -> list[tuple[str, ...]]:
    found: list[tuple[str, ...]] = []
    run = ""
    for op, arg in [*items, (None, None)]:
        if op is re_parser.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            found.append((run,))
            run = ""
        if op in (re_parser.MAX_REPEAT, re_parser.MIN_REPEAT) and arg[0] >= 1:
            found += _groups(arg[2])
        elif op is re_parser.SUBPATTERN:
            found += _groups(arg[3])
        elif op is re_parser.BRANCH:
            best = [max(_groups(b), key=lambda g: min(map(len, g)), default=None) for b in arg[1]]
            if all(best):
                found.append(tuple(sorted({t for g in best for t in g})))
    return found


def prefix_tree_regex(words: Iterable[str], together: int = 5) -> str:
    """One regex for many words that shares their common beginnings.

    Matches the longest word that starts at a position.  A backtracking engine
    tries branches one by one, so wide forks are split into groups it can skip
    by one look at the next letter.
    """
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def spell(node: dict) -> str:
        letters = sorted(ch for ch in node if ch)
        branches = [re.escape(ch) + spell(node[ch]) for ch in letters]
        if not branches:
            return ""
        if len(branches) == 1 and "" not in node:
            return branches[0]
        if len(branches) > together:
            firsts = ["".join(map(re.escape, letters[i:i + together]))
                      for i in range(0, len(letters), together)]
            branches = [f"(?=[{first}])(?:{'|'.join(branches[i * together:(i + 1) * together])})"
                        for i, first in enumerate(firsts)]
        return "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")

    return spell(root)

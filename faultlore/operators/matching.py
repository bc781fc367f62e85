"""Match log lines against a rule catalogue.

All operators are row-wise: the rules become literals inside one projection,
so matching needs no join and no shuffle and runs unchanged on streams.

A line is read once by a single regex that finds the literal texts the rules
require; only regexes whose required text was found are tried on it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlore.catalogue import BUILTIN_RULES, Rule, check_rules
from faultlore.functions.regexes import (
    prefix_tree_regex, required_text, spark_regex, sql_text)
from faultlore.functions.text import constant, utf16_length

# Fixed values of the confidence formula.
BASE_CONFIDENCE = 0.6
LENGTH_WEIGHT = 0.3
REGEX_CAP = 0.95
KEYWORD_STEP = 0.05
KEYWORD_CAP = 0.15
ERROR_CODE_STEP = 0.1
CONFIDENCE_CAP = 0.99

_LOWERED = "_lowered"
_MARKS = "_marks"
_BUCKETS = 2048
_TELLING = 4  # shorter literals are in most lines


def regex_confidence(match_length: Column, line_length: Column) -> Column:
    return F.least(
        F.lit(BASE_CONFIDENCE) + match_length / line_length * F.lit(LENGTH_WEIGHT),
        F.lit(REGEX_CAP))


def keyword_boost(confidence: Column, keyword_hits: Column) -> Column:
    boost = F.least(keyword_hits * F.lit(KEYWORD_STEP), F.lit(KEYWORD_CAP))
    return F.least(confidence + boost, F.lit(CONFIDENCE_CAP))


def error_code_boost(confidence: Column, code_hit: Column) -> Column:
    # Without a code nothing is added, and the cap already holds.
    return F.least(
        confidence + F.when(code_hit, F.lit(ERROR_CODE_STEP)).otherwise(F.lit(0.0)),
        F.lit(CONFIDENCE_CAP))


def confidence_round(confidence: Column) -> Column:
    """Two decimals, half up; ranking uses the rounded value, so ties are common."""
    return F.floor(confidence * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


@lru_cache(maxsize=8)
def _search(rules: tuple[Rule, ...]) -> tuple[str, list[list[int]], list[int], str]:
    """What is searched for, as text: the regex that finds literal texts, the marks
    each literal sets (by hash bucket), marks set always, and the trial of a regex.

    Mark ``n`` is regex number ``n``: try it, unless the line lacks one of its further
    groups of literals.
    """
    check_rules(rules)
    regexes = [(rank, rx) for rank, r in enumerate(rules, start=1) for rx in r.patterns]
    groups = [required_text(rx) for _, rx in regexes]
    uses = Counter(t for gs in groups for g in gs for t in g)

    marks: dict[str, set[int]] = {}
    always, needed = [], []
    for number, gs in enumerate(groups, start=1):
        # A trial waits for the group of literals that other regexes use least.
        rarest_first = sorted(gs, key=lambda g: (sum(uses[t] for t in g), -min(map(len, g))))
        if not rarest_first:
            always.append(number)
        for text in rarest_first[0] if rarest_first else ():
            marks.setdefault(text, set()).add(number)
        needs = []
        for group in rarest_first[1:]:
            if min(map(len, group)) >= _TELLING:
                needs.append(" OR ".join(f"contains({_LOWERED}, {sql_text(text)})" for text in group))
        needed.append(needs)
    # The search reports the longest literal at a position; it stands for its prefixes.
    for text in sorted(marks, key=len):
        for prefix in marks:
            if prefix != text and text.startswith(prefix):
                marks[text] |= marks[prefix]

    # Literal -> marks by hash.  A collision only means a regex tried in vain.
    buckets: list[set[int]] = [set() for _ in range(_BUCKETS)]
    for text, numbers in marks.items():
        buckets[zlib.crc32(text.encode()) % _BUCKETS] |= numbers

    def trial(low: int, high: int) -> str:
        if high - low == 1:
            rank, rx = regexes[low]
            text = f"regexp_extract(raw_log, {sql_text(spark_regex(rx))}, 0)"
            if needed[low]:
                present = " AND ".join(f"({need})" for need in needed[low])
                text = f"IF({present}, {text}, '')"
            return f"named_struct('rank', {rank}, 'text', {text})"
        middle = (low + high) // 2
        return f"IF(n <= {middle}, {trial(low, middle)}, {trial(middle, high)})"

    find = f"(?=({prefix_tree_regex(marks)}))" if marks else "(?!)()"
    hits = f"filter(transform({_MARKS}, n -> {trial(0, len(regexes))}), h -> h.text != '')"
    return find, [sorted(b) for b in buckets], always, hits


def _hits(logs: DataFrame, rules: tuple[Rule, ...], kept: list[str]) -> DataFrame:
    """``kept`` and ``_hits``, an ``array<struct<rank, text>>``: one element per
    regex that matched."""
    find, buckets, always, hits = _search(rules)
    bucket = constant(buckets, "array<array<int>>")
    texts = F.array_distinct(F.regexp_extract_all(F.col(_LOWERED), F.lit(find), F.lit(1)))
    marks = F.flatten(F.transform(texts, lambda t: F.element_at(
        bucket, (F.crc32(t.cast("binary")) % _BUCKETS + 1).cast("int"))))
    if always:
        marks = F.concat(marks, F.array(*map(F.lit, always)))
    return (logs.select(*kept, F.array_distinct(marks).alias(_MARKS))
            .select(*kept, F.expr(hits).alias("_hits")))


def with_candidates(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES,
                    name: str = "candidates") -> DataFrame:
    """Adds the matching rules of each line, best first:
    ``array<struct<confidence, neg_rank, match_length, keyword_hits, code_hit>>``.
    """
    rules, kept = tuple(rules), logs.columns
    keywords = constant([[k.lower() for k in r.keywords] for r in rules], "array<array<string>>")
    codes = constant([list(r.error_codes) for r in rules], "array<array<string>>")
    line, lowered = F.col("raw_log"), F.col(_LOWERED)

    logs = _hits(logs.withColumn(_LOWERED, F.lower("raw_log")), rules, [*kept, _LOWERED])
    measured = F.transform("_hits", lambda h: F.struct(
        h["rank"].alias("rank"), utf16_length(h["text"]).alias("match_length")))
    # Of several regexes of one rule the longest match counts.
    longest = F.array_distinct(F.filter("_measured", lambda h: ~F.exists(
        "_measured", lambda o: (o["rank"] == h["rank"]) & (o["match_length"] > h["match_length"]))))
    scored = F.transform(longest, lambda h: F.struct(
        h["rank"].alias("rank"),
        h["match_length"].alias("match_length"),
        F.size(F.filter(F.element_at(keywords, h["rank"]),
                        lambda k: F.contains(lowered, k))).alias("keyword_hits"),
        F.exists(F.element_at(codes, h["rank"]),
                 lambda c: F.contains(line, c)).alias("code_hit")))
    scored = F.transform(scored, lambda h: F.struct(
        confidence_round(error_code_boost(
            keyword_boost(regex_confidence(h["match_length"], utf16_length(line)),
                          h["keyword_hits"]),
            h["code_hit"])).alias("confidence"),
        (-h["rank"]).alias("neg_rank"),
        h["match_length"].cast("int").alias("match_length"),
        h["keyword_hits"].alias("keyword_hits"),
        h["code_hit"].alias("code_hit")))
    # A generator of one row keeps later filters from being moved below it, which
    # would run every regex a second time inside the filter.
    return logs.select(*kept, _LOWERED, measured.alias("_measured")).select(
        *kept, F.inline(F.array(F.struct(F.sort_array(scored, asc=False).alias(name)))))


def rank_candidates(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """One row per line and matching rule, ``place`` 1 being the best."""
    ids = constant([r.rule_id for r in rules], "array<string>")
    kept = logs.columns
    exploded = with_candidates(logs, rules, "_candidates").select(
        *kept, F.posexplode("_candidates").alias("_place", "_c"))
    return exploded.select(
        *kept,
        (F.col("_place") + 1).alias("place"),
        F.element_at(ids, -F.col("_c.neg_rank")).alias("rule_id"),
        (-F.col("_c.neg_rank")).alias("rank"),
        F.col("_c.confidence").alias("confidence"),
        F.col("_c.match_length").alias("match_length"),
        F.col("_c.keyword_hits").alias("keyword_hits"),
        F.col("_c.code_hit").alias("code_hit"))


@lru_cache(maxsize=8)
def _keyword_index(rules: tuple[Rule, ...]) -> tuple[str, list[list[dict]], list[list[str]]]:
    """The regex that finds keywords, what each found text stands for (by hash bucket), and the rules of each keyword.

    A text stands for the numbers of the keywords that begin it, itself included.
    """
    index: dict[str, list[str]] = {}
    for r in rules:
        for k in r.keywords:
            index.setdefault(k.lower(), []).append(r.rule_id)
    numbers = {k: n for n, k in enumerate(index, start=1) if k}
    buckets: list[list[dict]] = [[] for _ in range(_BUCKETS)]
    for text in numbers:
        begun = [n for k, n in numbers.items() if text.startswith(k)]
        buckets[zlib.crc32(text.encode()) % _BUCKETS].append({"text": text, "numbers": begun})
    return f"(?=({prefix_tree_regex(set(numbers))}))" if numbers else "(?!)()", buckets, list(index.values())


def keyword_candidates(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """One row per line and rule with a keyword in the line; ``place`` is the order
    in which the keyword index comes upon the rules.

    A line is read once: at each place the prefix tree reports the longest keyword that
    begins there, which stands for the shorter ones that begin it, so overlapping
    keywords are all found.
    """
    find, buckets, rules_of = _keyword_index(tuple(rules))
    bucket = constant(buckets, "array<array<struct<text:string,numbers:array<int>>>>")
    kept = logs.columns
    texts = F.array_distinct(F.regexp_extract_all(F.lower("raw_log"), F.lit(find), F.lit(1)))
    numbers = F.flatten(F.transform(texts, lambda t: F.flatten(F.transform(
        F.filter(F.element_at(bucket, (F.crc32(t.cast("binary")) % _BUCKETS + 1).cast("int")), lambda e: e["text"] == t),
        lambda e: e["numbers"]))))
    found = F.array_distinct(F.flatten(F.transform(F.array_sort(F.array_distinct("_numbers")), lambda n: F.element_at(
        constant(rules_of, "array<array<string>>"), n))))
    ids = constant([r.rule_id for r in rules], "array<string>")
    return (logs.select(*kept, numbers.alias("_numbers"))
            .select(*kept, F.posexplode(found).alias("_place", "rule_id"))
            .select(*kept, (F.col("_place") + 1).alias("place"), "rule_id",
                    F.array_position(ids, F.col("rule_id")).cast("int").alias("rank")))


def rule_regex_predicate(rule: Rule) -> Column:
    """Whether any regex of one rule matches ``raw_log``."""
    hit = F.lit(False)
    for rx in rule.patterns:
        hit = hit | F.col("raw_log").rlike(spark_regex(rx))
    return hit

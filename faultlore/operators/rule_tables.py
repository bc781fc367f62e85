"""Match lines against rules that are a table, however many.

An inverted index leads from pieces of text to the regexes that cannot match without
them.  Lines look up their own pieces, so a line only meets the regexes it may match:
an equi-join, whose plan is the same for sixty rules or a million.  What the join
finds is verified, first by the regex's required literals, then by the regex.

A regex that requires no literal text of two letters is looked up by every line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlore.functions.regexes import in_dialect, required_text, spark_regex
from faultlore.functions.text import utf16_length
from faultlore.operators.matching import (
    confidence_round, error_code_boost, keyword_boost, regex_confidence)

#: Letters of an indexed piece; a shorter literal is a piece itself.
PIECE = 4
REGEXES = "rank int, number int, regex string, literals array<array<string>>"


class RuleIndex(NamedTuple):
    """What matching reads: ``regexes`` (rank, number, regex, literals), ``pieces`` (piece, rank,
    number), ``rules`` (rank, rule_id, keywords, error_codes), and the lengths of pieces."""

    regexes: DataFrame
    pieces: DataFrame
    rules: DataFrame
    lengths: tuple[int, ...]


def rule_regexes(rules: DataFrame) -> DataFrame:
    """One row per regex of ``rules`` (rank, rule_id, patterns): the regex as Spark takes it, and the
    groups of lower-case literals of which any match contains one each.

    Raises ``ValueError`` for a regex that matches empty text or is beyond the dialect.
    """
    def spelt(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for rank, rule_id, patterns in zip(*(batch.column(c).to_pylist() for c in ("rank", "rule_id", "patterns"))):
                for number, rx in enumerate(patterns or ()):
                    if re.compile(rx).search("") is not None or not in_dialect(rx):
                        raise ValueError(f"{rule_id}: regex {rx!r} matches empty text, or has look-around or back-references")
                    for values, value in zip(rows, (rank, number, spark_regex(rx), [list(g) for g in required_text(rx)])):
                        values.append(value)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)],
                                             names=["rank", "number", "regex", "literals"])

    return rules.select("rank", "rule_id", "patterns").mapInArrow(spelt, REGEXES)


def _pieces(text: Column, length: int) -> Column:
    """All runs of ``length`` letters, found in one pass over the text, however long it is."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def rule_index(rules: DataFrame, store: Callable[[DataFrame], DataFrame]) -> RuleIndex:
    """The index of ``rules``, a table like that of ``read_rules``; ``store`` stores a table and reads it back.

    A regex is indexed by its group of literals whose shortest is longest, and each of
    these by the piece that fewest literals have.
    """
    regexes = store(rule_regexes(rules))
    longest = F.element_at(F.array_sort(F.transform("literals", lambda g: F.struct(
        F.array_min(F.transform(g, F.length)).alias("n"), g.alias("of")))), -1)["of"]
    literals = regexes.filter(F.size("literals") > 0).select("rank", "number", F.explode(longest).alias("literal"))
    own = F.when(F.length("literal") < PIECE, F.array("literal")).otherwise(_pieces(F.col("literal"), PIECE))
    pieces = literals.select("rank", "number", "literal", F.explode(F.array_distinct(own)).alias("piece"))
    uses = pieces.select("literal", "piece").distinct().groupBy("piece").agg(F.count("*").alias("uses"))
    rarest = (pieces.join(uses, "piece").groupBy("rank", "number", "literal")
              .agg(F.min_by("piece", F.struct("uses", "piece")).alias("piece")).select("piece", "rank", "number").distinct())
    always = regexes.filter(F.size("literals") == 0).select(F.lit("").alias("piece"), "rank", "number")
    stored = store(rarest.unionByName(always))
    lengths = tuple(sorted(r[0] for r in stored.select(F.length("piece")).distinct().collect()))
    return RuleIndex(regexes, stored, store(rules.select("rank", "rule_id", "keywords", "error_codes")), lengths)


def match_rule_table(logs: DataFrame, index: RuleIndex, line_id: str = "log_id") -> DataFrame:
    """One row per line of ``logs`` (``line_id``, raw_log) and matching rule: ``line_id``, place, rule_id, rank,
    confidence, match_length, keyword_hits and code_hit, place 1 being the best.

    ``line_id`` is unique.  Only ids and pieces meet the index; texts meet the regexes
    that the index names.
    """
    lines = logs.select(F.col(line_id).alias("_line"), "raw_log", F.lower("raw_log").alias("_lowered"))
    own = F.array_distinct(F.concat(*(F.array(F.lit("")) if n == 0 else _pieces(F.col("_lowered"), n) for n in index.lengths or (0,))))
    probes = lines.select("_line", F.explode(own).alias("piece"))
    found = probes.join(index.pieces, "piece").select("_line", "rank", "number").distinct()
    text = F.col("_text")
    present = F.forall("literals", lambda g: F.exists(g, lambda t: F.contains(F.col("_lowered"), t)))
    hits = (found.join(index.regexes, ["rank", "number"]).join(lines, "_line").filter(present)
            .withColumn("_text", F.expr("regexp_extract(raw_log, regex, 0)")).filter(text != "")
            .groupBy("_line", "rank").agg(F.max(utf16_length(text)).alias("match_length")))
    scored = hits.join(index.rules, "rank").join(lines, "_line").select(
        "_line", "rank", "rule_id", "match_length", utf16_length(F.col("raw_log")).alias("_length"),
        F.size(F.filter("keywords", lambda k: F.contains(F.col("_lowered"), F.lower(k)))).alias("keyword_hits"),
        F.exists(F.coalesce("error_codes", F.array().cast("array<string>")), lambda c: F.contains(F.col("raw_log"), c)).alias("code_hit"))
    confidence = confidence_round(error_code_boost(keyword_boost(
        regex_confidence(F.col("match_length"), F.col("_length")), F.col("keyword_hits")), F.col("code_hit")))
    place = F.row_number().over(Window.partitionBy("_line").orderBy(F.desc("confidence"), "rank"))
    return (scored.withColumn("confidence", confidence).withColumn("place", place)
            .select(F.col("_line").alias(line_id), "place", "rule_id", "rank", "confidence",
                    F.col("match_length").cast("int").alias("match_length"), "keyword_hits", "code_hit"))

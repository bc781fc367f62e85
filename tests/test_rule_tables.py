import random
import time

import pytest
from pyspark.sql import functions as F

from faultlore.catalogue import BUILTIN_RULES, Rule, read_rules
from faultlore.operators import matching as mt
from faultlore.operators import rule_tables as rt
from tests.fixtures import LINES


@pytest.fixture
def store(spark, tmp_path):
    def keep(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def lines_of(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "log_id long, raw_log string")


def ranked(df):
    return sorted((r["log_id"], r["place"], r["rule_id"], r["rank"], r["confidence"], r["match_length"], r["keyword_hits"], r["code_hit"])
                  for r in df.collect())


def test_as_the_list_of_rules(spark, store):
    odd = ["", "a", "e", "\U0001F600 ECONNREFUSED", "ECONNREFUSED " * 400, "OOM", "x" * 9000]
    logs = lines_of(spark, list(LINES.values()) + odd)
    index = rt.rule_index(read_rules(spark), store)
    got = ranked(rt.match_rule_table(logs, index))
    assert got == ranked(mt.rank_candidates(logs)) and len({g[2] for g in got}) > 10


OWN = (
    Rule("SHORT", "", "network", "LOW", (r"q\d", r"z7+"), ("q",)),  # literals of one letter require nothing
    Rule("TWO", "", "network", "LOW", (r"\bxy\b",), ("xy",), ("xy",)),
    Rule("NONE", "", "network", "LOW", (r"\d{5,}",), ("12",)),
    Rule("EITHER", "", "network", "HIGH", (r"(?:alpha|be) \w+ (?:gamma|delta)",), ("alpha", "ALPHA")),
    Rule("LONG", "", "network", "HIGH", (r"alpha beta gamma", r"gamma.*delta"), ("beta", "gamma")),
)


def test_short_and_missing_literals(spark, store):
    rng = random.Random(1)
    words = ["alpha", "be", "beta", "gamma", "delta", "xy", "xyz", "q7", "z77", "12345", "ALPHA", "Gamma"]
    logs = lines_of(spark, [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(300)])
    index = rt.rule_index(read_rules(spark, OWN), store)
    assert 0 in index.lengths and 2 in index.lengths
    got = ranked(rt.match_rule_table(logs, index))
    assert got == ranked(mt.rank_candidates(logs, OWN)) and {g[2] for g in got} == {r.rule_id for r in OWN}


def test_thousands_of_rules(spark, store):
    """The plan is as small as for few rules and takes no time to build; every line finds its own rule alone."""
    many = spark.range(1, 5001).select(
        F.col("id").cast("int").alias("rank"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("rule_id"),
        F.array(F.concat(F.lit(r"service\-"), F.hex(F.xxhash64("id")), F.lit(r" (?:failed|stopped) with \d+"))).alias("patterns"),
        F.array(F.lit("failed")).alias("keywords"), F.array().cast("array<string>").alias("error_codes"))
    logs = spark.range(3000).select(F.col("id").alias("log_id"), F.concat(
        F.lit("service-"), F.hex(F.xxhash64((F.col("id") % 5000 + 1))), F.lit(" failed with 7")).alias("raw_log"))
    index = rt.rule_index(many, store)
    start = time.perf_counter()
    matched = rt.match_rule_table(logs, index)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - start < 3
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "stopped" not in plan
    few = rt.match_rule_table(logs, rt.rule_index(read_rules(spark), store))._jdf.queryExecution().optimizedPlan().toString()
    assert abs(len(matched._jdf.queryExecution().optimizedPlan().toString()) - len(few)) < 0.2 * len(few)
    rows = matched.collect()
    assert len(rows) == 3000 and all(r["rank"] == r["log_id"] % 5000 + 1 and r["place"] == 1 for r in rows)


def test_rules_beyond_the_dialect(spark, store):
    for rx in (r"a(?=b)", r"x*", r"(a)\1"):
        with pytest.raises(Exception, match="matches empty text, or has look-around"):
            rt.rule_index(read_rules(spark, (Rule("BAD", "", "network", "LOW", (rx,), ("a",)),)), store)


def test_no_rules_and_no_lines(spark, store):
    none = rt.rule_index(read_rules(spark).filter("false"), store)
    assert rt.match_rule_table(lines_of(spark, list(LINES.values())), none).count() == 0
    whole = rt.rule_index(read_rules(spark), store)
    assert rt.match_rule_table(lines_of(spark, []), whole).count() == 0 and len(BUILTIN_RULES) == whole.rules.count()


def test_pieces_of_a_long_line_in_proportion_to_its_length(spark):
    lines = lines_of(spark, ["ab", "é\U0001F600abc", "é" + "abcdefgh" * 10_000])
    pieces = lines.select("log_id", F.array_distinct(rt._pieces(F.col("raw_log"), rt.PIECE)).alias("p"))
    assert {r[0]: r[1][:2] for r in pieces.filter("log_id < 2").collect()} == {0: [], 1: ["é\U0001F600ab", "\U0001F600abc"]}
    start = time.monotonic()
    assert pieces.filter("log_id = 2").select(F.size("p")).first()[0] == 9
    assert time.monotonic() - start < 8

"""Personal data by weak supervision, of built-in functions alone.

1. Candidates.  Base patterns find addresses of mail, IP addresses, cards and phones;
   looser ones find what may be such: mail addresses in disguise, numbers that fail a
   base check, phones without a country code, and names after a title or a known
   first name.
2. Votes.  Labelers by format (regex and checksum), by gazetteer (domains, country
   codes, issuers, first names) and by context (words before) vote for, against or
   not at all.
3. Expectation-maximisation over the table of vote patterns estimates each
   labeler's reliability and each pattern's probability to be personal.
4. A span classifier (naive Bayes on hashed features of the span and the words
   before it) is trained on these probabilities, weighing every candidate of the
   corpus, and decides which candidates become spans beside the base ones.

What comes to the driver is bounded: vote patterns (kinds x 3 ^ labelers at most)
and ``BUCKETS`` feature sums.  Texts never move: candidates are found and judged in
the row of their text.

Edge cases.  Null and empty texts have no span: counts 0, ``spans`` empty.  Repeated
rows and null ids are treated like others.  Long runs of digits or letters cost time
in proportion to their length.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import written
from faultlore.llm.quality import let

BUCKETS = 4096
#: Probability from which a candidate becomes a span; weight of the belief that labelers are right.
LEAST, BELIEF = 0.9, 20.0
#: Characters of context before a span; matches gathered at a time.
CONTEXT, CHUNK = 24, 256

# Possessive quantifiers give the same leftmost matches without deep recursion;
# a match begins at the start of its run of characters or where the last one ended.
_MAIL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra"
# Common first names, top-level domains, country calling codes.
FIRST_NAMES = ("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan "
               "Joseph Jessica Thomas Sarah Charles Karen Hans Peter Klaus Ursula Monika Jean Pierre Marie Claire "
               "Juan Carmen Carlos Lucia Pablo Anna Paul Laura").split()
TOP_LEVELS = "com org net edu gov int de fr es uk it nl eu ch at io info biz".split()
LOOSE = {
    "email": (r"[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++",
              r"\(at\)|\[at\]| at "),
    "phone": (r"(?<![0-9A-Za-z+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-]"),
    "name": (rf"(?<![A-Za-z])(?:(?:{_TITLES})\.? |(?:{'|'.join(FIRST_NAMES)}) )[A-Z][a-z]++(?: [A-Z][a-z]++)?",
             rf"(?<![A-Za-z])(?:(?:{_TITLES})\.?|{'|'.join(FIRST_NAMES)}) [A-Z]"),
}
KINDS = ("email", "ip", "card", "phone", "name")
LABELERS = ("format", "check", "gazetteer", "context", "counter", "shape")
_CONTEXT = (r"(?i)(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|card|visa|credit|address|adresse|name|ip|host|"
            r"telefon|karte|carte|tarjeta|correo|courriel)")
_COUNTER = r"(?i)(?:order|invoice|version|isbn|issue|page|figure|token|sha|build|\bno\.|\bid\b|#|\$|€)"


def found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in order: array of (start, end, value, before); code points, ends exclusive.

    ``before`` is what stands before a match, ``CONTEXT`` characters at most.
    Appending copies an array, so matches are gathered ``CHUNK`` at a time: work
    grows with the number of matches, not with its square.
    """
    fields = "struct<start:int,end:int,value:string,before:string>"
    empty, no_chunk = (F.from_json(F.lit("[]"), ddl) for ddl in (f"array<{fields}>", f"array<array<{fields}>>"))

    def placed(values: Column, gaps: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            value, start = F.get(values, k), state["at"] + F.length(F.get(gaps, k))
            before = F.right(F.concat(state["tail"], F.get(gaps, k)), F.lit(CONTEXT))
            end = start + F.length(value)
            one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"))
            return F.struct(end.alias("at"), F.right(F.concat(before, value), F.lit(CONTEXT)).alias("tail"),
                            F.array_append(state["out"], one).alias("out"))

        def chunk(state: Column, low: Column) -> Column:
            numbers = F.sequence(low, F.least(low + CHUNK, F.size(values)) - 1)
            first = F.struct(state["at"].alias("at"), state["tail"].alias("tail"), empty.alias("out"))
            return let(F.aggregate(numbers, first, step), lambda own: F.struct(
                own["at"].alias("at"), own["tail"].alias("tail"), F.array_append(state["out"], own["out"]).alias("out")))

        lows = F.sequence(F.lit(0), F.size(values) - 1, F.lit(CHUNK))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), no_chunk.alias("out"))
        return F.flatten(F.aggregate(lows, start, chunk)["out"])

    def between(values: Column) -> Column:
        return F.when(F.size(values) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda own: placed(values, own)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def valid(kind: str, value: Column) -> Column:
    """Whether a base match counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    size = F.length(_digits(value))
    if kind == "card":
        return size.between(12, 19) & _luhn(_digits(value))
    return size.between(9, 15)


def _gate(kind: str, text: Column) -> Column:
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")),
            "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
            "card": F.rlike(text, F.lit(r"[0-9](?:[ -]?[0-9]){6}"))}[kind]


def _candidates(text: Column) -> Column:
    """array of (kind number, start, end, value, before, base) in no order."""
    empty = F.from_json(F.lit("[]"), "array<struct<kind:int,start:int,end:int,value:string,before:string,base:boolean>>")

    def told(number: int, base: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                  x["value"].alias("value"), x["before"].alias("before"), base(x["value"]).alias("base"))

    parts = []
    for number, kind in enumerate(KINDS):
        if kind in PATTERNS:
            matches = F.transform(found(text, PATTERNS[kind]), told(number, partial(valid, kind)))
            if kind == "ip":  # a part above 255 makes it none
                matches = F.filter(matches, lambda x: x["base"])
            if kind == "card":  # shorter runs of digits are no candidates
                matches = F.filter(matches, lambda x: F.length(_digits(x["value"])).between(12, 19))
            parts.append(F.when(_gate(kind, text), matches).otherwise(empty))
        if kind in LOOSE:
            pattern, gate = LOOSE[kind]
            matches = F.transform(found(text, pattern), told(number, lambda value: F.lit(False)))
            parts.append(F.when(F.rlike(text, F.lit(gate)), matches).otherwise(empty))
    return F.concat(*parts)


def _votes(x: Column) -> Column:
    """The labelers' votes (1 for, -1 against, 0 none) as an array, in the order of ``LABELERS``."""
    before, digits, kind = x["before"], _digits(x["value"]), x["kind"]
    number = (kind == 2) | (kind == 3)
    check = F.when(kind == 2, F.when(_luhn(digits), 1).otherwise(-1)).when(
        kind == 1, F.when(x["base"], 1).otherwise(-1)).otherwise(0)
    top = F.regexp_extract(F.lower(x["value"]), r"([a-z]+)$", 1)
    gazetteer = (F.when(kind == 0, F.when(top.isin(TOP_LEVELS), 1).otherwise(-1))
                 .when(kind == 2, F.when(F.rlike(digits, F.lit("^(?:4|5[1-5]|2[2-7]|3[47]|6)")), 1).otherwise(-1))
                 .when(kind == 3, F.when(F.rlike(x["value"], F.lit(r"^\+[1-9]")), 1).otherwise(0))
                 .when(kind == 4, F.when(F.rlike(x["value"], F.lit(rf"(?:^| )(?:{'|'.join(FIRST_NAMES)}) ")), 1).otherwise(0))
                 .otherwise(0))
    shape = (F.when(kind == 2, F.when(F.length(digits).isin(15, 16), 1).otherwise(-1))
             .when(kind == 3, F.when(F.length(digits).between(10, 13), 1).otherwise(-1))
             .when(number, 0).otherwise(F.when(F.length(x["value"]).between(6, 64), 1).otherwise(-1)))
    return F.array(F.when(x["base"], 1).when(kind == 4, F.when(F.rlike(x["value"], F.lit(rf"^(?:{_TITLES})\b")), 1).otherwise(0)).otherwise(-1),
                   check, gazetteer, F.when(F.rlike(before, F.lit(_CONTEXT)), 1).otherwise(0),
                   F.when(F.rlike(before, F.lit(_COUNTER)), -1).otherwise(0), shape)


def _features(x: Column) -> Column:
    """Buckets of a span's kind, shape, length and the words before it."""
    before = x["before"]
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["value"], "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    digits = F.length(_digits(x["value"]))
    made = (F.array_join(_votes(x).cast("array<string>"), ","), shape, word, digits.cast("string"), F.rlike(before, F.lit(_CONTEXT)).cast("string"),
            F.rlike(before, F.lit(_COUNTER)).cast("string"), _luhn(_digits(x["value"])).cast("string"))
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), x["kind"], F.coalesce(value, F.lit(""))), F.lit(BUCKETS)).cast("int")
                     for i, value in enumerate(made)))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, tuple[int, ...]], float]:
    """P(personal) of each (kind, votes), by expectation-maximisation over (kind, votes, count).

    A labeler has one distribution of votes on personal and one on other spans, a
    kind has a share of personal spans; ``BELIEF`` counts say that votes are right.
    """
    share = {kind: 0.5 for kind, _, _ in patterns}
    chance = [{True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.1, 0: 0.3, -1: 0.6}} for _ in LABELERS]
    out: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            yes, no = log(share[kind]), log(1 - share[kind])
            for labeler, vote in zip(chance, votes):
                yes, no = yes + log(labeler[True][vote]), no + log(labeler[False][vote])
            out[kind, votes] = 1 / (1 + exp(max(-50.0, min(50.0, no - yes))))
        for kind in share:
            own = [(out[k, v], n) for k, v, n in patterns if k == kind]
            share[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for i, labeler in enumerate(chance):
            for truth in (True, False):
                counts = {v: BELIEF * (0.6 if v == (1 if truth else -1) else 0.3 if v == 0 else 0.1) for v in (1, 0, -1)}
                for kind, votes, n in patterns:
                    counts[votes[i]] += n * (out[kind, votes] if truth else 1 - out[kind, votes])
                labeler[truth] = {v: c / sum(counts.values()) for v, c in counts.items()}
    return out


def classifier(candidates: DataFrame) -> tuple[float, list[float]]:
    """Prior log odds and the buckets' log odds, from all candidates (kind, votes, features)."""
    grouped = candidates.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes")
    patterns = [(r["kind"], tuple(r["votes"]), r["n"]) for r in grouped.collect()]
    if not patterns:
        return -50.0, [0.0] * BUCKETS
    belief = reliabilities(patterns)
    rows = json.dumps([{"kind": k, "votes": v, "p": round(p * 1_000_000)} for (k, v), p in belief.items()])
    table = candidates.sparkSession.range(1).select(F.inline(F.from_json(
        F.lit(rows), "array<struct<kind:int,votes:array<int>,p:bigint>>")))
    sums = (candidates.join(F.broadcast(table), ["kind", "votes"]).select(F.explode("features").alias("bucket"), "p")
            .groupBy("bucket").agg(F.sum("p").alias("yes"), F.count("*").alias("n")).collect())
    yes = sum(n * round(belief[k, v] * 1_000_000) for k, v, n in patterns) / 1_000_000
    no = sum(n for _, _, n in patterns) - yes
    weights = [0.0] * BUCKETS
    for r in sums:
        own = r["yes"] / 1_000_000
        weights[r["bucket"]] = log((own + 0.5) / (yes + 1)) - log((r["n"] - own + 0.5) / (no + 1))
    return log((yes + 1) / (no + 1)), weights


def _of_kind(kind: int, x: Column) -> Column:
    return x["kind"] == kind


def _said(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a generator fences the search, so later columns do not repeat it
    held = own.select("doc_id", "text", F.explode(F.array(_candidates(F.col("text")))).alias("found"))
    judged = F.transform("found", lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"),
        _votes(x).alias("votes"), _features(x).alias("features")))
    rows = written(held.select("doc_id", judged.alias("found")), "candidates")
    prior, weights = classifier(rows.select(F.explode("found").alias("x")).select("x.kind", "x.votes", "x.features"))
    weight = F.from_json(F.lit(json.dumps(weights)), "array<double>")

    def likely(x: Column) -> Column:
        odds = F.aggregate(x["features"], F.lit(prior), lambda total, b: total + F.get(weight, b))
        return odds >= log(LEAST / (1 - LEAST))

    def told(base: Column) -> Column:
        more = F.filter("found", lambda x: ~x["base"] & likely(x) & ~F.exists(
            base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        counts = (F.size(F.filter(base, partial(_of_kind, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4))
        return F.struct(*counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.concat(base, more)).alias("spans"))

    return rows.select("doc_id", let(F.filter("found", lambda x: x["base"]), told).alias("out")).select("doc_id", "out.*")

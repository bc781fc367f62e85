"""Small text helpers as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters the rule dialect counts as white space.
WHITESPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Classes that decide on printable ASCII first; the many ranges of white space cost most of a regex's time otherwise.
SPACE = f"[[^!-~]&&[{WHITESPACE}]]"
NOT_SPACE = f"[!-~[^{WHITESPACE}]]"
_BLANKS = "".join(chr(c) for c in range(0x10000) if re.match(f"[{WHITESPACE}]", chr(c)))


def constant(value, ddl: str) -> Column:
    """A nested constant; the optimiser folds it to a literal."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def trimmed(text: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(text, F.lit(_BLANKS))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is in the text, far cheaper to find out than by a regex."""
    found = [F.contains(text, F.lit(word)) for word in words]
    return reduce(Column.__or__, found)


def apart(value: Column) -> Column:
    """The same value through a higher-order function.

    Spark compiles a projection that holds one by itself, in methods that the JVM compiles
    too.  Projections fused into one method of more than 8,000 bytes stay interpreted.
    """
    return F.element_at(F.transform(F.array(value), lambda v: v), 1)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which rule confidence is defined."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)


def first_match(text: Column, regex: str, group: int = 0, tried: Column | None = None) -> Column:
    """Group of the leftmost match, NULL when there is none; the regex is tried where ``tried`` holds."""
    found = F.regexp_extract(text, regex, group)
    return F.nullif(found if tried is None else F.when(tried, found), F.lit(""))


def replace_first(text: Column, token: Column, by: str) -> Column:
    """Replace the first literal occurrence of ``token``; unchanged if NULL."""
    at = F.instr(text, token)
    return F.when(token.isNull(), text).otherwise(F.concat(
        F.substring(text, F.lit(1), at - 1),
        F.lit(by),
        F.substring(text, at + F.length(token), F.length(text))))


def half_up(value: Column) -> Column:
    """Round half up to a whole number."""
    return F.floor(value + F.lit(0.5))


def utc_day(df: DataFrame, name: str) -> Column:
    """The day of a time stamp column in UTC; one without a time zone is in UTC already."""
    at = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp":
        return F.to_date(at)
    micros, day = F.unix_micros(at), F.lit(86_400_000_000)
    return F.date_from_unix_date(((micros - F.pmod(micros, day)) / day).cast("int"))

"""Metadata fields of a log line as column expressions.

Fields are read from ``scan``: the trimmed line whose time stamp has been
replaced by a blank.  Every field is text; a missing field is NULL.  Word
boundaries are spelt as look-arounds on ``\\w`` because Java's ``\\b`` also
stops at accented letters.  A regex begins with the letters that can begin its
match, which are cheaper to test than a look-behind, and is tried where a
text that any match contains is in the line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlore.functions.text import NOT_SPACE, SPACE, WHITESPACE, contains_any, first_match, replace_first, trimmed

# Fixed values from here on.

START = r"(?<!\w)"
END = r"(?!\w)"
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# Tried in this order; the first form that occurs anywhere wins.
TIMESTAMP_FORMS = (
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    rf"[A-Z][a-z]{{2}}{SPACE}+\d{{1,2}}{SPACE}+\d{{2}}:\d{{2}}:\d{{2}}",
    rf"\d{{2}}/[A-Z][a-z]{{2}}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}{SPACE}+[+-]\d{{4}}",
    rf"\d{{4}}-\d{{2}}-\d{{2}}{SPACE}+\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?",
    rf"1(?<!\w1)\d{{9}}(?:\d{{3}})?{END}",
)
# Texts that every match of a form contains.
TIMESTAMP_TEXTS = (("T", "-", ":"), (":",), ("/", ":"), ("-", ":"), ("1",))

LEVEL_WORDS = (
    "EMERG", "EMERGENCY", "ALERT", "CRIT", "CRITICAL", "ERR", "ERROR", "WARN",
    "WARNING", "NOTICE", "INFO", "DEBUG", "TRACE", "FATAL", "VERBOSE",
)

# All begin with E, which is looked for before anything else.
POSIX_CODES = (
    "ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "EPIPE", "EADDRINUSE", "EADDRNOTAVAIL",
    "EAI_AGAIN", "ENOTFOUND", "ENOENT", "ENOSPC", "EACCES", "EPERM", "EHOSTUNREACH",
    "ENETUNREACH", "ECONNABORTED",
)

# Tried in this order; only the first match of each counts.
ERROR_CODE_FORMS = (
    rf"(E(?<!\wE)[A-Z0-9_]{{3,}}){END}",
    rf"(?i)e(?<!\we)rr(?:or)?[{WHITESPACE}_-]*(?:code)?[=:{WHITESPACE}]+([A-Z0-9_]+)",
    rf"(\d(?<!\w\d)\d{{2}}){SPACE}+[A-Z][a-z]",
    rf"(?i)c(?<!\wc)ode[=:{WHITESPACE}]+['\"]?([A-Z0-9_]+)",
)

ERROR_CODE_TEXTS = ("E", "err", "", "code")  # in every match, in lower case but for the first

HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "CONNECT", "TRACE")

HTTP_REASONS = (
    "OK", "Created", "Accepted", rf"Bad{SPACE}+Request", "Unauthorized", "Forbidden",
    rf"Not{SPACE}+Found", rf"Internal{SPACE}+Server", rf"Service{SPACE}+Unavailable",
    rf"Gateway{SPACE}+Time",
)

URL = rf"https?://[^{WHITESPACE}\"']+|/[a-zA-Z0-9._~:/?#\[\]@!$&'()*+,;=-]+"
FILE_PATH = (rf"/[a-zA-Z0-9._-]+/[a-zA-Z0-9._-][a-zA-Z0-9._/-]*"
             rf"|[A-Z]:\\[^{WHITESPACE}\\]{NOT_SPACE}*")


def extract_timestamp(line: Column) -> Column:
    return F.coalesce(*[
        F.when(reduce(Column.__and__, [F.contains(line, F.lit(t)) for t in texts]), first_match(line, form))
        for form, texts in zip(TIMESTAMP_FORMS, TIMESTAMP_TEXTS, strict=True)])


def strip_timestamp(line: Column, timestamp: Column) -> Column:
    return replace_first(line, timestamp, " ")


def extract_log_level(scan: Column) -> Column:
    firsts = "".join(sorted({word[0] for word in LEVEL_WORDS}))
    return F.upper(first_match(scan, f"(?i)(?=[{firsts}]){START}(?:{'|'.join(LEVEL_WORDS)}){END}"))


def extract_pid(scan: Column) -> Column:
    return first_match(
        scan, rf"(?i)(?=[p\[])(?:{START}pid[=:{WHITESPACE}]+(?=\d+{END})|\[(?=\d+\]))(\d+)", 1,
        F.contains(scan, F.lit("[")) | F.contains(F.lower(scan), F.lit("pid")))


def extract_ip(scan: Column) -> Column:
    return first_match(scan, rf"\d(?<!\w\d)\d{{0,2}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{END}")


def extract_port(scan: Column, ip: Column) -> Column:
    """The port after the address, else one named so, else the last ``:dd`` of the
    first run of colon-separated numbers."""
    after_ip = F.concat(F.lit(START), F.replace(ip, F.lit("."), F.lit(r"\.")),
                        F.lit(rf":(\d{{2,5}}){END}"))
    return F.coalesce(
        F.when(F.contains(scan, F.concat(ip, F.lit(":"))),
               F.nullif(F.call_function("regexp_extract", scan, after_ip, F.lit(1)), F.lit(""))),
        F.when(F.contains(F.lower(scan), F.lit("port")),
               first_match(scan, rf"(?i)p(?<!\wp)ort[=:{WHITESPACE}]+(\d{{2,5}}){END}", 1)),
        F.when(F.contains(scan, F.lit(":")), first_match(scan, rf":(\d{{2,5}}){END}(?!:\d{{2}})", 1)))


def extract_error_code(scan: Column) -> Column:
    # A level word in the place of a code is not a code.
    lowered = F.lower(scan)
    codes = [(F.contains(scan if text == "E" else lowered, F.lit(text)), F.upper(F.regexp_extract(scan, form, 1)))
             for form, text in zip(ERROR_CODE_FORMS, ERROR_CODE_TEXTS, strict=True)]
    posix = rf"E(?<!\wE)(?:{'|'.join(code[1:] for code in POSIX_CODES)}){END}"
    return F.coalesce(first_match(scan, posix),
                      *(F.when(tried & ~code.isin("", *LEVEL_WORDS), code) for tried, code in codes))


def extract_http_status(scan: Column) -> Column:
    code = rf"(?=\d{{3}}{END})"
    words = ["http", "status", *(reason.split(SPACE)[0].lower() for reason in HTTP_REASONS)]
    return first_match(scan, (
        rf"(?i)(?=[hs\d]){START}(?:HTTP[/{WHITESPACE}]+\d\.\d['\"]*{SPACE}+{code}"
        rf"|status[=:{WHITESPACE}]+{code}"
        rf"|(?=\d{{3}}{SPACE}+(?:{'|'.join(HTTP_REASONS)})))(\d{{3}})"), 1, contains_any(F.lower(scan), words))


def extract_http_method(scan: Column) -> Column:
    return first_match(scan, f"{START}(?:{'|'.join(HTTP_METHODS)}){END}", 0, contains_any(scan, HTTP_METHODS))


def extract_url(scan: Column) -> Column:
    return first_match(scan, URL)


def extract_username(scan: Column) -> Column:
    return first_match(
        scan, rf"(?i)u(?<!\wu)ser(?:name)?[=:{WHITESPACE}]+['\"]?([a-zA-Z0-9._@-]+)['\"]?{BOUNDARY}", 1,
        F.contains(F.lower(scan), F.lit("user")))


def extract_file_path(scan: Column) -> Column:
    """A path ends before an empty segment.  That is cut off afterwards, as a regex
    that repeats whole segments would recurse once per segment."""
    path = F.regexp_extract(scan, FILE_PATH, 0)
    path = F.regexp_replace(path, "^(/[^/].*?)/(?:/.*)?$", "$1")
    path = F.regexp_replace(path, r"^([A-Z]:\\.*?)\\(?:\\.*)?$", "$1")
    return F.when(F.contains(scan, F.lit("/")) | F.contains(scan, F.lit(":\\")), F.nullif(path, F.lit("")))


def extract_source(scan: Column) -> Column:
    return F.coalesce(
        first_match(scan, (
            rf"^{NOT_SPACE}+{SPACE}+\d+{SPACE}+\d+:\d+:\d+{SPACE}+({NOT_SPACE}+)"
            rf"{SPACE}+{NOT_SPACE}+?(?:\[\d+\])?:"), 1),
        F.when(F.contains(scan, F.lit(".service")),
               first_match(scan, rf"(?<!{NOT_SPACE}){NOT_SPACE}+\.service")),
        F.when(F.contains(scan, F.lit("|")), first_match(scan, rf"^({NOT_SPACE}+){SPACE}+\|", 1)),
        F.when(F.contains(scan, F.lit("[")) | F.contains(scan, F.lit("(")), first_match(
            scan, r"[\[(](?:(?<=\[)(?=[a-zA-Z0-9._-]+\])|(?<=\()(?=[a-zA-Z0-9._-]+\)))([a-zA-Z0-9._-]+)", 1)))


def message_body(line: Column, timestamp: Column) -> Column:
    rest = replace_first(line, timestamp, "")
    return trimmed(F.regexp_replace(rest, f"^{SPACE}*[-:]{SPACE}*", ""))


def override_source(extracted: Column, given: Column) -> Column:
    """A caller's non-empty source replaces the extracted one."""
    return F.coalesce(F.nullif(given, F.lit("")), extracted)

"""Token patterns: from the reference dialect to Java's, checked at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The default token pattern, and one word character by Unicode class.
DEFAULT_PATTERN = r"(?u)\b\w\w+\b"
WORD_CLASS = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}"


# What may follow "(?" in the dialect, besides flags; Java's own constructs are not in it.
GROUPS = (":", "P<", "<")
FLAGS = re.compile(r"\(\?[imsxuU]*(?:-[imsxuU]+)?[:)]")


def _elements(pattern: str):
    """(text, inside a class) of the pattern's elements: escapes and single characters."""
    depth = at = 0
    while at < len(pattern):
        size = 2 if pattern[at] == "\\" else 1
        text = pattern[at : at + size]
        yield at, text, depth > 0
        if text == "[":
            depth += 1
            for first in ("^", "]"):  # a class that begins with a bracket holds it
                if pattern[at + 1 : at + 2] == first:
                    at += 1
                    yield at, first, True
        elif text == "]" and depth:
            depth -= 1
        at += size


def to_java(pattern: str) -> str:
    """Java pattern with Unicode classes.  Look-around, atomic groups, possessive repetition and
    back-references are not in the dialect and raise ValueError, as does a pattern that does
    not compile.  Groups may be named with ``(?P<name>`` or ``(?<name>``."""
    if pattern == DEFAULT_PATTERN:  # a maximal run of two or more word characters
        return f"[{WORD_CLASS}]{{2,}}"
    invalid = ValueError(f"invalid token_pattern: {pattern!r}")
    out, before, names, skip = [], "", 0, 0
    for at, text, inside in _elements(pattern):
        if skip:
            skip -= 1
            continue
        new = text
        if not inside:
            if re.fullmatch(r"\\[1-9kGRXNQE]", text):  # references and what only Java has
                raise invalid
            if text == "+" and before in ("+", "*", "?", "}"):
                raise invalid
            if text == "(" and pattern[at + 1 : at + 2] == "?":
                kind = pattern[at + 2 :]
                if kind.startswith(("<=", "<!")) or not (kind.startswith(GROUPS) or FLAGS.match(pattern, at)):
                    raise invalid
                if kind.startswith(("P<", "<")):  # Java's names are letters and digits only; names are not used
                    name = re.match(r"P?<([A-Za-z_][A-Za-z0-9_]*)>", kind)
                    if name is None:
                        raise invalid
                    names += 1
                    new, skip = f"(?<g{names}>", 1 + name.end()
        out.append(new)
        before = "" if inside else text
        if len(out) > 1 and not inside and text == "?" and out[-2] in ("+", "*", "?", "}"):
            before = "lazy"
    body = _with_unicode("".join(out))
    return body if body.startswith("(?U)") else f"(?U){body}"


def _with_unicode(body: str) -> str:
    return "(?U)" + body[4:] if body.startswith("(?u)") else body


def validate(spark: SparkSession, pattern: str) -> str:
    """``to_java``, compiled once on the driver so that an invalid pattern raises now."""
    java = to_java(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as error:
        raise ValueError(f"invalid token_pattern: {pattern!r}") from error
    return java


def find_all(text: Column, java: str) -> Column:
    """Leftmost non-overlapping matches; groups in the pattern are ignored."""
    return F.regexp_extract_all(text, F.lit(java), F.lit(0))

"""Nested list literals as models write them, turned into JSON inside the JVM.

Lists and tuples, single and double quotes, escapes, numbers in any notation, None, True and False, commas before a
closing bracket. An apostrophe inside a single-quoted text does not end it unless a comma or a bracket follows.
Numbers become texts as written, without underscores. Anything else, a bare word say, becomes the text
``BAD``, so that only the element it stands in is spoiled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAD = "\u0000?"

_ENDS = r"(?=\s*(?:[,\])}:]|$))"
_SINGLE = r"'(?:\\[\s\S]|[^'\\]|'(?!\s*(?:[,\])}:]|$)))*'"
_DOUBLE = r'"(?:\\[\s\S]|[^"\\])*"'
_NUMBER = r"[+-]?(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)" + _ENDS
_NAME = r"(?:None|True|False|null|true|false)" + _ENDS
_CLOSE = r",?\s*[\])]"
# What is none of these, up to the next comma or bracket.
_OTHER = r"[^\s,\[\]()][^,\[\]()]*"
TOKEN = "|".join([_SINGLE, _DOUBLE, _NUMBER, _NAME, r"[\[(]", _CLOSE, ",", _OTHER])

_ESCAPE = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|[\s\S])|[^\\]+|\\"
# One-letter escapes that JSON has as well, and what the others stand for.
_PLAIN = {"\\'": "'", '\\"': '\\"', "\\\\": "\\\\", "\\n": "\\n", "\\r": "\\r", "\\t": "\\t", "\\b": "\\b", "\\f": "\\f", "\\a": "\\u0007", "\\v": "\\u000b", "\\\n": ""}


def _hex4(number: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(number)), 4, "0"))


def _code_point(number: Column) -> Column:
    """A code point as JSON escapes, two for one beyond the first plane."""
    rest = number - 0x10000
    pair = F.concat(_hex4(F.shiftright(rest, 10) + 0xD800), _hex4(rest.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    return F.when(number > 0x10FFFF, F.lit("\\u0000?")).when(number >= 0x10000, pair).otherwise(_hex4(number))


def _unescaped(part: Column) -> Column:
    """A stretch of a quoted text, or one of its escapes, as JSON."""
    tail = F.substring(part, 3, 10)
    chosen = F.when(~part.startswith("\\"), F.replace(part, F.lit('"'), F.lit('\\"')))
    for escape, made in _PLAIN.items():
        chosen = chosen.when(part == escape, F.lit(made))
    octal = F.conv(F.substring(part, 2, 3), 8, 10).cast("int")
    chosen = chosen.when(part.rlike(r"^\\[xuU][0-9a-fA-F]+$"), _code_point(F.conv(tail, 16, 10).cast("int")))
    chosen = chosen.when(part.rlike(r"^\\[0-7]+$"), _code_point(octal))
    # An unknown escape is a backslash and what follows it.
    return chosen.otherwise(F.concat(F.lit("\\\\"), F.replace(F.substring(part, 2, 10), F.lit('"'), F.lit('\\"'))))


def _text(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    parts = F.regexp_extract_all(inner, F.lit(_ESCAPE), F.lit(0))
    return F.concat(F.lit('"'), F.array_join(F.transform(parts, _unescaped), ""), F.lit('"'))


def _quoted(token: Column) -> Column:
    return (F.startswith(token, F.lit("'")) & token.rlike(f"^{_SINGLE}$")) | (F.startswith(token, F.lit('"')) & token.rlike(f"^{_DOUBLE}$"))


def _as_json(token: Column) -> Column:
    closing = F.endswith(token, F.lit("]")) | F.endswith(token, F.lit(")"))
    return (
        F.when(token == ",", ",")
        .when(_quoted(token), _text(token))
        .when(token.isin("[", "("), "[")
        .when(closing & token.rlike(r"^,?\s*[\])]$"), "]")
        .when(token.isin("None", "null"), "null")
        .when(token.isin("True", "true"), "true")
        .when(token.isin("False", "false"), "false")
        .when(token.rlike(f"^{_NUMBER}$"), F.concat(F.lit('"'), F.replace(token, F.lit("_"), F.lit("")), F.lit('"')))
        .otherwise(F.lit('"\\u0000?"'))
    )


def literal_to_json(text: Column) -> Column:
    """The literal as one JSON text, with numbers as texts."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, _as_json), "")


def is_bad(json: Column) -> Column:
    """Whether a JSON text, or a text read from one, holds something that is no literal."""
    return F.contains(json, F.lit(BAD)) | F.contains(json, F.lit("\\u0000?"))

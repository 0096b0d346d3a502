"""Rules for raw observation text, as Spark SQL expressions.

Every function takes SQL expressions (usually a column name) and returns one, so a
rule set reaches Spark as a few parsed expressions rather than thousands of calls.
"""

from __future__ import annotations

from collections.abc import Iterable

from tallymark.contracts import (
    NUMERIC_PATTERN,
    VALUE_TYPE,
    VARIABLE_DEFINITIONS,
    YEAR_PATTERN,
)

UNIT_SEPARATOR = "\u001f"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_list(texts: Iterable[str]) -> str:
    return ", ".join(map(quoted, texts))


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(f"({condition})" for condition in conditions) + ")"


def is_blank(value: str) -> str:
    """Null, empty, or only spaces (other white space counts as text)."""
    return f"({value} IS NULL OR trim({value}) = '')"


def is_numeric_text(value: str) -> str:
    """Plain or correctly grouped digits with an optional sign and fraction."""
    return f"({value} RLIKE r'{NUMERIC_PATTERN}')"


def numeric_value(value: str) -> str:
    """The number behind grouped text, or null when it does not fit the value type."""
    return f"try_cast(replace({value}, ',', '') AS {VALUE_TYPE})"


def value_status(value: str) -> str:
    """Classify a raw value; the first matching branch wins."""
    return f"""CASE
        WHEN {is_blank(value)} THEN 'UNAVAILABLE'
        WHEN {value} = 'C' THEN 'CONFIDENTIAL'
        WHEN {value} = 'S' THEN 'SUPPRESSED'
        WHEN {is_numeric_text(value)} AND {numeric_value(value)} IS NOT NULL THEN 'PUBLISHED'
        ELSE 'INVALID' END"""


def is_year_text(value: str) -> str:
    return f"({value} RLIKE r'{YEAR_PATTERN}')"


def year_value(value: str) -> str:
    """Four-digit text as an integer, null for anything else (never an ANSI error)."""
    return f"CASE WHEN {is_year_text(value)} THEN try_cast({value} AS INT) END"


def is_complete_definition(code: str, name: str, category: str, units: str) -> str:
    """Whether four non-null fields together are an approved definition: one hash probe.

    No field of a definition holds the separator, so equal joined text means equal fields.
    """
    joined = quoted_list(UNIT_SEPARATOR.join(d) for d in VARIABLE_DEFINITIONS)
    return f"(concat_ws('{UNIT_SEPARATOR}', {code}, {name}, {category}, {units}) IN ({joined}))"


def is_known_definition(code: str, name: str, category: str, units: str) -> str:
    """The same with three-valued logic: unknown if null fields could complete one."""
    fields = (code, name, category, units)
    listed = ", ".join(f"array({quoted_list(d)})" for d in VARIABLE_DEFINITIONS)
    same = " AND ".join(f"known[{i}] = {field}" for i, field in enumerate(fields))
    return f"""CASE WHEN {any_of(f"{field} IS NULL" for field in fields)}
        THEN exists(array({listed}), known -> {same})
        ELSE {is_complete_definition(*fields)} END"""


def texts_where(conditions: Iterable[tuple[str, str]]) -> str:
    """The texts whose condition holds, in order, joined by the unit separator.

    Split the result with :func:`split_texts`. Compared with an array function over
    ``CASE`` items this stays in generated code throughout.
    """
    items = ", ".join(f"CASE WHEN {condition} THEN {quoted(text)} END"
                      for condition, text in conditions)
    return f"concat_ws('{UNIT_SEPARATOR}', {items})"


def split_texts(joined: str, content: str | None = None) -> str:
    """``joined`` (or ``content`` when ``joined`` is not empty) as an array of texts."""
    return f"""CASE WHEN {joined} = '' THEN CAST(array() AS array<string>)
        ELSE split({content or joined}, '{UNIT_SEPARATOR}') END"""


# A JSON array of strings and nothing else.
_JSON_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_JSON_STRING_ARRAY = (
    rf"^\s*+\[\s*+(?:{_JSON_STRING}\s*+(?:,\s*+{_JSON_STRING}\s*+)*+)?+\]\s*+\z"
)


def is_string_array(value: str) -> str:
    """True for null or well-formed text; false marks a value to reject.

    ``from_json`` alone turns numbers into strings and keeps null items, so the
    text form is checked first.
    """
    return f"({value} IS NULL OR {value} RLIKE r'{_JSON_STRING_ARRAY}')"


def string_array(value: str) -> str:
    """JSON text of a string array as ``array<string>``.

    Null text gives an empty array. Anything but an array whose items are all JSON
    strings gives null; see :func:`is_string_array`.
    """
    return f"""CASE
        WHEN {value} IS NULL THEN CAST(array() AS array<string>)
        WHEN {is_string_array(value)} THEN from_json({value}, 'array<string>') END"""

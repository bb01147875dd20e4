"""Text rules that all engines here share: white space is space, \\t to \\r; offsets are code points."""

from __future__ import annotations

import json
import unicodedata

#: Inside of a character class, for Java, Python and RE2.
WS = r"\x20\t\n\x0B\f\r"
BLANKS = " \t\n\x0b\x0c\r\0"


def strip(text: str) -> str:
    return text.strip(BLANKS)


def fold(text: str) -> str:
    """Lower case, code point by code point: no context, so no final sigma; the length can change."""
    return text.lower() if text.isascii() else "".join(map(str.lower, text))


_TO_SPACE = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


def collapsed(text: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return strip(" ".join(x for x in text.translate(_TO_SPACE).split(" ") if x))


def for_match(text: str) -> str:
    """The form that fuzzy matching compares."""
    return collapsed(fold(unicodedata.normalize("NFC", text)))


def stringified(value) -> str:
    """A scalar as text; objects and arrays as JSON."""
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return to_json(value)
    return str(value)


def to_json(value) -> str:
    return json.dumps(string_keys(value), ensure_ascii=False)


def string_keys(value):
    """Keys of nested objects as text."""
    if isinstance(value, dict):
        return {stringified(k): string_keys(v) for k, v in value.items()}
    return [string_keys(v) for v in value] if isinstance(value, list) else value

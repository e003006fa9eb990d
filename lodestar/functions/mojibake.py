"""Text that was decoded by the wrong table, once or more, made whole again."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The tables that UTF-8 is wrongly read by. Bytes that the first has no character for stay control characters, as the second reads them.
TABLES = ("cp1252", "latin-1")
#: Times that a text may have been through it.
TURNS = 4


def _read(byte: int) -> str:
    try:
        return bytes([byte]).decode(TABLES[0])
    except UnicodeDecodeError:
        return bytes([byte]).decode(TABLES[1])


#: Characters by the byte they stand for in either table.
_BYTE = {chr(b): b for b in range(128, 256)} | {_read(b): b for b in range(128, 256)}


def _class(low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in _BYTE.items() if low <= b <= high) + "]"


_TAIL = _class(0x80, 0xBF)
#: Characters that, as bytes, are one of UTF-8 of more than one byte.
_SUSPECT = re.compile(f"(?:{_class(0xC2, 0xDF)}{_TAIL}|{_class(0xE0, 0xEF)}{_TAIL}{{2}}|{_class(0xF0, 0xF4)}{_TAIL}{{3}})+")


def _whole(run: re.Match) -> str:
    try:
        return bytes(_BYTE[c] for c in run[0]).decode("utf-8")
    except UnicodeDecodeError:
        return run[0]


def badness(text: str) -> int:
    """Code points of a text that look as if read by the wrong table, and control characters that no text has."""
    return sum(len(m[0]) for m in _SUSPECT.finditer(text)) + sum("\x80" <= c <= "\x9f" for c in text)


def mended(text: str) -> str:
    """The text with such runs read as UTF-8, again while that makes it less bad; others don't change."""
    if text.isascii():
        return text
    bad = badness(text)
    for _ in range(TURNS):
        if not bad:
            break
        better = _SUSPECT.sub(_whole, text)
        now = badness(better)
        if now >= bad:
            break
        text, bad = better, now
    return text


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(mended, na_action="ignore")


def repaired(text: Column) -> Column:
    """text made whole; null stays null. UTF-8 that was read as Windows-1252 or Latin-1, up to TURNS times over, comes back."""
    return _repaired(text)

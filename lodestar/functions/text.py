"""Text clean-up as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default sentence marks.
SENTENCE_MARKS = ("!", ".", "?", "։", "؟", "۔", "܀", "܁", "܂", "‼", "‽", "⁇", "⁈", "⁉", "⸮", "﹖", "﹗", "！", "．", "？", "｡", "。", "\n")
#: Character entities by name that unescape() knows; numbers it knows all.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def mark_class(marks: tuple[str, ...]) -> str:
    """The inside of a character class of single marks, escaped and in their order."""
    return "".join("\\" + m if m in "\\^]-[&~" else "\\n" if m == "\n" else m for m in marks)


def sentence_pattern(marks: tuple[str, ...] = SENTENCE_MARKS) -> str:
    """Blanks, then a run without marks that ends in no blank, then the marks after it."""
    p = mark_class(marks)
    return rf"\s*[^{p}]*[^{p}\s][{p}]*"


def unescape(text: Column) -> Column:
    """HTML entities, by name or by number, resolved twice, as text that was escaped twice needs it."""
    for _ in range(2):
        text = _numbers(text)
        for entity, char in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
    return text


#: An entity by number: decimal, or hexadecimal after an x.
_NUMBER = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"


def _numbers(text: Column) -> Column:
    """Entities by number as their characters; numbers that name no character stay as they are."""
    digits = lambda e: F.regexp_extract(e, "([0-9A-Fa-f]+);", 1)
    value = lambda e: F.when(F.lower(e).startswith("&#x"), F.conv(digits(e), 16, 10)).otherwise(digits(e)).cast("int")
    sound = lambda v: v.between(1, 0x10FFFF) & ~v.between(0xD800, 0xDFFF)
    char = lambda e: F.when(sound(value(e)), F.decode(F.unhex(F.lpad(F.hex(value(e)), 8, "0")), "UTF-32")).otherwise(e)
    hits, gaps = F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), F.split(text, _NUMBER, -1)
    joined = F.array_join(F.zip_with(gaps, F.transform(hits, char), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    return F.when(text.contains("&#") & text.rlike(_NUMBER), joined).otherwise(text)


#: Matches whose ends are summed up at once.
FOLD = 256


def match_ends(hits: Column, gaps: Column) -> Column:
    """Where matches end, in code points, from the matches of a pattern and what stands between them.

    Running sums within FOLD matches, then over those sums: adding to one array match by match would copy it each time.
    """
    size = F.transform(F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda hit, gap: F.char_length(hit) + F.char_length(gap)), lambda n: n)
    none = F.array().cast("array<int>")
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out"))
    running = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(hits) - 1) / FOLD)).cast("int")), lambda b: F.slice(size, b * FOLD + 1, F.lit(FOLD)))
    sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda s, n: s + n))
    begins = F.concat(F.array(F.lit(0)), running(sums, F.lit(0)))
    return F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), running))


def clean(text: Column, lower: bool = True) -> Column:
    """Entities resolved, blanks collapsed, ends trimmed, and in lower case."""
    text = F.trim(F.regexp_replace(unescape(text), r"\s+", " "))
    return F.lower(text) if lower else text


def label_prompt(labels: Column, template: str = "{}") -> Column:
    """Labels joined by ', ' inside a template with one {}."""
    head, _, tail = template.partition("{}")
    return F.concat(F.lit(head), F.concat_ws(", ", labels), F.lit(tail))

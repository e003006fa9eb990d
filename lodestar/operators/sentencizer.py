"""Sentences of texts, as one row each, in column functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import SENTENCE_MARKS, match_ends, sentence_pattern


def sentencize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 1, max_len: int = 512, marks: tuple[str, ...] | None = None, uniform_weight: bool = True, positions: bool = True) -> DataFrame:
    """(id, offset, sentence, weight, start, end) of each sentence longer than min_len code points.

    A sentence is a run without marks and the marks after it; offsets count all of them, so short ones leave gaps;
    start and end are the untrimmed match's; the text is trimmed, newlines become blanks, and what is over max_len is
    cut off. A text without any such run is one sentence. Null and empty texts give none. Without positions start and
    end are left out, and the pattern runs over a text once.
    """
    pattern = sentence_pattern(tuple(marks) if marks else SENTENCE_MARKS)
    text = F.col(text_col)
    # the matches are worked out here, and only referred to from there on
    rows = docs.where(F.char_length(text) > 0).select(F.col(id_col), F.char_length(text).alias("_n"), text.alias("_text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_hits"))
    whole = F.size("_hits") == 0
    raw = F.when(whole, F.array("_text")).otherwise(F.col("_hits"))
    if positions:
        ends = F.when(whole, F.array("_n")).otherwise(match_ends(F.col("_hits"), F.split("_text", pattern, -1)))
        rows = rows.select(id_col, "_n", F.posexplode(F.arrays_zip(raw.alias("raw"), ends.alias("end"))).alias("offset", "_s"))
    else:
        rows = rows.select(id_col, "_n", F.posexplode(F.transform(raw, lambda x: F.struct(x.alias("raw")))).alias("offset", "_s"))
    trimmed = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace("_s.raw", r"\n+", " "), r"^\s+", ""), r"\s+$", ""), 1, max_len)
    rows = rows.withColumn("sentence", trimmed).where(F.char_length("sentence") > min_len)
    weight = F.lit(1.0) if uniform_weight else F.char_length("sentence") / F.col("_n")
    spot = ((F.col("_s.end") - F.char_length("_s.raw")).alias("start"), F.col("_s.end").alias("end")) if positions else ()
    return rows.select(id_col, "offset", "sentence", weight.alias("weight"), *spot)

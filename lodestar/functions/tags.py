"""Tags of documents as variants: values of any type under names, read with a type, written, and made columns where they are common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types that a tag can become a column of, by what a variant calls them; other tags stay where they are.
COLUMN_TYPES = {"BIGINT": "double", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean"}


def variant_of(tags: Column, kind: str = "json") -> Column:
    """Tags from JSON, null where it can't be read, or with kind="struct" from a struct or a map with string keys."""
    return F.try_parse_json(tags) if kind == "json" else F.to_variant_object(tags)


def _path(name: str) -> str:
    if "'" in name:
        raise ValueError("a tag's name can't hold a quote")
    return f"$['{name}']"


def tag(tags: Column, name: str, kind: str = "double") -> Column:
    """A tag's value as `kind`; null where the tag is missing or can't be one. A number kept as text is a number."""
    return F.try_variant_get(tags, _path(name), kind)


def entries(tags: Column) -> Column:
    """Tags as map<string,variant>; null where they aren't an object."""
    return F.when(F.schema_of_variant(tags).startswith("OBJECT"), F.try_variant_get(tags, "$", "map<string,variant>"))


def with_tags(tags: Column, **values: Column) -> Column:
    """tags with these set, in the place of those of the same names; a null value removes the tag. Null tags count as none."""
    names = F.array(*[F.lit(n) for n in values])
    old = F.map_filter(F.coalesce(entries(tags), F.expr("cast(map() as map<string,variant>)")), lambda k, _: ~F.array_contains(names, k))
    new = F.map_from_arrays(names, F.array(*[F.to_variant_object(F.named_struct(F.lit("v"), v)) for v in values.values()]))
    new = F.transform_values(new, lambda _, v: F.try_variant_get(v, "$.v", "variant"))
    new = F.map_filter(new, lambda _, v: v.isNotNull() & ~F.is_variant_null(v))
    return F.to_variant_object(F.map_concat(old, new))


def common_tags(rows: DataFrame, tags_col: str, share: float = 0.5) -> dict[str, str]:
    """The tags that at least `share` of the rows have, each with the type of a column that holds all of its values.

    Numbers become double; a tag of several types text; one that holds lists or objects isn't common. Names are at most
    the mean number of tags over share, however many rows there are.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be over 0 and at most 1")
    kinds = rows.select(F.explode(entries(F.col(tags_col))).alias("name", "value")).where(~F.is_variant_null("value"))
    kinds = kinds.withColumn("kind", F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)).groupBy("name", "kind").agg(F.count("*").alias("n"))
    by_name = kinds.groupBy("name").agg(F.sum("n").alias("n"), F.collect_set("kind").alias("kinds"))  # a handful of types
    whole = rows.count()
    found = by_name.where(F.col("n") >= share * whole).collect() if whole else []
    numbers = {"BIGINT", "DOUBLE", "FLOAT", "DECIMAL"}
    known = numbers | set(COLUMN_TYPES)
    kind = lambda kinds: "double" if kinds <= numbers else COLUMN_TYPES[next(iter(kinds))] if len(kinds) == 1 else "string"
    return {r["name"]: kind(set(r["kinds"])) for r in sorted(found, key=lambda r: r["name"]) if set(r["kinds"]) <= known}


def promoted(rows: DataFrame, tags_col: str, share: float = 0.5, prefix: str = "tag_") -> DataFrame:
    """rows with a column prefix + name for each common tag, of its type, so that filters and statistics reach it; the tags stay as they are."""
    return rows.withColumns({f"{prefix}{name}": tag(F.col(tags_col), name, kind) for name, kind in common_tags(rows, tags_col, share).items()})

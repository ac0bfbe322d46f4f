"""Hypergraphs from labelled records: articles by category, patents by class code, questions by tag.

Records come as DataFrames, since nothing here reads a network.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hyperloom.plans.storage import numbered

#: The levels of patent class codes, from the coarsest.
CODE_LEVELS = ("section", "class", "subclass", "group", "subgroup")
SYNTHETIC_FROM = 1_000_000_000


def from_labels(records: DataFrame, label: str, member: str, min_size: int = 1) -> DataFrame:
    """(label, v): each label's distinct members, for labels that have so many at least."""
    rows = records.select(F.col(label).alias("label"), F.col(member).alias("v")).dropna().distinct()
    enough = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("label")
    return rows.join(enough, "label", "left_semi")


def archive(category: Column) -> Column:
    """What stands before a category's first dot."""
    return F.substring_index(category, ".", 1)


def article_records(articles: DataFrame, archives: list[str] | None = None, primary_only: bool = False) -> DataFrame:
    """(article, category) of articles with `id` and `categories`, a text with blanks between; the first is the primary one."""
    names = F.filter(F.split(F.trim("categories"), r"\s+"), lambda x: x != "")
    rows = articles.select(F.col("id").alias("article"), F.explode(F.slice(names, 1, 1) if primary_only else names).alias("category"))
    return rows.where(archive(F.col("category")).isin(*archives)) if archives else rows


def truthy(column: Column) -> Column:
    """Whether a text is a yes-word; null for a null or blank one."""
    text = F.lower(F.trim(column.cast("string")))
    return F.when(text != "", text.isin("1", "t", "true", "y", "yes"))


def said(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of these columns that the rows have and that isn't blank."""
    have = [F.when(F.trim(F.col(f"`{n}`").cast("string")) != "", F.trim(F.col(f"`{n}`").cast("string"))) for n in names if n in rows.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def is_inventive(rows: DataFrame) -> Column:
    """True by a category that names an invention, else what the flag says; null if neither says anything."""
    return F.when(F.contains(F.lower(said(rows, ("cpc_category", "category"))), F.lit("invent")), True).otherwise(truthy(said(rows, ("is_inventive", "inventive"))))


def is_primary(rows: DataFrame) -> Column:
    """What a flag says, else whether the place in the sequence is 0 or 1; null if neither says anything."""
    place = said(rows, ("cpc_sequence", "sequence", "ordinal", "position")).try_cast("int")
    return F.coalesce(truthy(said(rows, ("is_primary", "is_main", "is_first", "primary"))), place.isin(0, 1))


def code_at(level: str, section: Column, klass: Column, subclass: Column, group: Column, subgroup: Column) -> Column:
    """A class code cut to a level, without blanks: the parts run together; a main group ends in /00.

    A subgroup with a slash names its group itself, one without stands behind its group's; without a subgroup the code is
    that of the main group. A level whose parts are missing is null.
    """
    section, klass, subclass, group, subgroup = (F.when(F.trim(c) != "", F.trim(c)) for c in (section, klass, subclass, group, subgroup))
    if level in CODE_LEVELS[:3]:
        return F.concat(*(section, klass, subclass)[: CODE_LEVELS.index(level) + 1])
    main = F.concat(group, F.lit("/00"))
    full = F.coalesce(F.when(F.contains(subgroup, F.lit("/")), subgroup), F.concat(group, F.lit("/"), subgroup), main)
    return F.regexp_replace(F.concat(section, klass, subclass, F.coalesce(F.when(full.isNotNull(), main), full) if level == "group" else full), r"\s+", "")


def patent_records(rows: DataFrame, level: str = "subclass", years: tuple[int, int] | None = None, sections: list[str] | None = None, prefixes: list[str] | None = None, inventive: bool = False, primary: bool = False) -> DataFrame:
    """(patent, code) of rows `patent`, `date`, `section`, `class`, `subclass`, `group`, `subgroup`, and columns that tell of `is_inventive` and `is_primary`.

    The year is the date's first four characters. With `inventive` or `primary`, rows that say no are left out, and
    rows that say nothing stay.
    """
    year = F.substring("date", 1, 4).try_cast("int")
    kept = rows.where(year.between(*years)) if years else rows
    kept = kept.where(F.col("section").isin(*sections)) if sections else kept
    for told, wanted in ((is_inventive(rows), inventive), (is_primary(rows), primary)):
        kept = kept.where(F.coalesce(told, F.lit(True))) if wanted else kept
    made = kept.select("patent", code_at(level, *(F.col(f"`{c}`") for c in CODE_LEVELS)).alias("code")).dropna()
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("code").startswith(p)
        made = made.where(hit)
    return made.distinct()


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Text with all HTML entities as characters."""
    return text.map(html.unescape, na_action="ignore")


def tags(field: Column) -> Column:
    """The tags of a field, `<a><b>` or `|a|b|`, escaped or not; a field with neither mark is one tag. Only fields with an & are unescaped."""
    plain = F.when(F.contains(field, F.lit("&")), unescaped(F.trim(field))).otherwise(F.trim(field))
    angle = F.regexp_extract_all(plain, F.lit("<([^<>]+)>"), 1)
    both = F.contains(plain, F.lit("<")) & F.contains(plain, F.lit(">"))
    return F.when(both, angle).otherwise(F.filter(F.split(plain, r"\|"), lambda x: x != ""))


def question_records(posts: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(question, tag) of posts `id`, `type` (1 for questions) and `tags`; synthetic ids are left out."""
    rows = posts.where((F.col("type") == 1) & (F.col("id") < SYNTHETIC_FROM)).select(F.col("id").alias("question"), F.explode(tags(F.col("tags"))).alias("tag"))
    return rows.where(F.col("tag").isin(*allowed)) if allowed else rows


def numbered_labels(hyperedges: DataFrame, by_size: bool = False) -> DataFrame:
    """`label`, its `size` and its line `number` from 1, by label or by size, greatest first."""
    sizes = hyperedges.groupBy("label").agg(F.count("*").alias("size"))
    order = [F.desc("size"), F.col("label")] if by_size else [F.col("label")]
    return numbered(sizes, order, "number").withColumn("number", F.col("number") + 1)

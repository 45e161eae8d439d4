"""A table of named templates: lookup, and upsert by the rules of one name and one content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"\A[a-z0-9]+(?:[+._-][a-z0-9]+)*\z"


def _content(template: Column) -> Column:
    return F.trim(template)


def lookup(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """wanted(name) with template and status: INVALID-TEMPLATE-NAME-FORMAT, FOUND or NOT_FOUND."""
    j = wanted.join(registry.select("name", "template"), "name", "left")
    return j.withColumn("status", F.when(~F.col("name").rlike(NAME), "INVALID-TEMPLATE-NAME-FORMAT").when(F.col("template").isNotNull(), "FOUND").otherwise("NOT_FOUND"))


def upsert(registry: DataFrame, incoming: DataFrame, replace: bool = True) -> DataFrame:
    """name, template, status of the registry after the incoming templates, sorted by name.

    A known name is replaced, unless replacing is not approved or another name has the content already
    (refused). A new name with known content takes the place of the name that had it (renamed).
    Both tables have each name once, and incoming each content once.
    """
    old = registry.select("name", F.col("template").alias("old"))
    holder = registry.groupBy(_content(F.col("template")).alias("content")).agg(F.min("name").alias("holder"), F.max("name").alias("other_holder"))
    new = incoming.select("name", "template", _content(F.col("template")).alias("content")).join(old, "name", "left").join(holder, "content", "left")
    elsewhere = F.coalesce((F.col("holder") != F.col("name")) | (F.col("other_holder") != F.col("name")), F.lit(False))
    status = F.when(F.col("old").isNotNull(), F.when(elsewhere | F.lit(not replace), "refused").otherwise("replaced")).otherwise(F.when(F.col("holder").isNotNull(), "renamed").otherwise("added"))
    new = new.withColumn("status", status)
    taken = new.where("status = 'replaced'").select("name").union(new.where("status = 'renamed'").select(F.col("holder").alias("name")))
    kept = registry.join(taken, "name", "left_anti").join(new.where("status = 'refused'").select("name", F.lit("refused").alias("status")), "name", "left").select("name", "template", F.coalesce("status", F.lit("kept")).alias("status"))
    return kept.union(new.where("status <> 'refused'").select("name", "template", "status")).orderBy("name")

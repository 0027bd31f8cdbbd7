"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Equal texts are found in three stages that each compare the whole text beside its digest: inside a map
task (the partial aggregate), inside salted digest groups, and over the winners of the salts. A group of
copies, however large, therefore reaches one task only as one row for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialise

#: Salted groups of one digest.
SALTS = 16


def _texts(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def combine(rows: DataFrame, best: str, salts: int = SALTS) -> DataFrame:
    """One row (digest, text, best, size) for each distinct text of ``rows`` (digest, text, best, salt_key).

    ``best`` is the largest value of that column, ``size`` the number of rows.
    """
    salt = F.pmod(F.xxhash64("salt_key"), F.lit(salts)).alias("salt")
    local = rows.groupBy("digest", "text", salt).agg(F.max(best).alias(best), F.count(F.lit(1)).alias("size"))
    return local.groupBy("digest", "text").agg(F.max(best).alias(best), F.sum("size").alias("size"))


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. The largest id of a group stays. Rows that
    repeat id and text are separate members of their group and exactly one of them stays; a group of null ids
    has a null keep_id and keeps one row. Empty texts are equal to each other. Other columns play no part.
    An empty table gives an empty result.
    """
    rows = docs.select(docs[key].alias("doc_id"), _texts(docs, text).alias("text"))
    rows = rows.withColumns({"digest": F.sha2("text", 256), "salt_key": F.col("doc_id")})
    groups = materialise(combine(rows, "doc_id").select("digest", F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size")), "groups")
    members = rows.groupBy("digest", "doc_id")
    shared = groups.groupBy("digest").count().where("count > 1")
    if shared.isEmpty():
        # every digest has one text, as the comparison of contents has shown
        found = members.agg(F.count(F.lit(1)).alias("rows")).join(groups, "digest")
    else:
        # different texts under one digest: the text is part of the key once more
        named = combine(rows, "doc_id").withColumnsRenamed({"doc_id": "keep_id", "size": "group_size"})
        found = rows.groupBy("digest", "text", "doc_id").agg(F.count(F.lit(1)).alias("rows")).join(named, ["digest", "text"])
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "keep_id", "group_size", (wins & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the row with the largest id.

    Rows that also share the id are told apart by their other columns, of which the largest stays; those
    columns must be orderable. A null text equals an empty one and is kept as it is if it stays.
    """
    # the text is the key of the group, so it needn't be carried twice
    bare = F.struct(docs[key].alias("k"), docs[text].isNull().alias("is_null"), *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    rows = docs.select(_texts(docs, text).alias("text"), bare.alias("best"), docs[key].alias("salt_key"))
    won = combine(rows.withColumn("digest", F.sha2("text", 256)), "best")
    back = [F.when(~F.col("best.is_null"), F.col("text")).alias(c) if c == text else F.col(f"best.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return won.select(*back)

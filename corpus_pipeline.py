"""A corpus pipeline from five document operators: each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import dedup, jaccard, langid, mixing, packing
from barloom.llm.common import word_count
from barloom.llm.queries import tokenizer
from barloom.session import materialise


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go (no letters, or below the calibrated threshold).

    Null and empty texts have no letters and go. Rows are judged one by one, so repeated rows stay repeated; an empty table stays empty. Columns of
    any names are kept.
    """
    model = langid.train(docs)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names that no output has
    named = langid.identify(plain, model, text=f"c{docs.columns.index('text')}")
    return named.where("NOT rejected").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id; null counts as empty. An empty table stays empty."""
    return dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five words and a similarity of 0.8: that with the smallest id (a null id last), of equal ids any one.

    Documents without words belong to no group and stay. Rows are judged by their own texts, also where an id repeats or is null: they are then
    told apart by numbers of their own, written with the rows. An empty table stays empty.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id IS NULL OR count > 1").isEmpty():
        gone = jaccard.near_duplicates(docs, width=5, percent=80).where("component_id < doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = materialise(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    found = jaccard.near_duplicates(rows.select("number", "row.text"), width=5, percent=80, key="number").select(F.col("doc_id").alias("number"), F.col("component_id").alias("class"))
    named = found.join(rows.select("number", F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), "number").alias("order")), "number")
    kept = named.groupBy("class").agg(F.min("order").alias("best")).select(F.col("best.number").alias("number"))
    return rows.join(kept, "number", "left_semi").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time they are taken.

    Null and empty texts have no words and are never taken; a null source is a source. Rows that repeat id, source and text are taken so many
    times together as the mix takes them, dealt evenly. An empty table stays empty.
    """
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    narrow = docs.select("doc_id", "source", word_count(docs["text"]).alias("words"), digest.alias("digest"))
    mixed = mixing.mix(narrow, size=narrow["words"])
    key = ["row.doc_id", "row.source", "row.digest"]
    times = mixed.where("size > 0").groupBy(*key).agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("times"), F.count(F.lit(1)).alias("rows"))
    times = materialise(times.where("times > 0"), "times")
    keyed = docs.select(F.struct(*docs.columns).alias("kept"), digest.alias("own"), docs["doc_id"].alias("id"), docs["source"].alias("from"))

    def of(times: DataFrame) -> DataFrame:
        return keyed.join(times, keyed["id"].eqNullSafe(times["doc_id"]) & keyed["from"].eqNullSafe(times["source"]) & (keyed["own"] == times["digest"]))

    def copies(rows: DataFrame) -> DataFrame:
        return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("kept.*")

    single = copies(of(times.where("rows = 1")))
    if times.where("rows > 1").isEmpty():
        return single
    # the whole takes of repeated rows, dealt by their number
    turn = F.row_number().over(Window.partitionBy("id", "from", "own").orderBy("kept"))
    dealt = of(times.where("rows > 1")).withColumn("turn", turn)
    dealt = dealt.withColumn("times", F.expr("times div rows") + (F.col("turn") <= F.col("times") % F.col("rows")).cast("long")).where("times > 0")
    return single.unionByName(copies(dealt))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset. A null text is empty and packed as its end mark; repeated rows are packed each."""
    pieces = packing.cut_documents(docs, tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [
    ("language", languages),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL can't express trained models, link components and patterns; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

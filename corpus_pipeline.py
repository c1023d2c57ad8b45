"""The corpus pipeline: toxicity, near duplicates, secrets, mixing and packing, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_dedup, packing, secrets, toxicity
from tessera.llm.common import WORD, Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _tag(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the network, trained on the labelled ones, doesn't reject, with their own columns.

    Null and empty texts are clean; repeated rows and null ids are judged by their text; an
    empty table stays empty.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of the smallest id. Repeated rows are one."""
    found = near_dedup.near_duplicates(docs).where("kept").groupBy("doc_id", "m").agg(F.count("*").alias("n"))
    found = Scratch(spark, "near-stage").table(found.select(F.col("doc_id").alias("k_id"), F.col("m").alias("k_m"), "n"), "kept")
    out = docs.join(found, docs["doc_id"].eqNullSafe(found["k_id"]) & (_tag(docs) == found["k_m"]), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if found.where("n > 1").limit(1).count() else out


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret span replaced by a mark and ``n_chars`` recounted."""
    found = secrets.find_secrets(docs).where(F.size("spans") > 0).select(F.col("m").alias("k_m"), F.col("spans").alias("k_spans")).dropDuplicates(["k_m"])
    found = Scratch(spark, "secret-stage").table(found.coalesce(8), "spans")
    new = F.when(found["k_spans"].isNull(), docs["text"]).otherwise(secrets.redact(docs["text"], found["k_spans"]))
    out = docs.join(found, _tag(docs) == found["k_m"], "left")
    columns = {"text": new}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(found["k_spans"].isNull(), docs["n_chars"]).otherwise(F.char_length(new)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns.get(c, docs[c]).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one on a source's border with the words that fit. Those it doesn't take, and empty ones, go."""
    plan = mixing.mix(docs, mixing.label_quality(_labels(spark, sf_dir)))
    plan = plan.where("taken > 0").groupBy("doc_id", "m").agg(F.max("taken").alias("k_taken"), F.max("size").alias("k_size"))
    plan = Scratch(spark, "mix-stage").table(plan.select(F.col("doc_id").alias("k_id"), F.col("m").alias("k_m"), "k_taken", "k_size"), "plan")
    out = docs.join(plan, docs["doc_id"].eqNullSafe(plan["k_id"]) & (_tag(docs) == plan["k_m"]))
    taken, size = plan["k_taken"], plan["k_size"]
    part = F.explode(F.transform(F.sequence(F.lit(1), F.ceil(taken / size).cast("int")), lambda k: F.least(size, taken - (k - 1) * size)))
    k_size, k_part = _free(docs, "k_size"), _free(docs, "k_part")
    out = out.select(*[docs[c] for c in docs.columns], size.alias(k_size), part.alias(k_part))
    whole = F.col(k_part) == F.col(k_size)
    new = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(k_part).cast("int")), " "))
    columns = {"text": new}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.char_length(new)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of words; the epochs of a document, the cut one too, are one cluster and never share a bin.

    Rows of a null id are clusters by their text. Null or empty texts get no bin; other
    columns are not read; an empty table gives no bins.
    """
    cluster = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    return packing.pack(docs, cluster)


STAGES = [("toxicity", toxic), ("near_dedup", near), ("secrets", secret), ("mix", mixed), ("pack", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
        scratch.free()
    return docs

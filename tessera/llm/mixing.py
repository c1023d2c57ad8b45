"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Source weights by rank of the source name, repeating.
CYCLE = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
ROWS_A_BIN = 5_000


def uniform(doc_id, seed: str):
    """A number in (0, 1) from the id alone, so reruns and lost executors agree."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def targets(stats: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, cycle: tuple = CYCLE) -> DataFrame:
    """Words to take of each source: weights share ``share`` of all words, none above ``max_epochs`` times its source.

    ``stats(source, source_size, ...)`` has one row a source, so its windows read
    one row a source. Filling to a level: sources are ordered by cap over weight;
    the level is what is left of the budget over the weights left, at the first
    source whose cap is above it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    d = stats.withColumn("weight_", weight)
    every = Window.partitionBy()
    order = Window.orderBy("ratio_", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(max_epochs) * F.col("source_size")
    d = d.withColumn("cap_", cap).withColumn("ratio_", F.col("cap_") / F.col("weight_"))
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap_").over(before), F.lit(0.0))
    weights = F.sum("weight_").over(every) - F.coalesce(F.sum("weight_").over(before), F.lit(0.0))
    d = d.withColumn("level_", left / weights).withColumn("at_", F.row_number().over(order))
    first = F.min(F.when(F.col("ratio_") > F.col("level_"), F.struct("at_", "level_"))).over(every)["level_"]
    d = d.withColumn("all_", first)
    target = F.when(F.col("all_").isNull() | (F.col("ratio_") <= F.col("all_")), F.col("cap_")).otherwise(F.col("all_") * F.col("weight_"))
    return d.select(*stats.columns, target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix-", share: float = SHARE, max_epochs: float = MAX_EPOCHS, cycle: tuple = CYCLE) -> DataFrame:
    """How many words of each document a mix takes.

    ``docs(doc_id, text, source)``; other columns are not read. ``quality(doc_id,
    quality_weight double)``, one row a document, gives positive sampling weights (1 where absent).
    A source first gives whole epochs, ``floor(target / source_size)`` times every
    document. The rest of its target comes from its documents in ascending order
    of ``-ln(u) / weight`` until the prefix sum of sizes reaches it; the document
    on the border gives the words that still fit.

    Returns ``doc_id, size, source_size, target, taken, m``, one row an input row;
    ``m`` is a hash of the text.
    Null text has size 0, a null source is a source, a null id samples by the word
    "null", repeated rows count each, an empty table gives an empty result. Keys
    tie only for repeated ids; then size decides, and equal rows are interchangeable.

    A source is never one task: its documents are cut into bins by key, whose sums
    are summed first, and only a bin is sorted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    d = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("m"), word_count(F.col("text")).alias("size"))
    d = scratch.table(d, "sizes")
    if quality is not None:
        d = d.join(quality.select("doc_id", "quality_weight"), "doc_id", "left")
        weight = F.coalesce("quality_weight", F.lit(1.0))
    else:
        weight = F.lit(1.0)
    d = d.select("doc_id", "source", "m", "size", weight.alias("w")).withColumn("key", -F.ln(uniform(F.col("doc_id"), seed)) / F.col("w"))
    d = scratch.table(d, "keys")
    scratch.drop("sizes")
    stats = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows_"), F.min("w").alias("slow_"))
    plan = targets(stats, share, max_epochs, cycle)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs_", epochs)
    plan = plan.withColumn("rest_", F.floor(F.col("target") - F.col("epochs_") * F.col("source_size") + 0.5).cast("long"))
    plan = scratch.table(plan.coalesce(1), "plan")
    bins = F.ceil(F.col("rows_") / F.lit(float(ROWS_A_BIN)))
    d = d.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.doc_id", "d.source", "d.m", "d.size", "d.key", "source_size", "target", "epochs_", "rest_",
        F.floor((F.lit(1.0) - F.exp(-F.col("slow_") * F.col("d.key"))) * bins).cast("long").alias("bin"),
    )
    sums = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before_", F.coalesce(F.sum("bin_size").over(up), F.lit(0))).drop("bin_size")
    sums = scratch.table(sums, "bins")
    inner = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within_", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bin") == F.col("s.bin")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest_") - F.col("before_") - F.col("within_")))
    return d.select("d.doc_id", "size", "source_size", "target", (F.col("epochs_") * F.col("size") + part).cast("long").alias("taken"), "d.m")


def label_quality(labels: DataFrame) -> DataFrame:
    """Sampling weights from labels: 2 for quality 1, 0.5 for 0; the best of repeated labels."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("quality_weight"))


#: DuckDB SQL for ``mix`` over documents and labels.
SQL = r"""
with q as (select doc_id, case when max(quality) > 0 then 2.0 else 0.5 end::double w from labels where doc_id is not null and quality is not null group by 1),
d as (select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::bigint size, coalesce(q.w, 1.0::double) w,
  (('0x' || substr(md5('mix-' || coalesce(d.doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double u
  from documents d left join q on q.doc_id = d.doc_id),
s as (select source, sum(size)::bigint source_size, count(*) n from d group by 1),
t as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] weight, 2.0::double * source_size cap from s),
t2 as (select *, cap / weight ratio from t),
t3 as (select *, row_number() over o at_,
  (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0.0::double))
  / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0.0::double)) lev
  from t2 window o as (order by ratio, source nulls last)),
lam as (select arg_min(lev, at_) l from t3 where ratio > lev),
p as (select source, source_size, case when l is null or ratio <= l then cap else l * weight end target from t3, lam),
p2 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint epochs from p),
p3 as (select *, floor(target - epochs * source_size + 0.5)::bigint rest from p2),
k as (select d.*, -ln(u) / w ky from d),
c as (select *, coalesce(sum(size) over (partition by source order by ky, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint before from k)
select c.doc_id, c.size, p3.source_size, p3.target, (epochs * c.size + greatest(0, least(c.size, rest - before)))::bigint taken
from c join p3 on c.source is not distinct from p3.source
"""

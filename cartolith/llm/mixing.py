"""Mixing sources to target weights by random keys, range sort and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: Weights by a source's place in code point order, null last, repeating; a source repeats at most so many epochs.
WEIGHTS, EPOCHS = (1, 2, 3), 3
#: Hexadecimal digits of the random key that name a range: 4,096 ranges a source, each summed on its own.
RANGE_DIGITS = 3

ORACLE_SQL = r"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
    FROM docs GROUP BY source),
ranked AS (
    SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
        CAST(coalesce(sum(source_size) OVER before, 0) AS BIGINT) AS size_before, CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_before
    FROM sources
    WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
    SELECT *, 3 * source_size * (weights - weight_before) <= (total - 3 * size_before) * weight AS is_capped FROM ranked),
free AS (
    SELECT CAST(sum(CASE WHEN is_capped THEN source_size ELSE 0 END) AS BIGINT) AS capped_size,
        CAST(sum(CASE WHEN is_capped THEN 0 ELSE weight END) AS BIGINT) AS free_weight FROM capped),
targets AS (
    SELECT source, source_size, CASE WHEN is_capped THEN CAST(3 * source_size AS DOUBLE)
        ELSE CAST((total - 3 * capped_size) * weight AS DOUBLE) / CAST(free_weight AS DOUBLE) END AS target
    FROM capped, free),
keyed AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS size_before
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE (budget // greatest(source_size, 1)) * size
        + greatest(0, least(size, budget % greatest(source_size, 1) - size_before)) END AS taken
FROM keyed
"""


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of (source, source_size): weights share all sizes, none above EPOCHS times its source's size.

    The excess of sources that stop there is shared by weight among the others until none is above. In order of size
    by weight the sources that stop come first, so running sums find them; all of it is integer arithmetic up to one
    division. The window goes over the sources alone, a row for each.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(place) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    capped = ranked.withColumn("is_capped", EPOCHS * F.col("source_size") * (F.col("weights") - F.col("weight_before")) <= (F.col("total") - EPOCHS * F.col("size_before")) * F.col("weight"))
    left = F.col("total") - EPOCHS * F.sum(F.when(F.col("is_capped"), F.col("source_size")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("is_capped"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("is_capped"), (EPOCHS * F.col("source_size")).cast("double")).otherwise((left * F.col("weight")).cast("double") / free.cast("double"))
    return capped.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """Words that a mix to target weights takes of each document.

    Returns (doc_id, size, source_size, target, taken, source), a row for each row of ``docs``. A document's key is the
    MD5 of its id, so reruns agree. Keys fall into 4,096 ranges a source; each range is sorted and summed on its own,
    the ranges' sums give the ranges' starts, and each source is cut at its exact budget (its target, rounded down):
    whole epochs first, then documents in key order, of the last one only the words still due. Null text has size 0;
    a null id has a key like any other, and a null source is a source; rows that tie in key go by id, then size, and
    repeated rows are taken one by one; sources without words take nothing; an empty table gives no rows. Columns
    other than doc_id, text and source are not read.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = sized.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("range_start"))
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "range", "range_start", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = placed.alias("p").join(starts.alias("s"), (F.col("p.range") == F.col("s.range")) & F.col("p.source").eqNullSafe(F.col("s.source")))
    epochs = F.expr("cast(floor(target) as bigint) div greatest(source_size, 1L)")
    rest = F.expr("cast(floor(target) as bigint) % greatest(source_size, 1L)") - F.col("range_start") - F.col("in_range")
    taken = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest)))
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("p.source").alias("source"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` mixed to the target weights, with the columns of ``docs`` and whole texts.

    Each row comes as many times as the mix takes its words, the last, partly taken document counting as whole, so
    that each source stays within one document of its budget. Documents without words have nothing to be taken and
    are left out; null ids and repeated rows are treated row by row, like in :func:`mix`. Rows that agree in id, source
    and size are interchangeable.
    """
    own = Window.partitionBy("doc_id", "source", "size").orderBy(F.col("taken").desc())
    times = mix(docs).withColumn("nth", F.row_number().over(own)).where("taken > 0")
    times = times.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__mixed_size"), F.col("nth").alias("__mixed_nth"), F.expr("cast(ceil(taken / size) as int)").alias("__times"))
    size = word_count(F.col("text"))
    numbered = docs.withColumn("__size", size).withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "source", "__size").orderBy(F.xxhash64("text"))))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__mixed_size")) & (F.col("__nth") == F.col("__mixed_nth"))
    return numbered.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row of ``documents``; see :func:`mix` for nulls, ties, repeats and empty tables."""
    return mix(table(spark, sf_dir, "documents")).drop("source")

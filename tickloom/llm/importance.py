"""Importance resampling towards a target: documents are drawn in proportion to how much likelier their hashed n-grams are
in the target than in the corpus.

A document's features are its words and pairs of neighbouring words, each in one of ``buckets`` by its checksum. The
bucket array of a text is made by higher-order functions inside one projection, once: the arrays are a written table of
two bytes a feature. Counting them is a partial aggregation in each task, of which only a total for each bucket is
shuffled; scoring is an aggregate over ``element_at`` of the literal array of gains, without an explode, a join or a
shuffle. The draw adds Gumbel noise, a hash of the seed and the
doc_id, to the weight and takes the greatest scores, which is a draw without replacement.

Ranks come without one order over all rows: scores are whole numbers between bounds that the logarithms of the counts
give (some 10^5 values whatever the input), so the counts of all scores fix the least score drawn and how many stand
before each, and only rows of equal score are ordered by doc_id, in one window for each score.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

BUCKETS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a whole text, A-Z in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def bucket_array(w: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of all words of an array and of all pairs of neighbours, repeats included."""

    def bucket(x: Column) -> Column:
        return (F.crc32(x.cast("binary")) % buckets).cast("int")

    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(w, bucket), pairs)


def bucketed(docs: DataFrame, *columns: Column, buckets: int = BUCKETS) -> DataFrame:
    """``columns``, n_words and the bucket array ``b`` of each row's text."""
    found = docs.select(*columns, words(F.col("text")).alias("w"))
    return found.select(*(c for c in found.columns if c != "w"), F.size("w").cast("bigint").alias("n_words"), bucket_array(F.col("w"), buckets).alias("b"))


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the arrays ``b`` of all rows."""
    # explode_outer, as explode would have the planner filter by the array's size first, and so make each array twice.
    n = rows.select(F.explode_outer("b").alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[n["b"].to_numpy(np.int64)] = n["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of a bucket's smoothed share in the target over that in the source)."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a hash of the seed and the doc_id; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def scored(rows: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean of gains, 0 without features) and score of rows (doc_id,
    n_words, b)."""
    table = F.split(F.lit(",".join(map(str, gain.tolist()))), ",").cast("array<bigint>")  # folded into one literal array
    n, total = F.size("b").cast("bigint"), F.aggregate("b", F.lit(0).cast("bigint"), lambda s, b: s + F.element_at(table, b + 1))
    rows = rows.select("doc_id", "n_words", n.alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``rows`` (doc_id, n_features, score, ...) with rank: 1, 2, ... in order of score, greatest first, for the
    floor(percent * N / 100) of the N eligible rows with the greatest; null for the others."""
    spark = rows.sparkSession
    counts = rows.where(eligible).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    n = counts["n"].to_numpy(np.int64)
    drawn, before = percent * int(n.sum()) // 100, np.cumsum(n) - n
    reached = before < drawn
    places = spark.createDataFrame(list(zip(counts["score"][reached].tolist(), before[reached].tolist(), strict=True)), "score bigint, before bigint")
    least = int(counts["score"][reached].min()) if reached.any() else None
    above = eligible & (F.col("score") >= least) if reached.any() else F.lit(False)
    inside = rows.where(above).join(F.broadcast(places), "score")  # a row for each distinct score at most
    place = F.col("before") + F.expr("row_number() over (partition by score order by doc_id nulls last, n_features)")
    inside = inside.withColumn("rank", F.when(place <= drawn, place).cast("bigint")).drop("before")
    return inside.unionByName(rows.where(~above).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank, one row per row of ``docs``; rank is null for rows that aren't drawn.

    Null and empty texts have no features, weight 0 and are never drawn. Ties go to the smaller doc_id, a null id last;
    rows of equal id and score are ranked by their features, and equal rows in any order. A null id draws the noise of
    an empty one. Other columns are not looked at. Empty tables give an empty result, or the gains of an empty target.
    """
    with Scratch(docs.sparkSession, "importance") as scratch:
        made = scratch.table(bucketed(docs, F.col("doc_id").cast("bigint").alias("doc_id"), buckets=buckets), "buckets")
        gain = gains(totals(made, buckets), totals(bucketed(target, buckets=buckets), buckets))
        rows = scratch.table(scored(made, gain, seed), "scored", keep=True)
        return ranked(rows, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
with tbl as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
    lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as crc_of),
raw as (
  select row_number() over () as row, doc_id, text, true as source from documents union all select 0, null, text, false from benchmark),
w as (
  select row, doc_id, source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from raw),
f as materialized (
  select row, source, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) as x from w),
b as materialized (
  select x, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, y: xor(c >> 8, crc_of[(xor(c, y) & 255) + 1])), 4294967295::bigint) % 10000 as bucket
  from (select distinct x from f), tbl),
n as (select bucket, count(*) filter (source) as s, count(*) filter (not source) as t from f join b using (x) group by bucket),
a as (select coalesce(sum(s), 0)::double as s_all, coalesce(sum(t), 0)::double as t_all from n),
g as (select bucket, floor(1000 * ln((t + 1.0::double) * (s_all + 10000) / ((s + 1.0::double) * (t_all + 10000))))::bigint as gain from n, a),
m as (select row, count(*) as n_features, sum(gain)::bigint as total from f join b using (x) join g using (bucket) where source group by row),
s as (
  select doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) as weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from w left join m using (row) where source),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score from s),
r as (
  select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features) end as place,
    25 * count(*) filter (n_words >= 20) over () // 100 as drawn from z)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when place <= drawn then place end::bigint as rank from r
"""

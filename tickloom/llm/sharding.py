"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

Each shard draws ``-ln(u) / weight`` for a document, u being a hash of the shard's path and the doc_id. The draw of a
rack is the least of its shards' draws and that of a region the least of its racks': a minimum of exponential draws is
an exponential draw with the sum of their weights, so every level is a weighted draw, and the descent takes the child
with the least at each. When a shard is added or a weight grows, only draws on that path fall: rows move only into the
shard that grew, and no draw of another subtree changes.

Slots are numbered without sorting a shard in one task: rows of a shard are dealt into ``spread`` buckets by a hash of
doc_id, numbered inside each, and set off by the counts of the buckets before, a table of shards * spread rows at most
whatever the input. The counts read the ids only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0

    @property
    def path(self) -> str:
        return f"{self.region}/{self.rack}/{self.number}"


#: Eight shards, and the same tree with a ninth in the last rack.
EIGHT = tuple(Shard(f"region{n // 4}", f"rack{n // 2 % 2}", n) for n in range(8))
NINE = (*EIGHT, Shard("region1", "rack1", 8))
SPREAD = 4096


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def draw(path: str) -> Column:
    """The exponential draw of unit weight of a shard's path for a row, from 52 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{path}|"), _id()).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52)))


def descend(shards: tuple[Shard, ...], draws: dict[str, Column]) -> Column:
    """Number of the shard at the end of the descent."""

    def level(members: list[Shard], keys: tuple[str, ...]) -> tuple[Column, Column]:
        """(draw, number) of the subtree of ``members``."""
        if not keys:
            return draws[members[0].path] / members[0].weight, F.lit(members[0].number)
        names = list(dict.fromkeys(getattr(s, keys[0]) for s in members))
        below = [level([s for s in members if getattr(s, keys[0]) == name], keys[1:]) for name in names]
        least = F.least(*(d for d, _ in below)) if len(below) > 1 else below[0][0]
        number = below[-1][1]
        for d, n in reversed(below[:-1]):
            number = F.when(d == least, n).otherwise(number)
        return least, number

    return level(list(shards), ("region", "rack", "number"))[1]


def assign(docs: DataFrame, shards: tuple[Shard, ...] = EIGHT, grown: tuple[Shard, ...] | None = None, spread: int = SPREAD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (null without ``grown``), one row per row of ``docs``.

    doc_id and the tree alone decide the shard; a null id counts as empty, so such rows share a shard and rows of equal
    id stay together. Slots run from 0 without gaps in each shard, by bucket, doc_id, checksum and size, and between
    equal rows in any order. A null text has no bytes: size 1, checksum 0. Other columns are not looked at, and an
    empty table gives an empty result.
    """
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), _id()).cast("binary")), 1, 8), 16, 10).cast("bigint") % spread
    every = list(dict.fromkeys(s.path for s in (*shards, *(grown or ()))))

    def placed(rows: DataFrame) -> DataFrame:
        drawn = rows.withColumns({f"draw{k}": draw(path) for k, path in enumerate(every)})
        draws = {path: F.col(f"draw{k}") for k, path in enumerate(every)}
        more = descend(grown, draws) if grown else F.lit(None).cast("int")
        return drawn.withColumns({"shard": descend(shards, draws), "grown_shard": more, "bucket": bucket})

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    counts = placed(ids).groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = counts.selectExpr("shard", "bucket", "sum(rows) over (partition by shard order by bucket) - rows as before")
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = placed(rows).withColumn("nth", F.expr("row_number() over (partition by shard, bucket order by doc_id, text_crc32, size)"))
    rows = rows.join(F.broadcast(before), ["shard", "bucket"])  # shards * spread rows at most
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), EIGHT, NINE)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_draw(s: Shard) -> str:
    return f"-ln((('0x' || substr(md5('{s.path}|' || id), 1, 13))::bigint + 0.5) / 4503599627370496.0) / {s.weight}"


OP7_SQL = f"""
with tbl as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
    lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as crc_of),
d as (
  select doc_id, coalesce(doc_id::varchar, '') as id, encode(coalesce(text, '')) as raw from documents),
m as (
  select doc_id, octet_length(raw) + 1 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(raw), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295::bigint) as text_crc32,
    [{', '.join(_sql_draw(s) for s in NINE)}] as draws,
    ('0x' || substr(md5('slot|' || id), 1, 8))::bigint % {SPREAD} as bucket
  from d, tbl),
s as (
  select *, list_position(draws[:8], list_min(draws[:8])) - 1 as shard, list_position(draws, list_min(draws)) - 1 as grown from m)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::integer as shard,
  (row_number() over (partition by shard order by bucket, doc_id, text_crc32, size) - 1)::bigint as slot, grown::integer as grown_shard
from s
"""

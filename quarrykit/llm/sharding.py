"""Proportional stratified interleaving (native).

Rows of each source are ranked in a seeded shuffle; row r of n has the fraction (2r - 1) / 2n. All rows sorted by
fraction and cut into equal runs give shards that each hold the sources in the mixture's proportions (within one row a
source and cut).

Both rankings are global, yet no task holds a source or the table: a row's shuffle hash gives one of ``BUCKETS`` equal
ranges, a small table has the rows of each (source, range), its running sums plus the rank inside the range are the
rank. The same is done for the fractions, which are spread evenly by construction. Only ids, sources, sizes and hashes
move, never texts; what is broadcast has exactly ``BUCKETS`` rows at most.

Defined results: null sources are a source of their own; null texts have size 8 and checksum 0; rows without an id are
shuffled by their text; repeated rows are ranked one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def assign(docs: DataFrame, n_shards: int, seed: str = "1", id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` narrowed to id, source, size and checksum, with ``shard`` (from 0) and ``slot`` (gapless from 0)."""
    body = F.coalesce(F.col(text), F.lit(""))
    row = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    shuffled = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))).cast("binary"))
    row = row.withColumn("h", shuffled).withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    ranged = row.repartition("stratum", "range")
    counts = ranged.groupBy("stratum", "range").agg(F.count("*").alias("n_range"))
    whole = Window.partitionBy("stratum")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stratum", "range", F.coalesce(F.sum("n_range").over(before), F.lit(0)).alias("before"), F.sum("n_range").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("stratum", "range").orderBy("h", "doc_id", "text_crc32", "size"))
    ranked = ranged.withColumn("inside", inside).join(counts, ["stratum", "range"]).withColumn("rank", F.col("before") + F.col("inside"))
    return _cut(ranked.select("doc_id", "stratum", "size", "text_crc32", "rank", "n"), n_shards)


def _cut(ranked: DataFrame, n_shards: int) -> DataFrame:
    part = F.floor(((2 * F.col("rank") - 1) * BUCKETS).cast("decimal(38,0)") / (2 * F.col("n"))).cast("int")
    parted = ranked.withColumn("part", part).repartition("part")
    sums = parted.groupBy("part").agg(F.count("*").alias("n_part"))
    order = Window.orderBy("part")  # BUCKETS rows at most
    sums = sums.select("part", F.coalesce(F.sum("n_part").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n_part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    fraction = (2 * F.col("rank") - 1).cast("double") / (2 * F.col("n")).cast("double")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(fraction, "stratum", "rank"))
    at = parted.withColumn("inside", inside).join(F.broadcast(sums), "part").withColumn("g", F.col("start") + F.col("inside") - 1)
    at = at.withColumn("shard", F.expr(f"g * {n_shards} div total").cast("int"))
    return at.select("doc_id", "stratum", "size", "text_crc32", "shard", F.expr(f"g - (shard * total + {n_shards - 1}) div {n_shards}").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order."""
    assigned.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.expr("substring(stratum, 2)").alias("source"))


ORACLE = """
with t as (select doc_id, '=' || source stratum, strlen(coalesce(text, '')) + 8 size, coalesce(text, '') s from documents),
r as (select *, row_number() over (partition by stratum order by md5('1-' || doc_id), doc_id) r, count(*) over (partition by stratum) n from t),
g as (select *, row_number() over (order by (2 * r - 1)::double / (2 * n)::double, stratum, r) - 1 g, count(*) over () total from r),
s as (select *, (g * 24) // total shard from g),
crc_table as (select i, v from (select range i, range x0 from range(256)) t, lateral (
  select xor(case when a7 & 1 = 1 then 3988292384 else 0 end, a7 >> 1) v from (
  select xor(case when a6 & 1 = 1 then 3988292384 else 0 end, a6 >> 1) a7 from (
  select xor(case when a5 & 1 = 1 then 3988292384 else 0 end, a5 >> 1) a6 from (
  select xor(case when a4 & 1 = 1 then 3988292384 else 0 end, a4 >> 1) a5 from (
  select xor(case when a3 & 1 = 1 then 3988292384 else 0 end, a3 >> 1) a4 from (
  select xor(case when a2 & 1 = 1 then 3988292384 else 0 end, a2 >> 1) a3 from (
  select xor(case when a1 & 1 = 1 then 3988292384 else 0 end, a1 >> 1) a2 from (
  select xor(case when x0 & 1 = 1 then 3988292384 else 0 end, x0 >> 1) a1))))))))),
tab as (select list(v order by i) v from crc_table),
crc as (select doc_id, shard, g, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, 2 * strlen(s), 2), lambda p: ('0x' || substr(hex(encode(s)), p, 2))::bigint)),
  lambda a, b: xor(v[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::bigint) c from s, tab)
select s.doc_id, size::bigint size, c::bigint text_crc32, 'rows' law, s.shard::int shard, (s.g - (s.shard * total + 23) // 24)::bigint slot, null::int grown_shard, substr(stratum, 2) source
from s join crc on crc.g = s.g
"""

"""Control-flow graph of an instruction stream by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import u64


def with_targets(classed: DataFrame) -> DataFrame:
    """``target`` of ARM rows, which decoders leave null, from the operands: the first 0x.. or 0h.., or all of them as a decimal."""
    operands = F.trim(F.coalesce("operands", F.lit("")))
    digits = F.regexp_extract(operands, "0[xXh]([0-9A-Fa-f]+)", 1)
    named = F.when(digits != "", u64.parse_hex(digits)).otherwise(F.when(operands.rlike(r"^\+?[0-9]{1,18}$"), operands.try_cast("bigint")))
    return classed.withColumn("target", F.when(F.col("isa") == "x86", F.col("target")).otherwise(F.coalesce("target", named)))


def _targets(classed: DataFrame) -> DataFrame:
    return classed.where("is_control_flow and target is not null").select("binary_id", F.col("target").alias("address")).distinct()


def leaders(classed: DataFrame) -> DataFrame:
    """Instructions with ``is_leader``: the first, those after control flow, and every named target."""
    classed = with_targets(classed)
    w = Window.partitionBy("binary_id").orderBy("seq")
    hit = _targets(classed).withColumn("_target", F.lit(True))
    marked = classed.join(hit, ["binary_id", "address"], "left")
    return marked.withColumn("is_leader", F.coalesce(F.lag("is_control_flow").over(w), F.lit(True)) | F.coalesce("_target", F.lit(False))).drop("_target")


def in_blocks(classed: DataFrame) -> DataFrame:
    w = Window.partitionBy("binary_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return leaders(classed).withColumn("block_id", F.sum(F.col("is_leader").cast("long")).over(w) - 1)


def blocks(classed: DataFrame) -> DataFrame:
    return in_blocks(classed).groupBy("binary_id", "block_id").agg(F.min_by("address", "seq").alias("address"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_instructions"))


def edges(classed: DataFrame) -> DataFrame:
    """``binary_id, src_block, dst_block, edge_type``; the next block is the next in the stream."""
    rows = in_blocks(classed)
    last = rows.groupBy("binary_id", "block_id").agg(
        F.min_by("address", "seq").alias("start"),
        F.max_by(F.struct("is_call", "is_return", "is_conditional", "is_unconditional", "target"), "seq").alias("e"),
    )
    ahead = last.withColumn("next", F.lead("block_id").over(Window.partitionBy("binary_id").orderBy("block_id")))
    # of blocks with one address the last counts
    at = last.groupBy("binary_id", F.col("start").alias("_t")).agg(F.max("block_id").alias("to"))
    ahead = ahead.withColumn("_t", F.col("e.target")).join(at, ["binary_id", "_t"], "left")
    e = F.col("e")
    kinds = F.array(
        F.struct(F.when(e["is_conditional"], F.col("to")).alias("dst"), F.lit("BranchTrue").alias("kind")),
        F.struct(F.when(e["is_conditional"], F.col("next")).alias("dst"), F.lit("BranchFalse").alias("kind")),
        F.struct(F.when(~e["is_conditional"] & e["is_unconditional"], F.col("to")).alias("dst"), F.lit("Unconditional").alias("kind")),
        F.struct(F.when(e["is_call"], F.col("to")).alias("dst"), F.lit("Call").alias("kind")),
        F.struct(F.when(~e["is_conditional"] & ~e["is_unconditional"] & ~e["is_return"], F.col("next")).alias("dst"), F.lit("FallThrough").alias("kind")),
    )
    return ahead.select("binary_id", F.col("block_id").alias("src_block"), F.explode(kinds).alias("x")).where("x.dst is not null").select("binary_id", "src_block", F.col("x.dst").alias("dst_block"), F.col("x.kind").alias("edge_type"))


def degrees(edges_: DataFrame) -> DataFrame:
    """Out and in degree of each block that has edges."""
    ends = edges_.select("binary_id", F.inline(F.array(F.struct(F.col("src_block").alias("block_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_block").alias("block_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("binary_id", "block_id").agg(F.sum("o").alias("n_successors"), F.sum("i").alias("n_predecessors"))


def adjacency(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy("binary_id", "src_block").agg(F.sort_array(F.collect_list(F.struct("dst_block", "edge_type"))).alias("successors"))


def previous_in_block(classed: DataFrame) -> DataFrame:
    w = Window.partitionBy("binary_id", "block_id").orderBy("seq")
    return in_blocks(classed).withColumn("previous_address", F.lag("address").over(w)).withColumn("previous_mnemonic", F.lag("mnemonic").over(w))

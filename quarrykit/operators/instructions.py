"""Instruction streams: classes, function seeds and intervals, thunks, jump tables.

Rows: ``binary_id, seq, isa, address, length, mnemonic, operands, target`` (``target``: resolved near target or null).
Windows are by binary and ordered by ``seq``; a binary's stream is one partition, as its order requires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.functions import text as X
from quarrykit.functions import u64


def classes(rows: DataFrame) -> DataFrame:
    """Adds is_call, is_return, is_conditional, is_unconditional, is_control_flow."""
    m = X.ascii_lower(F.col("mnemonic"))
    base = F.substring_index(m, ".", 1)
    x86 = F.col("isa") == "x86"
    cc = "|".join(rules.ARM_CONDITIONS.split())
    arm_cond = m.rlike(rf"(?s)^b(\..+|{cc})$") | m.isin("cbz", "cbnz", "tbz", "tbnz")
    arm_uncond = m.isin("b", "bx", "bxj", "br", "braa", "brab")
    arm_call = base.isin("bl", "blx", "blr", "blraa", "blrab")
    arm_ret = base.isin("ret", "eret")
    ret = m.isin("ret", "retn", "retf", "iret", "iretd", "iretq")
    arm_cf = base.isin("b", "bl", "blx", "bx", "bxj", "br", "blr", "braa", "brab", "blraa", "blrab", "cbz", "cbnz", "tbz", "tbnz", "ret", "eret")
    pick = lambda a, b: F.when(x86, a).otherwise(b)
    return rows.withColumns(
        {
            "is_call": pick(m == "call", arm_call),
            "is_return": pick(ret, arm_ret),
            "is_conditional": pick(m.startswith("j") & (m != "jmp"), arm_cond),
            "is_unconditional": pick(m == "jmp", arm_uncond),
            "is_control_flow": pick(m.startswith("j") | (m == "call") | ret, arm_cf),
        }
    )


def text(mnemonic: Column, operands: Column) -> Column:
    return F.when(F.coalesce(operands, F.lit("")) == "", mnemonic).otherwise(F.concat(mnemonic, F.lit(" "), operands))


def is_prologue(bytes_: Column, architecture: Column) -> Column:
    out = F.when(F.lit(False), False)
    for arch, prefixes in rules.PROLOGUES.items():
        out = out.when(architecture == arch, X.any_of([F.lower(F.hex(bytes_)).startswith(p) for p in prefixes]))
    return out.otherwise(False)


def seeds(classed: DataFrame, entries: DataFrame | None = None, exports: DataFrame | None = None) -> DataFrame:
    """``binary_id, address`` where functions start: entries, exports, x86 call targets, jumps over a gap to the very next
    decoded instruction, prologues; those that are decoded addresses."""
    w = Window.partitionBy("binary_id").orderBy("seq")
    ahead = classed.withColumn("_next", F.lead("address").over(w))
    x86 = F.col("isa") == "x86"
    gap = F.col("is_unconditional") & (F.col("target") == F.col("_next")) & (F.col("_next") != F.col("address") + F.col("length"))
    found = ahead.where(x86 & F.col("target").isNotNull() & (F.col("is_call") | gap)).select("binary_id", F.col("target").alias("address"))
    if "bytes" in classed.columns:
        found = found.unionByName(classed.where(is_prologue(F.col("bytes"), F.col("architecture"))).select("binary_id", "address"))
    for more in (entries, exports):
        if more is not None:
            found = found.unionByName(more.where("address <> 0").select("binary_id", "address"))
    decoded = classed.select("binary_id", "address").distinct()
    return found.distinct().join(decoded, ["binary_id", "address"], "left_semi")


def members(classed: DataFrame, seeds_: DataFrame) -> DataFrame:
    """Instructions with ``function_address``: the last seed at or before them; those before any seed are left out."""
    marked = classed.join(seeds_.withColumn("_seed", F.lit(True)), ["binary_id", "address"], "left")
    w = Window.partitionBy("binary_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("function_address", F.last(F.when(F.col("_seed"), F.col("address")), ignorenulls=True).over(w)).where("function_address is not null").drop("_seed")


def functions(in_functions: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """One row a function: name, size, instruction count, block estimate, kind."""
    branch = F.col("is_call") | F.col("is_conditional") | F.col("is_unconditional")
    out = in_functions.groupBy("binary_id", F.col("function_address").alias("address")).agg(
        F.sum("length").cast("long").alias("size"),
        F.count("*").alias("n_instructions"),
        (F.lit(1) + F.count_if(branch)).cast("long").alias("block_estimate"),
        F.when((F.count("*") == 1) & F.bool_and("is_unconditional"), "tailcall_thunk").otherwise("normal").alias("kind"),
    )
    name = F.concat(F.lit("sub_"), u64.hex_text(F.col("address")))
    if exports is None:
        return out.withColumn("name", name).withColumn("is_export", F.lit(False))
    first = exports.where("address <> 0").groupBy("binary_id", "address").agg(F.min_by("name", F.when(F.col("name") != "", F.col("ord"))).alias("_name"))
    out = out.join(first.withColumn("is_export", F.lit(True)), ["binary_id", "address"], "left")
    return out.withColumn("name", F.coalesce(F.nullif("_name", F.lit("")), name)).withColumn("is_export", F.coalesce("is_export", F.lit(False))).drop("_name")


def cfg_summary(in_functions: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(F.col(c)).alias
    return in_functions.groupBy("binary_id").agg(count("is_call")("direct_calls"), count("is_conditional")("conditional_branches"), count("is_unconditional")("unconditional_branches"), count("is_return")("returns"))


def jump_tables(classed: DataFrame) -> DataFrame:
    o = F.col("operands")
    return classed.where((F.col("isa") == "x86") & F.col("is_unconditional") & F.col("target").isNull() & o.contains("[") & o.contains("]") & o.contains("*"))


def top_functions(functions_: DataFrame, k: int = 20) -> DataFrame:
    """The first k functions of each binary, in address order."""
    w = Window.partitionBy("binary_id").orderBy(u64.order_key(F.col("address")))
    return functions_.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def parameters(in_functions: DataFrame, format_: str) -> DataFrame:
    """Argument registers read before they are written in the first 32 instructions up to a call or return (x64)."""
    order = rules.ARGUMENT_REGISTERS[format_]
    w = Window.partitionBy("binary_id", "function_address").orderBy("seq")
    stop = F.max((F.col("is_call") | F.col("is_return")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = in_functions.withColumns({"_i": F.row_number().over(w), "_stop": stop}).where("_i <= 32 and _stop = 0")
    m = X.ascii_lower(F.col("mnemonic"))
    ops = F.filter(F.transform(F.split("operands", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("binary_id", "function_address", "_i", m.alias("m"), ops.alias("ops"))
    zeroed = (F.col("m") == "xor") & (F.size("ops") == 2) & (X.ascii_lower(F.get("ops", F.lit(0))) == X.ascii_lower(F.get("ops", F.lit(1))))
    moves = F.col("m").isin("mov", "movzx", "movsxd", "lea") & (F.size("ops") >= 2)
    writes = F.col("m").isin("mov", "movzx", "movsxd", "lea", "xor", "add", "sub", "and", "or", "imul")
    each = rows.select("binary_id", "function_address", "_i", zeroed.alias("z"), moves.alias("mv"), writes.alias("wr"), F.posexplode("ops").alias("k", "op"))
    word = F.regexp_extract(F.regexp_replace("op", "^((byte|word|dword|qword) ptr )+", ""), "[A-Za-z0-9_]+", 0)
    each = each.withColumn("reg", X.canonical_register(word)).where(F.col("reg").isin(*order))
    read = F.when(~F.col("z") & ~(F.col("mv") & (F.col("k") == 0)), F.col("_i"))
    write = F.when(F.col("wr") & (F.col("k") == 0), F.col("_i"))
    used = each.groupBy("binary_id", "function_address", "reg").agg(F.min(read).alias("r"), F.min(write).alias("w")).where("r is not null and (w is null or r <= w)")
    at = F.array_position(F.array(*map(F.lit, order)), F.col("reg"))
    return used.groupBy("binary_id", "function_address").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("k"), "reg"))), lambda x: x["reg"]), ",").alias("parameters"))

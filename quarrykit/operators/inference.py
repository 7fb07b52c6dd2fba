"""Code patterns over instruction text, and value types of single instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.functions import text as X
from quarrykit.functions import u64
from quarrykit.operators import instructions


def patterns(in_functions: DataFrame) -> DataFrame:
    """The patterns that each function's text holds, with the first match and the address of its first instruction."""
    said = F.struct("seq", instructions.text(F.col("mnemonic"), F.col("operands")).alias("t"))
    whole = in_functions.groupBy("binary_id", "function_address").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["t"]), "; ").alias("text"), F.min_by("address", "seq").alias("address"))
    found = [F.struct(F.lit(n).alias("pattern"), F.lit(c).cast("float").alias("confidence"), F.regexp_extract("text", p, 0).alias("match")) for n, p, c in rules.CODE_PATTERNS]
    return whole.select("binary_id", "function_address", "address", F.inline(F.array(*found))).where("match <> ''")


def instruction_patterns(rows: DataFrame) -> DataFrame:
    text = instructions.text(F.col("mnemonic"), F.col("operands"))
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(n).alias("pattern"), F.lit(c).cast("float").alias("confidence"))) for n, p, c in rules.CODE_PATTERNS]))
    return rows.select("binary_id", "address", text.alias("match"), F.inline(found))


def immediate(operands: Column) -> Column:
    """The first 0x number, or the whole text as a decimal one, as unsigned bits; else null."""
    digits = F.regexp_extract(operands, "0[xX]([0-9A-Fa-f]+)", 1)
    decimal = F.trim(operands).try_cast("decimal(20,0)")
    whole = F.when(F.trim(operands).rlike(r"^\+?[0-9]+$") & (decimal <= F.expr("cast(18446744073709551615 as decimal(20,0))")), u64.parse_hex(F.conv(F.regexp_replace(F.trim(operands), r"^\+", ""), 10, 16)))
    return F.when(digits != "", u64.parse_hex(digits)).otherwise(whole)


def value_type(isa: Column, mnemonic: Column, operands: Column) -> Column:
    """U8 to U64 of a moved immediate, Pointer(Void) of an address, else Unknown."""
    m, value = F.lower(mnemonic), immediate(operands)
    moves = F.when(isa == "x86", m == "mov").otherwise(m.isin("mov", "movz", "movk"))
    loads = F.when(isa == "x86", m.contains("lea") | m.contains("ptr")).otherwise(m.startswith("ldr"))
    size = F.when(value.between(0, 0xFF), "U8").when(value.between(0, 0xFFFF), "U16").when(value.between(0, 0xFFFFFFFF), "U32").otherwise("U64")
    return F.when(moves & value.isNotNull(), size).when(loads, "Pointer(Void)").otherwise("Unknown")


def _looked_up(kind: Column, k: int, other):
    out = F.when(F.lit(False), rules.C_TYPES[0][k])
    for row in rules.C_TYPES:
        out = out.when(kind == row[0], row[k])
    return out.otherwise(other)


def c_type(kind: Column) -> Column:
    """C name of a type; arrays are ``Array(I8,n)``."""
    element = F.regexp_extract(kind, r"^Array\((\w+),", 1)
    array = F.when(element == "I8", "char[]").when(element == "U8", "unsigned char[]").otherwise("void[]")
    return F.when(kind.startswith("Array("), array).otherwise(_looked_up(kind, 1, "void*"))


def c_size(kind: Column) -> Column:
    element, n = F.regexp_extract(kind, r"^Array\((\w+),", 1), F.regexp_extract(kind, r",(\d+)\)$", 1).try_cast("int")
    return F.when(kind.startswith("Array("), _looked_up(element, 2, 8) * n).otherwise(_looked_up(kind, 2, 8))


def is_integer(kind: Column) -> Column:
    return kind.rlike("^[IU](8|16|32|64)$")


def is_pointer(kind: Column) -> Column:
    return kind.startswith("Pointer(") | (kind == "Unknown")

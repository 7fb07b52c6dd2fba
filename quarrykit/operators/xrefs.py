"""References: calls, tail calls, imports, strings, and what is grouped from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import text as X
from quarrykit.functions import u64


def _resolved(rows: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds target_address, target_kind, target_name; rows without any address go."""
    at = F.coalesce("target", X.memory_target(F.col("operands"), F.col("address"), F.col("length")))
    rows = rows.withColumn("target_address", at).where("target_address is not null")
    # of imports at one address the last counts
    known = imports.groupBy("binary_id", F.col("address").alias("target_address")).agg(F.max_by(F.concat("library", F.lit("!"), "function"), "ord").alias("_import"))
    named = functions.select("binary_id", F.col("address").alias("target_address"), F.col("name").alias("_function")).dropDuplicates(["binary_id", "target_address"])
    out = rows.join(known, ["binary_id", "target_address"], "left").join(named, ["binary_id", "target_address"], "left")
    return out.withColumns({"target_kind": F.when(F.col("_import").isNotNull(), "import").otherwise("function"), "target_name": F.coalesce("_import", "_function")}).drop("_import", "_function")


def calls(in_functions: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    return _resolved(in_functions.where("is_call"), imports, functions).select("binary_id", "function_address", F.col("address").alias("site"), "target_address", "target_kind", "target_name")


def tail_calls(in_functions: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """Every unconditional jump whose address is known, those inside a function too."""
    return _resolved(in_functions.where("is_unconditional"), imports, functions).select("binary_id", "function_address", F.col("address").alias("site"), "target_address", "target_kind", "target_name")


def call_graph(calls_: DataFrame) -> DataFrame:
    """An edge a (caller, callee) with its number of calls and its sites in order."""
    return calls_.groupBy("binary_id", "function_address", "target_address").agg(
        F.count("*").alias("n_calls"),
        F.transform(F.sort_array(F.collect_list(F.struct(u64.order_key(F.col("site")).alias("k"), "site"))), lambda x: x["site"]).alias("call_sites"),
        F.min_by("target_name", u64.order_key(F.col("site"))).alias("target_name"),
    )


def string_refs(in_functions: DataFrame, strings: DataFrame) -> DataFrame:
    """Hex tokens of an instruction's text that are string addresses, each once an instruction, in the order of tokens."""
    whole = F.concat_ws(" ", "mnemonic", "operands")
    rows = in_functions.select("binary_id", "function_address", F.col("address").alias("site"), F.posexplode(X.hex_tokens(whole)).alias("pos", "string_address"))
    rows = rows.groupBy("binary_id", "function_address", "site", "string_address").agg(F.min("pos").alias("pos"))
    # of strings at one address (an ASCII and a UTF-16 one, say) the least counts
    known = strings.groupBy("binary_id", F.col("address").alias("string_address")).agg(F.min("value").alias("value"))
    return rows.join(known, ["binary_id", "string_address"]).withColumn("symbol", X.string_symbol(F.col("string_address")))


def strings_by_function(refs: DataFrame) -> DataFrame:
    return refs.groupBy("binary_id", "function_address").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"), F.count("*").alias("n_refs"))


def _in_order() -> Column:
    """Callers by function and site, as unsigned addresses."""
    keyed = F.struct(u64.order_key(F.col("function_address")).alias("f"), u64.order_key(F.col("site")).alias("s"), "function_address", "site")
    return F.transform(F.sort_array(F.collect_list(keyed)), lambda x: F.struct(x["function_address"].alias("function_address"), x["site"].alias("site")))


def import_callers(calls_: DataFrame) -> DataFrame:
    """Callers of each import by lower-cased library and symbol, ordered by function and site."""
    lib, fn = F.substring_index("target_name", "!", 1), F.substring_index("target_name", "!", -1)
    rows = calls_.where("target_kind = 'import'").select("binary_id", X.ascii_lower(lib).alias("lib_key"), X.ascii_lower(fn).alias("fn_key"), "function_address", "site")
    return rows.groupBy("binary_id", "lib_key", "fn_key").agg(_in_order().alias("callers"))


def import_xrefs(imports: DataFrame, callers: DataFrame, insights: DataFrame) -> DataFrame:
    """Every imported function with its address, category and callers (an empty array for none)."""
    keyed = imports.withColumns({"lib_key": X.ascii_lower(F.col("library")), "fn_key": X.ascii_lower(F.col("function"))})
    told = insights.select("binary_id", F.col("lib_key"), F.col("fn_key"), "category", "severity").dropDuplicates(["binary_id", "lib_key", "fn_key"])
    out = keyed.join(told, ["binary_id", "lib_key", "fn_key"], "left").join(callers, ["binary_id", "lib_key", "fn_key"], "left")
    return out.withColumn("callers", F.coalesce("callers", F.array().cast("array<struct<function_address:bigint,site:bigint>>")))


def function_xrefs(functions: DataFrame, calls_: DataFrame, refs: DataFrame) -> DataFrame:
    """Functions with who calls them and their strings."""
    by = calls_.groupBy("binary_id", F.col("target_address").alias("address")).agg(_in_order().alias("called_by"))
    has = strings_by_function(refs).select("binary_id", F.col("function_address").alias("address"), "symbols")
    out = functions.join(by, ["binary_id", "address"], "left").join(has, ["binary_id", "address"], "left")
    return out.withColumns({"called_by": F.coalesce("called_by", F.array().cast("array<struct<function_address:bigint,site:bigint>>")), "symbols": F.coalesce("symbols", F.array().cast("array<string>"))})


#: Block sizes of the range join, as bits; a section is put on the first level where it covers 17 blocks at most.
LEVELS = tuple(range(12, 64, 4))


def section_of(addresses: DataFrame, sections: DataFrame) -> DataFrame:
    """The first section that holds each address (va <= address < va + max(size, 1), unsigned; what would pass the end of the
    address space ends there): a range join as an equi-join on address blocks. The size of blocks follows the size of a section, so a section
    of any size is a few rows, an address is one row a level, and it never is a cross join; ``section_ord`` breaks ties."""
    va, key = F.col("virtual_address"), u64.order_key
    last = F.when(F.col("size") >= 0, u64.wrapping_add(va, F.greatest(F.col("size"), F.lit(1)) - 1)).otherwise(F.lit(-1))
    spans = sections.select("binary_id", "section_ord", "name", "virtual_address", "size", F.when(key(last) >= key(va), last).otherwise(F.lit(-1)).alias("_last"))
    level = F.lit(LEVELS[-1])
    for bits in reversed(LEVELS[:-1]):
        level = F.when((F.col("size") >= 0) & (F.shiftrightunsigned("size", bits) < 16), bits).otherwise(level)
    spans = spans.withColumn("_level", level)
    block = lambda at: F.expr(f"shiftrightunsigned({at}, _level)")
    spans = spans.withColumn("_block", F.explode(F.sequence(block("virtual_address"), block("_last"))))
    rows = addresses.withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("_block", block("address"))
    hit = rows.join(spans, ["binary_id", "_level", "_block"]).where((key(F.col("address")) >= key(va)) & (key(F.col("address")) <= key(F.col("_last"))))
    return hit.groupBy("binary_id", "address").agg(F.min_by("name", "section_ord").alias("section"))

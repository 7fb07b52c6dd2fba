"""Queries of operators that need rows of their own making: references to strings, tail calls, runtimes, ARM streams, operand
and C text. Rows are made of the provided tables, so that their SQL can make them too."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.functions import text as X
from quarrykit.operators import behavior, cfg, instructions, runtime, strings, xrefs
from quarrykit.plans import adapters as A
from quarrykit.plans import decompile
from quarrykit.sources import binaries

#: Where the strings of a user's stream begin.
STRINGS_AT = 4096


def _entries(rows):
    return rows.groupBy("binary_id").agg(F.min_by("address", "seq").alias("address"))


def _members(rows, exports=None):
    classed = instructions.classes(rows)
    return instructions.members(classed, instructions.seeds(classed, _entries(rows), exports))


def _no_imports(s):
    return s.createDataFrame([], "binary_id long, library string, function string, address long, ord long")


def _k(s, d):
    return A.table(s, d, "events").select((F.col("event_id") * 16).alias("address"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def _naming(s, d):
    """Streams whose moves name an address: ..h and 0x.., which count, and bare digits and ..hh, which don't."""
    rows = A.instructions(s, d).join(_k(s, d), "address")
    at, form = F.hex(F.col("k") * 16 + STRINGS_AT), F.col("k") % 4
    named = F.when(form == 0, F.concat(F.lit("rcx,["), at, F.lit("h]"))).when(form == 1, F.concat(F.lit("rcx,0x"), at)).when(form == 2, F.concat(F.lit("rcx,[rbp+"), at, F.lit("]"))).otherwise(F.concat(F.lit("rcx,"), at, F.lit("hh")))
    return rows.withColumn("operands", F.when(F.col("mnemonic") == "mov", named).otherwise("")).drop("k")


def _named(s, d):
    """A string of a user for each k of its events but every third."""
    k = F.get_json_object("props", "$.k").cast("long")
    return A.table(s, d, "events").select(F.col("user_id").alias("binary_id"), k.alias("k")).where("k % 3 <> 0").distinct().select("binary_id", (F.col("k") * 16 + STRINGS_AT).alias("address"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("value"))


def _refs(s, d):
    return xrefs.string_refs(_members(_naming(s, d)), _named(s, d))


def string_xrefs(s, d):
    return _refs(s, d).select("binary_id", "function_address", "site", "string_address", "symbol", "value")


def strings_by_function(s, d):
    return xrefs.strings_by_function(_refs(s, d)).select("binary_id", "function_address", F.array_join("symbols", ",").alias("symbols"), "n_refs")


def _jumping(s, d):
    """Every second call as a jump."""
    return A.instructions(s, d).withColumn("mnemonic", F.when((F.col("mnemonic") == "call") & (F.col("seq") % 2 == 0), "jmp").otherwise(F.col("mnemonic")))


def tail_calls(s, d):
    m = _members(_jumping(s, d))
    return xrefs.tail_calls(m, _no_imports(s), instructions.functions(m))


def block_estimate(s, d):
    return instructions.functions(_members(_jumping(s, d))).select("binary_id", "address", "block_estimate")


def jump_tables(s, d):
    """Jumps through a scaled table, plain indirect jumps and jumps to an address."""
    at = F.hex(F.col("address"))
    pick = F.col("seq") % 6
    operands = F.when(pick == 0, F.concat(F.lit("qword ptr [rax*8+"), at, F.lit("h]"))).when(pick == 2, "qword ptr [rcx]").otherwise(F.concat(at, F.lit("h")))
    rows = _jumping(s, d).withColumn("target", F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("target"))).withColumn("operands", operands)
    return instructions.jump_tables(instructions.classes(rows)).select("binary_id", "address", "operands")


def export_names(s, d):
    """Functions named by exports: every third event is one, some without a name, some twice."""
    e = A.table(s, d, "events").where("event_id % 3 = 0").select(F.col("user_id").alias("binary_id"), (F.col("event_id") * 16).alias("address"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("f"), F.col("event_id").cast("string"))).otherwise("").alias("name"))
    e = e.unionByName(e.where("ord % 4 = 0").withColumns({"ord": F.col("ord") - 1, "name": F.concat(F.lit("early_"), "name")}))
    return instructions.functions(_members(A.instructions(s, d), e), e).select("binary_id", "address", "name", "is_export", "n_instructions")


ARM = ("b.eq", "bne", "cbz", "bl", "ret", "b", "ldr", "b.xy", "blx", "tbnz", "eret", "bx")


def _arm(s, d):
    """Users' streams as ARM: branches name their target in the operands, in hex or as a decimal."""
    rows = A.instructions(s, d).join(_k(s, d), "address")
    name = F.get(F.array(*map(F.lit, ARM)), (F.col("k") % len(ARM)).cast("int"))
    to = F.col("k") % 50 * 16 + F.col("address") - F.col("address") % 800
    form = F.col("seq") % 4
    operands = F.when(form == 0, F.concat(F.lit("0x"), F.lower(F.hex(to)))).when(form == 1, F.concat(F.lit("x0, #3, 0x"), F.hex(to))).when(form == 2, to.cast("string")).otherwise("x30")
    return instructions.classes(rows.select("binary_id", "seq", F.lit("arm").alias("isa"), "address", F.lit(4).alias("length"), name.alias("mnemonic"), operands.alias("operands"), F.lit(None).cast("long").alias("target")))


def arm_classes(s, d):
    return _arm(s, d).groupBy("mnemonic").agg(*[F.count_if(F.col(c)).alias(c) for c in ("is_call", "is_return", "is_conditional", "is_unconditional", "is_control_flow")])


def arm_blocks(s, d):
    return cfg.blocks(_arm(s, d))


def arm_edges(s, d):
    return cfg.edges(_arm(s, d))


def runtime_confidence(s, d):
    probes = s.createDataFrame([(k % 5, v) for k, v in enumerate(A.RUNTIME_PROBES)], "binary_id long, value string")
    none = s.createDataFrame([], "binary_id long, section_ord int, name string, raw binary")
    libs = A.table(s, d, "part").select(F.col("p_partkey").alias("binary_id"), F.get(F.array(*map(F.lit, A.RUNTIME_LIBRARIES)), (F.col("p_partkey") % len(A.RUNTIME_LIBRARIES)).cast("int")).alias("library"), F.lit("f").alias("function"))
    return runtime.detect(probes, none, libs).select("binary_id", "family", "confidence", F.size("evidence").alias("n_evidence"))


def finding_ranks(s, d):
    from quarrykit import queries

    return behavior.ranked(queries._findings(s, d)).select("binary_id", "source", "category", "severity", "detail", "place")


def string_symbols(s, d):
    at = (F.col("l_orderkey") * (1 << 36) + F.col("l_partkey")) * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.string_symbol(at).alias("symbol"))


def stack_slots(s, d):
    line = A.table(s, d, "lineitem")
    base = F.get(F.array(*map(F.lit, ("rbp", "EBP", "bp", "rsp", "ESP", "sp", "rax"))), (F.col("l_linenumber") - 1).cast("int"))
    return line.select("l_orderkey", "l_linenumber", X.stack_name(base, (F.col("l_partkey") - F.col("l_suppkey") * 20).cast("long")).alias("slot"))


def integer_literals(s, d):
    line = A.table(s, d, "lineitem")
    n, form = F.col("l_partkey") * F.col("l_suppkey"), F.col("l_linenumber")
    text = F.when(form == 1, n.cast("string")).when(form == 2, F.concat(F.lit("-"), n.cast("string"))).when(form == 3, F.concat(F.lit("0x"), F.hex(n))).when(form == 4, F.concat(F.lit(" -0X"), F.lower(F.hex(n)))).when(form == 5, F.concat(F.hex(n), F.lit("h"))).when(form == 6, F.concat(F.hex(n), F.lit("hh"))).otherwise("rax")
    return line.select("l_orderkey", "l_linenumber", X.integer_literal(text).alias("value"))


def comment_sanitize(s, d):
    return A.table(s, d, "pages").select("page_id", F.md5(X.c_comment(F.replace("html", F.lit("<"), F.lit("*/"))).cast("binary")).alias("comment_md5"))


def contains_any_case(s, d):
    return A.table(s, d, "documents").select("doc_id", X.contains_ignoring_case(F.coalesce("text", F.lit("")), "The").alias("has_the"), X.contains_ignoring_case(F.coalesce("text", F.lit("")), "EN").alias("has_en"))


def format_names(s, d):
    """What the first bytes say: heads of every format, and texts that have none."""
    heads = ("4D5A", "7F454C46", "CEFAEDFE", "CFFAEDFE", "FEEDFACE", "FEEDFACF", "CAFEBABE", "7F454C", "4D", "")
    head = F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("doc_id") % len(heads)).cast("int")))
    return A.table(s, d, "documents").select("doc_id", binaries.sniff(F.concat(head, F.coalesce("text", F.lit("")).cast("binary"))).alias("format"))


def prologues(s, d):
    """Bytes that begin a function, by architecture, beside bytes that don't."""
    starts = [(a, p) for a, ps in rules.PROLOGUES.items() for p in ps]
    bytes_ = F.get(F.array(*[F.lit(p) for _, p in starts]), (F.col("event_id") % len(starts)).cast("int"))
    arch = F.get(F.array(*map(F.lit, rules.PROLOGUES)), (F.col("user_id") % len(rules.PROLOGUES)).cast("int"))
    return A.table(s, d, "events").select("event_id", instructions.is_prologue(F.unhex(F.concat(bytes_, F.lit("9090"))), arch).alias("is_prologue"))


def artifact_files(s, d):
    """Names of artifact files: repeats in a binary are numbered."""
    rows = A.table(s, d, "part").select(F.col("p_size").alias("binary_id"), F.col("p_partkey").alias("ord"), "p_type")
    return runtime.unique_files(rows, F.substring_index("p_type", " ", 2), "pyc").select("binary_id", "ord", "file_name")


def import_declarations(s, d):
    """C names of imports, unique in a binary."""
    rows = A.imports(s, d).select("binary_id", "library", "function", "address", "ord")
    return decompile.import_declarations(rows).select("binary_id", "ord", "function", "address", "c_name")


NAMES = (
    string_xrefs, strings_by_function, tail_calls, block_estimate, jump_tables, export_names, arm_classes, arm_blocks, arm_edges, runtime_confidence, finding_ranks, string_symbols, stack_slots,
    integer_literals, comment_sanitize, contains_any_case, format_names, prologues, artifact_files, import_declarations,
)
QUERIES = {f.__name__: f for f in NAMES}

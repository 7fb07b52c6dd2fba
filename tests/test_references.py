"""Addresses in operands, ARM control flow, hostile sections, names and orders."""

import pytest
from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.functions import text as X
from quarrykit.operators import cfg, instructions, strings, xrefs
from quarrykit.plans import decompile
from tests.test_operators import INSTRUCTION, SECTION, one, stream


@pytest.mark.parametrize(
    "text,found",
    [
        ("[0x401000], 401000h zz 1", [0x401000, 0x401000]), ("add rax,18", []), ("[rbx+18]", []), ("18hh", []), ("0x", []), ("h", []), ("0X1f, 1FH", [31, 31]), ("0x10h", []),
        ("1FFFFFFFFFFFFFFFFh", []), ("0FFFFFFFFFFFFFFFFh", [-1]), ("", []), ("dead beefh", [0xBEEF]),
    ],
)
def test_hex_tokens_need_a_prefix_or_one_suffix(spark, text, found):
    assert one(spark, X.hex_tokens(F.lit(text))) == found


def test_bare_digits_name_no_target_and_no_string(spark):
    assert one(spark, X.memory_target(F.lit("qword ptr [rbx+18]"), F.lit(0x1000), F.lit(6))) is None
    rows = stream(spark, [(0x1000, 4, "add", "rax,18", None), (0x1004, 4, "mov", "rax,18h", None)]).withColumn("function_address", F.lit(0x1000))
    known = spark.createDataFrame([("b", 0x18, "b"), ("b", 0x18, "a"), ("b", 0xADD, "x")], "binary_id string, address long, value string")
    assert [(r.site, r.string_address, r.value) for r in xrefs.string_refs(rows, known).collect()] == [(0x1004, 0x18, "a")]


def arm(spark, rows):
    return instructions.classes(spark.createDataFrame([("b", k, "arm", 0x1000 + 4 * k, 4, m, o, None) for k, (m, o) in enumerate(rows)], INSTRUCTION))


def test_arm_targets_come_from_operands(spark):
    rows = arm(spark, [("cbz", "x0, 0x1008"), ("nop", ""), ("b", "4096"), ("tbnz", "w1, #3, 0x1004"), ("b.xx", "0h1000"), ("bx", "lr"), ("ret", "")])
    edges = {(r.src_block, r.dst_block, r.edge_type) for r in cfg.edges(rows).collect()}
    assert edges == {(0, 2, "BranchTrue"), (0, 1, "BranchFalse"), (1, 2, "FallThrough"), (2, 0, "Unconditional"), (3, 1, "BranchTrue"), (3, 4, "BranchFalse"), (4, 0, "BranchTrue"), (4, 5, "BranchFalse")}
    assert [r.is_conditional for r in rows.orderBy("seq").collect()] == [True, False, False, True, True, False, False]


def test_every_keyword_is_escaped(spark):
    words = rules.C_KEYWORDS.split()
    assert len(words) == len(set(words)) == 55
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.identifier(F.col("w"), "sym").alias("x")).collect()
    assert all(r.x == decompile.identifier(r.w, "sym") == (f"sym_{r.w.lstrip('_')}_" if r.w.startswith("_") else f"{r.w}_") for r in got)


def test_sections_of_any_size_and_place(spark):
    low, top = -(1 << 63), (1 << 63) - 1
    rows = [(0, "small", 0x1000, 0x10), (1, "empty", 0x3000, 0), (2, "huge", 0x10000, 1 << 62), (3, "past", -0x1000, top), (4, "wide", 0x2000, 64 << 30), (5, "unsigned", 0x7000000000000000, low + 5)]
    sections = spark.createDataFrame([("b", *r) for r in rows], "binary_id string, section_ord int, name string, virtual_address long, size long")
    at = {0x1000: "small", 0x100F: "small", 0x1010: None, 0x3000: "empty", 0x3001: "wide", 0x10000: "huge", (1 << 62) + 0xFFFF: "huge", (1 << 62) + 0x10000: None, -0x1000: "past", -1: "past", 0x7000000000000000: "unsigned", low: "unsigned", 0: None, 5: None}
    got = {r.address: r.section for r in xrefs.section_of(spark.createDataFrame([("b", a) for a in at], "binary_id string, address long"), sections).collect()}
    assert got == {a: s for a, s in at.items() if s}


def test_string_addresses_wrap(spark):
    raw = bytearray(b"\0\0word\0w\0i\0d\0e\0\0\0")
    rows = spark.createDataFrame([("b", 0, ".data", (1 << 63) - 1, len(raw), raw, True)], SECTION)
    assert {(r.value, r.address) for r in strings.extract(rows).collect()} >= {("word", (1 << 63) + 1 - (1 << 64))}


def test_callers_are_in_unsigned_order(spark):
    calls = spark.createDataFrame([("b", -8, -4, 1, "import", "L!f"), ("b", 16, 20, 1, "import", "l!F")], "binary_id string, function_address long, site long, target_address long, target_kind string, target_name string")
    assert [tuple(x) for x in xrefs.import_callers(calls).first().callers] == [(16, 20), (-8, -4)]


def test_import_declarations_are_unique_in_a_binary(spark):
    rows = spark.createDataFrame([("a", "f", 1, 0), ("a", "f", 2, 1), ("a", "f_2", 3, 2), ("a", "", 255, 3), ("a", "int", 4, 4), ("b", "f", 1, 0), ("b", None, None, 1)], "binary_id string, function string, address long, ord long")
    got = {(r.binary_id, r.ord): r.c_name for r in decompile.import_declarations(rows).collect()}
    assert got == {("a", 0): "f", ("a", 1): "f_2", ("a", 2): "f_2_2", ("a", 3): "import_FF", ("a", 4): "int_", ("b", 0): "f", ("b", 1): "import_0"}

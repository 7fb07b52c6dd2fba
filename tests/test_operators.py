"""Operators over hand-written rows."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from quarrykit import queries
from quarrykit.functions import text as X
from quarrykit.functions import u64
from quarrykit.operators import behavior, cfg, instructions, runtime, strings, xrefs
from quarrykit.sources import binaries

SECTION = "binary_id string, section_ord int, name string, virtual_address long, size long, raw binary, is_data boolean"
INSTRUCTION = "binary_id string, seq long, isa string, address long, length int, mnemonic string, operands string, target long"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def section(spark, raw, va=0x1000):
    return spark.createDataFrame([("b", 0, ".data", va, len(raw), bytearray(raw), True)], SECTION)


def stream(spark, rows):
    return instructions.classes(spark.createDataFrame([("b", k, "x86", a, n, m, o, t) for k, (a, n, m, o, t) in enumerate(rows)], INSTRUCTION))


@pytest.mark.parametrize(
    "raw,va,found",
    [
        (b"hello\0\xff\xff", 0x1000, [("hello", 0x1000)]),
        (b"hi\0world\0", 0x1000, [("world", 0x1003)]),
        (b"test\0test\0test\0", 0x1000, [("test", 0x1000)]),
        (b"abc\x01def\0", 0x1000, []),
        (b"\0\0hello\0", 0x400000, [("hello", 0x400002)]),
        (b"unterminated", 0, []),
        (b"T\0e\0s\0t\0\0\0", 0x2000, [("Test", 0x2000)]),
    ],
)
def test_string_scan(spark, raw, va, found):
    got = strings.extract(section(spark, raw, va)).orderBy("address").collect()
    assert [(r.value, r.address) for r in got] == found


def test_ascii_scan_equals_a_sequential_scan(spark):
    rng = random.Random(3)
    raw = bytes(rng.choice(b"\0\0ab c\x01\xffde") for _ in range(5000))
    expected, run = [], []
    for at, byte in enumerate(raw):
        if 0x20 <= byte <= 0x7E:
            run.append(at)
        else:
            if byte == 0 and 4 <= len(run) <= 1024:
                expected.append((run[0], raw[run[0] : at].decode()))
            run = []
    got = strings.scan_ascii(section(spark, raw, 0)).orderBy("address").collect()
    assert [(r.address, r.value) for r in got] == expected


@pytest.mark.parametrize(
    "value,category",
    [("HTTP://x", "url"), ("powershell -nop", "command"), ("my_Passwd", "credential_hint"), ("Kernel32.DLL", "platform_indicator"), ("HKLM\\Software\\x", "platform_indicator"), ("plain", None)],
)
def test_suspicious_category(spark, value, category):
    assert one(spark, X.suspicious_category(F.lit(value))) == category


@pytest.mark.parametrize(
    "value,signal",
    [
        ("SGVsbG8sIHdvcmxkIQ==", "base64"), ("4D5A90000300000004000000FFFF0000", "hex"), ("https%3A%2F%2Fevil.test%2Fpayload", "url_percent_encoding"), ("\\x48\\x65", "escaped_hex"),
        ("kernel32.dll", None), ("https://example.test", None), ("CreateFileW", None), ("1234567890123456", None), ("GetModuleHandleW", "base64"), ("", None),
    ],
)
def test_recipe_signal(spark, value, signal):
    assert one(spark, X.recipe_signal(F.lit(value))) == signal


def test_deep_link_encodes_the_value_twice(spark):
    confidence, reason, recipe = X.recipe_details(F.lit("SGVsbG8sIHdvcmxkIQ=="), F.lit("base64"))
    assert one(spark, X.deep_link(F.lit("SGVsbG8sIHdvcmxkIQ=="), recipe)).endswith("&input=U0dWc2JHOHNJSGR2Y214a0lRPT0%3D")
    assert one(spark, confidence) == 85


def test_hex_tokens_and_targets(spark):
    assert one(spark, X.hex_tokens(F.lit("[0x401000], 401000h zz 1"))) == [0x401000, 0x401000]
    target = X.memory_target(F.lit("qword ptr [rip+1FFAh]"), F.lit(0x1000), F.lit(6))
    assert one(spark, target) == 0x3000
    assert one(spark, X.memory_target(F.lit("[3000h]"), F.lit(0x1000), F.lit(6))) == 0x3000
    assert one(spark, X.memory_target(F.lit("rax"), F.lit(0x1000), F.lit(6))) is None


def test_unsigned_addresses(spark):
    assert one(spark, u64.wrapping_add(F.lit(-1), F.lit(2))) == 1
    assert one(spark, u64.parse_hex(F.lit("FFFFFFFFFFFFFFFF"))) == -1
    assert one(spark, u64.parse_hex(F.lit("1FFFFFFFFFFFFFFFF"))) is None


@pytest.mark.parametrize("text,name", [("a!b", "a_b"), ("int", "int_"), ("9x", "sym_9x"), ("_x", "sym_x"), ("", "sym"), ("  a--b  ", "a_b"), ("a_-b", "a_b")])
def test_identifier(spark, text, name):
    assert one(spark, X.identifier(F.lit(text), "sym")) == name


def test_c_escape(spark):
    assert one(spark, X.c_quote(F.lit('a"\\\n\té\0'))) == '"a\\"\\\\\\n\\t\\303\\251\\000"'


def test_stack_names_and_literals(spark):
    assert [one(spark, X.stack_name(F.lit(b), F.lit(d))) for b, d in (("rbp", -8), ("ebp", 16), ("rsp", -4), ("esp", 32), ("rax", 1))] == ["local_8", "arg_10", "stack_m_4", "stack_20", None]
    assert [one(spark, X.integer_literal(F.lit(t))) for t in ("-5", "0x10", "20h", "x")] == [-5, 16, 32, None]


def test_cfg_shapes(spark):
    linear = stream(spark, [(0x1000, 1, "nop", "", None), (0x1001, 1, "nop", "", None), (0x1002, 1, "ret", "", None)])
    assert cfg.blocks(linear).count() == 1 and cfg.edges(linear).count() == 0
    branch = stream(spark, [(0x1000, 2, "jne", "1010h", 0x1010), (0x1002, 1, "nop", "", None), (0x1003, 1, "ret", "", None), (0x1010, 1, "ret", "", None)])
    assert cfg.blocks(branch).count() == 3
    assert {r.edge_type for r in cfg.edges(branch).collect()} == {"BranchTrue", "BranchFalse"}
    call = stream(spark, [(0x1000, 5, "call", "1010h", 0x1010), (0x1005, 1, "ret", "", None), (0x1010, 1, "ret", "", None)])
    assert sorted(r.edge_type for r in cfg.edges(call).collect()) == ["Call", "FallThrough"]


def test_functions_and_thunks(spark):
    rows = stream(spark, [(0x1000, 5, "call", "2000h", 0x2000), (0x1005, 1, "ret", "", None), (0x2000, 5, "jmp", "1000h", 0x1000)])
    entries = spark.createDataFrame([("b", 0x1000)], "binary_id string, address long")
    seeds = instructions.seeds(rows, entries)
    got = {r.address: r for r in instructions.functions(instructions.members(rows, seeds)).collect()}
    assert {a: (r.size, r.kind, r.name) for a, r in got.items()} == {0x1000: (6, "normal", "sub_1000"), 0x2000: (5, "tailcall_thunk", "sub_2000")}


def test_arm_classes(spark):
    rows = [("b", k, "arm64", k * 4, 4, m, "", None) for k, m in enumerate(["bic", "b.eq", "beq", "cbz", "bl", "ret", "b"])]
    got = instructions.classes(spark.createDataFrame(rows, INSTRUCTION)).orderBy("seq").collect()
    assert [(r.is_conditional, r.is_call, r.is_control_flow) for r in got] == [(False, False, False), (True, False, True), (True, False, False), (True, False, True), (False, True, True), (False, False, True), (False, False, True)]


def test_parameters_in_abi_order(spark):
    rows = stream(spark, [(0, 3, "mov", "rax,r8", None), (3, 3, "mov", "rbx,rdx", None), (6, 3, "mov", "r9,1", None), (9, 3, "add", "rax,r9", None), (12, 3, "mov", "rsi,ecx", None), (15, 1, "ret", "", None), (16, 3, "mov", "rax,r9", None)])
    got = instructions.parameters(rows.withColumn("function_address", F.lit(0)), "PE/EXE").first()
    assert got.parameters == "rcx,rdx,r8"


def test_calls_resolve_imports_first(spark):
    rows = stream(spark, [(0x1000, 6, "call", "qword ptr [rip+1FFAh]", None), (0x1006, 5, "call", "2000h", 0x2000)]).withColumn("function_address", F.lit(0x1000))
    imports = spark.createDataFrame([("b", "lib", "fn", 0x3000, 0)], "binary_id string, library string, function string, address long, ord long")
    functions = spark.createDataFrame([("b", 0x2000, "sub_2000")], "binary_id string, address long, name string")
    got = {r.site: (r.target_kind, r.target_name) for r in xrefs.calls(rows, imports, functions).collect()}
    assert got == {0x1000: ("import", "lib!fn"), 0x1006: ("function", "sub_2000")}
    refs = xrefs.string_refs(stream(spark, [(0x1000, 7, "lea", "rcx, [3000h]", None)]).withColumn("function_address", F.lit(0x1000)), spark.createDataFrame([("b", 0x3000, "hello")], "binary_id string, address long, value string"))
    assert [(r.symbol, r.value) for r in refs.collect()] == [("str_3000", "hello")]


def test_behaviour_score(spark):
    names = ["CreateFileW", "VirtualAlloc", "WriteProcessMemory", "CreateRemoteThread", "InternetOpenUrlW", "SendMessageW", "OpenProcessToken"]
    imports = spark.createDataFrame([("b", "k", n, k, k) for k, n in enumerate(names)], "binary_id string, library string, function string, address long, ord long")
    insights = behavior.api_insights(imports)
    assert insights.count() == 5
    found = strings.suspicious(spark.createDataFrame([("b", 0, 1, "http://x", "Ascii", 8), ("b", 0, 2, "powershell -nop", "Ascii", 15)], "binary_id string, section_ord int, address long, value string, encoding string, length long"))
    got = behavior.risk(behavior.findings(insights, found)).first()
    assert got.level == "high" and got.score >= 60
    top = {r.category: r.severity for r in behavior.categories(behavior.findings(insights, found)).collect()}
    assert top["process_injection"] == "high" and top["network"] == "medium"


def test_runtime_families(spark):
    strings_ = spark.createDataFrame([("p", "PYZ-00.pyz"), ("p", "__nuitka"), ("w", "#~")], "binary_id string, value string")
    sections_ = spark.createDataFrame([("g", 0, ".gopclntab", bytearray(b"x go build id: y"))], "binary_id string, section_ord int, name string, raw binary")
    imports = spark.createDataFrame([("d", "mscoree.dll", "_CorExeMain")], "binary_id string, library string, function string")
    got = {(r.binary_id, r.family): (r.confidence, r.evidence) for r in runtime.detect(strings_, sections_, imports).collect()}
    assert got[("p", "python_packaged")] == (90, ["PyInstaller PYZ archive", "Nuitka marker", "Nuitka marker"])
    assert got[("g", "go")] == (75, ["Go pclntab section (.gopclntab)", "Go build id"])
    assert got[("d", "dotnet_clr")][0] == 75
    assert not any(b == "w" for b, _ in got)


def test_carving(spark):
    pyc = b"\xa7\r\r\n" + b"\0" * 12 + b"\xe3" + b"code"
    raw = b"noise" + b"\x00" + pyc + b"MEI\x0c\x0b\x0a\x0b\x0e"
    rows = section(spark, raw, 0x4000)
    assert [(r.virtual_address, r.size) for r in runtime.carve_pyc(rows).collect()] == [(0x4006, len(raw) - 6)]
    assert [r.virtual_address for r in runtime.archive_cookies(rows).collect()] == [0x4000 + len(raw) - 8]


def elf(text=b"\x90\xc3"):
    names = b"\0.text\0.shstrtab\0"
    head = b"\x7fELF\x02\x01\x01" + b"\0" * 9
    body, strings_at = 64, 64 + len(text)
    table = strings_at + len(names)
    head += struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0x401000, 0, table, 0, 64, 0, 0, 64, 3, 2)
    row = lambda name, kind, flags, va, at, n: struct.pack("<IIQQQQIIQQ", name, kind, flags, va, at, n, 0, 0, 0, 0)
    return head + text + names + row(0, 0, 0, 0, 0, 0) + row(1, 1, 6, 0x401000, body, len(text)) + row(7, 3, 0, 0, strings_at, len(names))


def test_images(spark, tmp_path):
    (tmp_path / "a.so").write_bytes(elf())
    (tmp_path / "bad.exe").write_bytes(b"MZ")
    (tmp_path / "x.bin").write_bytes(b"none")
    images = binaries.parsed(binaries.read(spark, str(tmp_path))).cache()
    good = images.where("format = 'ELF'").first()
    assert (good.architecture, good.entry_point) == ("x64", 0x401000)
    code = binaries.sections(images).where("is_code").first()
    assert (code.name, code.virtual_address, bytes(code.raw)) == (".text", 0x401000, b"\x90\xc3")
    assert binaries.errors(images).count() == 2


@pytest.mark.parametrize("head,name", [("4D5A9000", "PE/EXE"), ("7F454C4602", "ELF"), ("CEFAEDFE", "Mach-O"), ("CFFAEDFE", "Mach-O"), ("CAFEBABE", "Mach-O"), ("", None), ("00", None), ("00000000", None)])
def test_sniff(spark, head, name):
    assert one(spark, binaries.sniff(F.unhex(F.lit(head)))) == name


def test_streaming_ingest(spark, tmp_path):
    from quarrykit.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.so").write_bytes(elf())
    ingest.to_parquet(ingest.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().format == "ELF"


def test_runtime_reports(spark):
    strings_ = spark.createDataFrame([("p", "PYZ-00.pyz"), ("j", "java/lang/Object")], "binary_id string, value string")
    sections_ = spark.createDataFrame([("g", 0, ".gopclntab", bytearray(b"x"))], "binary_id string, section_ord int, name string, raw binary")
    imports = spark.createDataFrame([], "binary_id string, library string, function string")
    found = runtime.detect(strings_, sections_, imports)
    got = {r.binary_id: r for r in runtime.reports(found, strings_, sections_, imports).collect()}
    assert [(a.name, a.detail) for a in got["p"].artifacts] == [("PYZ", "PyInstaller archive marker")] and len(got["p"].actions) == 2
    assert [(a.name, a.detail) for a in got["g"].artifacts] == [(".gopclntab", "Go metadata section")]
    assert [(a.name, a.detail) for a in got["j"].artifacts] == [("JVM class reference", "JVM evidence")]


def test_patterns_and_types(spark):
    from quarrykit.operators import inference

    rows = stream(spark, [(0, 1, "push", "rbp", None), (1, 3, "mov", "rbp, rsp", None), (4, 5, "call", "malloc", None), (9, 2, "dec", "ecx", None), (11, 2, "jnz", "x", None)]).withColumn("function_address", F.lit(0))
    assert {r.pattern for r in inference.patterns(rows).collect()} == {"function_prologue_x86", "function_prologue_x64", "malloc_call", "for_loop"}
    assert [r.pattern for r in inference.instruction_patterns(rows).collect()] == ["malloc_call"]
    kinds = [("x86", "mov", "eax, 0xFF"), ("x86", "mov", "eax, 0x100"), ("x86", "mov", "0x10000"), ("x86", "mov", "0x100000000"), ("x86", "lea", "rax, [rbx]"), ("x86", "nop", ""), ("arm", "ldr", "x0"), ("arm", "movz", "x0, 0x5"), ("x86", "mov", "70000"), ("x86", "mov", "0xFFFFFFFFFFFFFFFF")]
    got = spark.createDataFrame(kinds, "isa string, m string, o string").select(inference.value_type(F.col("isa"), F.col("m"), F.col("o")).alias("k")).collect()
    assert [r.k for r in got] == ["U8", "U16", "U32", "U64", "Pointer(Void)", "Unknown", "Pointer(Void)", "U8", "U32", "U64"]
    assert [one(spark, c) for k in ("Array(I8,4)", "Pointer(U8)", "I16") for c in (inference.c_type(F.lit(k)), inference.c_size(F.lit(k)))] == ["char[]", 4, "unsigned char*", 8, "int16_t", 2]


def test_import_xrefs_counts_every_call_site(spark, tmp_path):
    spark.createDataFrame([(1, "Brand#1"), (2, "Brand#2"), (3, "Brand#3")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    sites = [(o, n, 1 if n < 6 else 2, 10 + o) for o in range(1, 5) for n in range(1, 8)]
    spark.createDataFrame(sites, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.binary_id: r.n_callers for r in queries.import_xrefs(spark, str(tmp_path)).collect()}
    assert got == {"Brand#1": 20, "Brand#2": 8, "Brand#3": 0}


def test_images_have_no_limit_of_names_exports_or_size(spark):
    import inspect

    assert binaries._text(b"\1" + b"n" * 10_000 + b"\0x", 1) == "n" * 10_000
    n, names_at = 70_000, 40 + 70_000 * 10
    body = bytearray(struct.pack("<IIHHIIIIIII", 0, 0, 0, 0, 0, 1, n, n, 0x1000 + 40, 0x1000 + 40 + 4 * n, 0x1000 + 40 + 8 * n))
    body += b"".join(struct.pack("<I", 1 + k) for k in range(n)) + struct.pack("<I", 0x1000 + names_at) * n + b"".join(struct.pack("<H", k & 0xFFFF) for k in range(n)) + b"f\0"
    optional = struct.pack("<HBBIIIIIII", 0x10B, 0, 0, 0, 0, 0, 0, 0, 0, 0x400000).ljust(92, b"\0") + struct.pack("<III", 1, 0x1000, 40)
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0) + optional
    head += b".rdata\0\0" + struct.pack("<IIII", len(body), 0x1000, len(body), 0x400) + bytes(12) + struct.pack("<I", 0x40)
    assert len(binaries.parse(bytes(head.ljust(0x400, b"\0") + body))["exports"]) == n
    for f in (binaries.read, binaries.identified):
        assert inspect.signature(f).parameters["most_bytes"].default == binaries.MOST_BYTES > 2_147_000_000
    files = spark.createDataFrame([("a", (1 << 28) + 1, bytearray(b"MZ")), ("b", 1 << 31, None), ("c", 0, bytearray())], "path string, length long, content binary")
    found = binaries.identified(files)
    assert {r.path: r.content is None for r in found.collect()} == {"a": False, "b": True, "c": False}
    why = {r.path: r.error for r in binaries.parsed(found).collect()}
    assert why["b"] == "too large" and why["a"] != "too large" and why["c"] == "unknown format"

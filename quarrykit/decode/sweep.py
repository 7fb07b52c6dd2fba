"""Linear-sweep decoding of code sections to instruction rows, one section at a time in Arrow batches.

ARM and ARM64 words are decoded for control flow (branches, calls, returns) and a few moves; others are ``.word``. x86 and
x64 cover the common one- and two-byte opcodes with ModRM operands; a byte that isn't covered is ``(bad)``, of length 1.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit import rules

R64 = "rax rcx rdx rbx rsp rbp rsi rdi r8 r9 r10 r11 r12 r13 r14 r15".split()
R32 = "eax ecx edx ebx esp ebp esi edi r8d r9d r10d r11d r12d r13d r14d r15d".split()
R16 = "ax cx dx bx sp bp si di r8w r9w r10w r11w r12w r13w r14w r15w".split()
R8 = "al cl dl bl spl bpl sil dil r8b r9b r10b r11b r12b r13b r14b r15b".split()
R8_OLD = "al cl dl bl ah ch dh bh".split()
JCC = "jo jno jb jae je jne jbe ja js jns jp jnp jl jge jle jg".split()
GROUP1 = "add or adc sbb and sub xor cmp".split()
SHIFTS = "rol ror rcl rcr shl shr shl sar".split()
ONE_BYTE = {0x90: "nop", 0xC3: "ret", 0xCB: "retf", 0xC9: "leave", 0xCC: "int3", 0xF4: "hlt", 0x99: "cdq", 0x98: "cwde", 0xCF: "iret", 0xF8: "clc", 0xFC: "cld"}


def hex_text(x: int) -> str:
    """As disassemblers print: decimal below 10, else hex digits and h, with a 0 before a letter."""
    if 0 <= x < 10:
        return str(x)
    out = f"{x:X}h"
    return out if out[0].isdigit() else "0" + out


class _X86:
    def __init__(self, data: bytes, va: int, wide: bool):
        self.data, self.va, self.wide = data, va, wide

    def take(self, form: str) -> int:
        value = struct.unpack_from("<" + form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return value

    def register(self, k: int, size: int) -> str:
        if size == 1:
            return R8[k] if self.rex or k > 7 else R8_OLD[k]
        return {2: R16, 4: R32, 8: R64}[size][k]

    def modrm(self, size: int) -> tuple[str, str, int]:
        """(register or memory operand, register, the middle field)."""
        m = self.take("B")
        mod, middle, rm = m >> 6, m >> 3 & 7, m & 7
        reg = self.register(middle | (self.rex >> 2 & 1) << 3, size)
        if mod == 3:
            return self.register(rm | (self.rex & 1) << 3, size), reg, middle
        bases = R64 if self.wide else R32
        base, index, disp, relative = None, "", 0, False
        if rm == 4:
            sib = self.take("B")
            k = sib >> 3 & 7 | (self.rex >> 1 & 1) << 3
            if k != 4:
                index = f"{bases[k]}*{1 << (sib >> 6)}" if sib >> 6 else bases[k]
            if sib & 7 == 5 and mod == 0:
                disp = self.take("i")
            else:
                base = bases[sib & 7 | (self.rex & 1) << 3]
        elif rm == 5 and mod == 0:
            disp, relative = self.take("i"), self.wide
        else:
            base = bases[rm | (self.rex & 1) << 3]
        if mod == 1:
            disp = self.take("b")
        elif mod == 2:
            disp = self.take("i")
        inner = "+".join(x for x in ("rip" if relative else base, index) if x)
        if not inner:
            inner = hex_text(disp & 0xFFFFFFFF)
        elif disp or relative:
            inner += ("-" if disp < 0 else "+") + hex_text(abs(disp))
        name = {1: "byte", 2: "word", 4: "dword", 8: "qword"}[size]
        return f"{name} ptr [{inner}]", reg, middle

    def one(self, start: int) -> tuple[str, str, int | None]:
        self.at, self.rex, word, repeat = start, 0, False, False
        op = self.take("B")
        while op in (0x66, 0xF2, 0xF3, 0x2E, 0x3E, 0x64, 0x65):
            word, repeat = word or op == 0x66, repeat or op in (0xF2, 0xF3)
            op = self.take("B")
        if self.wide and op & 0xF0 == 0x40:
            self.rex = op
            op = self.take("B")
        size = 8 if self.rex & 8 else 2 if word else 4
        address = 8 if self.wide else 4
        here = lambda: self.va + self.at
        mask = (1 << 64) - 1 if self.wide else (1 << 32) - 1
        if op == 0x0F:
            op = self.take("B")
            if op & 0xF0 == 0x80:
                d = self.take("i")
                t = here() + d & mask
                return JCC[op & 15], hex_text(t), t
            if op & 0xF0 == 0x90:
                return "set" + JCC[op & 15][1:], self.modrm(1)[0], None
            if op & 0xF0 == 0x40:
                a, r, _ = self.modrm(size)
                return "cmov" + JCC[op & 15][1:], f"{r},{a}", None
            if op in (0xB6, 0xB7, 0xBE, 0xBF):
                middle = self.data[self.at] >> 3 & 7 | (self.rex >> 2 & 1) << 3
                a, _, _ = self.modrm(1 if op & 1 == 0 else 2)
                return "movzx" if op < 0xB8 else "movsx", f"{self.register(middle, size)},{a}", None
            if op == 0xAF:
                a, r, _ = self.modrm(size)
                return "imul", f"{r},{a}", None
            if op == 0x1E and repeat and self.data[self.at : self.at + 1] in (b"\xfa", b"\xfb"):
                return ("endbr64" if self.take("B") == 0xFA else "endbr32"), "", None
            if op in (0x1F, 0x1E):
                return "nop", self.modrm(size)[0], None
            if op == 0x0B:
                return "ud2", "", None
            if op == 0x05:
                return "syscall", "", None
            raise ValueError
        if op < 0x40 and op & 7 < 6:
            name, form = GROUP1[op >> 3], op & 7
            if form < 4:
                width = 1 if form & 1 == 0 else size
                a, r, _ = self.modrm(width)
                return name, f"{a},{r}" if form < 2 else f"{r},{a}", None
            return (name, f"al,{hex_text(self.take('B'))}", None) if form == 4 else (name, f"{self.register(0, size)},{hex_text(self.immediate(size))}", None)
        if 0x50 <= op <= 0x5F:
            return "push" if op < 0x58 else "pop", self.register(op & 7 | (self.rex & 1) << 3, address), None
        if not self.wide and 0x40 <= op <= 0x4F:
            return "inc" if op < 0x48 else "dec", R32[op & 7], None
        if 0x70 <= op <= 0x7F:
            d = self.take("b")
            t = here() + d & mask
            return JCC[op & 15], f"short {hex_text(t)}", t
        if op in (0xE8, 0xE9):
            d = self.take("i")
            t = here() + d & mask
            return "call" if op == 0xE8 else "jmp", hex_text(t), t
        if op == 0xEB:
            d = self.take("b")
            t = here() + d & mask
            return "jmp", f"short {hex_text(t)}", t
        if op in (0x80, 0x81, 0x83):
            width = 1 if op == 0x80 else size
            a, _, middle = self.modrm(width)
            value = self.take("b") if op != 0x81 else self.immediate(size)
            return GROUP1[middle], f"{a},{hex_text(value & (1 << 8 * width) - 1)}", None
        if 0x84 <= op <= 0x8B:
            width = 1 if op & 1 == 0 else size
            a, r, _ = self.modrm(width)
            return ("test", "test", "xchg", "xchg", "mov", "mov", "mov", "mov")[op - 0x84], f"{r},{a}" if op >= 0x8A else f"{a},{r}", None
        if op == 0x8D:
            a, r, _ = self.modrm(size)
            return "lea", f"{r},{a[a.index('[') :]}", None
        if op == 0x63 and self.wide:
            middle = self.data[self.at] >> 3 & 7 | (self.rex >> 2 & 1) << 3
            a, _, _ = self.modrm(4)
            return "movsxd", f"{self.register(middle, size)},{a}", None
        if 0xB0 <= op <= 0xB7:
            return "mov", f"{self.register(op & 7 | (self.rex & 1) << 3, 1)},{hex_text(self.take('B'))}", None
        if 0xB8 <= op <= 0xBF:
            value = self.take("Q") if size == 8 else self.immediate(size)
            return "mov", f"{self.register(op & 7 | (self.rex & 1) << 3, size)},{hex_text(value)}", None
        if op in (0xC6, 0xC7):
            width = 1 if op == 0xC6 else size
            a, _, _ = self.modrm(width)
            return "mov", f"{a},{hex_text(self.take('B') if width == 1 else self.immediate(size))}", None
        if op in (0xC0, 0xC1, 0xD0, 0xD1, 0xD2, 0xD3):
            a, _, middle = self.modrm(1 if op & 1 == 0 else size)
            by = hex_text(self.take("B")) if op < 0xD0 else "1" if op < 0xD2 else "cl"
            return SHIFTS[middle], f"{a},{by}", None
        if op in (0x68, 0x6A):
            return "push", hex_text((self.take("i") if op == 0x68 else self.take("b")) & mask), None
        if op in (0x69, 0x6B):
            a, r, _ = self.modrm(size)
            return "imul", f"{r},{a},{hex_text(self.immediate(size) if op == 0x69 else self.take('b') & 0xFF)}", None
        if op in (0xA8, 0xA9):
            return ("test", f"al,{hex_text(self.take('B'))}", None) if op == 0xA8 else ("test", f"{self.register(0, size)},{hex_text(self.immediate(size))}", None)
        if op in (0xF6, 0xF7):
            width = 1 if op == 0xF6 else size
            a, _, middle = self.modrm(width)
            name = ("test", "test", "not", "neg", "mul", "imul", "div", "idiv")[middle]
            return name, f"{a},{hex_text(self.take('B') if width == 1 else self.immediate(size))}" if middle < 2 else a, None
        if op in (0xFE, 0xFF):
            middle = self.data[self.at] >> 3 & 7
            name = ("inc", "dec", "call", None, "jmp", None, "push", None)[middle]
            if name is None or op == 0xFE and middle > 1:
                raise ValueError
            return name, self.modrm(1 if op == 0xFE else address if middle > 1 else size)[0], None
        if op == 0xC2:
            return "ret", hex_text(self.take("H")), None
        if op in ONE_BYTE:
            return ONE_BYTE[op], "", None
        raise ValueError

    def immediate(self, size: int) -> int:
        value = self.take("h" if size == 2 else "i")
        return value & (1 << 8 * size) - 1


def x86(data: bytes, va: int, wide: bool) -> Iterator[tuple]:
    """(address, bytes, mnemonic, operands, length, target)."""
    sweep, at = _X86(data, va, wide), 0
    while at < len(data):
        try:
            mnemonic, operands, target = sweep.one(at)
            end = sweep.at
        except (ValueError, struct.error, IndexError, KeyError):
            mnemonic, operands, target, end = "(bad)", "", None, at + 1
        yield va + at, data[at:end], mnemonic, operands, end - at, target
        at = end


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> bits - 1 else value


def arm64_word(w: int, address: int) -> tuple[str, str]:
    if w >> 26 in (0b000101, 0b100101):
        return "b" if w >> 26 == 5 else "bl", f"0x{address + 4 * _signed(w & 0x3FFFFFF, 26):x}"
    if w & 0xFF000010 == 0x54000000 and w & 15 < 14:
        names = "eq ne hs lo mi pl vs vc hi ls ge lt gt le".split()
        return f"b.{names[w & 15]}", f"0x{address + 4 * _signed(w >> 5 & 0x7FFFF, 19):x}"
    if w & 0x7E000000 == 0x34000000:
        return "cbnz" if w >> 24 & 1 else "cbz", f"{'x' if w >> 31 else 'w'}{w & 31}, 0x{address + 4 * _signed(w >> 5 & 0x7FFFF, 19):x}"
    if w & 0x7E000000 == 0x36000000:
        bit = (w >> 31) << 5 | w >> 19 & 31
        return "tbnz" if w >> 24 & 1 else "tbz", f"{'x' if w >> 31 else 'w'}{w & 31}, #{bit}, 0x{address + 4 * _signed(w >> 5 & 0x3FFF, 14):x}"
    for base, name in ((0xD61F0000, "br"), (0xD63F0000, "blr")):
        if w & 0xFFFFFC1F == base:
            return name, f"x{w >> 5 & 31}"
    if w & 0xFFFFFC1F == 0xD65F0000:
        return "ret", "" if w >> 5 & 31 == 30 else f"x{w >> 5 & 31}"
    if w == 0xD503201F:
        return "nop", ""
    return ".word", f"0x{w:08x}"


def arm_word(w: int, address: int) -> tuple[str, str]:
    names = [*"eq ne hs lo mi pl vs vc hi ls ge lt gt le".split(), "", None]
    cc = names[w >> 28]
    if cc is not None and w >> 25 & 7 == 5:
        return ("bl" if w >> 24 & 1 else "b") + cc, f"0x{address + 8 + 4 * _signed(w & 0xFFFFFF, 24) & 0xFFFFFFFF:x}"
    if cc is not None and w & 0x0FFFFFD0 == 0x012FFF10:
        return ("blx" if w & 0x20 else "bx") + cc, "lr" if w & 15 == 14 else f"r{w & 15}"
    return ".word", f"0x{w:08x}"


def arm(data: bytes, va: int, wide: bool) -> Iterator[tuple]:
    for at in range(0, len(data) // 4 * 4, 4):
        mnemonic, operands = (arm64_word if wide else arm_word)(struct.unpack_from("<I", data, at)[0], va + at)
        yield va + at, data[at : at + 4], mnemonic, operands, 4, None


def rows(data: bytes, va: int, architecture: str) -> Iterator[tuple]:
    return x86(data, va, architecture == "x64") if architecture in ("x86", "x64") else arm(data, va, architecture == "ARM64")


RAW = "binary_id string, section_ord int, pos long, isa string, architecture string, address long, bytes binary, length int, mnemonic string, operands string, target long"


def disassembled(sections: DataFrame) -> DataFrame:
    """``binary_id, seq, isa, architecture, address, bytes, length, mnemonic, operands, target`` of all code sections, in
    section order; rows leave in batches, so a section's rows are never held together."""
    wrap = lambda x: None if x is None else x - (1 << 64) if x >= 1 << 63 else x

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RAW.split(", ")]
        for b in batches:
            for binary, ord_, va, arch, raw in zip(*(c.to_pylist() for c in b.columns)):
                held = []
                isa = "x86" if arch in ("x86", "x64") else "arm"
                for k, (address, data, mnemonic, operands, length, target) in enumerate(rows(raw or b"", va & (1 << 64) - 1, arch)):
                    held.append((binary, ord_, k, isa, arch, wrap(address), data, length, mnemonic, operands, wrap(target)))
                    if len(held) == 20_000:
                        yield _batch(held, names)
                        held = []
                if held:
                    yield _batch(held, names)

    code = sections.where(F.col("is_code") & F.col("architecture").isin(*rules.PROLOGUES)).select("binary_id", "section_ord", "virtual_address", "architecture", "raw")
    found = code.mapInArrow(out, RAW)
    seq = F.row_number().over(Window.partitionBy("binary_id").orderBy("section_ord", "pos")).cast("long")
    return found.withColumn("seq", seq).drop("section_ord", "pos")


def _batch(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)

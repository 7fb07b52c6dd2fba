"""Scalar rules over strings, operands and identifiers, as column expressions (JVM side throughout)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.functions import u64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """Lower case in A-Z alone; values of ASCII only, which most are, take the quick way."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_ignoring_case(x: Column, needle: str) -> Column:
    return ascii_lower(x).contains(needle.lower())


def suspicious_category(value: Column) -> Column:
    """First matching category, or null."""

    def first(low: Column) -> Column:
        test = {"prefix": low.startswith, "contains": low.contains, "suffix": low.endswith}
        out = F.when(F.lit(False), "")
        for name, (kind, needles) in rules.STRING_RULES:
            out = out.when(any_of([test[kind](n) for n in needles]), name)
        return out

    return let(ascii_lower(value), first)


def string_behavior(category: Column) -> tuple[Column, Column]:
    """(category, severity) of the behaviour that a string category stands for."""

    def pick(k):
        out = F.when(category == "", "")
        for name, pair in rules.STRING_BEHAVIOR.items():
            out = out.when(category == name, pair[k])
        return out.otherwise(rules.OTHER_STRING_BEHAVIOR[k])

    return pick(0), pick(1)


def severity_rank(severity: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in rules.SEVERITY_RANK.items():
        out = out.when(severity == name, rank)
    return out.otherwise(0)


def severity_weight(rank: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, r in rules.SEVERITY_RANK.items():
        out = out.when(rank == r, rules.SEVERITY_WEIGHT[name])
    return out.otherwise(0)


def risk_level(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, least in rules.RISK_LEVELS:
        out = out.when(score >= least, name)
    return out.otherwise("none")


def string_symbol(address: Column) -> Column:
    return F.concat(F.lit("str_"), u64.hex_text(address))


# --- encoded strings -------------------------------------------------------------------------------------------------


def recipe_signal(value: Column) -> Column:
    """url_percent_encoding, hex, base64, escaped_hex or null, for the trimmed value. Plain tests that every match passes go before
    the patterns: most values are short words and meet none."""

    def told(v: Column) -> Column:
        length = F.length(v)
        percent = v.contains("%") & (F.regexp_count(v, F.lit("%(?=[0-9A-Fa-f]{2})")) >= 2)
        compact = F.regexp_replace(v, r"[ \t\n\f\r:\-_]", "")
        is_hex = (length >= 16) & let(compact, lambda c: c.rlike("^[0-9A-Fa-f]{16,}$") & (F.length(c) % 2 == 0) & c.rlike("[A-Fa-f]"))
        plain = v.rlike("^[A-Za-z0-9+/]+={0,2}$")
        url_safe = v.rlike("[-_]") & v.rlike("^[A-Za-z0-9_-]+={0,2}$")
        is_base64 = (length >= 16) & (length % 4 == 0) & (plain | url_safe) & ~v.rlike("^[0-9A-Fa-f]+$")
        escaped = v.contains("\\") & (F.regexp_count(v, F.lit(r"\\[xX][0-9A-Fa-f]{2}")) >= 2)
        return F.when(v == "", None).when(percent, "url_percent_encoding").when(is_hex, "hex").when(is_base64, "base64").when(escaped, "escaped_hex")

    return let(F.regexp_replace(value, r"^\s+|\s+$", ""), told)


def recipe_details(value: Column, signal: Column) -> tuple[Column, Column, Column]:
    """(confidence, reason, recipe as compact JSON)."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    mark = F.when(v.startswith("H4sI"), "H4sI").when(v.startswith("eJ"), "eJ").otherwise("")
    alphabet = F.when(v.rlike("[-_]"), "A-Za-z0-9-_=").otherwise("A-Za-z0-9+/=")
    confidence = F.when(mark == "H4sI", 90).when((mark == "eJ") | v.endswith("="), 85).otherwise(70)
    reason, more = (reduce(lambda out, kv: out.when(mark == kv[0], kv[1]), table.items(), F.when(F.lit(False), "")) for table in (rules.BASE64_REASONS, rules.BASE64_MORE))
    recipe = F.concat(F.lit('[{"op":"From Base64","args":["'), alphabet, F.lit('",true,false]}'), more, F.lit("]"))
    out = [F.when(signal == "base64", x) for x in (confidence, reason, recipe)]
    for name, row in rules.RECIPES.items():
        out = [x.when(signal == name, y) for x, y in zip(out, row)]
    return tuple(out)


def _percent(x: Column) -> Column:
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def deep_link(value: Column, recipe: Column) -> Column:
    """A link that opens the recipe with the untrimmed value."""
    packed = F.regexp_replace(F.base64(value.cast("binary")), r"[\r\n]", "")
    return F.concat(F.lit(rules.LINK_BASE), _percent(F.url_encode(recipe)), F.lit("&input="), _percent(F.url_encode(packed)))


# --- operands --------------------------------------------------------------------------------------------------------


def hex_tokens(text: Column) -> Column:
    """The addresses that an operand text names, in order: 0x.. or ..h (one h), of 64 bits at most. Bare digits name none."""
    tokens = F.regexp_extract_all(text, F.lit("[0-9A-Fa-fxXhH]+"), F.lit(0))

    def value(t: Column) -> Column:
        digits = F.when(t.rlike("^0[xX]"), F.substring(t, 3, 1 << 20)).when(t.rlike("[hH]$"), F.regexp_replace(t, "[hH]$", ""))
        return u64.parse_hex(digits)

    return F.array_compact(F.transform(tokens, value))


def memory_target(operands: Column, address: Column, length: Column) -> Column:
    """Address of a memory operand: absolute, or relative to the next instruction."""
    token = F.get(hex_tokens(operands), F.lit(0))
    low = ascii_lower(operands)
    after = u64.wrapping_add(address, length.cast("bigint"))
    plus = low.contains("rip+") | low.contains("rip +")
    minus = low.contains("rip-") | low.contains("rip -")
    return F.when(operands.contains("[") & operands.contains("]"), F.when(plus, u64.wrapping_add(after, token)).when(minus, u64.wrapping_add(after, -token)).otherwise(token))


def canonical_register(name: Column) -> Column:
    """The 64-bit register that a part belongs to, or null."""
    low = ascii_lower(name)
    out = F.when(F.lit(False), "")
    for whole, parts in rules.REGISTERS.items():
        out = out.when(low.isin(whole, *parts.split()), whole)
    return out


def branch_condition(mnemonic: Column) -> Column:
    """Comparison operator of a conditional jump after ``cmp``; signed and unsigned alike; else null."""
    out = F.when(F.lit(False), "")
    for op, names in rules.CONDITIONS.items():
        out = out.when(ascii_lower(mnemonic).isin(*names.split()), op)
    return out


def zero_condition(mnemonic: Column) -> Column:
    """Operator after ``test``: only branches on the zero flag have one."""
    low = ascii_lower(mnemonic)
    return F.when(low.isin("je", "jz"), "==").when(low.isin("jne", "jnz"), "!=")


def stack_name(base: Column, disp: Column) -> Column:
    """Name of a frame slot; offsets in lower-case hex."""
    size = F.lower(F.hex(F.abs(disp)))
    frame = ascii_lower(base).isin("rbp", "ebp", "bp")
    pointer = ascii_lower(base).isin("rsp", "esp", "sp")
    return F.when(frame, F.concat(F.when(disp < 0, "local_").otherwise("arg_"), size)).when(pointer, F.concat(F.when(disp < 0, "stack_m_").otherwise("stack_"), size))


def integer_literal(text: Column) -> Column:
    """Sign, 0x, trailing h or decimal -> BIGINT, or null."""
    t = F.trim(text)
    negative = t.startswith("-")
    body = F.regexp_replace(t, "^[+-]", "")
    hexed = F.when(body.rlike("^0[xX][0-9A-Fa-f]+$"), F.substring(body, 3, 64)).when(body.rlike("^[0-9A-Fa-f]+[hH]$"), F.regexp_replace(body, "[hH]$", ""))
    parsed = u64.parse_hex(hexed)
    value = F.when(hexed.isNotNull(), F.when(parsed >= 0, parsed)).otherwise(F.when(body.rlike("^[0-9]+$"), body.try_cast("bigint")))
    return F.when(negative, -value).otherwise(value)


def narrowest_unsigned(value: Column) -> Column:
    return F.when((value >= 0) & (value <= 0xFF), "uint8_t").when((value >= 0) & (value <= 0xFFFF), "uint16_t").when((value >= 0) & (value <= 0xFFFFFFFF), "uint32_t").otherwise("uint64_t")


# --- C text ----------------------------------------------------------------------------------------------------------


def c_escape(text: Column) -> Column:
    """Escaped for a C string: byte by byte, octal for what isn't printable ASCII."""
    at = F.sequence(F.lit(1), F.octet_length(text))

    def byte(i: Column) -> Column:
        b = F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("int")
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(b.cast("string"), 10, 8), 3, "0"))
        return F.when(b == 34, '\\"').when(b == 92, "\\\\").when(b == 10, "\\n").when(b == 13, "\\r").when(b == 9, "\\t").when((b < 32) | (b > 126), octal).otherwise(F.chr(b.cast("bigint")))

    return F.when(text == "", "").otherwise(F.array_join(F.transform(at, byte), ""))


def c_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), c_escape(text), F.lit('"'))


def c_comment(text: Column) -> Column:
    return F.replace(text, F.lit("*/"), F.lit("* /"))


def _identifier_body(text: Column) -> Column:
    """Runs of other characters part words by one underscore, unless the word before ends with one."""
    t = F.regexp_replace(F.trim(text), "[^A-Za-z0-9_]+", " ")
    t = F.trim(t)
    return F.replace(F.regexp_replace(t, "_ ", "_"), F.lit(" "), F.lit("_"))


def identifier(text: Column, fallback: str) -> Column:
    """A C identifier that is no keyword and not reserved."""
    body = _identifier_body(text)
    named = F.when(body == "", fallback).when(body.rlike("^[0-9]"), F.concat(F.lit(f"{fallback}_"), body)).otherwise(body)
    named = F.when(named.isin(*rules.C_KEYWORDS.split()), F.concat(named, F.lit("_"))).otherwise(named)
    rest = F.regexp_replace(named, "^_+", "")
    return F.when(named.startswith("_"), F.when(rest == "", fallback).otherwise(F.concat(F.lit(f"{fallback}_"), rest))).otherwise(named)


def file_stem(text: Column) -> Column:
    clean = F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_")
    return F.when(clean == "", "artifact").otherwise(clean)

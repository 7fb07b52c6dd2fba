"""Unsigned 64-bit addresses in BIGINT bit patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)
MODULUS = 1 << 64


def hex_text(x: Column) -> Column:
    """Upper-case hex without leading zeros."""
    return F.hex(x)


def order_key(x: Column) -> Column:
    """Sorts as the unsigned value does."""
    return x.bitwiseXOR(F.lit(SIGN))


def parse_hex(digits: Column) -> Column:
    """Null where the digits are more than 64 bits."""
    core = F.regexp_replace(digits, "^0+", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]+$") & (F.length(core) <= 16), F.conv(F.when(core == "", "0").otherwise(core), 16, -10).cast("bigint"))


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, in any ANSI mode."""
    total = F.pmod(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), F.expr(f"cast({MODULUS} as decimal(38,0))"))
    return F.when(total >= F.expr(f"cast({1 << 63} as decimal(38,0))"), total - F.expr(f"cast({MODULUS} as decimal(38,0))")).otherwise(total).cast("bigint")

"""Strings of sections, their categories and recipes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import text as X
from quarrykit.functions import u64


def scan_ascii(sections: DataFrame, min_length: int = 4, max_length: int = 1024) -> DataFrame:
    """NUL-ended runs of printable ASCII in data sections: native, one generator a section. Longer runs are left out."""
    raw = F.decode("raw", "ISO-8859-1")
    parts = sections.where("is_data").select("binary_id", "section_ord", "virtual_address", F.split(raw, "\x00", -1).alias("p"))
    ends = F.slice("p", F.lit(1), F.size("p") - 1)
    rows = parts.select("binary_id", "section_ord", "virtual_address", F.posexplode(ends).alias("pos", "seg"))
    w = Window.partitionBy("binary_id", "section_ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("seg") + 1).over(w) - 1).withColumn("value", F.regexp_extract("seg", r"[\x20-\x7E]*\z", 0))
    size = F.length("value")
    address = u64.wrapping_add(F.col("virtual_address"), (F.col("end") - size).cast("bigint"))
    return rows.where((size >= min_length) & (size <= max_length)).select("binary_id", "section_ord", address.alias("address"), "value", F.lit("Ascii").alias("encoding"), size.cast("long").alias("length"))


def scan_utf16(sections: DataFrame, min_length: int = 4, max_length: int = 1024) -> DataFrame:
    """The same over little-endian 16-bit units at even offsets: bytes in, arrays out, one Arrow pass."""

    @F.pandas_udf("array<struct<offset:bigint,value:string>>")
    def found(raw: pd.Series) -> pd.Series:
        out = []
        for data in raw:
            units = np.frombuffer(bytes(data or b"")[: len(data or b"") // 2 * 2], dtype="<u2")
            good = (units >= 0x20) & (units < 0x7F)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
            hits = []
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b < len(units) and units[b] == 0 and min_length <= b - a <= max_length:
                    hits.append({"offset": 2 * a, "value": units[a:b].astype(np.uint8).tobytes().decode("ascii")})
            out.append(hits)
        return pd.Series(out)

    rows = sections.where("is_data").select("binary_id", "section_ord", "virtual_address", F.explode(found("raw")).alias("s"))
    return rows.select("binary_id", "section_ord", u64.wrapping_add(F.col("virtual_address"), F.col("s.offset")).alias("address"), F.col("s.value").alias("value"), F.lit("Utf16Le").alias("encoding"), F.length("s.value").cast("long").alias("length"))


def dedupe(strings: DataFrame) -> DataFrame:
    """The first of each value in a section; ASCII goes before UTF-16."""
    w = Window.partitionBy("binary_id", "section_ord", "value").orderBy("encoding", "address")
    return strings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extract(sections: DataFrame, min_length: int = 4, max_length: int = 1024, include_null: bool = False) -> DataFrame:
    return dedupe(scan_ascii(sections, min_length, max_length).unionByName(scan_utf16(sections, min_length, max_length)))


def _told(strings: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows for which ``value`` isn't null. It passes through a generator, below which no filter is pushed: it is evaluated once."""
    kept = [c for c in strings.columns if c != name]
    return strings.select(*kept, F.explode(F.array(value)).alias(name)).where(F.col(name).isNotNull())


def suspicious(strings: DataFrame) -> DataFrame:
    out = _told(strings, "category", X.suspicious_category(F.col("value")))
    return out.withColumn("symbol", X.string_symbol(F.col("address")))


def recipes(strings: DataFrame) -> DataFrame:
    """Strings that look encoded, with how to decode them."""
    told = _told(strings, "signal", X.recipe_signal(F.col("value")))
    confidence, reason, recipe = X.recipe_details(F.col("value"), F.col("signal"))
    told = told.withColumns({"symbol": X.string_symbol(F.col("address")), "confidence": confidence, "reason": reason, "recipe": recipe})
    return told.withColumn("deep_link", X.deep_link(F.col("value"), F.col("recipe")))

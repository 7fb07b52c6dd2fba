"""The report package of a corpus: every table from the same lazy lineage, and its sinks.

Tables stay DataFrames keyed by ``binary_id`` until a sink. Sinks write through Spark (JSON or Parquet a table,
partitioned by binary), or, for payload files, from the executors into a folder that they share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import u64
from quarrykit.operators import behavior, cfg, instructions, runtime, strings, xrefs
from quarrykit.sources import binaries


@dataclass
class Inputs:
    """What the package is made of; ``instructions`` as ``operators.instructions`` describes them."""

    images: DataFrame
    instructions: DataFrame


def tables(given: Inputs) -> dict[str, DataFrame]:
    """Name -> DataFrame."""
    sections, exports = binaries.sections(given.images), binaries.exports(given.images)
    imports = binaries.imports(given.images)
    called = imports.where("function is not null")
    entries = given.images.select("binary_id", F.col("entry_point").alias("address"))
    classed = instructions.classes(given.instructions)
    members = instructions.members(classed, instructions.seeds(classed, entries, exports))
    functions = instructions.functions(members, exports)
    found = strings.extract(sections)
    runtimes = runtime.detect(found, sections, imports)
    calls, tails = xrefs.calls(members, called, functions), xrefs.tail_calls(members, called, functions)
    refs = xrefs.string_refs(members, found)
    insights = behavior.api_insights(called)
    suspicious = strings.suspicious(found)
    findings = behavior.findings(insights, suspicious, runtimes)
    out = {
        "sections": sections.select("binary_id", "section_ord", "name", "virtual_address", "size", F.octet_length("raw").alias("raw_size"), "is_code", "is_data", "is_readable", "is_writable", "is_executable"),
        "imports": binaries.import_libraries(given.images),
        "import_addresses": called,
        "pe_directories": binaries.directories(given.images),
        "exports": exports,
        "functions": functions,
        "strings": found,
        "calls": calls,
        "tail_calls": tails,
        "call_graph": xrefs.call_graph(calls),
        "cfg_summary": instructions.cfg_summary(members),
        "cfg_edges": cfg.edges(classed),
        "jump_tables": instructions.jump_tables(classed),
        "string_refs": refs,
        "strings_by_function": xrefs.strings_by_function(refs),
        "suspicious_strings": suspicious,
        "decode_recipes": strings.recipes(found),
        "api_insights": insights,
        "import_xrefs": xrefs.import_xrefs(called, xrefs.import_callers(calls), insights),
        "function_xrefs": xrefs.function_xrefs(functions, calls, refs),
        "runtimes": runtimes,
        "behavior_findings": findings,
        "behavior_categories": behavior.categories(findings),
        "risk": behavior.risk(findings),
        "artifacts": runtime.inventory(runtimes, found, sections, imports, exports.select("binary_id", "name")),
        "errors": binaries.errors(given.images),
    }
    out["summary"] = summary(given.images, out)
    return out


COUNTED = ("sections", "imports", "exports", "functions", "strings", "calls", "jump_tables", "suspicious_strings", "api_insights", "runtimes")


def summary(images: DataFrame, tables_: dict[str, DataFrame]) -> DataFrame:
    """Counts of each binary's tables in one shuffle: a row a table and binary, partly summed before."""
    rows = None
    for name in COUNTED:
        part = tables_[name].select("binary_id", F.lit(name).alias("t"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("binary_id").agg(*[F.count_if(F.col("t") == name).alias(f"{name}_count") for name in COUNTED])
    about = images.select("binary_id", "path", "format", "architecture", "entry_point")
    return about.join(counts, "binary_id", "left").na.fill(0, [f"{name}_count" for name in COUNTED])


def write(tables_: dict[str, DataFrame], folder: str, kind: str = "json") -> None:
    for name, table in tables_.items():
        table.write.mode("overwrite").partitionBy("binary_id").format(kind).save(f"{folder}/{name}")


def as_json(table: DataFrame) -> DataFrame:
    """``binary_id, json``: one document a row."""
    return table.select("binary_id", F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def report_text(tables_: dict[str, DataFrame], most_functions: int = 20, most_categories: int = 10) -> DataFrame:
    """``binary_id, text``: a readable summary; the first functions and categories of each binary."""
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Path: "), "path"), F.concat(F.lit("Format: "), "format"), F.concat(F.lit("Architecture: "), "architecture"),
        F.concat(F.lit("Entry point: 0x"), u64.hex_text(F.col("entry_point"))),
        *[F.concat(F.lit(f"{name.replace('_', ' ').capitalize()}: "), F.col(f"{name}_count").cast("string")) for name in COUNTED],
    )
    top = instructions.top_functions(tables_["functions"], most_functions)
    line = F.concat(F.lit("  0x"), u64.hex_text(F.col("address")), F.lit(" "), "name", F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes)"))
    listed = top.groupBy("binary_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(u64.order_key(F.col("address")).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("functions"))
    kinds = tables_["behavior_categories"].select("binary_id", F.struct((-F.col("severity_rank")).alias("r"), "category", F.concat(F.lit("  ["), "severity", F.lit("] "), "category", F.lit(": "), F.col("n_findings").cast("string")).alias("l")).alias("x"))
    kinds = kinds.groupBy("binary_id").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("x")), 1, most_categories), lambda x: x["l"]), "\n").alias("categories"))
    risk = tables_["risk"].select("binary_id", F.concat(F.lit("Risk: "), "level", F.lit(" ("), F.col("score").cast("string"), F.lit(")")).alias("risk"))
    out = tables_["summary"].join(listed, "binary_id", "left").join(kinds, "binary_id", "left").join(risk, "binary_id", "left")
    return out.select("binary_id", F.concat_ws("\n", head, F.coalesce("risk", F.lit("Risk: none (0)")), F.lit("Functions:"), "functions", F.lit("Behavior:"), "categories").alias("text"))


def artifacts_folder(explicit: str | None, report: str | None, stem: str) -> str:
    return explicit or report or f"{stem}_artifacts"


def write_artifacts(carved: DataFrame, folder: str) -> DataFrame:
    """Writes carved payloads below ``folder`` (shared by the executors), by binary; the manifest has no payloads. Each
    file appears whole under its name, so a task that runs again changes nothing."""
    named = runtime.unique_files(carved.withColumn("ord", F.col("virtual_address")), F.concat("name", F.lit("_0x"), u64.hex_text(F.col("virtual_address"))), "pyc")

    def store(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups:
            for r in rows.itertuples():
                where = os.path.join(folder, str(r.binary_id))
                os.makedirs(where, exist_ok=True)
                path = os.path.join(where, r.file_name)
                with open(f"{path}.{os.getpid()}", "wb") as out:
                    out.write(r.payload)
                os.replace(f"{path}.{os.getpid()}", path)
            yield rows[["binary_id", "file_name", "virtual_address", "size"]]

    return named.select("binary_id", "file_name", "virtual_address", "size", "payload").mapInPandas(store, "binary_id string, file_name string, virtual_address long, size long")


def c_files(decompiled: DataFrame, header: str = "#include <stdint.h>") -> DataFrame:
    """``binary_id, c_text``: prototypes, then bodies, in address order."""
    parts = F.sort_array(F.collect_list(F.struct(u64.order_key(F.col("address")).alias("k"), "prototype", "c_text")))
    out = decompiled.groupBy("binary_id").agg(parts.alias("p"))
    join = lambda name, by: F.array_join(F.transform("p", lambda x: x[name]), by)
    return out.select("binary_id", F.concat(F.lit(header + "\n\n"), join("prototype", "\n"), F.lit("\n\n"), join("c_text", "\n\n"), F.lit("\n")).alias("c_text"))

"""Runtime families of binaries from markers, and artifacts of packaged runtimes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.functions import text as X

MAGIC = bytes.fromhex("4d45490c0b0a0b0e")
MOST = 1 << 20


def _flags(rows: DataFrame, value: Column, needles: list[str]) -> DataFrame:
    """One pass: for each binary an array that says which needles it has."""
    low = X.ascii_lower(value)
    return rows.groupBy("binary_id").agg(F.array(*[F.bool_or(low.contains(n.lower())) for n in needles]).alias("f"))


def marker_hits(strings: DataFrame, sections: DataFrame, imports: DataFrame, markers=rules.RUNTIME_MARKERS, exports: DataFrame | None = None) -> DataFrame:
    """``binary_id, kind, needle, label_suffix`` of every marker found. Strings, section bytes, names of sections and
    imports are each read once, with all needles as aggregates; nothing is joined with the markers by row."""
    needles = {k: list(dict.fromkeys(m[3] for m in markers if m[2] == k)) for k in ("string", "section", "import", "function")}
    raw = F.decode("raw", "ISO-8859-1")
    parts = []

    def listed(rows: DataFrame, value: Column, kind: str):
        if not needles[kind]:
            return
        hit = _flags(rows, value, needles[kind])
        flat = F.inline(F.arrays_zip(F.array(*map(F.lit, needles[kind])).alias("needle"), F.col("f").alias("hit")))
        parts.append(hit.select("binary_id", F.lit(kind).alias("kind"), flat).where("hit").select("binary_id", "kind", "needle", F.lit("").alias("suffix")))

    listed(strings, F.col("value"), "string")
    listed(sections, raw, "string")
    if exports is not None:
        listed(exports, F.col("name"), "string")
    listed(imports, F.col("library"), "import")
    listed(imports, F.col("function"), "function")
    names = []
    for n in needles["section"]:
        hit = X.contains_ignoring_case(F.col("name"), n)
        names.append(F.struct(F.lit(n).alias("needle"), F.min_by("name", F.when(hit, F.col("section_ord"))).alias("first")))
    if names:
        found = sections.groupBy("binary_id").agg(F.array(*names).alias("n")).select("binary_id", F.inline("n")).where("first is not null")
        parts.append(found.select("binary_id", F.lit("section").alias("kind"), "needle", F.concat(F.lit(" ("), "first", F.lit(")")).alias("suffix")))
    return reduce(DataFrame.unionByName, parts).distinct()


def detect(strings: DataFrame, sections: DataFrame, imports: DataFrame) -> DataFrame:
    """``binary_id, family, name, confidence, evidence, guidance``; order by confidence and name."""
    spark = strings.sparkSession
    rows = [(f, o, k, n, label, (f, n) == rules.WEAK_MARKER) for f, o, k, n, label in rules.RUNTIME_MARKERS]
    table = spark.createDataFrame(rows, "family string, ord int, kind string, needle string, label string, weak boolean")
    about = spark.createDataFrame([(f, n, g) for f, n, g in rules.RUNTIME_FAMILIES], "family string, name string, guidance string")
    hits = marker_hits(strings, sections, imports).join(F.broadcast(table), ["kind", "needle"])
    by = hits.groupBy("binary_id", "family").agg(F.sort_array(F.collect_list(F.struct("ord", F.concat("label", "suffix").alias("e")))).alias("e"), F.bool_and("weak").alias("weak"))
    by = by.where(~F.col("weak")).select("binary_id", "family", F.transform("e", lambda x: x["e"]).alias("evidence"))
    return by.withColumn("confidence", confidence(F.size("evidence"))).join(F.broadcast(about), "family").select("binary_id", "family", "name", "confidence", "evidence", "guidance")


def confidence(n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(95), 60 + 15 * (n - 1))).cast("int")


def reports(runtimes: DataFrame, strings: DataFrame, sections: DataFrame, imports: DataFrame) -> DataFrame:
    """``binary_id, family, title, summary, artifacts, actions``: fixed texts of each family found, with its markers or evidence."""
    spark = runtimes.sparkSession
    fixed = spark.createDataFrame(
        [(f, summary, detail, [{"label": a, "detail": b} for a, b in actions]) for f, summary, detail, actions in rules.RUNTIME_REPORTS],
        "family string, summary string, evidence_detail string, actions array<struct<label:string,detail:string>>",
    )
    table = [(f, k, n, d) for f, k, n, d in rules.REPORT_MARKERS]
    known = spark.createDataFrame([(f, o, k, n, d) for o, (f, k, n, d) in enumerate(table)], "family string, ord int, kind string, needle string, detail string")
    hits = marker_hits(strings, sections, imports, tuple((f, 0, k, n, d) for f, k, n, d in table if k == "string")).join(F.broadcast(known), ["kind", "needle"])
    marked = hits.select("binary_id", "family", "ord", F.lit(0).alias("at"), F.col("needle").alias("name"), "detail")
    low = X.ascii_lower(F.col("name"))
    named = sections.select("binary_id", "section_ord", "name", F.when(low.contains("snapshot"), "dart_flutter").when(low.contains("gopclntab") | low.contains("go.buildinfo"), "go").alias("family")).where("family is not null")
    detail = F.when(F.col("family") == "go", "Go metadata section").otherwise("Dart/Flutter snapshot-related section")
    marked = marked.unionByName(named.select("binary_id", "family", F.lit(-1).alias("ord"), F.col("section_ord").alias("at"), "name", detail.alias("detail")))
    listed = marked.groupBy("binary_id", "family").agg(F.sort_array(F.collect_list(F.struct("ord", "at", "name", "detail"))).alias("m"))
    out = runtimes.join(F.broadcast(fixed), "family").join(listed, ["binary_id", "family"], "left")
    evidence = F.transform("evidence", lambda e: F.struct(e.alias("name"), F.col("evidence_detail").alias("detail")))
    markers = F.coalesce(F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["detail"].alias("detail"))), F.array().cast("array<struct<name:string,detail:string>>"))
    return out.select("binary_id", "family", F.col("name").alias("title"), "summary", F.when(F.col("evidence_detail") != "", evidence).otherwise(markers).alias("artifacts"), "actions")


def carve_pyc(sections: DataFrame) -> DataFrame:
    """Bytecode candidates: CR LF at 2, a code object's mark at 16; each ends at the next one, 1 MiB on, or the section's end.
    Positions come from the bytes in one Arrow pass, ends from a window."""
    import re

    pattern = re.compile(rb"(?=..\r\n.{12}[\xe3\x63])", re.S)

    @F.pandas_udf("array<bigint>")
    def at(raw: pd.Series) -> pd.Series:
        return pd.Series([[m.start() for m in pattern.finditer(bytes(x or b""))] for x in raw])

    rows = sections.select("binary_id", "section_ord", "name", "virtual_address", "raw", F.octet_length("raw").alias("n"), F.explode(at("raw")).alias("o"))
    w = Window.partitionBy("binary_id", "section_ord").orderBy("o")
    # a candidate inside the one before ends it; the scan goes on from there
    end = F.least(F.coalesce(F.lead("o").over(w), F.col("n")), F.col("o") + 1 + MOST, F.col("n"))
    return rows.withColumn("end", end).select("binary_id", "section_ord", "name", (F.col("virtual_address") + F.col("o")).alias("virtual_address"), (F.col("end") - F.col("o")).alias("size"), F.substring("raw", F.col("o").cast("int") + 1, (F.col("end") - F.col("o")).cast("int")).alias("payload"))


def archive_cookies(sections: DataFrame) -> DataFrame:
    """Every place of the archive cookie, overlaps too."""

    @F.pandas_udf("array<bigint>")
    def at(raw: pd.Series) -> pd.Series:
        out = []
        for x in raw:
            x, found, k = bytes(x or b""), [], -1
            while (k := x.find(MAGIC, k + 1)) >= 0:
                found.append(k)
            out.append(found)
        return pd.Series(out)

    rows = sections.select("binary_id", "section_ord", "name", "virtual_address", F.explode(at("raw")).alias("o"))
    return rows.select("binary_id", "section_ord", "name", (F.col("virtual_address") + F.col("o")).alias("virtual_address"))


def unique_files(artifacts: DataFrame, stem: Column, extension: str) -> DataFrame:
    """File names; the n-th of one name gets _n."""
    named = artifacts.withColumn("_base", X.file_stem(stem))
    w = Window.partitionBy("binary_id", "_base").orderBy("ord")
    n = F.row_number().over(w)
    return named.withColumn("file_name", F.concat("_base", F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(f".{extension}"))).drop("_base")


#: Fixed texts of inventoried markers.
PYTHON_INVENTORY = (
    ("PYZ-00.pyz", "PyInstaller PYZ archive marker"), ("_MEIPASS", "PyInstaller extraction directory marker"), ("pyi_rth", "PyInstaller runtime hook marker"),
    ("Nuitka", "Nuitka native Python compiler marker"), ("__nuitka", "Nuitka native Python compiler marker"),
)
DART_INVENTORY = (
    ("dart:ui", "Flutter dart:ui library marker"), ("Flutter", "Flutter runtime marker"), ("kDartVmSnapshotData", "Dart VM snapshot data marker"),
    ("kDartIsolateSnapshotData", "Dart isolate snapshot data marker"), ("vm_snapshot", "Dart VM snapshot marker"), ("isolate_snapshot", "Dart isolate snapshot marker"),
)


def inventory(runtimes: DataFrame, strings: DataFrame, sections: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """``binary_id, name, kind, status, runtime, source, detail``: rows of markers, and for the other families a row of
    each piece of evidence."""
    spark = runtimes.sparkSession
    table = [("python", m, d) for m, d in PYTHON_INVENTORY] + [("dart", m, d) for m, d in DART_INVENTORY]
    known = spark.createDataFrame(table, "grp string, needle string, detail string")
    hits = marker_hits(strings, sections, imports, tuple(("", 0, "string", m, d) for _, m, d in table), exports).join(F.broadcast(known), "needle")
    grp = F.when(F.col("family").isin("python_packaged", "python_native"), "python").when(F.col("family") == "dart_flutter", "dart").otherwise("other")
    r = runtimes.withColumn("grp", grp)
    fixed = lambda kind, source: (F.lit(kind).alias("kind"), F.lit("inventoried").alias("status"), F.col("runtime"), F.lit(source).alias("source"))
    kind = F.when(F.col("grp") == "python", "python_marker").otherwise("dart_flutter_snapshot").alias("kind")
    marked = r.select("binary_id", "grp", F.col("name").alias("runtime")).join(hits, ["binary_id", "grp"]).select("binary_id", F.col("needle").alias("name"), kind, F.lit("inventoried").alias("status"), "runtime", F.lit("binary markers").alias("source"), "detail")
    evidence = r.where("grp = 'other'").select("binary_id", F.col("name").alias("runtime"), F.explode("evidence").alias("name")).select("binary_id", "name", *fixed("runtime_evidence", "runtime detector"), F.lit("Runtime detector evidence").alias("detail"))
    library = imports.where(X.contains_ignoring_case(F.col("library"), "python")).select("binary_id", F.col("library").alias("name")).distinct()
    python = r.where("grp = 'python'").select("binary_id", F.col("name").alias("runtime")).join(library, "binary_id").select("binary_id", "name", *fixed("python_marker", "imports"), F.lit("Python runtime import").alias("detail"))
    return marked.unionByName(evidence).unionByName(python)

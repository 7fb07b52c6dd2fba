"""API insights, behaviour findings and risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.functions import text as X


def api_rules(spark: SparkSession) -> DataFrame:
    """The rules as a table by full name: 66 names with 9 endings each; of equal names the first rule counts."""
    names: dict[str, tuple] = {}
    for k, (category, severity, summary, words) in enumerate(rules.API_RULES):
        for name in words.split():
            for ending in rules.API_SUFFIXES:
                names.setdefault(name + ending, (name + ending, category, severity, summary, k))
    return spark.createDataFrame(list(names.values()), "fn_key string, category string, severity string, summary string, rule_ord int")


def api_insights(imports: DataFrame) -> DataFrame:
    """Imported functions that a rule names. The rules are a broadcast of fixed size."""
    keyed = imports.withColumns({"lib_key": X.ascii_lower(F.col("library")), "fn_key": X.ascii_lower(F.col("function"))})
    return keyed.join(F.broadcast(api_rules(imports.sparkSession)), "fn_key").withColumn("severity_rank", X.severity_rank(F.col("severity")))


def ranked(findings_: DataFrame) -> DataFrame:
    """Findings with their place (from 1) in the order of reports: the most severe first, then by category and detail."""
    w = Window.partitionBy("binary_id").orderBy(F.desc("severity_rank"), F.asc("category"), F.asc("detail"), F.asc("source"))
    return findings_.withColumn("place", F.row_number().over(w).cast("long"))


def findings(insights: DataFrame, suspicious: DataFrame, runtimes: DataFrame | None = None) -> DataFrame:
    """``binary_id, source, category, severity, severity_rank, detail`` of imports, strings and sure runtimes."""
    api = insights.select("binary_id", F.lit("import_table").alias("source"), "category", "severity", F.concat("library", F.lit("!"), "function", F.lit(" - "), "summary").alias("detail"))
    category, severity = X.string_behavior(F.col("category"))
    shown = F.concat(X.string_symbol(F.col("address")), F.lit(" @ 0x"), F.hex("address"), F.lit(": "), "value")
    string = suspicious.select("binary_id", F.lit("string").alias("source"), category.alias("category"), severity.alias("severity"), shown.alias("detail"))
    out = api.unionByName(string)
    if runtimes is not None:
        told = F.concat("name", F.lit(" ("), F.col("confidence").cast("string"), F.lit("%)"))
        out = out.unionByName(runtimes.where("confidence >= 70").select("binary_id", F.lit("runtime_detector").alias("source"), F.lit("runtime_packaging").alias("category"), F.lit("low").alias("severity"), told.alias("detail")))
    return out.withColumn("severity_rank", X.severity_rank(F.col("severity")))


def categories(findings_: DataFrame) -> DataFrame:
    """By category: the highest severity, the number of findings, and their details in finding order."""
    out = findings_.groupBy("binary_id", "category").agg(
        F.max("severity_rank").alias("severity_rank"),
        F.count("*").alias("n_findings"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("severity_rank")).alias("r"), "detail"))), lambda x: x["detail"]).alias("evidence"),
    )
    severity = F.when(F.lit(False), "")
    for name, rank in rules.SEVERITY_RANK.items():
        severity = severity.when(F.col("severity_rank") == rank, name)
    return out.withColumn("severity", severity)


def risk(findings_: DataFrame) -> DataFrame:
    """Score and level of each binary: what its categories weigh, and up to four strings, two points each."""
    by = findings_.groupBy("binary_id", "category").agg(F.max("severity_rank").alias("r"), F.count_if(F.col("source") == "string").alias("strings"))
    out = by.groupBy("binary_id").agg(F.sum(X.severity_weight(F.col("r"))).alias("w"), F.sum("strings").alias("strings"), F.max("r").alias("top"))
    score = F.least(F.col("w") + 2 * F.least(F.col("strings"), F.lit(4)), F.when(F.col("top") == 3, 100).otherwise(69)).cast("int")
    return out.select("binary_id", score.alias("score"), X.risk_level(score).alias("level"))

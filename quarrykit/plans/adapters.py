"""The provided tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = 1 << 24
#: Names given to imports: some that rules know, some that they don't.
API_NAMES = (
    "CreateRemoteThread WriteProcessMemory OpenProcess InternetOpen HttpSendRequest send RegOpenKey RegSetValue CreateProcess ShellExecute CreateFile ReadFile VirtualAlloc"
    " LoadLibrary GetProcAddress IsDebuggerPresent CryptEncrypt OpenService SendMessage OpenProcessToken SystemParametersInfoForDpi lstrlen GetTickCount CloseHandle"
).split()
API_ENDINGS = ("", "A", "W", "Ex", "ExW")
#: Encoded values, so that every signal is met.
ENCODED = (
    "SGVsbG8sIHdvcmxkIQ==", "4D5A90000300000004000000FFFF0000", "https%3A%2F%2Fevil.test%2Fpayload", "H4sIAAAAAAAAAPNIzcnJBwCCidH3BQAAAA==", "eJzLSM3JyQcABiwCFQ==",
    "\\x48\\x65\\x6c\\x6c\\x6f", "kernel32.dll", "powershell -nop", "cmd.exe /c dir", "my_password=1", "HKLM\\Software\\Run", "CreateFileW", "  4d:5a:90:00:03:00:00:00:ff  ", "aGVsbG8td29ybGRfXw==",
)
RUNTIME_LIBRARIES = ("python311.dll", "mscoree.dll", "node.dll", "jvm.dll", "kernel32.dll")
RUNTIME_PROBES = ("PYZ-00.pyz", "_MEIPASS2", "Go build ID: x", "runtime.main", "java/lang/Object", "core::panicking::panic", "dart:ui", "BSJB v4", "#~", "app.asar", "Py_Initialize")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents, urls of pages, and the encoded values as binary -1."""
    words = F.filter(F.split("text", "[ \n\t\r]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("binary_id"), F.posexplode(words).alias("pos", "value"))
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("binary_id"), F.lit(PLACE - 1).alias("pos"), F.col("url").alias("value"))
    fixed = spark.createDataFrame([(-1, k, v) for k, v in enumerate(ENCODED)], "binary_id long, pos int, value string")
    rows = docs.unionByName(urls).unionByName(fixed)
    address = F.when(F.col("binary_id") < 0, F.col("pos").cast("long")).otherwise(F.col("binary_id") * PLACE + F.col("pos"))
    return rows.select("binary_id", F.lit(0).alias("section_ord"), address.alias("address"), "value", F.lit("Ascii").alias("encoding"), F.length("value").cast("long").alias("length"))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as its instruction stream."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    e = e.select(F.col("user_id").alias("binary_id"), F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("seq"), F.count("*").over(w).alias("n"), (F.col("event_id") * 16).alias("address"), (F.lit(1) + F.col("event_id") % 15).cast("int").alias("length"), "event_type", "k")
    name = F.when(F.col("event_type") == "view", "mov").when(F.col("event_type") == "click", "cmp").when(F.col("event_type") == "error", "jne").when(F.col("event_type") == "purchase", "call").otherwise("ret")
    e = e.withColumn("mnemonic", name).withColumn("_t", F.when(F.col("mnemonic").isin("jne", "call"), F.lit(1) + F.col("k") % F.col("n")))
    at = e.select("binary_id", F.col("seq").alias("_t"), F.col("address").alias("target"))
    pick = F.col("k") % 4
    operands = F.when(F.col("mnemonic") == "mov", F.when(pick == 0, "rax,rcx").when(pick == 1, "ecx,5").when(pick == 2, "[rbp-8],rdx").otherwise("r8,[rcx]")).when(F.col("mnemonic") == "cmp", F.when(pick < 2, "rdx,0").otherwise("eax,r9d")).otherwise("")
    return e.join(at, ["binary_id", "_t"], "left").select("binary_id", "seq", F.lit("x86").alias("isa"), "address", "length", "mnemonic", operands.alias("operands"), "target")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, ends = F.array(*map(F.lit, API_NAMES)), F.array(*map(F.lit, API_ENDINGS))
    name = F.concat(F.get(names, (F.col("p_partkey") % len(API_NAMES)).cast("int")), F.get(ends, (F.col("p_partkey") % len(API_ENDINGS)).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("binary_id"), F.col("p_brand").alias("library"), name.alias("function"), (F.col("p_partkey") * 8).alias("address"), F.col("p_partkey").alias("ord"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit(0).alias("binary_id"), F.col("l_suppkey").alias("function_address"), F.col("l_partkey").alias("target_address"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("site"), F.lit(None).cast("string").alias("target_name"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of one binary a source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    body = F.regexp_replace("text", "\n", "\0")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("binary_id"), F.col("doc_id").alias("section_ord"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("name"), (F.col("doc_id") * PLACE).alias("virtual_address"),
        F.octet_length("text").cast("long").alias("size"), body.cast("binary").alias("raw"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_data"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_executable"),
    )

"""Chat formatting by prefix-target expansion (native).

Each assistant turn becomes an example: all turns before it as context, that reply as target, and a loss span of code
points that covers the reply's text alone. Turns after the last reply come as one more example with an empty span, so
no turn is lost.

A turn is written ``### role:``, newline, text, ``</turn>``, newline. Inside roles and texts the template's characters are
coded, always as a backslash and a letter (``\\`` is ``\\b``, ``#`` is ``\\h``, ``<`` is ``\\l``; in roles ``:`` is ``\\c``), so that no
text can hold a control string, and decoding is exact.

One shuffle, by conversation. The expansion itself is a generator: an example's text is built in the row that leaves
it. Defined results: null roles and texts are empty; turns that tie are taken by role, then text; repeated rows are
repeated turns; null ids form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the format.
CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
END = "</turn>\n"


def _coded(text: Column, codes=CODES[:3]) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def decoded(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows ``conv_id, example, target_turn, text, loss_start, loss_chars``; spans count code points from 0."""
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit("### "), _coded(F.col("role"), CODES), F.lit(":\n"))
    said = said.select("conv_id", F.struct("turn", "role", "text", F.length(head).alias("head"), F.concat(head, _coded(F.col("text")), F.lit(END)).alias("shown")).alias("t"))
    convs = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.select("conv_id", F.transform("ts", lambda t: t["shown"]).alias("shown"), F.transform("ts", lambda t: F.struct(t["turn"].alias("turn"), (t["role"] == "assistant").alias("reply"), t["head"].alias("head"))).alias("about"))
    rows = convs.select("conv_id", "shown", F.size("about").alias("n"), F.posexplode("about").alias("i", "a")).where(F.col("a.reply") | (F.col("i") == F.col("n") - 1))
    context = F.array_join(F.slice("shown", F.lit(1), F.col("i")), "")
    rows = rows.select("conv_id", F.col("i").alias("example"), "a", context.alias("context"), F.get("shown", F.col("i")).alias("last"))
    span = F.length("last") - F.col("a.head") - len(END)
    return rows.select(
        "conv_id",
        "example",
        F.when(F.col("a.reply"), F.col("a.turn")).alias("target_turn"),
        F.concat("context", "last").alias("text"),
        F.when(F.col("a.reply"), F.length("context") + F.col("a.head")).otherwise(0).alias("loss_start"),
        F.when(F.col("a.reply"), span).otherwise(0).alias("loss_chars"),
    )


def parsed(text: Column) -> Column:
    """The turns that a formatted text holds: an array of (role, text)."""
    parts = F.filter(F.split(text, END), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decoded(F.substring_index(F.substring(p, 5, 1 << 30), ":\n", 1)).alias("role"), decoded(F.substr(p, F.instr(p, ":\n") + 2)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """A digest of each conversation, from the formatted examples alone."""
    under = decoded(F.substr("text", F.col("loss_start") + 1, F.col("loss_chars")))
    convs = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.struct("example", under.alias("t")))).alias("loss"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    convs = convs.select("conv_id", parsed(F.col("longest")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["t"]), "").alias("loss"), "formatted_chars")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark, sf_dir: str) -> DataFrame:
    probe = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe.alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(expand(turns.unionByName(extra)))


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') txt from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (select *, 14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(txt) + length(regexp_replace(txt, '[^\\#<]', '', 'g')) n from t),
s as (select *, sum(n) over (partition by conv_id order by turn, role, txt rows unbounded preceding) upto,
  row_number() over (partition by conv_id order by turn desc, role desc, txt desc) back from e)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by turn, role, txt)) turns_sha256,
  coalesce(sum(length(txt)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(txt, '' order by turn, role, txt) filter (role = 'assistant'), '')) loss_sha256,
  coalesce(sum(upto) filter (role = 'assistant' or back = 1), 0)::bigint formatted_chars
from s group by conv_id
"""

"""Quality rules as a bitmask ledger (native).

``ledger`` measures every text once and stores one failure bit a rule beside the measurements. Policies are versioned
masks over these bits, so that a policy change or an ablation reads only the ledger: ``apply_policy`` is one bitwise
AND a row, ``ablation`` groups by the mask (at most ``2 ** len(RULES)`` groups, combined before the shuffle).

There is no Python in ``ledger``. Texts of up to ``LONG`` bytes are measured in their row, without a shuffle. Longer ones are parted
into pieces that end with a word (or a line), and their words and lines are rows that are counted by the text's digest, so no
row and no task holds all windows of a text, however long it is.

Defined results: a null or empty text has no words, all measurements 0, and fails ``min_words``; null ids and repeated rows pass
through row by row; an empty table gives an empty ledger; columns of the input may have any names: those that ``keep`` does not
name are gone, and a kept one that is named like one of the ledger's comes out with ``_kept`` after its name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
PLACE_BITS = 24
#: Bytes of a text that is measured in its row, and characters of a piece of a longer one.
LONG, PIECE = 1 << 20, 1 << 18
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_ellipsis_lines", "n_bullet_lines")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


#: Bits are never given to another rule: stored ledgers stay readable. Thresholds are those published for web text.
RULES = (
    Rule(0, "min_words", lambda: _c("n_words") < 50),
    Rule(1, "repeated_trigrams", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule(2, "max_words", lambda: _c("n_words") > 100_000),
    Rule(3, "mean_word_length", lambda: (_c("word_chars") < 3 * _c("n_words")) | (_c("word_chars") > 10 * _c("n_words"))),
    Rule(4, "symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule(5, "duplicate_lines", lambda: 100 * _c("n_dup_lines") > 30 * _c("n_lines")),
    Rule(6, "alphabetic_words", lambda: 100 * _c("n_alpha_words") < 80 * _c("n_words")),
    Rule(7, "ellipsis_lines", lambda: 100 * _c("n_ellipsis_lines") > 30 * _c("n_lines")),
    Rule(8, "bullet_lines", lambda: 100 * _c("n_bullet_lines") > 90 * _c("n_lines")),
)


def mask(*names: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


#: A document is kept under a version if none of the version's bits is set.
POLICIES = {
    "base-1": mask("min_words", "repeated_trigrams"),
    "web-1": mask(*(r.name for r in RULES)),
    # length alone rejects no text: the bit of max_words only measures
    "web-2": mask(*(r.name for r in RULES if r.name != "max_words")),
}
PRODUCTION = "web-2"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body has it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _hashed_windows(words: Column) -> Column:
    """For each three-word window 40 bits of hash above 24 bits of place (more than a text of ``LONG`` bytes has)."""
    n = F.size(words)
    at = F.when(n > 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))


def _neighbours(sorted_: Column, same: Callable[[Column, Column], Column], places: Callable[[Column, Column], Column]) -> Column:
    """The distinct places of equal neighbours in a sorted array."""
    n = F.greatest(F.size(sorted_) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(sorted_, F.lit(1), n), F.slice(sorted_, F.lit(2), n), lambda a, b: F.when(same(a, b), places(a, b)))
    return F.array_distinct(F.flatten(F.array_compact(pairs)))


def _candidates(hashes: Column) -> Column:
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")
    return _neighbours(
        hashes,
        lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), PLACE_BITS) == 0,
        lambda a, b: F.array(a.bitwiseAND(place).cast("int"), b.bitwiseAND(place).cast("int")),
    )


def _repeats(words: Column, places: Column) -> Column:
    """Words covered by windows that stand at two of ``places`` or more: these windows, as text, are sorted and equal
    neighbours cover three words each."""

    def keyed(w: Column) -> Column:
        return F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i"))))

    covered = lambda s: F.size(
        _neighbours(s, lambda a, b: a["k"] == b["k"], lambda a, b: F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2))
    )
    return F.when(F.size(places) > 0, _let(words, lambda w: _let(keyed(w), covered))).otherwise(0)


def _alpha(text: Column) -> Column:
    """Words with a letter: each is one match, from its first letter to its end."""
    return F.regexp_count(text, F.lit(r"\p{L}[^\x20\x09-\x0D]*"))


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]"))


def _ellipsis(line: Column) -> Column:
    return F.rtrim(line).rlike(r"(\.\.\.|…)$")


def _bullet(line: Column) -> Column:
    return F.substring(F.ltrim(line), 1, 1).isin("-", "*", "•", "‣", "◦")


def _with_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def _in_row(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and measurements of texts ``_x`` that their rows can hold as arrays."""
    body = F.coalesce("_x", F.lit(""))
    words = F.when(F.btrim(body, F.lit(BLANK)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(body, F.lit(BLANK)), SPACE))
    cut = rows.select(*keep, body.alias("_t"), words.alias("_w"), F.filter(F.split(body, "\n"), _with_word).alias("_l"))
    cut = cut.select("*", F.sort_array(_hashed_windows(F.col("_w"))).alias("_h"))
    cut = cut.select("*", _candidates(F.col("_h")).alias("_p"))
    return cut.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _symbols(F.col("_t")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeats(F.col("_w"), F.col("_p")).cast("long").alias("n_repeat_words"),
        _alpha(F.col("_t")).cast("long").alias("n_alpha_words"),
        F.size(F.filter("_l", _ellipsis)).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_l", _bullet)).cast("long").alias("n_bullet_lines"),
    )


def _by_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The same of longer texts: equal ones are measured once, by their digest."""
    keyed = rows.withColumn("_d", F.sha2("_x", 256))
    texts = keyed.groupBy("_d").agg(F.first("_x").alias("_x"))

    def parts(rest: str, split: str) -> DataFrame:
        """The words or lines of each text in order (piece, pos)."""
        pieces = F.regexp_extract_all("_x", F.lit(f"(?s).{{1,{PIECE}}}{rest}*"), F.lit(0))
        cut = texts.select("_d", F.posexplode(pieces).alias("piece", "t"))
        return cut.select("_d", "piece", F.posexplode(F.split("t", split, -1)).alias("pos", "v"))

    # what is asked of a word comes before the shuffle; a long word is compared by its digest
    words = parts(r"[^\x20\x09-\x0D]", SPACE).where("v <> ''")
    words = words.select("_d", "piece", "pos", F.when(F.length("v") > 64, F.sha2("v", 256)).otherwise(F.col("v")).alias("w"), F.length("v").alias("chars"), F.col("v").rlike(r"\p{L}").alias("alpha"))
    order = Window.partitionBy("_d").orderBy("piece", "pos")
    windows = words.withColumn("k", F.array("w", F.lead("w", 1).over(order), F.lead("w", 2).over(order)))
    full = F.get("k", F.lit(2)).isNotNull()
    windows = windows.withColumn("same", F.count("*").over(Window.partitionBy("_d", "k")) > 1).withColumn("hit", full & F.col("same"))
    covered = F.col("hit") | F.coalesce(F.lag("hit", 1).over(order), F.lit(False)) | F.coalesce(F.lag("hit", 2).over(order), F.lit(False))
    by_word = windows.withColumn("covered", covered).groupBy("_d").agg(
        F.count("*").alias("n_words"), F.sum("chars").cast("long").alias("word_chars"), F.count_if("covered").alias("n_repeat_words"), F.count_if("alpha").alias("n_alpha_words")
    )
    lines = parts(r"[^\n]", "\n")
    # a piece after the first begins with the break that ended the one before
    lines = lines.where((F.col("piece") == 0) | (F.col("pos") > 0)).where(_with_word(F.col("v")))
    lines = lines.select("_d", F.when(F.length("v") > 64, F.sha2("v", 256)).otherwise(F.col("v")).alias("w"), _ellipsis(F.col("v")).alias("e"), _bullet(F.col("v")).alias("b"))
    by_line = lines.groupBy("_d", "w", "e", "b").agg(F.count("*").alias("n")).groupBy("_d").agg(
        F.sum("n").alias("n_lines"), F.sum(F.col("n") - 1).alias("n_dup_lines"), F.sum(F.when(F.col("e"), F.col("n")).otherwise(0)).alias("n_ellipsis_lines"), F.sum(F.when(F.col("b"), F.col("n")).otherwise(0)).alias("n_bullet_lines")
    )
    told = texts.select("_d", _symbols(F.col("_x")).cast("long").alias("n_symbols")).join(by_word, "_d", "left").join(by_line, "_d", "left")
    told = told.select("_d", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES])
    return keyed.select("_d", *keep).join(told, "_d").select(*keep, *MEASURES)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: ``keep``, every measurement, and ``failure_bits`` (bit r set: rule r fails)."""
    held = [f"_keep{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)], F.col(f"`{text}`").alias("_x"))
    long = F.coalesce(F.octet_length("_x"), F.lit(0)) > LONG
    measured = _in_row(rows.where(~long), held).unionByName(_by_rows(rows.where(long), held))
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    taken = {*MEASURES, "failure_bits", "policy", "kept"}
    return measured.withColumn("failure_bits", bits).withColumnsRenamed({h: f"{c}_kept" if c in taken else c for c, h in zip(keep, held)})


def apply_policy(table: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The ledger with ``policy`` and ``kept``; ``kept`` never is null."""
    return table.withColumn("policy", F.lit(version)).withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def kept(docs: DataFrame, version: str = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a version keeps, with their columns. The ledger passes through a generator, which no filter
    is pushed below: the rules are evaluated once a row."""
    columns = [f"_in{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*columns)
    held = ledger(own, columns[docs.columns.index(text)], tuple(columns))
    held = held.select(F.inline(F.array(F.struct(*columns, "failure_bits"))))
    return apply_policy(held, version).where("kept").select(*columns).toDF(*docs.columns)


def ablation(table: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """For each rule of a version: documents that fail it, that fail only it (what removing the rule would keep), and
    what the version keeps without it. Only masks and counts move."""
    held = POLICIES[version]
    groups = table.groupBy(F.col("failure_bits").bitwiseAND(F.lit(held).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if held >> r.bit & 1]
    out = groups.select("bits", "n", F.explode(F.array(*each)).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return out.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    held = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failure_bits").bitwiseAND(F.lit(POLICIES["base-1"]).cast("long")) != 0
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failure_bits")


ORACLE = r"""
with t as (select row_number() over () r, doc_id, coalesce(text, '') s from documents),
w as (select *, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
      list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from t),
win as (select r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] k from (select r, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)),
rep as (select r, i from (select r, i, count(*) over (partition by r, k) c from win) where c > 1),
cov as (select r, count(distinct p) n from (select r, unnest([i, i + 1, i + 2]) p from rep) group by r),
m as (select w.r, doc_id, len(w)::bigint n_words, length(list_aggregate(list_concat(w, ['']), 'string_agg', ''))::bigint word_chars,
      len(regexp_extract_all(s, '[#*$%&|<>]'))::bigint n_symbols, len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
      coalesce(cov.n, 0)::bigint n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}')))::bigint a,
      len(list_filter(l, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$')))::bigint e, len(list_filter(l, lambda x: ltrim(x)[1] in ('-', '*', '•', '‣', '◦')))::bigint b
      from w left join cov on cov.r = w.r),
f as (select *, case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
      + case when n_words > 100000 then 4 else 0 end + case when word_chars < 3 * n_words or word_chars > 10 * n_words then 8 else 0 end
      + case when 10 * n_symbols > n_words then 16 else 0 end + case when 100 * n_dup_lines > 30 * n_lines then 32 else 0 end
      + case when 100 * a < 80 * n_words then 64 else 0 end + case when 100 * e > 30 * n_lines then 128 else 0 end
      + case when 100 * b > 90 * n_lines then 256 else 0 end failure_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 base_failed, failure_bits & ~4 = 0 kept, failure_bits::bigint failure_bits from f
"""

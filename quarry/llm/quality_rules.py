"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
named, versioned mask over those bits, so any number of policies is applied later without reading a text again, and
ablations (what each rule rejects, and what it alone rejects) are one bitwise aggregation over the ledger.

Defined cases: a null text counts as empty (no words, lines or symbols) and fails the word rule; empty texts likewise;
repeated rows each get their own row; ties cannot arise; texts of any length are measured whole; an empty table gives an empty
ledger. Only doc_id and text are read, so further columns may carry any name. Equal 8-word windows are found by their 64-bit hashes. There is no shuffle: all work is within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as C

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Bits of the ledger, lowest first.
RULES = ("few_words", "repeated_words", "short_words", "long_words", "symbols", "duplicate_lines", "upper_case", "few_letters", "stutter")
#: Versioned policies: the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "duplicate_lines"),
    "web-2": RULES,
}
POLICY = "web-2"


def mask_of(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row: a lambda variable, which the optimizer can't copy."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside the n-word windows that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def spread(s: Column) -> Column:
            same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            at = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, spread))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(let(windows, covered))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measure(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and the measurements that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.filter(F.split(F.col("t"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    words = let(split, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("long").alias("n_stutter")))
    gone = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    return (
        docs.select(*keys, text.alias("t"))
        .select(
            *keys,
            words.alias("w"),
            gone(r"[\x20\x09-\x0D]+").cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            duplicate_lines(F.col("t")).alias("n_dup_lines"),
            F.size(F.filter(F.split("t", "\n", -1), lambda x: x != "")).cast("long").alias("n_lines"),
            gone(r"[^\p{Lu}]+").cast("long").alias("n_upper"),
            gone(r"[^\p{L}]+").cast("long").alias("n_letters"),
        )
        .select(*keys, "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.n_stutter", "n_lines", "n_upper", "n_letters")
    )


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and `failed_bits`, one bit for each of RULES."""
    c = F.col
    failed = {
        "few_words": c("n_words") < 20,
        "repeated_words": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 16 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 60 * c("n_lines"),
        "upper_case": 100 * c("n_upper") > 30 * c("n_letters"),
        "few_letters": 10 * c("n_letters") < 6 * c("word_chars"),
        "stutter": 100 * c("n_stutter") > 50 * c("n_words"),  # words equal to the one before
    }
    bits = sum((F.when(failed[r], F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)), F.lit(0))
    return measure(docs, keys).withColumn("failed_bits", bits.cast("int"))


def verdicts(rows: DataFrame, policies: tuple[str, ...] = (POLICY,)) -> DataFrame:
    """The ledger with one boolean `kept_<policy>` for each policy."""
    return rows.withColumns({f"kept_{p}": F.col("failed_bits").bitwiseAND(mask_of(p)) == 0 for p in policies})


def ablation(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: the documents that it fails, and those that only it rejects (kept if it is left out).

    One aggregation over distinct bit patterns (at most 2**rules), then one row per rule."""
    mask = mask_of(policy)
    hit = F.col("failed_bits").bitwiseAND(mask)
    groups = rows.groupBy(hit.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in POLICIES[policy]])).alias("r")
    return (
        groups.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit").groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(ledger(C.table(spark, sf_dir, "documents")))
    base = F.col("failed_bits").bitwiseAND(mask_of("base-1")) != 0
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col(f"kept_{POLICY}")).alias("kept"), F.col("failed_bits"),
    )


_KEPT = "10 * n_symbols <= n_words AND word_chars >= 2 * n_words AND word_chars <= 16 * n_words AND 100 * n_dup_lines <= 60 * n_lines AND 100 * n_upper <= 30 * n_letters AND 10 * n_letters >= 6 * word_chars AND 100 * n_stutter <= 50 * n_words"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM d),
wins AS (SELECT doc_id, p, array_to_string(ws[p : p + 7], ' ') AS k FROM s, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 6, 1))) AS p) WHERE len(ws) >= 8),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM wins) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - p, 8))) AS n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda w, i: i > 1 AND w = ws[i - 1])) AS n_stutter, len(list_filter(string_split(t, chr(10)), lambda x: x <> '')) AS n_lines,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters
  FROM s LEFT JOIN cov ON s.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND {_KEPT}) AS kept,
  ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 16 * n_words)::INT
   + 16 * (10 * n_symbols > n_words)::INT + 32 * (100 * n_dup_lines > 60 * n_lines)::INT + 64 * (100 * n_upper > 30 * n_letters)::INT + 128 * (10 * n_letters < 6 * word_chars)::INT + 256 * (100 * n_stutter > 50 * n_words)::INT)::INT AS failed_bits
FROM m
"""


def keep(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The documents that the policy and the base rules keep; rows and columns pass unchanged, without a join.

    The row number is a guard: a filter isn't pushed below a non-deterministic column, where each use of a measurement
    would evaluate it again."""
    row, guard = "__quarry_row", "__quarry_guard"
    rows = docs.select(F.struct(*docs.columns).alias(row), F.col("text")).withColumn(guard, F.monotonically_increasing_id())
    led = ledger(rows, (row, guard))
    ok = F.col("failed_bits").bitwiseAND(mask_of(policy) | mask_of("base-1")) == 0
    return led.where(ok & (F.col(guard) >= 0)).select(f"{row}.*")

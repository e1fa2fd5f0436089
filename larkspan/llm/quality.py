"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once.  The ledger keeps, per document, the
measurements and one bit per failed rule; a policy is a versioned mask over
those bits, so applying another version, or asking what a rule alone costs, is
bitwise arithmetic over the stored ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: space and the controls 9 to 13.
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements; ``bit`` never changes its meaning."""

    bit: int
    name: str
    failed: Callable[[], Column]


RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 10),
    Rule(1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule(2, "symbols", lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words")),
    Rule(3, "repeated_lines", lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    Rule(4, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(5, "long_words", lambda: F.col("word_chars") > 40 * F.col("n_words")),
)
#: The two rules of the base, whatever the policy.
BASE_MASK = 0b11
#: Policies by version: the rules that count.
POLICIES = {1: 0b000111, 2: 0b111111}
CURRENT_POLICY = 2


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words per row.

    Words are runs of characters other than space and the controls 9 to 13.
    ``n_lines`` counts lines with a word; ``n_dup_lines`` those among them that
    equal an earlier one.  ``n_repeat_words`` counts the words that lie in a
    5-word window found at least twice in the text; windows are compared by
    64-bit hashes of their words' 64-bit hashes.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Each array is a column of its own before a lambda looks into it: it is then built once a row.
    split = rows.select(
        "doc_id",
        (F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, _BLANKS, "")) > 0).alias("lines"),
        F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"),
    )
    windows = split.select(
        "doc_id",
        "n_symbols",
        "word_chars",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 4, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2), F.get("words", i + 3), F.get("words", i + 4))).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = windows.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit(None))).drop("windows")
    at = lambda i: F.get("ordered", i)["h"]
    found = F.filter(F.transform("ordered", lambda x, k: F.when(x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)), x["i"])), lambda p: p.isNotNull())
    starts = ordered.withColumn("starts", F.sort_array(found)).drop("ordered")
    covered = F.aggregate(F.transform("starts", lambda p, k: F.least(F.coalesce(F.get("starts", k + 1) - p, F.lit(5)), F.lit(5))), F.lit(0), lambda a, n: a + n)
    return starts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and ``fail_bits``, one bit per rule that a row fails.

    A null text counts as the empty one: no words, so ``few_words`` fails.
    Null ids and repeated rows are kept, an empty table stays empty, other
    columns are ignored.
    """
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.failed(), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    mask = POLICIES[version] | BASE_MASK
    return ledger.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0,
        "policy": F.lit(version),
    })


def ablations(ledger: DataFrame, version: int = CURRENT_POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails (kept without it).

    Rows are first counted by their failure mask, so what follows handles at
    most ``2 ** len(rules)`` rows.
    """
    mask = POLICIES[version]
    masks = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    table = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in rules if mask >> r.bit & 1])
    each = masks.select("m", "n", F.explode(table).alias("r")).select("m", "n", "r.rule", "r.b")
    hit = F.col("m").bitwiseAND(F.col("b")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("b"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not(F.col("b"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )

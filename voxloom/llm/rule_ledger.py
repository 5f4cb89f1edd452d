"""Quality rules as a ledger of failure bits, in DataFrame functions only.

Every rule is evaluated once and leaves one bit; measurements stay beside the
bits.  A policy is a versioned set of bits, so applying, comparing or ablating
policies reads the ledger and never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.support import materialize

_BLANK = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: name and the condition that fails a text, over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("upper_case", "2 * n_upper > word_chars"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: the bits that reject a text.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["upper_case"],
    "v2": BASE | BIT["symbols"] | BIT["upper_case"] | BIT["short_words"] | BIT["long_words"] | BIT["few_letters"],
    "v3": sum(BIT.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]


def _repeat_words(grams: Column) -> Column:
    """Words in runs of three found twice or more, from the sorted (hash, position) pairs."""
    again = F.filter(grams, lambda g, i: (
        F.get(grams, i - 1)["h"].eqNullSafe(g["h"]) | F.get(grams, i + 1)["h"].eqNullSafe(g["h"])))
    return F.sort_array(F.transform(again, lambda g: g["i"]))


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the measurements of each text as longs, named ``prefix`` plus ``MEASURES``.

    n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``),
    n_lines (lines with a word), n_dup_lines (of these, equal to an earlier
    one), n_repeat_words (words in three-word runs that occur twice or more),
    n_upper and n_letters.  A null or empty text measures 0 throughout.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, _BLANK), "")
    # each step is a column of its own and is used more than once below, so it is computed once
    step = docs.withColumn("__ledger_w", words)
    runs = F.transform(F.slice("__ledger_w", 1, F.greatest(F.size("__ledger_w") - 2, F.lit(0))), lambda w, i: F.struct(
        F.xxhash64(w, F.get("__ledger_w", i + 1), F.get("__ledger_w", i + 2)).alias("h"), i.alias("i")))
    step = step.withColumn("__ledger_g", F.sort_array(runs))
    step = step.withColumn("__ledger_p", _repeat_words(F.col("__ledger_g")))
    covered = F.aggregate(
        F.col("__ledger_p"), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("__ledger_l", lines)
    letters = F.regexp_replace(body, r"\P{L}+", "")
    values = {
        "n_words": F.size("__ledger_w"),
        "word_chars": F.char_length(F.translate(body, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.char_length(body) - F.char_length(F.translate(body, _SYMBOLS, "")),
        "n_lines": F.size("__ledger_l"),
        "n_dup_lines": F.size("__ledger_l") - F.size(F.array_distinct("__ledger_l")),
        "n_repeat_words": covered,
        "n_upper": F.char_length(F.regexp_replace(body, r"\P{Lu}+", "")),
        "n_letters": F.char_length(letters),
    }
    # a generator of one row: filters on the measurements stay above it, else they would repeat every step per word
    made = F.struct(*[c.cast("long").alias(prefix + n) for n, c in values.items()])
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return step.select(*kept, F.inline(F.array(made)))


def failure_bits(prefix: str = "") -> Column:
    """The bitmask of failed rules over columns that ``measure`` added."""
    bits = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        if prefix:
            for name in MEASURES:
                condition = condition.replace(name, prefix + name)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, all measurements and ``failed`` (bit k set: rule k of ``RULES`` fails); one row per input row.

    Null ids and repeated rows pass through; other input columns are dropped.
    """
    return measure(docs.select("doc_id", "text")).drop("text").withColumn("failed", failure_bits())


def store(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs`` as a table in the shared folder: texts are read once, policies and ablations read this."""
    return materialize(ledger(docs))


def passes(policy: str, failed: str = "failed") -> Column:
    """True where the ledger's bits hold none that the policy rejects."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policies(entries: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """Add one boolean ``kept_<policy>`` per policy to a ledger."""
    return entries.withColumns({f"kept_{p}": passes(p) for p in policies or list(POLICIES)})


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """How many texts each rule rejects, rejects alone, and how many stay without it: (rule, failed, alone, kept).

    The ledger is first counted by bitmask (at most 2**len(RULES) rows). A text is rejected alone by a rule if no
    other rule of the policy fails it. An empty ledger gives no rows.
    """
    mask = POLICIES[policy]
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))
    rules = [(name, bit, mask & ~bit) for name, bit in BIT.items() if mask & bit]
    each = F.explode(F.array(*[F.struct(
        F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"), F.lit(rest).cast("long").alias("rest"))
        for name, bit, rest in rules]))
    on = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    clear = F.col("failed").bitwiseAND(F.col("r.rest")) == 0
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return (counts.withColumn("r", each).groupBy(F.col("r.rule").alias("rule"))
            .agg(total(on).alias("failed"), total(on & clear).alias("alone"), total(clear).alias("kept")))

"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``evaluate_rules`` measures every text once and stores one bit per failed rule; ``apply_policy`` turns the ledger
into verdicts for a versioned policy (a set of rules), and ``ablation`` computes what each rule alone decides by
bitwise aggregation of the stored masks, without reading a text again.

Defined results: a null text counts as empty (no words, no lines); an empty table gives an empty ledger; repeated
rows are judged one by one; columns of the input other than the text are carried through under their own names, but one
with the name of a ledger or verdict column, as ``n_words``, becomes ``n_words_input``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.columns import set_aside

#: Bit of each rule in ``failed_bits``.
RULES: Mapping[str, int] = {
    "too_few_words": 0,
    "repeated_words": 1,
    "too_many_words": 2,
    "word_length": 3,
    "symbol_ratio": 4,
    "duplicate_lines": 5,
    "no_lower_case": 6,
    "pipe_table": 7,
}
#: Rules of each policy version; the base rules belong to all of them.
BASE = ("too_few_words", "repeated_words")
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "word_length", "symbol_ratio", "duplicate_lines"),
    "v2": (*BASE, "too_many_words", "word_length", "symbol_ratio", "duplicate_lines", "no_lower_case", "pipe_table"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_pipes", "has_lower", "failed_bits")
_SPACES = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once: a lambda's variable is not inlined by the optimiser."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    spaced = text
    for c in _SPACES:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _covered(words: Column) -> Column:
    """Words in three-word windows that occur at least twice: sort (window, place), flag equal neighbours, unite places."""

    def flag(ranked: Column) -> Column:
        def same(i: Column) -> Column:
            here = F.get(ranked, i)["g"]
            return F.coalesce(here == F.get(ranked, i - 1)["g"], F.lit(False)) | F.coalesce(here == F.get(ranked, i + 1)["g"], F.lit(False))

        flagged = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), same)
        places = F.sort_array(F.transform(flagged, lambda i: F.get(ranked, i)["p"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        )["n"]

    def windows(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p")),
        )
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_let(F.sort_array(grams), flag))

    return _let(words, windows)


def _measures(text: Column) -> Column:
    """One struct of measurements per text; the word array is built once."""
    bare = text
    for c in _SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" " + _SPACES))) > 0)

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(bare)).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
            _covered(w).alias("n_repeat_words"),
            (F.char_length(text) - F.char_length(F.replace(text, F.lit("|"), F.lit("")))).cast("long").alias("n_pipes"),
            (F.upper(text) != text).alias("has_lower"),
        )

    return _let(_words(text), measured)


def _failures() -> dict[str, Column]:
    """Each rule's failure in whole numbers, so that every engine agrees on it."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "too_few_words": n < 50,
        "repeated_words": F.col("n_repeat_words") * 100 > n * 50,
        "too_many_words": n > 100_000,
        "word_length": (chars < n * 2) | (chars > n * 12),
        "symbol_ratio": F.col("n_symbols") * 10 > n,
        "duplicate_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        "no_lower_case": ~F.col("has_lower"),
        "pipe_table": F.col("n_pipes") * 5 > n,
    }


def policy_mask(rules: Sequence[str]) -> int:
    return sum(1 << RULES[r] for r in rules)


def evaluate_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """The ledger: the input's other columns, the measurements and ``failed_bits``; one pass, no shuffle."""
    df = set_aside(df, (*MEASURES, "_m", "base_failed", "kept"), keep=(text,))
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    measured = df.select(*others, _measures(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_m"))
    names = [c for c in df.columns if c != text]
    flat = measured.select(
        *[F.col(f"`{c}`") for c in names],
        *[F.col(f"_m.{c}") for c in ("n_words", "word_chars", "n_symbols")],
        F.col("_m.lines.dup").alias("n_dup_lines"),
        F.col("_m.n_repeat_words"),
        F.col("_m.lines.n").alias("n_lines"),
        F.col("_m.n_pipes"),
        F.col("_m.has_lower"),
    )
    bits = F.lit(0).cast("long")
    for rule, failed in _failures().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << RULES[rule]).cast("long")).otherwise(F.lit(0).cast("long")))
    return flat.withColumn("failed_bits", bits)


def apply_policy(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """``base_failed`` and ``kept`` for a policy version, from the stored bits alone."""
    base, mask = policy_mask(BASE), policy_mask(POLICIES[policy]) | policy_mask(BASE)
    return ledger.withColumns(
        {
            "base_failed": F.col("failed_bits").bitwiseAND(F.lit(base)) != 0,
            "kept": F.col("failed_bits").bitwiseAND(F.lit(mask)) == 0,
        }
    )


def ablation(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that only it rejects, rows kept without it.

    The rows are first counted by mask, so at most 2^rules rows are left to combine.
    """
    mask = policy_mask(POLICIES[policy]) | policy_mask(BASE)
    by_mask = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = by_mask.select("bits", "n", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )

"""Quality rules: a threshold table compiled into Spark expressions, without user functions.

``measures`` adds the counts of a text, all built-in expressions over the row alone; ``RULES`` says
which range of a ratio of them is acceptable; ``compile_rules`` turns that table into one projection
with a boolean column per rule and the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that it was for on are with as be this have from or by not but what all were when we there can an your which their "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "le la les des du et est dans que qui une pour pas sur par plus avec ce il au ne se son sont aux ou mais comme on leur "
    "el los las del y que se por con para una su al lo como más pero sus este entre cuando muy sin sobre también hasta hay donde"
).split()


@dataclass(frozen=True)
class Rule:
    """measure / per (or measure alone) must lie in [low, high]; a measure of a text without per passes."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        ratio = F.col(self.measure) / F.col(self.per) if self.per else F.col(self.measure)
        tests = ([ratio >= self.low] if self.low is not None else []) + ([ratio <= self.high] if self.high is not None else [])
        ok = tests[0] if len(tests) == 1 else tests[0] & tests[1]
        return F.when(F.col(self.per) == 0, F.lit(True)).otherwise(ok) if self.per else ok


#: The method's own table, applied to texts that pass the base rules.
RULES = (
    Rule("length", "n_words", None, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2, 20),
    Rule("symbols", "n_symbols", "n_words", None, 0.3),
    Rule("exclamations", "n_exclamations", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, 0.9),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("same_words", "n_same_words", "n_words", None, 0.3),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """doc_id and the counts of each text; a null text counts as empty. Every step is a projection of one row.

    A word is a maximal run of characters other than space and U+0009 to U+000D. Windows of three words
    are hashed to 64 bits once; a text without two equal ones has no repeated word, and only the others'
    windows are sorted with their places, equal ones next to each other.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).select(
        "doc_id",
        F.array_remove(F.split(text, f"{BLANK}+"), "").alias("__words"),
        (F.length(text) - F.regexp_count(text, F.lit(BLANK))).alias("__chars"),
        F.regexp_count(text, F.lit(SYMBOL)).alias("__symbols"),
        F.regexp_count(text, F.lit("!")).alias("__calls"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
    )
    n = F.size("__words")
    hashed = base.withColumn("__hashes", F.transform(F.slice("__words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))))
    twice = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    windows = hashed.withColumn("__sorted", F.when(twice, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def again(x: Column, i: Column) -> Column:
        """If a window is equal to the one before it or after it in the sorted order."""
        before, after = (F.get("__sorted", i + j)["h"] for j in (-1, 1))
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    repeats = windows.withColumn("__at", F.when(F.col("__sorted").isNotNull(), F.array_sort(F.transform(F.filter("__sorted", again), lambda x: x["i"]))))
    k = F.size("__at")
    gaps = F.aggregate(F.zip_with(F.slice("__at", 2, k - 1), F.slice("__at", 1, k - 1), lambda b, a: F.least(b - a, F.lit(3))), F.lit(0), lambda s, x: s + x)
    same = F.size(F.filter("__words", lambda w, i: F.coalesce(w == F.get("__words", i + 1), F.lit(False))))
    return repeats.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.col("__chars").cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__at").isNull(), 0).otherwise(gaps + 3).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.col("__calls").cast("long").alias("n_exclamations"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(list(stop_words)))).cast("long").alias("n_stop_words"),
        same.cast("long").alias("n_same_words"),
    )


def compile_rules(measured: DataFrame, rules=RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """base_failed, a pass_<rule> column a rule, and kept: no base failure and every rule passes."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    verdict = ~failed
    for rule in rules:
        verdict = verdict & rule.passes()
    extra = [c for c in measured.columns if c not in BASE]
    return measured.select(*BASE, failed.alias("base_failed"), verdict.alias("kept"), *extra, *[r.passes().alias(f"pass_{r.name}") for r in rules])


BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, base_failed, kept and each rule's result, one row per row of docs.

    Null and empty texts have counts of 0 and fail the base rules. Repeated rows are judged each.
    """
    return compile_rules(measures(docs, id_col, text_col), rules)

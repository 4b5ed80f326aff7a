"""Quality rules as one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on are as with he be at this from or have by not "
    "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es zu an "
    "la le les de et des un une que dans pour qui sur au pas par plus est du en "
    "el los las y se del con por para una su lo al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where `metric` is below `low` or above `high`."""

    metric: str
    low: float | None = None
    high: float | None = None


# Word length, symbols, stop words, lines and repetition; None means no bound on that side.
RULES = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("exclamation_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.02, None),
    Rule("duplicate_line_ratio", None, 0.5),
    Rule("alphabetic_word_ratio", 0.7, None),
    Rule("upper_ratio", None, 0.6),
)

SPACE = r"[\x20\x09-\x0D]+"


def _nonblank(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each document, by built-in expressions only.

    Repeated words: windows of 8 words are hashed from their words' hashes and sorted with their
    places; equal neighbours mark the windows that occur twice or more, and the words under marked
    windows are counted once each. The sort runs only where a text has an equal pair at all.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = base.select(
        "doc_id", F.length("t").alias("n_chars"), _nonblank(F.col("t")).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"!+", ""))).alias("n_exclamations"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).alias("n_letters"),
    )
    sized = split.withColumn("n_words", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    windows = sized.withColumn(
        "g",
        F.when(F.col("n_words") >= 8, F.transform(F.sequence(F.lit(1), F.col("n_words") - 7), lambda i: F.xxhash64(F.slice("h", i, 8)))),
    )
    placed = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    sorted_ = windows.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed))
    n = F.size("s")
    shifted = F.zip_with(
        F.col("s"), F.zip_with(F.concat(F.slice("s", 1, 1), F.slice("s", 1, n - 1)), F.slice("s", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda s, o: F.when(((s["x"] == o["a"]["x"]) & (s["i"] != o["a"]["i"])) | F.coalesce(s["x"] == o["b"]["x"], F.lit(False)), s["i"]),
    )
    places = sorted_.withColumn("p", F.array_sort(F.filter(shifted, lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.zip_with(F.col("p"), F.slice("p", 2, F.size("p")), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8))),
        F.lit(0), lambda acc, x: acc + x,
    )
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return places.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.col("n_exclamations").cast("long").alias("n_exclamations"),
        F.col("n_upper").cast("long").alias("n_upper"), F.col("n_letters").cast("long").alias("n_letters"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_alphabetic"),
        F.size(F.filter("words", lambda w: F.array_contains(stop, F.lower(F.regexp_replace(w, r"[^\p{L}]+", ""))))).cast("long").alias("n_stop"),
    )


def metrics(counts: DataFrame) -> DataFrame:
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "*", (F.col("word_chars") / per_word).alias("mean_word_length"), (F.col("n_symbols") / per_word).alias("symbol_ratio"),
        (F.col("n_exclamations") / per_word).alias("exclamation_ratio"), (F.col("n_stop") / per_word).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("duplicate_line_ratio"),
        (F.col("n_alphabetic") / per_word).alias("alphabetic_word_ratio"),
        (F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))).alias("upper_ratio"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one boolean expression over the metrics: true where a rule fails."""
    failed: Column = F.lit(False)
    for r in rules:
        if r.low is not None:
            failed = failed | (F.col(r.metric) < r.low)
        if r.high is not None:
            failed = failed | (F.col(r.metric) > r.high)
    return failed


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Counts, metrics and the verdict `kept` of every document.

    base_failed: fewer than `min_words` words, or more than `max_repeat_percent` percent of the
    words in repeated windows. kept: not base_failed and no rule of the table fails. Cases: null and
    empty texts have no words and fail; ids may be null or repeat, each row is judged on its own; an
    empty table gives no rows; columns beyond the two named ones are not read.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return metrics(counted(docs, id_col, text_col)).withColumn("base_failed", base).withColumn("kept", ~base & ~compiled(rules))

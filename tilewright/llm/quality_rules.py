"""Quality rules: a threshold table compiled into one projection of built-in Spark functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for as on by this are was at or from "
    "le la les de des du et un une est que qui en pour dans par sur au aux il elle "
    "der die das und ist nicht ein eine zu den von mit auf im dem sich des "
    "el los las y una que en por con para se del al lo es no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while ``scale * numerator <= limit * denominator`` (or ``>=``, with ``at_least``).

    Numerator and denominator are whole numbers, so the comparison is exact; a rule whose denominator is
    zero passes if its numerator is zero, too, or if it is an ``at_least`` rule.
    """

    name: str
    numerator: str
    denominator: str
    limit: int
    scale: int = 100
    at_least: bool = False

    def passes(self) -> Column:
        left, right = self.scale * F.col(self.numerator), self.limit * F.col(self.denominator)
        return left >= right if self.at_least else left <= right


#: The method's verdict: every rule has to pass.
RULES = (
    Rule("mean word length at most 16", "word_chars", "n_words", 16, scale=1),
    Rule("mean word length at least 2", "word_chars", "n_words", 2, scale=1, at_least=True),
    Rule("symbols at most 5 % of the words' characters", "n_symbols", "word_chars", 5),
    Rule("lines that repeat an earlier line at most 50 %", "n_dup_lines", "n_lines", 50),
    Rule("stop words at least 2 % of the words", "n_stop_words", "n_words", 2, at_least=True),
)


def _black(column: Column) -> Column:
    """``column`` without white space."""
    return F.translate(column, WS, "")


def _metrics(text: Column) -> dict[str, Column]:
    """First level: what needs the text or its words alone."""
    return {
        "__words": F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != ""),
        "__lines": F.filter(F.split(text, "\n"), lambda line: _black(line) != ""),
        "word_chars": F.char_length(_black(text)).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def _repeats(level: DataFrame) -> DataFrame:
    """n_repeat_words: words covered by 3-word windows that occur at least twice.

    A window is known by the 64-bit hash of its words (compared within one document only).  Sorted as
    (window, position) pairs, equal windows stand together; the positions that have an equal neighbour, in
    order, cover up to three words each.  Each array is a column of its own, so that it is made once;
    documents whose windows all differ skip the sorting.
    """
    grams, spots, at = F.col("__grams"), F.col("__spots"), F.col("__at")
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    level = level.withColumn("__spots", F.when(F.size(grams) > F.size(F.array_distinct(grams)), pairs))
    neighbours = F.transform(spots, lambda s, k: F.when((F.get(spots, k + 1)["g"] == s["g"]) | (F.get(spots, k - 1)["g"] == s["g"]), s["i"]))
    level = level.withColumn("__at", F.sort_array(F.filter(neighbours, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform(at, lambda i, k: F.least(F.get(at, k + 1) - i, F.lit(3))), F.lit(0), lambda total, gap: total + gap)
    return level.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def quality_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words,
    base_failed and kept added (a column of ``docs`` with one of these names is replaced).

    Null text has no words.  Every metric is over the whole text.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    level = docs.withColumns(_metrics(text))
    words = F.col("__words")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice(words, 3, F.size(words)), lambda ab, c: F.xxhash64(ab, c))
    level = level.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
            "__grams": F.when(F.size(words) >= 3, F.slice(windows, 1, F.size(words) - 2)).otherwise(F.array().cast("array<long>")),
        }
    )
    level = _repeats(level)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    level = level.withColumn("base_failed", failed)
    verdict = F.lit(True)
    for rule in RULES:
        verdict = verdict & rule.passes()
    return level.withColumn("kept", ~F.col("base_failed") & verdict).drop("__words", "__lines", "__grams", "__spots", "__at")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, the metrics, base_failed and kept.

    Null and empty texts have zero metrics, fail the base rule and are not kept.  Repeated rows give equal
    rows; a null identifier is carried through; an empty table gives no rows.  Other columns are not read.
    """
    measured = quality_metrics(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")), "__text")
    return measured.drop("__text").withColumnRenamed("__id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    # The optimizer would push the verdict below the projections, writing out every level's expressions once
    # for each use above it; a row number in the last projection keeps the filter where it is.
    judged = quality_metrics(row, "__text").withColumn("__line", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__line") >= 0)).select(*[F.col("__row")[c].alias(c) for c in docs.columns])

"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``RULES`` maps a measure to the range in which a document passes. :func:`measures` has the columns and
:func:`verdict` turns a table into one boolean expression, so another table is another projection.

Defined results: a null or blank text has no words, fails the base rule and has ratio 0 in every ratio; very long texts
are measured whole; repeated rows are measured one by one; other columns of the input are not looked
at, and :func:`annotate` overwrites none but those it adds (``q_`` names inside, dropped at the end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it was for on with as at by this be or are from an have not but "
    "de la le les et des en un une du que est pour dans qui il au pas sur el los las y por con una se del para su al lo "
    "der die und das den von zu mit sich dem ist nicht ein eine auf für im auch wie so"
).split()

#: measure -> (lowest, highest) that passes; None: no bound.
RULES: dict[str, tuple[float | None, float | None]] = {
    "n_words": (10, None),
    "mean_word_chars": (2.0, 15.0),
    "symbol_ratio": (None, 0.10),
    "stop_word_ratio": (0.02, None),
    "dup_line_ratio": (None, 0.30),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _repeats(keyed: Column) -> Column:
    """Words of a text that lie in a 5-word window found twice or more.

    In most texts all windows are found once, which array_distinct tells; else ``keyed`` has their sorted (hash, index)
    pairs, of which we keep those with an equal neighbour, and the words of the overlapping runs are summed in order.
    """
    near = lambda x, i: F.coalesce(F.get(keyed, i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(keyed, i + 1).h == x.h, F.lit(False))
    at = F.sort_array(F.transform(F.filter(keyed, near), lambda x: x.i))
    gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(5)), F.lit(5)))
    return F.when(keyed.isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda s, x: s + x))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_stop_words (long) to ``docs``."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = "q_"
    while any(c.startswith(own) for c in docs.columns):
        own = f"_{own}"
    words, starts, keyed, kept_lines = (f"{own}{x}" for x in ("words", "windows", "keyed", "lines"))
    w = F.col(words)
    windows = F.transform(
        F.sequence(F.lit(1), F.size(w) - 4),
        lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3)),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return (
        docs.withColumn(words, _words(t))
        .withColumn(starts, F.when(F.size(w) >= 5, windows).otherwise(F.array().cast("array<bigint>")))
        .withColumn(keyed, F.when(F.size(F.array_distinct(starts)) < F.size(starts), F.sort_array(F.transform(starts, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn(kept_lines, lines)
        .withColumns(
            {
                "n_words": F.size(words).cast("long"),
                "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
                "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size(kept_lines) - F.size(F.array_distinct(kept_lines))).cast("long"),
                "n_lines": F.size(kept_lines).cast("long"),
                "n_repeat_words": _repeats(F.col(keyed)).cast("long"),
                "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            }
        )
        .drop(words, starts, keyed, kept_lines)
    )


def ratios() -> dict[str, Column]:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": part("word_chars", "n_words"),
        "symbol_ratio": part("n_symbols", "word_chars"),
        # one more, so that a short text without any isn't judged by chance
        "stop_word_ratio": F.when(F.col("n_words") > 0, (F.col("n_stop_words") + 1) / F.col("n_words")).otherwise(F.lit(0.0)),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
    }


def verdict(rules: dict[str, tuple[float | None, float | None]] = RULES) -> Column:
    """True where every measure of the table lies in its range."""
    values, out = ratios(), F.lit(True)
    for name, (low, high) in rules.items():
        if low is not None:
            out = out & (values[name] >= low)
        if high is not None:
            out = out & (values[name] <= high)
    return out


def annotate(docs: DataFrame, text: str = "text", rules: dict[str, tuple[float | None, float | None]] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))

"""Quality rules with adaptive thresholds from mergeable quantile sketches, on DataFrame functions alone.

Each document gets counts and four measures in whole thousandths or hundredths. A sketch of a measure is
the count of documents at each of its values: at most a few thousand numbers per group, added up partly
in each task before the shuffle, and two sketches merge by adding. From the sketch of each language and
source come the quartiles, and from those the fences: ``FENCE`` quartile distances and a fixed slack
beyond the quartiles. They take the place of fixed cutoffs and are joined back to the documents, which
then pass or fail. Groups may hold any share of the rows.

Defined cases: null or empty text has no words and fails the base rule; null language and null source are
groups of their own; repeated rows each count; a group of few rows has the slack around its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.columns import let
from kinweave.session import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
FENCE = 3
#: Measure, slack beyond the fence, whether small values fail as well.
MEASURES = (("word_length", 100, True), ("symbol_share", 150, False), ("dup_line_share", 300, False), ("repeat_share", 300, False))
#: Mean word lengths from here on, in hundredths, share one place of the sketch.
LONGEST = 10_000


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the array."""
    def counted(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.struct(
            F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        repeated = lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])), lambda x: x["i"]))
        covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                                        F.lit(0).cast("long"), lambda t, x: t + x)
        return let(F.array_sort(windows), lambda s: let(repeated(s), covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, counted))


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and the counts of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        *[F.col(c) for c in keep],
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(filled, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"))).alias("_words"),
    ).select(*keep, F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.n").alias("n_lines"),
             F.col("_lines.dup").alias("n_dup_lines"), F.col("_words.repeat").alias("n_repeat_words"))


def _values() -> list[Column]:
    """The measures of a row with words, as whole numbers."""
    return [F.least(F.expr("100 * word_chars div n_words"), F.lit(LONGEST).cast("long")), F.expr("1000 * n_symbols div word_chars"),
            F.expr("1000 * n_dup_lines div n_lines"), F.expr("1000 * n_repeat_words div n_words")]


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def sketches(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(*groups, measure, value, n): the sketch of every measure in every group, over rows that pass the base rule."""
    rows = measured.where(~base_failed()).select(*groups, F.posexplode(F.array(*_values())).alias("measure", "value"))
    return rows.groupBy(*groups, "measure", "value").agg(F.count("*").alias("n"))


def merge(*parts: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One sketch out of several, of days or of shards."""
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.groupBy(*groups, "measure", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(*groups, low, high): arrays of the least and largest value that pass, one place per measure."""
    group = Window.partitionBy(*groups, "measure")
    reached = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("value")), "all": F.sum("n").over(group)})
    quartiles = reached.groupBy(*groups, "measure").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("value"))).alias("q3"))
    slack = F.element_at(F.array(*[F.lit(s) for _, s, _ in MEASURES]), F.col("measure") + 1)
    both = F.element_at(F.array(*[F.lit(b) for _, _, b in MEASURES]), F.col("measure") + 1)
    spread = FENCE * (F.col("q3") - F.col("q1")) + slack
    limits = quartiles.select(*groups, F.struct("measure", F.when(both, F.col("q1") - spread).otherwise(F.lit(0)).cast("long").alias("low"),
                                                (F.col("q3") + spread).cast("long").alias("high")).alias("limit"))
    return limits.groupBy(*groups).agg(F.array_sort(F.collect_list("limit")).alias("limits"))


def judge(measured: DataFrame, limits: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    named = limits.select(*[F.col(g).alias(f"_{g}") for g in groups], "limits")
    same = None
    for g in groups:
        own = measured[g].eqNullSafe(named[f"_{g}"])
        same = own if same is None else same & own
    inside = F.forall(F.zip_with(F.array(*_values()), "limits", lambda v, x: (v >= x["low"]) & (v <= x["high"])), lambda ok: ok)
    return measured.join(named, same, "left").select(
        *[measured[c] for c in measured.columns], base_failed().alias("base_failed"),
        F.when(base_failed(), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False))).alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base rule, verdict under the thresholds of its language and source."""
    measured = stage(measure(docs), "measured")
    return judge(measured, fences(sketches(measured))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Quality rules with thresholds that adapt to each language and source, from mergeable quantile sketches."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, checkpoint, read_documents, squeeze

#: Relative accuracy of the sketch: its buckets are the powers of (1 + ACCURACY) / (1 - ACCURACY).
ACCURACY = 0.02
#: Values below this share the lowest bucket.
LEAST = 1e-3
#: Rows with which a group's quantiles weigh as much as those of its language, and a language's as much as those of the whole table.
EVEN_ROWS = 100
#: Width of the fence beyond the quartiles, in interquartile ranges.
FENCE = 3.0
#: Quantile that is the cutoff where the quartiles say nothing; its complement for low values.
TOP = 0.99
#: Per measure: whether low values fail too.
MEASURES = {"symbols_per_word": False, "marks_per_word": False, "capitals_per_char": False, "dup_line_share": False, "repeat_share": False, "chars_per_word": True}
#: Measures that are 0 in most texts. Their cutoffs come from the rows that are within the fences of all others.
SPARSE = ("symbols_per_word", "dup_line_share", "repeat_share")
GRADED = tuple(m for m in MEASURES if m not in SPARSE)


def text_measures(text: Column) -> dict[str, Column]:
    """Measures that need no words array. `flat` in the frame is the squeezed, trimmed text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {"n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")), "lines": lines}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row the counts of the base rules and the measures of the adaptive ones; see quality_rules.

    The words of repeated 3-word windows are found inside the row: window hashes are sorted, and
    only where two are equal are positions sorted along, so a word is counted once however many
    windows cover it.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), as_text(F.col(text_col)).alias("text"))
    text, flat = F.col("text"), F.col("flat")
    df = docs.withColumn("flat", F.trim(squeeze(text)))
    df = df.withColumn("words", F.when(flat != "", F.split(flat, " ")).otherwise(F.array().cast("array<string>")))
    own = text_measures(text)
    letters = F.length(flat)
    df = df.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), letters.alias("n_flat"), own["n_symbols"].cast("long").alias("n_symbols"), own["lines"].alias("lines"), "words",
        (letters - F.length(F.regexp_replace(flat, r"[\x21-\x40\x5B-\x60\x7B-\x7E]+", ""))).alias("n_marks"),
        (letters - F.length(F.regexp_replace(flat, r"[A-Z]+", ""))).alias("n_capitals"),
    )
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    df = df.withColumn("windows", windows).drop("words").withColumn("ordered", F.sort_array("windows"))
    twice = F.exists(F.sequence(F.lit(1), F.size("ordered") - 1), lambda i: F.get("ordered", i) == F.get("ordered", i - 1))
    df = df.withColumn("pairs", F.when((F.size("ordered") > 1) & twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, j: F.get("pairs", j)["h"] == p["h"]
    df = df.withColumn("starts", F.sort_array(F.transform(F.filter("pairs", lambda p, j: F.coalesce(same(p, j - 1), F.lit(False)) | F.coalesce(same(p, j + 1), F.lit(False))), lambda p: p["i"])))
    covered = F.aggregate("starts", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    n = F.greatest(F.col("n_words"), F.lit(1))
    n_lines = F.size("lines")
    df = df.select(
        "doc_id", "lang", "source", "n_words", F.when(F.col("n_words") > 0, F.col("n_flat") - F.col("n_words") + 1).otherwise(0).cast("long").alias("word_chars"), "n_symbols",
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), n_lines.alias("n_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_marks", "n_capitals", "n_flat",
    )
    return df.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbols_per_word"), (F.col("n_marks") / n).alias("marks_per_word"), (F.col("n_capitals") / F.greatest(F.col("n_flat"), F.lit(1))).alias("capitals_per_char"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / n).alias("repeat_share"), (F.col("word_chars") / n).alias("chars_per_word"),
    )


def sketch(rows: DataFrame, measures: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """Quantile sketch of some measures per (lang, source): counts per bucket of logarithmic width.

    Sketches merge by adding counts, in any order and with the same result, and any quantile
    read from one is within ACCURACY of the true value.
    """
    gamma = math.log((1 + ACCURACY) / (1 - ACCURACY))
    values = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures])).alias("x"))
    bucket = F.when(F.col("x.v") > LEAST, F.ceil(F.log(F.col("x.v") / LEAST) / gamma)).otherwise(0).cast("int")
    return values.groupBy("lang", "source", F.col("x.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and measure, its rows, the quartiles of its sketch, and the outer quantiles."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    own = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(own))
    value = F.when(F.col("bucket") > 0, F.lit(LEAST) * F.pow(F.lit(gamma), F.col("bucket")) * (2 / (1 + gamma))).otherwise(0.0)
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), value))
    return ranked.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"), at(1 - TOP).alias("bottom"), at(TOP).alias("top"))


def fences(sketches: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """One row per (lang, source): low_<measure> and high_<measure>. A group's quantiles are blended with those of its language, and these with those of everything, by weights that grow smoothly with the rows.

    Cutoffs are moved out by the width of a bucket, and are LEAST or more, so that values which the sketch can't tell apart fare alike.
    """
    sketches = checkpoint(sketches)
    merged = lambda *keys: sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    marks = ("q1", "q3", "bottom", "top")
    own, lang, all_ = quartiles(sketches, ["lang", "source"]), quartiles(merged("lang"), ["lang"]), quartiles(merged(), [])
    lang = lang.select(F.col("lang").alias("of_lang"), F.col("measure").alias("lang_measure"), *[F.col(c).alias(f"lang_{c}") for c in ("rows", *marks)])
    all_ = all_.select(F.col("measure").alias("all_measure"), *[F.col(c).alias(f"all_{c}") for c in marks])
    near = own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("measure") == F.col("lang_measure"))).join(F.broadcast(all_), F.col("measure") == F.col("all_measure"))
    weight = lambda rows: F.col(rows) / (F.col(rows) + EVEN_ROWS)
    blend = lambda w, a, b: w * a + (1 - w) * b
    near = near.select("lang", "source", "measure", *[blend(weight("rows"), F.col(q), blend(weight("lang_rows"), F.col(f"lang_{q}"), F.col(f"all_{q}"))).alias(q) for q in marks])
    width = (1 + ACCURACY) / (1 - ACCURACY)
    spread = F.col("q3") - F.col("q1")
    upper, lower = F.col("q3") + FENCE * spread, F.col("q1") - FENCE * spread
    high = F.when(F.col("measure").isin(*SPARSE), F.greatest(upper, F.col("top"))).otherwise(F.when(spread > 0, upper).otherwise(F.col("top")))
    low = F.when(spread > 0, lower).otherwise(F.col("bottom"))
    return near.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.greatest(F.lit(LEAST), high * width))).alias(f"high_{m}") for m in measures],
        *[F.max(F.when(F.col("measure") == m, low / width)).alias(f"low_{m}") for m in measures if MEASURES[m]],
    )


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    return rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_lang", "of_source")


def beyond(measure: str) -> Column:
    high = F.col(measure) > F.col(f"high_{measure}")
    return F.coalesce(high | (F.col(measure) < F.col(f"low_{measure}")) if MEASURES[measure] else high, F.lit(False))


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed (the names of the measures beyond their fence).

    Base rule: fewer than 50 words, or over half of the words in 3-word windows that occur
    twice. All other cutoffs come from the corpus: rows that pass the base rule feed one
    quantile sketch per language, source and measure, and a row is kept if no measure is beyond
    its group's cutoff. That is the outer fence (FENCE interquartile ranges from the quartile).
    For a measure that is 0 in most texts it is the quantile TOP if that is larger, taken over
    the group's rows within the fences of the other measures, so that a share of bad texts
    doesn't set it. Sketching is a partial aggregation, so a hot source costs no more than others.

    Defined cases: null text counts as empty and fails the base rule; null languages and
    sources are groups of their own; a group in which no row passes the base rule has no fence
    and nothing to keep; very long texts are measured whole; a measure equal to its cutoff passes;
    repeated rows are judged alike; an empty table gives no rows; further columns are ignored.
    """
    rows = checkpoint(measured(docs, **columns))
    passing = rows.filter(~F.col("base_failed"))
    graded = checkpoint(fences(sketch(passing, GRADED), GRADED))
    within = with_limits(passing, graded).filter(~functools.reduce(Column.__or__, map(beyond, GRADED)))
    sparse = fences(sketch(within, SPARSE), SPARSE)
    joined = with_limits(with_limits(rows, graded), sparse)
    failed = F.array_compact(F.array(*[F.when(beyond(m), F.lit(m)) for m in MEASURES]))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"), F.concat_ws(",", failed).alias("failed"))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir))


SQL = None

"""License scans by diagonal voting of word k-grams against template texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_text, read_documents
from .license_templates import TEMPLATES

#: Words per k-gram.
K = 4
#: Diagonals at most this far apart are one match with insertions or deletions.
NEAR = 3
#: Share of a template's words that a verified span covers.
COVERED = 0.7
#: Phrases that decide alone, with their labels. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Everything in ASCII but digits and letters parts words.
APART = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    r"""Lower-cased words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; other scripts' capitals fold too, which no phrase can tell."""
    bare = F.trim(F.lower(text), F.lit(APART))
    return F.when(bare != "", F.split(bare, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).otherwise(F.array().cast("array<string>"))


def kgrams(words: str) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - K), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)]))
    return F.when(F.size(words) >= K, grams)


def template_positions(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(gram, template, label, tpos, t_words); its size is that of the templates, which bounds the broadcast."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, label string, t_text string").withColumn("t_list", words_of(F.col("t_text")))
    df = df.withColumn("grams", kgrams("t_list")).withColumn("t_words", F.size("t_list"))
    return df.select("template", "label", "t_words", F.posexplode("grams").alias("tpos", "gram"))


def diagonal_votes(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """docs: (doc_id, text_hash, words). Verified and unverified matches: (doc_id, text_hash, label, first, last, covered, t_words)."""
    # the outer form: of the plain one Catalyst would infer a filter and push it, with its lambda, below the words
    grams = docs.withColumn("grams", kgrams("words")).select("doc_id", "text_hash", F.posexplode_outer("grams").alias("pos", "gram"))
    hits = grams.join(F.broadcast(template_positions(docs.sparkSession, templates)), "gram")
    lines = hits.groupBy("doc_id", "text_hash", "template", "label", "t_words", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    own = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > NEAR, F.lit(True)).cast("int")
    banded = lines.withColumn("begins", begins).withColumn("band", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.sort_array(F.array_distinct(F.flatten(F.collect_list("at"))))
    bands = banded.groupBy("doc_id", "text_hash", "template", "label", "t_words", "band").agg(at.alias("at"), F.min("first").alias("first"), (F.max("last") + K).alias("last"))
    covered = F.aggregate("at", F.struct(F.lit(-K).alias("p"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("p"), (a["n"] + F.least(F.lit(K), i - a["p"])).alias("n")), lambda a: a["n"])
    return bands.select("doc_id", "text_hash", "label", "t_words", "first", "last", covered.alias("covered"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Phrases of PHRASES are found where their words stand consecutively. Every rolling K-word
    hash of every text is joined to the templates' positions; hits vote for the diagonal
    (position in the text less position in the template), diagonals within NEAR merge into one
    band, and a band counts as a license if it covers COVERED of the template's words within a
    span of at most twice the template's length. spans has (label, first word, word after the
    last) of the verified ones. score is 1 with a phrase, else the largest share covered. As
    whole licenses and their opening sentences are templates of their own, cut texts are found too.

    Only hits are shuffled, by document; a document's votes for one diagonal combine before. The
    broadcast has a row for each word of the templates.
    Defined cases: null text counts as empty and scores 0; without phrases first_word and
    last_word are null; very long texts are matched whole; repeated rows get equal results; rows
    without doc_id are matched by their text alone; an empty table gives no rows; further columns
    are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    parts = base.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"), F.lower("text").contains("license").alias("named"))
    phrases = [(p.split(" "), label) for p, label in PHRASES.items()]
    places = lambda w: F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: _stands(w, i))
    named = lambda w, label: F.transform(places(w), lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))
    found = F.when(F.col("named"), F.concat(*[named(w, label) for w, label in phrases]))
    own = parts.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.coalesce(found, F.array().cast("array<struct<i:int,label:string>>")).alias("found"))

    bands = diagonal_votes(parts.select("doc_id", "text_hash", "words"), templates)
    share = F.least(F.lit(1.0), F.col("covered") / F.col("t_words"))
    sound = (share >= COVERED) & (F.col("last") - F.col("first") <= 2 * F.col("t_words"))
    per_doc = bands.groupBy("doc_id", "text_hash").agg(F.max(share).alias("share"), F.collect_set(F.when(sound, F.struct("label", "first", "last"))).alias("spans")).withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    joined = own.join(per_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    labels = F.transform("found", lambda x: x["label"])
    spans = F.sort_array(F.coalesce("spans", F.array().cast("array<struct<label:string,first:int,last:int>>")))
    listed = lambda x: F.concat_ws(",", F.sort_array(F.array_distinct(x)))
    n_base = F.size("found").cast("long")
    return joined.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(F.transform("found", lambda x: x["i"])).cast("long").alias("first_word"), F.array_max(F.transform("found", lambda x: x["i"])).cast("long").alias("last_word"),
        listed(labels).alias("base_labels"), listed(F.concat(labels, F.transform(spans, lambda x: x["label"]))).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.to_json(spans).alias("spans"),
    )


def _stands(words: list[str], at: Column) -> Column:
    """The words stand consecutively from there on."""
    out = F.lit(True)
    for j, w in enumerate(words):
        out = out & F.coalesce(F.get("words", at + j) == w, F.lit(False))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(read_documents(spark, sf_dir))


SQL = None

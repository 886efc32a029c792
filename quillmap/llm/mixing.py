"""Mixing sources to target token counts by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.iteration import Steps
from .common import as_rows, as_text, checkpoint, read_documents, shuffle_partitions, stored, word_count

#: Weights that the sources get in turn, in the order of their names.
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words; no source and no document is taken more than CAP times.
SHARE, CAP = 1.5, 2
#: Newton steps at most, and the relative error of each source's constraint at which they stop.
STEPS, TOLERANCE = 40, 1e-6
#: Passes that settle what rounding leaves of a source's target, each with ever smaller documents.
SETTLE = 6
#: Parts at least that the documents of one size in a source are dealt over, to choose which get a further copy; no more than 2**16. Their number doesn't change the choice.
SALT = 64


def source_targets(sources: DataFrame) -> DataFrame:
    """sources: (source, words). Adds target: SHARE of all words by weight, capped at CAP times the source, the excess reshared.

    Resharing until none is above its cap ends at a water level t with target = min(cap, weight * t);
    sources sorted by cap / weight fill up in that order, so t is the largest of the levels that two running sums give.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)).withColumn("cap", F.col("words") * float(CAP))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (F.lit(SHARE) * F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("level", level).select("source", "words", F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything)).alias("target"))


def balance(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """cells: (source, size, n); targets: (source, words, target). One row per source with its dual variable `tilt`.

    Among all rates w within [0, CAP] with sum(n * size * w) = target, the ones nearest to 1 in
    relative entropy are w = min(CAP, exp(tilt * size)). tilt is the root of a rising function,
    found by Newton steps kept within a shrinking bracket; each step is one aggregation of the
    cells, whose number is that of the distinct sizes of each source. A source whose target is
    its cap gets no tilt (null): all its rates are CAP.
    """
    smallest = cells.filter("size > 0").groupBy("source").agg(F.min("size").cast("double").alias("least"))
    open_ = (F.col("target") > 0) & (F.col("target") < CAP * F.col("words") * (1 - 1e-12))
    state = targets.filter(open_).join(smallest, targets.source.eqNullSafe(smallest.source)).drop(smallest.source)
    with Steps(cells.sparkSession) as steps:
        state = steps.keep(state.select(
            "source", "target", F.lit(0.0).alias("tilt"), F.lit(1.0).alias("error"),
            F.least(F.lit(0.0), F.log(F.col("target") / F.col("words")) / F.col("least")).alias("low"),
            (F.log(F.lit(float(CAP))) / F.col("least")).alias("high"),
        ))
        for _ in range(STEPS):
            w = F.least(F.lit(float(CAP)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(10.0))))
            mass = F.col("n") * F.col("size")
            sums = (
                cells.join(state.select(F.col("source").alias("of"), "tilt"), F.col("source").eqNullSafe(F.col("of")))
                .groupBy("of")
                .agg(F.sum(mass * w).alias("f"), F.sum(F.when(w < CAP, mass * F.col("size") * w).otherwise(0.0)).alias("slope"))
            )
            over = F.col("f") - F.col("target")
            low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
            newton = F.col("tilt") - F.when(F.col("slope") > 0, over / F.col("slope"))
            step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
            done = F.abs(over) <= F.lit(TOLERANCE) * F.col("target")
            state = steps.keep(
                state.join(sums, state.source.eqNullSafe(sums.of))
                .select("source", "target", F.when(done, F.col("tilt")).otherwise(step).alias("tilt"), (F.abs(over) / F.col("target")).alias("error"), low.alias("low"), high.alias("high"))
            )
            if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
                break
        return checkpoint(state.select("source", "tilt", "error"))


def copies_by_size(cells: DataFrame, targets: DataFrame, tilts: DataFrame) -> DataFrame:
    """Rounds the rates into `copies`, the whole copies that all documents of a (source, size) get together.

    Running sums of the rates are rounded from the largest size down, so each size's copies
    differ from their rate by less than one. What is then missing from the source's target, or
    above it, is settled by the largest documents that fit into it, SETTLE times. The windows
    hold the distinct sizes of one source.
    """
    t = targets.select(F.col("source").alias("of"), "words", "target")
    u = tilts.select(F.col("source").alias("tilted"), "tilt")
    rated = (
        cells.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .join(u, F.col("source").eqNullSafe(F.col("tilted")), "left").drop("tilted")
        .withColumn("rate", F.when(F.col("size") == 0, F.least(F.lit(1.0), F.col("target"))).when(F.col("tilt").isNull(), F.when(F.col("target") > 0, F.lit(float(CAP))).otherwise(0.0)).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(10.0))))))
    )
    source, down = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.col("size").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(so_far)
    df = rated.withColumn("upto", F.floor(F.round(upto, 6) + 0.5)).withColumn("copies", F.least(F.col("n") * CAP, F.greatest(F.lit(0), F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))).cast("long"))
    for _ in range(SETTLE):
        df = df.withColumn("left", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(source))
        room = F.when(F.col("left") > 0, F.col("n") * CAP - F.col("copies")).otherwise(F.col("copies"))
        df = df.withColumn("room", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("left")), room).otherwise(0))
        df = df.withColumn("ahead", F.sum(F.col("room") * F.col("size")).over(so_far) - F.col("room") * F.col("size"))
        moved = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("left") - F.col("ahead")) / F.col("size"))))
        df = df.withColumn("copies", (F.col("copies") + F.when(F.col("room") > 0, F.signum("left") * moved).otherwise(0)).cast("long"))
    return df.select("source", "size", "n", "words", "target", "rate", "copies")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, text_hash, size, source_size, target, rate, copies, taken (copies * size).

    size is the number of words. Every source is mixed to its target (see source_targets) with
    the rates of `balance`, rounded by `copies_by_size`. Which documents of one size get the
    further copy is decided by the order of a hash of doc_id and text, which is ranked by ranges,
    so neither a hot source nor a large group of copies meets in one task. Nothing is drawn at
    random; reruns agree, texts under one doc_id included.

    Defined cases: null text counts as empty; a null source is a source of its own, last in
    order; empty documents have size 0, take nothing and get one copy, or none if their source
    has target 0; rows with a null or repeated doc_id are further documents; repeated rows are
    interchangeable; a very long text that alone exceeds what is left of its source's target is
    passed over for smaller ones; an empty table gives no rows; further columns are ignored.
    """
    text = as_text(F.col(text_col))
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash")))
    parts_of = min(max(SALT, shuffle_partitions(docs.sparkSession)), 2**16)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash"), 1)  # without a sign, so parts are ranges of it
    rows = rows.withColumn("draw", draw).withColumn("part", F.shiftright(F.shiftright("draw", 47) * parts_of, 16).cast("int"))
    parts = checkpoint(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")))
    cells = stored(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    targets = stored(source_targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"))), "targets")
    copies = stored(copies_by_size(cells, targets, balance(cells, targets)), "copies")

    c = copies.select(F.col("source").alias("of"), F.col("size").alias("of_size"), "words", "target", "rate", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("further"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = (
        parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(c, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")))
        .select(F.col("source").alias("in_source"), F.col("size").alias("in_size"), F.col("part").alias("in_part"), "words", "target", "rate", "each", (F.col("further") - F.col("before")).alias("further"))
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id", "text_hash"))
    joined = rows.withColumn("rank", rank).join(dealt, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("size") == F.col("in_size")) & (F.col("part") == F.col("in_part")))
    copies_ = (F.col("each") + F.when(F.col("rank") <= F.col("further"), 1).otherwise(0)).cast("long")
    return joined.select("doc_id", "text_hash", "size", F.col("words").alias("source_size"), "target", "rate", copies_.alias("copies"), (copies_ * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, each as many times as the mix takes it.

    Defined cases are those of mix_sources; repeated rows of one doc_id and text are taken together as often as the mix takes all of them.
    """
    mix = mix_sources(docs, id_col, text_col, source_col).filter("copies > 0").groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("times"), F.count("*").alias("rows"))
    mix = stored(mix.toDF("mix_id", "mix_hash", "times", "rows"), "mix")
    rows = as_rows(docs).withColumns({"doc_id": F.col("row")[id_col], "text_hash": F.xxhash64(as_text(F.col("row")[text_col]))})
    if not mix.filter("rows > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "text_hash"])
    taken = rows.join(mix, F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("text_hash") == F.col("mix_hash")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_documents(spark, sf_dir))


SQL = None

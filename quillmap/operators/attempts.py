"""Attempts at model calls, as rows, to outcomes of calls, segments and batches.

A call is a (video_id, segment_id, kind); kinds are metadata and concepts, which are asked side by side,
relationships, asked if there are concepts, and the video's one global call. What happened in a call
depends on its attempts in order, what happened in a segment on its calls in order, and what
counts in a video on its segments in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.responses import strip_fence
from ..functions.text import classify_error, let, retry_delay
from .extraction import GLOBAL

#: Attempts that a call has.
MOST = 3
CALL = ["video_id", "segment_id", "kind"]
#: The order in which a segment's calls fail it, and the JSON that each kind's answer is.
KINDS = {"metadata": "OBJECT", "concepts": "ARRAY", "relationships": "ARRAY", GLOBAL: "ARRAY"}


def of_shape(body: Column, kind: Column) -> Column:
    """Whether a body is JSON of the kind's shape."""
    fits = lambda shape: F.when(kind == "metadata", shape.startswith("OBJECT")).otherwise(shape.startswith("ARRAY"))
    return F.coalesce(let(F.schema_of_variant(F.try_parse_json(strip_fence(body))), fits), F.lit(False))


def call_outcomes(attempts: DataFrame, most: int = MOST) -> DataFrame:
    """attempts: (video_id, seg_no, segment_id, kind, attempt, error, body), error being null where a body came.

    (video_id, seg_no, segment_id, kind, outcome, tries, waited, body, error), a row for each call. Attempts
    count in their order: one that is told 429 is tried again after its delay, `most` times in all; any other
    ends the call, and what comes after isn't looked at. The outcome is answered, quota (no try again, whatever
    the code), error (raised, or an answer that isn't JSON of the kind's shape), exhausted (429 to the last) or
    pending (429 so far, with tries left). tries counts the attempts looked at, waited the seconds between them.
    """
    own = Window.partitionBy(*CALL).orderBy("attempt")
    again = F.col("error").isNotNull() & (classify_error(F.col("error")) == "retry")
    before = F.max(~F.col("again")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    looked = attempts.withColumn("again", again).withColumns({"try": F.row_number().over(own), "over": F.coalesce(before, F.lit(False))}).filter((F.col("try") <= most) & ~F.col("over"))
    # rows come sorted by call and attempt from the window, so this needs neither a sort nor a list
    steps = looked.groupBy(*CALL).agg(
        F.min("seg_no").alias("seg_no"), F.count("*").alias("seen"), F.max_by(F.struct("error", "body"), F.when(~F.col("again"), F.col("try"))).alias("end"),
        F.coalesce(F.sum(F.when(F.col("again"), retry_delay(F.col("error")))), F.lit(0.0)).alias("waited"), F.max_by("error", "try").alias("last"),
    )
    ended, error = F.col("end").isNotNull(), F.col("end.error")
    outcome = (
        F.when(~ended, F.when(F.col("seen") < most, "pending").otherwise("exhausted"))
        .when(error.isNotNull(), F.when(classify_error(error) == "quota", "quota").otherwise("error"))
        .when(of_shape(F.col("end.body"), F.col("kind")), "answered").otherwise("error")
    )
    judged = steps.withColumn("outcome", outcome)
    told = F.when(~ended, F.col("last")).otherwise(F.coalesce(error, F.when(F.col("outcome") == "error", "not an answer of its kind")))
    return judged.select(*CALL, "seg_no", "outcome", F.col("seen").cast("int").alias("tries"), "waited", F.when(F.col("outcome") == "answered", F.col("end.body")).alias("body"), told.alias("error"))


def segment_outcomes(calls: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, seg_no, segment_id, outcome, reason), a row for each segment.

    A segment's outcome is that of its first call that wasn't answered, in the order of KINDS, and done if
    all were; relationships needn't be asked where the concepts are none. A call without attempts is pending.
    In order of seg_no, a video's first segment that ends for want of quota cancels those after it, whatever
    they had; other failures leave the others alone.
    """
    mine = calls.filter(F.col("kind") != GLOBAL)
    told = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = mine.groupBy("video_id", "segment_id").agg(
        *[told(k, "outcome").alias(k) for k in ("metadata", "concepts", "relationships")], *[told(k, "error").alias(f"{k}_error") for k in ("metadata", "concepts", "relationships")],
        told("concepts", "body").alias("body"),
    )
    none = F.coalesce(F.variant_get(F.try_parse_json(strip_fence(F.col("body"))), "$[0]", "variant").isNull(), F.lit(True))
    rows = segments.select("video_id", "seg_no", "segment_id").join(wide, ["video_id", "segment_id"], "left")
    state = {k: F.coalesce(k, F.lit("pending")) for k in ("metadata", "concepts", "relationships")}
    out, why = F.when(state["metadata"] != "answered", state["metadata"]), F.when(state["metadata"] != "answered", F.col("metadata_error"))
    out, why = out.when(state["concepts"] != "answered", state["concepts"]), why.when(state["concepts"] != "answered", F.col("concepts_error"))
    left = ~none & (state["relationships"] != "answered")
    rows = rows.select("video_id", "seg_no", "segment_id", out.when(left, state["relationships"]).otherwise("done").alias("outcome"), why.when(left, F.col("relationships_error")).alias("reason"))
    stops = rows.filter("outcome = 'quota'").groupBy("video_id").agg(F.min("seg_no").alias("stop"))
    cancelled = F.col("seg_no") > F.col("stop")
    rows = rows.join(stops, "video_id", "left")
    return rows.select("video_id", "seg_no", "segment_id", F.when(cancelled, "cancelled").otherwise(F.col("outcome")).alias("outcome"), F.when(cancelled, F.lit(None).cast("string")).otherwise(F.col("reason")).alias("reason"))


def answered(calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The responses (video_id, segment_id, kind, body) that extraction reads: those of segments that are done, and the global one of videos that have such and met no quota."""
    done = outcomes.filter("outcome = 'done'").select("segment_id", "video_id")
    asked = outcomes.groupBy("video_id").agg(F.count_if(F.col("outcome") == "done").alias("done"), F.count_if(F.col("outcome") == "quota").alias("stopped")).filter("done > 0 AND stopped = 0").select("video_id")
    good = calls.filter("outcome = 'answered'").select(*CALL, "body")
    own = good.filter(F.col("kind") != GLOBAL).join(done, ["video_id", "segment_id"], "left_semi")
    return own.unionByName(good.filter(F.col("kind") == GLOBAL).join(asked, "video_id", "left_semi"))


def video_summary(calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(video_id, segments, done, failed, cancelled, pending, tries, waited): how each video's extraction went."""
    n = lambda *of: F.count_if(F.col("outcome").isin(*of))
    counts = outcomes.groupBy("video_id").agg(F.count("*").alias("segments"), n("done").alias("done"), n("error", "exhausted", "quota").alias("failed"), n("cancelled").alias("cancelled"), n("pending").alias("pending"))
    effort = calls.groupBy("video_id").agg(F.sum("tries").alias("tries"), F.sum("waited").alias("waited"))
    return counts.join(effort, "video_id", "left").withColumns({"tries": F.coalesce("tries", F.lit(0)), "waited": F.coalesce("waited", F.lit(0.0))})


def run_batch(videos: DataFrame, skip_errors: bool = False, most: int | None = None) -> DataFrame:
    """videos: (ordinal, video_id, error), error being null where a video went well. (ordinal, video_id, status, error).

    Videos run in order, the first `most` of them if given. One that fails ends the batch, and those after
    it are not run, unless errors are skipped. Where it ends is one number, found by a partial
    aggregation, so no order over all videos is made.
    """
    rows = videos if most is None else videos.orderBy("ordinal").limit(most)
    failed = F.col("error").isNotNull()
    status = F.when(failed, "failed").otherwise("success")
    if not skip_errors:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(F.when(failed, F.col("ordinal"))).alias("end"))))  # one row
        late = F.coalesce(F.col("ordinal") > F.col("end"), F.lit(False))
        return rows.select("ordinal", "video_id", F.when(late, "not run").otherwise(status).alias("status"), F.when(~late, F.col("error")).alias("error"))
    return rows.select("ordinal", "video_id", status.alias("status"), "error")


def batch_summary(batch: DataFrame) -> DataFrame:
    """One row: (total, succeeded, failed, not_run)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return batch.agg(F.count("*").alias("total"), n("success").alias("succeeded"), n("failed").alias("failed"), n("not run").alias("not_run"))

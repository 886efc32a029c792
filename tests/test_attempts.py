import json
import random
import re

import pytest

from quillmap.operators import attempts as A

from .test_operators import rows

ATTEMPTS = "video_id string, seg_no int, segment_id string, kind string, attempt int, error string, body string"
SEGMENTS = "video_id string, seg_no int, segment_id string"
BODIES = {"metadata": ['{"title":"t"}', "{}", "[]", "no", None], "concepts": ['[{"name":"a"}]', "[]", "[]", '{"a":1}', "```json\n[1]\n```"], "relationships": ["[]", "[{}]", "nope"], "global": ["[]", "{}"]}
ERRORS = ["429 busy", "429 Retry after 3.5 s", "429 retry after 90", "429 insufficient_quota", "insufficient_quota", "500 down"]


def call(tried):
    """tried: (error, body) in order."""
    waited = 0.0
    for k, (error, body) in enumerate(tried[:3], 1):
        if error is None:
            return "answered", k, waited, body
        if "insufficient_quota" in error:
            return "quota", k, waited, None
        if "429" not in error:
            return "error", k, waited, None
        told = re.search(r"retry after ([\d.]+)", error, re.IGNORECASE)
        waited += min(float(told[1]) + 2 if told else 15.0, 30.0)
    return ("exhausted" if len(tried) >= 3 else "pending"), min(len(tried), 3), waited, None


def parsed(kind, outcome):
    state, tries, waited, body = outcome
    if state != "answered":
        return outcome
    try:
        value = json.loads(re.sub(r"^```[^\n]*\n|\n```$", "", body or ""))
    except ValueError:
        value = None
    good = isinstance(value, dict if kind == "metadata" else list)
    return ("answered", tries, waited, body) if good else ("error", tries, waited, None)


def loop(segments, calls):
    """Segments one after the other; a want of quota ends the video."""
    out, stopped = {}, False
    for s in segments:
        if stopped:
            out[s] = "cancelled"
            continue
        state = {k: calls.get((s, k), ("pending",))[0] for k in ("metadata", "concepts", "relationships")}
        asked = ["metadata", "concepts"]
        if state["concepts"] == "answered" and re.sub(r"\s|```|json", "", calls[s, "concepts"][3]) != "[]":
            asked.append("relationships")
        out[s] = next((state[k] for k in asked if state[k] != "answered"), "done")
        stopped = out[s] == "quota"
    return out


def made(r, videos=60):
    attempts, segments, calls = [], {}, {}
    for v in range(videos):
        segments[f"v{v}"] = [f"v{v}_seg{k:03d}" for k in range(1, r.randint(2, 9))]
        for k, s in enumerate([*segments[f"v{v}"], "global"], 1):
            for kind in ["global"] if s == "global" else ["metadata", "concepts", "relationships"]:
                tried = [(r.choice(ERRORS), None) if r.random() < 0.3 else (None, r.choice(BODIES[kind])) for _ in range(r.choice([0, 1, 1, 2, 3, 5]))]
                if r.random() < 0.6:
                    tried.insert(0, (None, BODIES[kind][0]))
                attempts += [(f"v{v}", None if s == "global" else k, s, kind, 10 * n, e, b) for n, (e, b) in enumerate(tried)]
                if tried:
                    calls[f"v{v}", s, kind] = parsed(kind, call(tried))
    return attempts, segments, calls


def test_attempts_agree_with_a_loop(spark):
    attempts, segments, calls = made(random.Random(11))
    df = A.call_outcomes(spark.createDataFrame(attempts, ATTEMPTS).repartition(5))
    got = {(x.video_id, x.segment_id, x.kind): (x.outcome, x.tries, x.waited, x.body) for x in df.collect()}
    assert got == calls
    every = spark.createDataFrame([(v, k, s) for v, ss in segments.items() for k, s in enumerate(ss, 1)], SEGMENTS)
    outcomes = A.segment_outcomes(df, every)
    want = {(v, s): o for v, ss in segments.items() for s, o in loop(ss, {k[1:]: c for k, c in calls.items() if k[0] == v}).items()}
    assert {(x.video_id, x.segment_id): x.outcome for x in outcomes.collect()} == want
    assert {"done", "error", "quota", "cancelled", "exhausted", "pending"} == {*want.values()}

    told = {(x.video_id, x.segment_id, x.kind): x.body for x in A.answered(df, outcomes).collect()}
    whole = {v for v in segments if "done" in (mine := [want[v, s] for s in segments[v]]) and "quota" not in mine}
    assert told == {k: c[3] for k, c in calls.items() if c[0] == "answered" and (k[0] in whole if k[1] == "global" else want[k[0], k[1]] == "done")}

    n = lambda v, *of: sum(want[v, s] in of for s in segments[v])
    effort = lambda v, k: sum(c[k] for key, c in calls.items() if key[0] == v)
    assert {tuple(x) for x in A.video_summary(df, outcomes).collect()} == {(v, len(ss), n(v, "done"), n(v, "error", "exhausted", "quota"), n(v, "cancelled"), n(v, "pending"), effort(v, 1), effort(v, 2)) for v, ss in segments.items()}


def test_only_429_is_tried_again_and_three_times_at_most(spark):
    made = [("v", 1, "s", "concepts", k, e, b) for k, (e, b) in enumerate([("429 retry after 1", None), ("429", None), (None, "[]"), ("500", None)])]
    made += [("v", 1, "s", "metadata", k, "429 Retry After 40", None) for k in range(7)] + [("v", 1, "s", "relationships", 0, "oops", None), ("v", 1, "s", "relationships", 1, None, "[]")]
    got = rows(A.call_outcomes(spark.createDataFrame(made, ATTEMPTS)).select("kind", "outcome", "tries", "waited", "error"), "kind")
    assert got == [("concepts", "answered", 3, 18.0, None), ("metadata", "exhausted", 3, 90.0, "429 Retry After 40"), ("relationships", "error", 1, 0.0, "oops")]


@pytest.mark.parametrize("skip, most, want", [(False, None, ["success", "failed", "not run", "not run"]), (True, None, ["success", "failed", "success", "failed"]), (False, 1, ["success"]), (True, 3, ["success", "failed", "success"])])
def test_a_batch_ends_with_its_first_failure_or_goes_on(spark, skip, most, want):
    videos = spark.createDataFrame([(4, "d", "late"), (1, "a", None), (2, "b", "gone"), (3, "c", None)], "ordinal long, video_id string, error string")
    batch = A.run_batch(videos, skip, most)
    assert [x.status for x in batch.orderBy("ordinal").collect()] == want
    assert tuple(A.batch_summary(batch).first()) == (len(want), *(want.count(s) for s in ("success", "failed", "not run")))


def test_no_attempts_at_all(spark):
    none, segments = spark.createDataFrame([], ATTEMPTS), spark.createDataFrame([("v", 1, "s")], SEGMENTS)
    calls = A.call_outcomes(none)
    assert calls.isEmpty() and rows(A.segment_outcomes(calls, segments)) == [("v", 1, "s", "pending", None)]
    assert rows(A.video_summary(calls, A.segment_outcomes(calls, segments))) == [("v", 1, 0, 0, 0, 1, 0, 0.0)]
    assert A.segment_outcomes(calls, segments.limit(0)).isEmpty() and A.run_batch(spark.createDataFrame([], "ordinal long, video_id string, error string")).isEmpty()

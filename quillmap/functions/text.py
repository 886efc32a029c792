"""Text functions: names, types, sources, ids, labels and times."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Concept types that stand, and what others become; everything else is a definition. Fixed values.
VALID_TYPES = ["definition", "algorithm", "theorem", "technique", "property", "model", "framework", "function", "process", "structure", "metric"]
TYPE_ALIASES = {
    "concept": "definition", "application": "technique", "method": "technique", "formula": "theorem", "equation": "theorem", "architecture": "model",
    "component": "structure", "layer": "structure", "measure": "metric", "loss": "function", "activation": "function",
}
#: A concept whose name or definition has one of these isn't about the subject. Fixed values.
NOISE = ["patreon", "sponsor", "subscribe", "community support", "crowdfunding", "merchandise", "donation", "channel", "playlist", "click here", "like and subscribe", "notification bell"]
#: Ranks and marks of importances, and endings of audio files. Fixed values.
IMPORTANCE_RANK = {"core": 3, "supporting": 2, "mentioned": 1}
IMPORTANCE_ICON = {"core": "*", "supporting": "o", "mentioned": "-"}
AUDIO_SUFFIXES = [".wav", ".mp3", ".m4a", ".flac", ".ogg"]
#: Addresses of hosted videos, matched from the start. Fixed value.
VIDEO_URL = r"^(https?://)?(www\.)?(youtube\.com/(watch\?v=|embed/)|youtu\.be/)"
#: Colours of importances and of kinds of concepts, as a page shows them. Fixed values.
IMPORTANCE_COLOUR = {"high": "#f87171", "medium": "#fbbf24", "low": "#34d399"}
TYPE_COLOUR = {"theory": "#a78bfa", "technique": "#60a5fa", "tool": "#34d399", "application": "#fbbf24"}
SPACE = r"(?U)\s"


def lookup(keys: dict[str, object], of: Column, default=None) -> Column:
    """Value of a small fixed map, as a CASE expression that Catalyst can fold."""
    out = None
    for k, v in keys.items():
        out = (F if out is None else out).when(of == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def let(value: Column, then) -> Column:
    """then(value), value being worked out once, however often `then` names it; Spark would do it anew in branches and lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def thousandths(number: str) -> Column:
    """round(number, 3) of doubles, which takes decimals to do so; a number that is the nearest one to some thousandths stays as it is without."""
    x = F.col(number)
    return F.when(F.rint(x * 1000.0) / 1000.0 == x, x + 0.0).otherwise(F.round(x, 3))


def normalize_name(name: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, single spaces, then the first plural rule that holds."""
    ends = lambda n, *of: functools.reduce(operator.or_, (n.endswith(x) for x in of))

    def singular(n: Column) -> Column:
        size = F.length(n)
        return (
            F.when(~n.endswith("s"), n)
            .when(n.endswith("ies") & (size > 4), F.concat(F.substring(n, 1, size - 3), F.lit("y")))
            .when(n.endswith("es") & (size > 4), F.substring(n, 1, size - 2))
            .when((size > 3) & ~ends(n, "ss", "as", "es", "is", "os", "us"), F.substring(n, 1, size - 1))
            .otherwise(n)
        )

    return let(F.trim(F.regexp_replace(F.translate(F.lower(name), "-_", "  "), SPACE + "+", " ")), singular)


def normalize_type(kind: Column) -> Column:
    k = F.trim(F.lower(kind))
    return F.when(k.isin(VALID_TYPES), k).otherwise(lookup(TYPE_ALIASES, k, "definition"))


def is_noise(name: Column, definition: Column) -> Column:
    text = F.concat(F.lower(name), F.lit(" "), F.lower(F.coalesce(definition, F.lit(""))))
    return let(text, lambda t: functools.reduce(operator.or_, (F.contains(t, F.lit(k)) for k in NOISE)))


def importance_rank(importance: Column) -> Column:
    return lookup(IMPORTANCE_RANK, importance, 0)


def direction_reversed(from_: Column, to: Column, kind: Column) -> Column:
    """Whether an is_part_of names the whole first: related words (by their first four letters) and the longer name first, or the second name within the first."""
    f, t = F.lower(from_), F.lower(to)
    words = lambda c: F.filter(F.split(c, SPACE + "+"), lambda w: w != "")
    near = lambda these, those: F.exists(these, lambda a: F.exists(those, lambda b: a.startswith(F.substring(b, 1, 4)) | b.startswith(F.substring(a, 1, 4))))
    related = let(F.struct(words(f).alias("f"), words(t).alias("t")), lambda w: near(w["f"], w["t"]))
    return (kind == "is_part_of") & (F.contains(f, t) | ((F.length(f) > F.length(t)) & related))


def is_video_url(source: Column) -> Column:
    return source.rlike(VIDEO_URL)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_audio_file(path: Column) -> Column:
    return suffix(path).isin(AUDIO_SUFFIXES)


def source_kind(source: Column) -> Column:
    return F.when(is_video_url(source), "url").when(is_audio_file(source), "audio").when(suffix(source) != "", "video").otherwise("missing")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def video_id(source: Column) -> Column:
    return F.concat(F.lit("vid_"), F.substring(F.md5(source.cast("binary")), 1, 8))


def segment_id(video: Column, number: Column) -> Column:
    return F.format_string("%s_seg%03d", video, number)


def example_id(segment: Column, number: Column) -> Column:
    return F.format_string("%s_ex%02d", segment, number)


def concept_id(name: Column) -> Column:
    return F.concat(F.lit("concept_"), normalize_name(name))


def _parts(seconds: Column) -> tuple[Column, Column, Column]:
    total = F.floor(seconds).cast("long")
    return F.floor(total / 3600).cast("long"), F.floor(total % 3600 / 60).cast("long"), total % 60


def format_timestamp(seconds: Column) -> Column:
    h, m, s = _parts(seconds)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def format_clock(seconds: Column) -> Column:
    """The first unit isn't padded."""
    h, m, s = _parts(seconds)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def excerpt(text: Column, chars: int = 500) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def preview(definition: Column) -> Column:
    return F.concat(F.substring(definition, 1, 80), F.lit("..."))


def icon(importance: Column) -> Column:
    return lookup(IMPORTANCE_ICON, importance, ".")


def importance_colour(importance: Column) -> Column:
    return lookup(IMPORTANCE_COLOUR, F.lower(importance), "#94a3b8")


def type_colour(kind: Column) -> Column:
    return lookup(TYPE_COLOUR, F.lower(kind), "#818cf8")


def progress(done: Column, steps: Column) -> Column:
    """Done steps as a percentage of all, 0 where there are none."""
    return F.when(steps > 0, done / steps * 100).otherwise(0.0)


def label(kind: Column) -> Column:
    return F.lower(F.replace(kind, F.lit("_"), F.lit(" ")))


def duration(start: Column, end: Column) -> Column:
    return F.coalesce(end - start, F.lit(0.0))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def retry_delay(message: Column) -> Column:
    told = F.try_to_number(F.nullif(F.regexp_extract(F.lower(message), r"retry after ([\d.]+)", 1), F.lit("")), F.lit("999999.999")).cast("double")
    return F.least(F.coalesce(told + 2, F.lit(15.0)), F.lit(30.0))


def classify_error(message: Column) -> Column:
    """What a failed model call calls for: stop for good, try again, or raise."""
    return F.when(F.contains(message, F.lit("insufficient_quota")), "quota").when(F.contains(message, F.lit("429")), "retry").otherwise("raise")

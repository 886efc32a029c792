"""Cleaning, deduplication and merging of concept mentions and relationships."""

from __future__ import annotations

import functools
import itertools
import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.picks import best_definition, best_importance, first_by
from ..functions.text import direction_reversed, importance_rank, is_noise, normalize_name, normalize_type
from .iteration import cut, values

UNIT = ["video_id", "seg_no"]
ORDER = ["video_id", "seg_no", "pos"]


def filter_noise(mentions: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops concepts about channels and sponsors: every mention of such a name within its unit, and the unit's relationships that touch it.

    A unit's noisy names meet its rows as one list, so rows are shuffled once however many names they have.
    """
    noisy = mentions.filter(is_noise(F.col("name"), F.col("definition"))).groupBy(*[F.col(k).alias(f"of_{k}") for k in UNIT]).agg(F.collect_set("name").alias("noisy"))

    def without(rows: DataFrame, *names: str) -> DataFrame:
        free = [~F.coalesce(F.array_contains("noisy", F.col(c)), F.lit(False)) for c in names]
        at = [F.col(k) == F.col(f"of_{k}") for k in UNIT]
        return rows.join(noisy, at, "left").filter(functools.reduce(operator.and_, free)).select(rows.columns)

    return without(mentions, "name"), without(relationships, "from_concept", "to_concept")


def normalize_types(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("type", normalize_type(F.col("type")))


ENTRIES = "video_id string, seg_no int, pos int, name string, aliases array<string>, type string, definition string, key string, alias_keys array<string>, entry int"


class Entries:
    """The entries of one video, as its mentions come.

    A mention joins the entry that it would open by its key, or else the first of its aliases' keys
    that opened one, or else the first entry that holds its key or one of its aliases'; otherwise it opens one.
    The entry then holds all of these keys. Two indexes, of the keys that opened an entry and of the
    first entry that holds a key, make a mention cost what its own keys cost, however many entries there are. What is kept grows with the
    video's names, and not with its mentions.
    """

    def __init__(self):
        self.opened, self.holder, self.last, self.told, self.made = {}, {}, {}, [], {}

    def join(self, key, aliases) -> int:
        at = self.opened.get(key)
        if at is None:
            at = next((self.opened[a] for a in aliases if a in self.opened), None)
        if at is None:
            at = min((self.holder[k] for k in (key, *aliases) if k in self.holder), default=None)
        if at is None:
            at = self.opened[key] = len(self.opened)
        for k in (key, *aliases):
            self.holder[k] = min(at, self.holder.get(k, at))
        return at

    def tell(self, key, alias_keys, name, aliases, kind, definition) -> None:
        """Joins a mention, from which the entry has its names, and, if it is the first one, its name and type; a longer definition below 500 characters is a better one."""
        at = self.join(key, alias_keys)
        for k in (key, *alias_keys):
            self.last[k] = max(at, self.last.get(k, at))
        size = len(definition) if definition and len(definition) < 500 else 0
        if at == len(self.told):
            self.told.append([name, {name, *aliases}, kind, definition, size])
        else:
            entry = self.told[at]
            entry[1].update((name, *aliases))
            if size > entry[4]:
                entry[3:] = definition, size

    def of(self, key):
        """(name, other names, type, definition) of the entry that a normalised name stands for: the last one that any mention joined with that key as its name's or an alias's; or None."""
        at = self.last.get(key) if key is not None else None
        if at is not None and at not in self.made:
            name, names, kind, definition, _ = self.told[at]
            others = sorted(n for n in names if n is not None and n != name)
            self.made[at] = (name, others + [None] * (None in names and name is not None), kind, definition or "")
        return self.made.get(at)


def _given(aliases: Column) -> Column:
    return F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.isNotNull())


def registry(mentions: DataFrame) -> DataFrame:
    """Mentions with the entry of their video that each one joins, as ENTRIES. This depends on the order of mentions, so they are folded in Python as they come, sorted by video: no group is made for a video."""

    def fold(batches):
        video, entries = None, Entries()
        for batch in batches:
            out = []
            for of, key, aliases in zip(*(batch.column(c).to_pylist() for c in ("video_id", "key", "alias_keys"))):
                if of != video:
                    video, entries = of, Entries()
                out.append(entries.join(key, aliases))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "entry"])

    keyed = mentions.select(*ORDER, "name", _given(F.col("aliases")).alias("aliases"), "type", "definition", normalize_name(F.col("name")).alias("key")).withColumn("alias_keys", F.transform("aliases", normalize_name))
    return keyed.repartition("video_id").sortWithinPartitions(*ORDER).mapInArrow(fold, ENTRIES)


#: What a line of canonical() is: a mention that joins its entry, one that gets its entry's name, a relationship.
JOINS, NAMED, RELATED = 0, 1, 2
#: What canonical() gives anew, of mentions and of relationships.
TOLD, ENDS = ["name", "aliases", "type", "definition"], ["from_concept", "to_concept"]


def spoken(mentions: DataFrame, relationships: DataFrame) -> DataFrame:
    """(video_id, seg_no, pos, m, r): both as rows of one table, whose other columns are a struct, m or r. A source that has a mention and a relationship in one place may give them in one row."""
    kind = lambda df: df.select(F.struct(*_others(df))).schema[0].dataType
    m, r = (df.select(*ORDER, F.struct(*_others(df)).alias(c)) for df, c in ((mentions, "m"), (relationships, "r")))
    return m.withColumn("r", F.lit(None).cast(kind(relationships))).unionByName(r.withColumn("m", F.lit(None).cast(kind(mentions))))


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ORDER]


def canonical(lines: DataFrame, mentions: bool = True, relationships: bool = True) -> DataFrame:
    """lines: spoken(). (kind, video_id, seg_no, pos, *TOLD, own, *ENDS, rest): mentions (NAMED) and relationships (RELATED), as asked for, with the names of their video's entries; own and rest are their other columns.

    A mention stands for the concept that the map gives for its name, which needn't be the entry it joined; of a unit's mentions of one concept the first is kept.
    Lines are folded in Python as they come, sorted by video: all that join entries, then again those that get their names, so no row waits for the end of its video,
    and lines are shuffled once, or not at all if those of a video lie together.
    """
    fields = lambda c, without: [f for f in lines.schema[c].dataType.names if f not in without]
    key = lambda c: normalize_name(F.col(c))
    kinds, cols = [F.when(F.col("m").isNotNull(), JOINS)], [*ORDER, "m", key("m.name").alias("key"), _given(F.col("m.aliases")).alias("given")]
    if mentions:
        kinds.append(F.when(F.col("m").isNotNull(), NAMED))
    if relationships:
        kinds.append(F.when(F.col("r").isNotNull(), RELATED))
        cols += ["r", key("r.from_concept").alias("from_key"), key("r.to_concept").alias("to_key")]
    keyed = lines.select(*cols).withColumn("alias_keys", F.transform("given", normalize_name)).withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))
    joins, named, related = (F.col("kind") == k for k in (JOINS, NAMED, RELATED))
    loose = named & (F.col("key").isNull() | F.col("video_id").isNull())
    told = [F.when(joins | loose, F.col("m.name")).alias("name")]
    if mentions:
        told += [F.when(joins, F.col("given")).when(loose, F.col("m.aliases")).alias("aliases"), *[F.when(joins | loose, F.col(f"m.{c}")).alias(c) for c in ("type", "definition")], F.when(named, F.struct(*[f"m.{c}" for c in fields("m", TOLD)])).alias("own")]
    if relationships:
        told += [*[F.when(related, F.col(c)).alias(c.split(".")[-1]) for c in ("from_key", "to_key", "r.from_concept", "r.to_concept")], F.when(related, F.struct(*[f"r.{c}" for c in fields("r", ENDS)])).alias("rest")]
    flat = keyed.select("kind", *ORDER, F.when(~related, F.col("key")).alias("key"), F.when(joins, F.col("alias_keys")).alias("alias_keys"), *told)
    sorted_ = flat.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("kind", "seg_no", "pos")))
    out = ["kind", *ORDER, *((*TOLD, "own") if mentions else ()), *((*ENDS, "rest") if relationships else ())]
    schema = sorted_.select(*out).schema

    def fold(batches):
        video, entries, unit, seen = None, Entries(), None, set()
        for batch in batches:
            size = batch.num_rows
            col = lambda c: values(batch.column(c)) if c in batch.schema.names else itertools.repeat(None, size)  # noqa: B023, E731
            kept, anew = [], {c: [] for c in (*TOLD, *ENDS) if c in out}
            rows = zip(*(col(c) for c in ("video_id", "kind", "seg_no", "key", "alias_keys", *TOLD, "from_key", "to_key", *ENDS)))
            for i, (of, kind, seg_no, key, alias_keys, name, aliases, type_, definition, from_key, to_key, *ends) in enumerate(rows):
                if of != video:
                    video, entries, unit, seen = of, Entries(), None, set()
                if kind == JOINS:
                    if of is not None:
                        entries.tell(key, alias_keys, name, aliases or (), type_, definition)
                    continue
                if kind == NAMED:
                    told = entries.of(key) or (name, aliases, type_, definition)
                    if seg_no != unit:
                        unit, seen = seg_no, set()
                    if told[0] in seen:
                        continue
                    seen.add(told[0])
                    ends = (None, None)
                else:
                    told = (None, None, None, None)
                    ends = [own if (e := entries.of(k)) is None or e[0] is None else e[0] for k, own in zip((from_key, to_key), ends)]
                kept.append(i)
                for c, v in zip((*TOLD, *ENDS), (*told, *ends)):
                    if c in anew:
                        anew[c].append(v)
            if kept:
                rest = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([pa.array(anew[c], rest.schema.field(c).type) if c in anew else rest.column(c) for c in out], names=out)

    return sorted_.mapInArrow(fold, schema)


def named_mentions(folded: DataFrame) -> DataFrame:
    """Mentions of canonical()."""
    return folded.filter(F.col("kind") == NAMED).select(*ORDER, *TOLD, "own.*")


def named_relationships(folded: DataFrame) -> DataFrame:
    """Relationships of canonical(), reversed parts turned round, and the first of each (from, to, type) in its unit."""
    return canonical_relationships(folded.filter(F.col("kind") == RELATED).select(*ORDER, *ENDS, "rest.*"))


def canonical_relationships(relationships: DataFrame) -> DataFrame:
    """Reversed parts turned round, and the first of each (from, to, type) in its unit."""
    df = relationships.withColumn("turn", direction_reversed(F.col("from_concept"), F.col("to_concept"), F.col("type")))
    df = df.withColumns({"from_concept": F.when(F.col("turn"), F.col("to_concept")).otherwise(F.col("from_concept")), "to_concept": F.when(F.col("turn"), F.col("from_concept")).otherwise(F.col("to_concept"))}).drop("turn")
    first = F.row_number().over(Window.partitionBy(*UNIT, "from_concept", "to_concept", "type").orderBy("pos"))
    return df.withColumn("rank", first).filter("rank = 1").drop("rank")


def deduplicate(mentions: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and relationships by canonical concepts; the registry is folded once and what it gives is written, since both results read it."""
    folded = cut(canonical(spoken(mentions, relationships)))
    return named_mentions(folded).select(*mentions.columns), named_relationships(folded).select(*relationships.columns)


def unique_concepts(mentions: DataFrame) -> DataFrame:
    """One row per (video_id, name): best definition and importance, all aliases but the name sorted, first type, first range. Ordered by rank and name where it is read."""
    order = F.struct("seg_no", "pos")
    given = F.col("timestamp_range").isNotNull()
    return mentions.groupBy("video_id", "name").agg(
        F.array_sort(F.array_except(F.flatten(F.collect_list("aliases")), F.array("name"))).alias("aliases"), first_by(F.col("type"), order).alias("type"), best_definition(F.col("definition"), order).alias("definition"),
        best_importance(F.col("importance"), order).alias("importance"), F.min_by("timestamp_range", F.when(given, order)).alias("timestamp_range"),
    )


def ranked(concepts: DataFrame) -> DataFrame:
    return concepts.orderBy(importance_rank(F.col("importance")).desc(), "name")

"""Model responses as JSON text: tolerant reading, and the records in them with their defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def strip_fence(body: Column) -> Column:
    """Text without white space around it, without a leading ``` line and a last line that is ```."""
    inner = lambda t: F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"(^|\n)```$", "")
    return let(F.regexp_replace(body, r"(?U)^\s+|\s+$", ""), lambda t: F.when(t.startswith("```"), inner(t)).otherwise(t))


def parse(body: Column, schema: str) -> Column:
    return F.from_json(strip_fence(body), schema)


def concepts(body: Column) -> Column:
    raw = parse(body, "array<struct<name:string,aliases:array<string>,type:string,definition:string,importance:string>>")
    return F.transform(raw, lambda c: F.struct(
        c["name"].alias("name"), F.coalesce(c["aliases"], F.array().cast("array<string>")).alias("aliases"), F.coalesce(c["type"], F.lit("definition")).alias("type"),
        F.coalesce(c["definition"], F.lit("")).alias("definition"), F.coalesce(c["importance"], F.lit("mentioned")).alias("importance"),
    ))


def relationships(body: Column) -> Column:
    raw = parse(body, "array<struct<from_concept:string,to_concept:string,type:string,evidence:string>>")
    return F.transform(raw, lambda r: F.struct(r["from_concept"].alias("from_concept"), r["to_concept"].alias("to_concept"), F.coalesce(r["type"], F.lit("depends_on")).alias("type"), F.coalesce(r["evidence"], F.lit("")).alias("evidence")))


def metadata(body: Column) -> Column:
    """(title, examples, key_quotes), the lists empty where absent."""
    raw = parse(body, "struct<title:string,examples:array<struct<description:string,illustrates:string>>,key_quotes:array<struct<text:string,relevance:string>>>")
    none = F.lit(None).cast("double").alias("timestamp")
    text = lambda c, k: F.coalesce(c[k], F.lit("")).alias(k)
    return F.struct(
        raw["title"].alias("title"),
        F.coalesce(F.transform(raw["examples"], lambda e: F.struct(text(e, "description"), text(e, "illustrates"), none)), F.array()).alias("examples"),
        F.coalesce(F.transform(raw["key_quotes"], lambda q: F.struct(text(q, "text"), none, text(q, "relevance"))), F.array()).alias("key_quotes"),
    )

"""JSON found in free text, as variant columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a fenced block that holds an object.
FENCE = "(?s)```(?:json|js)?\\s*(\\{.*?\\})\\s*```"


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such stretch."""
    start = F.instr(text, F.lit("{"))
    end = F.length(text) - F.instr(F.reverse(text), F.lit("}")) + 1
    return F.when((start > 0) & (F.instr(text, F.lit("}")) > 0) & (end > start), F.substring(text, start, end - start + 1))


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")


def verdict_json(text: Column) -> Column:
    """The object in a model's last message: all of it, else its fenced block, else its braces.

    A fenced block that is no JSON gives null; the braces are then not tried.
    """
    t = _strip(text)
    fence = F.regexp_extract(t, FENCE, 1)
    return F.coalesce(F.try_parse_json(t), F.when(fence != "", F.try_parse_json(fence)).otherwise(F.try_parse_json(braces(t))))


def analysis_json(text: Column) -> Column:
    """The object in an analysis answer: fence lines stripped, parsed, else its braces; objects only."""
    t = _strip(text)
    t = _strip(F.regexp_replace(F.regexp_replace(t, "^```(?:json)?\\s*", ""), "\\s*```$", ""))
    whole = F.try_parse_json(t)
    found = F.coalesce(whole, F.try_parse_json(braces(t)))
    return F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), found)


def pretty(text: Column, sort_keys: bool = False) -> Column:
    """JSON text indented by two, characters kept, keys in order if asked; Spark's own printer spaces it otherwise."""

    def indented(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, sort_keys=sort_keys, ensure_ascii=False))

    return F.pandas_udf(indented, "string")(text)


def prompt_payload(cve: Column, metadata: Column, binaries: Column, resolution: Column, target_dir: Column, compiler: Column, optimisation: Column) -> Column:
    """The task payload of a prompt; `metadata` is JSON text, `resolution` a map."""
    fields = F.struct(
        cve.alias("cve"), F.parse_json(metadata).alias("metadata"), binaries.alias("requested_binaries"), resolution.alias("binary_resolution"),
        target_dir.alias("target_dir"), compiler.alias("compiler"), optimisation.alias("optimization"),
    )
    return pretty(F.to_json(fields))

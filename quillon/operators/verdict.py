"""From final messages to one verdict for each requested binary, and back to original names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.jsons import analysis_json, verdict_json
from quillon.functions.text import is_blank, remap_names
from quillon.sources.schemas import STATUSES

#: Evidence and reasoning of verdicts for binaries that the output lacks.
MISSING = ("codex output did not contain this requested binary", "Missing per-binary result in final JSON.")
MISSING_ANONYMOUS = ("codex output did not contain this requested binary after de-anonymization", "Missing per-binary result in anonymous final JSON.")
#: Fields of a behaviour analysis and what is said of bad ones.
ROOT_FIELDS, INTENT_FIELDS, CHANGES = ("summary", "unsafe_mechanism"), ("summary", "intended_security_property"), "behavior_changes"
NO_ANALYSES = "missing root_cause_analysis or patch_intent_analysis"
BAD_CHANGES = "patch_intent_analysis.behavior_changes must be a string list"
_VARIANTS = "array<variant>"


def final_text(last_message: Column, stdout: Column) -> Column:
    """The last message as it is, or standard output if that is blank."""
    return F.when(~is_blank(last_message), last_message).otherwise(stdout)


def text_of(v: Column) -> Column:
    """A JSON scalar as Python's str() writes it; other values as JSON text."""
    kind = F.schema_of_variant(v)
    said = F.when(kind == "BOOLEAN", F.initcap(v.cast("string"))).when(kind == "VOID", F.lit("None"))
    return F.when(v.isNull(), F.lit("None")).otherwise(said.otherwise(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))))


def extracted(raw: DataFrame, text: str = "final_text") -> DataFrame:
    """Raw rows with `obj`, the JSON object in the text; null where there is none."""
    return raw.withColumn("obj", verdict_json(F.col(text)))


def validated(rows: DataFrame) -> DataFrame:
    """(cve, binary, status, confidence, evidence, reasoning) of rows (cve, binaries, obj).

    Accepted are a `results` list, an object under the CVE, and a bare object, in this order. List
    rows of another CVE do not count, the last row of a binary does; a binary without a row gets an
    error verdict; unknown statuses are errors; evidence that is no list becomes one. Rows whose
    object is null or no object give only error verdicts.
    """
    obj = F.col("obj")
    listed = F.try_variant_get(obj, "$.results", _VARIANTS)
    # keys may hold any character, so objects are read as maps
    root = F.try_variant_get(obj, "$", "map<string,variant>")
    own = F.try_variant_get(F.try_element_at(root, F.col("cve")), "$", "map<string,variant>")
    pick = rows.withColumn("__listed", listed).withColumn("__map", F.coalesce(own, root))
    each = pick.select("cve", "__listed", "__map", F.posexplode("binaries").alias("__n", "binary"))
    mine = F.filter(
        "__listed",
        lambda r: (F.coalesce(text_of(F.try_variant_get(r, "$.binary", "variant")), F.lit("None")) == F.col("binary"))
        & F.coalesce(F.when(F.try_variant_get(r, "$.cve", "variant").isNull(), True).otherwise(text_of(F.try_variant_get(r, "$.cve", "variant")) == F.col("cve")), F.lit(True))
        & F.try_variant_get(r, "$", "map<string,variant>").isNotNull(),
    )
    row = F.when(F.col("__listed").isNotNull(), F.try_element_at(mine, F.lit(-1))).otherwise(F.try_element_at("__map", F.col("binary")))
    fields = F.try_variant_get(row, "$", "map<string,variant>")
    each = each.withColumn("__row", fields)
    get = lambda key: F.try_element_at("__row", F.lit(key))
    has = lambda key: F.map_contains_key("__row", key)
    missing = F.col("__row").isNull()
    status = F.when(has("status"), text_of(get("status"))).otherwise("error")
    status = F.when(status.isin(*STATUSES), status).otherwise("error")
    items = F.try_variant_get(get("evidence"), "$", _VARIANTS)
    evidence = F.when(~has("evidence"), F.array().cast("array<string>")).when(items.isNotNull(), F.transform(items, text_of)).otherwise(F.array(text_of(get("evidence"))))
    return each.select(
        "cve", "binary",
        F.when(missing, "error").otherwise(status).alias("status"),
        F.when(missing | ~has("confidence"), "low").otherwise(text_of(get("confidence"))).alias("confidence"),
        F.when(missing, F.array(F.lit(MISSING[0]))).otherwise(evidence).alias("evidence"),
        F.when(missing, MISSING[1]).when(~has("reasoning"), "").otherwise(text_of(get("reasoning"))).alias("reasoning"),
    )


def deanonymised(verdicts: DataFrame, names: DataFrame, folder: Column | None = None) -> DataFrame:
    """Verdicts under original names, their texts mapped back; `names` has (cve, anonymous, original).

    An original without a verdict gets an error verdict.
    """
    every = names.groupBy("cve").agg(F.collect_list(F.struct("anonymous", "original")).alias("__names"))
    joined = names.join(verdicts.withColumnRenamed("binary", "anonymous"), ["cve", "anonymous"], "left").join(every, "cve")
    none = F.col("status").isNull()
    lost = F.array(F.lit(MISSING_ANONYMOUS[0]))
    return joined.select(
        "cve", F.col("original").alias("binary"), F.coalesce("status", F.lit("error")).alias("status"), F.coalesce("confidence", F.lit("low")).alias("confidence"),
        F.when(none, lost).otherwise(F.transform("evidence", lambda e: remap_names(e, F.col("__names"), folder))).alias("evidence"),
        F.when(none, MISSING_ANONYMOUS[1]).otherwise(remap_names(F.col("reasoning"), F.col("__names"), folder)).alias("reasoning"),
    )


def merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("cve", "binary"), order: str = "written") -> DataFrame:
    """The latest row of every key; of equal times the new table's."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "__new")).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def has_status(verdicts: DataFrame, status: str) -> DataFrame:
    """(cve, has) whether any of a CVE's verdicts is of a status."""
    return verdicts.groupBy("cve").agg(F.coalesce(F.bool_or(F.col("status") == status), F.lit(False)).alias("has"))


def analyses(responses: DataFrame, text: str = "text") -> DataFrame:
    """Validated behaviour analyses of answers, or `analysis_error` saying what is wrong.

    Both parts must be objects and the changes a list of texts, of which blank ones go; other
    fields become trimmed texts, empty where they are missing.
    """
    rows = responses.withColumn("__obj", analysis_json(F.col(text)))
    for name, path in (("__root", "root_cause_analysis"), ("__intent", "patch_intent_analysis")):
        part = F.try_variant_get("__obj", f"$.{path}", "variant")
        rows = rows.withColumn(name, F.when(F.startswith(F.schema_of_variant(part), F.lit("OBJECT")), part))
    listed = F.try_variant_get("__intent", f"$.{CHANGES}", _VARIANTS)
    error = F.when(F.col("__obj").isNull(), "no JSON object in the answer").when(F.col("__root").isNull() | F.col("__intent").isNull(), NO_ANALYSES)
    error = error.when(listed.isNull() | F.exists(listed, lambda v: F.schema_of_variant(v) != "STRING"), BAD_CHANGES)

    def said(part: str, key: str) -> Column:
        value = F.try_variant_get(part, f"$.{key}", "variant")
        there = F.map_contains_key(F.try_variant_get(part, "$", "map<string,variant>"), key)
        return F.trim(F.when(there, text_of(value)).otherwise("")).alias(key)

    changes = F.filter(F.transform(F.try_variant_get("__intent", f"$.{CHANGES}", "array<string>"), lambda t: F.trim(t)), lambda t: t != "")
    good = F.struct(
        F.struct(*(said("__root", k) for k in ROOT_FIELDS)).alias("root_cause_analysis"),
        F.struct(*(said("__intent", k) for k in INTENT_FIELDS), changes.alias(CHANGES)).alias("patch_intent_analysis"),
    )
    return rows.withColumn("analysis_error", error).withColumn("analysis", F.when(F.col("analysis_error").isNull(), good)).drop("__obj", "__root", "__intent")


def unfinished(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items whose earlier result lacks one of its two analyses."""
    done = existing.filter("coalesce(root_cause_analysis, '') <> '' and coalesce(patch_intent_analysis, '') <> ''")
    return items.join(done, "cve", "left_anti")


def enriched(items: DataFrame, analysed: DataFrame) -> DataFrame:
    """Items with their analysis, or with its error."""
    return items.join(analysed.select("cve", "analysis", F.col("analysis_error").alias("behavior_analysis_error")), "cve", "left")

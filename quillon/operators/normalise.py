"""Normalisers of input documents. Lists keep first occurrences; the last record of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("vuln", "patch", "not_affected")


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _last_by(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, "v.*")


def _binaries() -> Column:
    return F.coalesce(F.col("binaries"), F.concat(*map(_list, SIDES)))


def _has_null(names: Column) -> Column:
    return F.exists(names, lambda b: b.isNull())


def _invalid(raw: DataFrame, times: Column, order: str, most: int) -> DataFrame:
    """One row (bad, sample): how often records are refused, and the first positions in input order."""
    rows = raw.select(F.col(order).cast("long").alias("at"), F.explode(F.array_repeat(F.lit(1), times)).alias("n")).select("at")
    first = rows.orderBy("at").limit(most).agg(F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda n: n.cast("string")), ", ").alias("sample"))
    return rows.agg(F.count("*").alias("bad")).crossJoin(first)


def refuse(rows: DataFrame, invalid: DataFrame, what: str) -> DataFrame:
    """The rows; a query over them fails, naming the first positions, if any record is refused."""
    stop = F.when(F.col("bad") > 0, F.raise_error(F.concat(F.lit(f"{what}. Bad item indexes: "), "sample")))
    told = F.broadcast(invalid.select(stop.cast("string").alias("__stop")))  # one row, an aggregate's
    return rows.crossJoin(told).filter("__stop is null").drop("__stop")


#: What is said of refused inputs.
BAD_TESTSET = "a test set is a list of records with CVE and binaries, or with vuln, patch and not_affected"
BAD_TRUTH = "ground truth is a list of records with CVE, vuln, patch and not_affected"


def testset(raw: DataFrame, order: str = "ord", strict: bool = False) -> DataFrame:
    """(cve, functions, binaries) of test-set records; strict loads fail as a whole if one is refused."""
    rows = raw.select(F.col("CVE").alias("cve"), _list("functions").alias("functions"), F.array_distinct(_binaries()).alias("binaries"), order)
    kept = _last_by(rows, "cve", order, "functions", "binaries")
    return refuse(kept, invalid_testset(raw, order), BAD_TESTSET) if strict else kept


def invalid_testset(raw: DataFrame, order: str = "ord", most: int = 5) -> DataFrame:
    """One row (bad, sample) of a test set.

    A record without a CVE or binaries is refused. One whose lists hold a null is refused for that,
    and once more if the lists before that one are empty.
    """
    sides = [_list(s) for s in SIDES]
    before, listed = F.lit(0), F.when(F.size(F.concat(*sides)) < 1, 1).otherwise(0)
    whole = F.when(_has_null(F.col("binaries")) | (F.size("binaries") < 1), 1).otherwise(0)
    counts = []
    for side in sides:
        counts.append((_has_null(side), F.when(before < 1, 2).otherwise(1)))
        before = before + F.size(side)
    for bad, n in reversed(counts):
        listed = F.when(bad, n).otherwise(listed)
    times = F.when(F.coalesce(F.col("CVE"), F.lit("")) == "", 1).when(F.col("binaries").isNotNull(), whole).otherwise(listed)
    return _invalid(raw, times, order, most)


def groundtruth(raw: DataFrame, order: str = "ord", strict: bool = False) -> DataFrame:
    """(cve, vuln, patch, not_affected) of ground-truth records; a missing list is empty. Strict as for testset()."""
    rows = raw.select(F.col("CVE").alias("cve"), *(F.array_distinct(_list(s)).alias(s) for s in SIDES), order)
    kept = _last_by(rows, "cve", order, *SIDES)
    return refuse(kept, invalid_groundtruth(raw, order), BAD_TRUTH) if strict else kept


def invalid_groundtruth(raw: DataFrame, order: str = "ord", most: int = 5) -> DataFrame:
    """One row (bad, sample) of ground truth: records without a CVE, or with a null in a list."""
    bad = F.coalesce(F.col("CVE"), F.lit("")) == ""
    for s in SIDES:
        bad = bad | _has_null(_list(s))
    return _invalid(raw, F.when(bad, 1).otherwise(0), order, most)


def source_diff(raw: DataFrame, project: str) -> DataFrame:
    """Records of a project's source diff whose key is a CVE id; rows of other projects go."""
    return raw.filter((F.col("project").isNull() | (F.col("project") == project)) & F.startswith("cve", F.lit("CVE-")))


def cveinfo(raw: DataFrame, order: str = "ord", keys: tuple[str, ...] = ("id", "cve", "upper_cve")) -> DataFrame:
    """(cve, summary, cwe) by the first non-empty of the key columns.

    The third holds the input's `CVE`, which Spark would not tell from `cve`.
    """
    key = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in keys))
    rows = raw.select(key.alias("key"), "summary", "cwe", order).filter(F.startswith("key", F.lit("CVE-")))
    return _last_by(rows, "key", order, "summary", "cwe").withColumnRenamed("key", "cve")


def functions_of(analysis: Column) -> Column:
    """Function names of an analysis list: non-empty, first occurrences."""
    return F.array_distinct(F.filter(F.transform(analysis, lambda a: a["function"]), lambda f: f.isNotNull() & (f != "")))


def change_types(diffs: DataFrame) -> DataFrame:
    """(cve, function, change_type): a function's last type, `unknown` if it has none."""
    rows = diffs.select("cve", F.posexplode("analysis").alias("pos", "a")).filter("coalesce(a.function, '') <> ''")
    kind = F.coalesce(F.nullif(F.col("a.type"), F.lit("")), F.lit("unknown"))
    return rows.groupBy("cve", F.col("a.function").alias("function")).agg(F.max_by(kind, "pos").alias("change_type"))


def function_names(declared: Column, mapped: Column) -> Column:
    """Declared names, then a mapping's further ones."""
    return F.array_distinct(F.concat(F.coalesce(declared, F.array().cast("array<string>")), F.coalesce(mapped, F.array().cast("array<string>"))))


def compact_function(df: DataFrame) -> DataFrame:
    """A function's record for the compact document: prompt code stands in for empty reduced code."""
    return df.withColumn("code", F.coalesce(F.nullif(F.col("reduced_code"), F.lit("")), F.col("prompt_code"), F.lit(""))).drop("reduced_code", "prompt_code")


def function_commit(own: Column, of_cve: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), of_cve, F.lit(""))


def cve_payload(items: DataFrame, item: str = "item") -> DataFrame:
    """Records (cve, item: a JSON object) whose object holds its `cve_id`; one that has the key keeps its value."""
    fields = F.try_variant_get(F.parse_json(item), "$", "map<string,variant>")
    named = F.map_concat(fields, F.create_map(F.lit("cve_id"), F.col("cve").cast("variant")))
    return items.withColumn(item, F.to_json(F.when(F.map_contains_key(fields, "cve_id"), fields).otherwise(named)))

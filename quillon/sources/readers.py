"""Scans of the inputs: JSON documents, texts, env files, symbol tables, configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions.text import strip
from quillon.sources.schemas import MODEL_CONFIG, VIEW_KEYS


def json_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Whole-file JSON, objects or lists of objects; anything else fails the load."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON object `key -> record`; `value` is the record's type."""
    rows = spark.read.text(path, wholetext=True)
    parsed = F.try_variant_get(F.parse_json("value"), "$", "map<string,variant>")
    return rows.select(F.explode(parsed).alias("key", "v")).select("key", F.from_json(F.to_json("v"), value).alias("value"))


def texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, text) of files; bytes that are no UTF-8 are dropped."""
    reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    kept = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return rows.select("path", kept.alias("text"))


def env_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of an env file; see env_lines()."""
    return env_lines(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()), "value", "n")


def env_lines(lines: DataFrame, line: str, order: str, *keys: str) -> DataFrame:
    """(keys, name, value) of env-file lines: blank and `#` lines go, `export ` is stripped, then
    double quotes at either end, then single ones. The first of a name wins, as set names do."""
    rows = lines.select(*keys, F.col(order).alias("__n"), strip(F.col(line)).alias("__l")).filter("__l <> '' and not startswith(__l, '#')")
    rows = rows.withColumn("__l", F.when(F.startswith("__l", F.lit("export ")), strip(F.substring("__l", 8, 1_000_000))).otherwise(F.col("__l"))).filter("contains(__l, '=')")
    parts = F.split("__l", "=", 2)
    value = F.regexp_replace(F.regexp_replace(strip(parts[1]), '^"+|"+$', ""), "^'+|'+$", "")
    named = rows.select(*keys, "__n", strip(parts[0]).alias("name"), value.alias("value")).filter("name <> ''")
    return named.groupBy(*keys, "name").agg(F.min_by("value", "__n").alias("value"))


def with_environment(declared: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing variables, and of the declared ones those that do not exist."""
    return existing.select("name", "value").union(declared.join(existing, "name", "left_anti").select("name", "value"))


def model_config(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The one row of a model configuration (active_profile, aliases, profiles).

    A strict load fails without an active profile or profiles, and where an alias means no profile.
    """
    rows = json_documents(spark, path, MODEL_CONFIG)
    if not strict:
        return rows
    none = F.create_map().cast("map<string,string>")
    lost = F.array_sort(F.array_distinct(F.array_except(F.map_values(F.coalesce("aliases", none)), F.map_keys("profiles"))))
    wrong = F.when(F.coalesce("active_profile", F.lit("")) == "", "model config requires non-empty active_profile").when(F.col("profiles").isNull(), "model config requires a profiles object")
    wrong = wrong.when(F.size(lost) > 0, F.concat(F.lit("model config aliases reference unknown profiles: "), F.array_join(lost, ", ")))
    return rows.filter(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True))


def profile_rows(config: DataFrame) -> DataFrame:
    """Profiles of a model configuration as models.profiles() takes them."""
    rows = config.select(F.explode("profiles").alias("name", "p")).select("name", "p.*")
    key = F.col("api_key_env")
    keys = F.when(F.startswith(key, F.lit("[")), F.from_json(key, "array<string>")).when(key.isNotNull(), F.array(key))
    return rows.select(
        "name", "provider", "base_url", "wire_api", "model", keys.alias("api_key_envs"), F.col("requires_openai_auth").alias("requires_auth"), F.col("reasoning.mode").alias("mode"),
        F.col("reasoning.effort").alias("effort"), F.col("codex_provider_name").alias("provider_name"),
    )


def view_config(spark: SparkSession, path: str, section: str) -> DataFrame:
    """The one row of bounds of line views, from a section of a JSON object.

    A missing section, a missing bound or one that is no integer fails the load.
    """
    v = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")
    own = F.try_variant_get(F.try_element_at(v, F.lit(section)), "$", "map<string,variant>")
    rows = spark.read.text(path, wholetext=True).select(own.alias("own"))
    stop = lambda what: F.raise_error(F.lit(what)).cast("long")
    bounds = []
    for key, column in VIEW_KEYS.items():
        bound = F.try_element_at("own", F.lit(key))
        value = F.when(F.col("own").isNull(), stop(f"config section must be a JSON object: {section}")).when(~F.map_contains_key("own", key), stop(f"config missing required key: {section}.{key}"))
        value = value.when(F.schema_of_variant(bound) != "BIGINT", stop(f"config value must be int: {section}.{key}"))
        bounds.append(value.otherwise(F.try_variant_get(bound, "$", "bigint")).alias(column))
    return rows.select(*bounds)


def connector(spark: SparkSession, kind: str, path: str | None = None, **options: str) -> DataFrame:
    """Any source that Spark itself reads."""
    reader = spark.read.format(kind).options(**options)
    return reader.load(path) if path else reader.load()


def results(spark: SparkSession, path: str) -> DataFrame:
    """(cve, binary, v) of results that write_results() has left, each document read whole."""
    kind = "map<string,struct<confidence:string,evidence:array<string>,reasoning:string,status:string>>"
    rows = spark.read.schema("value string, cve string").text(path, wholetext=True)
    return rows.select("cve", F.explode(F.from_json("value", kind)).alias("binary", "v"))

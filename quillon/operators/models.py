"""Model profiles: validation, lookup, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MODES = ("on", "off", "inherit")
EFFORTS = ("low", "medium", "high", "xhigh")
CURRENT = "codex"


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def profiles(raw: DataFrame, prefix: str = "profile-") -> DataFrame:
    """Profiles (name, provider, base_url, wire_api, model, api_key_envs, requires_auth, mode, effort) with `problem`, null if valid.

    The current provider needs nothing else and drops the rest; others need base_url, wire_api,
    model, and a key's variable unless authentication is by account. The first variable counts.
    `provider_name` is what requests call the provider: the profile's own, or else the prefix and
    the profile's name, other characters than letters, digits, line and hyphen made hyphens.
    """
    own = F.col("provider_name") if "provider_name" in raw.columns else F.lit(None).cast("string")
    made = F.concat(F.lit(prefix), F.regexp_replace("name", "[^A-Za-z0-9_-]+", "-"))
    mode = F.coalesce("mode", F.lit("inherit"))
    current = F.col("provider") == CURRENT
    keys = F.coalesce("api_key_envs", F.array().cast("array<string>"))
    problem = (
        F.when(_blank("provider"), "provider is missing")
        .when(~mode.isin(*MODES), "reasoning mode is unknown")
        .when((mode == "on") & ~F.coalesce(F.col("effort").isin(*EFFORTS), F.lit(False)), "reasoning needs an effort")
        .when(F.col("effort").isNotNull() & ~F.col("effort").isin(*EFFORTS), "reasoning effort is unknown")
        .when(~current & (_blank("base_url") | _blank("wire_api") | _blank("model")), "base_url, wire_api and model are needed")
        .when(~current & (F.exists(keys, lambda k: k.isNull() | (k == "")) | (F.col("api_key_envs").isNotNull() & (F.size(keys) == 0))), "api_key_env is no list of names")
        .when(~current & ~F.coalesce("requires_auth", F.lit(False)) & (F.size(keys) == 0), "api_key_env is missing")
        .when(~current & (own == ""), "provider_name is empty")
    )
    keep = lambda c: F.when(~current, c)
    return raw.select(
        "name", "provider", keep(F.col("base_url")).alias("base_url"), keep(F.col("wire_api")).alias("wire_api"), keep(F.col("model")).alias("model"),
        keep(F.try_element_at(keys, F.lit(1))).alias("api_key_env"), F.when(current, False).otherwise(F.coalesce("requires_auth", F.lit(False))).alias("requires_auth"),
        mode.alias("mode"), "effort", F.when(current, "").otherwise(F.coalesce(own, made)).alias("provider_name"), problem.alias("problem"),
    )


def dangling_aliases(aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Alias targets (alias, target) that are no profile, in order."""
    return aliases.select(F.col("target").alias("name")).distinct().join(known, "name", "left_anti").orderBy("name")


def resolved(requests: DataFrame, aliases: DataFrame, known: DataFrame, active: str) -> DataFrame:
    """Requests (id, provider, profile) with the profile's name, or `problem` listing what there is.

    A provider's alias precedes a profile's name, which precedes the active profile.
    """
    have = known.agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("__have"))
    told = aliases.agg(F.array_join(F.sort_array(F.collect_set("alias")), ", ").alias("__told"))
    rows = requests.join(aliases.withColumnRenamed("alias", "provider"), "provider", "left").crossJoin(F.broadcast(have)).crossJoin(F.broadcast(told))
    asked = ~_blank("provider")
    name = F.when(asked, F.col("target")).otherwise(F.coalesce("profile", F.lit(active)))
    rows = rows.withColumn("name", name).join(known.select("name", F.lit(True).alias("__k")), "name", "left")
    problem = F.when(asked & F.col("target").isNull(), F.concat(F.lit("unknown provider alias; available: "), "__told")).when(F.col("__k").isNull(), F.concat(F.lit("unknown profile; available: "), "__have"))
    return rows.select("id", "name", problem.alias("problem"))


def reasoning_effort(flag: Column, mode: Column, effort: Column) -> Column:
    """A flag precedes the profile's effort, which counts while reasoning is on."""
    return F.coalesce(F.nullif(flag, F.lit("")), F.when(mode == "on", effort))


def provider_overrides(name: Column, base_url: Column, wire_api: Column, api_key_env: Column, requires_auth: Column, current: Column) -> Column:
    """Command-line settings that put a provider in force; none for the current one."""
    quoted = lambda key, value: F.concat(F.lit(f'{key}="'), value, F.lit('"'))
    fields = F.concat_ws(", ", quoted("name", name), quoted("base_url", base_url), quoted("env_key", api_key_env), quoted("wire_api", wire_api), F.concat(F.lit("requires_openai_auth="), requires_auth.cast("string")))
    pair = F.concat(F.lit("model_providers."), name, F.lit("={"), fields, F.lit("}"))
    return F.when(current, F.array().cast("array<string>")).otherwise(F.array(F.lit("-c"), quoted("model_provider", name), F.lit("-c"), pair))


def without_proxy(existing: Column, *hosts: Column) -> Column:
    """A no-proxy list with those hosts appended that it lacks."""
    items = F.filter(F.transform(F.split(F.coalesce(existing, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    wanted = F.filter(F.array_distinct(F.array(*hosts)), lambda h: h.isNotNull() & (h != ""))
    return F.array_join(F.concat(items, F.array_except(wanted, items)), ",")

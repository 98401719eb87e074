"""Selecting CVEs, planning and resuming tasks, naming targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import run_id_of
from quillon.sources.tables import written

#: The verdict of a CVE without metadata.
NO_METADATA = ("Cannot inspect patch presence without metadata.", " not found in project metadata JSON")


def select_cves(df: DataFrame, wanted: DataFrame | None = None, limit: int | None = None, zero_is_all: bool = False) -> DataFrame:
    """CVEs in code-point order, of those wanted, at most `limit`.

    With limit 0 nothing is selected, or everything where zero_is_all is set.
    """
    rows = df if wanted is None else df.join(wanted.select("cve").distinct(), "cve", "left_semi")
    rows = rows.orderBy("cve")
    return rows if limit is None or (zero_is_all and limit == 0) else rows.limit(limit)


def select_in_order(df: DataFrame, order: str, limit: int = 0) -> DataFrame:
    """Rows in input order, at most `limit`; 0 means all."""
    return df.orderBy(order).limit(limit) if limit else df


def tasks(testset: DataFrame, binarywise: bool = False) -> DataFrame:
    """(run_id, cve, binaries): a task for each CVE, or for each of its binaries."""
    if binarywise:
        rows = testset.select("cve", F.posexplode("binaries").alias("pos", "b"))
        return rows.select(run_id_of(F.concat_ws("__", "cve", "b")).alias("run_id"), "cve", F.array("b").alias("binaries"))
    return testset.select(run_id_of(F.col("cve")).alias("run_id"), "cve", "binaries")


def pending(planned: DataFrame, done: DataFrame, resume: bool = True, retry_errors: bool = False) -> DataFrame:
    """Tasks that still have to run, given earlier verdicts (cve, binary, status).

    A task is done if all its binaries have a verdict and, with retry_errors, none is an error.
    """
    if not resume:
        return planned
    each = planned.select("run_id", "cve", F.explode("binaries").alias("binary"))
    seen = done.groupBy("cve", "binary").agg(F.bool_or(F.col("status") == "error").alias("failed"))
    state = each.join(seen, ["cve", "binary"], "left").groupBy("run_id").agg(
        F.bool_and(F.col("failed").isNotNull()).alias("whole"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed")
    )
    finished = state.filter(F.col("whole") & ~(F.lit(retry_errors) & F.col("failed")))
    return planned.join(finished, "run_id", "left_anti")


def with_metadata(planned: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runnable tasks with metadata, error verdicts of tasks whose CVE has none)."""
    joined = planned.join(metadata.withColumn("__has", F.lit(True)), "cve", "left")
    missing = joined.filter("__has is null").select("cve", F.explode("binaries").alias("binary"))
    return joined.filter("__has").drop("__has"), error_rows(missing, F.lit(NO_METADATA[0]), F.concat(F.col("cve").cast("string"), F.lit(NO_METADATA[1])))


def exposed_answers(answers: DataFrame, visible: DataFrame) -> DataFrame:
    """(path, root) of ground-truth files that lie under a folder which the judge can see.

    A path is joined by each of its parent folders, so that the join is on equal names.
    """
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = answers.select("path", F.explode(parents).alias("__top"))
    return under.join(visible.select("root", F.regexp_replace("root", "/+$", "").alias("__top")), "__top").select("path", "root")


def error_rows(binaries: DataFrame, reason: Column, evidence: Column) -> DataFrame:
    """A low-confidence error verdict for every (cve, binary)."""
    return binaries.select("cve", "binary", F.lit("error").alias("status"), F.lit("low").alias("confidence"), F.array(evidence).alias("evidence"), reason.alias("reasoning"))


def progress(planned: DataFrame, order: str) -> DataFrame:
    """Tasks with their launch ordinal, from 1.

    Rows are sorted by ranges; a row's ordinal is its place in its range and the rows of the ranges
    before, of which the driver sees one number each.
    """
    spark = planned.sparkSession
    ranges = written(planned.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("__range", F.spark_partition_id()))
    sums, total = [], 0
    for r in sorted(ranges.groupBy("__range").agg(F.count("*").alias("rows")).collect()):
        sums.append((r["__range"], total))
        total += r["rows"]
    offsets = F.broadcast(spark.createDataFrame(sums, "__range int, __before long"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranges.join(offsets, "__range").withColumn("n", F.col("__before") + place).drop("__range", "__before")


def anonymous_names(targets: DataFrame, group: str, order: str) -> DataFrame:
    """Targets of each group numbered target_001 on in request order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return targets.withColumn("anonymous", F.format_string("target_%03d", n))


def resolve_binaries(requests: DataFrame, files: DataFrame, opt: Column) -> DataFrame:
    """Requests (binary) with the target file that stands for them.

    An exact name precedes `-deployed`, which precedes the name with compiler and level; the last
    is the answer even if there is no such file.
    """
    names = files.select(F.col("name").alias("f")).distinct()
    asked = requests.withColumn("__third", F.concat_ws("-", "binary", "compiler", opt)).withColumn("__second", F.concat("binary", F.lit("-deployed")))
    for key, col in (("__a", "binary"), ("__b", "__second")):
        asked = asked.join(names.withColumnRenamed("f", key), F.col(col) == F.col(key), "left")
    return asked.withColumn("actual", F.coalesce("__a", "__b", "__third")).drop("__a", "__b", "__second", "__third")


def first_existing(candidates: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Of each key's candidate paths the first that exists, else the first of all."""
    order = F.struct((~F.coalesce("exists", F.lit(False))).alias("absent"), F.col(rank))
    return candidates.groupBy(key).agg(F.min_by("path", order).alias("path"))


#: What a run needs, and where a project keeps it, best place first.
NEEDED = ("project_json", "testset_json", "target_dir", "output")
PLACES = {
    "project_json": ("{base}/{project}/{project}.json", "{base}/{project}.json"),
    "testset_json": ("{base}/{project}/testset.json", "{base}/testset.json"),
    "target_dir": ("{binaries}/{project}_gcc", "{base}/{project}/targets", "{base}/{project}/gcc", "{base}/{project}"),
}


def derived_paths(requests: DataFrame, present: DataFrame) -> DataFrame:
    """Requests (id, project, base, binaries, opt and NEEDED) with what is not given derived from the project.

    Of a path's places the first that is among `present` (path), else the first. `problem` names
    what is neither given nor derived.
    """

    def filled(place: str) -> Column:
        for key in ("base", "binaries", "project"):
            place = place if isinstance(place, Column) else F.lit(place)
            place = F.replace(place, F.lit("{" + key + "}"), F.col(key))
        return place

    has = present.select(F.col("path").alias("__path")).distinct().withColumn("exists", F.lit(True))
    named = F.coalesce("project", F.lit("")) != ""
    out = requests
    for name, places in PLACES.items():
        each = requests.filter(named).select("id", F.posexplode(F.array(*map(filled, places))).alias("rank", "__path")).join(has, "__path", "left")
        best = first_existing(each.withColumnRenamed("__path", "path"), "id").select("id", F.col("path").alias("__best"))
        out = out.join(best, "id", "left").withColumn(name, F.coalesce(name, "__best")).drop("__best")
    out = out.withColumn("output", F.coalesce("output", F.when(named, F.concat("base", F.lit("/runs/"), "project", F.lit("_"), "opt", F.lit("_codex_results.json")))))
    lacking = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit("--" + n.replace("_", "-"))) for n in NEEDED)))
    problem = F.when(F.size(lacking) > 0, F.concat(F.lit("missing required arguments: "), F.array_join(lacking, ", "), F.lit("; or provide --project")))
    return out.withColumn("problem", problem)


def required(derived: DataFrame) -> DataFrame:
    """Requests of derived_paths(); one that lacks a path fails the query."""
    return derived.filter(F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(True))

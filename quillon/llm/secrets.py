"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every text is addressed by its content. A (blob, rule version) pair is scanned once: pairs that a
ledger from earlier runs already holds are left out, copies of a text are one blob, and findings
are joined back to every row (path) that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh, materialise

#: Increase whenever a rule below changes: ledgers of other versions then no longer count.
RULES_VERSION = 1


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the least length of a group of the match (0: all of it)."""

    kind: str
    pattern: str
    group: int
    least: int


#: Fixed values. The first three are the base; their order ranks spans that start together.
RULES = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 1),
)
BASE = 3


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def _scan_pattern(rule: Rule) -> str:
    """Runs of one class are matched at their least length at once, which spares short matches."""
    if rule.pattern.endswith("]+") and rule.group == 0 and rule.least > 1:
        head = rule.pattern[: rule.pattern.rindex("[")]
        return f"{rule.pattern[:-1]}{{{rule.least - len(head.replace('[oprsu]', 'x'))},}}"
    return rule.pattern


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, spans array<struct<start, rank, kind, end>>) of the blobs (blob, text) that hold secrets.

    start and end count code points, end exclusive. Blobs without secrets have no row, an empty or
    null text has none, a blob that is given twice counts its spans twice, and an empty table gives
    no rows. A pattern's matches and the gaps between them
    give all lengths; running sums of these place the matches.
    """
    found = [F.expr(f"regexp_extract_all(text, '{_quoted(_scan_pattern(r))}', 0)").alias(f"m{i}") for i, r in enumerate(RULES)]
    hits = blobs.select("blob", "text", *found).filter(" or ".join(f"size(m{i}) > 0" for i in range(len(RULES))))

    def lengths(i: int, r: Rule) -> str:
        p, m = _quoted(_scan_pattern(r)), f"m{i}"
        told = f"transform(regexp_extract_all(text, '{p}', {r.group}), x -> length(x))" if r.group else f"transform({m}, x -> length(x))"
        zipped = f"arrays_zip(transform(slice(split(text, '{p}', -1), 1, size({m})), x -> length(x)) as gap, transform({m}, x -> length(x)) as len, {told} as told)"
        zipped = zipped.replace(" as gap", "").replace(" as len", "").replace(" as told", "")
        return f"case when size({m}) > 0 then transform({zipped}, (x, j) -> struct({i} as rank, j as j, x['0'] as gap, x['1'] as len, x['2'] as told)) end"

    each = hits.select("blob", F.explode(F.expr(f"flatten(filter(array({', '.join(lengths(i, r) for i, r in enumerate(RULES))}), x -> x is not null))")).alias("x")).select("blob", "x.*")
    end = F.expr("sum(gap + len) over (partition by blob, rank order by j rows unbounded preceding)")
    kinds = F.element_at(F.array(*(F.lit(r.kind) for r in RULES)), F.col("rank") + 1)
    least = F.element_at(F.array(*(F.lit(r.least) for r in RULES)), F.col("rank") + 1)
    placed = each.withColumn("end", end).filter(F.col("told") >= least)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "rank", kinds.alias("kind"), "end")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): paths are (id, blob, spans) of every row, ledger is the old one plus what was scanned.

    A ledger has (blob, version, spans); blobs without secrets are in it with an empty array, so
    that they are never scanned again. Null and empty texts are one blob without spans. Repeated
    rows and rows with null ids each keep their row. An empty table gives empty tables.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    # copies are combined where they are read, so that a blob of many rows is no task's alone
    unseen, paths = rows.filter("text <> ''").groupBy("blob").agg(F.first("text").alias("text")), rows.select("id", "blob")
    scanned = paths.select("blob").distinct()
    if ledger is not None:
        seen = ledger.filter(F.col("version") == RULES_VERSION)
        unseen, scanned = unseen.join(seen.select("blob"), "blob", "left_anti"), scanned.join(seen, "blob", "left_anti")
    found = materialise(scan(unseen))
    known = found if ledger is None else found.union(seen.select("blob", "spans"))
    empty = F.expr("array()").cast(found.schema["spans"].dataType)
    added = scanned.join(found, "blob", "left").select("blob", F.lit(RULES_VERSION).alias("version"), F.coalesce("spans", empty).alias("spans"))
    whole = added if ledger is None else ledger.select("blob", "version", "spans").union(added)
    return paths.join(known, "blob", "left").select("id", "blob", F.coalesce("spans", empty).alias("spans")), whole


def merged(spans: str) -> str:
    """SQL for an array of spans in order, as disjoint (start, end) pairs that cover the same characters."""
    fold = f"aggregate({spans}, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) -> case when size(a) > 0 and s.start <= a[size(a) - 1].end then concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start as start, greatest(a[size(a) - 1].end, s.end) as end))) else concat(a, array(struct(s.start as start, s.end as end))) end)"
    return fold


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with every secret replaced by a mark and n_chars brought up to date.

    Spans that overlap become one mark. Rows without secrets stay as they are, null and empty texts
    too; rows that repeat a text are all marked. Columns are those of the input, whatever their
    names. An empty table gives no rows.
    """
    blob, spans = fresh(docs, "secret_blob"), fresh(docs, "secret_spans")
    keyed = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256))
    blobs = keyed.filter("text <> ''").groupBy(F.col(blob).alias("blob")).agg(F.first("text").alias("text"))
    found = materialise(scan(blobs)).select(F.col("blob").alias(blob), F.expr(merged("spans")).alias(spans))
    joined = keyed.join(found.hint("merge"), blob, "left")  # shuffled at every size
    kept = "concat(array_join(transform({s}, (s, i) -> concat(substring(text, cast(case when i = 0 then 0 else {s}[i - 1].end end as int) + 1, cast(s.start - case when i = 0 then 0 else {s}[i - 1].end end as int)), '{mark}')), ''), substring(text, cast({s}[size({s}) - 1].end as int) + 1))"
    kept = kept.replace("{s}", spans).replace("{mark}", _quoted(mark))
    text: Column = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.expr(kept))
    out = joined.withColumn("text", text)
    out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)

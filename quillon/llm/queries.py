"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import audit, chat, codes, forest, maxent, mixing, multiset, packing, pieces, quality, secrets, simhash, toxicity
from quillon.llm.common import materialise

#: A conversation that the template must survive.
PROBE = (-7, r"\### Assistant: </turn> ok")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.size("draws")).cast("long")
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), "source", F.col("draws.shard").alias("shards"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(_table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, said = PROBE
    probe = spark.createDataFrame([(conv, 0, "user", said), (conv, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(turns.unionByName(probe)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes in two deliveries, as versions of a history do: what is new at first, then all of it.
    The second scans only blobs that the first one's ledger lacks and joins findings back to every row."""
    docs = _table(spark, sf_dir, "documents")
    _, ledger = secrets.secrets(docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))))
    paths, _ = secrets.secrets(docs, ledger=materialise(ledger))

    def told(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {i})) as bigint)").alias(f"n_{secrets.RULES[i].kind}") for i in range(secrets.BASE)]
    base = F.sha2(F.expr(told(f"filter(spans, s -> s.rank < {secrets.BASE})")), 256).alias("base_sha256")
    return paths.select(F.col("id").alias("doc_id"), *counts, base, F.expr(told("spans")).alias("spans"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edits(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_mixing, op3_sentencepiece, op4_lm_scoring, op5_chat_formatting, op6_secrets, op7_fingerprints, op8_quality, op9_nearest, op10_simhash, op11_packing, op12_filter_audit, op13_vector_codes)
    return {f.__name__: f for f in own}


def _secret_sql() -> str:
    """Places matches by the lengths of matches and of what splitting leaves between them."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, unnest(regexp_extract_all(t, '{p}', 0)) AS hit, "
            f"unnest(regexp_extract_all(t, '{p}', {r.group})) AS told, "
            f"unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}', 0)))) AS gap, "
            f"generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) AS j FROM d WHERE regexp_matches(t, '{p}')"
        )
    counts = ", ".join(f"coalesce(count(*) FILTER (rank = {i}), 0) AS n_{secrets.RULES[i].kind}" for i in range(secrets.BASE))
    zero = ", ".join(f"CAST(coalesce(n_{secrets.RULES[i].kind}, 0) AS BIGINT) AS n_{secrets.RULES[i].kind}" for i in range(secrets.BASE))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, rank ORDER BY j) AS e FROM m),
good AS (SELECT rid, rank, kind, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE length(told) >= least),
told AS (SELECT rid, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {secrets.BASE}) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM good GROUP BY rid)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)
"""


#: All orders are built by joining letters; a filter fails by its bit of the mask.
AUDIT_SQL = r"""
WITH said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN said USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
g AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM s),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
    FROM c, g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


def _codes_sql() -> str:
    """Lloyd rounds written out: every round's codebook is a table of its own. Components stay far below what doubles hold."""
    size = f"len(v) // {codes.PARTS}"

    def hits(of: str, book: str) -> str:
        dist = "list_inner_product(p, p) - 2 * list_inner_product(p, c) + list_inner_product(c, c)"
        return f"SELECT {of}, j, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (SELECT {of}, j, p, e, {dist} AS d FROM parts JOIN {book} USING (j)) GROUP BY {of}, j, p"

    rounds = []
    for k in range(codes.ROUNDS):
        rounds.append(f"""h{k} AS MATERIALIZED ({hits('vec_id', f'b{k}')}),
m{k} AS (SELECT j, e, i, floor(sum(p[i])::DOUBLE / count(*)) AS c FROM (SELECT j, e, p, unnest(range(1, len(p) + 1)) AS i FROM h{k}) GROUP BY j, e, i),
b{k + 1} AS MATERIALIZED (SELECT b{k}.j, b{k}.e, coalesce(n.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT j, e, list(c ORDER BY i) AS c FROM m{k} GROUP BY j, e) n USING (j, e))""")
    last = codes.ROUNDS
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, j, v[j * ({size}) + 1 : (j + 1) * ({size})] AS p FROM (SELECT *, unnest(range({codes.PARTS})) AS j FROM v)),
b0 AS MATERIALIZED (SELECT j, e - 1 AS e, p AS c FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY vec_id) AS e FROM parts) WHERE e <= {codes.ENTRIES}),
{", ".join(rounds)},
done AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({hits('vec_id', f'b{last}')}) GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY j, e)) FROM b{last}) AS codebooks_sha256 FROM done JOIN v USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_secrets": _secret_sql(), "op12_filter_audit": AUDIT_SQL, "op13_vector_codes": _codes_sql()}

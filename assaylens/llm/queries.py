"""The registered queries of the text operators and, where there is one, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.llm import (
    centroids,
    conversations,
    decontaminate,
    exact_dedup,
    html_main,
    license_scan,
    line_dedup,
    packing,
    pii,
    prefix_bpe,
    simhash,
    toxicity,
    url_filter,
)
from assaylens.llm.tables import read
from assaylens.operators.ranking import join_back

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages, by rules and else by boosted trees."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.labels(pages))
    return url_filter.judge(pages, model).select("page_id", "url_verdict.*")


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in ten-word windows of benchmark items."""
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        decontaminate.digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op3_decontamination"] = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
doc_words AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM item_words WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT k FROM sized),
places AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, sizes WHERE len(w) >= k),
hits AS (
  SELECT p.doc_id, p.i, p.k, g.item_id
  FROM places p JOIN grams g ON g.k = p.k AND g.gram = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that match an earlier one."""
    found = line_dedup.report(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_lines",
        "n_removed",
        "n_links",
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
    )


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, plain and disguised."""
    found = pii.scan(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
        "n_disguised",
    )


@query
def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = html_main.extract(read(spark, sf_dir, "pages"))
    return found.withColumnRenamed("id", "page_id")


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.drop("row").withColumnRenamed("id", "doc_id")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a lexicon learned from the labels."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        toxicity.score(F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents; the largest doc_id stays."""
    found = exact_dedup.classes(read(spark, sf_dir, "documents"), keep="largest")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


SQL["op9_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of all documents."""
    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the multilingual byte-level vocabulary, and decoded again."""
    model = prefix_bpe.encoder(spark)
    found = prefix_bpe.decode(prefix_bpe.encode(read(spark, sf_dir, "documents"), model), model)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(prefix_bpe.joined_ids(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, audited and repaired."""
    turns = read(spark, sf_dir, "conversations")
    audits, repaired = conversations.repair(conversations.damage(turns))
    found = join_back(turns.select("conv_id").distinct(), audits, ["conv_id"], "left")
    found = join_back(found, conversations.digests(repaired), ["conv_id"], "left")
    zero = F.lit(0).cast("bigint")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _edit_sql(cost: str, letter: str, line: str | None, to: str) -> str:
    lines = f"list_prepend({line}, {to}.lines)" if line else f"{to}.lines"
    return f"struct_pack(cost := {cost} + {to}.cost, audit := '{letter}' || {to}.audit, lines := {lines})"


def _least_sql(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _turn_sql(state: int) -> str:
    """The least (cost, audit, lines) of the edits that consume a turn, in one state."""
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    to, role = (3, "assistant") if state == 2 else (2, "user")
    delete = _edit_sql("4", "D", None, f"v{state}")
    cases = " ".join(
        f"WHEN g = '{initial}' THEN {_edit_sql('extra', 'K', 'line', f'v{after}')}" for initial, after in keep.items()
    )
    reroled = _edit_sql("3 + extra", "R", f"'{role}:' || text", f"v{to}")
    kept = _least_sql(delete, f"CASE {cases} ELSE {delete} END", reroled)
    return f"CASE WHEN gone THEN {delete} ELSE {kept} END"


_INSERT_USER, _INSERT_ASSISTANT = "'user:'", "'assistant:'"

SQL["op12_conversations"] = f"""
WITH RECURSIVE
bits AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tables AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
faults AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) % 20 AS fault
  FROM keyed, tables),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM faults WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS g, role || ':' || text AS line,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair
  FROM placed),
turns AS (
  SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM marked),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT gone) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
solved AS (
  SELECT conv_id, n + 1 AS p,
    struct_pack(cost := 0, audit := '', lines := CAST([] AS VARCHAR[])) AS v0,
    struct_pack(cost := 6, audit := 'II', lines := ['user:', 'assistant:']) AS v1,
    struct_pack(cost := 3, audit := 'I', lines := ['assistant:']) AS v2,
    struct_pack(cost := 0, audit := '', lines := CAST([] AS VARCHAR[])) AS v3
  FROM counts
  UNION ALL
  SELECT conv_id, p, {_least_sql("w0", _edit_sql("3", "I", _INSERT_USER, "x2"))},
    {_least_sql("w1", _edit_sql("3", "I", _INSERT_USER, "x2"))}, x2, x3
  FROM (
    SELECT conv_id, p, w0, w1, {_least_sql("w2", _edit_sql("3", "I", _INSERT_ASSISTANT, "w3"))} AS x2,
      {_least_sql("w3", _edit_sql("3", "I", _INSERT_USER, "w2"))} AS x3
    FROM (
      SELECT s.conv_id, t.p, {", ".join(f"{_turn_sql(state)} AS w{state}" for state in range(4))}
      FROM solved s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.p = s.p - 1))),
answers AS (SELECT conv_id, v0 FROM solved WHERE p = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v0.cost, 0) AS BIGINT) AS cost,
  coalesce(v0.audit, '') AS audit, sha256(coalesce(array_to_string(v0.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN answers a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings clustered around 40 centroids in five rounds."""
    found = centroids.cluster(read(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        centroids.centroid_digest(F.col("centroid")).alias("centroid_sha256"),
    )


def _rounds_sql() -> str:
    """The centroids of each round from those before: c0 to c5, and the last assignment."""
    out = []
    for n in range(centroids.ROUNDS + 1):
        out.append(f"""
d{n} AS MATERIALIZED (
  SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} c USING (i) GROUP BY v.r, c.k),
a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM d{n} GROUP BY r)""")
        if n < centroids.ROUNDS:
            out.append(f"""
s{n} AS (
  SELECT a.best.k AS k, v.i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{n} a USING (r) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (
  SELECT c.k, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS x
  FROM c{n} c LEFT JOIN s{n} s ON s.k = c.k AND s.i = c.i)""")
    return ",".join(out)


SQL["op13_centroids"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
v AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(e) AS x FROM kept),
c0 AS MATERIALIZED (SELECT r AS k, i, x FROM v WHERE r < {centroids.K}),{_rounds_sql()},
f AS (SELECT r, best.k AS k, CAST(best.d AS BIGINT) AS distance FROM a{centroids.ROUNDS}),
g AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{centroids.ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM f JOIN kept USING (r) JOIN g USING (k)
"""

"""One query per operator, over the whole given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import configure
from plumbline.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    filter_audit,
    html_text,
    jaccard,
    language_id,
    lattice_lm,
    packing,
    quality,
    secrets,
    substring,
    vector_codes,
)
from plumbline.llm.common import prepare, split_of, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(configure(spark)), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_of("doc_id", 4) == 2
    model = language_id.train(docs.filter(~held_out))
    named = docs.withColumn("held_out", held_out)
    return language_id.predict(named, model, keep=("doc_id", "held_out"))


@query(
    "op2_decontaminate",
    r"""
    WITH item AS (
      SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
    win AS (
      SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
    doc AS (
      SELECT doc_id, coalesce(regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
      FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
    size AS (SELECT DISTINCT n FROM win),
    place AS (
      SELECT doc_id, i, n, w[i : i + n - 1] AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
    found AS (SELECT doc_id, i, place.n, item_id FROM place JOIN win ON place.g = win.g),
    hit AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("longest")


@query(
    "op3_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, offsets=False)
    return bpe.decode(encoded, BYTE_BPE).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = split_of("doc_id", 3) == 1
    measured = quality.measure(docs.withColumn("held_out", held_out), keep=("doc_id", "held_out"))
    model = quality.train(measured.filter(~F.col("held_out")), labels)
    return quality.score(measured, model, keep=("doc_id", "held_out"))


@query("op9_ngram_jaccard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"))


@query("op10_lattice_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = split_of("doc_id", 10) != 0
    docs = table(spark, sf_dir, "documents").withColumn("_learn", learn)
    scored = lattice_lm.score(docs, "_learn", PIECES)
    return scored.withColumn("held_out", ~F.col("_learn")).drop("_learn")


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out, one pair of subqueries each."""
    apart = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(cut.v, c.v)])"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    a{r} AS MATERIALIZED (
      SELECT vec_id, label, p, any_value(v) AS v, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d
      FROM (SELECT vec_id, label, cut.p, cut.v, c.e, CAST({apart} AS BIGINT) AS d FROM cut JOIN c{r} c ON cut.p = c.p)
      GROUP BY vec_id, label, p)""")
        if r < rounds:
            steps.append(f"""
    c{r + 1} AS MATERIALIZED (
      SELECT p, e, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
        SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
        FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n
              FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, e, i)
        GROUP BY p, e) m USING (p, e))""")
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
      FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    cut AS MATERIALIZED (
      SELECT vec_id, label, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS v
      FROM kept, range({parts}) AS r(p)),
    c0 AS MATERIALIZED (
      SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut
      QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}),{",".join(steps)},
    books AS (
      SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
      FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c{rounds})),
    coded AS (
      SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a{rounds} GROUP BY vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded, books
    """


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.digest).alias("codebooks_sha256")
    return codes.select("vec_id", "code", "error", "label_error", digest)


@query("op12_pattern_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE_JSON)


@query(
    "op13_filter_audit",
    r"""
    WITH doc AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    label AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
    flag AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * (strlen(t) - strlen(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
      FROM doc LEFT JOIN label USING (doc_id)),
    tally AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flag GROUP BY part, fails),
    letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
      FROM letter a JOIN letter b ON b.x <> a.x JOIN letter c ON c.x NOT IN (a.x, b.x)
      JOIN letter d ON d.x NOT IN (a.x, b.x, c.x) JOIN letter e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
    steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1 : step - 1] AS before FROM orders, range(1, 6) AS r(step)),
    state AS (
      SELECT part, filter_order, step, f, n, good, toxic, fails = f AS lone,
             contains(fails, f) AS hit,
             len(translate(fails, before, '')) < len(fails) AS gone
      FROM tally, steps),
    total AS (
      SELECT part, filter_order, step, f,
             sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN lone THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM state GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM total
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = filter_audit.failures(table(spark, sf_dir, "documents"))
    return filter_audit.interactions(filter_audit.with_labels(flagged, table(spark, sf_dir, "labels")), "ABCDE")

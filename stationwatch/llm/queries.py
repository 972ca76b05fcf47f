"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest, remove_repeats

    return digest(remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify

    return identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "offset")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .decontam import contamination

    found = contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", F.col("items").cast("array<string>")).alias("item_ids"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import link

    return link(_table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, score

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    found = assess(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import cluster

    return cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_language_id": op3_language_id,
        "op4_source_mixing": op4_source_mixing,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_toxicity": op8_toxicity,
        "op9_html_extraction": op9_html_extraction,
        "op10_secret_scan": op10_secret_scan,
        "op11_phrase_mining": op11_phrase_mining,
        "op12_quality_rules": op12_quality_rules,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


#: Word shingles, their common counts by document pair, and reachability over the links.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id, n.doc_id = min(reach) AS kept FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
"""


#: All n-grams of pieces by language, their parts' counts at every cut, and what stands inside longer ones.
PHRASES_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 5) x(k)) GROUP BY 1, 2, 3 HAVING k = 1 OR count(*) >= 30),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
parts AS (SELECT lang, k, phrase, f, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS rest FROM c, range(1, 4) x(j) WHERE j < k),
best AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.f // (l.f + r.f) AS BIGINT) AS score FROM parts c JOIN f l ON c.lang = l.lang AND c.head = l.phrase JOIN f r ON c.lang = r.lang AND c.rest = r.phrase
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, phrase, max(f) AS longest FROM (SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM c, range(2, 4) y(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase WHERE i.longest IS NULL OR 100::HUGEINT * i.longest < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

#: Repeated windows of 4, 8 and 201 words say what the maximal repeats say: words in some of 4 or more, and whether one is longer than 200.
QUALITY_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'g': array_to_string(w[i:i + k - 1], ' '), 'i': i})) AS x FROM d, (VALUES (4), (8)) x(k)),
h AS MATERIALIZED (SELECT id, k, x.g AS g, list(x.i) AS places FROM s GROUP BY 1, 2, 3 HAVING count(*) > 1),
o AS (SELECT id FROM (SELECT id, unnest(places) AS i FROM h WHERE k = 8) JOIN d USING (id) WHERE i + 200 <= len(w) GROUP BY id, array_to_string(w[i:i + 200], ' ') HAVING count(*) > 1),
c AS (SELECT id, k, count(DISTINCT i) AS n FROM (SELECT id, k, unnest(range(i, i + k)) AS i FROM (SELECT id, k, unnest(places) AS i FROM h)) GROUP BY 1, 2),
l AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(e.n, 0) AS n_repeat_words,
    coalesce(f.n, 0) AS covered, d.id IN (SELECT id FROM o) AS long_one FROM d LEFT JOIN l ON d.id = l.id LEFT JOIN c e ON d.id = e.id AND e.k = 8 LEFT JOIN c f ON d.id = f.id AND f.k = 4)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * covered <= 50 * n_words AND NOT long_one AS kept FROM m
"""


def _clusters_sql() -> str:
    """Rounds of assignment and floored means over arrays of whole numbers."""
    far = "list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, x FROM v ORDER BY cluster LIMIT 40)",
    ]
    for k in range(6):
        parts.append(f"a{k} AS MATERIALIZED (SELECT id, arg_min(cluster, (far, cluster)) AS cluster, min(far) AS distance FROM (SELECT v.id, c.cluster, {far} AS far FROM v, c{k} c) GROUP BY 1)")
        if k < 5:
            parts.append(f"m{k} AS (SELECT cluster, list(q ORDER BY j) AS x FROM (SELECT cluster, j, (s - ((s % n) + n) % n) // n AS q FROM (SELECT a.cluster, j, CAST(sum(v.x[j]) AS HUGEINT) AS s, count(*) AS n FROM v JOIN a{k} a USING (id), range(1, 65) t(j) GROUP BY 1, 2)) GROUP BY 1)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (cluster))")
    return f"""WITH {", ".join(parts)}, i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY 1)
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a5) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a5 a USING (id) JOIN c5 c ON a.cluster = c.cluster JOIN i ON a.cluster = i.cluster"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": NEAR_DUPLICATES_SQL, "op11_phrase_mining": PHRASES_SQL, "op12_quality_rules": QUALITY_SQL, "op13_centroid_clustering": _clusters_sql()}

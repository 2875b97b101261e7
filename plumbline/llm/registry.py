"""Queries of the training-data operators: name, function, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import balltree, bestfit, exact, langid, lines, minhash, neighbours, packing, pages, substring, toxicity, wfst, whitening
from plumbline.llm.common import documents

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(documents(spark, folder))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_groups(documents(spark, folder))


def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    out = langid.languages(documents(spark, folder))
    return out.withColumn("held_out", langid.held_out())


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return wfst.encoded(documents(spark, folder), tokenizer(PIECE_BPE))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.toxicity(documents(spark, folder), labels)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), tokenizer(BYTE_BPE))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring.repeats(documents(spark, folder))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extracted(spark.read.parquet(f"{folder}/pages.parquet"))


def op10_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.fuzzy_lines(documents(spark, folder))
    digest = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return balltree.ranked(documents(spark, folder), items).select("item_id", "rank", "doc_id", "score")


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit.best_two_fit(documents(spark, folder), tokenizer(BYTE_BPE))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_minhash_near_dedup, op3_nearest_neighbours, op4_language_id, op5_sentencepiece, op6_toxicity, op7_packing, op8_substring_dedup, op9_html_extraction, op10_fuzzy_lines, op11_ranked_search, op12_best_fit_packing, op13_embedding_whitening)}

ORACLE = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
            count(*) OVER (PARTITION BY text_sha256) AS group_size,
            doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i
                  FROM w WHERE len(words) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS MATERIALIZED (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
        reach(node, other) AS (
            SELECT a, b FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles,
            least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id,
            least(d.doc_id, coalesce(min(r.other), d.doc_id)) = d.doc_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.node = d.doc_id
        GROUP BY d.doc_id
    """,
    "op8_substring_dedup": r"""
        WITH w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        g AS MATERIALIZED (
            SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS gram
            FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i
                  FROM w WHERE len(words) > 12)),
        f AS MATERIALIZED (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram),
        gone AS MATERIALIZED (
            SELECT DISTINCT doc_id, i + unnest(generate_series(0, 12)) AS pos
            FROM g JOIN f USING (gram) WHERE first_id < doc_id),
        lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept_text
            FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w)
                ANTI JOIN gone USING (doc_id, pos)
            GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(kept_text, '')) AS kept_sha256
        FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op11_ranked_search": r"""
        WITH docs AS MATERIALIZED (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM docs GROUP BY ALL),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM docs GROUP BY doc_id),
        corpus AS MATERIALIZED (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM n),
        w AS MATERIALIZED (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
        asked AS MATERIALIZED (
            SELECT item_id, term, count(*) AS q
            FROM (SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark)
            GROUP BY ALL),
        s AS (
            SELECT item_id, doc_id, sum(q * w * (1000000000 * tf
                // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))))::BIGINT AS score
            FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), corpus
            GROUP BY ALL)
        SELECT item_id, rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
              FROM s WHERE score > 0)
        WHERE rank <= 20
    """,
    "op3_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_sum(embedding::DOUBLE[]) IS NOT NULL),
        d AS (
            SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(
                [(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.e, b.e)], lambda x, y: x + y)) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
        WHERE rank <= 10
    """,
}

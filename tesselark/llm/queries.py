"""The registered queries over documents, pages and embeddings, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm.shared import crc_mod, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm import langid

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = langid.label(docs, langid.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm import media

    return media.digests(media.media_columns(table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), size=2048, end_id=0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = toxicity.score(docs, toxicity.train(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesselark.llm import bpe

    return bpe.digests(bpe.byte_bpe(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm import pii

    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    found = quality.score(docs, quality.train(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm import pages

    rows = table(spark, sf_dir, "pages")
    return pages.extract(rows, pages.train(rows))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm.clusters import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3:", dim=64, factor=1024)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm.tries import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), every=20, most=3)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselark.llm.leaks import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_language_id, op3_media_columns, op4_best_fit_packing, op5_toxicity,
        op6_exact_top_k, op7_byte_bpe, op8_personal_data, op9_quality, op10_html_text,
        op11_delta_lloyd, op12_conversation_trie, op13_decontamination,
    )
}

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _lloyd_sql(rounds: int) -> str:
    """The rounds one after another, as SQL has no loop that aggregates."""
    nearest = """a{0} AS MATERIALIZED (
            SELECT r, arg_min(c, (d, c)) AS c, CAST(min(d) AS BIGINT) AS d
            FROM (SELECT r, c.c, list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v) AS d FROM k, c{0} c) GROUP BY r),
        """
    moved = """c{1} AS MATERIALIZED (
            SELECT o.c, coalesce(m.v, o.v) AS v FROM c{0} o LEFT JOIN (
                SELECT c, list(x ORDER BY i) AS v FROM (
                    SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT a.c, generate_subscripts(k.v, 1) AS i, unnest(k.v) AS x FROM k JOIN a{0} a ON a.r = k.r) GROUP BY c, i)
                GROUP BY c) m ON m.c = o.c),
        """
    return f"""
        WITH k AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (
                SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8)),
        {"".join(nearest.format(r) + moved.format(r, r + 1) for r in range(rounds))}{nearest.format(rounds)}
        s AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a{rounds} GROUP BY c),
        h AS (SELECT c, sha256(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS h FROM c{rounds})
        SELECT k.vec_id, a.c AS cluster, a.d AS distance, s.s AS cluster_inertia, CAST((SELECT sum(s) FROM s) AS BIGINT) AS inertia, h.h AS centroid_sha256
        FROM k JOIN a{rounds} a ON a.r = k.r JOIN s ON s.c = a.c JOIN h ON h.c = a.c
    """


SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
            FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
        m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
        FROM w JOIN m ON m.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
    """,
    "op6_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_delta_lloyd": _lloyd_sql(10),
    "op12_conversation_trie": r"""
        WITH z AS MATERIALIZED (  -- CRC-32, a byte at a time
            SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
        o AS MATERIALIZED (
            SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                                      ORDER BY turn NULLS FIRST, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (
            SELECT c, s, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                              lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS INTEGER) AS h
            FROM o, z),
        r AS MATERIALIZED (
            SELECT h.c, list_concat(list_slice(coalesce(b.s, []), 1, h.h), list_slice(h.s, h.h + 1, len(h.s))) AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
        p AS MATERIALIZED (SELECT c, len(s) AS n, d, list_slice(s, 1, d) AS k FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
        m AS MATERIALIZED (
            SELECT k, d, min(c) AS c, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS e FROM p GROUP BY k, d),
        w AS MATERIALIZED (
            SELECT m.*, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) END AS own,
                   (SELECT count(*) FROM m x WHERE x.d = m.d + 1 AND list_slice(x.k, 1, m.d) = m.k) AS kids FROM m),
        u AS (SELECT list_slice(k, 1, a) AS k, sum(own) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM (SELECT w.*, unnest(range(0, d + 1)) AS a FROM w) GROUP BY 1)
        SELECT w.c AS conv_id, w.d AS depth, q.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, u.leaves AS n_leaves,
               CAST(u.saved AS BIGINT) AS saved_tokens, sha256(w.e) AS ends_sha256
        FROM w JOIN u ON u.k = w.k LEFT JOIN w q ON q.d = w.d - 1 AND q.k = list_slice(w.k, 1, w.d - 1)
    """,
    "op13_decontamination": rf"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '{_WORD}') AS w FROM documents),
        i AS MATERIALIZED (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
        k AS MATERIALIZED (
            SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda a: array_to_string(w[a:a + least(10, len(w)) - 1], ' '))) AS g
            FROM i WHERE len(w) > 0),
        n AS (SELECT DISTINCT n FROM k),
        s AS MATERIALIZED (
            SELECT r, n, unnest(range(1, len(w) - n + 2)) AS a, unnest(list_transform(range(1, len(w) - n + 2), lambda a: array_to_string(w[a:a + n - 1], ' '))) AS g
            FROM d, n WHERE len(w) >= n),
        h AS MATERIALIZED (SELECT r, s.n, a, item FROM s JOIN k ON k.n = s.n AND k.g = s.g),
        c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM (SELECT DISTINCT r, n, a FROM h)) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN t ON t.r = d.r
    """,
}

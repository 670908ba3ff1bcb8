"""One query for each operator, over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import ball_tree, bpe, decontaminate, feistel_shards, line_blocks, phrase_automata, secret_scan, simhash_dedup, term_audit, token_blocks, toxicity, url_rules, warc_archive
from threadloom.llm.common import table

SHARDS = 24


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def multilingual_bpe() -> str:
    return bpe.tokenizer_from_ranks(bpe.read_ranks(public_path("byte_bpe_multi_50k.tiktoken")))


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_pattern())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract_pages(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), multilingual_bpe(), public_pattern())


def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(table(spark, sf_dir, "documents"))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel_shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.collocations(table(spark, sf_dir, "documents"))


def op13_term_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_audit.audit_sources(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_blocks, op2_toxicity, op3_main_text, op4_decontamination, op5_byte_bpe, op6_simhash_classes, op7_warc_archive, op8_url_rules, op9_exact_top_k, op10_feistel_shards, op11_secret_scan, op12_phrase_automata, op13_term_audit, pipeline)}

ORACLE_SQL = {
    "op7_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, sha256(body) AS k FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY k) AS first_id FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          1 + CAST(((CAST('0x' || substr(h, 1 + CAST(5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM r""",
    "op9_exact_top_k": """
        WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM f q JOIN f c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_phrase_automata": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, k, list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' ')) AS phrases
              FROM w CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS BIGINT) AS k) WHERE len(ws) >= k),
        f AS (SELECT lang, phrase, k AS size, count(*) AS f FROM (SELECT lang, k, unnest(phrases) AS phrase FROM g) GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        x AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
        c AS (SELECT lang, phrase, a, ws, unnest(range(1, size)) AS k FROM x),
        s AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (l.f + r.f) AS score
              FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.ws, 1, c.k), ' ')
              JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.ws, c.k + 1, len(c.ws)), ' ')),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s) WHERE cut = 1),
        i AS (SELECT lang, size, a, ws, unnest(range(2, size)) AS m FROM x WHERE size > 2),
        o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda j: array_to_string(list_slice(ws, j, j + m - 1), ' '))) AS phrase FROM i) GROUP BY lang, phrase),
        t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
              FROM b LEFT JOIN o USING (lang, phrase) WHERE o.longer IS NULL OR 100 * o.longer < 80 * b.a)
        SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, n.n, CAST(t.score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE t.rank <= 2000""",
    "op13_term_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term FROM (SELECT DISTINCT doc, lang, term FROM w) GROUP BY lang, term HAVING count(*) >= 30),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
        n AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p
              FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
              LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        m AS (SELECT lang, CAST(sum(c) AS HUGEINT) AS n FROM c GROUP BY lang),
        q AS (SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(t.c, 0) + 5)) // (coalesce(m.n, 0) + 5 * v.v) AS q
              FROM k JOIN v ON v.lang = k.lang LEFT JOIN m ON m.lang = k.lang LEFT JOIN (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM c GROUP BY ALL) t ON t.lang = k.lang AND t.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL
              SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
}

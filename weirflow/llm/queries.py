"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe, chat, embeddings, exact, lexical, merkle, mixing, pii, secrets, simhash, toxicity, urls, warc
from weirflow.llm.tables import prepare, read


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(prepare(spark), sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(prepare(spark), sf_dir, "documents").select("doc_id", "text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(prepare(spark), sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(prepare(spark), sf_dir, "pages"), least=0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(prepare(spark), sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(read(prepare(spark), sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(read(prepare(spark), sf_dir, "embeddings"), cosine=0.98)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Target shares of tokens by language: English halved in favour of the rest.
LANGUAGE_SHARES = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), domain="lang", targets=LANGUAGE_SHARES)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(prepare(spark), sf_dir, "pages")).drop("pattern")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(read(prepare(spark), sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.events(chat.with_hostile(read(prepare(spark), sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scans, op2_bpe, op3_simhash, op4_warc, op5_pii, op6_exact_dedup, op7_embedding_dedup, op8_toxicity,
                            op9_mixing, op10_url_filters, op11_merkle, op12_lexical_search, op13_chat, pipeline)
}

STRIPPED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLES: dict[str, str] = {
    # payloads are compared by what they are; the digest's base 32 is built from its bits, five at a time
    "op4_warc": r"""
WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
best AS (SELECT payload, max(page_id) AS keep FROM own GROUP BY payload),
joined AS (SELECT page_id, octet_length(payload) AS payload_bytes, unhex(sha1(payload))::BIT::VARCHAR AS bits, keep FROM own JOIN best USING (payload))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, (5 * i + j + 1)::INT, 1)::INT * (16 >> j::INT)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM joined""",
    "op6_exact_dedup": f"""
WITH own AS (SELECT doc_id, {STRIPPED} AS content, length(coalesce(text, '')) AS points FROM documents),
grouped AS (SELECT content, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM own GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM own JOIN grouped USING (content)""",
    "op7_embedding_dedup": """
WITH RECURSIVE own AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM own a JOIN own b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
roots AS (SELECT u, min(v) AS root FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(root, e.vec_id)) AS component_id, least(e.vec_id, coalesce(root, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN roots r ON r.u = e.vec_id""",
    "op10_url_filters": urls.oracle(),
    # a CRC-32 bit by bit, the levels as recursions: first up the tree of each source, then up that of the sources, then along each leaf's way
    "op11_merkle": """
WITH RECURSIVE bits AS (
    SELECT doc_id, source, lang, n_chars, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(0, length(doc_id::VARCHAR)),
           lambda i: [ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1))::UBIGINT] || list_transform(range(0, 8), lambda k: 256::UBIGINT)))),
           lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END), 4294967295::UBIGINT) AS crc
    FROM documents),
own AS (
    SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM bits),
hashed AS (
    SELECT doc_id, source, sha256(start || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
           sha256(start || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS other
    FROM (SELECT *, coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                 || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS start FROM own)),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed),
tree(level, source, pos, digest, n) AS (
    SELECT 0, source, pos, leaf, n FROM leaves
    UNION ALL
    SELECT level + 1, source, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16 FROM tree WHERE n > 1 GROUP BY level, source, pos // 16),
subroots AS (
    SELECT source, digest AS subroot, level AS high, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(level, pos, digest, n) AS (
    SELECT 0, place, subroot, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16 FROM crown WHERE n > 1 GROUP BY level, pos // 16),
runs AS (
    SELECT source, level, pos // 16 AS run, list(digest ORDER BY pos) AS nodes FROM tree WHERE n > 1 GROUP BY source, level, pos // 16
    UNION ALL
    SELECT s.source, s.high + c.level, c.pos // 16, list(c.digest ORDER BY c.pos) FROM crown c, subroots s WHERE c.n > 1 GROUP BY s.source, s.high, c.level, c.pos // 16),
way(doc_id, leaf, subroot, source, level, pos, node, seen, done) AS (
    SELECT doc_id, leaf, subroot, l.source, 0, CASE WHEN high = 0 THEN place ELSE pos END, other, '', false FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
    UNION ALL
    SELECT doc_id, leaf, w.subroot, w.source, w.level + 1, CASE WHEN w.level + 1 = high THEN place ELSE pos // 16 END,
           CASE WHEN nodes IS NULL THEN node ELSE sha256(array_to_string(list_transform(nodes, lambda x, i: CASE WHEN i = pos % 16 + 1 THEN node ELSE x END), '')) END,
           CASE WHEN nodes IS NULL THEN seen ELSE seen || array_to_string(list_transform(nodes, lambda x, i: CASE WHEN i = pos % 16 + 1 THEN '' ELSE x END), '') END,
           nodes IS NULL
    FROM way w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source
    LEFT JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.level = w.level AND r.run = pos // 16
    WHERE NOT done)
SELECT doc_id, leaf, subroot, (SELECT digest FROM crown WHERE n = 1) AS root, sha256(seen) AS proof_sha256, node AS folded_root,
       node = (SELECT digest FROM crown WHERE n = 1) AS verified
FROM way WHERE done""",
    "op12_lexical_search": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS own
    FROM documents WHERE text IS NOT NULL),
sums AS (SELECT count(*) AS n_docs, sum(len(own))::BIGINT AS n_terms FROM words WHERE len(own) > 0),
counts AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(own) AS term, len(own) AS n FROM words) GROUP BY doc_id, term),
rarity AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
           FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), sums),
asked AS (SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM asked JOIN counts USING (term) JOIN rarity USING (term), sums GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20""",
    "op13_chat": r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (SELECT *, len(regexp_extract_all(text, '<\\*(?:/?s>|</?SYS>>|/?role)|\[\\*/?INST\]')) AS escaped FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + escaped + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 8 WHEN 'system' THEN 18 ELSE 15 + length(role) END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
}

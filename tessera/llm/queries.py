"""The operators' queries over the documents and pages tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fingerprints, html_text, media, merkle, mixing, ngram_join, quality, sentencepiece_lattice, substring_dedup, token_store, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix to weights 5, 2, 1 takes of each. Nulls, ties and empty tables as in fair_queue."""
    queue = mixing.fair_queue(_table(spark, sf_dir, "documents"))
    return queue.select("doc_id", "source", "size", "source_size", "target", "taken", "virtual_finish")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 5-grams and its component of links of similarity 0.75. Nulls and repeats as in ngram_groups."""
    return ngram_join.ngram_groups(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a field that learns from labels outside of the held-out quarter; an id that is null is held out in no sense (null). Nulls as in score."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", "expected", "spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that a document shares with an earlier holder. Nulls and repeats as in shared_passages."""
    return substring_dedup.shared_passages(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text. Nulls and repeats as in edited_fingerprints."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as WAV, read back, with the landmarks of all of it. Nulls as in media_column."""
    return media.media_column(_table(spark, sf_dir, "documents"), keep_media=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive: its digest, and what it revisits. Nulls and repeats as in write_archives."""
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select(
        "page_id",
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text and the digest of what they decode to. Nulls as in encode."""
    model = _tokenizer("piece_bpe_32k.model")
    encoded = sentencepiece_lattice.encode(_table(spark, sf_dir, "documents"), model)
    return sentencepiece_lattice.decode(encoded, model).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its evidence, its host's and path's rates and its score. Nulls as in posterior."""
    docs = _table(spark, sf_dir, "documents")
    return quality.posterior(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the store, how many, and their checksum, from the stored files. Nulls as in write_shards."""
    return token_store.token_store(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), keep_ids=False)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest, and whether its text without line feeds, where its id's checksum is even, still leads to the root. Nulls and ties as in authenticated; a null id is not tampered with."""
    docs = _table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    audit = merkle.tamper_audit(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))
    return audit.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark a source. Nulls and empty tables as in source_divergence."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Nulls and empty tables as in main_text."""
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of corpus_pipeline.run. An empty table gives an empty one."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_ngram_join, op3_toxicity, op4_substring_dedup, op5_fingerprints, op6_media, op7_warc, op8_sentencepiece, op9_quality, op10_token_store, op11_merkle, op12_divergence, op13_html_text, pipeline)
    return {f.__name__: f for f in own}


_OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS shuffled
  FROM documents),
sources AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighed AS (
  SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY skey) - 1) % 3]::BIGINT AS weight, 3 * source_size AS ceiling FROM sources),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY ceiling::DOUBLE / weight, skey) AS k, sum(source_size) OVER () AS everything, sum(weight) OVER () AS all_weight FROM weighed),
ahead AS (
  SELECT *, everything - coalesce(sum(ceiling) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         all_weight - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS among FROM ordered),
judged AS (SELECT *, remaining * weight >= ceiling * among AS is_full FROM ahead),
shares AS (
  SELECT skey, source_size, weight,
         CASE WHEN is_full THEN ceiling::DOUBLE
              ELSE ((everything - coalesce(sum(ceiling) FILTER (is_full) OVER (), 0)) * weight)::DOUBLE / (sum(weight) FILTER (NOT is_full) OVER ())::DOUBLE END AS target
  FROM judged),
queued AS (
  SELECT s.skey, s.doc_id, s.source, s.size, h.source_size, h.weight, h.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.shuffled, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead_words
  FROM sized s JOIN shares h USING (skey)),
copies AS (
  SELECT q.*, e AS epoch, ahead_words + source_size * e AS begins, greatest(0, least(size, floor(target)::BIGINT - ahead_words - source_size * e)) AS head
  FROM queued q, range(3) t(e) WHERE size > 0),
packets AS (
  SELECT skey, ahead_words, epoch, 0 AS piece, head AS words, (begins + head)::DOUBLE / target AS finish FROM copies WHERE head > 0
  UNION ALL SELECT skey, ahead_words, epoch, 1, size - head, (begins + size)::DOUBLE / target FROM copies WHERE size > head),
served AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, skey, epoch, ahead_words, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM packets),
given AS (
  SELECT skey, ahead_words, sum(greatest(0, least(words, (SELECT sum(size) FROM sized) - earlier)))::BIGINT AS taken FROM served GROUP BY ALL)
SELECT doc_id, source, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS taken, (ahead_words + size)::DOUBLE / nullif(target, 0) AS virtual_finish
FROM queued LEFT JOIN given USING (skey, ahead_words)
"""

_OP2 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT DISTINCT a, a FROM sides UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of l USING (doc_id)
"""

_OP7 = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
parts AS (SELECT *, list_transform(range(4), lambda k: ('0x' || substr(hex, 1 + 10 * k, 10))::BIGINT) AS five FROM payloads),
digests AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(32), lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((five[1 + d // 8] >> (35 - 5 * (d % 8))) & 31)::INT, 1)), '') AS payload_digest
  FROM parts),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""


_OP11 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN list_reduce(flatten([[4294967295::BIGINT]] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                lambda crc, e: CASE WHEN e >= 0 THEN xor(crc, e) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END) & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS shown
  FROM documents),
leaves AS (
  SELECT doc_id, source, row_number() OVER () AS rid,
         sha256(list_reduce(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), lambda a, b: a || b)) AS leaf,
         sha256(list_reduce(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, shown], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), lambda a, b: a || b)) AS shown_leaf
  FROM texts),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes(source, level, idx, digest) AS (
  SELECT source, 0, pos, leaf FROM placed
  UNION ALL
  SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM nodes) WHERE c > 1 GROUP BY source, level, idx // 3),
subroots AS (SELECT source, arg_max(digest, level) AS subroot, max(level) AS height FROM nodes GROUP BY source),
tops AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot FROM subroots),
upper_nodes(level, idx, digest) AS (
  SELECT 0, spot, subroot FROM tops
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper_nodes GROUP BY level, idx // 3 HAVING (SELECT count(*) FROM upper_nodes) > 1),
runs AS (
  SELECT source, level, idx // 3 AS run, list(digest ORDER BY idx) AS members FROM (SELECT *, max(level) OVER (PARTITION BY source) AS height FROM nodes) WHERE level < height GROUP BY ALL),
upper_runs AS (SELECT level, idx // 3 AS run, list(digest ORDER BY idx) AS members FROM upper_nodes WHERE level < (SELECT max(level) FROM upper_nodes) GROUP BY ALL),
steps AS (
  SELECT rid, level + 1 AS k, members, (pos // (3 ** level)::BIGINT) % 3 AS place FROM placed p JOIN runs r ON r.source IS NOT DISTINCT FROM p.source AND r.run = p.pos // (3 ** (level + 1))::BIGINT
  UNION ALL
  SELECT rid, t.height + level + 1, members, (t.spot // (3 ** level)::BIGINT) % 3 FROM placed p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source JOIN upper_runs r ON r.run = t.spot // (3 ** (level + 1))::BIGINT),
around AS (SELECT rid, k, array_to_string(members[1:place::BIGINT], '') AS before, array_to_string(members[place::BIGINT + 2:], '') AS after FROM steps),
fold(rid, k, digest) AS (
  SELECT rid, 0, shown_leaf FROM placed
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(a.before || f.digest || a.after) FROM fold f JOIN around a ON a.rid = f.rid AND a.k = f.k + 1),
ends AS (SELECT rid, arg_max(digest, k) AS folded_root FROM fold GROUP BY rid),
proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY k) AS proof FROM around GROUP BY rid)
SELECT p.doc_id, p.leaf, t.subroot, u.digest AS root, sha256(coalesce(f.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = u.digest AS verified
FROM placed p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source JOIN ends e USING (rid) LEFT JOIN proofs f USING (rid)
CROSS JOIN (SELECT arg_max(digest, level) AS digest FROM upper_nodes) u
"""


_OP12 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
terms AS (SELECT rid, lang, source, unnest(words) AS term FROM texts),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
found AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM full_counts JOIN sizes USING (lang)),
lang_counts AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM full_counts GROUP BY ALL),
lang_shares AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM lang_counts JOIN sizes USING (lang)),
distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
more AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _OP1, "op2_ngram_join": _OP2, "op7_warc": _OP7, "op11_merkle": _OP11, "op12_divergence": _OP12}

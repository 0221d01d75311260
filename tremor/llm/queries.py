"""One query for each operator: (spark, sf_dir) to its rows over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filter_audit, hilbert, idstore, langid, neardup, packing, pii, spotsigs, toxicity, transcripts, variants, wordpiece
from .common import id_remainder, new_folder, table

#: The public vocabulary of the token operators.
VOCABULARY = "word_bpe_49k.json"


def op1_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; three quarters of the labelled ones teach the profiles."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False))
    profiles = langid.learn(docs.filter(~held_out), reject=False)
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_distance")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs of every document and of its edited text, and their likeness."""
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op3_hmm_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of every conversation's turns from transcripts without some of the markers; three quarters of the conversations teach the model."""
    turns = table(spark, sf_dir, "conversations")
    model = transcripts.learn(turns.filter(F.coalesce(id_remainder(4, "conv_id") != 2, F.lit(False))))
    return transcripts.parse(turns, model)


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents by five-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight runs of the Hilbert curve over language, source and size."""
    placed = hilbert.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 2048, 0)


def op7_linear_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_zstd_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids written to a store with a shared dictionary and read back."""
    folder = new_folder(spark, "ids")
    idstore.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY), 2)
    return idstore.read_store(spark, folder, ids=False)


def op9_seed_align_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of benchmark items in documents."""
    docs = table(spark, sf_dir, "documents")
    return decontam.copies(docs, decontam.benchmark_items(table(spark, sf_dir, "benchmark")))


def op10_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; four fifths of the labelled ones teach the field."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), F.coalesce(id_remainder(5) == 0, F.lit(False))
    field = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, field).select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


def op11_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document. Counts and ``base_sha256`` are of the patterns' spans; ``spans`` and ``n_added`` have the field's too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.learn(docs)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in every order, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_errata_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_rank_order_langid,
    op2_spotsigs,
    op3_hmm_transcripts,
    op4_minhash_neardup,
    op5_hilbert_shards,
    op6_best_fit_packing,
    op7_linear_longest_match,
    op8_zstd_id_store,
    op9_seed_align_decontam,
    op10_crf_toxicity,
    op11_skip_chain_pii,
    op12_filter_audit,
    op13_errata_variants,
)

#: Exact Jaccard of five-word shingles by an inverted index, then reachability.
NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w
), x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b AS id, r.c FROM r JOIN e ON r.id = e.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, len(s.g) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN m ON s.doc_id = m.id
"""


def _crc_table() -> list[int]:
    """The table of CRC-32 for each byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def _cell_sql(column: str) -> str:
    return f"coalesce(CAST('0x' || substr(md5({column}), 1, 8) AS BIGINT) % 32, 0)"


#: The curve, the order and the runs of equal counts; checksums byte by byte.
SHARDS_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, lang, source, strlen(text) + 1 AS size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, lang, source, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32, length(bin(least(size, 65536))) - 1 AS k FROM b),
cells AS (SELECT doc_id, size, text_crc32, {_cell_sql('lang')} AS c0, {_cell_sql('source')} AS c1, least(31, 2 * k + CASE WHEN least(size, 65536) * least(size, 65536) >= pow(2e0, 2 * k + 1) THEN 1 ELSE 0 END) AS c2 FROM c),
{hilbert.curve_sql(["c0", "c1", "c2"])},
o AS (SELECT *, row_number() OVER (ORDER BY curve, size, text_crc32, doc_id) - 1 AS i, count(*) OVER () AS n FROM curve),
s AS (SELECT *, i * 8 // n AS s FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(s AS INTEGER) AS shard, CAST(i - (s * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM s
"""

#: Every order and step from the masks of failed filters; a row of the masks for each document.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT o, step, 1 << (instr('ABCDE', o[step]) - 1) AS own, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i < step THEN 1 << (instr('ABCDE', o[i]) - 1) ELSE 0 END))::INTEGER AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step)
)
SELECT part, o AS filter_order, step::INTEGER AS step,
  sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  (sum(sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM c, s GROUP BY part, o, step, own
"""

#: Damaged runs with checksums byte by byte, pairs by deleted characters, forms, and roots by recursion.
VARIANTS_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
p AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY doc_id, w HAVING length(w) >= 6),
b AS (SELECT w, n, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || w)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM p),
h AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b),
v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), k AS (SELECT word, n, i, word[:i] || word[i + 2:] AS less, word[:i] || '*' || word[i + 2:] AS any_ FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (
  SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM k a JOIN k b ON a.any_ = b.any_ AND a.word <> b.word
  UNION SELECT k.word, k.n, v.word, v.n FROM k JOIN v ON k.less = v.word
  UNION SELECT v.word, v.n, k.word, k.n FROM k JOIN v ON k.less = v.word
), f AS (SELECT a AS word, count(*) AS n_near, (list(b ORDER BY b_n DESC, b))[1] AS best, max(b_n) AS best_n FROM e GROUP BY a),
t AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM v LEFT JOIN f USING (word)),
c AS (SELECT word, word AS root, form AS next FROM t UNION ALL SELECT c.word, t.word, t.form FROM c JOIN t ON c.next = t.word)
SELECT t.word, t.form, c.root, t.n, t.n_near, t.form_n FROM t JOIN c ON t.word = c.word AND c.next IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_neardup": NEARDUP_SQL, "op5_hilbert_shards": SHARDS_SQL, "op12_filter_audit": AUDIT_SQL, "op13_errata_variants": VARIANTS_SQL}

"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotcheck.llm import fingerprints, html_extract, langid, jaccard_join, mixing, packing, periodic_runs, quality, simhash_dedup, spelling, suffix_dedup, token_output, topk
from plotcheck.llm.common import table
from plotcheck.storage import materialize


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th vector over all others."""
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its text."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word SimHash fingerprints within 4 bits."""
    out = simhash_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 200-byte strings that occur elsewhere too."""
    return suffix_dedup.removal_digest(table(spark, sf_dir, "documents"), length=200)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids in sequences of at most 1024."""
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "space", 1024, 2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by its text."""
    return langid.predicted_languages(table(spark, sf_dir, "documents"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, against their edited texts and their neighbours."""
    return fingerprints.edit_robustness(table(spark, sf_dir, "documents"))


def fingerprint_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near fingerprints of every 50th document among those of all, found in the block tables of op9's method."""
    found = materialize(fingerprints.fingerprints(table(spark, sf_dir, "documents")), "searched")
    return fingerprints.neighbours(found, found.filter(F.col("doc_id") % 50 == 0), radius=12)


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as word BPE ids, written in bit planes and read back."""
    return token_output.written_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", 1)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of 0.8 of their five-word shingles."""
    return jaccard_join.similar_sets(table(spark, sf_dir, "documents"), shingle=5, percent=80)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters and more, with what they are a misspelling of."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), least=7, repeats=2, ratio=10)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_token_id_output": op10_token_id_output,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
    "fingerprint_neighbours": fingerprint_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
WITH e AS (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.nth AS asked, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.nth <> q.nth
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
""",
    "op11_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT nth, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS grams FROM w
), r AS (
  SELECT min(nth) AS rep, min(doc_id) AS low, len(grams) AS n, unnest(grams) AS gram FROM (SELECT min(nth) OVER (PARTITION BY list_sort(grams)) AS nth, doc_id, grams FROM g WHERE doc_id IS NOT NULL AND len(grams) > 0) GROUP BY nth, grams
), k AS MATERIALIZED (SELECT DISTINCT rep, n, gram FROM r),
p AS (SELECT a.rep AS a, b.rep AS b FROM k a JOIN k b ON a.gram = b.gram AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t AS (SELECT DISTINCT rep AS node, rep AS root FROM k UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node),
c AS (SELECT node, min(root) AS root FROM t GROUP BY node),
m AS (SELECT nth, doc_id, len(grams) AS n, min(CASE WHEN doc_id IS NOT NULL AND len(grams) > 0 THEN nth END) OVER (PARTITION BY list_sort(grams)) AS rep FROM g)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, CASE WHEN m.n = 0 OR m.doc_id IS NULL THEN m.doc_id ELSE min(CASE WHEN m.n > 0 THEN m.doc_id END) OVER (PARTITION BY CASE WHEN m.n = 0 OR m.doc_id IS NULL THEN -m.nth ELSE c.root END) END AS component_id FROM m LEFT JOIN c ON c.node = m.rep
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE b AS (SELECT CAST(i AS BIGINT) AS i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS x FROM range(256) r(i)),
tab AS (SELECT list(x ORDER BY i) AS t FROM b),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(concat(id, ':', run))) + 1), lambda i: CAST(concat('0x', hex(encode(concat(id, ':', run)))[2 * i - 1:2 * i]) AS BIGINT))),
  lambda c, d: xor(c // 256, t[1 + xor(c, d) % 256])), 4294967295) AS h FROM l, tab WHERE length(run) >= 7),
o AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, CAST(h % length(run) AS INTEGER)), substr(run, CAST(h % length(run) AS INTEGER) + 2)) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, concat(left(word, CAST(i AS INTEGER) - 1), substr(word, CAST(i AS INTEGER) + 1)) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a.word AS a, b.word AS b, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less)),
f AS (SELECT a, b, m, count(*) OVER (PARTITION BY a) AS k, row_number() OVER (PARTITION BY a ORDER BY m DESC, b) AS nth FROM p),
g AS MATERIALIZED (SELECT v.word, v.n, coalesce(k, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN b END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN f ON f.a = v.word AND nth = 1),
w AS (SELECT word, word AS at, 0 AS step FROM g UNION ALL SELECT w.word, g.form, step + 1 FROM w JOIN g ON g.word = w.at WHERE g.form IS NOT NULL)
SELECT g.word, n, n_near, form, form_n, arg_max(w.at, step) AS root FROM g JOIN w ON w.word = g.word GROUP BY g.word, n, n_near, form, form_n
""",
}

"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontam import contamination_digest
from .fill_middle import fill_digest
from .mixing import mix_digest
from .ngram_lm import lm_digest
from .projection_dedup import linked_vectors
from .quality import quality_digest
from .ranked_search import search_digest
from .secret_scan import BASE_RULES, MORE_RULES, secrets_digest
from .sharding import shard_documents
from .simhash import simhash_digest
from .storage import table
from .token_output import token_digest
from .topk import top_k_digest
from .url_filter import url_digest


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_digest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_digest(table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_digest(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_top_k": op5_top_k,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_token_output": op10_token_output,
    "op11_ranked_search": op11_ranked_search,
    "op12_projection_dedup": op12_projection_dedup,
    "op13_fill_middle": op13_fill_middle,
}

WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, k, k + least(10, len(w)) - 1) AS win
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, doc_windows.n AS n, item FROM doc_windows JOIN item_windows USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op5_top_k": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
    "op11_ranked_search": f"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
tf AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, c GROUP BY term, n_docs),
s AS (
    SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY item_id, doc_id HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 50
""",
    "op12_projection_dedup": """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
    SELECT r, e, sqrt(list_inner_product(e, e)) AS size FROM v
    WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN n USING (r)
""",
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
h AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
""",
}


def _matches_sql(rule, at: int) -> str:
    """Rows (r, kind, place, start, stop) of a rule's long enough matches, in DuckDB SQL: running sums of gaps and matches are the offsets."""
    pattern = rule.pattern.replace("'", "''")
    found = f"SELECT r, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS s FROM d"
    each = f"SELECT r, unnest(range(len(w))) AS i, unnest(w) AS whole, unnest(g) AS own, unnest(s[1:len(w)]) AS gap FROM ({found}) WHERE len(w) > 0"
    ends = f"SELECT r, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop, length(whole) AS n, length(own) AS own FROM ({each})"
    return f"SELECT r, '{rule.kind}' AS kind, {at} AS place, stop - n AS start, stop FROM ({ends}) WHERE own >= {rule.least}"


_BASE, _RULES = [r.kind for r in BASE_RULES], BASE_RULES + MORE_RULES
_LISTED = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place){0}, '')"
ORACLE_SQL["op6_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches_sql(r, i) for i, r in enumerate(_RULES))})
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)},
    sha256({_LISTED.format(f" FILTER (place < {len(_BASE)})")}) AS base_sha256, {_LISTED.format("")} AS spans
FROM d LEFT JOIN m USING (r) GROUP BY r, doc_id
"""

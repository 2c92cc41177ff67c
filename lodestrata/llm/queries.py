"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import ann, common, decontaminate, jaccard_join, language_id, line_templates, mixing, token_counts, toxicity, url_filter, warc

OVER_LIMIT_TOKENS = 512
TOXIC_AT = 0.3
MIX_TARGETS = {"good": 0.92, "poor": 0.06, "toxic": 0.02}
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    # A cache of its own: the query shows the whole work, not what an earlier call left.
    out = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), common.fresh_path(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT_TOKENS).alias("over_limit"))


def op2_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is never learnt from: it counts as held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(common.crc32_mod(F.col("doc_id"), 4) == 2, F.lit(True))
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out & F.col("toxic").isNotNull())
    # The class prior, as published labels state it; single negatives are never trained on.
    toxic, every = labels.agg(F.sum(F.col("toxic").cast("long")), F.count("*")).first()
    model = toxicity.fit(docs.filter(~held_out), labels.filter("toxic = 1"), (toxic or 0) / max(every, 1))
    scored = toxicity.score(docs, model, columns=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op3_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is never learnt from: it counts as held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(common.crc32_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    model = language_id.fit(docs.filter(~held_out))
    predicted = language_id.predict(docs, model, columns=["doc_id"])
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of the mixing operator: what the quality and toxicity labels together name."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return common.table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, domain_labels(spark, sf_dir), MIX_TARGETS).drop("copy")


def op7_score_aware_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op8_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.fresh_path(spark, "warc")
    warc.write_archives(warc.label_copies(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")), root)
    return warc.read_archives(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs, k=4, percent=85)


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_pu_toxicity": op2_pu_toxicity,
    "op3_bigru_language": op3_bigru_language,
    "op4_minhash_containment": op4_minhash_containment,
    "op5_line_templates": op5_line_templates,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_score_aware_ann": op7_score_aware_ann,
    "op8_warc_dictionary": op8_warc_dictionary,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_cascade": op10_url_cascade,
}

OP10_SQL = r"""
WITH rules(action, rule_host, rule_path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages),
fits AS (
    SELECT page_id, rule_host || rule_path AS rule, action,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.place = 1
"""

OP4_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-`{-\x7F]+'), lambda w: w <> '') AS w FROM documents),
asked AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-`{-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
d AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words),
q AS (
    SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS s
    FROM asked),
sizes AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
pairs AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN q USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared::DOUBLE / n_item AS containment, shared, n_item
FROM pairs JOIN sizes USING (item_id) WHERE 100 * shared >= 80 * n_item
"""

OP5_SQL = r"""
WITH lines AS (SELECT doc_id, text AS copy, unnest(string_split(text, chr(10))) AS raw FROM documents),
masked AS (SELECT doc_id, copy, regexp_replace(raw, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM lines WHERE raw <> ''),
keyed AS (SELECT *, len(string_split(m, ' ')) AS n, array_to_string(string_split(m, ' ')[1:3], ' ') AS lead FROM masked),
copies AS (SELECT m, n, lead, copy, min(doc_id) AS first_doc FROM keyed GROUP BY ALL),
support AS (SELECT m, n, lead, count(*) AS support, min(first_doc) AS first_doc FROM copies GROUP BY ALL),
leaves AS (SELECT n, lead FROM support GROUP BY ALL HAVING sum(support) >= 5),
hot AS (SELECT s.* FROM support s JOIN leaves USING (n, lead)),
tokens AS (SELECT m, n, lead, support, first_doc, unnest(string_split(m, ' ')) AS token, unnest(range(n)) AS place FROM hot),
fields AS (SELECT n, lead, place, token, true AS constant FROM tokens GROUP BY n, lead, place, token HAVING sum(support) >= 5),
flags AS (SELECT t.*, (f.constant IS NOT NULL OR t.place < 3) AS fixed FROM tokens t LEFT JOIN fields f USING (n, lead, place, token)),
shapes AS (
    SELECT m, n, lead, support, first_doc, list(CASE WHEN fixed THEN token ELSE '<*>' END ORDER BY place) AS template
    FROM flags GROUP BY m, n, lead, support, first_doc
    HAVING count(*) FILTER (fixed) * 100 >= n * 80 AND bool_or(fixed AND token NOT IN ('<*>', ''))),
recurring AS (SELECT n, lead, template, min(first_doc) AS keeper FROM shapes GROUP BY ALL HAVING sum(support) >= 5),
drops AS (SELECT m, keeper FROM shapes JOIN recurring USING (n, lead, template)),
lists AS (SELECT k.doc_id, list(DISTINCT k.m) AS ms FROM keyed k JOIN drops d ON k.m = d.m WHERE k.doc_id <> d.keeper GROUP BY k.doc_id),
kept AS (
    SELECT d.doc_id, d.text AS whole, ms, string_split(d.text, chr(10)) AS all_lines,
        list_filter(string_split(d.text, chr(10)), lambda x: x = '' OR NOT list_contains(ms, regexp_replace(x, '[^ ]*[0-9][^ ]*', '<*>', 'g'))) AS kept_lines
    FROM documents d LEFT JOIN lists l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN ms IS NULL THEN whole ELSE array_to_string(kept_lines, chr(10)) END AS text,
    coalesce(len(all_lines), 0)::BIGINT AS n_lines, CASE WHEN ms IS NULL THEN 0 ELSE len(all_lines) - len(kept_lines) END::BIGINT AS n_dropped
FROM kept
"""

_NIBBLES = " ".join(f"WHEN '{n:x}' THEN '{n:04b}'" for n in range(16))

OP8_SQL = rf"""
WITH h AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, payload, max(page_id) OVER (PARTITION BY payload) AS winner,
    array_to_string(list_transform(range(1, 41), lambda i: CASE hex[i] {_NIBBLES} END), '') AS bits FROM h)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: CASE bits[5 * i + j] WHEN '1' THEN 1 << (5 - j) ELSE 0 END))::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM b
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
least_id AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, n::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sized LEFT JOIN least_id ON u = doc_id
"""

ORACLES: dict[str, str] = {"op4_minhash_containment": OP4_SQL, "op5_line_templates": OP5_SQL, "op8_warc_dictionary": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op10_url_cascade": OP10_SQL}

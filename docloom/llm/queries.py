"""The operators over their whole tables, as registered queries, and DuckDB SQL where SQL can say the same.

Paths of tokenizer files are parameters; the defaults come from the installed `public_tokenizers`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.ngram_join import ngram_components

    return ngram_components(documents(spark, sf_dir), 3, 9, 10)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.token_files import token_files

    return token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), "byte_level", 2)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.quality import judge

    return judge(documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.warc import archive

    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.mixing import plan_mix

    return plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.langid import identify

    return identify(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), "words", 1, 4096)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), 400).drop("t", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(documents(spark, sf_dir))
    texts = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"))}
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(t, 256).alias(name) for name, t in texts.items()])


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.near_vectors import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    first = (op1_ngram_jaccard, op2_token_files, op3_exact_top_k, op4_quality_rules, op5_warc, op6_mix_sources, op7_language_id, op8_best_fit_packing, op9_suffix_dedup, op10_toxicity)
    return {f.__name__: f for f in (*first, op11_whitening, op12_fill_in_middle, op13_near_vectors)}


def _quality_sql() -> str:
    from docloom.llm.quality import BASE, MEASURES, POLICIES, RULES

    failed = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
    word = r"[^\x20\x09-\x0D]"
    return rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY doc_id),
dup AS (SELECT doc_id, list_filter(ls, lambda x, i: list_position(ls, x) < i) AS ds FROM w),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(len(ds) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(ws, lambda x: regexp_full_match(x, '[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*'))) AS BIGINT) AS n_capital_words,
 CAST(len(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]')) AS BIGINT) AS n_letters, CAST(coalesce(list_sum(list_transform(ds, lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')))), 0) AS BIGINT) AS dup_line_chars
 FROM w JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM m)
SELECT doc_id, failed, {", ".join(MEASURES)}, failed & {BASE} <> 0 AS base_failed, failed & {BASE | POLICIES["web-2"]} = 0 AS kept FROM f"""


_warc_sql = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - k % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM q"""

_mix_sql = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS number FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT level FROM l WHERE cap > w * level ORDER BY cap / w, encode(source) NULLS LAST LIMIT 1), 1e300))::DOUBLE AS target FROM l),
u AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target, u.source, rate, CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || number), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, rate, copies FROM c"""


_fill_sql = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, CAST(len(t) AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS INT), 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

_near_sql = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.x = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON x = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": _quality_sql(), "op5_warc": _warc_sql, "op6_mix_sources": _mix_sql, "op12_fill_in_middle": _fill_sql, "op13_near_vectors": _near_sql}

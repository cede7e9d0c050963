"""The registered queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldengine.llm import ballhash, chat, decontaminate, lexical, neighbours, packing, pagetext, pieces, quality, setjoin, spelling, toxicity, urls


def model_file(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary file, which every node has: in TOKENIZER_DIR if set, else where it is installed."""
    folder = os.environ.get("TOKENIZER_DIR")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's digests, read back from its formatted parts and loss masks."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(turns.unionByName(more), model_file("byte_bpe_50k.json"))
    return chat.digest_conversations(parts)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity and grade."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_severity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_severity(docs, model, ["doc_id"])


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; a page's outcome is the label of the document of the same number."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.judge_urls(_table(spark, sf_dir, "pages"), outcomes).drop("lower")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component of near copies."""
    return setjoin.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a copy of a benchmark item, with the score and place of the best alignment."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being good."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, ["doc_id"])


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, with the tokens of its blocks in runs that other pages of its host have too."""
    return pagetext.extract_text(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in packed rows."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), model_file("byte_bpe_50k.tiktoken"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    encoded = pieces.encode_pieces(_table(spark, sf_dir, "documents"), model_file())
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and its component of fingerprints within 4 bits."""
    found = ballhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the texts with its near words' number, its form and its root."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_chat_format, op2_toxicity, op3_neighbours, op4_url_filter, op5_jaccard_join, op6_decontamination, op7_quality, op8_page_text, op9_packing, op10_pieces,
        op11_simhash, op12_spelling, op13_lexical_search,
    )
    return {f.__name__: f for f in found}


def llm_oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": URL_FILTER_SQL, "op13_lexical_search": LEXICAL_SEARCH_SQL}


def _level_sql(level: str, prior: str) -> str:
    """Strength of a level's prior by moments, as in `urls`."""
    return f"""(SELECT least(greatest(CASE WHEN r IS NULL OR r <= 0 THEN 1000.0 ELSE (1 - r) / r END, 1.0), 1000.0) AS s FROM (
        SELECT sum((bad - n * {prior}) * (bad - n * {prior}) - n * {prior} * (1 - {prior}))
            / nullif(sum(n * (n - 1) * {prior} * (1 - {prior})), 0) AS r FROM {level} WHERE n > 0))"""


URL_FILTER_SQL = f"""
WITH given AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (
    SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad,
        regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix
    FROM given LEFT JOIN known USING (page_id) GROUP BY host),
total AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS overall FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(overall) AS prior FROM hosts, total GROUP BY suffix),
suffix_means AS (SELECT suffix, (bad + s * prior) / (n + s) AS suffix_mean FROM suffixes, {_level_sql("suffixes", "prior")}),
domains AS (
    SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(suffix_mean) AS suffix_mean
    FROM hosts JOIN suffix_means USING (suffix) GROUP BY domain, suffix),
domain_means AS (
    SELECT domain, (bad + s * suffix_mean) / (n + s) AS domain_mean FROM domains, {_level_sql("domains", "suffix_mean")}),
placed AS (SELECT * FROM hosts JOIN domain_means USING (domain)),
judged AS (
    SELECT host, (bad + s * domain_mean) / (n + s) AS m, n + s + 1 AS size FROM placed, {_level_sql("placed", "domain_mean")}),
fitted AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM given)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN m - 1.2816 * sqrt(m * (1 - m) / size) > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM fitted JOIN judged USING (host)
"""

_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL_SEARCH_SQL = f"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
texts AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM given WHERE len(terms) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM texts),
asked AS (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
postings AS (
    SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts)
    WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, corpus GROUP BY term),
scored AS (
    SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN texts USING (r), corpus GROUP BY ALL)
SELECT * FROM (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored JOIN texts USING (r) WHERE score > 0)
WHERE rank <= 10
"""

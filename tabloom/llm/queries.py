"""The registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer

from tabloom.llm.alignment import align
from tabloom.llm.bpe import decode, encode
from tabloom.llm.chunks import dedup_substrings
from tabloom.llm.common import cut, table
from tabloom.llm.decontaminate import hit_words, matches
from tabloom.llm.minhash import near_duplicates
from tabloom.llm.mixing import mix_sources, word_count
from tabloom.llm.phrases import mine_phrases
from tabloom.llm.quality import grade_quality
from tabloom.llm.quantise import search
from tabloom.llm.quotes import link_quotes
from tabloom.llm.repeats import remove_repeats
from tabloom.llm.toxicity import toxicity
from tabloom.llm.url_filter import url_filter

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sizes are taken from the texts once, and kept.
    sizes = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("spread")))
    mixed = mix_sources(sizes, sized=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    n_hit = hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        "longest", "longest_at", "longest_item",
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).withColumnRenamed("kept", "text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of low quality, 1 readable but toxic, 2 readable and clean."""
    ratings = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality + quality * (1 - toxic) AS grade")
    return grade_quality(table(spark, sf_dir, "documents"), ratings, least=1)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"), k=10)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer("byte_bpe_multi_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, PATTERN).drop("text")
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return decode(encoded, ranks).select("doc_id", "n_tokens", *digests)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), digest=True)
    return made.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quotes": op8_quotes,
    "op9_minhash": op9_minhash,
    "op10_neighbours": op10_neighbours,
    "op11_bpe": op11_bpe,
    "op12_phrases": op12_phrases,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        rules(verdict, rhost, rpath) AS (VALUES
            ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
            ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        hits AS (
            SELECT p.*, r.verdict, r.rhost || r.rpath AS rule,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS k
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1""",
    "op2_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tie,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, 3.0::DOUBLE * source_size AS cap,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                       WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM s),
        l AS (
            SELECT *, coalesce(sum(cap) OVER b, 0::DOUBLE) AS capped,
                   (sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0::DOUBLE) AS weights,
                   sum(source_size) OVER () AS total
            FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        m AS (SELECT max((total - capped) / weights) FILTER ((total - capped) / weights * weight <= cap) AS level FROM l),
        t AS (
            SELECT l.source, l.source_size, least(cap, coalesce(level * weight, cap)) AS target,
                   ('0x' || substr(md5('mix|' || coalesce(l.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM l, m),
        r AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, u,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS step,
                   row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie, d.doc_id) AS k
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(floor(u + step * k) - floor(u + step * (k - 1)) AS BIGINT) * size AS taken FROM r""",
    "op9_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        e AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4
                THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles
            FROM d),
        s AS (SELECT doc_id, unnest(shingles) AS shingle FROM e),
        n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM e),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
              FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
        u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS reached FROM n UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reached)
        SELECT doc_id, n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept
        FROM n JOIN r ON r.id = n.doc_id GROUP BY doc_id, n_shingles""",
    "op12_phrases": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (
            SELECT lang, 1 AS n, unnest(w) AS phrase FROM q UNION ALL
            SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM q UNION ALL
            SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM q),
        f AS (SELECT lang, n, phrase, count(*) AS f FROM g GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS total FROM f WHERE n = 1 GROUP BY lang),
        c AS (SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND f >= 10),
        k AS (SELECT *, {'g': lang, 'p': array_to_string(w[:k], ' ')} AS lkey, {'g': lang, 'p': array_to_string(w[k + 1:], ' ')} AS rkey
              FROM (SELECT *, unnest(range(1, n)) AS k FROM c)),
        z AS (SELECT {'g': lang, 'p': phrase} AS key, f FROM f),
        s AS (
            SELECT k.lang, k.phrase, k.n, k.a, k.k, x.f AS l, y.f AS r,
                   (1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS score
            FROM k JOIN z x ON x.key = k.lkey JOIN z y ON y.key = k.rkey),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        o AS (
            SELECT lang, phrase, max(a) AS a FROM (
                SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE n = 3) GROUP BY ALL),
        d AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               a, l, r, total AS n, CAST(score AS BIGINT) AS score
        FROM d JOIN t USING (lang) QUALIFY rank <= 2000""",
}

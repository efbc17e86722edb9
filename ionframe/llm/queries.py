"""One registered query per operator of this package, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.llm import (
    bpe, collocations, covertree, hmm, minhash, packing, prefixes, quantised, rotated, sharding, substrings, toxicity, urlrules,
)
from ionframe.llm.common import table

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"

#: The id that ends each packed document.
END_ID = 2
SHARDS = 8
TOKEN_LIMIT = 512


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into power-of-two sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), END_ID, keep_ids=False)


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a hidden Markov model trained on nine of ten folds, and by word counts."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by linked-list merging and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best rows by integer inner product for every twentieth vector."""
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages of fifty words that an earlier document holds."""
    return substrings.digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by positive-unlabelled learning on four of five folds."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight equal shards by rendezvous hashing of doc_id; and their shard among nine."""
    placed = sharding.shard_documents(
        table(spark, sf_dir, "documents"), sharding.equal_shards(SHARDS), added=(SHARDS, 1.0)
    )
    return placed.withColumn("law", F.lit("key"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts, the last of the counts at every prefix."""
    counted = prefixes.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_FILE))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents on five-word shingles at similarity 0.75."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at cosine 0.98."""
    return quantised.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to four words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; those without a rule are allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


def op13_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in 40 clusters after five rounds."""
    return rotated.cluster(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_hmm, op3_bpe, op4_topk, op5_substrings, op6_toxicity, op7_sharding, op8_token_counts, op9_minhash,
        op10_quantised, op11_collocations, op12_url_rules, op13_rotated,
    )
}

_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _clustering_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Rows of (vector, place, component) against rows of (centroid, place, component), round by round."""
    steps = [f"""
        v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id,
                list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT id, unnest(range(1, 65)) AS place, unnest(e) AS value FROM v),
        c0 AS MATERIALIZED (
            SELECT c - 1 AS c, unnest(range(1, 65)) AS place, unnest(e) AS value
            FROM (SELECT e, row_number() OVER (ORDER BY sha256('2:' || vec_id), e) AS c FROM v) WHERE c <= {clusters})"""]
    for k in range(rounds + 1):
        steps.append(f"""
        d{k} AS MATERIALIZED (
            SELECT id, c, CAST(sum((x.value - c{k}.value) * (x.value - c{k}.value)) AS BIGINT) AS d
            FROM x JOIN c{k} USING (place) GROUP BY id, c),
        a{k} AS MATERIALIZED (SELECT id, first(c ORDER BY d, c) AS c, min(d) AS d FROM d{k} GROUP BY id)""")
        if k < rounds:
            steps.append(f"""
        s{k} AS MATERIALIZED (SELECT c, place, sum(value) AS s, count(*) AS n FROM a{k} JOIN x USING (id) GROUP BY c, place),
        c{k + 1} AS MATERIALIZED (
            SELECT c, place, coalesce((s - ((s % n) + n) % n) // n, value) AS value FROM c{k} LEFT JOIN s{k} USING (c, place))""")
    return f"""
        WITH {",".join(steps)},
        own AS (SELECT c, CAST(sum(d) AS BIGINT) AS i FROM a{rounds} GROUP BY c),
        named AS (SELECT c, sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY place)) AS h FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, i AS cluster_inertia,
            CAST((SELECT sum(i) FROM own) AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN v USING (id) JOIN own USING (c) JOIN named USING (c)"""


ORACLE: dict[str, str] = {
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (
            SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS h
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
        least_of AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
        hit AS (SELECT doc_id, i FROM win JOIN least_of USING (h) WHERE first < doc_id),
        gone AS (
            SELECT doc_id, list(DISTINCT p) AS gone
            FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id),
        kept AS (
            SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
                CASE WHEN gone IS NULL THEN ws
                ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(gone, p)), lambda p: ws[p]) END AS left_
            FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id)
        SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(left_, ' '), '')) AS kept_sha256 FROM kept""",
    "op9_minhash": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        meet AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
            FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * i >= 75 * (x.n + y.n - i)),
        reach AS (
            SELECT DISTINCT a AS doc_id, a AS other FROM links
            UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
        least_of AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id,
            coalesce(c, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_of ON least_of.doc_id = w.doc_id""",
    "op10_quantised": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        reach AS (
            SELECT a AS vec_id, a AS other FROM n
            UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
        least_of AS (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id,
            coalesce(c, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least_of ON least_of.vec_id = e.vec_id""",
    "op11_collocations": rf"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS (
            SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
        words AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
        cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
        s AS (
            SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1 : j], ' ')
                JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[j + 1 : cut.k], ' ')),
        least_of AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        part AS (
            SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
        kept AS (
            SELECT z.* FROM least_of z LEFT JOIN part ON part.lang = z.lang AND part.phrase = z.phrase
            WHERE longer IS NULL OR 100 * longer < 80 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000""",
    "op12_url_rules": rf"""
        WITH u AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWERED}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(rule_host, rule_path, v) AS (VALUES {", ".join(map(str, URL_RULES))})
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict
        FROM (
            SELECT *, (
                SELECT max_by({{'rule': rule_host || rule_path, 'v': v}}, len(rule_host || rule_path)) FROM rules
                WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS b
            FROM p)""",
    "op13_rotated": _clustering_sql(),
}

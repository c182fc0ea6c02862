"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiregrid.llm import (
    bestfit_pack,
    chat_format,
    debruijn,
    exact_radix,
    minhash_fss,
    plane_clusters,
    quality_rules,
    secret_scan,
    sentence_pieces,
    shard_kk,
    suffix_bcr,
    token_align,
    token_files,
)
from wiregrid.llm.common import table
from wiregrid.session import scratch_dir


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(rows))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = sentence_pieces.encode(table(spark, sf_dir, "documents"), model)
    return sentence_pieces.decode(encoded, model)


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = bestfit_pack.cut_pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return bestfit_pack.pack(pieces)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_kk.shard_documents(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read_tokens(
        token_files.write_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_radix.deduplicate(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash_fss.Near(width=2)
    found = minhash_fss.near_components(table(spark, sf_dir, "documents"), near)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_bcr.cut_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, keep=["doc_id"]).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept"
    )


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(
        table(spark, sf_dir, "documents"),
        tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"),
    ).drop("groups")


def op12_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centers = plane_clusters.cluster(table(spark, sf_dir, "embeddings"))
    named = centers.select(
        "cluster", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("components").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )
    # A row per centroid, 16 of them.
    return members.join(F.broadcast(named), "cluster")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(
        table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/secret-ledger"
    )
    base = [rule.name for rule in secret_scan.BASE]

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["rule"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secret_scan.spelled(F.col("found"), base), 256).alias("base_sha256"),
        secret_scan.spelled(F.col("found")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_sentence_pieces": op2_sentence_pieces,
        "op3_bestfit_packing": op3_bestfit_packing,
        "op4_sharding": op4_sharding,
        "op5_token_files": op5_token_files,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_minhash": op7_minhash,
        "op8_debruijn": op8_debruijn,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_align": op11_align,
        "op12_plane_clusters": op12_plane_clusters,
        "op13_secret_scan": op13_secret_scan,
    }


OP6_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
    FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM texts
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS w
    FROM documents
),
shingles AS (
    SELECT doc_id, unnest(list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w] ELSE
        list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END)) AS s
    FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 80 * (x.n + y.n - common)
),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a
)
SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles,
       min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

OP10_SQL = r"""
WITH words AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                       lambda x: x <> '') AS w
    FROM documents
),
lines AS (
    SELECT *, list_filter(string_split(text, chr(10)),
                          lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM words
),
spots AS (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3
),
windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS three FROM spots),
twice AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows
    ) WHERE n > 1
),
repeats AS (
    SELECT doc_id, count(DISTINCT i + k) AS n
    FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
),
base AS (
    SELECT l.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT)
               AS n_symbols,
           CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
    FROM lines l LEFT JOIN repeats r ON l.doc_id = r.doc_id
),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           word_chars * 100 // greatest(n_words, 1) AS r_word_length,
           n_symbols * 1000 // greatest(n_words, 1) AS r_symbols,
           n_dup_lines * 1000 // greatest(n_words, 1) AS r_dup_lines,
           n_repeat_words * 1000 // greatest(n_words, 1) AS r_repeats
    FROM base
),
long AS (
    SELECT doc_id, lang, source, base_failed, unnest(['word_length', 'symbols', 'dup_lines', 'repeats'])
               AS ratio,
           unnest([r_word_length, r_symbols, r_dup_lines, r_repeats]) AS value,
           unnest([100, 50, 100, 50]) AS slack
    FROM judged
),
cells AS (
    SELECT *, (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0)
               AS cell
    FROM long WHERE NOT base_failed
),
levels AS (
    SELECT 0 AS level, lang, source, ratio, cell, slack FROM cells
    UNION ALL SELECT 1, lang, NULL, ratio, cell, slack FROM cells
    UNION ALL SELECT 2, NULL, NULL, ratio, cell, slack FROM cells
),
marks AS (
    SELECT level, lang, source, ratio, any_value(slack) AS slack, count(*) AS n,
           quantile_disc(cell, 0.1) AS down, quantile_disc(cell, 0.5) AS mid,
           quantile_disc(cell, 0.9) AS up
    FROM levels GROUP BY ALL HAVING count(*) >= 100
),
limits AS (
    SELECT *, mid - 4 * (mid - down + slack) AS low, mid + 4 * (up - mid + slack) AS high FROM marks
),
verdicts AS (
    SELECT v.doc_id,
           bool_and(coalesce(v.value BETWEEN coalesce(a.low, b.low, c.low)
                                         AND coalesce(a.high, b.high, c.high), true)) AS fair
    FROM long v
    LEFT JOIN limits a ON a.level = 0 AND a.ratio = v.ratio AND a.lang IS NOT DISTINCT FROM v.lang
                       AND a.source IS NOT DISTINCT FROM v.source
    LEFT JOIN limits b ON b.level = 1 AND b.ratio = v.ratio AND b.lang IS NOT DISTINCT FROM v.lang
    LEFT JOIN limits c ON c.level = 2 AND c.ratio = v.ratio
    GROUP BY v.doc_id
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND fair AS kept
FROM judged j JOIN verdicts v ON j.doc_id = v.doc_id
"""


_OP12_ROUND = """
near{n} AS MATERIALIZED (
    SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
    FROM (
        SELECT v.vec_id, c.cluster, list_sum(list_transform(range(1, 65), lambda i:
                   (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS distance
        FROM ints v, centers{n} c
    ) GROUP BY vec_id
),
"""

_OP12_MOVE = """
centers{next} AS MATERIALIZED (
    SELECT c.cluster, coalesce(any_value(m.x), any_value(c.x)) AS x
    FROM centers{n} c LEFT JOIN (
        SELECT cluster, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x FROM (
            SELECT cluster, i, CAST(sum(x) AS DOUBLE) AS total, count(*) AS n FROM (
                SELECT k.cluster, unnest(range(1, 65)) AS i, unnest(v.x) AS x
                FROM near{n} k JOIN ints v ON v.vec_id = k.vec_id
            ) GROUP BY cluster, i
        ) GROUP BY cluster
    ) m ON m.cluster = c.cluster
    GROUP BY c.cluster
),
"""

OP12_SQL = (
    """
WITH ints AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT))
               AS x
    FROM embeddings
    WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
),
centers0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, x
    FROM ints QUALIFY cluster < 16
),
"""
    + "".join(_OP12_ROUND.format(n=n) + _OP12_MOVE.format(n=n, next=n + 1) for n in range(3))
    + _OP12_ROUND.format(n=3)
    + """
sums AS (SELECT cluster, sum(distance) AS cluster_inertia FROM near3 GROUP BY cluster)
SELECT k.vec_id, CAST(k.cluster AS INTEGER) AS cluster, CAST(k.distance AS BIGINT) AS distance,
       CAST(s.cluster_inertia AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(distance) FROM near3) AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near3 k JOIN sums s ON s.cluster = k.cluster JOIN centers3 c ON c.cluster = k.cluster
"""
)


#: (kind, pattern, group, least characters), as the scan's rules have them.
_OP13_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
               r"""([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]


def _op13_hits(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {place} AS place, '{kind}' AS kind, {least} AS least,
           regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS part,
           string_split_regex(t, '{quoted}') AS gaps
    FROM texts"""


OP13_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(_op13_hits(i, *kind) for i, kind in enumerate(_OP13_KINDS))}
),
sizes AS (
    SELECT doc_id, place, kind, least, list_transform(m, lambda x: length(x)) AS m,
           list_transform(part, lambda x: length(x)) AS part,
           list_transform(gaps, lambda x: length(x)) AS gaps
    FROM hits WHERE len(m) > 0
),
spots AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM sizes),
spans AS (
    SELECT doc_id, place, kind, CAST(list_sum(gaps[1:i]) + list_sum(m[1:i]) - m[i] AS BIGINT) AS a,
           CAST(list_sum(gaps[1:i]) + list_sum(m[1:i]) AS BIGINT) AS b
    FROM spots WHERE part[i] >= least
),
told AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
           count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place)
               FILTER (place < 3) AS base,
           string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": OP6_SQL,
        "op7_minhash": OP7_SQL,
        "op10_quality_rules": OP10_SQL,
        "op12_plane_clusters": OP12_SQL,
        "op13_secret_scan": OP13_SQL,
    }

"""One query for each operator over its whole table, and its check in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm import (
    decontaminate,
    hyperminhash,
    licenses,
    mixing,
    neighbours,
    ngram_join,
    periods,
    ranking,
    substrings,
    tokens,
    toxicity,
    urls,
    warc,
)
from spectrafold.llm.frames import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"

# The url rules (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


@query(
    "op1_warc",
    """
    WITH page AS (
        SELECT page_id, coalesce(html, '') AS payload FROM pages
    ), sized AS (
        SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
               sha256(payload) AS payload_digest
        FROM page
    ), told AS (
        SELECT *, CASE WHEN payload_bytes >= 100
                       THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
        FROM sized
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id
                THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
    FROM told
    """,
)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of all pages, read back."""
    manifest = warc.write(table(spark, folder, "pages"))
    return warc.read(manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query(
    "op2_ngram_join",
    r"""
    WITH RECURSIVE cut AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[ \t\n\v\f\r]+'), lambda w: w <> '') AS words
        FROM documents
    ), shingle AS (
        SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS s
        FROM cut, unnest(range(1, greatest(len(words) - 2, least(len(words), 1) + 1))) AS t(i)
    ), sized AS (
        SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM shingle
    ), link AS (
        SELECT a.doc_id AS x, b.doc_id AS y
        FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), reach AS (
        SELECT doc_id AS x, doc_id AS y FROM cut
        UNION
        SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
    )
    SELECT cut.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles,
           (SELECT min(y) FROM reach WHERE reach.x = cut.doc_id) AS component_id
    FROM cut LEFT JOIN (SELECT DISTINCT doc_id, n FROM sized) USING (doc_id)
    GROUP BY cut.doc_id
    """,
)
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under Jaccard links of 0.85."""
    return ngram_join.report(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "op3_decontamination",
    r"""
    WITH cut AS (
        SELECT kind, id, list_filter(string_split_regex(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
        FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents
              UNION ALL SELECT 'item', item_id, text FROM benchmark)
    ), shingle AS (
        SELECT DISTINCT kind, id, array_to_string(words[i : i + 4], ' ') AS s
        FROM cut, unnest(range(1, len(words) - 3)) AS t(i)
    ), sized AS (
        SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingle WHERE kind = 'item'
    ), hit AS (
        SELECT d.id AS doc_id, i.id AS item_id, any_value(i.n) AS n_item, count(*) AS n_shared
        FROM sized i JOIN shingle d ON d.kind = 'doc' AND d.s = i.s GROUP BY ALL
    )
    SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
    FROM hit WHERE 10 * n_shared >= 8 * n_item
    """,
)
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that stand in documents: every pair found."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.contained(docs, table(spark, folder, "benchmark"))


@query("op4_neighbours")
def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query("op5_mixing")
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of every document, and its share in each domain."""
    rows = mixing.mix(table(spark, folder, "documents"), table(spark, folder, "labels"))
    shares = [
        F.round(F.col("posterior")[k], 6).alias(f"share_{name}")
        for k, name in enumerate(mixing.TARGETS)
    ]
    return rows.select("doc_id", "n_tokens", *shares, "rate", "copies")


@query("op6_licenses")
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence findings of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query(
    "op7_substring_dedup",
    r"""
    WITH cut AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS words
        FROM documents
    ), win AS (
        SELECT doc_id, i, sha256(array_to_string(words[i : i + 49], ' ')) AS w
        FROM cut, unnest(range(1, len(words) - 48)) AS t(i)
    ), dup AS (
        SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS first_id FROM win)
        WHERE first_id < doc_id
    ), covered AS (
        SELECT DISTINCT doc_id, i + k AS i FROM dup, unnest(range(0, 50)) AS t(k)
    ), gone AS (
        SELECT doc_id, list(i) AS places FROM covered GROUP BY doc_id
    ), result AS (
        SELECT doc_id, words, coalesce(len(places), 0) AS n_removed,
               CASE WHEN places IS NULL THEN words
                    ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END AS kept
        FROM cut LEFT JOIN gone USING (doc_id)
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
           sha256(array_to_string(kept, ' ')) AS kept_sha256
    FROM result
    """,
)
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document after substring dedup."""
    return substrings.report(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, TOKENIZER).drop("text")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted"
    )


@query(
    "op10_url_filter",
    """
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0
                             THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ), split AS (
        SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS given,
               regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
        FROM cut
    ), page AS (
        SELECT page_id, path,
               translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
        FROM split
    ), rules(rule_host, rule_path, said) AS (
        VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
               ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ), fitting AS (
        SELECT page_id, host, path, rule_host || rule_path AS rule, said,
               row_number() OVER (PARTITION BY page_id, host, path
                                  ORDER BY length(rule_host || rule_path) DESC) AS place
        FROM page LEFT JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM fitting WHERE place = 1
    """,
)
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, rules).drop("url")


@query(
    "op11_near_duplicates",
    r"""
    WITH RECURSIVE cut AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[ \t\n\v\f\r]+'), lambda w: w <> '') AS words
        FROM documents
    ), shingle AS (
        SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS s
        FROM cut, unnest(range(1, greatest(len(words) - 2, least(len(words), 1) + 1))) AS t(i)
    ), sized AS (
        SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM shingle
    ), link AS (
        SELECT a.doc_id AS x, b.doc_id AS y
        FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reach AS (
        SELECT doc_id AS x, doc_id AS y FROM cut
        UNION
        SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
    ), named AS (
        SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
    )
    SELECT cut.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, any_value(component_id) AS component_id,
           cut.doc_id = any_value(component_id) AS kept
    FROM cut JOIN named USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id, n FROM sized) USING (doc_id)
    GROUP BY cut.doc_id
    """,
)
def op11_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under Jaccard links of 0.8, and whether it is the one kept."""
    return hyperminhash.report(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "op12_ranked_search",
    r"""
    WITH doc AS (
        SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
        FROM documents
    ), item AS (
        SELECT item_id, unnest(list_filter(string_split_regex(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)
    ), asked AS (
        SELECT item_id, term, count(*) AS times FROM item GROUP BY ALL
    ), total AS (
        SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_words FROM doc WHERE len(words) > 0
    ), found AS (
        SELECT row, doc_id, n, term, count(*) AS tf
        FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM doc)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ), held AS (
        SELECT term, count(*) AS df FROM found GROUP BY term
    ), weighted AS (
        SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM held, total
    ), scored AS (
        SELECT item_id, row, doc_id,
               CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
        FROM asked JOIN weighted USING (term) JOIN found USING (term), total GROUP BY ALL
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scored WHERE score > 0
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
)
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ranking.top(docs, table(spark, folder, "benchmark").select("item_id", "text"), k=20)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, the longest one, and what is left without repetition."""
    docs = periods.with_periodic_tails(table(spark, folder, "documents").select("doc_id", "text"))
    found = periods.collapse(docs)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS s, -r.period AS p)))")
    lines = "transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n')"
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.length div -longest.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.expr(lines), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

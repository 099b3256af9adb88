"""One query per operator over the given tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalogue.registry import Tables
from .chat_format import conversation_digests, format_conversations, read_conversations
from .decontaminate import contamination
from .embedding_dedup import embedding_duplicates
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .lexical_search import build_index, search
from .mixing import mix
from .near_dedup import near_duplicates
from .pseudonyms import pseudonymize
from .quality import classify, trusted_ids
from .token_counts import token_counts
from .token_files import read_documents, write_token_files
from .url_rules import judge_urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def all_queries() -> dict[str, Query]:
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


@query("op1_kneser_ney_quality")
def kneser_ney_quality(t: Tables) -> DataFrame:
    judged = classify(t.documents, trusted_ids(t.labels), carry=["doc_id", "lang"])
    return judged.select("doc.doc_id", "doc.lang", "bits_per_byte", "perplexity", "low", "high", "kept")


@query("op2_pfair_mixing")
def pfair_mixing(t: Tables) -> DataFrame:
    return mix(t.documents, power=0.5, block_bytes=1 << 16)


@query("op3_feistel_pseudonyms")
def feistel_pseudonyms(t: Tables) -> DataFrame:
    return pseudonymize(t.documents, key="millrace example key")


@query("op4_whole_token_counts")
def whole_token_counts(t: Tables) -> DataFrame:
    return token_counts(t.documents, tokenizer_path("word_bpe_49k.json"), limit=2048)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op5_cuckoo_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, text_sha256
    FROM d WINDOW same AS (PARTITION BY text_sha256)
""")
def cuckoo_exact_dedup(t: Tables) -> DataFrame:
    return exact_duplicates(t.documents)


@query("op6_arrow_token_files")
def arrow_token_files(t: Tables) -> DataFrame:
    files = write_token_files(
        t.documents, tokenizer_path("byte_bpe_50k.json"), end_id=2, order_by=[F.col("doc_id"), F.xxhash64("text")],
        length=2048)
    return read_documents(files)


WORDS = "regexp_extract_all(" + LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_winnowing_decontamination", f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    item_windows AS (
        SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
            SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
            FROM items WHERE len(w) > 0)
    ),
    sizes AS (SELECT DISTINCT n FROM item_windows),
    doc_windows AS (
        SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
            SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
    ),
    hits AS (SELECT r, d.n, i, item_id FROM doc_windows d JOIN item_windows t ON d.win = t.win AND d.n = t.n),
    words AS (
        SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
    ),
    found AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits),
    ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
""")
def winnowing_decontamination(t: Tables) -> DataFrame:
    return contamination(t.documents, t.benchmark)


URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query("op8_mined_url_rules")
def mined_url_rules(t: Tables) -> DataFrame:
    labels = t.labels.select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(t.pages, labels, URL_RULES)


def _escaped(text: str) -> str:
    from .chat_format import ESCAPES

    for old, new in ESCAPES:
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query("op9_relational_chat_format", f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), marked AS (
        SELECT *, {_escaped('text')} AS body, replace({_escaped('role')}, chr(10), '\\n') AS head,
               lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                           FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(body) + CASE WHEN before = role THEN 11 ELSE 12 + length(head) + 1
                    + CASE WHEN before IS NULL THEN 0 ELSE 11 END END) + 11 AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
""")
def relational_chat_format(t: Tables) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    extra = t.spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    turns = t.conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(read_conversations(format_conversations(turns)))


@query("op10_lsh_forest_near_dedup")
def lsh_forest_near_dedup(t: Tables) -> DataFrame:
    return near_duplicates(t.documents, percent=85, k=5)


@query("op11_one_bit_hard_negatives", """
    WITH e AS (
        SELECT row_number() OVER () AS r, vec_id,
               CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x) FOR x IN CAST(embedding AS DOUBLE[])] AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    ), scored AS (
        SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same,
               CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r
    ), positives AS (
        SELECT a, anchor_id AS id, vec_id AS positive_id, b AS p, score AS positive_score FROM (
            SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS n FROM scored WHERE same)
        WHERE n <= 5
    ), ranked AS (
        SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, vec_id, b) AS INTEGER) AS rank
        FROM positives p JOIN scored s ON s.a = p.a AND NOT same
        WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
""")
def one_bit_hard_negatives(t: Tables) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(t.embeddings.withColumn("label", label), anchors=F.col("vec_id") % 100 == 0)


@query("op12_int8_tile_dedup", """
    WITH RECURSIVE e AS (
        SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    ), links AS (
        SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.label = b.label AND a.r <> b.r
        WHERE list_cosine_similarity(a.v, b.v) >= 0.98
    ), reach AS (
        SELECT r, r AS s FROM e UNION SELECT reach.r, links.b AS s FROM reach JOIN links ON links.a = reach.s
    ), least AS (
        SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.s GROUP BY reach.r
    ), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM e JOIN least ON least.r = e.r LEFT JOIN counts ON counts.a = e.r
""")
def int8_tile_dedup(t: Tables) -> DataFrame:
    return embedding_duplicates(t.embeddings, threshold=0.98)


TERMS = "regexp_extract_all(" + LOWERED + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op13_block_max_search", f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
    sizes AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
    items AS (SELECT row_number() OVER () AS q, item_id, {TERMS} AS w FROM benchmark),
    asked AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM items) GROUP BY q, term),
    held AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs)
        WHERE term IN (SELECT term FROM asked) GROUP BY r, term
    ),
    weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals
    ),
    impacts AS (
        SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS impact
        FROM held JOIN sizes USING (r), totals
    ),
    scores AS (
        SELECT q, r, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score
        FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY q, r, doc_id
    ),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 20
""")
def block_max_search(t: Tables) -> DataFrame:
    return search(build_index(t.documents), t.benchmark, k=20)

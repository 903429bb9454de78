"""The queries of the dealt operators, with SQL where DuckDB can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from caselens.llm import (
    op1_sharding as slots,
    op2_token_files as token_files,
    op3_suffix_dedup as suffix_dedup,
    op4_maxent_lm as maxent_lm,
    op5_pii as pii,
    op6_language_id as language_id,
    op7_jaccard_join as jaccard_join,
    op8_mixing as mixing,
    op9_decontamination as decontamination,
    op10_exact_dedup as exact_dedup,
    op11_vector_search as vector_search,
    op12_vector_codes as vector_codes,
    op13_conversation_repair as conversation_repair,
)

QUERIES, ORACLES = {}, {}


def registered(oracle: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


OP9_SQL = """
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark),
     windows AS (SELECT DISTINCT item, w[i : i + least(10, len(w)) - 1] AS win
        FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
     docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents),
     grams AS (SELECT doc_id, n, i, w[i : i + n - 1] AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM docs, (SELECT DISTINCT len(win) AS n FROM windows) WHERE len(w) >= n)),
     hits AS (SELECT g.doc_id, g.n, g.i, x.item FROM grams g JOIN windows x ON g.win = x.win),
     words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
     named AS (SELECT doc_id, count(DISTINCT item) AS n_items,
        array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(named.n_items, 0) AS n_items,
    sha256(coalesce(named.items, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""


@registered(OP9_SQL)
def op9_decontaminate(spark, sf):
    docs, benchmark = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    return decontamination.digest(decontamination.contamination(docs, benchmark))


OP10_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@registered(OP10_SQL)
def op10_exact_copies(spark, sf):
    return exact_dedup.exact_groups(read(spark, sf, "documents"))


@registered()
def op1_sharding(spark, sf):
    placed = slots.shard(read(spark, sf, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


@registered()
def op2_token_files(spark, sf):
    return token_files.round_trip(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registered()
def op8_mixing(spark, sf):
    mixed = mixing.mix(read(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@registered()
def op5_pii(spark, sf):
    return pii.digest(pii.find(read(spark, sf, "documents")))


OP7_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x{20}\\x{09}-\\x{0D}]+') AS w FROM documents),
     grams AS (SELECT DISTINCT doc_id, w[i : i + least(4, len(w)) - 1] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
     sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
     pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
        GROUP BY x.doc_id, y.doc_id),
     links AS (SELECT a, b FROM pairs JOIN sizes s ON a = s.doc_id JOIN sizes t ON b = t.doc_id
        WHERE 100 * pairs.n >= 85 * (s.n + t.n - pairs.n)),
     reached AS (WITH RECURSIVE r(doc_id, node) AS (SELECT doc_id, doc_id FROM words
            UNION SELECT r.doc_id, links.b FROM r JOIN links ON r.node = links.a) SELECT * FROM r)
SELECT words.doc_id, coalesce(max(sizes.n), 0) AS n_shingles, min(reached.node) AS component_id
FROM words LEFT JOIN sizes ON words.doc_id = sizes.doc_id JOIN reached ON words.doc_id = reached.doc_id
GROUP BY words.doc_id
"""


@registered(OP7_SQL)
def op7_jaccard_join(spark, sf):
    return jaccard_join.near_groups(read(spark, sf, "documents"))


@registered()
def op3_suffix_dedup(spark, sf):
    return suffix_dedup.digest(suffix_dedup.removed(read(spark, sf, "documents")))


@registered()
def op4_maxent_lm(spark, sf):
    return maxent_lm.score(read(spark, sf, "documents"))


@registered()
def op6_language_id(spark, sf):
    evidence = language_id.document_evidence()
    return language_id.identify(read(spark, sf, "documents"), ["doc_id"], **evidence)


@registered()
def pages_language(spark, sf):
    """The same operator where markup and addresses are: ``pages``."""
    return language_id.identify(read(spark, sf, "pages"), ["page_id"], **language_id.page_evidence())


OP11_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
        FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
     ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs)
SELECT * FROM ranked WHERE rank <= 20
"""


@registered(OP11_SQL)
def op11_vector_search(spark, sf):
    rows = vector_search.usable(read(spark, sf, "embeddings"))
    queries = rows.where("id % 20 = 0")
    return vector_search.search(vector_search.build_index(rows), queries)


def _op12_sql() -> str:
    """Five assignments and four replacements, one after another."""
    rounds = []
    for i in range(5):
        rounds.append(
            f"""a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM
        (SELECT r, p, e, x, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) AS d
         FROM parts JOIN b{i} USING (p)) GROUP BY r, p)"""
        )
        if i < 4:
            rounds.append(
                f"""s{i} AS (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM
        (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY p, e, i),
     m{i} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s{i} GROUP BY p, e),
     b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, e))"""
            )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
        list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
     b0 AS (SELECT p, r AS e, x AS c FROM parts WHERE r < 256),
     {", ".join(rounds)},
     codes AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r),
     books AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h
        FROM (SELECT p, e, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS y FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN codes USING (r), books
"""


@registered(_op12_sql())
def op12_vector_codes(spark, sf):
    return vector_codes.digest(*vector_codes.fit_and_encode(read(spark, sf, "embeddings")))


# The checksum bit by bit, and the cheapest edits row by row, each state with its best path so far.
OP13_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
     hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
            coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: CAST(ord(s) AS BIGINT))),
            lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS way
        FROM conversations, crc),
     damaged AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
        CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN way = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE way <> 0),
     placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inked,
        CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM damaged),
     judged AS MATERIALIZED (SELECT *, CASE WHEN inked = '' THEN 2
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
            WHEN right(inked, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
     stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate,
        count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id),
     everyone AS (SELECT DISTINCT conv_id FROM conversations),
     inserts(q, q1, ins, lines, c) AS (VALUES (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0),
        (0, 2, 'I', chr(10) || 'user:', 5), (1, 2, 'I', chr(10) || 'user:', 5), (3, 2, 'I', chr(10) || 'user:', 5),
        (2, 3, 'I', chr(10) || 'assistant:', 5), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10),
        (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10)),
     ops(op, initial, q1, q2, name, c) AS (VALUES ('D', NULL, NULL, NULL, NULL, 2),
        ('K', 's', 0, 1, NULL, 0), ('K', 'u', 0, 2, NULL, 0), ('K', 'u', 1, 2, NULL, 0), ('K', 'u', 3, 2, NULL, 0), ('K', 'a', 2, 3, NULL, 0),
        ('R', NULL, 0, 2, 'user', 1), ('R', NULL, 1, 2, 'user', 1), ('R', NULL, 3, 2, 'user', 1), ('R', NULL, 2, 3, 'assistant', 1)),
     paths AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'c': CAST(0 AS BIGINT), 'audit': '', 'body': ''} AS best FROM everyone
        UNION ALL
        SELECT p.conv_id, p.i + 1, coalesce(o.q2, n.q1),
            min({'c': p.best.c + n.c + o.c + CASE WHEN o.op <> 'D' AND j.fault = 1 THEN 5 ELSE 0 END,
                'audit': p.best.audit || n.ins || o.op,
                'body': p.best.body || n.lines || CASE WHEN o.op = 'D' THEN '' ELSE chr(10) || coalesce(o.name, j.role) || ':' || j.text END})
        FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1
        JOIN inserts n ON n.q = p.q
        JOIN ops o ON (o.op = 'D' OR j.fault < 2) AND (o.q1 IS NULL OR o.q1 = n.q1) AND (o.initial IS NULL OR o.initial = j.initial)
        GROUP BY p.conv_id, p.i, coalesce(o.q2, n.q1)),
     ends AS (SELECT p.conv_id, min({'c': p.best.c + n.c, 'audit': p.best.audit || n.ins, 'body': p.best.body || n.lines}) AS best
        FROM paths p LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM p.conv_id JOIN inserts n ON n.q = p.q AND n.q1 IN (0, 3)
        WHERE p.i = coalesce(s.n, 0) GROUP BY p.conv_id)
SELECT e.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
    coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, CAST(e.best.c AS BIGINT) AS cost, e.best.audit AS audit,
    sha256(substr(e.best.body, 2)) AS repaired_sha256
FROM ends e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@registered(OP13_SQL)
def op13_conversation_repair(spark, sf):
    return conversation_repair.repair(conversation_repair.damaged(read(spark, sf, "conversations")))

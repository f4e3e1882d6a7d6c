"""The registered queries of the pipeline operators and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op5_exact_top_k", """
WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.own, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.own <> q.own AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.topk import exact_top_k

    vectors = table(spark, folder, "embeddings")
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


@query("op8_mixing", """
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   md5(concat('0:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(source, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
-- the rule as stated: stop what is above its limit, share the rest again
step AS (SELECT 0 AS i, []::BIGINT[] AS stopped, (SELECT sum(source_size) FROM w)::DOUBLE / (SELECT sum(weight) FROM w) AS level
         UNION ALL
         SELECT i + 1, list_sort((SELECT list(place) FROM w WHERE cap < weight * step.level)),
                ((SELECT sum(source_size) FROM w)::DOUBLE - (SELECT coalesce(sum(cap), 0) FROM w WHERE cap < weight * step.level))
                / (SELECT sum(weight) FROM w WHERE cap >= weight * step.level)
         FROM step WHERE i = 0 OR i < 60),
fixed AS (SELECT level FROM step ORDER BY i DESC LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM fixed)) AS target FROM w),
g AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS goal FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.goal,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
-- a pass takes the whole document if at least half of it lies before the end of the target
SELECT doc_id, size, source_size, target, size * n AS taken, n AS n_draws
FROM (SELECT *, CASE WHEN size = 0 THEN 0 ELSE (2 * (goal - start) >= size)::BIGINT + (2 * (goal - start - source_size) >= size)::BIGINT
                     + (2 * (goal - start - 2 * source_size) >= size)::BIGINT END::BIGINT AS n FROM p)
""")
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.mixing import mix

    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.size("draws").cast("long").alias("n_draws"))


@query("op2_preference_format", """
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT a.conv_id, a.turns AS chosen, (a.conv_id // 2) % (len(a.turns) + 1) AS cut, coalesce(b.turns, []) AS theirs
      FROM c a LEFT JOIN c b ON b.conv_id = xor(a.conv_id, 1::BIGINT)),
r AS (SELECT conv_id, chosen, list_concat(chosen[1:cut], theirs[cut + 1:]) AS rejected FROM p),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1,
                         least(len(chosen), len(rejected))) AS k FROM r),
t AS (SELECT conv_id, k, chosen[1:k] AS pr, chosen[k + 1:] AS ch, rejected[k + 1:] AS re FROM n),
x AS (SELECT conv_id, k,
      list_transform(pr, lambda t: concat('<|', t.role, chr(10), t.text, '<|end|>', chr(10))) AS pl,
      list_transform(ch, lambda t: concat('<|', t.role, chr(10), t.text, '<|end|>', chr(10))) AS cl,
      list_transform(re, lambda t: concat('<|', t.role, chr(10), t.text, '<|end|>', chr(10))) AS rl, ch, re FROM t)
SELECT conv_id, k::INTEGER AS prompt_turns, list_aggregate(list_concat([''], pl), 'string_agg', '') AS prompt,
       list_aggregate(list_concat([''], cl), 'string_agg', '') AS chosen_text, list_aggregate(list_concat([''], rl), 'string_agg', '') AS rejected_text,
       list_aggregate(list_concat([''], list_transform(list_filter(range(1, len(ch) + 1), lambda i: ch[i].role = 'assistant'),
           lambda i: concat(coalesce(list_sum(list_transform(cl[1:i], lambda s: length(s))), 0) - length(cl[i]) + 12, '-', coalesce(list_sum(list_transform(cl[1:i], lambda s: length(s))), 0), ' '))), 'string_agg', '') AS chosen_spans,
       list_aggregate(list_concat([''], list_transform(list_filter(range(1, len(re) + 1), lambda i: re[i].role = 'assistant'),
           lambda i: concat(coalesce(list_sum(list_transform(rl[1:i], lambda s: length(s))), 0) - length(rl[i]) + 12, '-', coalesce(list_sum(list_transform(rl[1:i], lambda s: length(s))), 0), ' '))), 'string_agg', '') AS rejected_spans
FROM x
""")
def op2_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.preference import branched_pairs, format_preferences

    def spans(name: str):
        return F.array_join(F.transform(name, lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["stop"].cast("string"), F.lit(" "))), "")

    pairs = branched_pairs(table(spark, folder, "conversations"))
    return format_preferences(pairs).select("conv_id", "prompt_turns", "prompt", "chosen_text", "rejected_text",
                                            spans("chosen_mask").alias("chosen_spans"), spans("rejected_mask").alias("rejected_spans"))


@query("op4_ngram_jaccard", """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2], ' ', w[i + 3]))) END AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS token FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.token = b.token AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
""")
def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, folder, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op3_url_filter")
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.url_filter import ALLOW, BLOCK, judge

    rules = [("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK)]
    return judge(table(spark, folder, "pages"), rules)


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.ngram_lm import score_documents

    return score_documents(table(spark, folder, "documents"), fold=5, held=1, order=3)


# fixed value: the split pattern that belongs to the byte-level vocabularies
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query("op10_imatch")
def op10_imatch(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.imatch import fingerprint_documents

    return fingerprint_documents(table(spark, folder, "documents"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.compression import classify

    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.separator_scan import document_token_counts

    path = tokenizer_path("byte_bpe_50k.tiktoken")

    def encode():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]

    # the file name depends on the task attempt, so the digest leaves it out
    return document_token_counts(table(spark, folder, "documents"), encode, end_id=50256).select("doc_id", "n_tokens")


@query("op11_prefix_trie", """
WITH RECURSIVE o AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
-- crc32 bit by bit: the register starts and ends inverted, the polynomial is 0xEDB88320
c AS (SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                      lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d AS depth, turns[1:d] AS node, len(turns) = d AS ends FROM r, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY depth, node),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND m.node[1:n.depth] = n.node) AS n_children,
             CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS gain FROM n),
-- every node is booked at itself and at all its ancestors
a AS (SELECT k.node[1:d] AS node, d AS depth, sum(gain) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM k, LATERAL (SELECT unnest(range(0, k.depth + 1)) AS d) GROUP BY ALL)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN a ON a.depth = k.depth AND a.node = k.node LEFT JOIN k u ON u.depth = k.depth - 1 AND u.node = k.node[1:k.depth - 1]
""")
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.prefix_trie import prefix_trie, rebuilt_conversations

    return prefix_trie(rebuilt_conversations(table(spark, folder, "conversations")))


@query("op12_chunked_bpe")
def op12_chunked_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.chunked_bpe import encode_documents

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")

    return encode_documents(table(spark, folder, "documents"), path)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from docfields.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"), components=4, factor=256.0)

"""The registered query of each operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlens.llm import alignment, ann, chat, extraction, language, licenses, merkle, mixing, packing, simhash, substring, topk, toxicity
from stormlens.llm.common import bucket_of, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


TOKENIZER = "word_bpe_49k.json"


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 4) == 2
    net = language.learn(docs, ~held_out)
    return language.identify_ids(docs, net, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op3_simhash_near_dedup")
def op3(spark, sf_dir):
    got = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_html_extraction")
def op4(spark, sf_dir):
    return extraction.extract(read(spark, sf_dir, "pages"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 5) == 0
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op6_source_mixing", """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
  r AS (SELECT source, sum(n) OVER () * sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () / n AS rate FROM s),
  p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
    FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM r)),
  u AS (SELECT doc_id, source, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
  c AS (SELECT doc_id, u.source, count(*) AS n_copies FROM u JOIN p ON p.source IS NOT DISTINCT FROM u.source AND p.cdf <= u.u GROUP BY ALL)
SELECT doc_id, source, CAST(n_copies AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy,
  substr(md5('mix order:' || doc_id || ':' || copy), 1, 16) AS shuffle_order
FROM (SELECT doc_id, source, n_copies, unnest(range(n_copies)) AS copy FROM c)""")
def op6(spark, sf_dir):
    got = mixing.mix(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", F.col("__copies").alias("n_copies"), F.col("__copy").alias("copy"),
                      F.col("__order").alias("shuffle_order"))


@query("op7_substring_dedup", r"""
WITH w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents)),
  g AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER s AS win, count(*) OVER s AS n
    FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
  d AS (SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY n = 20, win ORDER BY doc_id, pos) > 1 AS late FROM g),
  c AS (SELECT doc_id, pos, word, bool_or(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM d),
  r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)""")
def op7(spark, sf_dir):
    return substring.digest(read(spark, sf_dir, "documents"))


@query("op8_cross_polytope_ann")
def op8(spark, sf_dir):
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op9(spark, sf_dir):
    return topk.top_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_license_scan")
def op10(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


@query("op11_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
  e AS (SELECT *, length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(role, '###+'), lambda x: length(x) - 2)), 0)
      + (length(role) - length(replace(role, ':' || chr(10), ''))) // 2
    + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) + 15 AS n FROM c),
  p AS (SELECT *, sum(n) OVER w AS upto, role = 'assistant' OR lead(1) OVER w IS NULL AS ends FROM e
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (ends)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""")
def op11(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digest(turns.unionByName(more))


_LEAF = "sha256(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ["doc_id", "source", "lang", "n_chars", "{text}"]) + ")"


@query("op12_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_LEAF.format(text="text")} AS leaf,
    {_LEAF.format(text="replace(text, chr(10), '')")} AS tampered, doc_id::VARCHAR AS s FROM documents),
  e AS (SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda k:
    [ascii(s[k]), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
    ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS crc FROM d),
  l AS (SELECT *, CASE WHEN crc % 2 = 0 THEN tampered ELSE leaf END AS claimed, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM e),
  t(source, lev, i, h, n) AS (SELECT source, 0, i, leaf, n FROM l UNION ALL
    SELECT source, lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, lev, n, i // 3),
  s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
  u(lev, i, h, n) AS (SELECT 0, i, h, n FROM s UNION ALL
    SELECT lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lev, n, i // 3),
  p(rid, source, lev, i, n, cur, sib) AS (SELECT rid, source, 0, i, n, claimed, '' FROM l UNION ALL
    SELECT p.rid, p.source, p.lev + 1, p.i // 3, (p.n + 2) // 3, sha256(string_agg(CASE WHEN t.i = p.i THEN p.cur ELSE t.h END, '' ORDER BY t.i)),
      p.sib || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> p.i), '')
    FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND t.lev = p.lev AND t.i // 3 = p.i // 3 WHERE p.n > 1
    GROUP BY p.rid, p.source, p.lev, p.i, p.n, p.sib),
  q(rid, lev, i, n, cur, sib) AS (SELECT p.rid, 0, s.i, s.n, p.cur, p.sib FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source WHERE p.n = 1
    UNION ALL SELECT q.rid, q.lev + 1, q.i // 3, (q.n + 2) // 3, sha256(string_agg(CASE WHEN u.i = q.i THEN q.cur ELSE u.h END, '' ORDER BY u.i)),
      q.sib || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> q.i), '')
    FROM q JOIN u ON u.lev = q.lev AND u.i // 3 = q.i // 3 WHERE q.n > 1 GROUP BY q.rid, q.lev, q.i, q.n, q.sib)
SELECT doc_id, leaf, s.h AS subroot, u.h AS root, sha256(q.sib) AS proof_sha256, q.cur AS folded_root, q.cur = u.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN q ON q.rid = l.rid AND q.n = 1 JOIN u ON u.n = 1""")
def op12(spark, sf_dir):
    return merkle.document_manifest(read(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def op13(spark, sf_dir):
    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))[0]

"""Registered queries of the subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_kd_shards")
def op1_kd_shards(spark, sf_dir):
    """All documents in 40 shards of near-equal bytes, split along language, source and length."""
    from .sharding import kd_shards
    out = kd_shards(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang", "source", "n_chars"], shards=40)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a"""

_OP6_SQL = r"""
WITH w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM (SELECT doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)),
s AS (SELECT doc_id, j, string_agg(word, ' ') OVER p AS run, count(*) OVER p AS n FROM w
  WINDOW p AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
d AS (SELECT doc_id, j FROM s JOIN (SELECT run FROM s WHERE n = 35 GROUP BY run HAVING count(*) > 1) USING (run) WHERE n = 35),
c AS (SELECT DISTINCT doc_id, unnest(range(j, j + 35)) AS j FROM d),
k AS (SELECT w.doc_id, count(*) AS n_words, count(c.j) AS n_removed,
  string_agg(word, ' ' ORDER BY w.j) FILTER (WHERE c.j IS NULL) AS kept
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.j = w.j GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)"""

_OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT, 1)),
  '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""


@register("op2_embedding_dedup", _OP2_SQL)
def op2_embedding_dedup(spark, sf_dir):
    """Links of cosine 0.95 and more between all embeddings."""
    from .embed_dedup import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=0.95)
    return out.withColumnRenamed("id", "vec_id")


@register("op3_bpe")
def op3_bpe(spark, sf_dir):
    """All documents encoded with the public word BPE and decoded again."""
    from . import bpe
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path).select(
        F.struct(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                 F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256")).alias("row"), "ids")
    return bpe.decode(coded, "row", "ids", path).select("id.*", F.sha2("text", 256).alias("decoded_sha256"))


@register("op4_packing")
def op4_packing(spark, sf_dir):
    """All documents packed into sequences of 512 to 8192 tokens."""
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@register("op5_simhash")
def op5_simhash(spark, sf_dir):
    """SimHash groups of all documents: 3-word shingles, 3 bits."""
    from .simhash import simhash_groups
    out = simhash_groups(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, max_bits=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


@register("op6_substring", _OP6_SQL)
def op6_substring(spark, sf_dir):
    """Repeated 35-word windows removed from all documents."""
    from .substring import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", window=35)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(remainder: int, modulus: int):
    """Rows that nothing is learned from; a row without an id is none of them."""
    return F.coalesce(_remainder(modulus) == remainder, F.lit(False))


def _remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@register("op7_language")
def op7_language(spark, sf_dir):
    """Language of all documents; learns from rows outside the held-out quarter."""
    from . import langid
    docs = table(spark, sf_dir, "documents")
    out = langid.learn_and_identify(docs, "text", "lang", ~held_out(2, 4), F.col("doc_id"))
    return out.withColumnRenamed("kept", "doc_id").select(
        "doc_id", held_out(2, 4).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    """Toxicity of all documents; learns from labels outside the held-out fifth."""
    from . import toxicity
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(0, 5))
    model = toxicity.train(docs, "doc_id", "text", labels, "doc_id", "toxic")
    return (toxicity.score(docs, "doc_id", "text", model).withColumnRenamed("id", "doc_id")
            .select("doc_id", held_out(0, 5).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


@register("op9_warc", _OP9_SQL)
def op9_warc(spark, sf_dir):
    """All pages written as sharded WARC files and read back."""
    from .common import scratch_path
    from .warc import read_warc, write_warc
    folder = scratch_path(spark, "warc-archive")
    write_warc(table(spark, sf_dir, "pages"), "page_id", "url", "html", folder, least_bytes=0)
    return read_warc(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest",
                                           "record_type", "refers_to")


@register("op10_neighbours")
def op10_neighbours(spark, sf_dir):
    """The ten nearest embeddings of every hundredth one."""
    from .ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10).select(
        "query_id", "rank", "vec_id", "score")


_OP11_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: unicode(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM c WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn FROM d),
r AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'd'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE ' ' END AS fault,
  left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS pair FROM o),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
ins(f, k, t) AS (VALUES ('F', 0, 'F'), ('S', 0, 'S'), ('U', 0, 'U'), ('A', 0, 'A'), ('F', 1, 'A'), ('F', 2, 'U'), ('S', 1, 'A'), ('S', 2, 'U'),
  ('U', 1, 'A'), ('A', 1, 'U')),
op(f, op, i, price, t) AS (VALUES ('F', 'D', NULL, 2, 'F'), ('S', 'D', NULL, 2, 'S'), ('U', 'D', NULL, 2, 'U'), ('A', 'D', NULL, 2, 'A'),
  ('F', 'K', 's', 0, 'S'), ('F', 'K', 'u', 0, 'A'), ('S', 'K', 'u', 0, 'A'), ('U', 'K', 'u', 0, 'A'), ('A', 'K', 'a', 0, 'U'),
  ('F', 'R', NULL, 1, 'A'), ('S', 'R', NULL, 1, 'A'), ('U', 'R', NULL, 1, 'A'), ('A', 'R', NULL, 1, 'U')),
dp(conv_id, rn, state, best) AS (
  SELECT conv_id, 0::BIGINT, 'F', {'cost': 0::BIGINT, 'audit': ''} FROM g
  UNION ALL
  SELECT dp.conv_id, dp.rn + 1, op.t, min({'cost': (best.cost + 5 * ins.k + op.price + CASE WHEN op.op <> 'D' AND fault = 't' THEN 5 ELSE 0 END)::BIGINT,
    'audit': best.audit || repeat('I', ins.k) || op.op})
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.rn = dp.rn + 1 JOIN ins ON ins.f = dp.state
  JOIN op ON op.f = ins.t AND (op.op = 'D' OR fault NOT IN ('b', 'd')) AND (op.i IS NULL OR op.i = r.i) GROUP BY ALL),
e AS (SELECT g.conv_id, min({'cost': best.cost + CASE state WHEN 'A' THEN 5 WHEN 'S' THEN 10 ELSE 0 END,
    'audit': best.audit || CASE state WHEN 'A' THEN 'I' WHEN 'S' THEN 'II' ELSE '' END}) AS best
  FROM g JOIN dp ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.rn = g.n GROUP BY 1),
p AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS pos FROM e),
q AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS rn, sum((edit <> 'D')::INT) OVER w AS j,
  sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id) AS m FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
f AS (SELECT q.conv_id, string_agg(CASE WHEN edit = 'K' THEN r.role WHEN (m - j) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY pos) AS lines
  FROM q LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.rn = q.rn WHERE edit <> 'D' GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id"""


@register("op11_conversations", _OP11_SQL)
def op11_conversations(spark, sf_dir):
    """All conversations, damaged as planted and repaired to alternating turns."""
    from .conversations import repair_report
    return repair_report(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").withColumnRenamed(
        "conv", "conv_id")


_OP12_SQL = r"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, w FROM (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'),
    lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
f AS (SELECT lang, g, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2),
    lambda i: w[i:i + k - 1])) AS g FROM p, range(1, 6) AS t(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, g, a, array_to_string(g, ' ') AS phrase FROM f WHERE len(g) > 1),
u AS (SELECT lang, unnest([g[:-2], g[2:]]) AS g, a FROM c),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, g, max(a) AS most FROM u GROUP BY ALL) m ON m.lang = c.lang AND m.g = c.g
  WHERE most IS NULL OR most < c.a),
cut AS (SELECT kept.*, unnest(range(1, len(g))) AS k FROM kept),
s AS (SELECT cut.lang, phrase, cut.a, x.a AS l, y.a AS r, n.n, k, (1000::HUGEINT * cut.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[:k] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[k + 1:]
  JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  score::BIGINT AS score FROM b QUALIFY rank <= 2000"""


@register("op12_collocations", _OP12_SQL)
def op12_collocations(spark, sf_dir):
    """The best phrases of two to five words of each language, over all documents."""
    from .collocations import collocations
    return collocations(table(spark, sf_dir, "documents"), "text", "lang", least=100, longest=5, share=100, top=2000)


@register("op13_quality")
def op13_quality(spark, sf_dir):
    """Quality of all documents; learns from labels outside the held-out fifth."""
    from .quality_ranking import rank_documents
    out = rank_documents(table(spark, sf_dir, "documents"), "doc_id", "text",
                         table(spark, sf_dir, "labels").where(~held_out(0, 5)), "doc_id", "quality", cut=0.3)
    return out.withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out(0, 5).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))

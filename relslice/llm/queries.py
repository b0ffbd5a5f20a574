"""The queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat, embedding_dedup, langid, merkle, multiset_hash, packing, quality, simhash, spelling, substring_dedup, token_file, toxicity
from .common import read


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = rows.unionByName(more).select("conv_id", "turn", "role", chat.text_parts("text").alias("parts"))
    return chat.read_back(chat.format_turns(turns))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(read(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.read_tokens(token_file.write_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_bpe_round_trip, op3_chat_format, op4_substring_dedup, op5_embedding_dedup, op6_multiset_hash, op7_token_file, op8_simhash, op9_packing, op10_quality, op11_merkle, op12_toxicity, op13_spelling)}


#: Digests of the turns, and of the text under the loss mask, straight from the table; the template's length is counted.
OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(replace(replace(replace(role || text, '\', '\\'), '<', '\<'), '[', '\[')) + length('<s>[INST][/INST]</s>') AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

#: All windows of 50 words as text.
OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS said FROM v),
f AS (SELECT said, min(doc_id) AS first FROM k GROUP BY said),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f ON f.said = k.said WHERE first < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
m AS (SELECT p.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN m ON m.doc_id = w.doc_id"""

#: All pairs.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def _sized(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


#: CRC-32 of the digits of doc_id, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"
_LEAF = f"sha256({_sized('doc_id')} || {_sized('source')} || {_sized('lang')} || {{}} || {_sized('text')})"

#: Whole trees, level by level; folding goes up one step of every path at a time.
OP11_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {_LEAF.format(_sized('n_chars'))} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(_sized('(n_chars + 1)'))} END AS tampered FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t(lang, lvl, pos, h, n) AS (SELECT lang, 0, pos, leaf, n FROM k UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, h, n) AS (SELECT 0, pos, subroot, n FROM s UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
g AS (SELECT DISTINCT lang, lvl FROM t WHERE n > 1), v AS (SELECT DISTINCT lvl FROM u WHERE n > 1),
a AS (SELECT k.lang, k.pos, g.lvl, t.h, k.pos >> g.lvl & 1 AS odd FROM k JOIN g ON g.lang IS NOT DISTINCT FROM k.lang LEFT JOIN t ON t.lang IS NOT DISTINCT FROM k.lang AND t.lvl = g.lvl AND t.pos = xor(k.pos >> g.lvl, 1)
  UNION ALL SELECT k.lang, k.pos, 100 + v.lvl, u.h, s.pos >> v.lvl & 1 FROM k JOIN s ON s.lang IS NOT DISTINCT FROM k.lang CROSS JOIN v LEFT JOIN u ON u.lvl = v.lvl AND u.pos = xor(s.pos >> v.lvl, 1)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, pos ORDER BY lvl) AS step, count(*) OVER (PARTITION BY lang, pos) AS steps FROM a),
f(lang, pos, step, h) AS (SELECT lang, pos, 0, coalesce(tampered, leaf) FROM k
  UNION ALL SELECT f.lang, f.pos, f.step + 1, sha256(CASE WHEN p.h IS NULL THEN f.h WHEN odd = 1 THEN p.h || f.h ELSE f.h || p.h END) FROM f JOIN p ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos AND p.step = f.step + 1),
w AS (SELECT lang, pos, arg_max(h, step) AS folded FROM f GROUP BY lang, pos), q AS (SELECT lang, pos, string_agg(h, '' ORDER BY lvl) AS said FROM a GROUP BY lang, pos),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT k.doc_id, k.leaf, s.subroot, r.root, sha256(coalesce(q.said, '')) AS proof_sha256, w.folded AS folded_root, w.folded = r.root AS verified
FROM k CROSS JOIN r JOIN s ON s.lang IS NOT DISTINCT FROM k.lang JOIN w ON w.lang IS NOT DISTINCT FROM k.lang AND w.pos = k.pos LEFT JOIN q ON q.lang IS NOT DISTINCT FROM k.lang AND q.pos = k.pos"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, XXH64 and trained models are beyond SQL; tests/llm holds the other queries against brute force."""
    return {"op3_chat_format": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op11_merkle": OP11_SQL}

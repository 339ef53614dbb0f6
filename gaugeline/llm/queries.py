"""The registered queries of the corpus operators and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import ann, chat, ctw, langid, mixing, pieces, quality, warc
from gaugeline.llm._split import bucket
from gaugeline.llm.decontaminate import find_contamination
from gaugeline.llm.minhash import near_duplicates
from gaugeline.llm.resample import resample
from gaugeline.llm.suffix_dedup import remove_repeats
from gaugeline.llm.trie import prefix_trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation of op1 whose texts are made of control strings.
_CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(turns.unionByName(extra))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, _table(spark, sf_dir, "documents"), length=200)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, _table(spark, sf_dir, "documents"), shingle_words=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(spark, _table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "mix_weight", "keep_probability", "sampled")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort(F.col("matches.item")).alias("item_ids"), F.array_max("matches.similarity").alias("best"))


def op6_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, _table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op7_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctw.score(spark, _table(spark, sf_dir, "documents"), bucket("doc_id", 10) != 0).withColumnRenamed("id", "doc_id")
    # a row without an id is neither learned from nor set aside by the rule
    return out.withColumn("held_out", F.coalesce(bucket("doc_id", 10) == 0, F.lit(False)))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    back, _ = warc.archive_pages(spark, _table(spark, sf_dir, "pages"), least=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels.where(F.coalesce(bucket("doc_id", 5) != 0, F.lit(False))))
    out = quality.score(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.learned_rows()))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie(spark, _table(spark, sf_dir, "conversations"), share=(20, 4))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_OP1_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT body, max(page_id) AS last FROM p GROUP BY body)
SELECT page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN m ON p.body = m.body
"""

#: CRC-32 of a string column, by half bytes of its UTF-8; the sixteen numbers are the register after each of them (fixed values).
_CRC32 = """xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 2 * strlen({0})), lambda k: CAST(('0x' || hex(encode({0}))[k + 2 - 2 * (k % 2)]) AS BIGINT))),
    lambda a, b: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, b) & 15) + 1], a >> 4)), 4294967295)"""


_OP11_SQL = f"""
WITH raw AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM raw)),
head AS (SELECT conv_id, max(pos) AS n FROM raw GROUP BY conv_id),
turns AS (
  SELECT c.conv_id, r.pos AS place, r.role, r.text FROM convs c JOIN raw r ON r.conv_id = c.conv_id - c.conv_id % 20 WHERE r.pos <= c.h
  UNION ALL SELECT c.conv_id, r.pos + 1000000000, r.role, r.text FROM convs c JOIN raw r ON r.conv_id = c.conv_id WHERE r.pos > c.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM turns),
path AS (
  SELECT conv_id, depth, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
    length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM numbered
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM convs),
n AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM path GROUP BY node),
up AS (SELECT n.*, p.node AS parent FROM n LEFT JOIN path p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent),
sub AS (
  SELECT p.node, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE k.parent IS NULL) AS n_leaves
  FROM n JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.parent = n.node GROUP BY p.node),
ends AS (
  SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, par.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM up n LEFT JOIN n par ON par.node = n.parent LEFT JOIN kids k ON k.parent = n.node JOIN sub s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""


_OP13_SQL = f"""
WITH w AS (
  SELECT 0 AS kind, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
  UNION ALL SELECT 1, -1 - row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (
  SELECT kind, rid, unnest(ws) AS feature FROM w
  UNION ALL SELECT kind, rid, unnest(list_transform(range(1, length(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
c AS (SELECT kind, rid, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT feature, CAST({_CRC32.format("feature")} % 10000 AS INT) AS bucket FROM (SELECT DISTINCT feature FROM c)),
g AS (
  SELECT bucket, sum(n) FILTER (WHERE kind = 0) AS s, sum(n) FILTER (WHERE kind = 1) AS t FROM c JOIN b USING (feature) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM g),
gain AS (
  SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS v FROM g, totals),
d AS (SELECT rid, sum(n) AS n_features, CAST(floor(sum(n * v) / sum(n)) AS BIGINT) AS weight FROM c JOIN b USING (feature) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY rid),
scored AS (
  SELECT w.rid, w.doc_id, length(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN d ON d.rid = w.rid WHERE kind = 0),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.rank <= 25 * r.n // 100 THEN r.rank END AS rank FROM scored s LEFT JOIN r ON r.rid = s.rid
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_mixing": op4_mixing,
        "op5_decontamination": op5_decontamination,
        "op6_multi_index_search": op6_multi_index_search,
        "op7_context_tree_scoring": op7_context_tree_scoring,
        "op8_warc_index": op8_warc_index,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_language_id": op10_language_id,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_importance_resampling": op13_importance_resampling,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _OP1_SQL, "op8_warc_index": _OP8_SQL, "op11_prefix_trie": _OP11_SQL, "op13_importance_resampling": _OP13_SQL}

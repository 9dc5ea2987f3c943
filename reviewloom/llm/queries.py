"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import table

TOKENIZER = "word_bpe_49k.json"
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary file is; every worker opens it there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and set size of every document. Null and wordless texts have no shingles and stand alone; repeated rows
    come each, linked; an empty table gives no rows."""
    from reviewloom.llm import ngram_join

    return ngram_join.similar_components(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation read back from its formatted string. Null texts and roles are empty, ties go by role and text,
    rows without a conversation are one of their own; an empty table leaves the added conversation."""
    from reviewloom.llm import chat

    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))
    chats = chat.format_chats(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "learned", chat.loss_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document. Null and empty texts score as texts without words; repeated rows score alike; without
    labels of both classes all scores are the same low one; an empty table gives no rows."""
    from reviewloom.llm import toxicity

    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document. Null texts stay null (null hash), empty ones empty; repeated rows are treated alike;
    an empty table gives no rows."""
    from reviewloom.llm import line_dedup

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(documents).select(
        "doc_id", F.col("dropped_lines").cast("long"), F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"))


def op5_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each query found. Null, empty, zero and non-finite vectors take no part; ties go to the smaller
    id; repeated rows count once; an empty table gives no rows."""
    from reviewloom.llm import ann

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))


def op6_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document. A null id has a place like any other; repeated rows share theirs; an empty table
    gives no rows."""
    from reviewloom.llm import sharding

    documents = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(documents, "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place. Null text is empty: the end mark alone; repeated rows are packed each;
    an empty table gives no rows."""
    from reviewloom.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. Null and empty texts have no words and fail; repeated rows get equal
    verdicts; without labels nothing but the base rules fails; an empty table gives no rows."""
    from reviewloom.llm import quality

    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. ``und`` where the text is null or has no letter, and without any label; ties go to the
    smaller name; repeated rows get equal results; an empty table gives no rows."""
    from reviewloom.llm import langid

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(documents, langid.train(documents))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document. Null texts have size 0; a null source comes last; repeated rows are documents
    of their own; an empty table gives no rows."""
    from reviewloom.llm import mixing

    used, sources = mixing.mix_sources(table(spark, sf_dir, "documents"))
    name = F.get("pattern", F.lit(0))
    return used.withColumn("name", name).join(
        sources, F.col("name").eqNullSafe(F.col("source"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("repeats") * F.col("size")).cast("long").alias("taken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations. Turns go by (turn, digest); null roles and texts are empty, rows
    without a conversation are left out, repeated rows are repeated turns, no conversations give no nodes."""
    from reviewloom.llm import trie

    nodes, ends = trie.prefix_trie(*trie.with_shared_heads(trie.turn_ids(table(spark, sf_dir, "conversations"))))
    return trie.with_ends(nodes, ends).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with weight, score and rank. Null texts have no words; a null id is hashed as empty text and
    loses ties; repeated rows are drawn one by one; empty tables give no rows or no target counts."""
    from reviewloom.llm import importance

    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the places of license wording. Null texts have no words; repeated rows stay."""
    from reviewloom.llm import licenses

    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_chat_format, op3_toxicity, op4_line_dedup, op5_graph_ann, op6_maglev_sharding, op7_best_fit_packing, op8_quality_rules, op9_language_id, op10_source_mixing, op11_prefix_trie,
                                        op12_importance_resampling, op13_license_scan)}

_ESCAPED = r"replace(replace(replace(coalesce({}, ''), '\', '\\'), '#', '\#'), '</', '<\/')"

ORACLE = {
    "op1_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words
), items AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM met JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
  WHERE 100 * common >= 75 * (len(p.s) + len(q.s) - common)
), ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x
)
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS component_id FROM sets d""",
    "op2_chat_format": rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before FROM said
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length({_ESCAPED.format('text')}) + 7 + CASE WHEN before IS NULL OR before <> role
    THEN length(replace({_ESCAPED.format('role')}, ':', '\:')) + 6 + (pos > 1)::INT ELSE 0 END AS chars FROM placed
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 of UTF-8 strings: a table of 256 entries by the rule, then one step a byte.
_CRC_TABLE = """step AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS crc_table FROM step WHERE k = 8)"""
_CRC = """xor(list_reduce([4294967295] || [('0x' || hex(encode({0}))[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, octet_length(encode({0})) + 1)],
    lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)"""

ORACLE["op11_prefix_trie"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, said AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 5 AS base, {_CRC.format('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT c FROM said), crc
), mixed AS (
  SELECT v.c, 0 AS part, s.pos, s.role, s.text FROM convs v JOIN said s ON s.c = v.base AND s.pos <= v.h
  UNION ALL SELECT v.c, 1, s.pos, s.role, s.text FROM convs v JOIN said s ON s.c = v.c AND s.pos > v.h
), turns AS (
  SELECT c, text, length(role) || ':' || length(text) || ':' || role || text AS said,
    row_number() OVER (PARTITION BY c ORDER BY part, pos) AS pos FROM mixed
), prefixes AS (
  SELECT c, pos AS depth, text, string_agg(md5(said), '') OVER (PARTITION BY c ORDER BY pos) AS path FROM turns
  UNION ALL SELECT c, 0, '', '' FROM convs
), nodes AS MATERIALIZED (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * octet_length(encode(min(text))) AS saved
  FROM prefixes GROUP BY path, depth
), tree AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children FROM nodes n
  LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, -32)
  LEFT JOIN (SELECT left(path, -32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1) k ON k.path = n.path
), below AS (
  SELECT t.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM tree t JOIN (SELECT tree.*, unnest([left(path, 32 * i) FOR i IN range(0, depth + 1)]) AS above FROM tree) u ON u.above = t.path GROUP BY t.path
), ends AS (
  SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (
    SELECT c, path, row_number() OVER (PARTITION BY c ORDER BY depth DESC) AS k FROM prefixes) WHERE k = 1 GROUP BY path
)
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs,
  n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM tree JOIN below USING (path) LEFT JOIN ends USING (path)"""

_FEATURES = """SELECT {0}, unnest(w) AS f FROM {1} UNION ALL SELECT {0}, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM {1}
  UNION ALL SELECT {0}, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM {1}"""

ORACLE["op12_importance_resampling"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, docs AS (SELECT doc_id, {_WORDS} AS w FROM documents
), goals AS (SELECT 1 AS one, {_WORDS} AS w FROM benchmark
), mine AS ({_FEATURES.format('doc_id', 'docs')}
), theirs AS ({_FEATURES.format('one', 'goals')}
), seen AS (SELECT f, {_CRC.format('f')} % 10000 AS bucket FROM (SELECT f FROM mine UNION SELECT f FROM theirs), crc
), counted AS (SELECT doc_id, bucket, count(*) AS n FROM mine JOIN seen USING (f) GROUP BY ALL
), source AS (SELECT bucket, sum(n) AS s FROM counted GROUP BY ALL
), goal AS (SELECT bucket, count(*) AS t FROM theirs JOIN seen USING (f) GROUP BY ALL
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM goal) + 10000)::DOUBLE)))::BIGINT AS g FROM source LEFT JOIN goal USING (bucket)
), weighed AS (SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight FROM counted JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
    + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (doc_id)
), placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (
  SELECT * FROM placed WHERE rank <= (SELECT count(*) * 5 // 100 FROM placed)) USING (doc_id)"""


def _license_oracle() -> str:
    """Places of the base phrases word by word; the other wording as regular expressions over the joined words."""
    from reviewloom.llm import licenses

    places, base, every, sure = [], [], [], []
    for t in licenses.BASE:
        said = t.wording.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(said))
        places.append(f"[i - 1 FOR i IN range(1, len(w) - {len(said) - 2}) IF {same}]")
        base.append(f"CASE WHEN len({places[-1]}) > 0 THEN '{t.label}' END")
    for t in licenses.BASE + licenses.NOTICES:
        accepted = f"regexp_matches(joined, '{licenses.as_regex(t.wording)}')"
        every.append(f"CASE WHEN {accepted} THEN '{t.label}' END")
        sure.append(f"CASE WHEN {accepted} THEN 1 - 1::DOUBLE / (1 + {licenses.mandatory(licenses.parse(t.wording))}) END")

    def joined(labels):
        return f"array_to_string(list_sort(list_distinct([{', '.join(labels)}])), ',')"

    return rf"""
WITH said AS (SELECT doc_id, {_WORDS} AS w FROM documents
), found AS (SELECT *, list_transform(w, lambda x: ' ' || x) AS spaced, {' || '.join(places)} AS places FROM said
), joined AS (SELECT *, array_to_string(spaced, '') AS joined FROM found)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  {joined(base)} AS base_labels, {joined(every)} AS labels, coalesce(greatest({', '.join(sure)}), 0) AS score FROM joined"""


ORACLE["op13_license_scan"] = _license_oracle()

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import centroids, chat_format, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, line_dedup, packing, quality_cnn, secret_scan, spelling, toxicity
from .common import table
from .queries_common import held_out, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_cnn.fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality_cnn.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = language_id.fit(docs.where(~held_out()))
    found = language_id.identify(docs, models)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op2_line_dedup"] = r"""
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS piece, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (SELECT *, trim(piece, ' ') AS line FROM pieces),
wide AS (SELECT line FROM keyed WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= 10),
first AS (SELECT line, min((doc_id, pos)) AS f FROM keyed WHERE line IN (SELECT line FROM wide) GROUP BY line),
marked AS (SELECT k.*, f.f IS NOT NULL AND (k.doc_id, k.pos) <> f.f AS gone FROM keyed k LEFT JOIN first f ON f.line = k.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  coalesce(string_agg(piece, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id
"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("doc", "doc_id")


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op5_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
groups AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.x = g.vec_id)::BIGINT AS n_links, g.component_id, g.vec_id = g.component_id AS kept FROM groups g
"""


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


#: Words as longest runs of ASCII letters, digits and non-ASCII characters; shingles of five; links from 0.8.
ORACLES["op6_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 10 * c >= 8 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x)
SELECT c.doc_id, c.class_id, (SELECT count(*) FROM both_ways b WHERE b.x = c.doc_id)::BIGINT AS n_links, c.doc_id = c.class_id AS kept FROM classes c
"""


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    # the contract's extra conversation, from literals
    added = F.inline(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(n).alias("turn"), F.lit(role).alias("role"), said.alias("text")) for n, role in enumerate(("user", "assistant"))]))
    return chat_format.chat_digests(chat_format.format_chats(turns.union(spark.range(1, numPartitions=1).select(added))))


ORACLES["op8_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), steps AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens,
    length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS shown, length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) AS shown_role FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown + CASE WHEN opens THEN 25 + shown_role ELSE 8 END)::BIGINT AS formatted_chars
FROM steps GROUP BY conv_id
"""


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "sentence_ids", F.array_join("licenses", ",").alias("licenses"), "n_rules")


def _license_sql() -> str:
    known = " ".join(f"WHEN s = '{wording}' THEN '{name}'" for name, wordings in license_scan.EXACT.items() for wording in wordings) + " "
    known += " ".join(f"WHEN regexp_full_match(s, '{pattern}') THEN '{name}'" for name, pattern in license_scan.SENTENCES.items())
    names = " ".join(f"WHEN '{sequence}' THEN '{name}'" for name, sequence in license_scan.RULES)
    longest_first = "|".join(sorted(dict.fromkeys(x for _, x in license_scan.RULES), key=len, reverse=True))
    return rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents
), parts AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
told AS (SELECT doc_id, pos, trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM parts),
known AS (SELECT doc_id, pos, CASE {known} END AS id FROM told),
sequences AS (SELECT doc_id, coalesce(string_agg(id, '' ORDER BY pos), '') AS sentence_ids FROM known GROUP BY doc_id),
hits AS (SELECT *, list_transform(regexp_extract_all(sentence_ids, '{longest_first}'), lambda x: CASE x {names} END) AS hit FROM sequences),
said AS (SELECT *, CASE WHEN len(list_filter(hit, lambda x: x <> 'proprietary')) > 0 THEN list_filter(hit, lambda x: x <> 'proprietary') ELSE hit END AS names FROM hits)
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(names)), ',') AS licenses, len(names)::BIGINT AS n_rules FROM said
"""


ORACLES["op10_license_scan"] = _license_sql()


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=97).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 byte by byte, by a table made from its polynomial; near words as neighbours under one deletion or one open place.
ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), several AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [195, ord(ch)::BIGINT - 64] END)) AS b FROM several
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM damaged GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, n, i, word[1:i - 1] AS head, word[i + 1:] AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.head || c.tail
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.head || c.tail
), best AS (SELECT x, count(*) AS n_near, arg_min(y, (-w.n, encode(y))) AS y, max(w.n) AS m FROM pairs JOIN words w ON w.word = y GROUP BY x),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * w.n THEN y END AS form, CASE WHEN m >= 2 * w.n THEN m END::BIGINT AS form_n FROM words w LEFT JOIN best ON x = w.word
), chain(word, place, ahead) AS (SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.ahead)
SELECT f.word, f.form, c.place AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.ahead IS NULL
"""


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.assigned(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clustering_sql(rounds: int = 10) -> str:
    """Each round as two common table expressions: assignment, then floors of exact means."""
    steps = []
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, min((list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c.k)) AS near FROM v, c{n} c GROUP BY vec_id)"
        )
        if n < rounds:
            steps.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM "
                f"(SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT near[2] AS k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{n}) GROUP BY k, i) GROUP BY k) m ON m.k = c.k)"
            )
    return rf"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS k, e FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
{", ".join(steps)},
found AS (SELECT vec_id, near[2] AS cluster, near[1] AS distance FROM a{rounds})
SELECT f.vec_id, f.cluster, f.distance, sum(f.distance) OVER (PARTITION BY f.cluster)::BIGINT AS cluster_inertia, sum(f.distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM found f JOIN c{rounds} c ON c.k = f.cluster
"""


ORACLES["op12_centroid_clustering"] = _clustering_sql()


def held_out_toxic(id_col: str = "doc_id"):
    """The fold that toxicity is not learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(~held_out_toxic()), table(spark, sf_dir, "labels").where(~held_out_toxic()))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out_toxic("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_windows", "n_toxic")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

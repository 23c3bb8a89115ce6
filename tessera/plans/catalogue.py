"""Named queries over the given tables, each with its DuckDB SQL where SQL can express it.

The tables stand in for the engine's own: documents are files (their source is the repository), embeddings the
vectors of the document with the same number, labels the rows indexed so far, pages give paths, conversations are
session turns and events are memories with a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import classify as C, text as T
from ..operators import blocks, chunks, documents, indexing, memory, paths as paths_index, points as P, rag, search as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


def file_path(id_: Column, source: Column) -> Column:
    return F.concat(source, F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in ("src", "docs", "tests", "config")]), (id_ % 4 + 1).cast("int")), F.lit("/file_"), id_.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".md", ".ts", ".json", ".sql")]), (id_ % 5 + 1).cast("int")))


FILE_SQL = "source || '/' || (['src','docs','tests','config'])[doc_id % 4 + 1] || '/file_' || doc_id || (['.py','.md','.ts','.json','.sql'])[doc_id % 5 + 1]"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: doc_id, repo, path, text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), file_path(F.col("doc_id"), F.col("source")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: id, repo, path, content_type, text, vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "docs").otherwise("code").alias("content_type"), "label")
    return vectors.join(files(spark, sf_dir), F.col("id") == F.col("doc_id")).drop("doc_id")


def scored(spark: SparkSession, sf_dir: str, payload: DataFrame | None = None) -> DataFrame:
    """id, content_type, label, score of the points, and the columns of ``payload`` (id, ...): vectors are scored where they are read and go no further."""
    kind = F.when(F.col("label") % 2 == 0, "docs").otherwise("code")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), kind.alias("content_type"), "label", S.score(F.col("embedding"), probe(spark, sf_dir)).alias("score"))
    if payload is not None:
        return rows.join(payload, "id")
    return rows.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first vector as the query: one row of one column comes to the driver."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return S.query_vector([float(x) for x in row.embedding])


FILES_SQL = f"files AS (SELECT doc_id, source AS repo, {FILE_SQL} AS path, coalesce(text, '') AS text FROM documents)"
POINTS_SQL = f"""{FILES_SQL}, points AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, CASE WHEN label % 2 = 0 THEN 'docs' ELSE 'code' END AS content_type, label, repo, path, text
  FROM embeddings JOIN files ON vec_id = doc_id
), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"""
#: An expression over a line or a text t, as the engine collapses white space.
COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


# --- search -----------------------------------------------------------------------------------------------------


def _distance_query(distance: str, expression: str, order: str) -> None:
    @query(f"topk_{distance}", f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS v FROM v WHERE vec_id = 0) SELECT vec_id AS id, round({expression}, 6) AS score FROM v, q ORDER BY {expression} {order}, vec_id LIMIT 10")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        return S.top_k(rows, probe(spark, sf_dir), 10, distance).select("id", F.round("score", 6).alias("score"))


for _name, _sql, _order in (
    ("cosine", "list_cosine_similarity(e, q.v)", "DESC"),
    ("dot", "list_inner_product(e, q.v)", "DESC"),
    ("euclid", "list_distance(e, q.v)", "ASC"),
    ("manhattan", "list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - q.v[i])))", "ASC"),
):
    _distance_query(_name, _sql, _order)


@query("topk_blocks", ORACLES["topk_cosine"])
def topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``topk_cosine`` over vectors stored in blocks: those that can't hold a hit are not read."""
    from ..sources import shared

    path = f"{shared.folder(spark)}/blocks-{uuid.uuid4().hex}"
    blocks.build(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path, 64)
    hits = blocks.top_k(spark, path, probe(spark, sf_dir), 10).hits
    return spark.createDataFrame([(r.id, r.score) for r in hits], "id long, score double").select("id", F.round("score", 6).alias("score"))


@query("topk_filtered", f"WITH {POINTS_SQL} SELECT id, path, round(list_cosine_similarity(vector, q.v), 6) AS score FROM points, q WHERE content_type = 'code' AND repo IN ('src1', 'src3', 'src5') AND starts_with(path, 'src') ORDER BY list_cosine_similarity(vector, q.v) DESC, id LIMIT 10")
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are scored where they are read; ids with scores meet the paths that the filter leaves."""
    wanted = S.payload_filter({"repo": ["src1", "src3", "src5"], "path_prefix": "src", "label": None})
    named = files(spark, sf_dir).select(F.col("doc_id").alias("id"), "repo", "path").where(wanted)
    hits = scored(spark, sf_dir, named).where(S.payload_filter({"content_type": "code"}))
    return S.best(hits, 10).select("id", "path", F.round("score", 6).alias("score"))


@query("path_match", f"WITH {FILES_SQL}, t AS (SELECT doc_id AS id, path, list_filter(regexp_split_to_array(lower(path), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM files) SELECT id, path FROM t WHERE list_contains(ts, 'docs') AND list_contains(ts, 'md')")
def path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose path holds two tokens, found by bitmaps."""
    rows = files(spark, sf_dir).select(F.col("doc_id").alias("id"), "path")
    return paths_index.holds(rows, paths_index.matched(paths_index.index(rows), "docs/*.md"))


@query("topk_min_score", f"WITH {POINTS_SQL}, best AS (SELECT id, list_cosine_similarity(vector, q.v) AS s FROM points, q ORDER BY s DESC, id LIMIT 20) SELECT id, round(s, 6) AS score FROM best WHERE s >= 0.35")
def topk_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best(scored(spark, sf_dir), 20, min_score=0.35).select("id", F.round("score", 6).alias("score"))


@query("topk_per_label", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS v FROM v WHERE vec_id = 0), r AS (SELECT vec_id AS id, label, list_cosine_similarity(e, q.v) AS s FROM v, q), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS rank FROM r) SELECT id, label, rank, round(s, 6) AS score FROM k WHERE rank <= 3")
def topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return S.top_k_by(rows, probe(spark, sf_dir), 3, "label").select("id", "label", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    "topk_batch",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY label, i),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS e FROM m GROUP BY label),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(v.e, q.e) AS s FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank FROM s)
SELECT query_id, rank, id, round(s, 6) AS score FROM r WHERE rank <= 10""",
)
def topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to the mean of each label's, all labels in one pass."""
    rows = table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector")).withColumnRenamed("label", "query_id")
    found = S.top_k_batch(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, 10)
    return found.withColumn("score", F.round("score", 6))


@query("collection_status", f"WITH {POINTS_SQL}, r AS (SELECT content_type AS collection, row_number() OVER (PARTITION BY content_type ORDER BY list_cosine_similarity(vector, q.v) DESC, id) AS n FROM points, q) SELECT collection, count(*)::INT AS hits, 'ok' AS status FROM r WHERE n <= 10 GROUP BY collection")
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the search of each collection went (without the times it took)."""
    rows = scored(spark, sf_dir)
    runs = {name: (lambda name=name: S.best(rows.where(F.col("content_type") == name), 10)) for name in ("code", "docs")}
    return S.search_collections(spark, runs).collections.select("collection", "hits", "status")


def fused_sql(k: int, floor: int) -> str:
    return f"""{POINTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY s DESC, id) AS rank FROM (SELECT points.*, list_cosine_similarity(vector, q.v) AS s FROM points, q)),
scored AS (SELECT *, 1.0::DOUBLE / (60 + rank) AS rrf, CASE content_type WHEN 'code' THEN 1 ELSE 2 END AS o FROM ranked WHERE rank <= {k}),
picked AS (SELECT * FROM scored ORDER BY CASE WHEN rank <= {min(max(floor, 1), k // 2)} THEN 0 ELSE 1 END, rrf DESC, o, rank LIMIT {k}),
fused AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, o, rank) AS position FROM picked)"""


def hybrid(spark: SparkSession, sf_dir: str, k: int, floor: int) -> DataFrame:
    """Ranked and fused by id and type alone; path and text of the hits are read afterwards."""
    return S.with_payload(fused(spark, sf_dir, k, floor), files(spark, sf_dir), "doc_id")


def fused(spark: SparkSession, sf_dir: str, k: int, floor: int) -> DataFrame:
    return S.fused(S.ranked_by(scored(spark, sf_dir), k, "content_type"), k, floor)


@query("rrf_hybrid", f"WITH {fused_sql(10, 1)} SELECT position, id, content_type, round(rrf, 9) AS rrf FROM fused")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, 10, 1).select(F.col("position").cast("long").alias("position"), "id", "content_type", F.round("rrf", 9).alias("rrf"))


@query("rrf_diversity_floor", f"WITH {fused_sql(7, 9)} SELECT position, id, content_type FROM fused")
def rrf_diversity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, 7, 9).select(F.col("position").cast("long").alias("position"), "id", "content_type")


@query("raw_score_merge", f"WITH {POINTS_SQL}, r AS (SELECT id, content_type, list_cosine_similarity(vector, q.v) AS s FROM points, q), k AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY s DESC, id) AS n FROM r) SELECT id, content_type, round(s, 6) AS score FROM k WHERE n <= 20 ORDER BY s DESC, content_type, id LIMIT 20")
def raw_score_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.ranked_by(scored(spark, sf_dir), 20, "content_type")
    return S.merged_by_score(hits, 20).select("id", "content_type", F.round("score", 6).alias("score"))


def _quota_sql(most: int, k: int) -> str:
    return f"WITH {fused_sql(20, 2)}, nth AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY position) AS n FROM fused) SELECT id, repo, position FROM nth WHERE n <= {most} ORDER BY position LIMIT {k}"


@query("scope_repo_quota", _quota_sql(3, 10))
def scope_repo_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quota(hybrid(spark, sf_dir, 20, 2), 3, 10, [F.asc("position")]).select("id", "repo", F.col("position").cast("long").alias("position"))


@query("ask_context_quota", _quota_sql(2, 5))
def ask_context_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quota(hybrid(spark, sf_dir, 20, 2), 2, 5, [F.asc("position")]).select("id", "repo", F.col("position").cast("long").alias("position"))


SNIPPET_SQL = f"CASE WHEN {COLLAPSED.format('text')} = '' THEN '(no snippet)' WHEN length({COLLAPSED.format('text')}) > 300 THEN rtrim(substr({COLLAPSED.format('text')}, 1, 297)) || '...' ELSE {COLLAPSED.format('text')} END"


@query("search_result_projection", f"WITH {FILES_SQL} SELECT repo, path, (doc_id % 100) / 100.0::DOUBLE AS score, CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 END::INT AS start_line, CASE WHEN doc_id % 7 > 0 AND doc_id % 11 >= doc_id % 7 THEN doc_id % 11 END::INT AS end_line, {SNIPPET_SQL} AS snippet, CASE WHEN path LIKE '%.md' OR path LIKE '%/docs/%' THEN 'docs' ELSE 'code' END AS content_type FROM files")
def search_result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = files(spark, sf_dir).select("repo", "path", "text", ((F.col("doc_id") % 100) / 100.0).alias("score"), (F.col("doc_id") % 7).alias("start_line"), (F.col("doc_id") % 11).cast("string").alias("endLine"), F.lit(None).cast("string").alias("content_type"))
    return S.result(hits)


@query("enriched_snippets", f"WITH {POINTS_SQL}, l AS (SELECT doc_id, {COLLAPSED.format("array_to_string((string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)))[2:4], chr(10))")} AS x FROM files WHERE doc_id % 3 <> 0) SELECT p.id, CASE WHEN p.id % 2 = 0 AND coalesce(x, '') <> '' THEN CASE WHEN length(x) > 300 THEN rtrim(substr(x, 1, 297)) || '...' ELSE x END ELSE 'own' END AS snippet FROM points p LEFT JOIN l ON l.doc_id = p.id")
def enriched_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file is missing, and every other hit has no range."""
    hits = points(spark, sf_dir).select("id", "repo", "path", F.when(F.col("id") % 2 == 0, 2).alias("start_line"), F.when(F.col("id") % 2 == 0, 4).alias("end_line"), F.lit("own").alias("snippet"))
    return S.enriched(hits, files(spark, sf_dir).where("doc_id % 3 <> 0")).select("id", "snippet")


@query("context_path_filter", f"WITH {FILES_SQL} SELECT doc_id, doc_id % 9 = 0 AS excluded FROM files")
def context_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth file lies in a cache or a virtual environment."""
    inside = F.when(F.col("doc_id") % 9 == 0, F.element_at(F.array(F.lit("x/.venv/"), F.lit("x/__pycache__/")), (F.col("doc_id") % 2 + 1).cast("int"))).otherwise(F.lit("x/"))
    return files(spark, sf_dir).select("doc_id", C.excluded_from_context(F.concat(inside, "path")).alias("excluded"))


@query("vector_validation", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", S.valid_vector(F.col("embedding"), 64).alias("valid"), F.round(S.norm(F.col("embedding")), 6).alias("norm"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: filter, exact scores, ranks per type, fusion with a floor, quota, result shape."""
    hits = S.quota(hybrid(spark, sf_dir, 20, 2), 3, 10, [F.asc("position")])
    return S.result(hits.withColumn("score", F.col("rrf"))).withColumn("score", F.round("score", 9))


query("hybrid_search", f"WITH {fused_sql(20, 2)}, nth AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY position) AS n FROM fused), kept AS (SELECT * FROM nth WHERE n <= 3 ORDER BY position LIMIT 10) SELECT repo, path, round(rrf, 9) AS score, NULL::INT AS start_line, NULL::INT AS end_line, {SNIPPET_SQL} AS snippet, content_type FROM kept")(hybrid_search)


# --- chunks and identity ----------------------------------------------------------------------------------------

LINES_SQL = f"{FILES_SQL}, l AS (SELECT *, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS ls FROM files)"


def windows_sql(size: int, overlap: int) -> str:
    return f"""{LINES_SQL}, s AS (SELECT doc_id, repo, path, ls, unnest(range(0, greatest(len(ls) - {overlap} - 1, 0) + 1, {size - overlap})) AS a FROM l WHERE len(ls) > 0),
w AS (SELECT doc_id, repo, path, (a // {size - overlap})::INT AS chunk_index, (a + 1)::INT AS start_line, least(a + {size}, len(ls))::INT AS end_line, array_to_string(ls[a + 1:least(a + {size}, len(ls))], chr(10)) AS content FROM s)"""


def window_chunks(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    return chunks.windows(files(spark, sf_dir), size, overlap)


@query("line_window_chunks", f"WITH {windows_sql(10, 2)} SELECT path, chunk_index, start_line, end_line, content FROM w")
def line_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_chunks(spark, sf_dir, 10, 2)


@query("line_window_defaults", f"WITH {windows_sql(120, 20)} SELECT path, chunk_index, start_line, end_line, length(content) AS chars FROM w")
def line_window_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_chunks(spark, sf_dir, 120, 20).select("path", "chunk_index", "start_line", "end_line", F.length("content").cast("long").alias("chars"))


LANGUAGE_SQL = "CASE regexp_extract(path, '(\\.[^.]+)$', 1) WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.ts' THEN 'typescript' WHEN '.json' THEN 'json' WHEN '.sql' THEN 'sql' ELSE 'text' END"


@query("chunk_identity", f"WITH {windows_sql(40, 5)} SELECT sha256(path || ':' || start_line || ':' || end_line || ':' || {LANGUAGE_SQL}) AS chunk_id, sha256(content) AS content_hash, path, start_line FROM w")
def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_chunks(spark, sf_dir, 40, 5)
    return found.select(T.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), C.language(F.col("path"))).alias("chunk_id"), T.content_hash(F.col("content")).alias("content_hash"), "path", "start_line")


FIRST_LINE_SQL = f"(list_filter(list_transform(string_split(content, chr(10)), lambda x: {COLLAPSED.format('x')}), lambda x: x <> ''))[1]"
RANGE_SQL = "CASE WHEN start_line = end_line THEN 'line ' || start_line ELSE 'lines ' || start_line || '-' || end_line END"


@query("chunk_summary_text", f"WITH {windows_sql(20, 4)}, f AS (SELECT *, {FIRST_LINE_SQL} AS f FROM w) SELECT path, start_line, concat_ws(' | ', path, {LANGUAGE_SQL}, {RANGE_SQL}, 'type=code_context', 'first_line=' || CASE WHEN length(f) > 120 THEN rtrim(substr(f, 1, 117)) || '...' ELSE f END) AS summary_text FROM f")
def chunk_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_chunks(spark, sf_dir, 20, 4)
    return found.select("path", "start_line", T.summary_text(F.col("path"), C.language(F.col("path")), F.col("start_line"), F.col("end_line"), F.lit("code_context"), F.col("content")).alias("summary_text"))


@query("chunk_context_text", f"WITH {windows_sql(20, 4)}, f AS (SELECT *, {COLLAPSED.format('content')} AS p FROM w) SELECT path, start_line, concat_ws(chr(10), 'Path: ' || path, 'Language: ' || {LANGUAGE_SQL}, 'Range: ' || {RANGE_SQL}, 'Type: code_context', 'Chunk strategy: line_window', CASE WHEN p <> '' THEN 'Preview: ' || CASE WHEN length(p) > 280 THEN rtrim(substr(p, 1, 277)) || '...' ELSE p END END) AS context_text FROM f")
def chunk_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_chunks(spark, sf_dir, 20, 4)
    return found.select("path", "start_line", T.context_text(F.col("path"), C.language(F.col("path")), F.col("start_line"), F.col("end_line"), F.lit("code_context"), F.lit("line_window"), F.col("content")).alias("context_text"))


@query("point_id_uuid5")
def point_id_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.point_id(F.col("repo"), F.concat(F.lit("/code/"), "repo"), F.col("doc_id").cast("string")).alias("point_id"))


ORACLES["point_id_uuid5"] = f"WITH {FILES_SQL}, h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(repo || ':/code/' || repo || ':' || doc_id)) AS h FROM files) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h"


@query("embedding_input_mode", f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE path || chr(10) || chr(10) || text END AS input FROM files")
def embedding_input_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir).withColumn("summary", F.when(F.col("doc_id") % 3 != 0, F.col("path")))
    return found.select("doc_id", T.embedding_input(F.col("text"), F.col("summary"), True).alias("input"))


@query("embed_batches", "SELECT source AS repo, count(*) AS rows, ceil(count(*) / 16.0)::BIGINT AS batches FROM documents GROUP BY source")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.batches(files(spark, sf_dir), "repo", 16)


@query("embedding_unseen", "WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL) SELECT DISTINCT content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels))")
def embedding_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that are left to embed once those of labelled documents are stored."""
    from ..sources import embedding

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").where("text IS NOT NULL").select(T.content_hash(F.col("text")).alias("content_hash"))
    return embedding.unseen(docs, known).select("content_hash")


@query(
    "paragraph_chunks",
    f"""WITH {FILES_SQL}, p AS (SELECT doc_id AS id, regexp_extract_all(replace(text, chr(10), chr(10) || chr(10)), '[^\\n]*\\n+|[^\\n]+') AS ps FROM files),
w AS (SELECT id, flatten(list_transform(ps, lambda p: list_transform(range(0, (length(p) - 1) // 300 + 1), lambda k: [substr(p, k * 300 + 1, 300)]))) AS ws FROM p WHERE len(ps) > 0),
r AS (SELECT id, list_reduce(ws, lambda acc, x: CASE WHEN length(acc[-1]) + length(x[1]) <= 300 THEN list_concat(acc[:len(acc) - 1], [acc[-1] || x[1]]) ELSE list_concat(acc, x) END) AS rs FROM w)
SELECT id, (generate_subscripts(rs, 1) - 1)::INT AS at, unnest(rs) AS piece FROM r""",
)
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.paragraphs(files(spark, sf_dir).select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("text")), 300)


# Texts of other kinds are made from the documents' lines: every fifth line becomes a heading, a key or a declaration.


def _shaped(spark: SparkSession, sf_dir: str, shape: Callable[[Column, Column], Column], head: str = "", tail: str = "") -> DataFrame:
    lines = F.transform(T.lines(F.col("text")), shape)
    return files(spark, sf_dir).select("path", F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit(tail)).alias("text"))


def _sections_sql(shape: str, opens: str, head: str = "", tail: str = "") -> str:
    """Chunks of shaped lines whose openings are told by a line (x), its number (n) and its neighbours (px, nx)."""
    return f"""WITH {LINES_SQL}, shaped AS (SELECT path, string_split({head}array_to_string(list_transform(ls, lambda x, i: {shape}), chr(10)){tail}, chr(10)) AS ls FROM l WHERE len(ls) > 0),
lines AS (SELECT path, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM shaped),
numbered AS (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM lines WINDOW w AS (PARTITION BY path ORDER BY n)),
marked AS (SELECT *, sum(CASE WHEN {opens} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS g FROM numbered),
full_ AS (SELECT path, g, min(n) AS a, max(n) AS b FROM marked WHERE regexp_matches(x, '\\S') GROUP BY path, g)
SELECT m.path, f.a::INT AS start_line, f.b::INT AS end_line, string_agg(m.x, chr(10) ORDER BY n) AS content FROM marked m JOIN full_ f ON f.path = m.path AND f.g = m.g AND n BETWEEN f.a AND f.b GROUP BY m.path, f.g, f.a, f.b"""


def _fifth(other: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.when(i % 5 == 0, other(x, i)).otherwise(x)


@query("markdown_sections", _sections_sql("CASE WHEN (i - 1) % 5 = 0 THEN '## ' || x ELSE x END", "regexp_matches(x, '^ {0,3}#{1,6}\\s+\\S')"))
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sections(_shaped(spark, sf_dir, _fifth(lambda x, i: F.concat(F.lit("## "), x))), chunks.markdown_headings)


@query("adoc_sections", _sections_sql("CASE WHEN (i - 1) % 5 = 0 THEN '== ' || x ELSE x END", "regexp_matches(x, '^\\s*={1,6}\\s+\\S')"))
def adoc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sections(_shaped(spark, sf_dir, _fifth(lambda x, i: F.concat(F.lit("== "), x))), chunks.adoc_headings)


_UNDER = "'^(?:" + "|".join(f"[{c}]{{3,}}" for c in ("=", "\\\\-", "~", "\\\\^", '"', "''", "`", ":", "#", "*", "+", ".", "<", ">", "_")) + ")$'"


@query("rst_sections", _sections_sql("CASE WHEN (i - 1) % 5 = 0 THEN x || chr(10) || repeat('=', greatest(length(x), 3)) ELSE x END", f"regexp_matches(x, '\\S') AND regexp_matches(rtrim(coalesce(nx, '')), {_UNDER}) AND length(rtrim(coalesce(nx, ''))) >= length(rtrim(x)) AND NOT regexp_matches(rtrim(x), {_UNDER})"))
def rst_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = _fifth(lambda x, i: F.concat(x, F.lit("\n"), F.repeat(F.lit("="), F.greatest(F.length(x), F.lit(3)))))
    return chunks.sections(_shaped(spark, sf_dir, shape), chunks.rst_headings)


@query("ini_sections", _sections_sql("CASE WHEN (i - 1) % 5 = 0 THEN '[part' || (i - 1) || ']' ELSE 'k' || (i - 1) || ' = ' || x END", "regexp_matches(x, '^\\s*\\[{1,2}[^\\[\\]]+\\]{1,2}\\s*$')"))
def ini_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("[part"), i.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("k"), i.cast("string"), F.lit(" = "), x))
    return chunks.sections(_shaped(spark, sf_dir, shape), chunks.ini_headings)


@query("yaml_blocks", _sections_sql("CASE WHEN (i - 1) % 5 = 0 THEN 'key' || (i - 1) || ':' ELSE '  - ' || x END", "regexp_matches(x, '^[^\\s#\\-].*:|^:')"))
def yaml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("key"), i.cast("string"), F.lit(":"))).otherwise(F.concat(F.lit("  - "), x))
    return chunks.sections(_shaped(spark, sf_dir, shape), chunks.yaml_keys)


@query("env_blocks", _sections_sql("CASE WHEN (i - 1) % 5 = 4 THEN '' ELSE 'K' || (i - 1) || '=' || x END", "regexp_matches(x, '\\S') AND n > 1 AND NOT regexp_matches(px, '\\S')"))
def env_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda x, i: F.when(i % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("K"), i.cast("string"), F.lit("="), x))
    return chunks.sections(_shaped(spark, sf_dir, shape), chunks.blank_separated)


@query("json_blocks")
def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda x, i: F.concat(F.lit('  "k'), i.cast("string"), F.lit('": {\n    "text": '), F.to_json(F.array(x)), F.lit("\n  },"))
    return chunks.sections(_shaped(spark, sf_dir, shape, "{\n", "\n}"), chunks.json_keys)


@query("sql_statements")
def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("-- note; on "), x)).when(i % 3 == 1, F.concat(F.lit("SELECT '"), F.replace(x, F.lit("'"), F.lit("''")), F.lit(";'\nFROM t;"))).otherwise(F.concat(F.lit("DO $x$ BEGIN\n"), F.replace(x, F.lit("$"), F.lit("")), F.lit(";\nEND $x$;")))
    return chunks.sections(_shaped(spark, sf_dir, shape), chunks.sql_statements)


def _word(x: Column) -> Column:
    """A name from a line: its first ASCII letters."""
    return F.concat(F.lit("f_"), F.lower(F.substring(F.regexp_replace(x, "[^A-Za-z]", ""), 1, 12)))


#: Pieces of code by line: heads over several lines, and strings and comments that look like code.
PYTHON_CLASS = """class C{0}(
    Base,
):
    \"\"\"def fake():
class Fake:
    \"\"\"

    def {1}(
        self, x,
    ):
        return self.helper("call(x)")

    def helper(self, x):
        return shared(x)
"""
PYTHON_FUNCTION = "def shared(x):\n    return str(x)\n"
SCRIPT_HOOK = "export const use{0} = useThing((a) => {{\n  const t = `function fake() {{`\n  return shared(a)\n}});\n"
SCRIPT_CARD = "export function Card{0}(\n  p: Props,\n) {{\n  return <div>{{useX(p)}}</div>\n}}\n"


def _filled(piece: str, *values: Column) -> Column:
    """A piece with columns in place of {0} and {1}."""
    marked = piece.format(*("\u0001" * len(values)))
    parts = marked.split("\u0001")
    return F.concat(F.lit(parts[0]), *[x for value, part in zip(values, parts[1:], strict=True) for x in (value, F.lit(part))])


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.lines(F.col("text"))
    shape = lambda x, i: F.when(i % 4 == 0, _filled(PYTHON_CLASS, i.cast("string"), _word(x))).when(i == 1, F.lit(PYTHON_FUNCTION)).otherwise(F.concat(F.lit("# "), x))
    return files(spark, sf_dir).where(F.size(lines) > 1).select("path", F.array_join(F.transform(lines, shape), "\n").alias("text"))


_WORD_SQL = "'f_' || lower(substr(regexp_replace(x, '[^A-Za-z]', '', 'g'), 1, 12))"


def _pieces_sql(sizes: str, least: int = 1) -> str:
    """s: each line's piece with its place (i, from 0), its source line (x) and the lines before it."""
    return f"""{LINES_SQL}, u AS (SELECT path, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM l WHERE len(ls) >= {least}), n AS (SELECT *, {sizes} AS n FROM u),
s AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY i) - n AS before FROM n)"""


_PYTHON_SQL = f"""{_pieces_sql("CASE WHEN i % 4 = 0 THEN 15 WHEN i = 1 THEN 3 ELSE 1 END", 2)}, y AS (
  SELECT path, 'C' || i AS qualified, 'class' AS kind, before + 1 AS a, before + 14 AS b, 'C' || i || '.helper,shared' AS callees, '' AS callers FROM s WHERE i % 4 = 0
  UNION ALL SELECT path, 'C' || i || '.' || {_WORD_SQL}, 'method', before + 8, before + 11, 'C' || i || '.helper', '' FROM s WHERE i % 4 = 0
  UNION ALL SELECT path, 'C' || i || '.helper', 'method', before + 13, before + 14, 'shared', 'C' || i || ',C' || i || '.' || {_WORD_SQL} FROM s WHERE i % 4 = 0
  UNION ALL SELECT path, 'shared', 'function', before + 1, before + 2, 'str', (SELECT string_agg('C' || t.i || ',C' || t.i || '.helper', ',' ORDER BY t.i) FROM s t WHERE t.path = s.path AND t.i % 4 = 0) FROM s WHERE i = 1
)"""


@query("python_symbols", f"WITH {_PYTHON_SQL} SELECT path, (row_number() OVER (PARTITION BY path ORDER BY a, b) - 1)::INT AS chunk_index, qualified, kind, a::INT AS start_line, b::INT AS end_line FROM y")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.numbered(chunks.symbols(python_files(spark, sf_dir), "python")).select("path", "chunk_index", "qualified", "kind", "start_line", "end_line")


@query("call_graph", f"WITH {_PYTHON_SQL} SELECT path, qualified, callees, callers FROM y")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.symbols(python_files(spark, sf_dir), "python").select("path", "symbol", "kind", "qualified", "parent", "start_line", "calls")
    return chunks.call_graph(found, chunks.dealt(files(spark, sf_dir))).select("path", "qualified", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


@query("sql_code_symbols", f"WITH {_PYTHON_SQL} SELECT path, qualified, a::INT AS start_line, b::INT AS end_line FROM y")
def sql_code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of ``python_symbols``, asked for in SQL."""
    from . import sql

    sql.register(spark)
    return spark.sql("SELECT f.path, s.qualified, s.start_line, s.end_line FROM {files} f, LATERAL code_symbols(f.text, 'python') s", files=python_files(spark, sf_dir))


_SCRIPT_SQL = f"""{_pieces_sql("CASE i % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 1 END")}
SELECT path, replace({_WORD_SQL}, 'f_', 'useF_') AS qualified, 'hook' AS kind, (before + 1)::INT AS start_line, (before + 4)::INT AS end_line, true AS exported FROM s WHERE i % 4 = 0
UNION ALL SELECT path, 'Card' || i, 'component', (before + 1)::INT, (before + 5)::INT, true FROM s WHERE i % 4 = 1"""


@query("script_symbols", f"WITH {_SCRIPT_SQL}")
def script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda x, i: F.when(i % 4 == 0, _filled(SCRIPT_HOOK, F.initcap(_word(x)))).when(i % 4 == 1, _filled(SCRIPT_CARD, i.cast("string"))).otherwise(F.concat(F.lit("// "), x))
    return chunks.symbols(_shaped(spark, sf_dir, shape), "typescript").select("path", "qualified", "kind", "start_line", "end_line", "exported")


# --- paths ------------------------------------------------------------------------------------------------------


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the documents' files and of the pages' addresses."""
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))
    return files(spark, sf_dir).select("path").unionByName(urls)


PATHS_SQL = f"{FILES_SQL}, paths AS (SELECT path FROM files UNION ALL SELECT regexp_replace(url, '^https?://|[?#].*$', '', 'g') FROM pages), p AS (SELECT path, '/' || trim(lower(replace(path, chr(92), '/')), '/') AS r, string_split(path, '/')[-1] AS name FROM paths), e AS (SELECT *, lower(regexp_extract(name, '.(\\.[^.]+)$', 1)) AS ext FROM p)"


def _any(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{x}')" for x in parts) + ")"


def _types_sql() -> str:
    from .. import config as K

    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    hint = "CASE " + " ".join(f"WHEN contains(r, '{h}') THEN '{h}'" for h in K.DOC_PATH_HINTS) + " END"
    test = f"({_any('r', K.TEST_PATH_MARKERS)} OR starts_with(lower(name), 'test_') OR {_any('lower(name)', K.TEST_FILE_MARKERS)})"
    stem = "regexp_replace(lower(name), '(.)\\.[^.]+$', '\\1')"
    conf = f"(lower(name) = '.env' OR ext IN ({listed(K.CONFIG_SUFFIXES)}) AND (lower(name) IN ({listed(K.CONFIG_FILE_NAMES)}) OR {_any(stem, K.CONFIG_STEM_MARKERS)} OR {_any('r', K.CONFIG_PATH_MARKERS)}))"
    return f"{PATHS_SQL}, c AS (SELECT *, {hint} AS hint, CASE WHEN {hint} IS NOT NULL OR ext IN ({listed(K.DOC_EXTENSIONS)}) THEN 'doc_section' WHEN {test} THEN 'test_case' WHEN ext = '.sql' THEN 'sql_block' WHEN {conf} THEN 'config_block' ELSE 'code_context' END AS kind FROM e)"


@query("classify_paths", f"WITH {_types_sql()} SELECT path, kind, hint, CASE kind WHEN 'doc_section' THEN 'docs' ELSE 'code' END AS collection FROM c")
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths(spark, sf_dir).withColumn("kind", C.content_type(F.col("path")))
    return found.select("path", "kind", C.doc_hint(F.col("path")).alias("hint"), C.collection(F.col("kind")).alias("collection"))


@query("detect_language", f"WITH {PATHS_SQL} SELECT path, ext, CASE ext WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.ts' THEN 'typescript' WHEN '.json' THEN 'json' WHEN '.sql' THEN 'sql' ELSE 'text' END AS language FROM e")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("path", T.suffix(F.col("path")).alias("ext"), C.language(F.col("path")).alias("language"))


@query("language_filter", f"WITH {PATHS_SQL} SELECT path FROM paths WHERE lower(path) LIKE '%.ts' OR lower(path) LIKE '%.tsx'")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).where(C.speaks(F.col("path"), "ts"))


@query("ignore_patterns")
def ignore_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("path", T.matches_any(F.col("path"), ["*/docs/*", "src1/*.json", "*file_[0-9]5.[a-z]*"]).alias("ignored"))


ORACLES["ignore_patterns"] = f"WITH {PATHS_SQL} SELECT path, path LIKE '%/docs/%' OR path LIKE 'src1/%.json' OR regexp_full_match(path, '.*file_[0-9]5\\.[a-z].*') AS ignored FROM paths"


@query("scan_stats", f"WITH {PATHS_SQL}, m AS (SELECT *, ext NOT IN ('.py', '.md', '.ts') AS bad_ext, path LIKE '%/tests/%' AS bad_pattern FROM e) SELECT count(*) AS seen, count(*) FILTER (bad_ext) AS ignored_ext, count(*) FILTER (NOT bad_ext AND bad_pattern) AS ignored_pattern, count(*) FILTER (NOT bad_ext AND NOT bad_pattern) AS kept FROM m")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import repository

    return repository.counts(repository.marked(paths(spark, sf_dir), extensions=(".py", ".md", ".ts"), patterns=["*/tests/*"])).select("seen", "ignored_ext", "ignored_pattern", "kept")


# --- the index run ------------------------------------------------------------------------------------------------


def _headed(text: Column) -> Column:
    """Every fifth line as a heading."""
    return F.array_join(F.transform(T.lines(text), _fifth(lambda x, i: F.concat(F.lit("## "), x))), "\n")


def _documents_sql(name: str, source: str) -> str:
    """CTE ``name`` (path, strategy, kind, start_line, end_line, content): chunks of the headed texts of ``source`` (path, text), which hold no code."""
    windows = "range(0, greatest(len(ls) - 5 - 1, 0) + 1, 35)"
    return f"""{name}_l AS (SELECT f.path, c.kind, CASE WHEN kind = 'doc_section' THEN 'doc_section' WHEN kind = 'config_block' THEN 'config_section' WHEN kind = 'sql_block' THEN 'sql_statement' WHEN c.ext = '.py' THEN 'python_symbol' WHEN c.ext = '.ts' THEN 'ts_symbol' ELSE 'line_window' END AS strategy,
  CASE WHEN f.text = '' THEN [] ELSE list_transform(string_split(regexp_replace(f.text, '\\n$', ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '## ' || x ELSE x END) END AS ls FROM ({source}) f JOIN (SELECT DISTINCT path, kind, ext FROM c) c USING (path)),
{name}_n AS (SELECT path, kind, strategy, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM {name}_l WHERE strategy <> 'line_window'),
{name}_m AS (SELECT *, sum(CASE WHEN strategy = 'doc_section' AND regexp_matches(x, '^ {{0,3}}#{{1,6}}\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS g FROM {name}_n),
{name}_e AS (SELECT path, g, min(n) AS a, max(n) AS b FROM {name}_m WHERE regexp_matches(x, '\\S') GROUP BY path, g),
{name} AS (SELECT m.path, m.strategy, m.kind, e.a::INT AS start_line, e.b::INT AS end_line, string_agg(m.x, chr(10) ORDER BY n) AS content FROM {name}_m m JOIN {name}_e e ON e.path = m.path AND e.g = m.g AND n BETWEEN e.a AND e.b GROUP BY m.path, m.strategy, m.kind, e.a, e.b
  UNION ALL SELECT path, strategy, kind, (a + 1)::INT, least(a + 40, len(ls))::INT, array_to_string(ls[a + 1:least(a + 40, len(ls))], chr(10)) FROM (SELECT *, unnest({windows}) AS a FROM {name}_l WHERE strategy = 'line_window' AND len(ls) > 0))"""


@query("chunk_documents", f"WITH {_types_sql()}, {_documents_sql('d', 'SELECT path, text FROM files')} SELECT path, strategy, kind AS content_type, start_line, end_line, sha256(content) AS content_hash FROM d")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file by the chunker that its path asks for."""
    rows = files(spark, sf_dir).withColumn("text", _headed(F.col("text")))
    return documents.chunk_files(rows, 40, 5).select("path", "strategy", "content_type", "start_line", "end_line", "content_hash")


def _index_run(spark: SparkSession, sf_dir: str) -> indexing.Indexed:
    """Two runs: the second finds a fifth of the files gone, half of the others longer by a line, and some unreadable."""
    from ..sources import shared

    rows = files(spark, sf_dir).withColumn("text", _headed(F.col("text")))
    none = spark.createDataFrame([], "id string, repo string, repo_root string, path string, content_type string, chunk_id string, content_hash string, start_line int, end_line int, text string, chunk_schema_version string")
    first = indexing.index(rows.where("doc_id % 3 <> 0"), none, "/code", size=40, overlap=5, keep=shared.stored).points
    plain = files(spark, sf_dir).where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new\n"), F.col("text"))).otherwise(F.col("text")))
    later = plain.withColumn("text", F.when(F.col("doc_id") % 50 != 1, _headed(F.col("text"))))
    return indexing.index(later, shared.stored(first), "/code", size=40, overlap=5, keep=shared.stored)


INDEX_SQL = f"{_types_sql()}, {_documents_sql('old', 'SELECT path, text FROM files WHERE doc_id % 3 <> 0 AND doc_id % 50 = 1 AND doc_id % 5 <> 0')}, {_documents_sql('new', 'SELECT path, CASE WHEN doc_id % 2 = 0 THEN ' + chr(39) + 'new' + chr(39) + ' || chr(10) || text ELSE text END AS text FROM files WHERE doc_id % 5 <> 0 AND doc_id % 50 <> 1')}, both_ AS (SELECT * FROM old UNION ALL SELECT * FROM new)"


@query("index_documents", f"WITH {INDEX_SQL} SELECT path, CASE kind WHEN 'doc_section' THEN 'docs' ELSE 'code' END AS content_type, sha256(path || ':' || start_line || ':' || end_line || ':' || {LANGUAGE_SQL}) AS chunk_id, sha256(content) AS content_hash FROM both_")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points after a second run: new chunks, and old ones of files that could not be read."""
    return _index_run(spark, sf_dir).points.select("path", "content_type", "chunk_id", "content_hash")


@query("index_file_log", f"WITH {_types_sql()} SELECT f.path, kind AS content_type, CASE WHEN doc_id % 50 = 1 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 50 = 1 THEN 'unreadable' END AS reason FROM files f JOIN (SELECT DISTINCT path, kind FROM c) c USING (path)")
def index_file_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file, whether it can be indexed or not."""
    rows = files(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 50 != 1, F.col("text")))
    return indexing.file_log(rows, 1_000_000).select("path", "content_type", "status", "reason")


# --- the point table --------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old rows, and new ones with repeated ids."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    old = rows.where("id % 3 <> 0").select("id", "label", F.lit("old").alias("state"))
    new = rows.where("id % 2 = 0").select("id", "label", F.col("id").alias("seq"))
    again = rows.where("id % 4 = 0").select("id", (F.col("label") + 100).alias("label"), (F.col("id") + 1_000_000).alias("seq"))
    return old, new.unionByName(again).withColumn("state", F.lit("new"))


@query("upsert_points", "SELECT vec_id AS id, label + CASE WHEN vec_id % 4 = 0 THEN 100 ELSE 0 END AS label, 'new' AS state FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label, 'old' FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 2 <> 0")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.upsert(*_stored(spark, sf_dir))


@query("delete_points", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def delete_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return P.delete(rows, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")))


@query("scroll_page", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 256")
def scroll_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), 100, 256)


@query("count_points", "SELECT label, count(*) AS n FROM embeddings WHERE label IN (1, 3, 5) GROUP BY label")
def count_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(S.payload_filter({"label": [1, 3, 5]})).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return rows.select("repo", F.when(F.col("doc_id") % 7 == 0, "docs").otherwise("code").alias("content_type"), F.when(F.col("doc_id") % 5 == 0, "v4").when(F.col("doc_id") % 5 < 4, "v5").alias("chunk_schema_version"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("/code/"), (F.col("doc_id") % 3).cast("string"))).alias("repo_root"))


VERSIONS_SQL = "v AS (SELECT source AS repo, CASE WHEN doc_id % 7 = 0 THEN 'docs' ELSE 'code' END AS content_type, CASE WHEN doc_id % 5 = 0 THEN 'v4' WHEN doc_id % 5 < 4 THEN 'v5' END AS version, CASE WHEN doc_id % 3 > 0 THEN '/code/' || doc_id % 3 END AS root FROM documents)"


@query("legacy_schema_count", f"WITH {VERSIONS_SQL} SELECT content_type, count(*) AS legacy FROM v WHERE version IS DISTINCT FROM 'v5' GROUP BY content_type")
def legacy_schema_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.legacy(_versions(spark, sf_dir), "v5")


@query("repo_collision", f"WITH {VERSIONS_SQL} SELECT content_type, count(*) AS colliding FROM v WHERE repo = 'src3' AND root IS DISTINCT FROM '/code/1' GROUP BY content_type")
def repo_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.collisions(_versions(spark, sf_dir), "src3", "/code/1")


@query("stale_cleanup", f"WITH {FILES_SQL}, x AS (SELECT doc_id AS id, CASE WHEN doc_id % 17 > 0 THEN path END AS path, CASE WHEN doc_id % 2 = 0 THEN 'docs' ELSE 'code' END AS content_type, 'c' || doc_id AS chunk_id FROM files), scanned AS (SELECT path FROM files WHERE doc_id % 5 <> 0), indexed AS (SELECT path FROM files JOIN labels USING (doc_id) WHERE doc_id % 5 <> 0), cur AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'code' WHEN doc_id % 2 = 0 THEN 'docs' ELSE 'code' END AS content_type, 'c' || doc_id AS chunk_id FROM files JOIN labels USING (doc_id)) SELECT id, path, content_type, chunk_id FROM x WHERE path IS NOT NULL AND (path NOT IN (SELECT path FROM scanned) OR path IN (SELECT path FROM indexed) AND (path, content_type, chunk_id) NOT IN (SELECT path, content_type, chunk_id FROM cur))")
def stale_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 2 == 0, "docs").otherwise("code")
    chunk = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    existing = found.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 17 > 0, F.col("path")).alias("path"), kind.alias("content_type"), chunk.alias("chunk_id"))
    done = found.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    current = done.select("path", F.when(F.col("doc_id") % 6 == 0, "code").otherwise(kind).alias("content_type"), chunk.alias("chunk_id"))
    return P.stale(existing, found.where("doc_id % 5 <> 0").select("path"), done.where("doc_id % 5 <> 0").select("path"), current)


@query("coverage_gate", "SELECT count(*) AS scanned, count(l.doc_id) AS indexed, round(count(l.doc_id) / count(*)::DOUBLE, 4) AS coverage, CASE WHEN count(*) = 0 THEN 'empty' WHEN round(count(l.doc_id) / count(*)::DOUBLE, 4) < 0.95 THEN 'insufficient_coverage' ELSE 'success' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir)
    return P.coverage(found.select("path"), found.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path"))


@query("chunks_by_type", f"WITH {_types_sql()} SELECT t.content_type, count(c.path) AS rows FROM (VALUES ('code'), ('docs')) t(content_type) LEFT JOIN c ON CASE kind WHEN 'doc_section' THEN 'docs' ELSE 'code' END = t.content_type GROUP BY t.content_type")
def chunks_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.by_type(paths(spark, sf_dir).select(C.collection(C.content_type(F.col("path"))).alias("content_type")))


@query("open_range", f"WITH {LINES_SQL} SELECT path, 3 AS start_line, (2 + len(ls[3:12]))::INT AS end_line, len(ls)::INT AS total_lines, array_to_string(ls[3:12], chr(10)) AS text, false AS truncated FROM l")
def open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.open_range(files(spark, sf_dir), 3, 12)


@query("open_range_bytes", f"WITH {LINES_SQL}, n AS (SELECT path, ls, list_transform(range(1, len(ls[1:20]) + 1), lambda i: strlen(array_to_string(ls[1:i], chr(10)))) AS sizes FROM l), k AS (SELECT *, len(list_filter(sizes, lambda s: s <= 400)) AS kept FROM n) SELECT path, 1 AS start_line, kept::INT AS end_line, CASE WHEN kept = len(sizes) THEN len(ls) END::INT AS total_lines, CASE WHEN kept = 0 THEN '' ELSE array_to_string(ls[1:kept], chr(10)) END AS text, kept < len(sizes) AS truncated FROM k")
def open_range_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.open_range(files(spark, sf_dir), 1, 20, most_bytes=400)


# --- conversations and memory -----------------------------------------------------------------------------------

PAIRS_SQL = "talk AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')), lagged AS (SELECT conv_id, turn, role, text AS assistant_text, lag(role) OVER w AS r, lag(text) OVER w AS user_text FROM talk WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (SELECT conv_id, turn, user_text, assistant_text FROM lagged WHERE role = 'assistant' AND r = 'user' AND user_text <> '')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("context_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def context_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.turn_pairs(turns(spark, sf_dir))


@query("context_budget", f"""WITH {PAIRS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM pairs), r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) - back + 1 AS i FROM b WHERE back <= 3),
x AS (SELECT *, '[Turno ' || i || ']' || chr(10) || 'Usuario: ' || user_text || chr(10) || 'Assistente: ' || assistant_text AS block FROM r), s AS (SELECT *, sum(length(block) + CASE WHEN back > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY back) <= 900 AS fits FROM x)
SELECT conv_id, CASE WHEN count(*) FILTER (fits) > 0 THEN string_agg(block, chr(10) || chr(10) ORDER BY i) FILTER (fits) ELSE max(CASE WHEN back = 1 THEN right(block, 900) END) END AS context, count(*) FILTER (fits) AS turns_used FROM s GROUP BY conv_id""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.context(memory.turn_pairs(turns(spark, sf_dir)), 3, 900)


@query("session_turns", "SELECT conv_id, turn, role FROM conversations WHERE conv_id < 5 ORDER BY conv_id, turn LIMIT 20")
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("conv_id < 5").orderBy("conv_id", "turn").limit(20).select("conv_id", "turn", "role")


@query("session_first_turns", "SELECT conv_id, turn, role, n FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations) WHERE n <= 20")
def session_first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns of every conversation, as many as a session lists."""
    return memory.first_turns(turns(spark, sf_dir), 20).select("conv_id", "turn", "role", "n")


NOW = "2024-03-01 00:00:00"
# The kind of memory that an event stands for.
KINDS = {"click": "preference", "view": "fact", "error": "convention"}


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as memories of their users: id, user_id, kind, topic, value, confidence, recent, reinforced."""
    rows = table(spark, sf_dir, "events")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("event_type")), F.lit("decision"))
    return rows.select(F.col("event_id").alias("id"), "user_id", kind.alias("kind"), F.col("event_type").alias("topic"), F.concat(F.lit("uses option "), F.col("props")).alias("value"), F.least(F.lit(1.0), F.col("value") / 20.0).alias("confidence"), F.col("ts").cast("timestamp").alias("recent"), (F.col("event_id") % 9).alias("reinforced"))


MEMORIES_SQL = f"m AS (SELECT event_id AS id, user_id, CASE event_type WHEN 'click' THEN 'preference' WHEN 'view' THEN 'fact' WHEN 'error' THEN 'convention' ELSE 'decision' END AS kind, event_type AS topic, 'uses option ' || props AS value, least(1.0, value / 20.0) AS confidence, ts AS recent, event_id % 9 AS reinforced FROM events), c AS (SELECT *, greatest(0.0, least(confidence * exp(-(CASE kind WHEN 'preference' THEN 0.08::DOUBLE WHEN 'fact' THEN 0.01::DOUBLE ELSE 0.03::DOUBLE END) * greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(recent), 0) / 86400000000.0::DOUBLE) * least(1.0::DOUBLE + reinforced * 0.08::DOUBLE, 1.6::DOUBLE), 1.0::DOUBLE)) AS effective FROM m)"


def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).withColumn("effective", memory.effective_confidence(F.col("confidence"), F.col("kind"), F.col("recent"), F.col("reinforced"), F.lit(NOW).cast("timestamp")))


@query("effective_confidence", f"WITH {MEMORIES_SQL} SELECT id, kind, round(effective, 4) AS effective FROM c")
def effective_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confident(spark, sf_dir).select("id", "kind", F.round("effective", 4).alias("effective"))


def _preload_sql(entries: int, tokens: int) -> str:
    """f: the entries of each user in order, with whether it is taken, and how many and what they cost so far."""
    return f"""WITH RECURSIVE {MEMORIES_SQL}, listed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recent DESC, id) AS nth FROM c),
r AS (SELECT *, greatest(1, round_even(len(list_filter(string_split_regex(concat_ws(': ', topic, value), '\\s+'), lambda x: x <> '')) * 1.15::DOUBLE, 0))::INT AS cost,
  row_number() OVER (PARTITION BY user_id ORDER BY effective DESC NULLS LAST, recent DESC, id) AS rank FROM listed WHERE nth <= 100),
f AS (SELECT user_id, rank, id, cost, true AS takes, cost AS used, 1 AS n FROM r WHERE rank = 1
  UNION ALL SELECT r.user_id, r.rank, r.id, r.cost, f.n < {entries} AND f.used + r.cost <= {tokens}, f.used + CASE WHEN f.n < {entries} AND f.used + r.cost <= {tokens} THEN r.cost ELSE 0 END,
    f.n + CASE WHEN f.n < {entries} AND f.used + r.cost <= {tokens} THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.rank = f.rank + 1)"""


@query("memory_preload", f"{_preload_sql(10, 60)} SELECT user_id, n AS position, id::VARCHAR AS id, cost AS tokens FROM f WHERE takes")
def memory_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.preload(confident(spark, sf_dir), ["user_id"], 10, 60)


@query("memory_preload_block", f"{_preload_sql(10, 60)} SELECT user_id, string_agg(printf('- %s/%s: %s (effective_confidence=%.2f)', kind, topic, value, effective), chr(10) ORDER BY n) AS block FROM f JOIN (SELECT id, kind, topic, value, effective FROM c) USING (id) WHERE takes GROUP BY user_id")
def memory_preload_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = confident(spark, sf_dir)
    picked = memory.preload(entries, ["user_id"], 10, 60)
    whole = entries.select(F.col("id").cast("string").alias("id"), "kind", "topic", "value", "effective")
    return memory.preload_lines(picked.join(whole, "id"), ["user_id"])


TOKENS_SQL = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-zA-Z0-9_]+'), lambda x: x <> ''))"


@query("lexical_similarity", f"WITH t AS (SELECT conv_id, turn, {TOKENS_SQL.format('text')} AS a, {TOKENS_SQL.format('prev')} AS b FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 6) AS similarity FROM t")
def lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns(spark, sf_dir).withColumn("prev", before).where("prev IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(T.jaccard(T.word_set(F.col("text")), T.word_set(F.col("prev"))), 6).alias("similarity"))


def _negated_sql(text: str) -> str:
    return "(" + " OR ".join("contains(' ' || lower({}) || ' ', '{}')".format(text, n.replace("'", "''")) for n in memory.NEGATIONS) + ")"


@query(
    "classify_conflict",
    f"""WITH {LINES_SQL}, u AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM l),
t AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'not ' ELSE '' END || regexp_replace(x, '\\s+\\S+$', '') AS y FROM u),
w AS (SELECT *, {TOKENS_SQL.format("x")} AS a, {TOKENS_SQL.format("y")} AS b FROM t),
s AS (SELECT *, len(list_intersect(a, b)) AS common, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END AS alike FROM w)
SELECT doc_id, i::INT AS "at", CASE WHEN alike >= 0.6::DOUBLE THEN CASE WHEN {_negated_sql("x")} <> {_negated_sql("y")} AND common >= 2 THEN 'contradiction' ELSE 'reinforcement' END WHEN alike >= 0.3::DOUBLE THEN 'complement' ELSE 'independent' END AS resolution FROM s""",
)
def classify_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document against the line before, half of them turned round."""
    lines = files(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "line"))
    shorter = F.regexp_replace("line", r"\s+\S+$", "")
    turned = F.when(F.col("at") % 2 == 0, F.concat(F.lit("not "), shorter)).otherwise(shorter)
    return lines.select("doc_id", "at", memory.conflict(F.col("line"), turned).alias("resolution"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    return rows.withColumn("active", F.col("id") % 4 != 0).withColumn("supersedes_entry_id", F.when((F.col("id") % 8 == 1) & (F.col("id") > 0), F.col("id") - 1)).withColumn("updated_at", F.col("recent"))


@query("memory_list_like", f"WITH {MEMORIES_SQL} SELECT id, topic, value FROM m WHERE id % 4 <> 0 AND user_id = 7 AND (lower(topic) LIKE '%vie%' OR lower(value) LIKE '%vie%') ORDER BY recent DESC, id LIMIT 50")
def memory_list_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.listed(_entries(spark, sf_dir), {"user_id": 7}, "vie").select("id", "topic", "value")


@query("memory_status", f"WITH {MEMORIES_SQL}, e AS (SELECT *, id % 4 <> 0 AS active, CASE WHEN id % 8 = 1 AND id > 0 THEN id - 1 END AS old FROM m) SELECT id, CASE WHEN active THEN 'active' WHEN id IN (SELECT old FROM e WHERE old IS NOT NULL) THEN 'superseded' ELSE 'disabled' END AS status FROM e")
def memory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.status(_entries(spark, sf_dir)).select("id", "status")


@query("memory_updates", f"WITH {MEMORIES_SQL}, e AS (SELECT *, id % 4 <> 0 AS active, CASE WHEN id % 12 = 0 THEN TIMESTAMP '2024-01-05' END AS disabled_at FROM m), d AS (SELECT *, active AND id % 5 = 0 AS gone FROM e) SELECT id, active AND NOT gone AS active, epoch_us(CASE WHEN gone THEN coalesce(disabled_at, TIMESTAMP '{NOW}') ELSE disabled_at END) AS disabled_us, CASE WHEN gone THEN 'forgotten' END AS disabled_reason, reinforced + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS times_reinforced, sha256(lower({COLLAPSED.format('value')})) AS value_hash FROM d")
def memory_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    rows = _entries(spark, sf_dir).withColumnRenamed("reinforced", "times_reinforced").withColumns({"disabled_at": F.when(F.col("id") % 12 == 0, F.lit("2024-01-05").cast("timestamp")), "disabled_reason": F.lit(None).cast("string"), "last_confirmed_at": none})
    found = memory.confirm(memory.disable(rows, F.col("id") % 5 == 0, now, "forgotten"), F.col("user_id") % 2 == 0, now)
    return found.select("id", "active", F.unix_micros("disabled_at").alias("disabled_us"), "disabled_reason", "times_reinforced", memory.value_hash(F.col("value")).alias("value_hash"))


def _managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with all that a store keeps of them."""
    return _entries(spark, sf_dir).withColumnRenamed("reinforced", "times_reinforced").withColumns({"last_confirmed_at": F.col("recent"), "disabled_at": F.lit(None).cast("timestamp"), "disabled_reason": F.lit(None).cast("string")})


_STATE_SQL = f"WITH {MEMORIES_SQL}, e AS (SELECT *, id % 4 <> 0 AS active, CASE WHEN id % 8 = 1 AND id > 0 THEN id - 1 END AS old FROM c)"


@query("memory_clear", f"{_STATE_SQL} SELECT id, active AND user_id IS DISTINCT FROM 7 AS active, CASE WHEN active AND user_id = 7 THEN 'manual_clear' END AS disabled_reason FROM e")
def memory_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.clear(_managed(spark, sf_dir), {"user_id": 7}, F.lit(NOW).cast("timestamp")).select("id", "active", "disabled_reason")


@query("memory_forget", f"{_STATE_SQL}, h AS (SELECT id FROM e WHERE active AND user_id = 7 AND (lower(topic) LIKE '%vie%' OR lower(value) LIKE '%vie%') ORDER BY recent DESC, id LIMIT 200) SELECT id, active AND id NOT IN (SELECT id FROM h) AS active, CASE WHEN id IN (SELECT id FROM h) THEN 'manual_forget' END AS disabled_reason FROM e")
def memory_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.forget(_managed(spark, sf_dir), {"user_id": 7}, "vie", F.lit(NOW).cast("timestamp")).select("id", "active", "disabled_reason")


@query("memory_explain", f"{_STATE_SQL}, u AS (SELECT * FROM e WHERE user_id = 7) SELECT id, topic, CASE WHEN active THEN 'active' WHEN id IN (SELECT old FROM u WHERE old IS NOT NULL) THEN 'superseded' ELSE 'disabled' END AS status, round(effective, 4) AS effective_confidence FROM u WHERE lower(topic) LIKE '%vie%' OR lower(value) LIKE '%vie%' ORDER BY recent DESC, id LIMIT 20")
def memory_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's entries on a term rest on, as many as an explanation shows."""
    found = memory.explain(_managed(spark, sf_dir), {"user_id": 7}, "vie", F.lit(NOW).cast("timestamp"))
    return found.select("id", "topic", "status", F.round("effective_confidence", 4).alias("effective_confidence"))


@query("memory_remember")
def memory_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a statement of its conversation, folded in order."""
    rows = turns(spark, sf_dir).where("role = 'user'")
    said = F.concat(F.when(F.col("turn") % 4 == 2, "not ").otherwise(""), T.collapsed(F.coalesce("text", F.lit(""))))
    statements = rows.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("preference").alias("kind"), F.lit("topic").alias("topic"), said.alias("value"), F.lit(0.8).alias("confidence"))
    return memory.reconcile(statements, ["conv_id"])


@query("memory_extract")
def memory_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with a statement's opening put before them."""
    rows = turns(spark, sf_dir).where("role = 'user'")
    openings = F.array(*[F.lit(x) for x in ("My name is ", "I prefer ", "I hate ", "always use ", "never use ", "")])
    said = F.concat(F.element_at(openings, (F.col("conv_id") % 6 + 1).cast("int")), F.coalesce("text", F.lit("")))
    return memory.extract(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), said.alias("text")))


# --- answers ----------------------------------------------------------------------------------------------------


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best code points for every label, with line ranges and snippets: label, position, path, ..."""
    hits = S.with_payload(S.ranked_by(scored(spark, sf_dir), 3, "label"), files(spark, sf_dir), "doc_id")
    return hits.select("label", F.col("rank").alias("position"), "path", F.when(F.col("id") % 2 == 0, F.lit(1)).alias("start_line"), F.when(F.col("id") % 2 == 0, F.lit(9)).alias("end_line"), S.snippet(F.col("text"), 80).alias("snippet"), F.concat(F.lit("what is "), F.col("label").cast("string")).alias("question"))


EVIDENCE_SQL = f"{POINTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(vector, q.v) DESC, id) AS position FROM points, q), e AS (SELECT label, position, path, CASE WHEN id % 2 = 0 THEN '(linhas 1-9)' ELSE '(linhas ?-?)' END AS ln, {SNIPPET_SQL.replace('300', '80').replace('297', '77')} AS snippet FROM r WHERE position <= 3)"


@query("grounded_answer", f"WITH {EVIDENCE_SQL} SELECT label, '{rag.GROUNDED_HEAD}' || chr(10) || chr(10) || string_agg('- ' || path || ' ' || ln || chr(10) || '```' || chr(10) || snippet || chr(10) || '```', chr(10) ORDER BY position) AS answer FROM e GROUP BY label")
def grounded_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.grounded_answer(_evidence(spark, sf_dir), "label")


@query("prompt_text", f"WITH {EVIDENCE_SQL} SELECT label, '## Contexto do codigo-fonte:' || chr(10) || chr(10) || string_agg('### Arquivo ' || position || ': ' || path || ' ' || ln || chr(10) || chr(10) || '```' || chr(10) || snippet || chr(10) || '```', chr(10) || chr(10) ORDER BY position) || chr(10) || chr(10) || '## Pergunta:' || chr(10) || 'what is ' || label || chr(10) || chr(10) || '## Resposta:' AS prompt FROM e GROUP BY label")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.prompt(_evidence(spark, sf_dir), "label", "question")


@query("answer_policy", f"WITH {EVIDENCE_SQL}, s AS (SELECT label, position, path, ln, snippet FROM e WHERE label < 5), a AS (SELECT label, count(*) AS n, '{rag.GROUNDED_HEAD}' || chr(10) || chr(10) || string_agg('- ' || path || ' ' || ln || chr(10) || '```' || chr(10) || snippet || chr(10) || '```', chr(10) ORDER BY position) AS answer FROM s GROUP BY label), l AS (SELECT DISTINCT label FROM embeddings) SELECT l.label, coalesce(n, 0) AS n_evidence, CASE WHEN n IS NULL THEN 'fallback' ELSE 'grounded' END AS kind, coalesce(answer, '{rag.NO_EVIDENCE}') AS answer FROM l LEFT JOIN a ON a.label = l.label")
def answer_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.answers(table(spark, sf_dir, "embeddings").select("label"), _evidence(spark, sf_dir).where("label < 5"), "label", grounded=True)


@query("search_result_blocks", f"WITH {fused_sql(10, 1)}, b AS (SELECT *, replace(CASE WHEN length({COLLAPSED.format('text')}) > 300 THEN rtrim(substr({COLLAPSED.format('text')}, 1, 297)) || '...' ELSE {COLLAPSED.format('text')} END, '\"', chr(39)) AS x FROM fused) SELECT position, '[' || position || '] score=' || printf('%.4f', s) || '  [' || repo || '] ' || path || ':1-' || coalesce((CASE WHEN id % 2 = 0 THEN 9 END)::VARCHAR, '?') || chr(10) || '    snippet: \"' || CASE WHEN x = '' THEN '(no text payload)' ELSE x END || '\"' AS block FROM b")
def search_result_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hybrid(spark, sf_dir, 10, 1)
    head = S.header(F.col("repo"), F.col("path"), F.lit(1), F.when(F.col("id") % 2 == 0, 9))
    return hits.select(F.col("position").cast("long").alias("position"), S.result_block(F.col("position"), F.col("score"), head, F.col("text")).alias("block"))


# --- embedding and streaming --------------------------------------------------------------------------------------


@query("embed_documents")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import embedding

    return embedding.embed(files(spark, sf_dir), embedding.HashingProvider(32), "doc_id")


@query("stream_ingest", f"WITH {windows_sql(60, 10)} SELECT path, start_line, end_line, sha256(content) AS content_hash FROM w")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the stream, then the table as it stands."""
    import uuid

    from ..sources import shared
    from ..streaming import ingest

    rows = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/documents.parquet*")
    source = stream.select(F.col("source").alias("repo"), file_path(F.col("doc_id"), F.col("source")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    place = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    ingest.ingest(source, f"{place}/table", f"{place}/checkpoint", 60, 10).awaitTermination()
    return ingest.current(spark, f"{place}/table").select("path", "start_line", "end_line", "content_hash")

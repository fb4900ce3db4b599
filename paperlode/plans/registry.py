"""Every registered query over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, fusion, index, lexical, ranking, vector
from ..sources.markdown import page_blocks
from ..streaming import ingest

TERMS = ["that", "enti", "que", "etc"]
TOP_K = 30
STOP = ("the", "and", "for", "with", "from", "that", "this")
ENTITIES, CONDITIONS, RELATIONS = ["the"], ["at", "que la"], ["with", "dans"]
GROUPS = [["the", "les"], ["at", "que"], ["zzz"]]

FLAGSHIP = "hybrid_rrf"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_TOKENS = f"regexp_extract_all(translate(lower(text), '{T.MARKED}', '{T.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_BM25 = f"""
words AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
lens AS (SELECT doc_id, len(t) AS n, t FROM words),
hits AS (SELECT doc_id, n, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM lens, (SELECT unnest({_sql_list(TERMS)}) AS term) q),
dfs AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM hits GROUP BY term),
stats AS (SELECT count(*) AS docs, avg(n) AS avg_n FROM lens),
bm25 AS (SELECT doc_id, sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))) AS bm25
  FROM hits JOIN dfs USING (term), stats GROUP BY doc_id HAVING sum(tf) > 0)"""


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS keyword_rank, 1.0::DOUBLE AS score_keyword FROM (SELECT doc_id, round(bm25, 9) AS bm25 FROM bm25) ORDER BY bm25 DESC, doc_id LIMIT {TOP_K}")
def kw_bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir).select("doc_id", r6("bm25").alias("bm25"), F.col("keyword_rank").cast("long").alias("keyword_rank"), "score_keyword")


def _keyword(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), TERMS, TOP_K)


_PADDED = f"w AS (SELECT doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS t FROM documents)"


@query(f"WITH {_PADDED} SELECT doc_id FROM w WHERE contains(t, ' of the ') AND contains(t, ' in ')")
def kw_phrase_match(spark, sf_dir):
    return lexical.phrases(table(spark, sf_dir, "documents"), ["of the", "in"]).select("doc_id")


@query(f"WITH {_PADDED} SELECT doc_id, CASE WHEN contains(t, ' of ') AND contains(t, ' in ') AND contains(t, ' near ') THEN 1 ELSE 0 END + CASE WHEN contains(t, ' near the ') THEN 2 ELSE 0 END AS found FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' near the' || t ELSE t END AS t FROM w)")
def kw_near_compat(spark, sf_dir):
    """Several phrases are joined by the word near, which must then occur; a third of the documents start with it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "Near the ").otherwise(""), "text").alias("text"))
    both = lexical.phrases(d, ["of", "in"], "compat").select("doc_id", F.lit(1).alias("a"))
    one = lexical.phrases(d, ["near the"], "compat").select("doc_id", F.lit(2).alias("b"))
    return d.select("doc_id").join(both, "doc_id", "left").join(one, "doc_id", "left").select("doc_id", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("found"))


@query(f"WITH w AS (SELECT doc_id, {_TOKENS} AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS term FROM w) SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM u GROUP BY term")
def kw_tokenize_stats(spark, sf_dir):
    return lexical.term_counts(table(spark, sf_dir, "documents"))


@query(
    f"""WITH s AS (SELECT doc_id, regexp_extract_all(source || ' ' || substr(text, 1, 600), '[A-Za-z0-9][A-Za-z0-9-]{{2,}}') AS w FROM documents),
k AS (SELECT doc_id, list_filter(w, lambda x: NOT list_contains({_sql_list(STOP)}, lower(x))) AS w FROM s),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM k),
f AS (SELECT doc_id, arg_min(x, i) AS x, min(i) AS i FROM u GROUP BY doc_id, lower(x)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f),
j AS (SELECT doc_id, string_agg(x, ', ' ORDER BY i) AS keywords FROM r WHERE n <= 12 GROUP BY doc_id)
SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN j USING (doc_id)"""
)
def kw_keyword_hints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keywords("source", F.lit(""), "text", STOP).alias("keywords"))


_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_VECTOR = f"vec AS (SELECT vec_id, round((list_cosine_similarity(embedding::DOUBLE[], q) + 1) / 2, 9) AS score_vector FROM embeddings, {_QUERY_VECTOR})"


def _query_vector(spark, sf_dir) -> list[float]:
    """The stated query: one row's vector."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query(f"WITH {_VECTOR} SELECT vec_id, round(score_vector, 6) AS score_vector, row_number() OVER (ORDER BY score_vector DESC, vec_id) AS vector_rank FROM vec ORDER BY score_vector DESC, vec_id LIMIT {TOP_K}")
def vec_cosine_topk(spark, sf_dir):
    found = vector.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), TOP_K)
    return found.select("vec_id", r6("score_vector").alias("score_vector"), F.col("vector_rank").cast("long").alias("vector_rank"))


@query(
    """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS match_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS c FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, match_id) AS n FROM p) SELECT query_id, match_id, round(c, 6) AS cosine FROM r WHERE n = 1"""
)
def vec_pairs_top1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector.nearest(e, e.where("vec_id % 100 = 0")).select("query_id", "match_id", r6("cosine").alias("cosine"))


@query("SELECT count(*) AS chunks_loaded, coalesce(max(len(embedding)), 0)::BIGINT AS vector_dimensions, count(DISTINCT len(embedding)) AS distinct_dimensions FROM embeddings")
def vec_index_stats(spark, sf_dir):
    return vector.stats(table(spark, sf_dir, "embeddings"))


_HYBRID = f"""{_BM25}, {_VECTOR},
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY b DESC, doc_id) AS kr FROM (SELECT doc_id, round(bm25, 9) AS b FROM bm25) ORDER BY b DESC, doc_id LIMIT {TOP_K}),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score_vector DESC, vec_id) AS vr FROM vec ORDER BY score_vector DESC, vec_id LIMIT {TOP_K}),
h AS (SELECT coalesce(k.id, v.id) AS chunk_id, kr, vr, least(1.0, (coalesce(1.0 / (60 + vr), 0) + coalesce(1.0 / (60 + kr), 0) + CASE WHEN kr IS NOT NULL AND vr IS NOT NULL THEN 0.15 ELSE 0 END) / (2.0 / 61 + 0.15)) AS s,
  CASE WHEN kr IS NOT NULL AND vr IS NOT NULL THEN 'hybrid' WHEN vr IS NOT NULL THEN 'vector' ELSE 'keyword' END AS retrieval_source FROM k FULL JOIN v ON k.id = v.id)"""


def _hybrid(spark, sf_dir, limit=None):
    v = vector.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), TOP_K).withColumnRenamed("vec_id", "chunk_id")
    return fusion.reciprocal_rank(v, _keyword(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), limit)


@query(f"WITH {_HYBRID} SELECT chunk_id, round(s, 6) AS score_final, retrieval_source FROM h")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("chunk_id", r6("score_final").alias("score_final"), "retrieval_source")


@query(f"WITH {_HYBRID} SELECT retrieval_source, count(*) AS n FROM h GROUP BY 1")
def hybrid_source_counts(spark, sf_dir):
    return _hybrid(spark, sf_dir).groupBy("retrieval_source").agg(F.count("*").alias("n"))


#: Lines of documents stand for chunks, and two score runs for two bundles.
_LINES = "lines AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS text, lpad(doc_id::VARCHAR, 9, '0') || ':' || lpad(i::VARCHAR, 4, '0') AS chunk_id FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_RUNS = """runs AS (SELECT *, 'first' AS bundle_name, 0 AS arrival, round(length(text) / (length(text) + 100.0), 9) AS score_final FROM lines WHERE contains(text, 'th') UNION ALL
SELECT *, 'second', 1, round(length(text) / (length(text) + 50.0), 9) FROM lines WHERE contains(text, 'que') OR contains(text, 'in'))"""


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    chunk = F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(":"), F.lpad((F.col("i") + 1).cast("string"), 4, "0"))
    return docs.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "text", chunk.alias("chunk_id"))


def _runs(spark, sf_dir):
    lines, n = _lines(spark, sf_dir), F.length("text").cast("double")
    one = lines.where(F.contains("text", F.lit("th"))).select("*", F.lit("first").alias("bundle_name"), F.lit(0).alias("arrival"), F.round(n / (n + 100), 9).alias("score_final"))
    two = lines.where(F.contains("text", F.lit("que")) | F.contains("text", F.lit("in"))).select("*", F.lit("second").alias("bundle_name"), F.lit(1).alias("arrival"), F.round(n / (n + 50), 9).alias("score_final"))
    return one.unionByName(two)


@query(f"WITH {_LINES}, {_RUNS} SELECT chunk_id, bundle_name, round(score_final, 6) AS score_final FROM runs QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score_final DESC, arrival) = 1")
def multi_bundle_maxby(spark, sf_dir):
    return ranking.best_per_chunk(_runs(spark, sf_dir)).select("chunk_id", "bundle_name", r6("score_final").alias("score_final"))


@query(
    f"""WITH {_LINES}, {_RUNS}, b AS (SELECT bundle_name, doc_id, max(score_final) AS s FROM runs GROUP BY 1, 2),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bundle_name ORDER BY s DESC, doc_id) <= 20),
c AS (SELECT doc_id, count(DISTINCT bundle_name) AS n FROM t GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS matched_bundle_count FROM documents LEFT JOIN c USING (doc_id)"""
)
def bundle_doc_matches(spark, sf_dir):
    counts = ranking.bundle_documents(_runs(spark, sf_dir))
    return table(spark, sf_dir, "documents").select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("matched_bundle_count", F.lit(0)).cast("long").alias("matched_bundle_count"))


@query(f"WITH {_LINES}, {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score_final DESC, chunk_id) AS n FROM runs WHERE bundle_name = 'first') SELECT doc_id, round(avg(score_final), 6) AS aggregate_score, string_agg(chunk_id, ',' ORDER BY n) AS top_ids FROM r WHERE n <= 3 GROUP BY doc_id")
def doc_top3_mean(spark, sf_dir):
    best = ranking.top_mean(_runs(spark, sf_dir).where("bundle_name = 'first'"))
    return best.select("doc_id", r6("aggregate_score").alias("aggregate_score"), F.array_join("top_ids", ",").alias("top_ids"))


@query(f"WITH {_LINES}, {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score_final DESC, chunk_id) AS n FROM runs WHERE bundle_name = 'first') SELECT doc_id, chunk_id, round(score_final, 6) AS score_final FROM r WHERE n <= 3 ORDER BY r.score_final DESC, chunk_id LIMIT 20")
def diverse_hits(spark, sf_dir):
    return ranking.diverse(_runs(spark, sf_dir).where("bundle_name = 'first'")).select("doc_id", "chunk_id", r6("score_final").alias("score_final"))


def _sql_match(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(norm, '{t}') OR contains(compact, '{t.replace(' ', '')}')" for t in terms) + ")"


_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-z\\x{4e00}-\\x{9fff}\\s.-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH n AS (SELECT doc_id, {_NORM} AS norm, replace(lower(text), ' ', '') AS compact, round(length(text) / (length(text) + 1000.0), 9) AS s FROM documents),
m AS (SELECT *, {_sql_match(ENTITIES)} AS e, {_sql_match(CONDITIONS)} AS c, {_sql_match(RELATIONS)} AS r, {' + '.join(f'{_sql_match(g)}::INT' for g in GROUPS)} AS g,
  array_to_string(list_filter([{', '.join(f"CASE WHEN NOT {_sql_match(g)} THEN '{' | '.join(g)}' END" for g in GROUPS)}], lambda x: x IS NOT NULL), '; ') AS missing FROM n),
p AS (SELECT *, least(1.0, 0.25 * e::INT + 0.35 * c::INT + 0.1 * r::INT + 0.3 * g / {len(GROUPS)} + 0.2 * (e AND c)::INT + 0.1 * (g = {len(GROUPS)})::INT) * CASE WHEN c THEN 1 ELSE 0.2 END * CASE WHEN e THEN 1 ELSE 0.35 END AS k FROM m)
SELECT doc_id, missing AS missing_constraints, round(k, 6) AS score_constraint, round(greatest(0, least(1, 0.55 * s + 0.45 * k + 0.08 * (e AND c)::INT - 0.12 * (NOT c)::INT)), 6) AS score_final FROM p"""
)
def constraint_rescore(spark, sf_dir):
    n = F.length("text").cast("double")
    hits = table(spark, sf_dir, "documents").select("doc_id", "text", F.round(n / (n + 1000), 9).alias("score_final"))
    out = fusion.constraint_scores(hits, ENTITIES, CONDITIONS, RELATIONS, GROUPS)
    return out.select("doc_id", F.array_join("missing_constraints", "; ").alias("missing_constraints"), r6("score_constraint").alias("score_constraint"), r6("score_final").alias("score_final"))


@query("SELECT d.doc_id, l.quality::BIGINT AS rerank_score, row_number() OVER (ORDER BY l.quality DESC NULLS LAST, n_chars DESC, d.doc_id) AS rank FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality DESC NULLS LAST, n_chars DESC, d.doc_id LIMIT 300")
def rerank_sort_nulls_last(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    from pyspark.sql import Window as W

    order = [F.desc_nulls_last("quality"), F.desc("n_chars"), F.col("doc_id")]
    return joined.orderBy(*order).limit(300).select("doc_id", F.col("quality").cast("long").alias("rerank_score"), F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"))


_TOKEN_COUNT = "greatest(1, (ceil((length(x) - length(regexp_replace(x, '[\\x00-\\x7f]', '', 'g'))) / 4.0) + length(regexp_replace(x, '[\\x00-\\x7f]', '', 'g')))::BIGINT)"
_COLLAPSED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"WITH x AS (SELECT doc_id, {_COLLAPSED} AS x FROM documents), t AS (SELECT doc_id, {_TOKEN_COUNT} AS t FROM x) SELECT doc_id, t AS tokens FROM t")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").cast("long").alias("tokens"))


@query(f"WITH x AS (SELECT doc_id, {_COLLAPSED} AS x FROM documents), t AS (SELECT doc_id, {_TOKEN_COUNT} + 16 AS tokens FROM x ORDER BY doc_id LIMIT 100), u AS (SELECT doc_id, tokens, sum(tokens) OVER (ORDER BY doc_id)::BIGINT AS used FROM t) SELECT * FROM u WHERE used <= 18000")
def context_budget_prefix(spark, sf_dir):
    return ranking.within_budget(table(spark, sf_dir, "documents"), T.token_estimate("text"), [F.col("doc_id")], budget=20000).select("doc_id", "tokens", "used")


@query(
    f"""WITH RECURSIVE x AS (SELECT doc_id, {_COLLAPSED} AS x FROM documents), t AS (SELECT doc_id, {_TOKEN_COUNT} + 16 AS tokens, row_number() OVER (ORDER BY doc_id) AS n FROM x ORDER BY doc_id LIMIT 500),
f AS (SELECT n, doc_id, tokens, 0::BIGINT AS batch_id, tokens AS used FROM t WHERE n = 1 UNION ALL
SELECT t.n, t.doc_id, t.tokens, CASE WHEN f.used + t.tokens > 3500 THEN f.batch_id + 1 ELSE f.batch_id END, CASE WHEN f.used + t.tokens > 3500 THEN t.tokens ELSE f.used + t.tokens END FROM f JOIN t ON t.n = f.n + 1)
SELECT doc_id, tokens, batch_id FROM f"""
)
def rerank_batches(spark, sf_dir):
    return ranking.batches(table(spark, sf_dir, "documents"), T.token_estimate("text"), ["doc_id"], 3500)


@query(
    """WITH j AS (SELECT source, doc_id, quality = 1 AS d FROM documents JOIN labels USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, sum(d::INT) OVER (PARTITION BY source ORDER BY doc_id) AS island FROM j),
r AS (SELECT *, sum((NOT d)::INT) OVER (PARTITION BY source, island ORDER BY doc_id) AS run FROM n),
s AS (SELECT *, min(CASE WHEN run >= 3 THEN n END) OVER (PARTITION BY source) AS stop FROM r)
SELECT source, count(*) AS documents, count(*) FILTER (stop IS NULL OR n <= stop + 4) AS judged, count(*) FILTER (d AND (stop IS NULL OR n <= stop + 4)) AS direct, bool_or(stop IS NOT NULL) AS stopped_early FROM s GROUP BY source"""
)
def early_stop_scan(spark, sf_dir):
    judged = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("direct", F.col("quality") == 1)
    return ranking.early_stop(judged, "source", "doc_id", "direct", streak=3)


_TITLE = "trim(regexp_replace(regexp_replace(lower(string_split(text, '.')[1]), '[^0-9a-z\\x{4e00}-\\x{9fff}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _titled(spark, sf_dir):
    """Documents as index entries: the first sentence is the title."""
    title = F.split("text", r"\.")[0]
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("/p/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("source_path"), title.alias("title"), T.normalize_title(title).alias("normalized_title"), T.content_hash("text").alias("file_hash"), "n_chars", F.col("doc_id").alias("n"))


_ENTRIES = f"entries AS (SELECT doc_id::VARCHAR AS doc_id, '/p/' || lpad(doc_id::VARCHAR, 9, '0') AS source_path, {_TITLE} AS normalized_title, sha256(text) AS file_hash, n_chars, doc_id AS n FROM documents)"


@query(
    f"""WITH {_ENTRIES}, st AS (SELECT min(source_path) AS source_path, normalized_title, arg_min(CASE WHEN n % 4 = 0 THEN 'old' ELSE file_hash END, source_path) AS file_hash FROM entries WHERE n % 2 = 0 GROUP BY normalized_title),
f AS (SELECT normalized_title, min(source_path) AS first FROM entries WHERE n_chars >= 100 GROUP BY 1)
SELECT e.doc_id, CASE WHEN n_chars < 100 THEN 'failed' WHEN own.file_hash = e.file_hash THEN 'skipped' WHEN o.source_path <> e.source_path AND own.source_path IS NOT NULL THEN 'conflict'
 WHEN o.source_path <> e.source_path OR (o.source_path IS NULL AND f.first <> e.source_path) THEN 'duplicate' ELSE 'processed' END AS status
FROM entries e LEFT JOIN st own ON own.source_path = e.source_path LEFT JOIN st o ON o.normalized_title = e.normalized_title LEFT JOIN f ON f.normalized_title = e.normalized_title"""
)
def incremental_status(spark, sf_dir):
    entries = _titled(spark, sf_dir)
    old = entries.where("n % 2 = 0").withColumn("h", F.when(F.col("n") % 4 == 0, "old").otherwise(F.col("file_hash")))
    state = old.groupBy("normalized_title").agg(F.min("source_path").alias("source_path"), F.min_by("h", "source_path").alias("file_hash"))
    incoming = entries.withColumn("error", F.when(F.col("n_chars") < 100, "too short"))
    return index.file_status(incoming, state).select("doc_id", "status")


@query(f"WITH {_ENTRIES} SELECT normalized_title, count(*) AS n, min(doc_id) AS kept_doc_id FROM entries GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir):
    return index.duplicate_titles(_titled(spark, sf_dir))


@query(
    f"""WITH {_ENTRIES}, new AS (SELECT 'x' || doc_id AS doc_id, CASE WHEN n_chars % 2 = 0 THEN source_path ELSE '/new' || source_path END AS source_path, normalized_title FROM entries WHERE n_chars % 3 = 0),
old AS (SELECT doc_id, source_path, normalized_title || CASE WHEN n_chars % 5 = 0 THEN ' old' ELSE '' END AS normalized_title FROM entries)
SELECT doc_id FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) AND source_path NOT IN (SELECT source_path FROM new) AND normalized_title NOT IN (SELECT normalized_title FROM new) UNION ALL SELECT doc_id FROM new"""
)
def upsert_anti(spark, sf_dir):
    """All documents are stored, some under older titles; those of every third length come in again, half of them from elsewhere."""
    entries = _titled(spark, sf_dir).select("doc_id", "source_path", "normalized_title", "n_chars")
    old = entries.withColumn("normalized_title", F.concat("normalized_title", F.when(F.col("n_chars") % 5 == 0, " old").otherwise(""))).drop("n_chars")
    path = F.when(F.col("n_chars") % 2 == 0, F.col("source_path")).otherwise(F.concat(F.lit("/new"), "source_path"))
    new = entries.where("n_chars % 3 = 0").select(F.concat(F.lit("x"), "doc_id").alias("doc_id"), path.alias("source_path"), "normalized_title")
    return index.replaced(old, new).select("doc_id")


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_text_dedupe(spark, sf_dir):
    return index.first_of_equal_texts(table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("text_hash")), ["text_hash"], ["doc_id"])


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("file_hash"))


@query(
    f"""WITH t AS (SELECT doc_id, {_TITLE} AS t FROM documents), s AS (SELECT doc_id, t, regexp_replace(substr(regexp_replace(regexp_replace(t, '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') AS slug FROM t)
SELECT doc_id, CASE WHEN slug = '' THEN '' ELSE slug || '-' END || substr(sha1(t), 1, 8) AS made_id FROM s"""
)
def doc_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.make_doc_id(F.split("text", r"\.")[0]).alias("made_id"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-z\\x{4e00}-\\x{9fff}\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM benchmark UNION ALL SELECT -1 - doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-z\\x{4e00}-\\x{9fff}\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) FROM documents")
def normalize_text(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", T.normalize_for_search("text").alias("normalized"))
    return b.unionByName(table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("item_id"), T.normalize_for_search("text").alias("normalized")))


@query("SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(lower(text), 'p\\s*h\\s*([0-9]+(?:\\.[0-9]+)?)', 1)).list_sort(), ',') AS ph FROM documents")
def ph_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.ph_values("text")), ",").alias("ph"))


@query("SELECT conv_id, turn, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk FROM conversations")
def cjk_flag(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.contains_cjk("text").alias("cjk"))


@query("SELECT event_id, nullif(regexp_extract(props, '(?s)\\{.*\\}'), '') AS block FROM events")
def json_block(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.json_block("props").alias("block"))


_PLAIN = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(
    f"""SELECT page_id, {_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {_PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS n_paragraphs, array_to_string(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: {_PLAIN.format('x')}), chr(10) || chr(10)) AS text FROM pages"""
)
def page_chunks(spark, sf_dir):
    return page_blocks(table(spark, sf_dir, "pages"))


@query("SELECT doc_id, list_filter(list_distinct(list_transform(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: '[' || x || ']'), ''), '\\[([0-9]+)\\]', 1), lambda x: TRY_CAST(x AS INT))), lambda x: x BETWEEN 1 AND 50).list_sort().array_to_string(',') AS refs FROM documents")
def citation_refs(spark, sf_dir):
    report = F.array_join(F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.concat(F.lit("["), x, F.lit("]"))), "")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.ref_ids(report, 50)), ",").alias("refs"))


@query("SELECT doc_id, source || ' (p. 0, chunk ' || lpad(doc_id::VARCHAR, 8, '0') || ':0001)' AS citation FROM documents")
def citation_format(spark, sf_dir):
    chunk = F.concat(F.lit("slug-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(":0001"))
    return table(spark, sf_dir, "documents").select("doc_id", T.citation("source", F.lit(0), F.lit(0), chunk).alias("citation"))


@query("SELECT doc_id, CASE WHEN length(text) <= 800 THEN text ELSE rtrim(substr(text, 1, 797)) || '...' END AS excerpt FROM documents")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt("text").alias("excerpt"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_ingest_counts(spark, sf_dir):
    return ingest.event_counts(spark, f"{sf_dir}/events.parquet").select("hour", "event_type", "n", F.round("total", 4).alias("total"))


@query()
def section_chunks(spark, sf_dir):
    """Pages as papers: the heading is the title, each paragraph a block, the page's title a section. Compared with a plain loop in the tests."""
    pages = page_blocks(table(spark, sf_dir, "pages"))
    text = F.concat(F.lit("# "), "heading", F.lit("\n\n## Abstract\n\n"), "heading", F.lit(".\n\n## "), "title", F.lit("\n\n"), "text")
    files = pages.select(F.col("page_id").cast("string").alias("source_path"), T.content_hash("text").alias("file_hash"), text.alias("text"), F.lit(None).cast("string").alias("error"))
    return chunking.chunk_table(chunking.chunk_documents(files))


from . import evidence  # noqa: E402, F401  (registers its queries)

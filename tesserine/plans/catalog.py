"""Queries over the shared tables, one or more for each group of operators, with their SQL.

The tables stand in for what the operators work on: ``documents`` for a knowledge base,
``embeddings`` for an index, ``conversations`` for questions and answers, the
star schema for keywords, ``events`` for event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import contexts, evalset, evaluation, keywords, metrics, preparation, retrieval, rewriting, validation
from ..session import scratch_dir
from ..sources import versions
from ..streaming import answers, events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]+"


def _n(x: str) -> str:
    """SQL of ``normalize_spaces``."""
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE_SQL}', ' ', 'g'))"


def _plain(x: str) -> str:
    """SQL of ``strip_diacritics``."""
    return f"replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D')"


def _match(x: str) -> str:
    """SQL of ``matching_key``."""
    return _n(f"regexp_replace(lower({_plain(x)}), '[^a-z0-9\\s]+', ' ', 'g')")


def _words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN [] ELSE string_split({x}, ' ') END)"


def _slug(x: str) -> str:
    return f"trim(regexp_replace(lower({_plain(x)}), '[^a-z0-9]+', '_', 'g'), '_')"


def _key(x: str) -> str:
    key = _n(f"regexp_replace({_plain(f'lower({_n(x)})')}, '[^a-z0-9\\s]+', ' ', 'g')")
    for ending in fixed.KEY_SUFFIXES:
        key = f"trim(regexp_replace({key}, '{ending}$', ''))" if ending.isascii() else key
    return key


# ---- vectors ----

_KNN = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS query_label, d.label AS doc_label, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM e q, e d WHERE {where}),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {k})"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("string").alias("label")
    return e.select(F.col("vec_id").alias("query_id"), "embedding", label), e.select(F.col("vec_id").alias("doc_id"), "embedding", label)


@query(f"WITH {_KNN.format(where='true', k=5)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM h")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector."""
    return retrieval.search(*_vectors(spark, sf_dir), k=5).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_KNN.format(where='q.label = d.label', k=5)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM h")
def knn_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(*_vectors(spark, sf_dir), k=5, by=("label",)).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_KNN.format(where='true', k=10)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM h WHERE score >= 0.35")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(*_vectors(spark, sf_dir), k=10, threshold=0.35).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query("""
WITH d AS (SELECT doc_id, lang AS value FROM documents), n AS (SELECT doc_id, CAST(quality AS VARCHAR) AS value FROM labels)
SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels upserted over documents by id."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("value"))
    return retrieval.upsert(old, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("value")))


# ---- evaluation ----

_LEAVE_ONE_OUT = _KNN.format(where="q.vec_id <> d.vec_id", k=5)
_RESULTS = f"""
WITH {_LEAVE_ONE_OUT},
m AS (SELECT *, 'kind ' || (query_label % 3) AS expected, 'kind ' || (doc_label % 3) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' sort ' || doc_label END AS keyword, query_label = doc_label AS cat FROM h),
k AS (SELECT *, keyword = expected OR starts_with(keyword, expected || ' ') AS kw FROM m),
r AS (SELECT query_id AS id, any_value(expected) AS expected_keyword, bool_or(kw AND rank = 1) AS hit_keyword_at_1, bool_or(kw) AS hit_keyword_at_k, bool_or(cat AND rank = 1) AS hit_category_at_1, bool_or(cat) AS hit_category_at_k,
  coalesce(1.0::DOUBLE / min(CASE WHEN kw THEN rank END), 0.0) AS rr_keyword, coalesce(1.0::DOUBLE / min(CASE WHEN cat THEN rank END), 0.0) AS rr_category, max(score) AS top1_score, min_by(keyword, rank) AS top1_keyword, list(keyword ORDER BY rank) AS found FROM k GROUP BY query_id)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector searched among the others, its label standing for a category and, loosely, a keyword."""
    queries, index = _vectors(spark, sf_dir)
    expected = queries.select(F.col("query_id").alias("id"), F.concat(F.lit("kind "), (F.col("label").cast("int") % 3).cast("string")).alias("expected_keyword"), F.concat(F.lit("cat "), "label").alias("expected_category"))
    label = F.col("label").cast("int")
    known = index.select("doc_id", F.concat(F.lit("cat "), "label").alias("category"), F.lit("").alias("subcategory"), F.concat(F.lit("kind "), (label % 3).cast("string"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit(" sort "), "label"))).alias("keyword"))
    near = retrieval.search(queries, index, k=6).where("query_id <> doc_id")
    by = F.row_number().over(evalset.W.partitionBy("query_id").orderBy("rank"))
    hits = near.withColumn("rank", by).where("rank <= 5").join(known, "doc_id").withColumnRenamed("query_id", "id")
    return evaluation.evaluate(expected, hits, k=5).withColumn("row_index", F.col("id"))


@query(_RESULTS + " SELECT id, hit_keyword_at_1, hit_keyword_at_k, hit_category_at_1, hit_category_at_k, round(rr_keyword, 6) AS rr_keyword, round(rr_category, 6) AS rr_category FROM r")
def eval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("id", "hit_keyword_at_1", "hit_keyword_at_k", "hit_category_at_1", "hit_category_at_k", F.round("rr_keyword", 6).alias("rr_keyword"), F.round("rr_category", 6).alias("rr_category"))


@query(_RESULTS + """ SELECT count(*) AS total, 5 AS top_k, 0::BIGINT AS no_result_count, 0.0::DOUBLE AS no_result_rate,
  round(count(*) FILTER (hit_keyword_at_1) / count(*), 4) AS top1_keyword_accuracy, round(count(*) FILTER (hit_keyword_at_k) / count(*), 4) AS topk_keyword_accuracy,
  round(count(*) FILTER (hit_category_at_1) / count(*), 4) AS top1_category_accuracy, round(count(*) FILTER (hit_category_at_k) / count(*), 4) AS topk_category_accuracy,
  round(sum(rr_keyword) / count(*), 4) AS mrr_keyword, round(sum(rr_category) / count(*), 4) AS mrr_category, round(avg(top1_score), 6) AS avg_top1_score, round(avg(1 - top1_score), 6) AS avg_top1_distance FROM r""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarize(_results(spark, sf_dir), k=5)


@query(_RESULTS + " SELECT id, expected_keyword, top1_keyword, round(top1_score, 9) AS top1_score, CAST(len(found) AS INTEGER) AS n_retrieved FROM r WHERE NOT hit_keyword_at_k")
def miss_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.misses(_results(spark, sf_dir)).select("id", "expected_keyword", "top1_keyword", F.round("top1_score", 9).alias("top1_score"), F.size("retrieved").alias("n_retrieved"))


@query(_RESULTS + """, u AS (SELECT id, expected_keyword, unnest(found) AS keyword, generate_subscripts(found, 1) AS pos FROM r WHERE NOT hit_keyword_at_k),
c AS (SELECT expected_keyword, keyword, count(*) AS n, min(id * 10000 + pos) AS f FROM u GROUP BY ALL)
SELECT expected_keyword, keyword, n, CAST(row_number() OVER (PARTITION BY expected_keyword ORDER BY n DESC, f) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""")
def wrong_keywords_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.wrong_keywords(evaluation.misses(_results(spark, sf_dir)), 3)


@query(_RESULTS + """, u AS (SELECT id, expected_keyword, unnest(found) AS keyword, generate_subscripts(found, 1) AS pos FROM r WHERE NOT hit_keyword_at_k)
SELECT expected_keyword, keyword, count(*) AS n FROM u GROUP BY ALL ORDER BY n DESC, min(id * 10000 + pos) LIMIT 10""")
def wrong_pairs_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.wrong_pairs(evaluation.misses(_results(spark, sf_dir)), 10)


_ERROR = """CASE WHEN t = '' THEN 'no_retrieved_keyword' WHEN e <> '' AND (contains(t, e) OR contains(e, t)) THEN 'keyword_variant_or_parent_child'
  WHEN list_has_any(string_split(e, ' '), string_split(t, ' ')) THEN 'same_keyword_family' ELSE 'semantic_neighbor' END"""


@query(_RESULTS + f", t AS (SELECT expected_keyword AS e, top1_keyword AS t FROM r WHERE NOT hit_keyword_at_k) SELECT {_ERROR} AS error_type, count(*) AS n FROM t GROUP BY ALL")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_error_type(evaluation.misses(_results(spark, sf_dir))).groupBy("error_type").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT p_partkey, lower({_n('p_name')}) AS e, lower({_n('p_type')}) AS t FROM part) SELECT p_partkey, {_ERROR} AS error_type FROM p")
def error_type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.error_type("p_name", "p_type").alias("error_type"))


@query(_RESULTS + """, x AS (SELECT * FROM r WHERE NOT hit_keyword_at_k),
o AS (SELECT *, row_number() OVER (PARTITION BY expected_keyword ORDER BY top1_score DESC, id) AS n, count(*) OVER (PARTITION BY expected_keyword) AS size, min(id) OVER (PARTITION BY expected_keyword) AS f FROM x),
a AS (SELECT id, 0 AS p, -size::DOUBLE AS b, f AS c FROM o WHERE n = 1 UNION ALL SELECT id, 1, -top1_score, id FROM o),
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, b, c) = 1)
SELECT id, CAST(row_number() OVER (ORDER BY p, b, c) AS INTEGER) AS position FROM u QUALIFY position <= 30""")
def representative_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.representative_cases(evaluation.misses(_results(spark, sf_dir)), 30).select("id", "position")


# ---- text ----


@query(f"SELECT doc_id, {_n('text')} AS spaced FROM documents")
def norm_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_spaces("text").alias("spaced"))


@query(f"SELECT doc_id, {_plain('text')} AS plain, strip_accents(lower(text)) AS accentless FROM documents")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_diacritics("text").alias("plain"), T.strip_accents(F.lower("text")).alias("accentless"))


@query(f"SELECT p_partkey, {_slug('p_name')} AS slug FROM part UNION ALL SELECT -item_id - 1, {_slug('text')} FROM benchmark")
def keyword_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", T.slug("p_name").alias("slug"))
    return parts.unionByName(table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("p_partkey"), T.slug("text").alias("slug")))


@query(f"SELECT p_partkey, {_key('p_name')} AS key, {_key(chr(39) + ' ' + chr(39) + ' || p_type || ' + chr(39) + ' Traditional  Culture' + chr(39))} AS type_key FROM part")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.lookup_key("p_name").alias("key"), T.lookup_key(F.concat(F.lit(" "), "p_type", F.lit(" Traditional  Culture"))).alias("type_key"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({_words(_match('text'))}, lambda w: NOT list_contains({_STOP_SQL}, w)))), ' ') AS tokens FROM benchmark")
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.token_set("text"), " ").alias("tokens"))


@query(f"SELECT doc_id, CAST(len({_words(_n('text'))}) AS INTEGER) AS words, CAST(length(regexp_replace(text, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g')) AS INTEGER) AS chars FROM documents")
def word_char_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("words"), T.char_count("text").alias("chars"))


@query(f"SELECT conv_id, turn, sha1({_n('role')} || '||' || {_n('text')}) AS cache_key FROM conversations")
def cache_key_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.rewrite_key("role", "text").alias("cache_key"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html("html").alias("escaped"))


@query("SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda p: p <> '')[-3:], '/') AS tail FROM pages")
def path_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.path_tail("url").alias("tail"))


_CUT = r"(?s)^(.*[.!?。！？][\s\x0b\x{85}\x{a0}\p{Z}]+)(.*)$"


@query(f"SELECT conv_id, turn, regexp_extract(text, '{_CUT}', 1) AS done, CASE WHEN regexp_matches(text, '{_CUT}') THEN regexp_extract(text, '{_CUT}', 2) ELSE text END AS rest FROM conversations")
def sentence_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.complete_sentences("text").alias("c")).select("conv_id", "turn", "c.done", "c.rest")


@query(f"""WITH w AS (SELECT conv_id, turn, {_words(_n('text'))} AS w FROM conversations), u AS (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS chunk_at FROM w)
SELECT conv_id, turn, CAST(chunk_at AS INTEGER) AS chunk_at, CASE WHEN chunk_at = 0 THEN x ELSE ' ' || x END AS chunk FROM u""")
def display_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.display_chunks("text")).alias("chunk_at", "chunk"))


@query()
def sanitize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about pictures, cleaned; needs look-behind, so it is tested against a model in Python instead."""
    said = F.concat(F.lit("Trả lời: Hình ảnh này cho thấy "), "text", F.lit(" Trong ảnh, một bát phở. Nhìn thấy rằng "), "role")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.postprocess_answer(said).alias("answer"))


# ---- rewriting ----

_OPENINGS = ["Món này", "Trong hình", "Hình ảnh thể hiện", "Mô tả hình ảnh này", "Kiến trúc này", "Ai"]
_QUESTIONS_SQL = "q AS (SELECT conv_id, turn, conv_id * 1000 + turn AS row_index, 'turn ' || turn AS keyword, [" + ", ".join(f"'{o}'" for o in _OPENINGS) + "][1 + (conv_id + turn) % 6] || ' ' || role || ' ' || text AS question, CASE WHEN turn % 3 = 0 THEN '' ELSE 'caption ' || conv_id END AS vision_caption FROM conversations)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (1 + (F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("keyword"),
        F.concat_ws(" ", opening, "role", "text").alias("question"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("caption "), F.col("conv_id").cast("string"))).alias("vision_caption"),
    )


def _rules_sql() -> str:
    """SQL of ``rewrite_question``: RE2 has no look-ahead, so what must follow is matched but not cut off."""
    parts = []
    for pattern, form in fixed.REWRITE_RULES:
        before, after = form.split("{keyword}")
        base, _, _ = pattern.partition("(?=")
        test, base = (x.replace(r"\w", r"[\pL\pN_]") for x in (pattern.replace("(?=", "("), base))
        parts.append(f"WHEN regexp_matches(question, '{test}') THEN '{before}' || keyword || '{after}' || substr(question, length(regexp_extract(question, '{base}')) + 1)")
    new = "CASE " + " ".join(parts) + " END"
    return f"CASE WHEN keyword <> '' AND question <> '' AND NOT contains(lower(question), lower(keyword)) THEN (SELECT upper(x[1]) || substr(x, 2) FROM (SELECT {new} AS x)) END"


_STRIPPED_SQL = _QUESTIONS_SQL.replace("role || ' ' || text AS question", f"role || ' ' || text AS raw").replace("q AS (", "q0 AS (") + f", q AS (SELECT * EXCLUDE (raw), regexp_replace(raw, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g') AS question FROM q0)"
_SUBJECT_SQL = "(SELECT len(list_filter(s, lambda w: list_contains(t, w))) >= CASE WHEN len(s) = 1 THEN 1 ELSE 2 END AND len(s) > 0 AND len(t) > 0 FROM (SELECT CASE WHEN len(s0) <= 2 THEN s0 WHEN len(s1) > 0 THEN s1 ELSE s0 END AS s, t FROM (SELECT s0, list_filter(s0, lambda w: NOT list_contains([{stop}], w)) AS s1, t FROM (SELECT regexp_extract_all(translate(strip_accents(lower({keyword})), '_-', '  '), '[a-z0-9]+') AS s0, regexp_extract_all(translate(strip_accents(lower({question})), '_-', '  '), '[a-z0-9]+') AS t))))"
_STOP2 = ", ".join(f"'{w}'" for w in fixed.SUBJECT_STOP_WORDS)
_REWRITTEN_SQL = f"WITH {_STRIPPED_SQL}, n AS (SELECT *, {_rules_sql()} AS new, {_SUBJECT_SQL.format(stop=_STOP2, keyword='keyword', question='question')} AS named FROM q), z AS (SELECT *, coalesce(new, question) AS standalone_question, CASE WHEN new IS NOT NULL THEN 'template' WHEN named THEN 'already_standalone' ELSE 'unchanged' END AS rewrite_method FROM n)"


@query(_REWRITTEN_SQL + " SELECT row_index, standalone_question, rewrite_method FROM z")
def template_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.apply_rules(_questions(spark, sf_dir)).select("row_index", "standalone_question", "rewrite_method")


@query("SELECT p_partkey, " + _SUBJECT_SQL.format(stop=_STOP2, keyword="p_name || ' viet nam'", question="p_type || ' ' || split_part(p_name, ' ', 1) || ' ' || p_brand") + " AS named FROM part")
def already_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.names_subject(F.concat("p_name", F.lit(" viet nam")), asked).alias("named"))


def _stats_sql() -> str:
    n = "count(*)"
    counts = [f"count(*) FILTER (rewrite_method = '{m}') AS {m}_count" for m in rewriting.METHODS]
    rates = [f"round(count(*) FILTER (rewrite_method = '{m}') / {n}, 4) AS {m}_rate" for m in rewriting.METHODS]
    length = lambda c: f"length(regexp_replace({c}, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g'))"
    words = lambda c: f"len({_words(_n(c))})"
    caption = "count(*) FILTER (trim(vision_caption) <> '')"
    return f"{_REWRITTEN_SQL} SELECT {n} AS total_questions, {', '.join(counts + rates)}, {caption} AS with_caption, {n} - {caption} AS missing_caption, round({caption} / {n}, 4) AS caption_coverage, round(avg({length('question')}), 2) AS avg_question_chars, round(avg({length('standalone_question')}), 2) AS avg_standalone_chars, round(avg({words('question')}), 2) AS avg_question_words, round(avg({words('standalone_question')}), 2) AS avg_standalone_words FROM z"


@query(_stats_sql())
def rewrite_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.rewrite_stats(rewriting.apply_rules(_questions(spark, sf_dir)))


_CACHE_SQL = f"c AS (SELECT DISTINCT sha1({_n('vision_caption')} || '||' || {_n('question')}) AS cache_key FROM q WHERE conv_id % 2 = 0), p AS (SELECT *, sha1({_n('vision_caption')} || '||' || {_n('question')}) AS cache_key, rewrite_method = 'unchanged' AND question <> '' AND vision_caption <> '' AS open FROM z)"


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = _questions(spark, sf_dir)
    cache = asked.where("conv_id % 2 = 0").select(T.rewrite_key("vision_caption", "question").alias("cache_key"), F.lit("from cache").alias("standalone_question"))
    return rewriting.apply_cache(rewriting.apply_rules(asked), cache)


@query(f"{_REWRITTEN_SQL}, {_CACHE_SQL} SELECT row_index FROM p WHERE open AND cache_key NOT IN (SELECT cache_key FROM c)")
def pending_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model still has to rewrite after the cache, which here knows every other conversation."""
    return _cached(spark, sf_dir)[1].select("row_index")


@query(f"{_REWRITTEN_SQL}, {_CACHE_SQL} SELECT row_index, CASE WHEN open AND cache_key IN (SELECT cache_key FROM c) THEN 'from cache' ELSE standalone_question END AS standalone_question, CASE WHEN open AND cache_key IN (SELECT cache_key FROM c) THEN 'llm' ELSE rewrite_method END AS rewrite_method FROM p")
def cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir)[0].select("row_index", "standalone_question", "rewrite_method")


# ---- keywords ----

_MAPPED_SQL = f"""
m AS (SELECT n_nationkey AS row_index, n_name AS raw, 'nước ' || n_name AS normalized FROM nation WHERE n_regionkey <> 2),
k AS (SELECT key, arg_max(normalized, row_index * 2 + form) AS normalized FROM (SELECT lower(raw) AS key, normalized, row_index, 0 AS form FROM m UNION ALL SELECT {_key('raw')}, normalized, row_index, 1 FROM m) GROUP BY key),
r AS (SELECT c_custkey AS row_index, upper(n_name) || CASE WHEN c_custkey % 2 = 0 THEN ' Culture' ELSE '' END AS keyword FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT r.row_index, r.keyword AS keyword_raw, coalesce(a.normalized, b.normalized, {_n('r.keyword')}) AS normalized_keyword FROM r LEFT JOIN k a ON lower({_n('r.keyword')}) = a.key LEFT JOIN k b ON {_key('r.keyword')} = b.key)"""


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    mapping = nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("row_index"), F.col("n_name").alias("raw"), F.concat(F.lit("nước "), "n_name").alias("normalized"))
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row_index"), F.concat(F.upper("n_name"), F.when(F.col("c_custkey") % 2 == 0, " Culture").otherwise("")).alias("keyword"))
    return named, keywords.key_table(mapping)


@query(f"WITH {_MAPPED_SQL} SELECT row_index, normalized_keyword, normalized_keyword <> keyword_raw AS changed FROM l")
def keyword_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.look_up(*_keyed(spark, sf_dir), "keyword").select("row_index", "normalized_keyword", "changed")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, keys = _keyed(spark, sf_dir)
    return keywords.clean_records(named.withColumn("standalone_question", F.concat(F.lit("what is "), F.lower("keyword"), F.lit(" like?"))), keys)


@query(f"WITH {_MAPPED_SQL} SELECT count(*) AS records, count(*) FILTER (normalized_keyword <> keyword_raw) AS changed, count(*) FILTER (normalized_keyword <> keyword_raw) AS standalone_changed, count(DISTINCT keyword_raw) AS unique_raw, count(*) FILTER (normalized_keyword = keyword_raw) AS unmapped FROM l")
def keyword_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.cleaning_summary(_cleaned(spark, sf_dir))


@query(f"WITH {_MAPPED_SQL} SELECT keyword_raw, count(*) AS n, min(row_index) AS first_row FROM l WHERE normalized_keyword = keyword_raw GROUP BY ALL")
def unmapped_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.unmapped(_cleaned(spark, sf_dir))


@query(f"WITH {_MAPPED_SQL} SELECT row_index, {_slug('normalized_keyword')} AS keyword_slug, CASE WHEN normalized_keyword = keyword_raw THEN 'what is ' || lower(keyword_raw) || ' like?' ELSE 'What is ' || normalized_keyword || ' like?' END AS standalone_question FROM l")
def keyword_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("row_index", "keyword_slug", "standalone_question")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, min(o_orderkey) LIMIT 10")
def most_common_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.most_common(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 10, order="o_orderkey").select("o_orderpriority", "o_orderstatus", "n")


# ---- validation ----

_IDS_SQL = "i AS (SELECT conv_id * 1000 + turn AS row_index, CASE WHEN turn % 7 = 5 THEN '' WHEN turn % 7 = 6 THEN 'c' || conv_id ELSE 'c' || (conv_id - conv_id % 2) || '_q' || turn END AS image_id FROM conversations)"


@query(f"""WITH {_IDS_SQL}, f AS (SELECT *, regexp_matches(image_id, '^(.+)_q(\\d+)$') AS formed FROM i)
SELECT row_index, CASE WHEN image_id = '' THEN 'missing' WHEN NOT formed THEN 'format' WHEN max(CASE WHEN formed THEN 1 END) OVER (PARTITION BY image_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL THEN 'duplicate' END AS problem,
  regexp_extract(image_id, '^(.+)_q(\\d+)$', 1) AS base_image_id, 'q' || regexp_extract(image_id, '^(.+)_q(\\d+)$', 2) AS question_id FROM f""")
def validate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    image = F.when(F.col("turn") % 7 == 5, "").when(F.col("turn") % 7 == 6, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("c"), (F.col("conv_id") - F.col("conv_id") % 2).cast("string"), F.lit("_q"), F.col("turn").cast("string")))
    return validation.check_record_ids(conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), image.alias("image_id"))).select("row_index", "problem", "base_image_id", "question_id")


def _raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of JSON text with all kinds of faults: repeated ids, missing parts, wrong types."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    category = F.element_at(F.array(*map(F.lit, [*fixed.CATEGORIES, "other", ""])), (1 + i % 8).cast("int"))
    sources = F.when(i % 5 == 0, F.lit('"a||b"')).when(i % 5 == 1, F.lit("[]")).when(i % 5 == 2, F.lit('["a", " ", "b"]')).otherwise(F.lit('["a"]'))
    count = F.when(i % 4 == 0, F.lit('"1"')).when(i % 4 == 1, F.lit("2")).otherwise(F.lit("1"))
    name = F.when(i % 11 == 0, "").when(i % 11 == 1, F.concat(category, F.lit("|x"))).otherwise(F.concat_ws("|", category, F.when(i % 3 == 0, F.lit("sub")).otherwise(F.lit("other")), (i % 97).cast("string")))
    quoted = lambda c: F.to_json(F.struct(c.alias("x")))
    value = lambda c: F.regexp_replace(quoted(c), r'(?s)^\{"x":(.*)\}$', "$1")
    content = F.when(i % 13 == 0, "").when(i % 13 == 1, "short").otherwise(F.col("text"))
    meta = F.concat(F.lit('{"keyword": '), value(F.when(i % 17 == 0, "").otherwise(F.lower(F.substring_index("text", " ", 1)))), F.lit(', "category": '), value(category), F.lit(', "subcategory": '), value(F.when(i % 7 == 0, "").otherwise(F.lit("sub"))), F.lit(', "source_image_ids": '), sources, F.lit(', "source_count": '), count, F.lit("}"))
    raw = F.concat(F.lit('{"doc_id": '), value(name), F.lit(', "content": '), value(content), F.lit(', "metadata": '), F.when(i % 19 == 0, F.lit("null")).otherwise(meta), F.lit("}"))
    return d.select(i.alias("row_index"), raw.alias("raw"))


_CATS = ", ".join(f"'{c}'" for c in fixed.CATEGORIES)
_CHECKED_SQL = f"""
WITH a AS (SELECT doc_id AS i, [{_CATS}, 'other', ''][1 + doc_id % 8] AS cat, regexp_replace(text, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g') AS body, lower(split_part(text, ' ', 1)) AS first FROM documents),
b AS (SELECT i, i % 19 <> 0 AS has_metadata, CASE WHEN i % 11 = 0 THEN '' WHEN i % 11 = 1 THEN cat || '|x' ELSE cat || '|' || CASE WHEN i % 3 = 0 THEN 'sub' ELSE 'other' END || '|' || (i % 97) END AS doc_id,
  CASE WHEN i % 13 = 0 THEN '' WHEN i % 13 = 1 THEN 'short' ELSE body END AS content, CASE WHEN i % 19 = 0 OR i % 17 = 0 THEN '' ELSE regexp_replace(first, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g') END AS keyword, CASE WHEN i % 19 = 0 THEN '' ELSE cat END AS category,
  CASE WHEN i % 19 = 0 OR i % 7 = 0 THEN '' ELSE 'sub' END AS subcategory, i % 19 <> 0 AND i % 5 <> 0 AS listed, CASE WHEN i % 19 = 0 OR i % 5 < 2 THEN 0 WHEN i % 5 = 2 THEN 2 ELSE 1 END AS ids,
  i % 19 <> 0 AND i % 4 <> 0 AS whole, CASE WHEN i % 4 = 1 THEN 2 ELSE 1 END AS given FROM a),
c AS (SELECT *, doc_id = '' OR content = '' OR NOT has_metadata OR keyword = '' OR category = '' OR category NOT IN ({_CATS}) AS bad, string_split(doc_id, '|') AS p FROM b),
d AS (SELECT *, doc_id <> '' AND max(CASE WHEN NOT bad THEN 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AS seen FROM c),
e AS (SELECT *, list_filter([
  CASE WHEN doc_id = '' THEN 'error:doc_id:{fixed.ISSUES["no_id"]}' END,
  CASE WHEN seen THEN 'error:doc_id:Duplicate doc_id: ''' || doc_id || '''.' END,
  CASE WHEN content = '' THEN 'error:content:{fixed.ISSUES["no_content"]}' END,
  CASE WHEN content <> '' AND length(content) < 20 THEN 'warning:content:{fixed.ISSUES["short"]}' END,
  CASE WHEN NOT has_metadata THEN 'error:metadata:{fixed.ISSUES["no_metadata"]}' END,
  CASE WHEN keyword = '' THEN 'error:metadata.keyword:{fixed.ISSUES["no_keyword"]}' END,
  CASE WHEN category = '' THEN 'error:metadata.category:{fixed.ISSUES["no_category"]}' END,
  CASE WHEN category <> '' AND category NOT IN ({_CATS}) THEN 'error:metadata.category:Invalid category ''' || category || '''.' END,
  CASE WHEN subcategory = '' THEN 'warning:metadata.subcategory:{fixed.ISSUES["no_subcategory"]}' END,
  'warning:metadata.base_image_id:{fixed.ISSUES["no_base_image"]}',
  CASE WHEN NOT listed THEN 'warning:metadata.source_image_ids:{fixed.ISSUES["ids_not_list"]}' END,
  CASE WHEN listed AND ids = 0 THEN 'warning:metadata.source_image_ids:{fixed.ISSUES["ids_empty"]}' END,
  CASE WHEN NOT whole THEN 'warning:metadata.source_count:{fixed.ISSUES["count_not_int"]}' END,
  CASE WHEN listed AND ids > 0 AND CASE WHEN whole THEN given ELSE ids END <> ids THEN 'warning:metadata.source_count:{fixed.ISSUES["count_differs"]}' END,
  CASE WHEN keyword <> '' AND content <> '' AND NOT contains(lower(content), keyword) THEN 'warning:content:{fixed.ISSUES["keyword_absent"]}' END,
  CASE WHEN doc_id <> '' AND len(p) < 3 THEN 'warning:doc_id:{fixed.ISSUES["id_format"]}' END,
  CASE WHEN len(p) >= 3 AND category <> '' AND p[1] <> category THEN 'warning:doc_id:{fixed.ISSUES["id_category"]}' END,
  CASE WHEN len(p) >= 3 AND subcategory <> '' AND p[2] <> subcategory THEN 'warning:doc_id:{fixed.ISSUES["id_subcategory"]}' END], lambda x: x IS NOT NULL) AS issues FROM d)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.check_documents(validation.parse_documents(_raw_documents(spark, sf_dir)))


@query(_CHECKED_SQL + ", u AS (SELECT i AS row_index, doc_id, unnest(issues) AS x, generate_subscripts(issues, 1) - 1 AS pos FROM e) SELECT row_index, CAST(pos AS INTEGER) AS pos, nullif(doc_id, '') AS doc_id, x AS issue FROM u")
def validate_docs_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.issue_table(_checked(spark, sf_dir)).select("row_index", "pos", "doc_id", F.concat_ws(":", "level", "field", "message").alias("issue"))


@query(_CHECKED_SQL + ", g AS (SELECT *, len(list_filter(issues, lambda x: starts_with(x, 'error'))) AS errors FROM e) SELECT count(*) AS total_raw_docs, count(*) FILTER (errors = 0) AS valid_docs, count(*) FILTER (errors > 0) AS invalid_docs, CAST(sum(errors) AS BIGINT) AS error_count, CAST(sum(len(issues) - errors) AS BIGINT) AS warning_count, count(DISTINCT CASE WHEN errors = 0 THEN keyword END) AS unique_keyword_count FROM g")
def validation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_stats(_checked(spark, sf_dir))


@query(_CHECKED_SQL + ", u AS (SELECT unnest(issues) AS x FROM e) SELECT regexp_extract(x, '^[a-z]+:[a-z_.]+') AS level_field, count(*) AS n FROM u GROUP BY ALL")
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.issue_histogram(_checked(spark, sf_dir))


@query(_CHECKED_SQL + " SELECT i AS row_index, doc_id, content, keyword, category, subcategory, CAST(CASE WHEN whole THEN given ELSE ids END AS INTEGER) AS source_count FROM e WHERE len(list_filter(issues, lambda x: starts_with(x, 'error'))) = 0")
def valid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.valid_documents(_checked(spark, sf_dir)).select("row_index", "doc_id", "content", "metadata.keyword", "metadata.category", "metadata.subcategory", "metadata.source_count")


_GATE_SQL = """, u AS (SELECT round(count(*) FILTER (hit_keyword_at_k) / count(*), 4) AS k, round(count(*) FILTER (hit_category_at_k) / count(*), 4) AS c, round(count(*) FILTER (hit_keyword_at_1) / count(*), 4) AS k1 FROM r),
w AS (SELECT CASE WHEN k >= 0.8 AND c >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS retrieval_status, k1 < k AS deeper FROM u)
SELECT CASE WHEN valid.ok AND retrieval_status = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS overall_status, CASE WHEN valid.ok THEN 'PASS' ELSE 'FAIL' END AS validation_status, 'PASS' AS build_status, retrieval_status, retrieval_status AS filtered_status,
  CAST((NOT valid.ok)::INTEGER + valid.warned::INTEGER + (retrieval_status = 'FAIL')::INTEGER + deeper::INTEGER AS INTEGER) AS n_recommendations FROM w, (%s) AS valid"""


@query(_RESULTS + _GATE_SQL % (_CHECKED_SQL + " SELECT count(*) FILTER (len(list_filter(issues, lambda x: starts_with(x, 'error'))) > 0) = 0 AS ok, count(*) FILTER (len(list_filter(issues, lambda x: starts_with(x, 'warning'))) > 0) > 0 AS warned FROM e"))
def report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over the results of validation, of the index of the valid documents, and of retrieval."""
    summary = evaluation.summarize(_results(spark, sf_dir), k=5)
    checked = _checked(spark, sf_dir)
    flat = validation.valid_documents(checked).select("doc_id", "content", "metadata.keyword")
    path = scratch_dir(spark)
    versions.create(preparation.embedding_documents(flat), path, key="doc_id", buckets=4)
    stored = versions.read(spark, path).agg(F.count("*").alias("count_after"))
    build = preparation.index_stats(preparation.embedding_documents(flat)).select(F.lit(False).alias("dry_run"), "total_documents").join(stored)
    return evaluation.gated_report(validation.validation_stats(checked), build, summary, summary).withColumn("n_recommendations", F.size("recommendations")).drop("recommendations")


# ---- preparation ----


@query(f"SELECT doc_id, CAST(length(regexp_replace(text, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g')) AS INTEGER) AS content_length_chars, CAST(len({_words(_n('text'))}) AS INTEGER) AS content_length_words, lang || '||' || source AS tags FROM documents")
def doc_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.array("lang", "source").alias("tags"))
    return preparation.embedding_documents(d).select("doc_id", "content_length_chars", "content_length_words", "tags")


@query(f"""WITH l AS (SELECT source, length(regexp_replace(text, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g')) AS c, len({_words(_n('text'))}) AS w FROM documents)
SELECT count(*) AS total_documents, count(DISTINCT source) AS unique_keyword_count, CAST(min(w) AS INTEGER) AS min_words, CAST(max(w) AS INTEGER) AS max_words, round(avg(w), 2) AS avg_words, CAST(min(c) AS INTEGER) AS min_chars, CAST(max(c) AS INTEGER) AS max_chars, round(avg(c), 2) AS avg_chars FROM l""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.index_stats(preparation.embedding_documents(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("keyword"))))


@query(f"""WITH t AS (SELECT doc_id, lang, source, {_n('text')} AS s, lang || '|' || source || '|' || doc_id AS base FROM documents WHERE doc_id % 5 <> 0),
g AS (SELECT substr(sha1(s), 1, 12) AS hash, arg_min(doc_id, doc_id) AS f, arg_min(lang, doc_id) AS category, arg_min(source, doc_id) AS subcategory, arg_min(base, doc_id) AS base_image_id, list_sort(list(DISTINCT base || '_q' || (doc_id % 3))) AS ids FROM t WHERE length(s) > 20 GROUP BY hash)
SELECT f AS row_index, category || '|' || subcategory || '|kw ' || (f % 7) || '|' || hash AS doc_id, base_image_id, array_to_string(ids, '|') AS source_image_ids, CAST(len(ids) AS INTEGER) AS source_count FROM g""")
def kb_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge documents of four fifths of the documents, as items with one question each."""
    d = table(spark, sf_dir, "documents")
    question = F.array(F.struct((F.col("doc_id") % 3).alias("question_id")))
    items = d.select(F.col("doc_id").alias("row_index"), F.col("lang").alias("category"), F.col("source").alias("subcategory"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"), F.when(F.col("doc_id") % 5 != 0, "train").otherwise("test").alias("split"), F.col("text").alias("knowledge"), F.concat(F.lit("kw "), (F.col("doc_id") % 7).cast("string")).alias("keyword"), question.alias("questions"))
    return preparation.knowledge_documents(items).select("row_index", "doc_id", "base_image_id", "source_image_ids", "source_count")


_SPLIT_SQL = "s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents), p AS (SELECT doc_id, lang, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.9::DOUBLE) THEN 'test' ELSE 'val' END AS split FROM s)"


@query(f"WITH {_SPLIT_SQL} SELECT doc_id, split FROM p")
def split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.train_test_val(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "split")


@query(f"WITH {_SPLIT_SQL} SELECT lang, split, count(*) AS n FROM p GROUP BY ALL")
def category_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.train_test_val(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").groupBy("lang", "split").agg(F.count("*").alias("n"))


# ---- evaluation sets ----


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row_index"), F.col("c_custkey").alias("id"), F.col("n_name").alias("expected_keyword"), F.col("c_mktsegment").alias("expected_category"), F.concat_ws(" ", "n_name", "c_mktsegment").alias("normalized_question"))


@query("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) IN (SELECT lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)")
def evalset_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation, as an expected keyword, some well-off supplier has."""
    nation = table(spark, sf_dir, "nation")
    documents = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.upper("n_name").alias("keyword"))
    return evalset.covered(_customers(spark, sf_dir), documents).select("id")


@query("SELECT min(c_custkey) AS id, n_name AS expected_keyword, c_mktsegment AS expected_category FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.deduplicate(_customers(spark, sf_dir)).select("id", "expected_keyword", "expected_category")


@query("SELECT c_custkey AS id FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) <= 50")
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.cap_per_group(_customers(spark, sf_dir), "expected_category", 50, seed=42).select("id")


@query("WITH r AS (SELECT c_custkey AS id, c_mktsegment AS m, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS n FROM customer) SELECT id FROM r ORDER BY n, m LIMIT 103")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.balanced_sample(_customers(spark, sf_dir), "expected_category", 103, seed=42).select("id")


@query("SELECT c_custkey AS id FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 60")
def random_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.random_cap(_customers(spark, sf_dir), 60, seed=7).select("id")


@query("SELECT conv_id, turn, 'val' AS source_split FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 'test' FROM conversations WHERE role = 'assistant'")
def union_val_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    part = lambda role, split: c.where(F.col("role") == role).select("conv_id", "turn", F.lit(split).alias("source_split"))
    return part("user", "val").unionByName(part("assistant", "test"))


# ---- contexts and prompts ----

_SUBJECTS = ["Tết Nguyên Đán", "mứt Tết", "áo dài", "lễ hội bánh chưng", "đàn bầu", ""]
_SUBJECTS_SQL = "[" + ", ".join(f"'{s}'" for s in _SUBJECTS) + "]"
_HITS_SQL = f"""
WITH {_LEAVE_ONE_OUT},
x AS (SELECT query_id, doc_id, rank, score, {_SUBJECTS_SQL}[1 + doc_id % 6] AS keyword, CASE WHEN doc_id % 4 = 0 THEN 'le_hoi' ELSE 'am_thuc' END AS category, CASE WHEN query_id % 2 = 0 THEN 'Tết ở đâu?' ELSE 'Món ăn Tết?' END AS query, 'text of ' || doc_id AS content FROM h),
y AS (SELECT *, {_match('keyword')} AS mk FROM x),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN mk = '' THEN '#' || doc_id ELSE mk END ORDER BY rank) = 1),
b AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN CASE WHEN mk = 'tet nguyen dan' THEN 0.25 WHEN category = 'le_hoi' THEN 0.12 ELSE 0.0 END - CASE WHEN mk IN ('mut tet', 'tet han thuc', 'le hoi banh chung') THEN 0.12 ELSE 0.0 END ELSE 0.0 END AS bonus FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score + bonus::DOUBLE DESC, score DESC, rank) AS position FROM b),
k AS (SELECT query_id, any_value(query) AS query, left(string_agg('[Cultural Context ' || position || ']\n' || 'doc_id: ' || doc_id || E'\\nkeyword: ' || keyword || E'\\ncategory: ' || category || E'\\nsubcategory: \\ncontent:\\n' || content, E'\\n\\n' ORDER BY position), 300) AS block FROM o GROUP BY query_id)""".replace("']\n'", "E']\\n'")


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests, and for each the five nearest other vectors as documents with made-up subjects."""
    queries, index = _vectors(spark, sf_dir)
    near = retrieval.search(queries, index, k=6).where("query_id <> doc_id")
    ranked = near.withColumn("rank", F.row_number().over(evalset.W.partitionBy("query_id").orderBy("rank"))).where("rank <= 5")
    subject = F.element_at(F.array(*map(F.lit, _SUBJECTS)), (1 + F.col("doc_id") % 6).cast("int"))
    hits = ranked.withColumns({"keyword": subject, "category": F.when(F.col("doc_id") % 4 == 0, "le_hoi").otherwise("am_thuc"), "subcategory": F.lit(""), "content": F.concat(F.lit("text of "), F.col("doc_id").cast("string"))})
    asked = queries.select("query_id", F.when(F.col("query_id") % 2 == 0, "Tết ở đâu?").otherwise("Món ăn Tết?").alias("question"), F.lit(" ").alias("normalized_question"))
    return asked, hits


@query(_HITS_SQL + " SELECT query_id, doc_id, CAST(position AS INTEGER) AS position FROM o")
def rerank_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    named = hits.join(asked.select("query_id", F.col("question").alias("query")), "query_id")
    return contexts.rerank(contexts.distinct_subjects(named)).select("query_id", "doc_id", "position")


@query(_HITS_SQL + f" SELECT query_id, query, regexp_replace(block, '{_SPACE_SQL}$', '') AS context_block FROM k")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    return contexts.build_context(asked.select("query_id", F.col("question").alias("query")), hits, max_chars=300)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(_HITS_SQL + f" SELECT query_id, {_literal(fixed.PROMPT_WITH)} || query || {_literal(fixed.PROMPT_MIDDLE)} || regexp_replace(block, '{_SPACE_SQL}$', '') AS prompt FROM k")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    return contexts.prepare_prompts(asked, hits, max_chars=300).select("query_id", "prompt")


@query("WITH b AS (SELECT doc_id, arg_min(text, turn) AS content FROM documents d JOIN (SELECT conv_id, turn FROM conversations WHERE turn = 0) c ON d.doc_id = c.conv_id GROUP BY ALL) SELECT c.conv_id, c.turn, coalesce(b.content, '') AS retrieve_context FROM conversations c LEFT JOIN b ON c.conv_id = b.doc_id".replace("arg_min(text, turn)", "any_value(text)"))
def top_context_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with the text of the document that has the conversation's number, where its first turn exists."""
    conv, docs = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")
    hits = docs.join(conv.where("turn = 0").select(F.col("conv_id").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("rank"), F.col("text").alias("content"))
    return contexts.top_context_column(conv, hits, key="conv_id").select("conv_id", "turn", "retrieve_context")


# ---- streams ----


@query(f"SELECT conv_id || '-' || turn AS request_id, {_n('text')} AS answer, true AS finished, false AS failed FROM conversations")
def sse_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as events of a response, folded back into text."""
    made = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("role").alias("retrieval_query"), F.array("role").alias("contexts"), F.lit("").alias("prompt"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(0.5).alias("seconds"))
    return answers.fold_events(answers.response_events(made))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.tumbling_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY ALL")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sliding_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.session_counts(table(spark, sf_dir, "events"))


# ---- text metrics ----


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.select("conv_id", "turn", F.col("text").alias("prediction")).join(after, ["conv_id", "turn"])


_TOKENS_SQL = "t AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[\\pL\\pN]+') AS p, regexp_extract_all(lower(b.text), '[\\pL\\pN]+') AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _f_sql(n: int) -> str:
    grams = lambda c: f"list_transform(generate_series(1, len({c}) - {n - 1}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"
    return f"""g{n} AS (SELECT conv_id, turn, {grams('p')} AS p, {grams('r')} AS r FROM t),
h{n} AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(p, r), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))), 0) AS h FROM g{n}),
f{n} AS (SELECT conv_id, turn, CASE WHEN h = 0 OR len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE 2 * (h / len(p)) * (h / len(r)) / (h / len(p) + h / len(r)) END AS rouge FROM h{n})"""


@query(f"WITH {_TOKENS_SQL}, {_f_sql(1)}, {_f_sql(2)} SELECT f1.conv_id, f1.turn, round(f1.rouge, 6) AS rouge1, round(f2.rouge, 6) AS rouge2 FROM f1 JOIN f2 ON f1.conv_id = f2.conv_id AND f1.turn = f2.turn")
def rouge_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 and -2 of each turn against the next."""
    return metrics.rouge_n(_pairs(spark, sf_dir), ["conv_id", "turn"], "prediction", "reference").withColumns({c: F.round(c, 6) for c in ("rouge1", "rouge2")})


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A longest common subsequence is beyond SQL, so it is tested against a model in Python instead."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l(F.col("prediction"), F.col("reference")), 6).alias("rougeL"))


@query()
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_bleu(_pairs(spark, sf_dir), "prediction", "reference")


@query("SELECT CAST(floor(value) AS BIGINT) AS epoch, min(CASE WHEN event_type <> 'click' THEN value END) AS train_loss, min(CASE WHEN event_type = 'click' THEN value END) AS eval_loss FROM events GROUP BY ALL")
def loss_per_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("value").alias("epoch"), F.when(F.col("event_type") != "click", F.col("value")).alias("loss"), F.when(F.col("event_type") == "click", F.col("value")).alias("eval_loss"))
    return preparation.loss_per_epoch(log)



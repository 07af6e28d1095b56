"""Queries that read and write, prepare nested items, and run whole jobs, with their SQL; registered beside those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, vectors
from ..functions import text as T
from ..operators import contexts, evalset, evaluation, keywords, metrics, preparation, rewriting, validation
from ..plugins import EchoGenerator, HashEmbedder, KeywordRewriter
from ..session import scratch_dir
from ..sources import readers, sinks
from ..streaming import answers
from . import jobs
from .catalog import _CHECKED_SQL, _QUESTIONS_SQL, _REWRITTEN_SQL, _SPACE_SQL, _checked, _customers, _n, _questions, query, table

# ---- sources and sinks: what is written is read back ----


@query("SELECT doc_id, text, lang, CAST(n_chars AS BIGINT) AS n_chars, (SELECT count(*) FROM documents) AS written FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    n = sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("n_chars").cast("long").alias("n_chars")), path)
    return readers.read_jsonl(spark, path, "doc_id long, text string, lang string, n_chars long").withColumn("written", F.lit(n).cast("long"))


@query("SELECT CAST(row_number() OVER (ORDER BY item_id) AS BIGINT) AS row_index, item_id FROM benchmark")
def jsonl_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered by their place in a file."""
    path = scratch_dir(spark)
    sinks.write_jsonl(table(spark, sf_dir, "benchmark").coalesce(1).sortWithinPartitions("item_id"), path)
    return readers.read_jsonl_numbered(spark, path, "item_id long, text string").select("row_index", "item_id")


@query("SELECT item_id, item_id % 3 = 0 AS bad, CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id END AS parsed FROM benchmark")
def jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lenient reader keeps what it can't parse."""
    path = scratch_dir(spark)
    i = F.col("item_id").cast("string")
    line = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('{"x": '), i, F.lit(" oops"))).otherwise(F.concat(F.lit('{"x": '), i, F.lit("}")))
    table(spark, sf_dir, "benchmark").select(line.alias("value")).write.text(path)
    read = readers.read_jsonl(spark, path, "x long", strict=False)
    found = F.coalesce(F.col("x"), F.regexp_extract("_corrupt", r"(\d+)", 1).cast("long"))
    return read.select(found.alias("item_id"), F.col("_corrupt").isNotNull().alias("bad"), F.when(F.col("_corrupt").isNull(), F.col("x")).alias("parsed"))


@query("SELECT r_name AS category, n_name AS subcategory, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS position, s_name AS file FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2")
def nested_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested index of files, written as one JSON document and flattened as it is read."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    files = s.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("files"))
    subs = n.join(files, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct("files")))).alias("subcategories"))
    cats = subs.join(r, F.col("n_regionkey") == F.col("r_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.struct("subcategories")))).alias("categories"))
    path = scratch_dir(spark)
    sinks.write_text(spark, cats.select(F.to_json(F.struct("categories"))).first()[0], path)
    index = readers.read_json_document(spark, path, "categories map<string, struct<subcategories: map<string, struct<files: array<string>>>>>")
    wanted = [x["r_name"] for x in r.where("r_regionkey <> 2").collect()]
    return preparation.index_files(index, categories=wanted)


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS name, (SELECT count(*) FROM nation) AS stored, true AS deleted, false AS there FROM nation")
def table_replace_and_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index upserted over itself, opened, and another one deleted."""
    path, schema = scratch_dir(spark), "id long, name string"
    first = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    assert readers.open_index(spark, path, schema).count() == 0
    sinks.replace_table(first.select("id", "name"), path)
    changed = first.where("n_regionkey = 1").select("id", F.concat(F.upper("name"), F.lit("!")).alias("name"))
    sinks.replace_table(jobs.retrieval.upsert(readers.open_index(spark, path, schema), changed, key="id", order="name"), path)
    other = scratch_dir(spark)
    sinks.replace_table(first, other)
    deleted = sinks.delete(spark, other)
    index = readers.open_index(spark, path, schema)
    return index.select("id", "name", F.lit(index.count()).cast("long").alias("stored"), F.lit(deleted).alias("deleted"), F.lit(readers.exists(spark, other)).alias("there"))


@query("SELECT count(*) AS orders, round(sum(o_totalprice), 2) AS total, false AS input_missing FROM orders UNION ALL SELECT NULL, NULL, true")
def stats_sink_and_missing_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row written as a small JSON file twice over, and read back beside one that isn't there."""
    path, schema = scratch_dir(spark), "orders long, total double"
    row = table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice").cast("double"), 2).alias("total"))
    sinks.write_stats(row.select(F.lit(0).alias("orders")), path)
    sinks.write_stats(row, path)
    return readers.read_json_or_missing(spark, path, schema).unionByName(readers.read_json_or_missing(spark, path + ".none", schema))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 57")
def scan_with_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_rows(table(spark, sf_dir, "orders"), 57, order="o_orderkey").select("o_orderkey")


# ---- preparation of nested items ----

_CATS = "[" + ", ".join(f"'{c}'" for c in fixed.CATEGORIES) + "]"
_N = len(fixed.CATEGORIES)
_ITEMS_SQL = f"""i AS (SELECT conv_id, {_CATS}[1 + conv_id % {_N}] AS category, 'sub' || (conv_id % 3) AS subcategory, conv_id || '.jpg' AS file, 'kw ' || (conv_id % 7) AS keyword, conv_id + CASE WHEN conv_id % 10 = 1 THEN 1000000 ELSE 0 END AS row_index,
  CASE WHEN conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 10 <> 3)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items with questions, joined to their files; some files have two items, some items none."""
    i = F.col("conv_id")
    c = table(spark, sf_dir, "conversations")
    asked = F.struct(F.col("turn").cast("long").alias("question_id"), F.col("text").alias("question"), F.col("role").alias("answer"), F.lit("more").alias("detailed_explanation"))
    each = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(asked)).alias("questions"))
    category, sub, file = F.element_at(F.array(*map(F.lit, fixed.CATEGORIES)), (1 + i % _N).cast("int")), F.concat(F.lit("sub"), (i % 3).cast("string")), F.concat(i.cast("string"), F.lit(".jpg"))
    files = each.select(category.alias("category"), sub.alias("subcategory"), file.alias("file"), F.when(i % 5 == 0, "test").otherwise("train").alias("split"))
    items = each.where("conv_id % 10 <> 3").select(i.alias("row_index"), F.concat_ws("/", F.lit("root"), category, sub, file).alias("image_path"), F.concat(F.lit("kw "), (i % 7).cast("string")).alias("keyword"), "questions", F.lit("seen").alias("caption"), F.lit("a long enough piece of knowledge").alias("knowledge"))
    again = items.where("row_index % 10 = 1").withColumn("row_index", F.col("row_index") + 1_000_000)
    return preparation.join_items(files, items.unionByName(again))


@query(f"WITH {_ITEMS_SQL} SELECT category, subcategory, file, row_index FROM i")
def items_by_path_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("category", "subcategory", "file", "row_index")


@query(f"""WITH {_ITEMS_SQL} SELECT i.row_index, category || '|' || subcategory || '|' || i.conv_id || '_q' || turn AS image_id, 'q' || turn AS question_id, 'images_' || split || '/' || category || '/' || subcategory || '/' || file AS image_path, keyword, text AS question, 'seen' AS vision_caption, role || '. more' AS answer_label
FROM i JOIN conversations c ON c.conv_id = i.conv_id""")
def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.question_records(_items(spark, sf_dir)).select("row_index", "image_id", "question_id", "image_path", "keyword", "question", "vision_caption", "answer_label")


@query(f"""WITH {_ITEMS_SQL}, r AS (SELECT category, split FROM i JOIN conversations c ON c.conv_id = i.conv_id)
SELECT category, count(*) AS "before", count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, 0::BIGINT AS val FROM r GROUP BY ALL""")
def question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return preparation.question_counts(items, preparation.question_records(items))


@query("""SELECT p_partkey, p_name || ' Đối tượng trong ảnh: ' || array_to_string(string_split(p_type, ' '), ', ') || '. Bố cục: ' || p_brand AS caption, array_to_string(list_sort(list_distinct([p_type, p_brand])), ' ') AS symbolism,
  'Lịch sử: ' || p_name || '. Ý nghĩa: . Vùng miền: ' || p_brand AS knowledge FROM part""")
def caption_and_symbolism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", preparation.caption(F.col("p_name"), F.split("p_type", " "), F.col("p_brand")).alias("caption"),
        preparation.distinct_symbolism(F.array("p_type", F.lit(" "), "p_brand", F.concat(F.lit(" "), "p_type"))).alias("symbolism"),
        preparation.knowledge(F.col("p_name"), F.lit(None).cast("string"), F.col("p_brand")).alias("knowledge"),
    )


# ---- evaluation sets and jobs ----


@query(f"""WITH v AS (SELECT conv_id * 1000 + turn AS row_index, CASE WHEN turn % 2 = 0 THEN 'c' || conv_id || '_q' || turn ELSE 'c' || conv_id END AS id, regexp_replace(text, '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g') AS question, CASE WHEN turn % 3 = 0 THEN '' ELSE 'kw' END AS k FROM conversations)
SELECT row_index, id, question, question AS normalized_question, 'val' AS source_split FROM v WHERE question <> '' AND k <> ''""")
def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("image_id"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("q"), F.col("turn").cast("string"))).alias("question_id"),
        F.col("text").alias("question"), F.lit(" ").alias("standalone_question"), F.when(F.col("turn") % 3 == 0, " ").otherwise("kw").alias("keyword"), F.lit("cat").alias("category"), F.lit("").alias("subcategory"),
    )
    return evalset.build_records(rows, "val").select("row_index", "id", "question", "normalized_question", "source_split")


_SAMPLE = """SELECT id, split FROM (SELECT id, split, row_number() OVER (PARTITION BY split, category ORDER BY md5(seed || ':' || id), id) AS n FROM q) WHERE n <= 20"""


@query(f"""WITH c AS (SELECT c_custkey, upper(n_name) AS keyword, c_mktsegment AS category, 'what about ' || n_name || ' ' || c_mktsegment || ' ' || (c_custkey % 5) AS question, CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'val' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3),
f AS (SELECT split, category, min(c_custkey) AS k FROM c GROUP BY split, category, lower(keyword), question),
q AS (SELECT split, category, 'i' || k AS id, CASE WHEN split = 'val' THEN 42 ELSE 43 END AS seed FROM f) {_SAMPLE}""")
def build_eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job of evaluation queries over customers: covered, distinct, capped per category, validation before test."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("row_index"), F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("image_id"), F.lit("").alias("question_id"),
        F.concat_ws(" ", F.lit("what about"), "n_name", "c_mktsegment", (F.col("c_custkey") % 5).cast("string")).alias("question"), F.lit("").alias("standalone_question"), F.upper("n_name").alias("keyword"), F.col("c_mktsegment").alias("category"), F.lit("").alias("subcategory"),
    )
    documents = nation.where("n_regionkey <> 3").select(F.lower("n_name").alias("keyword"))
    splits = {"val": rows.where("row_index % 3 <> 0"), "test": rows.where("row_index % 3 = 0")}
    return jobs.build_eval_queries(splits, documents, max_per_category=20).select("id", F.col("source_split").alias("split"))


@query("""SELECT (SELECT count(*) FROM customer) AS raw_count, (SELECT count(*) FROM customer) AS valid_count, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3) AS covered_count,
  (SELECT count(*) FROM (SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3)) AS deduplicated_count,
  (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3) / (SELECT count(*) FROM customer) AS keyword_coverage_rate, x.category, x.n FROM (SELECT c_mktsegment AS category, count(DISTINCT n_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3 GROUP BY ALL) x""")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _customers(spark, sf_dir)
    covered = evalset.covered(known, table(spark, sf_dir, "nation").where("n_regionkey <> 3").select(F.lower("n_name").alias("keyword")))
    stats = evalset.split_stats({"raw": known, "valid": known, "covered": covered, "deduplicated": evalset.deduplicate(covered)})
    return stats.select("*", F.explode("categories").alias("category", "n")).drop("categories")


@query("""WITH r AS (SELECT 'nước ' || n_name AS keyword, n_nationkey FROM nation) SELECT n_nationkey AS row_index, 'loc|' || trim(regexp_replace(lower(replace(replace(strip_accents(keyword), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', '_', 'g'), '_') || '|h' AS doc_id, n_name AS keyword_raw, keyword FROM r JOIN nation USING (n_nationkey)""")
def clean_knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    mapping = nation.select(F.col("n_nationkey").alias("row_index"), F.col("n_name").alias("raw"), F.concat(F.lit("nước "), "n_name").alias("normalized"))
    docs = nation.select(F.col("n_nationkey").alias("row_index"), F.concat_ws("|", F.lit("loc"), F.lower("n_name"), F.lit("h")).alias("doc_id"), F.col("n_name").alias("keyword"), F.lit("loc").alias("category"), F.lit("").alias("subcategory"), F.lit("text").alias("content"))
    return jobs.clean_keywords(docs, mapping, mode="knowledge").select("row_index", "doc_id", "keyword_raw", "keyword")


@query(f"""WITH {_QUESTIONS_SQL} SELECT row_index, CASE WHEN row_index % 4 = 0 THEN 'earlier ' || row_index ELSE 'plain' END AS standalone_question, CASE WHEN row_index % 4 = 0 THEN 'llm' ELSE 'unchanged' END AS rewrite_method, CASE WHEN row_index % 4 = 0 THEN 'existing_output' END AS rewrite_source FROM q""")
def existing_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the rewrites that an earlier output has of a quarter of them; of two such, the last."""
    asked = _questions(spark, sf_dir).withColumn("image_id", F.col("row_index").cast("string"))
    records = asked.select("row_index", "image_id", "question", F.lit("plain").alias("standalone_question"), F.lit("unchanged").alias("rewrite_method"), F.lit(None).cast("string").alias("rewrite_source"))
    old = asked.where("row_index % 4 = 0").select("row_index", "image_id", "question", F.concat(F.lit("earlier "), "image_id").alias("standalone_question"), F.lit("llm").alias("rewrite_method"))
    older = old.withColumns({"row_index": F.col("row_index") - 1_000_000_000, "standalone_question": F.lit("too early")})
    return rewriting.restore_existing(records, old.unionByName(older)).select("row_index", "standalone_question", "rewrite_method", "rewrite_source")


@query(_REWRITTEN_SQL + " SELECT row_index, standalone_question, CASE WHEN rewrite_method = 'template' THEN 'template' ELSE 'unchanged' END AS rewrite_method FROM z")
def rules_without_subject_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.rules_only(_questions(spark, sf_dir)).select("row_index", "standalone_question", "rewrite_method")


@query(f"WITH {_QUESTIONS_SQL} SELECT row_index, keyword, question FROM q ORDER BY row_index LIMIT 10")
def rewrite_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.examples(rewriting.rules_only(_questions(spark, sf_dir))).select("row_index", "keyword", "question")


@query("SELECT conv_id * 1000 + turn AS row_index,  'llm' AS rewrite_method, 'kw' || conv_id || 'x: zz ' || turn || ' zz ' || text AS standalone_question FROM conversations")
def standalone_question_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rewriting job: no rule fits, so the model is asked for every question."""
    c = table(spark, sf_dir, "conversations")
    records = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_q"), F.col("turn").cast("string")).alias("image_id"), F.concat(F.lit("kw"), F.col("conv_id").cast("string"), F.lit("x")).alias("keyword"), F.concat(F.lit("zz "), F.col("turn").cast("string"), F.lit(" zz "), F.col("text")).alias("question"), F.lit("seen").alias("vision_caption"))
    done, _ = jobs.build_standalone_questions(records, rewriter=KeywordRewriter())
    return done.select("row_index", "rewrite_method", "standalone_question")


@query(_CHECKED_SQL + """, g AS (SELECT *, len(list_filter(issues, lambda x: starts_with(x, 'error'))) AS errors FROM e), v AS (SELECT * FROM g WHERE errors = 0),
k AS (SELECT keyword, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(i), keyword) AS pos FROM v WHERE keyword <> '' GROUP BY keyword),
u AS (SELECT unnest(issues) AS x FROM e)
SELECT 'category' AS kind, category AS name, count(*) AS n FROM v WHERE category <> '' GROUP BY ALL UNION ALL SELECT 'keyword', keyword, n FROM k WHERE pos <= 30 UNION ALL SELECT 'issue', regexp_extract(x, '^[a-z]+:[a-z_.]+'), count(*) FROM u GROUP BY ALL""")
def validation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of the full statistics, as rows."""
    stats = validation.full_stats(_checked(spark, sf_dir))
    named = lambda c, kind: F.transform(F.map_entries(c), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("n")))
    each = F.concat(named("categories", "category"), named("top_keywords", "keyword"), named("issues", "issue"))
    return stats.select(F.explode(each).alias("e")).select("e.*")


@query(_CHECKED_SQL + ", u AS (SELECT i, unnest(issues) AS x, generate_subscripts(issues, 1) - 1 AS pos FROM e) SELECT i AS row_index, CAST(pos AS INTEGER) AS pos, x AS issue FROM u ORDER BY i, pos LIMIT 30")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.first_issues(_checked(spark, sf_dir), 30).select("row_index", "pos", F.concat_ws(":", "level", "field", "message").alias("issue"))


_ODD = [('"0"', "0"), ('"false"', "false"), ("0", ""), ("false", ""), ("null", ""), ("[]", ""), ("{}", ""), ("true", "True"), ("7", "7"), ('" x "', "x"), ("0.0", ""), ('""', "")]


@query("SELECT o_orderkey AS row_index, [" + ", ".join(f"'{t}'" for _, t in _ODD) + f"][1 + o_orderkey % {len(_ODD)}] AS doc_id, [" + ", ".join(f"'{t}'" for _, t in _ODD) + f"][1 + o_orderkey // {len(_ODD)} % {len(_ODD)}] AS keyword FROM orders")
def falsy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as a text: "0" and "false" do; zero, false, null, [] and {} are blank."""
    pick = lambda i: F.element_at(F.array(*(F.lit(v) for v, _ in _ODD)), (1 + i % len(_ODD)).cast("int"))
    i = F.col("o_orderkey")
    raw = F.concat(F.lit('{"doc_id": '), pick(i), F.lit(', "metadata": {"keyword": '), pick(F.floor(i / len(_ODD))), F.lit("}}"))
    return validation.parse_documents(table(spark, sf_dir, "orders").select(i.alias("row_index"), raw.alias("raw"))).select("row_index", "doc_id", "keyword")


# ---- search, contexts, answers ----


@query("SELECT n_nationkey AS query_id, n_nationkey AS doc_id, 'about ' || n_name AS content, 1.0 AS score FROM nation WHERE n_nationkey % 4 <> 0")
def search_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations asked for by their own text, each the nearest of its index; blank queries find nothing."""
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("about "), "n_name").alias("content"))
    embedder = HashEmbedder()
    asked = named.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("content")).alias("query"))
    return jobs.search_texts(asked, embedder.embed(named, "content"), embedder, k=1, threshold=0.35).select("query_id", "doc_id", "content", F.round("score", 6).alias("score"))


@query("SELECT n_nationkey AS query_id, E'[Context 1]\\ndoc_id: ' || n_nationkey || E'\\nkeyword: ' || n_name || E'\\ncategory: ' || n_regionkey || E'\\ncontent:\\nabout ' || n_name AS context_block FROM nation")
def plain_context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.lit(1).alias("rank"), F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("keyword"), F.col("n_regionkey").cast("string").alias("category"), F.concat(F.lit("about "), "n_name").alias("content"))
    return contexts.plain_blocks(hits)


@query("SELECT n_nationkey AS query_id, 'All about ' || n_name || '.' AS answer FROM nation")
def answer_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question to answer: search, contexts, prompt, a generator that gives the context's first sentence, and its cleaning."""
    nation = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("all about "), "n_name", F.lit(". And more."))
    docs = nation.select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("keyword"), F.lit("place").alias("category"), F.lit("").alias("subcategory"), text.alias("content"))
    embedder = HashEmbedder()
    asked = nation.select(F.col("n_nationkey").alias("query_id"), text.alias("question"), F.lit("").alias("normalized_question"), F.lit("").alias("category"), F.col("n_name").alias("keyword"))
    return jobs.answer(asked, embedder.embed(docs, "content"), embedder, EchoGenerator()).select("query_id", "answer")


@query("SELECT p_partkey, true AS is_unit FROM part")
def l2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", vectors.normalized(F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"))).alias("v"))
    return made.select("p_partkey", (F.abs(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) - 1) < 1e-9).alias("is_unit"))


@query("SELECT 'a' AS run, round(avg(n_chars), 4) AS rouge1, 0.0 AS bleu FROM documents UNION ALL SELECT 'b', round(max(n_chars), 4), count(*) FROM documents")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    runs = {"a": d.agg(F.round(F.avg("n_chars"), 4).alias("rouge1")), "b": d.agg(F.round(F.max("n_chars").cast("double"), 4).alias("rouge1"), F.count("*").cast("double").alias("bleu"))}
    return metrics.compare_runs(runs, ["rouge1", "bleu"])


@query("SELECT conv_id * 1000 + turn AS row_index, text AS prediction, role AS reference FROM conversations WHERE turn % 2 = 0")
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("row_index", F.col("conv_id") * 1000 + F.col("turn"))
    return metrics.align(c.select("row_index", F.col("text").alias("prediction")), c.where("turn % 2 = 0").select("row_index", F.col("role").alias("reference")))


@query(f"SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN '' ELSE {_n('p_name')} END AS optional, 'x ' || p_brand AS unfenced, CASE WHEN length({_n('p_type')}) <= 10 THEN {_n('p_type')} ELSE rtrim(substr({_n('p_type')}, 1, 10)) || '...' END AS preview FROM part")
def small_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_optional("p_name").alias("optional"), T.strip_code_fence(F.concat(F.lit("```json\nx "), "p_brand", F.lit("\n```"))).alias("unfenced"), T.preview("p_type", 10).alias("preview"))


@query("SELECT E'<|im_start|>user\\n" + fixed.CHAT_REQUEST.replace("\n", "\\n").replace("%s", "' || CASE WHEN turn % 3 = 0 THEN role ELSE 'about ' || conv_id END || E'", 1).replace("%s", "' || CASE WHEN turn % 2 = 0 THEN 'q' ELSE text END || E'", 1) + "<|im_end|>\\n<|im_start|>assistant\\n' || role || E'<|im_end|>\\n' AS text FROM conversations WHERE text <> ''")
def chat_training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training chats of records whose fields fall back on others."""
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    rows = c.select(
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("about "), F.col("conv_id").cast("string"))).alias("cultural_context"), F.col("role").alias("culture_context"),
        F.when(F.col("turn") % 2 == 0, "q").alias("standalone_question"), F.col("text").alias("question"), F.lit("").alias("answer_label"), F.col("role").alias("answer"),
    )
    return preparation.chat_texts(preparation.training_texts(rows))


# ---- streams ----


@query("SELECT conv_id * 1000 + turn AS row_index, 'turn ' || turn || ': ' || role AS standalone_question FROM conversations")
def rewrite_stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of records rewritten batch by batch and stored; after a stop the second half comes, and nothing comes twice."""
    folder = scratch_dir(spark)
    source, out, checkpoint = (f"{folder}/{x}" for x in ("in", "out", "checkpoint"))
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("keyword"), F.col("role").alias("question"))
    for half in (0, 1):
        c.where(F.col("row_index") % 2 == half).coalesce(2).write.mode("append").parquet(source)
        records = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream = answers.rewrite_stream(records, KeywordRewriter().rewrite, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), checkpoint=checkpoint)
        stream.awaitTermination()
    return spark.read.parquet(out).select("row_index", "standalone_question")


@query(f"SELECT conv_id || '-' || turn AS request_id, {_n('text')} AS text FROM conversations WHERE trim(text) <> ''")
def sentence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens streamed through the sentence buffer; the sentences of a request make its text again."""
    folder = scratch_dir(spark)
    words = F.split("text", "(?<= )")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.posexplode(words).alias("seq", "token"), F.size(words).alias("n"))
    tokens = c.select("request_id", F.col("seq").cast("long").alias("seq"), "token", (F.col("seq") == F.col("n") - 1).alias("is_last"))
    tokens.write.parquet(f"{folder}/in")
    stream = answers.stream_sentences(spark.readStream.schema(tokens.schema).parquet(f"{folder}/in"))
    provider = "spark.sql.streaming.stateStore.providerClass"  # states of this kind need this store
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    whole = spark.read.schema(answers.SENTENCES).parquet(f"{folder}/out").groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sentence"))), lambda s: s["sentence"]), "").alias("text"))
    return whole.select("request_id", T.normalize_spaces("text").alias("text"))

"""Operators on small tables, with the edge cases that each defines."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine.operators import contexts, evalset, evaluation, keywords, metrics, preparation, retrieval, rewriting, validation
from tesserine.plans import jobs
from tesserine.plugins import BatchRewriter, EchoGenerator, GreedyMatchScorer, HashEmbedder, KeywordRewriter, device, dtype
from tesserine.sources import readers, sinks

HIT = "query_id string, rank int, doc_id string, content string, keyword string, category string, subcategory string, score double, distance double"


def test_search_ties_nulls_filters(spark):
    index = spark.createDataFrame([("b", [1.0, 0.0], "x"), ("a", [2.0, 0.0], "x"), ("c", [0.0, 1.0], "y"), ("n", None, "x"), ("z", [0.0, 0.0], "x")], "doc_id string, embedding array<float>, category string")
    queries = spark.createDataFrame([("q1", [1.0, 0.0], None), ("q2", [1.0, 0.0], "y"), ("q3", None, None)], "query_id string, embedding array<float>, category string")
    got = [tuple(r)[:4] for r in retrieval.search(queries, index, k=2, by=("category",), tiles=(1, 2)).orderBy("query_id", "rank").collect()]
    assert got == [("q1", 1, "a", 1.0), ("q1", 2, "b", 1.0), ("q2", 1, "c", 0.0)]
    assert retrieval.search(queries, index, k=2, threshold=0.5).count() == 4
    assert retrieval.search(queries.limit(0), index, k=2).count() == 0


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (90, 4)).astype(float)  # many ties, some zero vectors
    some = lambda n, names: [None if x == 0 else names[x - 1] for x in rng.integers(0, len(names) + 1, n)]
    index = [(f"d{i:02}", vectors[i].tolist(), c, k) for i, (c, k) in enumerate(zip(some(70, ["x", "y", "=", '"']), some(70, ["m", "n"]), strict=True))]
    queries = [(f"q{i:02}", vectors[70 + i].tolist(), c, k) for i, (c, k) in enumerate(zip(some(20, ["x", "y", "=", '"', "absent"]), some(20, ["m", "n", ""]), strict=True))]
    schema = "{} string, embedding array<double>, category string, keyword string"
    want = set()
    for q, v, c, k in queries:
        near = [(round(float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), 9), d) for d, w, dc, dk in index if np.any(v) and np.any(w) and (not c or c == dc) and (not k or k == dk)]
        want |= {(q, i + 1, d, s) for i, (s, d) in enumerate(sorted(near, key=lambda x: (-x[0], x[1]))[:4])}
    tables = spark.createDataFrame(queries, schema.format("query_id")), spark.createDataFrame(index, schema.format("doc_id"))
    for tiles in ((3, 7), (1024, 16384)):
        got = retrieval.search(*tables, k=4, by=("category", "keyword"), tiles=tiles).select("query_id", "rank", "doc_id", "score")
        assert {tuple(r) for r in got.collect()} == want


def test_search_with_more_filters_than_are_broadcast(spark, monkeypatch):
    index = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), F.col("id").alias("shop"))
    queries = index.select(F.col("doc_id").alias("query_id"), "embedding", "shop")
    monkeypatch.setattr(retrieval, "FILTERS", 5)
    got = retrieval.search(queries, index, k=3, by=("shop",)).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in got) == [(i, i) for i in range(40)]


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    for n in "ba":
        (tmp_path / f"{n}.txt").write_text("".join("\n" if i % 7 == 3 else f"{n}{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = readers.read_lines(spark, str(tmp_path))
        got = sorted(map(tuple, lines.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(j * 3000 + i + 1, f"{n}{i}") for j, n in enumerate("ab") for i in range(3000) if i % 7 != 3]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("")
    assert readers.read_lines(spark, str(tmp_path / "empty")).count() == 0


def test_search_plan_has_top_k_before_the_window(spark):
    index = spark.createDataFrame([("b", [1.0, 0.0])], "doc_id string, embedding array<float>")
    plan = retrieval.search(index.withColumnRenamed("doc_id", "query_id"), index, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 3)], "doc_id string, v int, n int")
    got = {r["doc_id"]: r["v"] for r in retrieval.upsert(old, new, order="n").collect()}
    assert got == {"a": 1, "b": 3, "c": 4}


def test_contexts(spark):
    hits = spark.createDataFrame([("q", 1, "d1", "mut", "mứt Tết", "am_thuc", "s", 0.453, 0.5), ("q", 2, "d2", "tet", "Tết Nguyên Đán", "le_hoi", "s", 0.441, 0.5), ("q", 3, "d3", "again", "TẾT nguyên đán", "le_hoi", "s", 0.4, 0.6), ("q", 4, "d4", "blank", "", "x", "s", 0.1, 0.9), ("q", 5, "d5", "blank", None, "x", "s", 0.1, 0.9)], HIT)
    queries = spark.createDataFrame([("q", "Tết Việt Nam có gì?"), ("none", "khác")], "query_id string, query string")
    named = hits.join(queries, "query_id")
    order = [r["doc_id"] for r in contexts.rerank(contexts.distinct_subjects(named)).orderBy("position").collect()]
    assert order == ["d2", "d1", "d4", "d5"]
    built = {r["query_id"]: r["context_block"] for r in contexts.build_context(queries, hits, max_chars=60).collect()}
    assert built["q"].startswith("[Cultural Context 1]\ndoc_id: d2") and len(built["q"]) <= 60 and built["none"] == ""
    whole = contexts.build_context(queries, hits, max_chars=0).where("query_id = 'q'").first()["context_block"]
    assert whole.count("[Cultural Context") == 4
    plain = contexts.plain_blocks(hits, max_chars=0).first()["context_block"]
    assert plain == ""
    prompts = {r["query_id"]: r["prompt"] for r in contexts.prepare_prompts(queries.select("query_id", F.col("query").alias("question"), F.lit(None).cast("string").alias("normalized_question")), hits).collect()}
    assert "Ngữ cảnh văn hóa:\n" in prompts["q"] and "Ngữ cảnh văn hóa:\n" not in prompts["none"]
    with pytest.raises(Exception, match="question cannot be empty"):
        spark.range(1).select(contexts.prompt(F.lit(" "), F.lit("x"))).collect()


def test_keywords(spark):
    mapping = readers.mapping_table(spark, {"keyword_normalization": {"banh chung Tet": "bánh chưng", " ": "x", "ao dai": "áo dài"}})
    keys = keywords.key_table(mapping)
    rows = spark.createDataFrame([(1, "Banh Chung tet", "what is banh chung tet"), (2, "AO-DAI", None), (3, "unknown", ""), (4, None, "x")], "row_index long, keyword string, standalone_question string")
    got = {r["row_index"]: r for r in keywords.clean_records(rows, keys).collect()}
    assert got[1]["keyword"] == "bánh chưng" and got[1]["standalone_question"] == "What is bánh chưng" and got[1]["keyword_slug"] == "banh_chung"
    assert got[2]["keyword"] == "áo dài" and got[3]["keyword"] == "unknown" and not got[3]["changed"] and got[4]["keyword"] == ""
    summary = keywords.cleaning_summary(keywords.clean_records(rows, keys)).first()
    assert (summary["records"], summary["changed"], summary["unmapped"]) == (4, 2, 1)
    docs = spark.createDataFrame([(1, "am_thuc|x|h1", "Chủ đề: y\nNgữ cảnh văn hóa:  ngon ", "ao dai", "am_thuc", None), (2, "short", "text", "unknown", "", "sub")], "row_index long, doc_id string, content string, keyword string, category string, subcategory string")
    got = {r["row_index"]: r for r in keywords.clean_documents(docs, keys).collect()}
    assert got[1]["doc_id"] == "am_thuc|ao_dai|h1" and got[1]["content"] == "Chủ đề: áo dài\nDanh mục: am_thuc\nNgữ cảnh văn hóa: ngon" and got[1]["subcategory"] == "ao_dai"
    assert got[2]["doc_id"] == "short" and got[2]["subcategory"] == "sub"


def document(**meta):
    base = {"keyword": "phở", "category": "am_thuc", "subcategory": "s", "base_image_id": "b", "source_image_ids": ["a"], "source_count": 1}
    return base | meta


def test_validation(spark):
    good = "phở is a soup of rice noodles"
    raws = [
        {"doc_id": "am_thuc|s|1", "content": "", "metadata": document()},  # an error: its id isn't seen
        {"doc_id": "am_thuc|s|1", "content": good, "metadata": document()},
        {"doc_id": "am_thuc|s|1", "content": good, "metadata": document()},
        {"doc_id": "x", "content": "phở", "metadata": document(source_image_ids="a||b", source_count=True)},
        {"doc_id": "am_thuc|t|2", "content": good, "metadata": document(source_image_ids=["a", " "], source_count="1")},
        {"doc_id": "le_hoi|s|3", "content": good, "metadata": document(category="bad", source_count=3)},
        {"doc_id": "a|b|c", "content": good, "metadata": []},
        {"content": 0, "metadata": None},
    ]
    raw = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)] + [(99, "not json")], "row_index long, raw string")
    checked = validation.check_documents(validation.parse_documents(raw))
    by = {}
    for r in validation.issue_table(checked).orderBy("row_index", "pos").collect():
        by.setdefault(r["row_index"], []).append((r["level"][0], r["field"]))
    assert by[0] == [("e", "content")] and 1 not in by and by[2] == [("e", "doc_id")]
    assert by[3] == [("w", "content"), ("w", "metadata.source_image_ids"), ("w", "doc_id")]
    assert by[4] == [("w", "metadata.source_count"), ("w", "doc_id")]
    assert by[5] == [("e", "metadata.category"), ("w", "metadata.source_count"), ("w", "doc_id")]
    assert by[6][0] == ("e", "metadata") and by[7][:2] == [("e", "doc_id"), ("e", "content")] and by[99][0] == ("e", "doc_id")
    loose = validation.check_documents(validation.parse_documents(raw), strict=False)
    assert {r["row_index"] for r in loose.where("valid").collect()} == {1, 3, 4, 5}
    stats = validation.validation_stats(checked).first()
    assert (stats["total_raw_docs"], stats["valid_docs"], stats["unique_keyword_count"]) == (9, 3, 1)
    assert validation.validation_stats(checked.limit(0)).first()["error_count"] == 0
    kept = {r["row_index"]: r["metadata"] for r in validation.valid_documents(checked).collect()}
    assert kept[3]["source_count"] == 1 and kept[4]["source_image_ids"] == ["a"]


def test_record_ids(spark):
    rows = spark.createDataFrame([(0, "a_q1", None), (1, "a_q1", "mine"), (2, "", None), (3, "bad", None)], "row_index long, image_id string, base_image_id string")
    got = {r["row_index"]: r for r in validation.check_record_ids(rows).collect()}
    assert [got[i]["problem"] for i in range(4)] == [None, "duplicate", "missing", "format"]
    assert got[0]["base_image_id"] == "a" and got[0]["question_id"] == "q1" and got[1]["base_image_id"] == "mine"
    with pytest.raises(ValueError, match="row 1"):
        validation.require_valid_ids(rows)


def test_rewriting(spark):
    rows = spark.createDataFrame([(0, "i0_q1", "phở", "Món này là gì?", "c"), (1, "i1_q1", "phở", "Phở là gì?", "c"), (2, "i2_q1", "phở", "Ai ăn?", "cap"), (3, "i3_q1", "phở", "Khi nào?", "cap"), (4, "i4_q1", "phở", "Ở đâu?", " "), (5, "i5_q1", "phở", "Vì sao?", "cap")], "row_index long, image_id string, keyword string, question string, vision_caption string")
    from tesserine.functions import text as T

    cache = rows.where("row_index = 2").select(T.rewrite_key("vision_caption", "question").alias("cache_key"), F.lit("Ai ăn phở?").alias("standalone_question"))
    existing = spark.createDataFrame([(7, "i5_q1", "Vì sao?", "Vì sao ăn phở?", "llm"), (8, "i3_q1", "changed", "x", "llm")], "row_index long, image_id string, question string, standalone_question string, rewrite_method string")
    done, left = jobs.build_standalone_questions(rows, existing=existing, cache=cache)
    got = {r["row_index"]: (r["rewrite_method"], r["standalone_question"]) for r in done.collect()}
    assert got == {0: ("template", "Phở là gì?"), 1: ("already_standalone", "Phở là gì?"), 2: ("llm", "Ai ăn phở?"), 3: ("unchanged", "Khi nào?"), 4: ("unchanged", "Ở đâu?"), 5: ("llm", "Vì sao ăn phở?")}
    assert [r["row_index"] for r in left.collect()] == [3]
    done, failed = jobs.build_standalone_questions(rows, existing=existing, cache=cache, rewriter=KeywordRewriter())
    assert {r["row_index"]: r["standalone_question"] for r in done.collect()}[3] == "phở: Khi nào?" and failed.count() == 0
    stats = rewriting.rewrite_stats(done).first()
    assert stats["llm_count"] == 3 and stats["caption_coverage"] == 0.8333
    assert rewriting.rewrite_stats(done.limit(0)).first()["total_questions"] == 0


def test_parse_rewrites(spark):
    df = spark.createDataFrame([(1, '```json\n[{"index": 0, "standalone_question": " a? "}, {"index": 1, "standalone_question": ""}, {"standalone_question": "b"}]\n```'), (2, "not json"), (3, None)], "batch int, answer string")
    assert [(r["batch"], r["index"], r["standalone_question"]) for r in rewriting.parse_rewrites(df).collect()] == [(1, 0, "a?")]


def results(spark):
    queries = spark.createDataFrame([(str(i), k, "c") for i, k in enumerate(["áo dài", "áo dài", "phở", "", "x y"])], "id string, expected_keyword string, expected_category string")
    hits = spark.createDataFrame([("0", 1, "d", "nón", "c", "", 0.9, 0.1), ("0", 2, "e", "áo dài cách tân", "d", "", 0.8, 0.2), ("1", 1, "d", "nón", "e", "", 0.7, 0.3), ("2", 1, "f", "bún", "c", "", 0.6, 0.4), ("3", 1, "f", "bún", "c", "", 0.5, 0.5)], "id string, rank int, doc_id string, keyword string, category string, subcategory string, score double, distance double")
    return evaluation.evaluate(queries, hits, k=5).withColumn("row_index", F.col("id").cast("long"))


def test_evaluation(spark):
    r = results(spark)
    got = {x["id"]: x for x in r.collect()}
    assert got["0"]["hit_keyword_at_k"] and not got["0"]["hit_keyword_at_1"] and got["0"]["rr_keyword"] == 0.5
    assert got["4"]["retrieved"] == [] and got["4"]["top1_score"] is None and not got["3"]["hit_keyword_at_k"]
    s = evaluation.summarize(r, k=5).first()
    assert (s["total"], s["no_result_count"], s["topk_keyword_accuracy"], s["mrr_keyword"], s["top1_category_accuracy"]) == (5, 1, 0.2, 0.1, 0.6)
    empty = evaluation.summarize(r.limit(0), k=5).first()
    assert empty["topk_keyword_accuracy"] == 0.0 and empty["avg_top1_score"] is None
    missed = evaluation.misses(r)
    assert missed.count() == 4
    assert {(x["expected_keyword"], x["keyword"], x["n"]) for x in evaluation.wrong_keywords(missed).collect()} == {("áo dài", "nón", 1), ("phở", "bún", 1), ("", "bún", 1)}
    assert [x["id"] for x in evaluation.representative_cases(missed, 3).orderBy("position").collect()] == ["1", "2", "3"]
    assert "| áo dài | 1 |" in evaluation.render_error_report(missed)


def test_gate(spark):
    ok = spark.sql("SELECT 0 AS error_count, 0 AS invalid_docs, 2 AS warning_count")
    build = spark.sql("SELECT false AS dry_run, 3 AS total_documents, 3 AS count_after")
    summary = spark.sql("SELECT 0 AS no_result_count, 0.9D AS topk_keyword_accuracy, 0.95D AS topk_category_accuracy, 0.5D AS top1_keyword_accuracy")
    r = evaluation.gated_report(ok, build, summary, summary.limit(0)).first()
    assert r["overall_status"] == "PASS" and r["filtered_status"] == "FAIL" and len(r["recommendations"]) == 2
    assert "| Index build | PASS |" in evaluation.render_gated_report(evaluation.gated_report(ok, build, summary, summary))
    r = evaluation.gated_report(ok.limit(0), build, summary, summary).first()
    assert r["overall_status"] == "FAIL" and r["validation_status"] == "FAIL"


def test_evalset(spark):
    rows = spark.createDataFrame([(i, f"im{i % 7}", f"q{i}", f"Question {i % 5}", None, ["a", "b", "c"][i % 3], ["x", "y"][i % 2] if i else "", "s") for i in range(30)], "row_index long, image_id string, question_id string, question string, standalone_question string, keyword string, category string, subcategory string")
    made = evalset.build_records(rows, "val")
    assert made.count() == 29 and made.where("id = 'im1_q1'").count() == 1
    docs = spark.createDataFrame([("A",), ("b ",), (None,)], "keyword string")
    kept = evalset.deduplicate(evalset.covered(made, docs))
    assert kept.count() == 19 and kept.agg(F.max("row_index")).first()[0] < 30
    assert evalset.sample(kept, max_per_category=3, max_per_split=5).groupBy("expected_category").count().where("count > 3").count() == 0
    assert evalset.sample(kept, max_per_split=4).count() == 4
    with pytest.raises(ValueError):
        evalset.covered(made, docs.where("keyword is null"))
    split = evalset.train_test_val(rows, "category", "row_index").where("category = 'x'").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 11, "test": 1, "val": 2}


def test_preparation(spark):
    items = spark.createDataFrame([json.dumps({
        "row_index": i, "image_path": f"/data/am_thuc/pho/{name}", "keyword": "phở", "image_analysis": {"overall_description": "tô phở", "main_objects": ["tô", "bún"], "visual_details": {"composition": "giữa"}},
        "cultural_context": {"historical_context": "xưa", "regional_significance": "bắc"},
        "questions": [{"question_id": 1, "question": "Đây là gì?", "answer": "phở", "detailed_explanation": "món ăn"}, {"question_id": 2, "question": "Ở đâu?", "answer": "Hà Nội", "detailed_explanation": None}],
    }) for i, name in enumerate(["1.jpg", "2.jpg", "1.jpg"])], "string")
    schema = "row_index long, image_path string, keyword string, image_analysis struct<overall_description: string, main_objects: array<string>, visual_details: struct<composition: string>>, cultural_context struct<historical_context: string, regional_significance: string>, questions array<struct<question_id: string, question: string, answer: string, detailed_explanation: string, additional_context: struct<symbolism: variant>>>"
    items = items.select(F.from_json("value", schema).alias("j")).select("j.*")
    index = spark.sql("SELECT map('am_thuc', named_struct('subcategories', map('pho', named_struct('files', array('1.jpg', '2.jpg', '3.jpg')))), 'other', named_struct('subcategories', map('z', named_struct('files', array('9.jpg'))))) AS categories")
    records, documents = jobs.prepare(items, index)
    got = records.orderBy("image_id").collect()
    assert [r["image_id"] for r in got] == ["am_thuc|pho|1_q1", "am_thuc|pho|1_q2", "am_thuc|pho|2_q1", "am_thuc|pho|2_q2"]
    assert got[0]["vision_caption"] == "tô phở Đối tượng trong ảnh: tô, bún. Bố cục: giữa" and got[1]["answer_label"] == "Hà Nội."
    docs = documents.collect()
    assert len(docs) == 1 and docs[0]["source_image_ids"].split("|")[-1].endswith("_q2") and docs[0]["doc_id"].startswith("am_thuc|pho|phở|")
    row = spark.sql("SELECT array('b', 'a', null, ' a ', '') AS s").select(preparation.distinct_symbolism(F.col("s")).alias("x")).first()
    assert row["x"] == "a b"
    pairs = preparation.training_texts(spark.sql("SELECT * FROM VALUES ('', 'c', NULL, 'q', 'a'), ('d', 'x', 's', 'q', NULL) AS t (cultural_context, culture_context, standalone_question, question, answer)"))
    assert sorted(map(tuple, pairs.collect())) == [("c", "q", "a"), ("d", "s", "")]
    assert preparation.chat_texts(pairs.where("culture_context = 'c'")).first()["text"].endswith("[Ngữ cảnh]: c\n[Câu hỏi]: q<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n")
    numbers = spark.sql("SELECT explode(array('3', 'x', null, 'true', '2.0')) AS s").select(preparation.whole_number(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in numbers] == [3, 0, 0, 0, 2]


def test_metrics(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat on the mat"), (2, "", "x"), (3, "a b", "a b")], "i int, p string, r string")
    got = {r["i"]: r for r in metrics.rouge_n(df, ["i"], "p", "r").collect()}
    assert abs(got[1]["rouge1"] - 10 / 11) < 1e-9 and got[2]["rouge1"] == 0 and got[3]["rouge2"] == 1
    got = {r["i"]: r["l"] for r in df.select("i", metrics.rouge_l(F.col("p"), F.col("r")).alias("l")).collect()}
    assert abs(got[1] - 10 / 11) < 1e-9 and got[2] == 0
    assert metrics.longest_common(list("abcbdab"), list("bdcaba")) == 4
    same = spark.createDataFrame([("a b c d e", "a b c d e")], "p string, r string")
    assert metrics.corpus_bleu(same, "p", "r").first()["bleu"] == 1.0 and metrics.corpus_bleu(df, "p", "r").first()["bleu"] >= 0
    assert metrics.corpus_rouge(same, "p", "r").first()["rougeL"] == 1.0
    met = metrics.align(spark.sql("SELECT 1 AS row_index, 'p' AS prediction"), spark.sql("SELECT explode(array(1, 2)) AS row_index, 'r' AS reference"))
    assert met.count() == 1
    runs = metrics.compare_runs({"a": spark.sql("SELECT 0.5D AS m"), "b": spark.sql("SELECT 1 AS other")}, ["m"])
    assert {r["run"]: r["m"] for r in runs.collect()} == {"a": 0.5, "b": 0.0}


def test_sources(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "b": "e\\u0301"}\n\n{"a": 2}\n', encoding="utf-8")
    got = readers.read_jsonl_numbered(spark, str(path), "a int, b string")
    assert [(r["row_index"], r["a"]) for r in got.orderBy("row_index").collect()] == [(1, 1), (3, 2)]
    assert readers.composed(got, "b").where("row_index = 1").first()["b"] == "é"
    assert readers.read_jsonl(spark, str(path), "a int").count() == 2
    path.write_text('{"a": 1}\n{bad\n', encoding="utf-8")
    with pytest.raises(ValueError, match="line 2"):
        readers.read_jsonl_numbered(spark, str(path), "a int")
    assert readers.read_jsonl(spark, str(path), "a int", strict=False).where("_corrupt is not null").count() == 1
    out = str(tmp_path / "out")
    assert sinks.write_jsonl(spark.range(5), out) == 5 and spark.read.json(out).count() == 5
    assert readers.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    sinks.replace_table(spark.range(3), str(tmp_path / "t"))
    sinks.replace_table(spark.read.parquet(str(tmp_path / "t")).where("id > 0"), str(tmp_path / "t"))
    assert readers.read_or_empty(spark, str(tmp_path / "t"), "id long").count() == 2
    sinks.write_stats(spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1, "b": None}
    row = readers.read_json_or_missing(spark, str(tmp_path / "s.json"), "a int").first()
    assert row["a"] == 1 and not row["input_missing"] and readers.read_json_or_missing(spark, str(tmp_path / "no"), "a int").first()["input_missing"]
    assert sinks.delete(spark, str(tmp_path / "t")) and not sinks.delete(spark, str(tmp_path / "t"))


def test_index_and_answers(spark):
    raw = spark.createDataFrame([(i, json.dumps({"doc_id": f"am_thuc|s|{i}", "content": f"{k} là món ăn nổi tiếng. Rất ngon.", "metadata": document(keyword=k)})) for i, k in enumerate(["phở", "bún chả", "nem rán"])], "row_index long, raw string")
    valid, issues, stats = jobs.validate_knowledge_base(raw)
    embedder = HashEmbedder(256)
    index = jobs.build_vector_index(valid, embedder)
    assert index.count() == 3 and stats.first()["error_count"] == 0
    requests = spark.createDataFrame([("1", "bún chả là gì", " ", None, None), ("2", "x", "phở là món gì", "am_thuc", None), ("3", "phở", None, "other", None)], "query_id string, question string, normalized_question string, category string, keyword string")
    got = {r["query_id"]: r for r in jobs.answer(requests, index, embedder, EchoGenerator(), jobs.Settings(threshold=0.1)).collect()}
    assert got["1"]["answer"].lower().startswith("bún chả") and got["2"]["retrieval_query"] == "phở là món gì" and got["3"]["context_block"] == ""
    queries = spark.createDataFrame([("e1", "nem rán là gì", "nem rán", "am_thuc")], "id string, question string, expected_keyword string, expected_category string")
    found, summary = jobs.evaluate_retrieval(queries, index, embedder, use_category_filter=True, threshold=0.0)
    assert summary.first()["top1_keyword_accuracy"] == 1.0
    again = jobs.build_vector_index(valid.limit(1), embedder, index=index)
    assert again.count() == 3
    records = spark.createDataFrame([("r", "phở là gì", "", "am_thuc", "phở", 5)], "query_id string, question string, standalone_question string, category string, keyword string, extra int")
    assert jobs.top_contexts(records, index, embedder).first()["retrieve_context"].startswith("phở")
    timed = jobs.answer_with_timing(requests, index, embedder, EchoGenerator(), jobs.Settings(threshold=0.1, serial=True)).collect()
    assert {r["query_id"]: r["answer"] for r in timed} == {k: r["answer"] for k, r in got.items()}
    assert all(r["timing"]["total_seconds"] >= r["timing"]["rag_seconds"] > 0 for r in timed)
    assert got["3"]["contexts"] == [] and got["3"]["filters"]["category"] == "other"
    assert [c["position"] for c in got["2"]["contexts"]] == list(range(1, len(got["2"]["contexts"]) + 1)) and got["2"]["contexts"][0]["content"].startswith("phở")
    plain = jobs.answer(requests, index, embedder, EchoGenerator(), jobs.Settings(threshold=0.1, debug=False))
    assert plain.columns == ["query_id", "retrieval_query", "filters", "answer"]
    asked = requests.select("query_id", F.col("question").alias("query"))
    assert jobs.search_contents(asked, index, embedder, k=1).where("query_id = '1'").first()["content"].startswith("bún chả")


def _client(path):
    """Answers in capitals; fails at its first request and whenever a question says so."""

    def connect():
        def ask(items):
            with open(path, "a") as f:
                f.write(f"{len(items)}\n")
            with open(path) as f:
                if len(f.readlines()) == 1 or any("fail" in x["question"] for x in items):
                    raise ConnectionError
            return {x["index"]: x["question"].upper() for x in items if "skip" not in x["question"]}

        return ask

    return connect


def test_batch_rewriter(spark, tmp_path):
    texts = ["a", "b", "skip", " c ", "fail", "d", "e"]
    rows = spark.createDataFrame([(i, "k", x, None) for i, x in enumerate(texts)], "row_index long, keyword string, question string, vision_caption string").coalesce(1).sortWithinPartitions("row_index")
    log = tmp_path / "requests"
    rewriter = BatchRewriter(_client(str(log)), size=1, tries=2, wait=0.0, pause=0.0)
    got = {r[0]: r[1] for r in rewriter.rewrite(rows).collect()}
    assert got == {0: "A", 1: "B", 2: None, 3: "C", 4: None, 5: "D", 6: "E"}
    log.unlink()
    assert sorted(r[1] for r in BatchRewriter(_client(str(log)), size=4, wait=0.0, pause=0.0).rewrite(rows.where("question <> 'fail'")).collect() if r[1]) == ["A", "B", "C", "D", "E"]
    assert log.read_text().split() == ["4", "4", "2"]
    done = rewriting.apply_model(rows.withColumns({"standalone_question": F.col("question"), "rewrite_method": F.lit("pending"), "rewrite_source": F.lit(None).cast("string")}), rows, BatchRewriter(lambda: None))
    assert {r["rewrite_method"] for r in done.collect()} == {"failed"}
    with pytest.raises(ValueError):
        BatchRewriter(lambda: None, size=0)


def test_scorer_and_devices(spark):
    df = spark.createDataFrame([("nem rán ngon", "nem rán ngon"), ("nem", "nem phở"), ("", "x"), (None, None)], "p string, r string")
    scorer = GreedyMatchScorer()
    each = scorer.score(df, "p", "r").collect()
    assert tuple(round(x, 9) for x in tuple(each[0])[2:]) == (1.0, 1.0, 1.0) and round(each[1]["precision"], 9) == 1.0 and each[1]["recall"] < 1.0
    assert tuple(each[2])[2:] == tuple(each[3])[2:] == (0.0, 0.0, 0.0)
    means = metrics.model_scores(df, "p", "r", scorer).first()
    assert means["precision"] == 0.5 and metrics.model_scores(df.limit(0), "p", "r", scorer).first()["f1"] == 0.0
    assert device("CPU") == "cpu" and device(None) in ("cpu", "cuda", "mps")
    assert (dtype("auto", "cuda"), dtype(None, "cpu"), dtype("BF16", "cpu")) == ("float16", "float32", "bfloat16")
    with pytest.raises(ValueError):
        dtype("int3", "cpu")


def test_nested_and_unwrapped(spark):
    df = spark.sql("SELECT named_struct('a', named_struct('b', 1), 'n', CAST(NULL AS INT)) AS summary, true AS input_missing")
    values = [readers.nested(df, p, F.lit(-1)) for p in ("summary.a.b", "summary.n", "summary.x", "summary.a.b.c", "none")]
    assert tuple(df.select(*(v.alias(str(i)) for i, v in enumerate(values))).first()) == (1, -1, -1, -1, -1)
    assert readers.unwrapped(df).columns == ["a", "n", "input_missing"] and readers.unwrapped(spark.range(1)).columns == ["id"]


def test_rouge_l_equals_the_table_of_prefixes(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(" ".join(rng.choice(list("abcde"), rng.integers(0, 90))) for _ in range(2)) for _ in range(150)]

    def model(a, b):
        a, b = a.split(), b.split()
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        p, r = (row[-1] / len(x) if x else 0.0 for x in (a, b))
        return 2 * p * r / (p + r) if p + r else 0.0

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", metrics.rouge_l(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [round(r["s"] or 0.0, 9) for r in got] == [round(model(*p), 9) for p in pairs]


def test_a_search_sends_each_row_a_few_times(spark):
    """Rows go once to each tile of the other side; how many tiles there are grows with the square of the rows only beyond the largest tiles."""
    for n, rows, cols in ((500, 1, 1), (5_000, 5, 1), (40_000, 12, 2), (600_000, 19, 19)):
        asked = spark.range(n).select(F.lit("x").alias("want"), F.array_repeat(F.lit(1.0), 64).alias("v"))
        found = retrieval._sizes(asked, asked, retrieval.TILES).first()
        assert (found["rows"], found["cols"]) == (rows, cols)
    long = spark.range(40_000).select(F.lit("x").alias("want"), F.array_repeat(F.lit(1.0), 512).alias("v"))
    assert retrieval._sizes(long, long, retrieval.TILES).first()["cols"] == 10  # tiles of 4,096, as long vectors take room


def test_bleu_shuffles_sums_only(spark):
    """Counted where rows are; the same as n-grams that meet by a grouped count."""
    pairs = [("a b a b c", "a b c a b"), ("x", "x y"), ("", "q"), (None, None)]
    df = spark.createDataFrame(pairs, "p string, r string")
    assert "Generate" not in metrics.corpus_bleu(df, "p", "r")._jdf.queryExecution().executedPlan().toString()
    for n, hits in ((1, 5), (2, 3), (3, 1), (4, 0)):
        assert metrics.clipped("a b a b c".split(), "a b c a b".split(), 4)[3 * (n - 1) : 3 * n] == [hits, 6 - n, 6 - n]


def test_an_exact_search_has_as_many_tiles_whatever_its_size(spark, monkeypatch):
    """So that each row is sent equally often; filters share the tiles, and large vectors make more of them."""
    made, plain = [], retrieval._sizes
    monkeypatch.setattr(retrieval, "_sizes", lambda *x: made.append(plain(*x)) or made[-1])
    vectors = lambda n, more: spark.range(n).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.array_repeat(F.lit(1.0), 64).cast("array<float>").alias("embedding"), *more)
    for n in (12_000, 40_000, 300_000):
        df = vectors(n, ())
        retrieval.search(df, df, k=3)
    assert {(r["rows"], r["cols"]) for sizes in made for r in sizes.collect()} == {retrieval.GRID}
    df = vectors(60_000, [F.when(F.col("id") % 10 == 0, "few").otherwise("most").alias("kind")])
    retrieval.search(df, df, k=3, by=("kind",))
    assert sorted((r["rows"], r["cols"]) for r in made[-1].collect()) == [(1, 1), (6, 3)]
    monkeypatch.setattr(retrieval, "LARGE", 4 * 64 * 5_000)
    df = vectors(40_000, ())
    retrieval.search(df, df, k=3)
    assert tuple(made[-1].select("rows", "cols").first()) == (8, 8)


def test_blocks_of_a_tile_give_the_best_of_all(monkeypatch):
    rng = np.random.default_rng(3)
    table = lambda v: pa.table({"id": pa.array(rng.permutation(len(v))), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    q, d = (table(rng.integers(-1, 2, (n, 4)).astype(float)) for n in (23, 61))  # many ties, some zero vectors
    a, b = retrieval.unit_rows(q), retrieval.unit_rows(d)
    ids = d.column("id").to_numpy()
    for block, part, k in ((4096, 128, 5), (7, 5, 5), (3, 4, 5), (7, 5, 100)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "PART", part)
        got = {}
        for i, j, s in zip(*retrieval.nearest(q, d, k), strict=True):
            got.setdefault(int(i), []).append((-float(s), int(ids[j])))
        want = {i: sorted((-round(float(a[i] @ b[j]), 9), int(ids[j])) for j in range(len(b)) if np.isfinite(a[i] @ b[j]))[:k] for i in range(len(a))}
        assert got == {i: w for i, w in want.items() if w}

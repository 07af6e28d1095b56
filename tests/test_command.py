"""The jobs from a shell, one after the other over files."""

import json

import pytest

from tesserine.plans import command

KEYWORDS = ["phở bò", "bún chả", "nem rán", "Banh Mi"]


@pytest.fixture
def run(spark, tmp_path):
    def job(*argv):
        return command.main([str(tmp_path / x[1:]) if x.startswith("@") else x.replace("=@", f"={tmp_path}/") for x in argv], spark)

    return job


def lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


def read(path):
    return [json.loads(x) for part in sorted(path.glob("part-*")) for x in part.read_text().splitlines()]


def test_jobs(spark, tmp_path, run):
    def document(i, k):
        return {"doc_id": f"am_thuc|s|{i}", "content": f"{k} là món ăn nổi tiếng của nhiều vùng. Rất ngon.", "metadata": {"keyword": k, "category": "am_thuc", "subcategory": "s", "base_image_id": "b", "source_image_ids": ["a"], "source_count": 1}}

    kb = [document(i, k) for i, k in enumerate(KEYWORDS)]
    lines(tmp_path / "kb.jsonl", kb)
    lines(tmp_path / "bad.jsonl", [*kb, {"doc_id": "", "content": "x"}])
    assert run("validate", "@kb.jsonl", "--stats=@valid.json") == 0 and run("validate", "@bad.jsonl") == 1
    told = json.loads((tmp_path / "valid.json").read_text())
    assert told["error_count"] == 0 and told["categories"] == {"am_thuc": 4} and list(told["top_keywords"]) == KEYWORDS

    assert run("build", "@bad.jsonl", "@index") == 1 and not (tmp_path / "index").exists()
    assert run("build", "@kb.jsonl", "@index", "--stats=@build.json", "--dry-run") == 0 and not (tmp_path / "index").exists()
    assert json.loads((tmp_path / "build.json").read_text())["dry_run"]
    assert run("build", "@kb.jsonl", "@index", "--limit=2") == 0
    assert run("build", "@kb.jsonl", "@index", "--stats=@build.json") == 0
    told = json.loads((tmp_path / "build.json").read_text())
    assert (told["total_documents"], told["count_before"], told["count_after"], len(told["examples"])) == (4, 2, 4, 4) and told["examples"][0]["keyword"] == "phở bò"

    asked = [{"image_id": f"i{i}", "question_id": f"i{i}_q1", "question": f"{k} là gì?", "standalone_question": f"{k} là gì?", "keyword": k, "category": "am_thuc", "subcategory": "s"} for i, k in enumerate(KEYWORDS)]
    lines(tmp_path / "val.jsonl", [*asked, asked[0]])
    lines(tmp_path / "test.jsonl", [asked[2] | {"keyword": "không có"}, asked[1]])
    assert run("eval-queries", f"val={tmp_path}/val.jsonl,test={tmp_path}/test.jsonl", "@kb.jsonl", "@queries", "--stats=@queries_stats") == 0
    assert [r["source_split"] for r in read(tmp_path / "queries")] == ["val"] * 4 + ["test"]
    told = json.loads((tmp_path / "queries_stats" / "val.json").read_text())
    assert [told[f"{x}_count"] for x in ("raw", "valid", "covered", "deduplicated", "sampled")] == [5, 5, 5, 4, 4]

    assert run("evaluate", "@queries", "@index", "@results", "--stats=@retrieval.json", "--use-category-filter", "--k=1") == 0
    assert json.loads((tmp_path / "retrieval.json").read_text())["total"] == 5
    (tmp_path / "wrapped.json").write_text(json.dumps({"summary": {"no_result_count": 0, "topk_keyword_accuracy": 1.0, "topk_category_accuracy": 1.0, "top1_keyword_accuracy": 1.0}}))
    lines(tmp_path / "odd", [asked[0] | {"id": "odd", "expected_keyword": "không có", "expected_category": "am_thuc"}])
    assert run("evaluate", "@odd", "@index", "@odd_results", "--stats=@odd.json") == 0
    assert run("misses", "@odd_results", "@missed", "--wrong=@wrong") == 0 and len(read(tmp_path / "missed")) == 1
    assert [r["rank"] for r in read(tmp_path / "wrong")] == list(range(1, 1 + len(read(tmp_path / "wrong")))) != []
    assert run("errors", "@odd_results", "@errors.md", "--n=5") == 0 and "Misses: 1" in (tmp_path / "errors.md").read_text()
    with pytest.raises(ValueError, match="has no"):
        spark.range(1).write.parquet(str(tmp_path / "other"))
        run("misses", "@other", "@none")

    paths = ["@valid.json", "@build.json", "@wrapped.json", "@wrapped.json"]
    assert run("report", *paths, "@report.md", "--fail-on-error") == 0 and "Overall: **PASS**" in (tmp_path / "report.md").read_text()
    paths[1] = "@missing.json"
    assert run("report", *paths, "@report.md") == 0 and run("report", *paths, "@report.md", "--fail-on-error") == 1

    lines(tmp_path / "raw.jsonl", [{"image_id": f"b{i}_q1", "base_image_id": f"b{i}", "question_id": "q1", "question": "Món này là gì?", "keyword": k, "category": "am_thuc", "vision_caption": "ảnh"} for i, k in enumerate(KEYWORDS)])
    assert run("questions", "@raw.jsonl", "@questions", "--stats=@questions.json") == 0
    assert run("questions", "@raw.jsonl", "@questions") == 0 and spark.read.parquet(str(tmp_path / "questions")).count() == 4
    assert len(json.loads((tmp_path / "questions.json").read_text())["examples"]) == 4
    assert run("top-contexts", "@val.jsonl", "@index", "@contexts") == 0
    assert [r["retrieve_context"][:3] for r in sorted(read(tmp_path / "contexts"), key=lambda r: r["row_index"])][:3] == ["phở", "bún", "nem"]

    pytest.importorskip("yaml")
    (tmp_path / "map.yaml").write_text("keyword_normalization:\n  banh mi: bánh mì\n")
    plain = asked + [asked[0] | {"keyword": "Plain"}] * 2
    lines(tmp_path / "plain.jsonl", plain)
    assert run("clean", "@plain.jsonl", "@map.yaml", "@cleaned", "--report=@cleaned.json") == 0
    told = json.loads((tmp_path / "cleaned.json").read_text())
    assert told["unmapped_keywords"] == [{"keyword_raw": "Plain", "n": 2}] and [x["keyword"] for x in told["changed_examples"]][-1] == "bánh mì"
    assert {r["keyword"] for r in read(tmp_path / "cleaned")} >= {"bánh mì", "phở bò"}
    assert run("clean", "@kb.jsonl", "@map.yaml", "@kb_cleaned", "--mode=knowledge", "--dry-run") == 0 and not (tmp_path / "kb_cleaned").exists()


def test_bad_options(spark, run):
    with pytest.raises(SystemExit):
        run("validate")
    with pytest.raises(SystemExit):
        run("no-such-job")

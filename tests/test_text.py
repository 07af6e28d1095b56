"""Column functions against a plain Python model, over random Unicode texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tesserine.functions import fixed
from tesserine.functions import text as T
from tesserine.functions import vectors as V

ALPHABET = list("aAbzZ09 _-.|,!?") + list("áàạảãăắâấđĐêếôốơớưứỳÁĂÂ") + ["\u00a0", "\t", "\n", "\u0301", "ü", "ß", "é"]


def model_spaces(s):
    return " ".join((s or "").split())


def model_plain(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s or "") if unicodedata.category(c) != "Mn")
    return s.replace("đ", "d").replace("Đ", "D")


def model_slug(s):
    return re.sub("[^a-z0-9]+", "_", model_plain(s).lower()).strip("_")


def model_key(s):
    k = model_spaces(re.sub(r"[^a-z0-9\s]+", " ", model_plain(model_spaces(s).lower())))
    for ending in fixed.KEY_SUFFIXES:
        if k.endswith(ending):
            k = k[: -len(ending)].strip()
    return k


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(600)]
    return made + [m + e for m in made[:40] for e in (" tet", " viet nam", " Culture", "TET")] + ["", None, "bánh chưng Tết", "Đàn bầu", "  x  "]


@pytest.mark.parametrize(("column", "model"), [(T.normalize_spaces, model_spaces), (T.strip_diacritics, model_plain), (T.slug, model_slug), (T.lookup_key, model_key), (T.word_count, lambda s: len((s or "").split())), (T.strip_accents, lambda s: model_plain((s or "").replace("đ", "\x01").replace("Đ", "\x02")).replace("\x01", "đ").replace("\x02", "Đ"))])
def test_equals_model(spark, texts, column, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("out", column("t"))
    assert [(t, r["out"]) for t, r in zip(texts, df.orderBy("i").collect(), strict=True)] == [(t, model(t)) for t in texts]


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("keyword", "question", "expected"), [
    ("bánh chưng", "Đây là gì?", "Bánh chưng là gì?"),
    ("phở", "Món này có gì?", "Phở có gì?"),
    ("áo dài", "Trong hình có gì?", "Trong hình về áo dài có gì?"),
    ("áo dài", "Mô tả chi tiết về hình ảnh.", "Mô tả chi tiết về áo dài."),
    ("áo dài", "Mô tả chi tiết về hình ảnh đẹp", None),
    ("áo dài", "Lễ này có gì?", "Áo dài có gì?"),
    ("áo dài", "Kiến trúc này có gì?", None),
    ("áo dài", "Áo dài này là gì?", None),
    ("", "Đây là gì?", None),
    ("$1\\E", "Đây là gì?", "$1\\E là gì?"),
])
def test_rewrite_question(spark, keyword, question, expected):
    assert one(spark, T.rewrite_question("k", "q"), k=keyword, q=question) == expected


def test_subject(spark):
    assert one(spark, T.names_subject("k", "q"), k="banh chung Tet", q="Ý nghĩa của bánh chưng là gì?")
    assert not one(spark, T.names_subject("k", "q"), k="banh chung Tet", q="Bánh này?")
    assert one(spark, T.keyword_subject("k"), k="đàn bầu viet nam") == ["an", "bau"]


def test_replace_keyword(spark):
    assert one(spark, T.replace_keyword("t", "r", "n"), t="what is AO DAI?", r="ao dai", n="áo dài") == "What is áo dài?"
    assert one(spark, T.replace_keyword("t", "r", "n"), t="a.b $x", r="a.b", n="c$1\\") == "C$1\\ $x"
    assert one(spark, T.replace_keyword("t", "r", "n"), t="same", r="same", n="same") == "same"


def test_sanitize(spark):
    got = one(spark, T.postprocess_answer("t"), t="Trả lời: Hình ảnh thể hiện kẹo dừa, một đặc sản nổi tiếng.")
    assert got == "Kẹo dừa là một đặc sản nổi tiếng."
    got = one(spark, T.postprocess_answer("t"), t="HÌNH ẢNH cho thấy nem nướng. Món này ngon .")
    assert "ình ảnh" not in got.lower() and "nem nướng" in got.lower() and got.endswith("ngon.")
    assert one(spark, T.postprocess_answer("t"), t=" ") == ""


def model_sanitized(text):
    def without(pattern, s, by=""):
        return re.sub(pattern, by, s, flags=re.IGNORECASE)

    def unseen(s):
        for pattern in fixed.VISUAL_PHRASES:
            s = without(pattern, s)
        return model_spaces(s).strip(" ,;:-")

    whole = (text or "").strip()
    kept = []
    for s in re.split(rf"(?<=[{fixed.SENTENCE_ENDS}])\s+", whole.replace("\n", " ")):
        s = unseen(without(fixed.LEADING_VISUAL, s.strip()).strip())
        s = without(fixed.APPOSITION, without(fixed.LEADING_CLASSIFIER, s).strip(), r"\1 là một ").strip()
        if s and not re.search(fixed.VISUAL_TERMS, s[0].upper() + s[1:], re.IGNORECASE):
            kept.append(s[0].upper() + s[1:])
    joined = re.sub(r"\.{2,}", ".", re.sub(r"\s+([,.!?])", r"\1", " ".join(kept)))
    return joined or unseen(without(fixed.LEADING_VISUAL, whole).strip())


def model_answer(text):
    text = (text or "").strip()
    for prefix in fixed.ANSWER_PREFIXES:
        text = text[len(prefix):].strip() if text.startswith(prefix) else text
    return model_sanitized(text)


def test_sanitizer_equals_model(spark):
    rng = random.Random(8)
    parts = ["hình ảnh", "Hình ảnh", "BỨC ẢNH", "ảnh", "ảnh chụp", "này", "đó", "cho thấy", "thể hiện", "mô tả", "trong", "Trong", "qua", "hình", "có thể", "nhìn thấy", "thấy", "rằng", "một", "Một", "các", "đĩa", "món", "chiếc",
             "phở bò", "áo dài", "đẹp", "là", "của", "ăn", "ớt", ",", ", một", ".", ". ", "..", "!", "? ", "。", "\n", "\t", " - ", ";", ":", "Trả lời:", "Câu trả lời:", "Answer:"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["", None, " "]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.sanitize_answer("t").alias("s"), T.postprocess_answer("t").alias("p")).orderBy("i").collect()
    for text, r in zip(texts, got, strict=True):
        assert (text, r["s"], r["p"]) == (text, model_sanitized(text), model_answer(text))


def test_sentences_and_chunks(spark):
    assert tuple(one(spark, T.complete_sentences("t"), t="Nem nướng là món ăn Việt Nam. Món này thường")) == ("Nem nướng là món ăn Việt Nam. ", "Món này thường")
    assert tuple(one(spark, T.complete_sentences("t"), t="no end")) == ("", "no end")
    assert one(spark, T.display_chunks("t", leading_space=True), t="Kẹo dừa là đặc sản Bến Tre.") == [" Kẹo", " dừa", " là", " đặc", " sản", " Bến", " Tre."]


def test_matching_and_errors(spark):
    assert one(spark, T.keyword_matches("a", "e"), a="Áo dài  cách tân", e="áo dài")
    assert not one(spark, T.keyword_matches("a", "e"), a="áo", e="")
    for expected, found, kind in (("a b", "", "no_retrieved_keyword"), ("a b", "a b c", "keyword_variant_or_parent_child"), ("a b", "b c", "same_keyword_family"), ("a b", "c d", "semantic_neighbor")):
        assert one(spark, T.error_type("e", "t"), e=expected, t=found) == kind


def test_small_functions(spark):
    assert one(spark, T.strip_code_fence("t"), t="```json\n[1]\n```") == "[1]"
    assert one(spark, T.clean_optional("t"), t="  ") is None
    assert one(spark, T.escape_html("t"), t="<a href='x'>&") == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    assert [one(spark, T.percent("t"), t=x) for x in (0.12345, 0.5, 0.0, 1.0)] == ["12.35%", "50.00%", "0.00%", "100.00%"]
    assert one(spark, T.path_tail("t"), t="/a/b/c/d.jpg") == "b/c/d.jpg"
    assert one(spark, T.path_tail("t"), t="d.jpg") == "d.jpg"
    assert len(one(spark, T.rewrite_key("a", "b"), a="x", b="y")) == 40


def test_cosine(spark):
    row = spark.sql("SELECT array(3.0F, 4.0F) AS a, array(0.0F, 0.0F) AS z")
    got = row.select(V.cosine(F.col("a"), F.col("a")).alias("same"), V.cosine(F.col("a"), F.col("z")).alias("none"), V.normalized(F.col("a")).alias("n"), V.normalized(F.col("z")).alias("zn")).first()
    assert abs(got["same"] - 1) < 1e-12 and got["none"] is None and abs(got["n"][0] - 0.6) < 1e-6 and got["zn"] == [0.0, 0.0]

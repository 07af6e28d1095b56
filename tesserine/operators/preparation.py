"""Raw preparation: nested items to question records and knowledge documents, enrichment, index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .contexts import first_wins
from .evalset import train_test_val


def index_files(index: DataFrame, *, categories: list[str] | None = None) -> DataFrame:
    """category, subcategory, position, file from the nested index (categories map of subcategories map of files)."""
    cats = index.select(F.explode("categories").alias("category", "c")).where(F.col("category").isin(categories or fixed.CATEGORIES))
    subs = cats.select("category", F.explode("c.subcategories").alias("subcategory", "s"))
    return subs.select("category", "subcategory", F.posexplode("s.files").alias("position", "file"))


def split_files(files: DataFrame, *, seed: int | str = 42) -> DataFrame:
    return train_test_val(files, "subcategory", "file", seed=seed)


def join_items(files: DataFrame, items: DataFrame, *, path: str = "image_path") -> DataFrame:
    """Files with the item whose path ends alike (category, subcategory, name); the last of several items."""
    last = first_wins(items.withColumn("_tail", T.path_tail(path)), ["_tail"], [F.desc("row_index")])
    tail = F.concat_ws("/", "category", "subcategory", F.element_at(F.split("file", "/"), -1))
    return files.withColumn("_at", tail).join(last, F.col("_at") == F.col("_tail")).drop("_at", "_tail")


def caption(description: Column, objects: Column, composition: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return T.strip(F.concat(blank(description), F.lit(" Đối tượng trong ảnh: "), F.array_join(F.coalesce(objects, F.array().cast("array<string>")), ", "), F.lit(". Bố cục: "), blank(composition)))


def distinct_symbolism(texts: Column) -> Column:
    """The distinct non-blank texts, sorted and joined by spaces."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(texts, T.text_or_empty), lambda x: x != ""))), " ")


def symbolism(value: Column) -> Column:
    """A text, or a list of texts as one, from a variant."""
    listed = F.array_join(F.try_variant_get(value, "$", "array<string>"), ". ")
    return F.coalesce(listed, F.try_variant_get(value, "$", "string"))


def knowledge(history: Column, symbols: Column, region: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return T.strip(F.concat(F.lit("Lịch sử: "), blank(history), F.lit(". Ý nghĩa: "), blank(symbols), F.lit(". Vùng miền: "), blank(region)))


def question_records(items: DataFrame) -> DataFrame:
    """One row per question of joined items (category, subcategory, file, split, keyword, questions, caption and knowledge)."""
    base = F.concat_ws("|", "category", "subcategory", F.substring_index(F.element_at(F.split("file", "/"), -1), ".", 1))
    each = items.withColumn("base_image_id", base).select("*", F.posexplode("questions").alias("question_at", "q"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    question_id = F.concat(F.lit("q"), blank("q.question_id"))
    return each.select(
        "row_index", "question_at", "split", F.concat_ws("_", "base_image_id", question_id).alias("image_id"), "base_image_id", question_id.alias("question_id"),
        F.concat_ws("/", F.concat(F.lit("images_"), F.col("split")), "category", "subcategory", "file").alias("image_path"),
        "category", "subcategory", "keyword", F.col("q.question").alias("question"), F.lit("").alias("standalone_question"),
        F.col("knowledge").alias("cultural_context"), F.col("caption").alias("vision_caption"),
        T.strip(F.concat(blank("q.answer"), F.lit(". "), blank("q.detailed_explanation"))).alias("answer_label"), F.lit("").alias("rewrite_method"),
    )


def knowledge_documents(items: DataFrame) -> DataFrame:
    """Documents of the training items, one per distinct knowledge text of over 20 characters.

    The first item's fields stay; source ids are those of each item's last question.
    """
    spaced = T.normalize_spaces("knowledge")
    base = F.concat_ws("|", "category", "subcategory", F.substring_index(F.element_at(F.split("file", "/"), -1), ".", 1))
    last = F.concat(base, F.lit("_q"), F.coalesce(F.try_element_at("questions", F.lit(-1))["question_id"].cast("string"), F.lit("")))
    rows = items.where("split = 'train'").withColumn("_text", spaced).where(F.char_length("_text") > 20)
    rows = rows.withColumns({"_hash": T.short_hash("_text"), "_base": base, "_source": last})
    first = F.min_by(F.struct("keyword", "category", "subcategory", F.col("_base").alias("base_image_id"), F.col("_text").alias("text")), F.col("row_index"))
    grouped = rows.groupBy("_hash").agg(first.alias("f"), F.array_sort(F.collect_set("_source")).alias("ids"), F.min("row_index").alias("row_index"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = F.format_string("Chủ đề: %s\nDanh mục: %s\nNhóm con: %s\nNgữ cảnh văn hóa: %s", blank("f.keyword"), blank("f.category"), blank("f.subcategory"), F.col("f.text"))
    return grouped.select("row_index", F.concat_ws("|", blank("f.category"), blank("f.subcategory"), blank("f.keyword"), "_hash").alias("doc_id"), content.alias("content"), "f.keyword", "f.category", "f.subcategory", "f.base_image_id", F.array_join("ids", "|").alias("source_image_ids"), F.size("ids").alias("source_count"))


def question_counts(items: DataFrame, records: DataFrame) -> DataFrame:
    """category, before (questions of the raw items), and rows of the records per split."""
    before = items.groupBy("category").agg(F.sum(F.size("questions")).alias("before"))
    return before.join(records.groupBy("category").pivot("split", ["train", "test", "val"]).count(), "category", "left").fillna(0)


def embedding_documents(docs: DataFrame) -> DataFrame:
    """Documents with text and flat metadata for the index: lengths, and lists joined by ||."""
    listed = [f.name for f in docs.schema if f.dataType.typeName() == "array" and f.name != "embedding"]
    out = docs.withColumns({"text": F.col("content"), "content_length_chars": T.char_count("content"), "content_length_words": T.word_count("content")})
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "||") for c in listed})


def index_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, distinct keywords, least, most and mean length in words and characters; zeros without documents."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    words, chars = F.col("content_length_words"), F.col("content_length_chars")
    return docs.agg(
        F.count("*").alias("total_documents"), F.count_distinct(F.when(F.coalesce(F.col("keyword"), F.lit("")) != "", F.col("keyword"))).alias("unique_keyword_count"),
        zero(F.min(words)).alias("min_words"), zero(F.max(words)).alias("max_words"), F.round(F.coalesce(F.avg(words), F.lit(0.0)), 2).alias("avg_words"),
        zero(F.min(chars)).alias("min_chars"), zero(F.max(chars)).alias("max_chars"), F.round(F.coalesce(F.avg(chars), F.lit(0.0)), 2).alias("avg_chars"),
    )


def whole_number(c: Column) -> Column:
    """A number from anything: null and other text are 0."""
    return F.coalesce(F.try_to_number(F.trim(c.cast("string")), F.lit("S999999999999999999")).cast("bigint"), c.try_cast("double").cast("bigint"), F.lit(0))


def training_texts(records: DataFrame) -> DataFrame:
    """culture_context, standalone_question, answer_label_explainable of every record, each the first of its columns that isn't empty, or empty."""

    def first(*columns: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns if c in records.columns), F.lit(""))

    return records.select(first("cultural_context", "culture_context").alias("culture_context"), first("standalone_question", "question").alias("standalone_question"), first("answer_label", "answer").alias("answer_label_explainable"))


#: A chat as text; a model's own template takes its place.
CHAT = "<|im_start|>user\n%s<|im_end|>\n<|im_start|>assistant\n%s<|im_end|>\n"


def chat_texts(texts: DataFrame, form: str = CHAT) -> DataFrame:
    """``text``: the chat of each row of ``training_texts``, a user's request with its context and the answer."""
    asked = F.format_string(fixed.CHAT_REQUEST, "culture_context", "standalone_question")
    return texts.select(F.format_string(form, asked, "answer_label_explainable").alias("text"))


def loss_per_epoch(log: DataFrame) -> DataFrame:
    """epoch, train_loss, eval_loss: the least of each per whole epoch of a training log (epoch, loss, eval_loss)."""
    return log.groupBy(F.floor("epoch").alias("epoch")).agg(F.min("loss").alias("train_loss"), F.min("eval_loss").alias("eval_loss"))



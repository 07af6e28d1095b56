"""Streams give what batches give."""

from pyspark.sql import functions as F

from tesserine.functions import text as X
from tesserine.plugins import EchoGenerator
from tesserine.streaming import answers, events


def test_pop_sentences():
    assert answers.pop_sentences("A. B! C") == ("A. B! ", "C")
    assert answers.pop_sentences("A.") == ("", "A.")
    assert answers.pop_sentences("") == ("", "")


def test_events_fold(spark):
    made = spark.createDataFrame([("a", "q", ["c"], "p", "one two", None, 0.1), ("b", "q", ["c"], "p", "x", "broke", 0.1), ("c", "q", [], "p", "", None, 0.1)], "request_id string, retrieval_query string, contexts array<string>, prompt string, answer string, error string, seconds double")
    rows = answers.response_events(made)
    assert [r["type"] for r in rows.where("request_id = 'a'").orderBy("seq").collect()] == ["metadata", "token", "token", "done"]
    bad = rows.unionByName(spark.createDataFrame([("a", 1, "token", "not json"), ("a", 99, "token", '{"text": "late"}')], "request_id string, seq long, type string, payload string"))
    got = {r["request_id"]: tuple(r)[1:] for r in answers.fold_events(bad).collect()}
    assert got == {"a": ("one two", True, False), "b": ("", False, True), "c": ("", True, False)}
    lines = spark.createDataFrame([('data: {"type": "token", "text": "x"}',), ("data: {bad",), (": ping",)], "line string")
    assert [r["type"] for r in answers.parse_event_lines(lines).collect()] == ["token"]


def test_windows_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 7 AS INT), 0) AS ts, id AS event_id, CONCAT('t', id % 2) AS event_type, id % 3 AS user_id, CAST(id AS DOUBLE) AS value FROM range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, f in (("tumbling", events.tumbling_counts), ("sliding", events.sliding_counts)):
        q = f(stream, watermark=None).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(rows).collect()))
    assert events.session_counts(rows, gap="10 minutes").agg(F.sum("n")).first()[0] == 60
    assert events.once(rows.unionByName(rows), "event_id").count() == 60


def test_sentence_stream_equals_batch(spark, tmp_path):
    text = {"r1": "Nem nướng ngon. Món này cay! Hết", "r2": "Một câu"}
    rows = [(k, i, c, i == len(v) - 1) for k, v in text.items() for i, c in enumerate(v)]
    df = spark.createDataFrame(rows, "request_id string, seq long, token string, is_last boolean")
    df.where("seq < 12").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("seq >= 12").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {r["request_id"]: r["done"] + r["rest"] for r in answers.batch_sentences(df).collect()}
    assert batch == text
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = answers.stream_sentences(stream).writeStream.format("memory").queryName("sentences").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {}
    for r in spark.table("sentences").orderBy("part").collect():
        got[r["request_id"]] = got.get(r["request_id"], "") + r["sentence"]
    assert got == text
    chunks = answers.clean_chunks(spark.table("sentences")).where("request_id = 'r1'").orderBy("part", "chunk_at").collect()
    assert "".join(r["chunk"] for r in chunks) == "Nem nướng ngon. Món này cay! Hết"


def test_first_shown_chunk_has_no_space(spark, tmp_path):
    text = {"r1": ["Trong hình ảnh này ", "Phở ngon. ", "Hết."], "r2": ["Một câu. ", "Hai."]}
    rows = [(k, i, x) for k, v in text.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, answers.SENTENCES)
    assert df.where("part = 0 and request_id = 'r1'").select(X.sanitize_answer("sentence")).first()[0] == ""
    for i in range(3):
        df.where(f"part = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = answers.clean_chunks(stream).writeStream.format("memory").queryName("shown").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    for shown in (answers.clean_chunks(df), spark.table("shown")):
        got = {}
        for r in shown.orderBy("part", "chunk_at").collect():
            got[r["request_id"]] = got.get(r["request_id"], "") + r["chunk"]
        assert got == {"r1": "Phở ngon. Hết.", "r2": "Một câu. Hai."}


def test_streaming_generator(spark):
    prompts = spark.createDataFrame([("a", "content:\nPhở ngon lắm. Thêm."), ("b", "")], "query_id string, context_block string")
    tokens = EchoGenerator().stream(prompts)
    assert tokens.where("is_last").count() == 2
    assert {r["request_id"]: r["done"] + r["rest"] for r in answers.batch_sentences(tokens).collect()} == {r["query_id"]: r["answer"] for r in EchoGenerator().generate(prompts).collect()}


def test_rewrite_stream_goes_on_where_it_stopped(spark, tmp_path):
    from tesserine.operators import rewriting

    rows = spark.createDataFrame([(i, "phở", "Món này là gì?", "") for i in range(4)], "row_index long, keyword string, question string, vision_caption string")
    seen = []

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        answers.rewrite_stream(stream, rewriting.apply_rules, lambda df, i: seen.extend(r["standalone_question"] for r in df.collect()), checkpoint=str(tmp_path / "cp")).awaitTermination(120)

    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    rows.limit(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert seen == ["Phở là gì?"] * 6


def test_only_what_is_new_is_searched():
    """A long text without a sentence's end is looked through once, token by token, with the same cuts as over whole buffers."""

    class Read(str):
        seen = 0

        def __getitem__(self, i):
            Read.seen += 1
            return str.__getitem__(self, i)

        def isspace(self):
            return str.isspace(self)

    assert answers.pop_sentences(Read("x" * 1000 + " y"), 1000) == ("", "x" * 1000 + " y") and Read.seen < 10
    for text in ("a. b c.  d", "no end", "a.\n\nb! ", "x? y"):
        for at in range(len(text)):
            tail = answers.pop_sentences(text[:at])[1]
            assert answers.pop_sentences(tail + text[at:], len(tail)) == answers.pop_sentences(tail + text[at:])

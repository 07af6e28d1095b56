"""Mixing, packing, token files and the pipeline: sums, exact round trips, edge cases."""

import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserine.llm import mixing, packing, queries, token_file, tokens
from tesserine.llm.tokens import UNUSUAL, Encoder

EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "One  two\x0bthree four", "en", "a"), (4, "x " * 30000, "en", "b"), (5, "dup", None, "b"), (5, "dup", None, "b"), (None, "no id here", "fr", "c"), (7, "日本語 <|endoftext|> É 👍", "en", "c")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_targets(size):
    """Water filling, source by source."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, full = float(sum(size.values())), {}
    while True:
        open_ = [s for s in names if s not in full]
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * size[s]]
        if not over:
            return full | {s: left * weight[s] / w for s in open_}
        for s in over:
            full[s] = 3.0 * size[s]
        left = float(sum(size.values())) - sum(full.values())


@pytest.mark.parametrize("seed", range(3))
def test_mix(make, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 400]))), "en", rng.choice([None, "a", "b", "é", "Z"] + ["hot"] * 6)) for i in range(400)]
    docs = make([(*r, 0, 0) for r in rows + EDGE], ", size int, target int")
    got = mixing.plan_mix(docs, shard_tokens=1500).collect()
    assert len(got) == len(rows) + len(EDGE)
    size, taken = {}, {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in size:
        assert abs(taken[s] - want[s]) <= max(3, 0.03 * want[s])
    again = mixing.plan_mix(docs.repartition(7), shard_tokens=1500).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in again)


def test_mix_texts_have_the_words_taken(make):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 50)), "en", "abc"[i % 3] if i % 7 else "a") for i in range(300)]
    docs = make([(*r, 5) for r in rows], ", n_chars long")
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan_mix(docs, block_tokens=4).collect()}
    out = mixing.mixed_texts(docs, block_tokens=4)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i for i, t in plan.items() if t} == set(got)
    text = {r[0]: r[1] for r in rows}
    for i, r in got.items():
        assert len(words(r["text"])) == plan[i] and set(words(r["text"])) <= set(words(text[i])) and r["n_chars"] == len(r["text"])


def test_mix_edges(make):
    assert mixing.plan_mix(make([])).count() == 0 and mixing.mixed_texts(make([])).count() == 0
    empty = mixing.plan_mix(make([(1, None, None, None), (2, " ", None, "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def brute_apportionment(votes, seats):
    """One seat after another to the highest quotient."""
    got = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        got[max(range(len(votes)), key=lambda i: (votes[i] / (got[i] + 0.5), -i))] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    groups = [([rng.choice([0.0, 1.0, 2.0, rng.uniform(0, 5), rng.uniform(0, 300), rng.paretovariate(0.5)]) for _ in range(rng.randrange(1, 30))], rng.randrange(200)) for _ in range(12)]
    rows = [(g, i, v, seats) for g, (votes, seats) in enumerate(groups) for i, v in enumerate(votes)]
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(spark.createDataFrame(rows, "g int, i int, votes double, seats long"), by=["g"], tie="i").collect()}
    for g, (votes, seats) in enumerate(groups):
        assert [got[g, i] for i in range(len(votes))] == brute_apportionment(votes, seats)


def test_mix_rows_are_apart_and_names_may_clash(make):
    """Rows that share id and size take their own shares; internal names are free for other columns."""
    rows = [(None if i % 3 else 5, " ".join(f"w{i % 7 if i % 2 else i}" for _ in range(50)), "en", "ab"[i % 2]) for i in range(200)]
    names = ["start", "block", "turn", "passes", "_n", "_id", "key", "row", "quota", "size", "mixed", "number", "shard", "votes", "seats", "stop"]
    docs = make([(*r, *range(len(names))) for r in rows], "".join(f", {n} int" for n in names))
    plan, out = mixing.plan_mix(docs).collect(), mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(len(words(r["text"])) for r in got) == sum(r["taken"] for r in plan) and all([r[n] for n in names] == list(range(len(names))) for r in got)
    target = {r["source"]: r["target"] for r in plan}
    for s, t in target.items():
        assert abs(sum(r["taken"] for r in plan if r["source"] == s) - t) <= 0.02 * t


def test_mix_equals_sql(make, tmp_path):
    docs = make([(i, "w " * (i % 30), "en", ["a", "b", None, "c"][i % 4]) for i in range(500)])
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(mixing.oracle_sql()).select("doc_id, size, source_size, target, taken").fetchall())
    got = sorted(tuple(r) for r in mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


@pytest.mark.parametrize(("kind", "file"), [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
def test_encoder_equals_the_tokenizer(kind, file):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    chars = [chr(c) for c in range(0x250)] + list("日Σς👍́ ")
    rng = random.Random(1)
    texts = ["".join(rng.choice(chars if i % 2 else [c for c in chars if not UNUSUAL.search(c)] + list(" \n'sdltrvme.19") * 9) for _ in range(80)) for i in range(600)]
    texts += [f"a{c}b {c}{c} 1{c}'{c}" for c in chars] + ["", "<|endoftext|>", "<|startoftext|> x", "don't we'll '' 's  \n\n  x "]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(kind).encode(texts) == want


def brute_ids(kind, text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path({"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}[kind]))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_pack(make):
    rng = random.Random(2)
    rows = EDGE + [(100 + i, " ".join("word" for _ in range(rng.randrange(1, 3000))), "en", "s") for i in range(150)]
    got = packing.pack_documents(make([(*r, 1) for r in rows], ", item int"), group=20, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"] and 1 <= r["length"] <= 4096
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(by) <= 1.06 * -(-total // 4096) + 1
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in EDGE:
        ids = brute_ids("word", text, 1)
        mine = sorted(pieces[i], key=lambda r: r["piece"])[:: 2 if i == 5 else 1]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in mine] == [(k, k * 4096, len(ids[k * 4096 : (k + 1) * 4096]), crc(ids[k * 4096 : (k + 1) * 4096])) for k in range(-(-len(ids) // 4096))]
    assert packing.pack_documents(make([])).count() == 0


def test_pack_when_nothing_fits_together(spark):
    items = spark.range(1000).select(F.col("id").alias("item"), F.lit(2100).cast("long").alias("length"))
    got = packing.pack(items, group=50).collect()
    assert len({r["sequence_id"] for r in got}) == 1000 and all(r["offset"] == 0 for r in got)


def test_best_fit():
    bins, places, fill = packing.best_fit([6, 5, 4, 3, 2, 1, 1], 10)
    assert sorted(fill, reverse=True) == [10, 10, 2] or sum(fill) == 22 and len(fill) == 3
    assert places[0] == 0 and len(bins) == 7


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9000])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.zipf(1.4, n) % 50257, np.zeros(n, dtype=np.int64), np.full(n, 50256), np.arange(n) % 7):
        data = token_file.write_file(ids.astype(np.int64), [None, 3], [n, 0], start=9)
        start, names, lengths, back = token_file.read_file(data)
        assert (start, names, lengths) == (9, [None, 3], [n, 0]) and (back == ids).all()


def test_token_file_finds_damage():
    ids = np.arange(5000) % 300
    data = token_file.write_file(ids, [1], [5000])
    for at in (0, 10, 60, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_file.read_file(bytes(bad))
    with pytest.raises(ValueError):
        token_file.read_file(data[:-3])


def test_any_id_and_better_than_order_0():
    rng = np.random.default_rng(3)
    big = np.r_[rng.integers(0, 2**31, 3000), 0, 2**32 - 1].astype(np.int64)
    assert (token_file.read_file(token_file.write_file(big, [1], [len(big)]))[3] == big).all()
    # Stretches of 1,000 ids, each of one of five kinds with ids of its own that come in no order.
    ids = np.concatenate([rng.zipf(1.3, 1000) % 400 + 400 * rng.integers(5) for _ in range(300)]).astype(np.int64)
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    assert len(token_file.write_file(ids, [1], [len(ids)])) * 8 / len(ids) < 0.95 * -(p * np.log2(p)).sum()


def test_repeats_compress():
    ids = np.tile(np.random.default_rng(1).integers(0, 50257, 40), 50)
    assert len(token_file.write_file(ids, [1], [2000])) < 1500


def test_token_table(make):
    rows = EDGE + [(50 - i, f"text number {i} " * (i % 9), "en", "s") for i in range(30)]
    docs = make([(*r, 1) for r in rows], ", part int").repartition(5)
    for options in ({}, {"file_ids": 50, "part_bytes": 20000}):
        got = token_file.token_table(docs, **options).collect()
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order, key=lambda x: (x is not None, x or 0))
        want = sorted((i if i is not None else -1, len(ids), crc(ids)) for i, text, *_ in rows for ids in [brute_ids("byte", text, 2)])
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_file.token_table(make([])).count() == 0


@pytest.fixture(scope="module")
def pipeline_rows():
    rng = random.Random(4)
    rows = []
    for i in range(120):
        lang = ["en", "de"][i % 2]
        vocabulary = {"en": "the and house water bread night light strong thing other", "de": "der und haus wasser brot nacht licht stark ding andere"}[lang].split()
        rows.append((i, " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) * (k % 5 == 0) for k in range(200)), lang, "src" + str(i % 3) if i % 5 else "src0"))
    rows += [(200 + i, rows[i][1].upper(), rows[i][2], "src1") for i in range(10)]  # equal but for letter case
    rows += [(300 + i, rows[i][1] + " end", rows[i][2], "src2") for i in range(10)]  # near
    return rows + [(400, None, None, None), (401, "12 !", "en", None), (402, "", None, "x"), (None, "the house and the water", "en", None), (403, rows[3][1], "en", "x"), (403, rows[3][1], "en", "x")]


def test_pipeline(spark, make, pipeline_rows, tmp_path):
    make(pipeline_rows).withColumn("n_chars", F.length("text").cast("long")).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").collect() if r["doc_id"] is not None) for n, d in seen.items()}
    assert set(range(120)) <= set(ids["language_id"]) and not {400, 401, 402} & set(ids["language_id"])
    assert not set(range(10)) & set(ids["exact_dedup"]) and {200 + i for i in range(10)} - {203} <= set(ids["exact_dedup"]) and ids["exact_dedup"].count(403) == 1 and 203 not in ids["exact_dedup"]
    from tests_brute import brute_components_of

    before = {r["doc_id"]: r["text"] for r in seen["exact_dedup"].collect()}
    assert ids["simhash_dedup"] == sorted(i for i in brute_components_of(before) if i is not None)
    mixed = {r["doc_id"]: r["text"] for r in seen["mix_sources"].collect()}
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan_mix(seen["simhash_dedup"]).collect()}
    assert {i: len(words(t)) for i, t in mixed.items()} == {i: t for i, t in plan.items() if t}
    packed = seen["best_fit_packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {i: len(brute_ids("word", t, 1)) for i, t in mixed.items()}


def test_pipeline_of_nothing(spark, make, tmp_path):
    docs = make([], ", n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_registry():
    found = queries.queries()
    assert [n for n in found if n.startswith("op")] and "pipeline" in found and set(queries.oracle_sql()) <= set(found)
    assert {re.match(r"op(\d+)_", n)[1] for n in found if n.startswith("op")} == {str(i) for i in range(1, 14)}


def test_texts_hold_chosen_blocks(make):
    """What is taken of a text besides whole copies is what a run of blocks in its shard holds; a tiny source changes nothing for others."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "ab"[i % 2]) for i in range(200)] + [(999, "tiny", "en", "c")]
    text, cut, docs = {r[0]: r[1] for r in rows}, 0, make(rows)
    for r in mixing.mixed_texts(docs).collect():
        *whole, last = r["text"].split("\n")
        assert all(x == text[r["doc_id"]] for x in whole)
        mine = text[r["doc_id"]].split()
        at = [mine.index(w) for w in last.split()]
        assert sum(b - a != 1 for a, b in zip(at, at[1:], strict=False)) <= 1 and sorted(at) == at
        cut += last != text[r["doc_id"]]
    assert cut <= 2 * 3  # two for each shard
    alone = mixing.plan_mix(make(rows[:-1])).select("doc_id", "passes", "taken").collect()
    assert sum(abs(r["taken"] - 60 * round(r["taken"] / 60)) > 0 for r in alone) <= 4


def test_many_shards_compete_in_groups(make, monkeypatch):
    rows = [(i, " ".join("w" * (1 + k % 3) for k in range(1 + i % 40)), "en", "ab"[i % 3 == 0]) for i in range(400)]
    docs = make(rows)
    one = mixing.plan_mix(docs, shard_tokens=100)
    monkeypatch.setattr(mixing, "GROUP", 4)
    many = mixing.plan_mix(docs, shard_tokens=100)
    for plan in (one, many):
        got = plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
        assert all(abs(r["taken"] - r["target"]) <= 3 for r in got) and sum(r["size"] // 100 for r in got) > 50
        assert plan.where("taken > 3 * size").count() == 0


def test_run_leaves_stage_outputs_only(spark, make, pipeline_rows, tmp_path, monkeypatch):
    """The whole run gives what its stages give, and deletes what they stored on the way."""
    monkeypatch.setattr("tesserine.llm.common.shared_dir", lambda s: str(tmp_path / "shared"))
    make(pipeline_rows).withColumn("n_chars", F.length("text").cast("long")).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 50
    assert sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir()) == sorted(n for n, _ in corpus_pipeline.STAGES)


def test_runs_in_threads_delete_their_own_tables(spark, tmp_path, monkeypatch):
    import threading

    from tesserine.llm import common

    monkeypatch.setattr("tesserine.llm.common.shared_dir", lambda s: str(tmp_path / "shared"))
    go, done, left = threading.Event(), threading.Event(), {}

    def long_run():
        with common.temporary(spark):
            mine = common.stored(spark.range(3), "long")
            go.set()
            assert done.wait(60)
            left["rows"] = mine.count()

    t = threading.Thread(target=long_run)
    t.start()
    assert go.wait(60)
    with common.temporary(spark):
        common.stored(spark.range(2), "short")
    left["between"] = sorted(p.name.split("-")[0] for p in (tmp_path / "shared").iterdir())
    done.set()
    t.join()
    assert left == {"between": ["long"], "rows": 3} and not list((tmp_path / "shared").iterdir())


def test_tables_are_fitted_to_every_stretch():
    """Whatever a file's length, each of its stretches is in one of the groups."""
    rng = np.random.default_rng(4)
    for n in (20, 60, 5000):
        ids = np.concatenate([rng.integers(20 * (i % 2), 20 * (i % 2) + 20, size=token_file.STRETCH) for i in range(n)])
        counts = token_file.fit_tables(ids, 40)
        assert counts[0].sum() == counts[1:].sum() == n * token_file.STRETCH and len(counts) > 2


def test_token_file_looks_ids_up_as_a_search_would():
    """The decoder's table of holders against a search of each order-0 table; blocks are coded as they were before it had one."""
    rng = np.random.default_rng(7)
    tables = token_file.Tables(rng.integers(0, 50, size=(3, 40)))
    holders, at = tables.holders(), np.arange(tables.total)
    for k in range(3):
        starts = tables.flat[k * tables.step : (k + 1) * tables.step]
        assert (holders[k * tables.total : (k + 1) * tables.total] == np.searchsorted(starts, at, side="right") - 1).all()
    ids = np.minimum(rng.zipf(1.3, size=9_001), 60_000).astype(np.int64)
    used, ranks = token_file.distinct(ids)
    assert (used == np.unique(ids)).all() and (used[ranks] == ids).all()
    coded = b"".join(token_file.encode_blocks([ranks[at : at + 2048] for at in range(0, len(ids), 2048)], token_file.Tables(token_file.fit_tables(ranks, len(used)))))
    assert (len(coded), zlib.crc32(coded)) == (7264, 2276855560)
    data = token_file.write_file(ids, [1], [len(ids)])
    assert (token_file.read_file(data)[3] == ids).all()


def test_pieces_have_the_ids_of_whole_texts():
    """Texts of everything that a cut could go wrong at: white space of all kinds and lengths, marks, contractions, other scripts."""
    rng = random.Random(8)
    parts = ["a", "The", "é", "à", "x1", "5", " ", "  ", "\n", "\t", "\xa0", "\x85", "\u1680", "\u180e", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\x1c", "\x00"]
    parts += ["'s", "'ll", "don't", "'", ",", "...", "(", "<|endoftext|>", "日本", "\u0301", "\U0001f642", "w" * 70, " word", " other"]
    made = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(4000)] + [" ", "  ", " a", "a ", "\xa0 a", "é  b", "", None]
    known = tokens.Encoder("byte")
    for column in (pa.array(["left out", *made]).slice(1), pa.array(made, pa.large_string()), pa.array(["", None]), pa.array([], pa.string())):
        many, numbers, ids = known.encode_pieces(column)
        assert len(many) == len(column) and len(numbers) == many.sum()
        at = 0
        for text, n in zip(column.to_pylist(), many.tolist()):
            got = b"".join(ids[k] for k in numbers[at : at + n].tolist())
            assert got == np.array(known.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes(), text
            at += n


def test_token_file_codes_words_by_symbols():
    """Frequent words are one symbol and rare ones are put together from pairs; the ids read back are all of them, in order."""
    rng = np.random.default_rng(11)
    lens = rng.integers(1, 6, 3000)
    flat = rng.integers(0, 60, lens.sum()) * 7
    words = np.concatenate([rng.zipf(1.2, 40_000) % 3000, np.arange(3000)])
    ids = np.concatenate(np.split(flat, np.cumsum(lens)[:-1]))[token_file._expand(np.arange(lens.sum()), lens, words)]
    units = token_file._Units(words, flat, lens)
    assert len(units.symbols) < len(ids) / 2
    for block in (7, 1024):
        some = slice(0, len(words) if block > 7 else 300)
        n = int(lens[words[some]].sum())
        data = token_file.write_words(words[some], flat, lens, [4, None], [n - 1, 1], block=block)
        start, names, lengths, back = token_file.read_file(data)
        assert (start, names, lengths) == (0, [4, None], [n - 1, 1]) and (back == ids[:n]).all()
    plain = token_file.write_file(ids, [1], [len(ids)])
    assert len(token_file.write_words(words, flat, lens, [1], [len(ids)])) < len(plain)

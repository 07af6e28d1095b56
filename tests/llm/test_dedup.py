"""De-duplication operators against brute force, with their edge cases."""

import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserine.llm import components, embed_dedup, exact_dedup, simhash

EDGE = [(1, "Same TEXT", "en", "a"), (2, "same text", None, None), (3, None, "en", "a"), (4, "", "en", "a"), (5, "É", "fr", "b"), (6, "é", "fr", "b"), (7, " same text", "en", "a"), (7, " same text", "en", "a"), (None, "same text", "en", "a"), (None, "alone", "en", "a"), (9, "long " * 60000, "en", "a"), (10, "long " * 60000, "en", "a")]


def test_exact_groups(make):
    got = exact_dedup.exact_groups(make([(*r, 1, "x") for r in EDGE], ", digest int, run string")).collect()
    by = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    assert by == [(1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, True), (9, 10, 2, False), (10, 10, 2, True), (None, None, 1, True), (None, 2, 3, False)]


@pytest.mark.parametrize(("runs", "fan_in"), [(1, 2), (64, 4), (7, 3)])
def test_exact_tree_shapes_agree(spark, runs, fan_in):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 37).cast("string").alias("text")).repartition(9)
    got = exact_dedup.exact_groups(df, runs=runs, fan_in=fan_in, keep="min").groupBy("keep_id").count().collect()
    assert {r["keep_id"] for r in got} == set(range(37)) and sum(r["count"] for r in got) == 500


def test_exact_drop_keeps_one_row_and_all_columns(make):
    docs = make([(*r, i) for i, r in enumerate(EDGE)], ", _count int")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [2, 4, 5, 6, 7, 10]
    assert left.where("doc_id IS NULL").count() == 1
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0 and exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_rounds_sort_and_merge(spark, make):
    """Executed as it is planned: a sort and a sorted aggregate in every round, and no Python."""
    merged = exact_dedup.merge_runs(exact_dedup.digests(make(EDGE)))
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search("Python|Arrow|Pandas|HashAggregate", plan)
    rounds = 4  # 64 runs, four at a time, down to one
    assert len(re.findall(r"SortAggregate\(", plan)) >= rounds and len(re.findall(r"[ -]Sort \[", plan)) >= rounds


def test_exact_drop_goes_by_row_and_normalised_text(make):
    rows = [(7, "A b", None, None), (7, "a b", None, None), (7, None, None, None), (7, "", None, None), (None, "A B", None, None), (8, "c", None, None), (None, "d", None, None), (None, "D", None, None)]
    clash = ", key long, row int, doc_id2 int, none boolean, id int, digest string, size int, stays long"
    docs = make([(*r, 1, 2, 3, True, 4, "x", 5, 6) for r in rows], clash)
    for keep in ("max", "min"):
        left = exact_dedup.drop_copies(docs, keep=keep)
        assert left.columns == docs.columns
        assert sorted(((r["doc_id"] or 0, (r["text"] or "").lower(), r["key"]) for r in left.collect())) == [(0, "d", 1), (7, "", 1), (7, "a b", 1), (8, "c", 1)]
    left = {(r["doc_id"], (r["text"] or "").lower()) for r in simhash.drop_near_copies(docs).collect()}
    assert {(7, "a b"), (8, "c"), (None, "d")} <= left


def slow_fingerprint(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp, ids, bits=3):
    root = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= bits:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min(ids[j] for j in range(len(fp)) if root[j] == root[i]) for i in range(len(fp))]


def near_texts(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(150)) for _ in range(6)]
    texts = ["", None, " \n", "One", "one", "One two", "É è", "x y z"]
    for b in base:
        words = b.split()
        for _ in range(8):
            w = list(words)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts + [base[0]] * 5


def test_simhash_equals_brute_force(make):
    texts = near_texts()
    ids = list(range(100, 100 + len(texts)))
    docs = make([(i, t, "x", None, "c") for i, t in zip(ids, texts, strict=True)], ", fp string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fp = [slow_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in ids] == ["%016x" % f for f in fp]
    assert [got[i]["component_id"] for i in ids] == brute_components(fp, ids)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == len(set(brute_components(fp, ids)))


@pytest.mark.parametrize("cell", [4, 4096])
def test_fingerprint_links_lose_nothing(spark, cell):
    """Chains, dense groups and random points, in small and in large cells."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    x = rng.getrandbits(64)
    for _ in range(30):
        x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        fps.add(x)
    fps = sorted(fps | {0, 7, 2**64 - 1})
    signed = [int(v) for v in np.array(fps, dtype=np.uint64).view(np.int64)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    found = {r["node"]: r["root"] for r in components.components(simhash.fingerprint_links(df, cell=cell)).collect()}
    want = brute_components(fps, signed)
    assert [found.get(v, v) for v in signed] == want


def test_simhash_edges(make):
    assert simhash.near_duplicates(make([])).count() == 0
    got = simhash.near_duplicates(make([(None, "a b c", None, None), (5, "a b c", None, None), (5, "a b c", None, None), (None, "else where now then", None, None)])).collect()
    assert sorted((r["component_id"] or -1, r["kept"]) for r in got) == [(-1, True), (5, False), (5, True), (5, True)]
    with pytest.raises(ValueError):
        simhash.fingerprint_links(make([]).select(F.col("doc_id").alias("fp")), max_bits=4)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(path + star + [(5, 5), (None, 3), (1, 0)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert set(got.values()) == {0, 1000} and sum(v == 0 for v in got.values()) == 61 and sum(v == 1000 for v in got.values()) == 200
    assert components.components(df.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    v = np.concatenate([rng.normal(size=(200, 24)), base, base + 0.05 * rng.normal(size=base.shape), base[:10], np.repeat(base[:1], 30, axis=0) * 3, base[:20] * 1e-3 + 0.0004 * rng.normal(size=(20, 24))])
    frame = pd.DataFrame({"vec_id": np.arange(len(v)) + 7, "embedding": v.astype(np.float32).tolist(), "label": 1, "e": "clash"})
    want = embed_dedup.brute_force(frame)
    for tile in (50, 8192):
        got = embed_dedup.near_duplicates(spark.createDataFrame(frame).repartition(3), tile=tile, fit=100).toPandas().sort_values("vec_id").reset_index(drop=True)
        assert (got["n_links"] == want["n_links"]).all() and (got["component_id"] == want["component_id"]).all()
        assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_boxes_part_what_no_link_joins():
    """Each vector reaches the boxes of all vectors that it links with, and in clusters far apart few others."""
    rng = np.random.default_rng(6)
    centers = embed_dedup.unit(rng.normal(size=(12, 6)))
    u = embed_dedup.unit(np.repeat(centers, 60, axis=0) + 0.02 * rng.normal(size=(720, 6)))
    r = u @ embed_dedup.axes(u)
    cuts = embed_dedup.Cuts(r, 16)
    own, rows, boxes = cuts.near(r, np.sqrt(0.2))
    reached = set(zip(rows.tolist(), boxes.tolist(), strict=True))
    assert cuts.boxes == 16 and all((i, own[i]) in reached for i in range(720))
    for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True):
        assert (i, own[j]) in reached
    assert len(reached) < 0.6 * 720 * 16


def test_embeddings_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (10, [2.0]), (None, [1.0, 0.0]), (2, [1.0, 0.1]), (11, [1e-30, 0.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=lambda x: (x[0] is None, x[0] or 0))
    assert by == [(1, 4, 1), (2, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 1, 9), (11, 4, 1), (None, 4, 1)]
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_suffix_bound_never_prunes_a_link():
    rng = np.random.default_rng(4)
    u = embed_dedup.unit(rng.normal(size=(300, 16)))
    u[150:] = embed_dedup.unit(u[:150] + 0.12 * rng.normal(size=(150, 16)))
    r = u @ embed_dedup.axes(u)
    every = np.arange(len(u))
    got = {tuple(sorted(p)) for i, j in embed_dedup.compare(u, r, every, every, 0.9, block=32) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True)}
    assert got == want


def test_near_copies_go_by_row_not_by_id(make):
    """A near copy without an id, or with a repeated one, leaves the other rows of that id."""
    a, b = "one two three four five six seven", "quite another text of words alone"
    rows = [(1, a, None, None), (None, a, None, None), (None, b, None, None), (7, a, None, None), (7, "red " + b + " blue green", None, None)]
    left = {(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(make(rows)).collect()}
    assert left == {(1, a), (None, b), (7, rows[-1][1])}


def test_simhash_of_a_very_long_text_and_clashing_names(make):
    rng = random.Random(11)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(80_000))
    docs = make([(1, long, None, None, 1, 2, 3, 4), (2, long + " end", None, None, 1, 2, 3, 4), (3, "short text", None, None, 1, 2, 3, 4)], ", fp long, root long, cell long, key long")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 3]
    assert got[1]["fingerprint"] == f"{slow_fingerprint(long):016x}"

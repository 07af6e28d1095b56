"""The index by cells: exact where all is probed, recall where few are, pruned folders, cells that stay as they are."""

import glob
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators import retrieval
from tesserine.operators import vector_index as V


def clustered(n, d, groups, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d))
    return (centers[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, d))).round(6).tolist()


@pytest.fixture(scope="module")
def rows(spark):
    schema = "doc_id long, embedding array<double>, kind string, text string"
    vectors = clustered(3000, 12, 40, 1)
    vectors[7:10] = [vectors[7]] * 3
    odd = [(5000, None, "a", "none"), (5001, [0.0] * 12, "a", "zero"), (5002, [float("nan")] + [1.0] * 11, "b", "nan"), (5003, [None] + [1.0] * 11, "b", "hole")]
    return spark.createDataFrame([(i, v, "abc"[i % 3], f"t{i}") for i, v in enumerate(vectors)] + odd, schema).repartition(4).persist()


@pytest.fixture(scope="module")
def asked(rows):
    return rows.where("doc_id % 20 = 0 or doc_id >= 5000").select(F.col("doc_id").alias("query_id"), "embedding", "kind")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return V.VectorIndex.build(rows, str(tmp_path_factory.mktemp("index") / "ix"), cells=30)


def same(a, b):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(a) == key(b)


def test_all_cells_give_the_exact_result(rows, asked, index):
    same(index.search(asked, k=4, probe=None, refine=None), retrieval.search(asked, rows, k=4))
    same(index.search(asked, k=4, probe=None, refine=None, by=("kind",), threshold=0.5), retrieval.search(asked, rows, k=4, by=("kind",), threshold=0.5))
    same(index.search(asked, k=3, probe=99, refine=None, tiles=(7, 50)), retrieval.search(asked, rows, k=3))
    assert index.search(asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        index.search(asked, k=5, refine=3)


def test_recall_of_clustered_vectors(rows, asked, index):
    exact = retrieval.search(asked, rows, k=5)
    assert V.recall(index.search(asked, k=5, probe=3, refine=40), exact) >= 0.95
    assert V.recall(index.search(asked, k=5, probe=1, refine=40), exact) >= 0.6
    n = index.probe_for(asked, 0.99)
    assert n < 10 and V.recall(index.search(asked, k=5, probe=n, refine=None), exact) >= 0.99


def test_recall_of_the_given_vectors(spark, tmp_path):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    e = spark.read.parquet(path).select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = e.where("doc_id % 25 = 0").withColumnRenamed("doc_id", "query_id")
    index = V.VectorIndex.build(e, str(tmp_path / "ix"))
    probe = index.probe_for(queries, 0.95)
    found = index.search(queries, k=5, probe=probe)
    assert probe < 0.8 * len(index.quantizer.centers) and V.recall(found, retrieval.search(queries, e, k=5)) >= 0.9


def test_only_probed_folders_are_read(asked, index):
    one = asked.where("query_id = 40")
    probed = {r["cell"] for r in index.probes(one, 2).collect()}
    assert len(probed) == 2
    scan = index.rows(sorted(probed))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell#\d+ IN \(", plan)
    assert {int(re.search(r"cell=(-?\d+)", f)[1]) for f in scan.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == probed
    found = index.search(one, k=5, probe=2, refine=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*?PartitionFilters: (\[.*?\]),", plan)
    assert scans and all(" IN (" in s or " = " in s for s in scans)


def test_every_row_is_stored_once(rows, index):
    assert index.rows().count() == rows.count()
    assert {r["doc_id"] for r in index.rows([V.NOWHERE]).collect()} == {5000, 5001, 5002, 5003}
    assert sorted(r["text"] for r in index.rows().collect()) == sorted(r["text"] for r in rows.collect())


def test_upsert_leaves_other_cells_alone(spark, rows, asked, tmp_path):
    path = str(tmp_path / "ix")
    index = V.VectorIndex.build(rows, path, cells=30)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/rows/cell=*/*.parquet")}
    before = files()
    moved = rows.where("doc_id in (11, 12)").withColumn("embedding", F.transform("embedding", lambda x: -x))
    new = spark.createDataFrame([(9000, clustered(1, 12, 40, 1)[0], "a", "new"), (5001, [1.0] * 12, "a", "found now")], rows.schema)
    touched = index.upsert(moved.unionByName(new))
    after = files()
    cell = lambda f: int(re.search(r"cell=(-?\d+)", f)[1])
    assert 2 <= len(touched) <= 7 and V.NOWHERE in touched
    assert {f for f in before if cell(f) not in touched} == {f for f in after if cell(f) not in touched}
    assert all(before[f] == after[f] for f in before if cell(f) not in touched)
    want = retrieval.upsert(rows, moved.unionByName(new))
    assert sorted(r["text"] for r in index.rows().collect()) == sorted(r["text"] for r in want.collect())
    same(index.search(asked, k=4, probe=None, refine=None), retrieval.search(asked, want, k=4))
    # The last row of a cell leaves it.
    index.upsert(spark.createDataFrame([(i, [1.0] * 12, "a", "x") for i in (5000, 5002, 5003)], rows.schema))
    assert not os.path.exists(f"{path}/rows/cell={V.NOWHERE}") and index.rows([V.NOWHERE]).count() == 0


def test_training_is_bounded_and_repeats(spark, rows):
    a, b = V.train(rows, sample=500), V.train(rows.repartition(9), sample=500)
    assert np.array_equal(a.centers, b.centers) and np.array_equal(a.books, b.books) and len(a.centers) <= 600 // V.EACH
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "doc_id long, embedding array<float>")
    assert len(V.train(flat, cells=4).centers) == 1
    for none in (flat.limit(0), spark.createDataFrame([(1, [0.0, 0.0])], flat.schema)):
        with pytest.raises(ValueError):
            V.train(none)


def test_queries_are_not_sent_once_a_cell(rows, asked, index, monkeypatch):
    """However many cells are probed, a search has each query once; the number of cells is told from given hits as from an own search."""
    sent, plain = [], retrieval.tile_hits
    monkeypatch.setattr(retrieval, "tile_hits", lambda queries, *more, **names: sent.append(queries.count()) or plain(queries, *more, **names))
    exact = retrieval.search(asked, rows, k=4)
    for probe, refine in ((None, None), (None, 40), (20, None), (20, 40)):
        assert V.recall(index.search(asked, k=4, probe=probe, refine=refine), exact) >= 0.95
    assert set(sent) == {asked.count(), asked.where(F.size("embedding") == 12).count()}
    assert index.probe_for(asked, 0.9, k=4, exact=exact) == index.probe_for(asked, 0.9, k=4)


def test_only_searches_by_codes_have_their_own_tiles(asked, index, monkeypatch):
    """A search of all cells is cut as an exact one, in as many tiles whatever its size."""
    cut, plain = [], retrieval.tile_hits
    monkeypatch.setattr(retrieval, "tile_hits", lambda *rows, **names: cut.append(names["tiles"]) or plain(*rows, **names))
    for names in ({"probe": None, "refine": None}, {"probe": 3}, {"probe": None, "refine": None, "tiles": (7, 50)}):
        index.search(asked, k=4, **names)
    assert cut == [None, retrieval.TILES, (7, 50)]

"""Harmonic packing, spelling variants and whitening against brute force, with their edge cases."""

import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import harmonic, queries, spelling, whitening
from tesserine.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "One  two\x0bthree four", "en", "a"), (4, "x " * 30000, "en", "b"), (5, "dup", None, "b"), (5, "dup", None, "b"), (None, "no id here", "fr", "c"), (7, "日本語 É 👍", "en", "c")]


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    return by


@pytest.mark.parametrize("capacity", [2048, 100, 1])
def test_harmonic_pieces_cover_each_id_once(make, capacity):
    rng = random.Random(5)
    rows = [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma,", "x9"]) for _ in range(rng.choice([0, 3, 60, 700]))), "en", "a") for i in range(60)]
    if capacity == 1:
        rows = rows[:5]
    edge = [r for r in EDGE if capacity > 1 or r[0] != 4]
    docs = make([(*r, 1, 2) for r in rows + edge], ", sequence_id int, ids int").repartition(3)
    got = harmonic.pack_documents(docs, capacity=capacity, with_ids=True).collect()
    check_sequences(got, capacity)
    known = Encoder("word")
    want = sorted(known.encode([r[1] or ""])[0] + b"\x01\0\0\0" for r in rows + edge)
    pieces = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    # A repeated row is a document of its own with the same id: its pieces come twice.
    whole = []
    for (doc, n), found in pieces.items():
        found.sort()
        times = 2 if doc == 5 else 1
        assert [s for s, _ in found[::times]] == list(np.cumsum([0] + [len(x) // 4 for _, x in found[::times]]))[:-1] and sum(len(x) // 4 for _, x in found) == times * n
        whole += [b"".join(x for _, x in found[::times])] * times
    assert sorted(whole) == want


def test_harmonic_classes_fill_by_count():
    bins = harmonic.Bins(2048, 32)
    ids = lambda n: np.arange(n, dtype="<u4").tobytes()
    assert [[(p[0], p[1], len(p[2]) // 4) for p in done] for done in bins.add("a", ids(4096))] == [[("a", 0, 2048)], [("a", 2048, 2048)]]
    done = [b for i in range(3) for b in bins.add(i, ids(683 + (i == 0)))]
    assert [[len(p[2]) // 4 for p in b] for b in done] == [[682, 683, 683]]  # as equal as whole tokens allow, and full
    for n in (1, 63, 64, 65, 1023, 1024, 1025, 2047):
        one = harmonic.Bins(2048, 32)
        sizes = [sum(len(p[2]) // 4 for p in b) for b in [*one.add(0, ids(n)), *one.close()]]
        assert sum(sizes) == n and all(s & (s - 1) == 0 for s in sizes) and len(set(sizes)) == len(sizes)
        assert not list(one.close())
    with pytest.raises(ValueError):
        harmonic._checked(0, 3)


def test_harmonic_query_wastes_nothing_and_cuts_little(spark):
    got = queries.op11_harmonic_packing(spark, SF).collect()
    by = check_sequences(got, 2048)
    total = sum(r["length"] for r in got)
    assert len(by) <= total // 2048 + 11 * 4  # no bin but the last few of a partition is less than full
    assert len(got) < 4 * len({r["doc_id"] for r in got})
    assert total == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())


def test_harmonic_sequences_are_those_of_the_pieces(make):
    docs = make(EDGE)
    rows = harmonic.pack_documents(docs, capacity=64, with_ids=True).orderBy("sequence_id", "offset").collect()
    want = {}
    for r in rows:
        want[r["sequence_id"]] = want.get(r["sequence_id"], b"") + bytes(r["ids"])
    plain, padded = harmonic.sequences(docs, capacity=64), harmonic.sequences(docs, capacity=64, pad=True, pad_id=9)
    assert {r["sequence_id"]: bytes(r["ids"]) for r in plain.collect()} == want
    for r in padded.collect():
        assert bytes(r["ids"]) == want[r["sequence_id"]] + b"\x09\0\0\0" * (64 - r["length"])
    assert harmonic.pack_documents(make([])).count() == 0 and harmonic.sequences(make([])).count() == 0


def brute_words(docs, mispelt=199, least=5, shortest=6):
    count = {}
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if mispelt and h % mispelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if n >= least and len(w) >= shortest}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count, ratio=5):
    near = {w: [x for x in count if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= ratio * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items()}


@pytest.mark.parametrize("chunk", [16_384, 7])
def test_variants_against_brute_force(spark, chunk):
    rng = random.Random(3)
    stems = ["color", "müßig", "aaaaaa", "zebra", "ÀÿÀÿ"]
    words = set()
    while len(words) < 300:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "À", "÷"])
        words.add("".join(w))
    count = {w: rng.choice([5, 5, 6, 25, 30, 150, 700, 3000]) for w in words if w}
    df = spark.createDataFrame([(n, w, 1) for w, n in count.items()], "n long, word string, best int")
    got = {tuple(r) for r in spelling.variants(df, chunk=chunk).collect()}
    assert got == brute_variants(count)
    assert any(x[2] not in (x[0], x[1]) for x in got)  # chains longer than one step
    groups = spelling.grouped(spelling.variants(df, chunk=chunk)).collect()
    assert sum(r["words"] for r in groups) == len(count) and sum(r["n"] for r in groups) == sum(count.values())


def test_masks_flip_as_stated(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    pairs = []
    for _ in range(300):
        w = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        x, i = list(w), rng.randrange(len(w))
        x[i : i + rng.randrange(2)] = rng.choice(["", *letters])
        pairs.append(("".join(w), "".join(x)))
    df = spark.createDataFrame([p for p in pairs if p[1]], "a string, b string")
    flips = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(spelling.bands(F.col("a")), spelling.bands(F.col("b")), strict=True)), F.lit(0))
    for r in df.withColumn("flips", flips).collect():
        assert r["flips"] == (0 if r["a"] == r["b"] else 2 if len(r["a"]) == len(r["b"]) else abs(len(r["a"]) - len(r["b"])))


def test_word_counts_and_edges(make):
    rows = [(1, "Élan ELANXX élanxx éLANXX élanxx" * 3, None, None), (2, None, None, None), (3, "", None, None), (None, "kettle kettle's Kettle-kettle 9kettle9", None, None), (5, "ab " * 70000 + "letters " * 9, None, None), (6, "naïveté×÷ýÿ " * 5, None, None), (7, "repeat repeat repeat", None, None), (7, "repeat repeat repeat", None, None)]
    docs = make([(*r, 1, "x") for r in rows], ", n int, word string")
    for mispelt in (199, 3, None):
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs, mispelt=mispelt).collect()}
        assert got == brute_words([r[:2] for r in rows], mispelt)
    assert {tuple(r) for r in spelling.spelling_variants(docs, mispelt=2, least=1, shortest=3).collect()} == brute_variants(brute_words([r[:2] for r in rows], 2, 1, 3))
    assert spelling.spelling_variants(make([])).count() == 0 and spelling.spelling_variants(make(rows[1:3])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(docs), ratio=1)


def test_spelling_query_against_sql_and_brute_force(spark):
    got = {tuple(r) for r in queries.op12_spelling_variants(spark, SF).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute_variants(brute_words(docs))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert set(con.sql(queries.oracle_sql()["op12_spelling_variants"]).fetchall()) == got


def exact_statistics(vectors, scale=64, shift=1_000_000):
    """n, sums and V, by fractions; and x of each vector."""
    x = [[int(np.floor(np.float64(c) * scale)) + shift for c in v] for v in vectors]
    u = sorted(set(map(tuple, x)))
    n, d = len(u), len(u[0])
    sums = [sum(r[i] for r in u) for i in range(d)]
    y = [[n * r[i] - sums[i] for i in range(d)] for r in u]
    return n, sums, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)], x


def check_whitening(rows, vectors, most=16):
    n, sums, v, x = exact_statistics([c for _, c in vectors])
    d = len(sums)
    cov = np.array([[float(a) for a in r] for r in v])
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1][:most], q.T[::-1][:most]
    by = {}
    for r in rows:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == {i for i, _ in vectors}
    k = max(r["component"] for r in rows)
    z = {}
    for (i, _), row in zip(vectors, x, strict=True):
        y = [n * a - s for a, s in zip(row, sums, strict=True)]
        assert sorted(by[i]) == list(range(1, k + 1))
        assert all(int(r["deviation"]) == sum(a * a for a in y) for r in by[i].values())
        z[i] = (np.array([float(Fraction(a, n)) for a in y]), np.array([by[i][c]["whitened"] for c in range(1, k + 1)]))
    a, b = (np.array(t) for t in zip(*z.values(), strict=True))
    want = a @ q[:k].T / np.sqrt(values[:k])
    signs = np.sign((want * b).sum(axis=0))
    assert np.allclose(want, b * signs, rtol=1e-6, atol=1e-6)
    share = [by[vectors[0][0]][c]["explained"] for c in range(1, k + 1)]
    assert np.allclose(share, values[:k] / np.trace(cov), rtol=1e-6)
    return k


@pytest.mark.parametrize(("d", "m", "spread"), [(5, 40, 1.0), (20, 60, 300.0), (3, 30, 1e12)])
def test_whitening_against_fractions(spark, d, m, spread):
    rng = np.random.default_rng(d)
    vectors = [(i, (rng.normal(size=d) * spread * (1 + np.arange(d))).tolist()) for i in range(m)]
    vectors += [(m + i, vectors[i % 3][1]) for i in range(25)]  # copies count once
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    assert check_whitening(whitening.whiten(df).collect(), vectors) == min(16, d)
    assert check_whitening(whitening.whiten(df, components=2).collect(), vectors, 2) == 2


def test_whitening_query(spark):
    got = queries.op13_embedding_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["n"] == "bigint"
    vectors = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(got.collect(), vectors)


def test_limb_products_are_exact():
    rng = np.random.default_rng(1)
    for wide in (3, 31, 61):
        y = rng.integers(-(1 << wide), 1 << wide, size=(9000, 4))
        parts = whitening.limbs(y)
        assert ((sum(p.astype(np.int64).astype(object) * (1 << (16 * i)) for i, p in enumerate(parts)) == y).all()) and all(abs(p).max() <= 1 << 15 for p in parts)
        found = whitening.Products(4)
        found.add(y[:5000])
        found.add(y[5000:])
        assert (found.total() == y.astype(object).T @ y.astype(object)).all()
    far = np.array([[10**30, -(10**30)], [7, -7]], dtype=object)
    found = whitening.Products(2)
    found.add(far)
    assert (found.total() == far.T @ far).all()


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, component int, x string"
    nan, inf = float("nan"), float("inf")
    bad = [(90, None), (91, [1.0, None]), (92, [nan, 1.0]), (93, [1.0, inf]), (94, []), (95, [1.0, 2.0, 3.0]), (96, [3e38, 0.0])]
    good = [(1, [0.0, 1.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (None, [0.25, -3.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in bad + good], schema)
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 0, 1, 1, 2, 2, 2, 2] and {r["n"] for r in got} == {3}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id in (90, 92)")).count() == 0
    assert whitening.whiten(df.where("vec_id = 2")).count() == 0  # no variance, no component
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(8)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    assert {tuple(r["x"]) for r in whitening.integer_vectors(df.where("vec_id = 2")).collect()} == {(1_000_064, 1_000_032)}
    with pytest.raises(ValueError):
        whitening.whiten(df, components=0)

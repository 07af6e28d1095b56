"""Classifiers and the language model: held-out accuracy, exact parts, edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import language, language_model, quality, toxicity

WORDS = {"en": "the and of house water bread night light strong thing", "de": "der und das haus wasser brot nacht licht stark ding", "fr": "le et de maison eau pain nuit lumière fort chose"}
EDGE = [(9001, None, None, None), (9002, "", "en", None), (9003, " 12 !? ", "en", "s"), (9004, "日本語 text", None, "s"), (9005, "the " * 30000, "en", "s"), (9005, "the " * 30000, "en", "s")]


def prose(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, prose(rng, lang), lang, "s") for i in range(240) for lang in [list(WORDS)[i % 3]]]


def test_language(make, corpus):
    docs = make([(*r, 0, "x") for r in corpus + EDGE], ", lang_pred int, rank string")
    got = {r["doc_id"]: r for r in language.identify_held_out(docs).collect()}
    assert len(got) == len(corpus) + 5
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [r for r in corpus if got[r[0]]["held_out"]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9004]["lang_pred"] != "und" and got[9005]["lang_pred"] == "en"
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got) - {9001, 9002, 9003}


def test_language_without_training(make):
    got = language.identify_held_out(make([(1, "abc", None, None)])).collect()
    assert [r["lang_pred"] for r in got] == ["und"] and language.identify_held_out(make([])).count() == 0


def brute_profile(texts, most=400):
    """n-grams of one to three letters or gaps, most frequent first, ties by the letters' numbers (a gap is 1)."""
    n = Counter()
    for text in texts:
        marked = "\1" + "\1".join("".join(c if c.isalpha() else "\1" for c in text.lower()).replace("\1", " ").split()) + "\1"
        n.update(marked[i : i + k] for k in (1, 2, 3) for i in range(len(marked) - k + 1) if marked[i : i + k] != "\1")
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(n, key=lambda g: (-n[g], number(g)))[:most], number


def test_out_of_place_distance():
    fit = {"x": "aab abba é 日本", "y": "bbb 日語 кот", "z": "кит кот"}
    names, ranked = list(fit), {k: brute_profile([t]) for k, t in fit.items()}
    profiles = language.Profiles({k: np.array([number(g) for g in grams]) for k, (grams, number) in ranked.items()})
    for text in ("aab", "bbb", "日本語", "кот и кит", "q"):
        mine, number = brute_profile([text])
        want = [sum(abs(ranked[k][0].index(g) - i) if g in ranked[k][0] else 400 for i, g in enumerate(mine)) for k in names]
        assert profiles.distances(language.top(*language.grams(language.letters(text)))).tolist() == want
        assert profiles.predict(text)[0] == names[want.index(min(want))]
    assert profiles.predict("...") == ("und", 0.0)


def test_language_equals_brute_force(make, corpus):
    """The whole query against profiles and distances in plain Python."""
    docs = make(corpus)
    train = {}
    for i, text, lang, _ in corpus:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            train.setdefault(lang, []).append(text)
    ranked = {k: brute_profile(t)[0] for k, t in sorted(train.items())}
    got = {r["doc_id"]: r for r in language.identify_held_out(docs).collect()}
    for i, text, *_ in corpus[::5]:
        mine = brute_profile([text])[0]
        far = {k: sum(abs(p.index(g) - at) if g in p else 400 for at, g in enumerate(mine)) for k, p in ranked.items()}
        first, second = sorted(far.values())[:2]
        assert got[i]["lang_pred"] == min(far, key=far.get) and abs(got[i]["score"] - (second - first) / second) < 1e-12


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, make):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        text = prose(rng, "en") if good else " ".join(w.upper() + "!!" for w in prose(rng, "en").split()) if i % 8 else " ".join([prose(rng, "en", 1)] * 40)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 1), (5, None, None), (77777, 0, 0)]
    got = {r["doc_id"]: r for r in quality.classify_held_out(make(rows + EDGE), marks(spark, labels)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    held = [i for i in range(240) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.95 * len(held)
    again = {r["doc_id"]: r["score"] for r in quality.classify_held_out(make(rows + EDGE), marks(spark, labels)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_quality_edges(spark, make):
    one = quality.classify_held_out(make(EDGE), marks(spark, [(9004, 1, 0)])).collect()
    assert len(one) == 6 and all(r["predicted"] in (0, 1) for r in one)
    none = quality.classify_held_out(make(EDGE), marks(spark, [])).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify_held_out(make([]), marks(spark, [])).count() == 0


def test_toxicity(spark, make):
    rng = random.Random(3)
    letters = "abcdefghijklmnoprstu"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["wretched", "zxqfool", "vqjscum"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    got = {r["doc_id"]: r for r in toxicity.classify_held_out(make(rows + EDGE), marks(spark, labels)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] for i in held if i % 4 == 0) >= 0.85 * sum(i % 4 == 0 for i in held)
    assert sum(got[i]["predicted"] for i in held if i % 4) <= 0.05 * len(held)
    assert not got[9002]["predicted"]


def test_toxicity_edges(spark, make):
    none = toxicity.classify_held_out(make(EDGE), marks(spark, [])).collect()
    assert len(none) == 6 and {r["score"] for r in none} == {0.0}
    assert len(toxicity.classify_held_out(make(EDGE), marks(spark, [(9004, 1, 1), (9002, 1, 0)])).collect()) == 6
    assert toxicity.classify_held_out(make([]), marks(spark, [])).count() == 0


def test_windows_cover_the_whole_text():
    text = toxicity.normal(b"word " * 500 + b"x" * 1000)
    parts = list(toxicity.windows(text, 64))
    assert max(map(len, parts)) <= 65 and b"x" * 60 in parts[-3]
    joined = parts[0]
    for p in parts[1:]:
        joined += p[1:] if joined[-1:] == p[:1] else p
    assert joined.replace(b" ", b"") == text.replace(b" ", b"")


def test_calibration_is_monotone():
    shares, low = toxicity.calibrate(np.array([0, 0, 1, 1, 2, 5]), np.array([0, 0, 1, 0, 0, 1]), 0.3)
    assert low == 0 and len(shares) == 6 and (np.diff(shares) >= -1e-12).all() and shares[0] < shares[-1]


def test_language_model_counts(make, corpus):
    docs = make([(*r, 1) for r in corpus + EDGE], ", share int")
    got = {r["doc_id"]: r for r in language_model.score_held_out(docs).collect()}
    assert len(got) == len(corpus) + 5
    c = Counter()
    for i, text, *_ in corpus + EDGE:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(language_model.tokens((text or "").encode()))
    n, v = sum(c.values()), len(c)
    for i, text, *_ in corpus + EDGE:
        t = language_model.tokens((text or "").encode())
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t)
        assert r["score"] < 0 and math.isfinite(r["open_score"])
    assert language_model.score_held_out(docs.limit(0)).count() == 0
    again = {r["doc_id"]: r for r in language_model.score_held_out(docs.repartition(7, "text")).collect()}
    for name in ("base_score", "score", "open_score"):
        assert all(again[i]["n_known"] == r["n_known"] and abs(again[i][name] - r[name]) <= 1e-6 * max(1, abs(r[name])) for i, r in got.items())


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcd"), size=rng.integers(1, 6))) for _ in range(200)]
    words = sorted(set(words)) + [""]
    coder = language_model.Letters([ord(c) for c in "abcd"], np.zeros(0, dtype=np.float32))
    cell, _ = coder.cells(words)
    keys, n = np.unique(cell, return_counts=True)
    letters = language_model.sample_letters(keys, n, coder.letters, rng)
    table = 10.0 ** letters.logs.astype(np.float64).reshape(-1, language_model.ALPHABET)
    assert np.allclose(table.sum(axis=1), 1, atol=1e-4)
    count = np.arange(1, len(words) + 1).astype(float)
    model = language_model.Words(int(count.sum()), 0.5)
    spelled = letters.spell(words)
    inside = float((10.0**spelled).sum())
    key = language_model.word_hash([w.encode() for w in words])
    total = float(model.tables(1, key, count, spelled, len(words)).sum())
    model.samples = [(1, letters, len(words), total, 1 - inside)]
    mass = float((10.0 ** model.predict(words, key, count)).sum()) + 10.0 ** model.unknown()
    assert abs(mass - 1) < 1e-9
    assert letters.spell(["abc"])[0] > letters.spell(["a" * 5 + "日"])[0]


def test_seating():
    rng = np.random.default_rng(3)
    t = language_model.seat(np.array([0, 1, 2, 1000, 10**7]), np.array([1.0, 1.0, 1e9, 5.0, 50.0]), 0.5, rng)
    assert t[0] == 0 and t[1] == 1 and t[2] == 2 and 1 < t[3] < 200 and t[4] < 5000
    exact = np.mean([language_model.seat(np.full(200, 30), np.full(200, 2.0), 0.0, rng).mean() for _ in range(20)])
    assert abs(exact - sum(2 / (2 + i) for i in range(1, 30)) - 1) < 0.1


def test_rare_letters_and_columns(make):
    docs = make([(1, "\x00  𝔘 日", None, None), (3, "a\nb", None, None)])
    assert language_model.score_held_out(docs.withColumn("word", F.lit(1))).count() == 2


def test_words_before_count(make):
    """What follows a word is told from the same words in another order."""
    pair = "red apple blue plum green pear"
    docs = make([(i, " ".join(random.Random(i).sample(["red apple", "blue plum", "green pear"], 3)), None, None) for i in range(300)] + [(1000, pair, None, None), (1001, "apple red plum blue pear green", None, None)])
    got = {r["doc_id"]: r for r in language_model.score_held_out(docs).collect()}
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    assert got[1000]["score"] > got[1001]["score"] + 3
    assert np.mean([r["score"] - r["base_score"] for i, r in got.items() if i < 300]) > 0


def test_context_restaurants_are_distributions(make):
    """Counts and seating against plain counting; each context's probabilities add up to one; scores against the sum over tokens."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(40)] + ["a zz b", "", "qq qq"]
    train = [i for i in range(len(texts)) if i < 40]
    counts, before = Counter(), Counter()
    for i in train:
        w = language_model.tokens(texts[i].encode())
        counts.update(w)
        before.update(zip([b"", *w], w, strict=False))
    over = language_model.shares(make([(i, t, None, None) for i, t in enumerate(texts)]), F.col("doc_id") < 40, share=200)
    assert over.numbers.count() > 3
    vocabulary, end, pairs, start, final, model, discount = language_model.seat_all(over, 3)
    rows = vocabulary.select("a", F.col("b").alias("n")).toArrow()
    assert {w: c for words, n in language_model.vocabulary(rows.to_batches()) for w, c in zip(words, n.tolist(), strict=True)} == dict(counts)
    assert discount == language_model.discount_of(sum(n == 1 for n in before.values()), sum(n == 2 for n in before.values()))
    hashed = lambda w: language_model.word_hash([w])
    word = {}
    for r in end.collect():
        words, k = language_model.unpacked_words(r["a"]), language_model.unpacked(r["b"], np.uint64)
        cu, t1 = np.split(language_model.unpacked(r["c"], np.uint64), 2)
        log = language_model.predicted(words, k, model)
        word |= {w: (int(k[i]), int(cu[i]), int(t1[i]), float(log[i])) for i, w in enumerate(words)}
    customers = Counter()
    for (u, _), n in before.items():
        customers[u] += n
    assert {w: x[1] for w, x in word.items() if x[1]} == dict(customers)
    assert sum(x[0] for x in word.values()) == sum(x[2] for x in word.values()) >= len(before)  # every table is a customer of the parent
    n, v = sum(counts.values()), len(counts)
    # What the shares were told at the start, by word.
    told = {}
    for r in over.numbers.collect():
        row = language_model._rows_at(over.path, r["share"]).to_pylist()[0]
        known = language_model.reply(start, r["share"])
        t0, log0 = language_model._joined(known, "a", np.uint64), language_model._joined(known, "b", np.float32)
        told |= {w: (t0[i], log0[i]) for i, w in enumerate(language_model.unpacked_words(row["words"]))}
    assert {w: int(x[0]) for w, x in told.items() if x[0]} == dict(Counter(u for u, _ in before))

    def own(u, w):
        if (u, w) not in before:
            return 0.0
        c = np.array([before[u, w]])
        strength = language_model.context_strength(np.array([float(told[u][0])]), np.array([told[w][1]]), discount)
        t = language_model.seat_pairs(language_model.pair_key(hashed(u), hashed(w)), c, strength, discount)
        return float((c - discount * t)[0]) / (1 + word[u][1])

    back = lambda u: (1 + discount * word[u][2]) / (1 + word[u][1])
    parent = lambda w: 10 ** word[w][3] if counts[w] else 10 ** model.unknown()
    assert abs(sum(parent(w) for w in counts) + 10 ** model.unknown() - 1) < 1e-5
    for u in customers:
        assert abs(sum(own(u, w) + back(u) * parent(w) for w in counts) + back(u) * 10 ** model.unknown() - 1) < 1e-5  # in single precision
    got = {r["doc_id"]: r for r in language_model.score_shares(over, pairs, start, final, model, discount, n, v).collect()}
    for i, text in enumerate(texts):
        t = language_model.tokens(text.encode())
        for name, p in (("score", parent), ("open_score", lambda w: 10 ** word[w][3])):
            assert got[i][name] == pytest.approx(sum(math.log10(own(u, w) + back(u) * p(w)) for u, w in zip([b"", *t], t, strict=False)), rel=1e-6)


def test_contexts_are_sampled_in_turns(make):
    """Two turns are kept; the second is seated from the first, its contexts are distributions too, and scores are of the mean of both."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcde") for _ in range(40)) for _ in range(40)] + ["a zz b", "", "c d"]
    over = language_model.shares(make([(i, t, None, None) for i, t in enumerate(texts)]), F.col("doc_id") < 40, share=200)
    later = []
    _, _, pairs, start, end, model, discount = language_model.seat_all(over, 3, later)
    assert len(later) == language_model.SEATINGS - 1 == 1
    counts, before = Counter(), Counter()
    for text in texts[:40]:
        w = language_model.tokens(text.encode())
        counts.update(w)
        before.update(zip([b"", *w], w, strict=False))
    hashed = lambda w: language_model.word_hash([w])
    told = [{}, {}, {}]
    for r in over.numbers.collect():
        words = language_model.unpacked_words(language_model._rows_at(over.path, r["share"]).to_pylist()[0]["words"])
        first = language_model._start(language_model.reply(start, r["share"]))
        told[0] |= {w: (first[0][i], first[1][i]) for i, w in enumerate(words)}
        for turn, path in ((1, end), (2, later[0].end)):
            log, _, cu, t = language_model._end(language_model.reply(path, r["share"]))
            told[turn] |= {w: (t[i], log[i], cu[i]) for i, w in enumerate(words)}
    models = [model, later[0].model]

    def tables(turn, u, w):
        key = language_model.pair_key(hashed(u), hashed(w))
        key = language_model._mixed(key + np.uint64(turn)) if turn else key
        strength = language_model.context_strength(np.array([float(told[turn][u][0])]), np.array([told[turn][w][1]]), discount)
        return language_model.seat_pairs(key, np.array([before[u, w]]), strength, discount)[0] if before[u, w] else 0.0

    for turn in (0, 1):
        opened = Counter()
        for u, w in before:
            opened[u] += tables(turn, u, w)
        assert {u: told[turn + 1][u][0] for u in opened} == dict(opened)
    assert any(told[1][u][0] != told[2][u][0] for u in counts)

    def p(turn, u, w):
        t, _, cu = told[turn + 1][u]
        parent = 10 ** told[turn + 1][w][1] if counts[w] else 10 ** models[turn].unknown()
        return (before[u, w] - discount * tables(turn, u, w)) / (1 + cu) + (1 + discount * t) / (1 + cu) * parent

    for u in counts:
        assert abs(sum(p(1, u, w) for w in counts) + p(1, u, b"zz") - 1) < 1e-5
    n, v = sum(counts.values()), len(counts)
    for r in language_model.score_shares(over, pairs, start, end, model, discount, n, v, later).collect():
        t = language_model.tokens(texts[r["doc_id"]].encode())
        assert r["score"] == pytest.approx(sum(math.log10((p(0, u, w) + p(1, u, w)) / 2) for u, w in zip([b"", *t], t, strict=False)), rel=1e-6)


def test_reversed_words_score_worse(make):
    rng = random.Random(8)
    after = {w: rng.sample(range(30), 3) for w in range(30)}

    def chain():
        at, out = rng.randrange(30), []
        for _ in range(40):
            out.append(f"w{at}")
            at = rng.choice(after[at])
        return out

    rows = [(i, " ".join(chain()), None, None) for i in range(200)]
    both = rows + [(1000 + i, " ".join(reversed(t.split())), None, None) for i, t, *_ in rows[:20]]
    got = {r["doc_id"]: r for r in language_model.score_held_out(make(both)).collect()}
    assert np.mean([got[i]["score"] - got[1000 + i]["score"] for i in range(20) if got[i]["held_out"] or not got[1000 + i]["held_out"]]) > 3


def test_rejected_rows_go_by_row_not_by_id(make, corpus):
    rows = [(None, None, None, None), (None, "the house and the water", "en", "s"), (5000, "12 !", "en", None), (5000, "das haus und das wasser", "de", None)]
    left = [(r["doc_id"], r["text"]) for r in language.keep_identified(make(corpus + rows)).collect()]
    assert len(left) == len(corpus) + 2 and {(None, rows[1][1]), (5000, rows[3][1])} <= set(left)


def test_distances_equal_compressed_lengths():
    """A text's distance from plain zstandard calls, window by window, and its score from the calibration's table."""
    import zstandard

    rng = random.Random(9)
    toxic = [(prose(rng, "en") + f" zorgblat {rng.choice(WORDS['en'].split())} " + prose(rng, "en", 9) + " vexnarg").encode() for _ in range(120)]
    ordinary = [prose(rng, "en", 50).encode() for _ in range(300)]
    model = toxicity.train(toxic, ordinary)
    assert any(x in model.contents[0] for x in (b"zorgb", b"vexna")) and b"zorgb" not in model.contents[1]
    for text in toxic[:5] + ordinary[:5] + [b"", "é 日本 \xa0".encode(), b"zorgblat " * 5000]:
        plain = []
        for w in toxicity.windows(b" " + b" ".join(text.lower().split()) + b" "):
            size = []
            for c in model.contents:
                p = zstandard.ZstdCompressionParameters.from_level(8, min_match=5, source_size=96, dict_size=len(c), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
                d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size.append(len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(toxicity.LEAD + w)))
            plain.append(min(12, max(0, size[1] - size[0])))
        best = sorted((model.evidence[x] for x in plain), reverse=True)[:5]
        assert model.distance(text) == int(4 * sum(sorted(best)) + 0.5)
        assert model.score(text) == model.shares[min(max(model.distance(text) - model.low, 0), len(model.shares) - 1)]


def test_classifiers_bear_internal_names(spark, make):
    rng = random.Random(2)
    rows = [(i, prose(rng, "en") + (" zorgblat" * 3 if i % 3 == 0 else ""), "en", "s", 1, 2, 3, "t") for i in range(90)]
    docs = make(rows, ", _id int, _label int, doc int, _text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0), 5, 6) for i in range(90)], "doc_id long, quality int, toxic int, _id int, text int")
    for module in (quality, toxicity):
        assert module.classify_held_out(docs, labels).count() == 90


def test_quality_score_equals_plain_sums():
    """A trained model's score from features that plain Python finds."""
    rng = random.Random(3)
    sample = [(prose(rng, "en").encode(), 1) for _ in range(40)] + [(prose(rng, "de").upper().encode(), 0) for _ in range(40)]
    model = quality.train(sample, epochs=3)
    mask = 2**64 - 1
    bucket = lambda x: ((x * 0x9E3779B97F4A7C15) & mask) >> 47

    def word_hash(word):
        total = 0
        for place, byte in enumerate(b" " + word):
            m = ((byte + 256 * place) * 0xD6E8FEB86659FD93) & mask
            total = (total + (m ^ (m >> 29))) & mask
        m = (0x20 * 0xD6E8FEB86659FD93) & mask
        return (total - (m ^ (m >> 29))) & mask

    for text in [sample[0][0], sample[-1][0], b"", b"one", b"a  b\tb b", "é à".encode()]:
        words = re.split(rb"[\x20\x09-\x0d]+", text)
        raw = re.sub(rb"[\x20\x09-\x0d]+", b" ", b" " + text + b" ")
        found = [bucket(int.from_bytes(raw[i : i + n], "big") + (n << 8 * n)) for n in (3, 4) for i in range(len(raw) - n + 1)]
        h = [word_hash(w) for w in words if w]
        found += [bucket(x ^ 0x5851F42D4C957F2D) for x in h] if h else []
        found += [bucket(((a ^ b) + lag) & mask) for lag in (1, 2) for a, b in zip(h, h[lag:], strict=False)]
        logit = model.bias + (sum(model.evidence[x] for x in found) / len(found) if found else 0.0)
        assert abs(model.score(text) - 1 / (1 + math.exp(-logit))) < 1e-9

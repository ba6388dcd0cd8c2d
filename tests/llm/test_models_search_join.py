import itertools
import random
import re
import zlib

import numpy as np
import pytest

from packframe.llm import ann, common, components, langid, ngram_join, quality, shingles

SF = "/root/testdata/sf0.001"


def test_letter_binding():
    a, b = langid.letter_vectors(np.array([97, 98, 97]))[:2]
    assert (langid.letter_vectors(np.array([97]))[0] == a).all() and abs(int(np.unpackbits(a ^ b).sum()) - 512) < 120
    grams = langid.n_grams("Ab, c\n")
    assert len(grams) == 4  # _ab ab_ b_c _c_
    one = langid.bundle(np.array([(97 * langid._BASE + 98) * langid._BASE + 97]), np.array([3]))
    signs = 1 - 2 * np.unpackbits(np.roll(a, 2) ^ np.roll(b, 1) ^ a).astype(int)
    assert (one == 3 * signs).all()


def test_bundle_in_parts(monkeypatch):
    grams, counts = np.unique(langid.n_grams("the quick brown fox jumps over the lazy dog"), return_counts=True)
    whole = langid.bundle(grams, counts)
    monkeypatch.setattr(langid, "N_GRAMS_AT_ONCE", 5)
    assert (langid.bundle(grams, counts) == whole).all()


def test_language_held_out_accuracy(spark):
    got = langid.op3_langid(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = got[got["held_out"]]
    assert set(held.index) == {i for i in got.index if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held["lang_pred"] == lang[held.index]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the and of the", "en"), (2, "der und die das", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (None, "the of", None), (1, "the and of the", "en")]
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    profiles = langid.learn(df)
    assert profiles.languages == ("de", "en")
    got = langid.identify(df.select("doc_id", "text", "lang"), profiles, ["doc_id", "text"]).collect()
    by = {r["text"]: (r["lang_pred"], r["score"]) for r in got}
    assert by["the and of the"][0] == "en" and by["der und die das"][0] == "de" and by[None] == by[""] == by["123 !!"] == ("und", 0.0) and len(got) == 7
    none = langid.learn(df.limit(0))
    assert none.languages == () and langid.identify(df.select("doc_id", "text"), none, ["doc_id"]).first()["lang_pred"] == "und"
    assert langid.identify(df.select("doc_id", "text").limit(0), profiles, ["doc_id"]).count() == 0
    long = "wort " * 300_000
    assert profiles.predict(long)[0] in ("de", "en")


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op9_quality(spark, d).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    held = got[got["held_out"] & got.index.isin(labels.index)]
    assert len(held) > 50 and (held["predicted"] == labels[held.index]).mean() > 0.95
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all() and got["score"].between(0, 1).all()


def test_discriminant_is_the_formula():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (200, 3)), 1: rng.normal(1, 2, (300, 3))}
    model = quality.Discriminant.of({c: (float(len(v)), v.sum(0), v.T @ v) for c, v in x.items()}, 0.1, 1e-3)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 500
    point = np.array([[0.3, -1, 2]])
    logs = {}
    for c, v in x.items():
        s = 0.9 * np.cov(v.T, bias=True) + 0.1 * np.diag(np.diag(pooled)) + np.eye(3) * (1e-3 * np.trace(pooled) / 3 + 1e-12)
        m = point[0] - v.mean(0)
        logs[c] = np.log(len(v) / 500) - 0.5 * m @ np.linalg.inv(s) @ m - 0.5 * np.log(np.linalg.det(s))
    assert model.score(point)[0] == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "A b. " * 50_000, "x"), (None, "\n\n", "x"), (3, "A b. " * 50_000, "x")], "doc_id long, text string, x string").select("doc_id", "text")
    measured = quality.measure(df, ["doc_id"])
    none = quality.fit(measured.select(measured["doc_id"].alias("label"), "x").limit(0))
    assert [r["score"] for r in quality.score(measured, none, ["doc_id"]).collect()] == [0.5] * 5
    one = quality.fit(measured.selectExpr("1 as label", "x"))
    assert all(r["score"] > 0.99 for r in quality.score(measured, one, ["doc_id"]).collect())
    assert quality.score(measured.limit(0), one, ["doc_id"]).count() == 0
    assert np.isfinite(quality.statistics([None, b"", b"   ", b"\xff" * 10, b"a" * 10**6])).all()


def reference_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_shingles_are_the_sets():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbB éÉ\t\n\x0b\x1c\xa0") for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["", None, "one two", "a " * 5000, "x" * 100_000, " lead", "trail "]
    sets = shingles.shingle_sets([None if t is None else t.encode() for t in texts])
    seen = {}
    for t, s in zip(texts, sets, strict=True):
        want = reference_set(t)
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
        for shingle, n in ((frozenset(want), tuple(s.tolist())),):
            assert seen.setdefault(n, shingle) == shingle
    assert len({tuple(s.tolist()) for s in sets}) == len({frozenset(reference_set(t)) for t in texts})


def near_copies(seed=0, groups=30, size=12, words=60):
    rng = random.Random(seed)
    out = []
    common = [f"p{i}" for i in range(20)]
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, words, 3 * words]))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(5000)}"
            if rng.random() < 0.4:
                at = rng.randrange(len(t))
                t[at:at] = common
            out.append(" ".join(t))
    return out


def brute_force(texts):
    sets = [reference_set(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("few, block", [(32, 4096), (1, 4096), (2, 3)])
def test_join_is_brute_force(spark, monkeypatch, few, block):
    """With small limits, hubs, blocks and the second round do all of the work."""
    monkeypatch.setattr(ngram_join.candidates, "__defaults__", (few, block))
    monkeypatch.setattr(ngram_join.shards, "__defaults__", (few, block))
    texts = near_copies() + [None, "", "  ", "one two", "ONE two", "one two three"] + ["long " + "word " * 3000] * 2
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, set string, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(df).collect()}
    sizes, roots = brute_force(texts)
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}
    assert len({*roots}) < len(texts) - 50


@pytest.mark.parametrize("id_bytes, hot", [(1, 1), (8, 1), (2, 3)])
def test_join_with_twins_and_parts(spark, monkeypatch, id_bytes, hot):
    """Sets whose first digest halves are equal stay apart; rows of frequent shingles are dealt to parts."""
    monkeypatch.setattr(ngram_join.prefixes, "__defaults__", (*ngram_join.prefixes.__defaults__[:-1], hot))
    texts = near_copies(1, size=25)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(df, id_bytes=id_bytes).collect()}
    sizes, roots = brute_force(texts)
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}
    rows, numbers = ngram_join._numbered(ngram_join.shingled(df, id_bytes=id_bytes), id_bytes)
    assert bool(numbers.twins) == (id_bytes < 8) and rows.select("set").distinct().count() == len({frozenset(reference_set(t)) for t in texts})


def test_words_that_collide_by_construction(spark):
    """Thue-Morse words and their complements are equal under any polynomial modulo a power of two."""
    for n in (1024, 2048, 4096, 1 << 17):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        a, b = shingles.shingle_sets([one.encode(), two.encode()])
        assert a.tolist() != b.tolist()
    assert shingles.shingle_sets([b"x" * 70_000 + b" y"])[0].tolist() == shingles.shingle_sets([b"other", b"X" * 70_000 + b"\n Y"])[1].tolist()
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted(r["component_id"] for r in ngram_join.classes(df).collect()) == [1, 2]


def test_one_of_each(spark):
    t = " ".join(f"w{i}" for i in range(30))
    u = " ".join(f"v{i}" for i in range(30))
    rows = [(3, t), (5, t + " more"), (5, u), (5, u), (7, u + " x"), (None, t), (None, t), (9, None), (9, " "), (9, " ")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, `set` string, n int")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got.collect()])) == sorted(map(str, [(3, t), (5, u), (None, t), (None, t), (9, None), (9, " "), (9, " ")]))
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.classes(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (9, t + " more"), (7, "other text"), (3, None)], schema)
    got = sorted(ngram_join.classes(df).collect(), key=str)
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(3, 0, 3), (7, 1, 7), (7, 26, 7), (7, 26, 7), (9, 27, 7)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_prefix_tree_is_exact():
    rng = np.random.default_rng(1)
    pool = np.sort(rng.integers(0, 1 << 63, 120).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(60)]
    sets += [np.sort(np.delete(s, rng.integers(0, len(s), max(0, len(s) // 8)))) for s in sets if len(s) > 3]
    sets = list({s.tobytes(): s for s in sets}.values())
    tree = ngram_join.PrefixTree(sets)
    for x in sets:
        want = {i for i, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))}
        assert set(tree.probe(x).tolist()) == want
    assert len(ngram_join.PrefixTree([]).probe(sets[0])) == 0


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(400)]
    rng.shuffle(chain)
    edges = chain + [(1000, x) for x in range(1001, 1300)] + [(5, 5), (2000, 2001), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {i: 0 for i in range(1, 401)} | {x: 1000 for x in range(1001, 1300)} | {2001: 2000}
    assert {k: v for k, v in got.items() if k != v} == want and all(got.get(r, r) == r for r in want.values())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_neighbours(rows, k=5):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in sound:
        if i % 50 == 0:
            scores = {}
            for j, w in sound:
                if j != i and len(w) == len(v):
                    s = float((v * w).sum() / np.sqrt((v * v).sum()) / np.sqrt((w * w).sum()))
                    scores[j] = max(s, scores.get(j, -2))
            out[i] = sorted(((-round(s, 9), j) for j, s in scores.items()))[:k]
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * 0.4).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, [1.0] * 12) for i in range(120)] + [(2000, [1.0, 0.0]), (2001, [0.5, 0.5]), (2050, None), (2100, []), (2150, [0.0] * 12), (2200, [float("nan")] * 12), (2250, [1.0, None]), (None, [1.0] * 12), (100, rows[100][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, ids string")
    vectors = ann.sound(df)
    index = ann.build_index(vectors, shard_nodes=200).cache()
    assert index.filter("dim = 12").count() == 5
    monkeypatch.setattr(common, "COMMON", 2)  # copies of one vector are queries too
    got = ann.search(index, vectors.filter("vec_id % 50 = 0"), at_most=7).toPandas()
    want = exact_neighbours(rows)
    assert set(got["query_id"]) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and len(g) == len(want[q])
        assert [tuple(x) for x in zip(-g["score"].round(9), g["vec_id"], strict=True)] == sorted(zip(-g["score"].round(9), g["vec_id"], strict=True))
        hits += len({*g["vec_id"]} & {j for _, j in want[q]})
        total += len(g)
    assert hits / total >= 0.97
    same = got[got["query_id"] == 1000].sort_values("rank")["vec_id"].tolist()
    assert same == [1001, 1002, 1003, 1004, 1005]  # ties by id among equal vectors
    none = ann.search(ann.build_index(vectors.limit(0)), vectors.limit(0))
    assert none.count() == 0


def test_graph_levels():
    v = np.random.default_rng(0).normal(size=(700, 8))
    levels, neighbours = ann.build(v)
    assert len(levels) > 1 and all(set(b) <= set(a) for a, b in itertools.pairwise(levels))
    assert neighbours[0].shape == (700, 2 * ann.LINKS)
    assert ann.build(v[:1])[0][0].tolist() == [0]


def test_recall_on_given_vectors(spark):
    """op10_ann as registered against brute force, and with small shards, over the whole table."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    data = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    want = {q: [j for _, j in w] for q, w in exact_neighbours(data).items()}
    vectors = ann.sound(rows)
    for got in (ann.op10_ann(spark, "/root/testdata/sf0.1"), ann.search(ann.build_index(vectors, shard_nodes=150), vectors.filter("vec_id % 50 = 0"))):
        found = {}
        for r in got.orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert found.keys() == want.keys() and all(len(found[q]) == len(want[q]) for q in want)
        hits = sum(len({*found[q]} & {*want[q]}) for q in want)
        assert hits / sum(map(len, want.values())) >= 0.95


def test_extreme_vectors(spark):
    rng = np.random.default_rng(2)
    plain = rng.normal(size=(120, 6))
    factor = np.array([1.0, 1e160, 1e-200, 1e300, 5e-310])[np.arange(120) % 5]
    rows = [(i, (plain[i] * factor[i]).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = ann.sound(df)
    got = {}
    for r in ann.search(ann.build_index(vectors), vectors.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (0, 50, 100):
        u = plain / np.linalg.norm(plain, axis=1, keepdims=True)
        scores = u @ u[q]
        scores[q] = -9
        best = np.argsort(-scores)[:5]
        assert [x for x, _ in got[q]] == best.tolist() and np.allclose([s for _, s in got[q]], scores[best], atol=1e-6)


def test_common_phrases_alone_make_no_shards(spark, monkeypatch):
    """Sets that share a few shingles with many others don't meet them, and no link is lost, whatever it shares."""
    r = random.Random(5)
    monkeypatch.setattr(ngram_join.candidates, "__defaults__", (3, 4096))
    monkeypatch.setattr(ngram_join.shards, "__defaults__", (3, 4096))
    phrases = [" ".join(f"p{i}_{j}" for j in range(5)) for i in range(4)]
    texts = []
    for i in range(60):
        words = [f"w{i}_{j}" for j in range(80)]
        at = r.randrange(80)
        texts.append(" ".join([*words[:at], phrases[i % 4], *words[at:]]))
        for _ in range(i % 3):  # copies with up to 12 words changed at either end: above and below the limit
            k = r.randrange(13)
            texts.append(" ".join([*[f"x{i}_{r.random()}" for _ in range(k)], *texts[-1].split(" ")[k:]]))
    base = [f"c{j}" for j in range(60)]
    texts += [" ".join(base[: r.randrange(44, 61)] + [phrases[i % 4]]) for i in range(20)]  # a large group of near copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.classes(docs).collect()}
    sizes, roots = brute_force(texts)
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))} and 20 < len({*roots}) < len(texts) - 20
    common = ngram_join.shared(ngram_join.prefixes(docs.select("text"), ngram_join.frequent(docs.select("text"))))
    members = ngram_join.shards(common).select("set").distinct().count()
    assert 0 < members <= 20  # those of the large group, not the 60 and their copies

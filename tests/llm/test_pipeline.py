import unicodedata

import numpy as np
import pytest

import corpus_pipeline
from packframe.llm import langid, ngram_join, packing
from tests.llm import twins

SF = "/root/testdata/sf0.001"


def test_stages_against_one_by_one(spark, tmp_path):
    """Each stage against a plain version of it on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.toPandas()
        if name == "language_id":
            twin = twins.Languages([(t, x) for i, t, x in zip(before["doc_id"], before["text"], before["lang"], strict=True) if twins.fold(i, 5) != 0])
            letters = lambda t: sum(unicodedata.category(c)[0] == "L" for c in t or "")
            want = {i for i, t in zip(before["doc_id"], before["text"], strict=True) if (p := twin.predict(t))[0] != "und" and (p[1] >= 3 / 32 or letters(t) < 64)}
        elif name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
            text = dict(zip(before["doc_id"], before["text"], strict=True))
            learned = [(text[i], q) for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if twins.fold(i, 3) != 1 and i in text]
            want = {i for i, x in zip(before["doc_id"], twins.quality(before["text"], learned), strict=True) if x >= 0.5}
        elif name == "ngram_join":
            from tests.llm.test_models_search_join import brute_force

            order = before.sort_values("doc_id").reset_index(drop=True)
            _, roots = brute_force(order["text"].tolist())
            want = {order["doc_id"][r] for r in {*roots}}
        else:
            want = set(before["doc_id"])
            assert (after.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all()
        assert set(after["doc_id"]) == want
        if name != "packing":
            assert docs.columns == columns and len(after) == len(want)
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", None, 3, 0.1, "x"), (2, text + " more", "en", "s", 3, 0.1, "x"), (None, text, None, "s", 3, 0.1, "x"), (4, None, "en", "s", 3, 0.1, "x"), (5, "", "en", "s", None, 0.1, "x"), (1, text, "en", None, 3, 0.1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.in_learned_languages(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert corpus_pipeline.of_quality(spark, docs, str(tmp_path)).count() == 6  # without labels nothing is rejected
    one = corpus_pipeline.without_near_copies(spark, docs, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "4", "5", "None"]
    other = spark.createDataFrame([(1, " ".join(f"other{i}" for i in range(40)), "en", None, 3, 0.1, "x")], docs.schema)
    for many in (docs.unionByName(other), other.unionByName(docs)):  # an id with two texts is two documents
        kept = corpus_pipeline.without_near_copies(spark, many, str(tmp_path)).collect()
        assert sorted(str(r["doc_id"]) for r in kept) == ["1", "1", "4", "5", "None"] and {r["text"] for r in kept if r["doc_id"] == 1} == {text, other.first()["text"]}
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), str(tmp_path)).collect()


UNLEARNED = [
    "Съешь же ещё этих мягких французских булок да выпей чаю, а потом расскажи нам всем о том, как прошёл вчерашний день в деревне",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα, είναι προικισμένοι με λογική και συνείδηση",
    "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء ولكل إنسان حق التمتع",
]


def test_unlearned_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([*UNLEARNED, *(" ".join([t] * 20) for t in UNLEARNED)])], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.in_learned_languages(spark, docs.unionByName(rows), SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}


def test_noise_is_below_the_floor(spark):
    rng = np.random.default_rng(0)
    profiles = langid.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for low, high in ((0x430, 0x450), (0x3B1, 0x3CA), (0xAC00, 0xD7A3), (0x627, 0x64B)):
        texts = [" ".join("".join(map(chr, rng.integers(low, high, rng.integers(2, 9)))) for _ in range(100)) for _ in range(200)]
        assert sum(profiles.predict(t)[1] >= langid.LEAST for t in texts) <= 6


def test_short_texts_are_not_judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = spark.createDataFrame([(-1, "Edstou reinan ed for.", "en"), (-2, "Rehaea lyth erst. Tistth.", "en"), (-3, "12 .", "en")], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.in_learned_languages(spark, docs.unionByName(rows), SF).select("doc_id").filter("doc_id < 0").collect()}
    assert kept == {-1, -2}


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in (1, 3, 4, 5, 6, 7, 8, 9, 10)} | ({"op2"} if any(n.startswith("op2_") for n in names) else set())
    assert "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()
    assert ngram_join.FEW >= 1
    with pytest.raises(KeyError):
        names["nothing"]

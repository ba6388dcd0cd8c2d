"""The registered queries that SQL can't express, over whole tables, against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest

from packframe.llm import audio, byte_bpe, langid, packing, quality
from tests.llm import twins

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def by_id(df):
    got = df.toPandas()
    assert got["doc_id"].is_unique
    return got.set_index("doc_id")


def test_op3_langid(spark, documents):
    twin = twins.Languages([(t, x) for i, t, x in zip(documents["doc_id"], documents["text"], documents["lang"], strict=True) if twins.fold(i, 5) != 0])
    got = by_id(langid.op3_langid(spark, SF))
    assert len(got) == len(documents)
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        lang, score = twin.predict(text)
        assert got.loc[i, "lang_pred"] == lang and got.loc[i, "score"] == pytest.approx(score, abs=1e-9) and got.loc[i, "held_out"] == (twins.fold(i, 5) == 0)


def test_op4_packing(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.op4_packing(spark, SF).toPandas()
    want = {}
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        ids = fresh.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[(i, k // 4096)] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1


def test_op5_audio(spark, documents):
    got = by_id(audio.op5_audio(spark, SF))
    assert len(got) == len(documents)
    seen = {}
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got.loc[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = audio.write_audio(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        full, rest = divmod(len(payload), 1417)  # bytes of payload in a frame of 320 kbit/s
        assert f"frames={full + bool(rest)};samples={1152 * (full + bool(rest))};crc={full + bool(rest)}/{full + bool(rest)};vbr=true;skipped=0" in r["feature"]
        assert seen.setdefault(text, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_op6_byte_bpe(spark, documents):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.encoder().ranks, special_tokens={})
    got = by_id(byte_bpe.op6_byte_bpe(spark, SF))
    assert len(got) == len(documents)
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        ids = own.encode_ordinary(text or "")
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_op9_quality(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    text = dict(zip(documents["doc_id"], documents["text"], strict=True))
    learned = [(text[i], q) for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if twins.fold(i, 3) != 1 and i in text]
    want = twins.quality(documents["text"], learned)
    got = by_id(quality.op9_quality(spark, SF))
    assert len(got) == len(documents)
    for i, score in zip(documents["doc_id"], want, strict=True):
        assert got.loc[i, "score"] == pytest.approx(score, abs=1e-6) and got.loc[i, "held_out"] == (twins.fold(i, 3) == 1) and got.loc[i, "predicted"] == (got.loc[i, "score"] >= 0.5)


def test_ties(spark):
    """Equal cosines go to the language that sorts first; a score of exactly one half is predicted as 1."""
    df = spark.createDataFrame([(1, "abc abc", "b"), (2, "abc abc", "a"), (3, "xyz", "c")], "doc_id long, text string, lang string")
    profiles = langid.learn(df)
    assert profiles.predict("abc")[0] == "a"
    same = {c: (10.0, np.zeros(2), np.eye(2) * 10) for c in (0, 1)}
    assert quality.Discriminant.of(same).score(np.ones((1, 2)))[0] == 0.5


def test_quality_columns_that_clash(spark):
    rows = [(1, "Good words here.", "a", 7.0, 1), (2, None, "b", 8.0, 0), (None, "x" * 300_000 + " y", "c", 9.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string, score double, label int")
    measured = quality.measure(df, ["doc_id"])
    assert measured.columns == ["doc_id", "x"] and measured.count() == 3
    model = quality.fit(quality.labelled(measured, spark.createDataFrame([(1, 1, "z"), (2, 0, "z"), (None, 1, "z")], "doc_id long, quality int, x string")))
    got = quality.score_texts(df, model, df.columns, name="packframe_score")
    assert got.columns == [*df.columns, "packframe_score"] and got.filter("packframe_score between 0 and 1").count() == 3


def test_long_chat_and_page(spark, tmp_path):
    from packframe.llm import chat

    long = "<|im_end|>\n<|im_start|>x <\\\\| " * 40_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = chat.read_chats(chat.format_chats(df)).first()
    assert got["loss_text"] == long and [t["text"] for t in got["turns"]] == [long, long]

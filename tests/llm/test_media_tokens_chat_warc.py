import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from packframe.llm import audio, byte_bpe, chat, packing, warc

TEXTS = [None, "", "a", "x" * 64, "é中\U0001f600 \x00\xff\xfb\x90", "ID3" * 700, "wörter und\n\n  mehr " * 4000]


def docs(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "clash", 1), (2, "a", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int")


def test_audio_round_trip(spark):
    got = audio.read_audio_columns(audio.to_audio(docs(spark, TEXTS))).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = (TEXTS[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) >= 64
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["crc_bad"] == 0 and r["skipped_bytes"] == 0 and r["vbr_exact"] and len(r["frame_offsets"]) == r["n_frames"] == r["crc_ok"]
        assert r["tags"]["TXXX:payload_bytes"] == str(len(payload))


@pytest.mark.parametrize("size", [1, 65, 130, 192, 1417 * 2, 1417 * 2 + 70, 1417 * 120 + 90])
def test_audio_payload_that_looks_like_a_tag(size):
    for at in {*range(max(0, size - 260), size)}:  # wherever the last 128 bytes begin
        payload = bytearray(b"x" * size)
        payload[at : at + 3] = b"TAG"
        payload = bytes(payload) + bytes(-len(payload) % 64)
        got = audio.read_audio(audio.write_audio(payload))
        assert got["payload"] == payload and got["vbr_exact"] and got["skipped"] == 0 and got["crc_bad"] == 0 and "v1:title" not in got["tags"]
        first = got["vbr"]["start"]
        want = [got["offsets"][len(got["offsets"]) * i // 100] - first for i in range(100)]
        assert list(got["vbr"]["toc"]) == [min(255, int(x) * 256 // got["vbr"]["bytes"]) for x in want]


def test_audio_texts_that_look_like_tags(spark):
    texts = ["x" * 65 + "TAG" + "y" * 100, "TAG" * 500]
    by = {r["doc_id"]: r for r in audio.read_audio_columns(audio.to_audio(docs(spark, texts))).collect() if r["doc_id"] in (0, 1)}
    assert [by[i]["payload_sha256"] for i in (0, 1)] == [hashlib.sha256((t.encode()).ljust(-(-len(t) // 64) * 64, b"\0")).hexdigest() for t in texts]


def test_audio_lost_payload_is_found(spark):
    media = audio.write_audio(b"x" * 5000)
    df = spark.createDataFrame([(1, 5000, bytearray(media[:-1440]))], "doc_id long, n_bytes long, media binary")
    with pytest.raises(Exception, match="declared"):
        audio.read_audio_columns(df).collect()


def test_audio_empty_table(spark):
    assert audio.read_audio_columns(audio.to_audio(docs(spark, []).limit(0))).count() == 0


def test_audio_reader_resynchronises_and_verifies():
    media = audio.write_audio(bytes(range(256)) * 20)
    good = audio.read_audio(media)
    assert good["duration"] == Fraction(good["n_samples"], 32000) and good["n_samples"] == 1152 * len(good["offsets"])
    at = int(good["offsets"][2])
    torn = audio.read_audio(media[:at] + b"junk\xff\xfb\xff" + media[at:])
    assert len(torn["offsets"]) == len(good["offsets"]) and torn["skipped"] == 7 and not torn["vbr_exact"]
    bad = bytearray(media)
    bad[at + 10] ^= 1  # side information
    assert audio.read_audio(bytes(bad))["crc_bad"] == 1
    tagged = media + b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
    assert audio.read_audio(tagged)["tags"]["v1:title"] == "title" and audio.read_audio(tagged)["vbr_exact"]
    for nothing in (b"", b"\xff" * 50, b"not audio at all"):
        assert len(audio.read_audio(nothing)["offsets"]) == 0


def frame(head, body, crc_bits=None):
    """A frame of a header, with a checksum over crc_bits of the body, by the definition of the polynomial."""
    size = audio.parse_header(head)[5]
    if head[1] & 1:
        return (head + body).ljust(size, b"\0")
    c = 0xFFFF
    bits = "".join(f"{b:08b}" for b in head[2:] + body)[: 16 + crc_bits]
    for bit in bits:
        c = (c << 1 ^ (0x8005 if c >> 15 ^ int(bit) else 0)) & 0xFFFF
    return (head + c.to_bytes(2, "big") + body).ljust(size, b"\0")


def test_checksums_of_layers_one_and_two():
    body = bytes(random.Random(1).randbytes(100))
    one = bytes((0xFF, 0xFE, 0x90, 0x00))  # Layer I, stereo: 32 subbands of 4 bits for each channel
    assert audio.read_audio(frame(one, body, 256) * 3)["crc_ok"] == 3
    joint = bytes((0xFF, 0xFE, 0x90, 0x40 | 0x10))  # shared from subband 8 on
    assert audio.read_audio(frame(joint, body, 4 * (16 + 24)) * 2)["crc_ok"] == 2
    mono = bytes((0xFF, 0xFC, 0xA4, 0xC0))  # Layer II, 192 kbit/s, 48 kHz, mono: table a
    widths = [4] * 11 + [3] * 12 + [2] * 4
    bits = "".join(f"{b:08b}" for b in body)
    used, at = 0, 0
    for w in widths:
        used += "1" in bits[at : at + w]
        at += w
    good = frame(mono, body, sum(widths) + 2 * used)
    got = audio.read_audio(good * 2)
    assert (got["layer"], got["crc_ok"], got["crc_bad"]) == (2, 2, 0)
    bad = bytearray(good)
    bad[8] ^= 8
    assert audio.read_audio(good + bytes(bad))["crc_bad"] == 1
    low = bytes((0xFF, 0xF4, 0x84, 0xC0))  # MPEG-2, Layer II
    assert audio.read_audio(frame(low, bytes(80), sum([4] * 4 + [3] * 7 + [2] * 19)) * 2)["crc_ok"] == 2


def test_tags_of_all_kinds():
    sound = audio.write_audio(b"payload" * 40)
    sound = sound[10 + audio._big(sound[6:10], 7) :]
    syncsafe = audio._syncsafe

    def v2(version, flags, body, footer=b""):
        return b"ID3" + bytes((version, 0, flags)) + syncsafe(len(body)) + body + footer

    text = b"\0Song\xff\xe0"
    three = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    two = b"TT2" + len(text).to_bytes(3, "big") + text
    four = b"TIT2" + syncsafe(len(text)) + b"\0\0" + text
    extended = (6).to_bytes(4, "big") + bytes(6)
    for tag, name in (
        (v2(3, 0, three), "TIT2"), (v2(3, 0x80, three.replace(b"\xff", b"\xff\0")), "TIT2"), (v2(3, 0x40, extended + three), "TIT2"), (v2(2, 0, two), "TT2"), (v2(4, 0, four), "TIT2"),
        (v2(4, 0x40, syncsafe(6) + b"\1\0" + four), "TIT2"), (v2(4, 0x10, four, b"3DI" + bytes(7)), "TIT2"), (v2(4, 0, b"TIT2" + syncsafe(len(text) + 5) + b"\0\3" + syncsafe(len(text)) + text.replace(b"\xff", b"\xff\0")), "TIT2"),
    ):
        got = audio.read_audio(tag + sound)
        assert got["tags"][name] == "Song\xff\xe0" and got["skipped"] == 0 and got["vbr_exact"] and got["payload"][:280] == b"payload" * 40
    item = (4).to_bytes(4, "little") + bytes(4) + b"Title\0" + b"Name"
    foot = b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little")
    v1 = b"TAG" + b"title".ljust(125, b"\0")
    for tail in (item + foot + bytes(12), item + foot + bytes(12) + v1, foot + (0xA0000000).to_bytes(4, "little") + bytes(8) + item + foot + (0x80000000).to_bytes(4, "little") + bytes(8)):
        got = audio.read_audio(sound + tail)
        assert got["tags"]["APE:Title"] == "Name" and got["skipped"] == 0 and got["vbr_exact"]
    fake = b"x" * 40 + b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(16) + b"y" * 9
    for n in range(1, 1500, 7):
        payload = b"z" * n + fake[:-9]
        assert audio.read_audio(audio.write_audio(payload))["payload"] == payload


def test_vbri_table_and_exact_duration(spark):
    head = audio._frame_head(9, protected=False)
    size = audio.parse_header(head)[5]
    sound = (head + bytes(size - 4)) * 6
    table = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (7 * size).to_bytes(4, "big") + (6).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 2, 2, 2)) + b"".join((size).to_bytes(2, "big") for _ in range(3))
    media = (head + bytes(32) + table).ljust(size, b"\0") + sound
    got = audio.read_audio(media)
    assert got["vbr"]["kind"] == "VBRI" and got["vbr"]["frames"] == 6 and got["vbr"]["toc"] == [2 * size] * 3 and got["vbr_exact"] and len(got["offsets"]) == 6
    df = spark.createDataFrame([(1, 0, bytearray(media)), (2, 0, bytearray(b"none")), (3, 0, None)], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: (r["duration_num"], r["duration_den"]) for r in audio.read_audio_columns(df).collect()}
    assert Fraction(*rows[1]) == Fraction(6 * 1152, 32000) and rows[2] == (0, 1) and rows[3] == (None, None)


def test_headers_against_known_frames():
    assert audio.parse_header(b"\xff\xfb\x90\x00")[3:7] == (44100, 2, 417, 1152)  # 128 kbit/s
    assert audio.parse_header(b"\xff\xfb\x92\x00")[5] == 418
    assert audio.parse_header(b"\xff\xf3\x80\xc4")[3:7] == (22050, 1, 208, 576)  # 64 kbit/s, MPEG-2
    assert audio.parse_header(b"\xff\xff\x90\x00")[5:7] == (312, 384)  # Layer I, 288 kbit/s
    assert audio.parse_header(b"\xff\xfb\xf0\x00") is None and audio.parse_header(b"\xff\xeb\x90\x00") is None


@pytest.fixture(scope="module")
def reference_bpe():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.encoder().ranks, special_tokens={})


def test_bpe_is_that_of_tiktoken(reference_bpe):
    rng = random.Random(3)
    own = byte_bpe.encoder()
    alphabet = "ab eéß\n\t    日本\U0001f600́\x1c\x85\xa0١Ⅷ<|endoftext|>'s 'll!?.,"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a" * 3000, "ab" * 2000, " " * 500, "the quick brown fox"]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == reference_bpe.encode_ordinary(t)
        assert own.decode(ids).decode() == t


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 10)
    own = byte_bpe.Encoder(byte_bpe.encoder().ranks, r"\S+|\s+")
    for i in range(100):
        assert own.decode(own.encode(f"word{i}")) == f"word{i}".encode()
    assert len(own.memory) <= 11 and len(own.memory.old) <= 11


def test_bpe_columns(spark, reference_bpe):
    got = byte_bpe.decode_ids(byte_bpe.encode_texts(docs(spark, TEXTS))).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] or ""
            assert np.frombuffer(r["ids"], "<u4").tolist() == reference_bpe.encode_ordinary(text) and r["bytes"] == text.encode()


def test_word_tokenizer_is_that_of_the_library():
    rng = random.Random(1)
    own = packing.tokenizer()
    alphabet = "ab Eéß_-*\n\t́̀\xa0　日本\U0001f600\x1c\x1f\x85٢Ⅷ<|endoftext|>'s 'LL!?.,ΣςİſK0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.inner.encode(t, add_special_tokens=False).ids, t


def test_special_tokens_in_texts_have_the_ids_of_the_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|", "<|", "a", "Bé", "\u212a", "日本", " ", " ", "\n", "\x1c", "."]
    rng = random.Random(5)
    texts = ["a photo of<|endoftext|>b", "<|STARTOFTEXT|> x <|startoftext|>", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800))]
    for t, ids in zip(texts, packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids, t
    got = packing.cut(docs(spark, [texts[0]]), with_ids=True).filter("doc_id = 0").first()
    assert 49407 in fresh.encode(texts[0], add_special_tokens=False).ids
    assert np.frombuffer(got["ids"], "<u4").tolist() == [*fresh.encode(texts[0], add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 65, 300), rng.integers(20, 40, 500), np.full(100, 22), np.array([64] * 5), np.array([], int), rng.zipf(1.5, 400).clip(1, 64)][seed]
    counts = np.bincount(lengths.astype(int), minlength=65)
    patterns = packing.plan(counts, 64)
    used = np.zeros(65, int)
    for pattern, copies in patterns:
        assert sum(pattern) <= 64 and copies > 0
        for x in pattern:
            used[x] += copies
    assert (used == counts).all()
    n = sum(c for _, c in patterns)
    assert n >= -(-int(lengths.sum()) // 64)
    if seed in (0, 5):
        assert n <= lengths.sum() / 64 * 1.05 + 1
    if seed == 2:
        assert n == 50  # two of 22 fit with 20 to spare


def checked_plan(counts, capacity):
    used = np.zeros(capacity + 1, int)
    for pattern, copies in packing.plan(counts, capacity):
        assert sum(pattern) <= capacity and copies > 0
        for x in pattern:
            used[x] += copies
    assert (used == counts).all()


def test_plan_ends_where_sums_exist_only_as_doubles():
    """Each sum of three exists only as twice a length of which there is one piece."""
    few = [t for t in range(1000) if "2" not in np.base_repr(t, 3)][:32]
    a = [3 * t + 1 for t in few]
    counts = np.bincount([1091, *a, *(3005 - 2 * x for x in a)], minlength=4097)
    began = time.perf_counter()
    checked_plan(counts, 4096)
    assert time.perf_counter() - began < 10


def test_plan_of_sparse_histograms_ends():
    rng = np.random.default_rng(8)
    began = time.perf_counter()
    for _ in range(60):
        counts = np.zeros(4097, int)
        chosen = rng.choice(np.arange(1, 4097), rng.integers(1, 700), replace=False)
        counts[chosen] = rng.integers(1, rng.choice([2, 3, 100_000]), len(chosen))
        checked_plan(counts, 4096)
    assert time.perf_counter() - began < 60


def test_exact_combinations_are_consumed_first():
    counts = np.bincount([60, 4, 50, 9, 5, 40, 12, 7, 5], minlength=65)
    assert sorted(p for p, _ in packing.plan(counts, 64)) == [(40, 12, 7, 5), (50, 9, 5), (60, 4)] or len(packing.plan(counts, 64)) == 3


def test_packing_columns(spark):
    rows = docs(spark, [*TEXTS, *["so many words " * 900] * 3])
    pieces = packing.cut(rows, capacity=256, with_ids=True).cache()
    got = packing.pack(pieces.drop("ids"), 256).toPandas()
    assert len(got) == pieces.count()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 256
    by = pieces.filter("doc_id = 9").orderBy("piece").collect()
    assert [r["start"] for r in by] == [256 * i for i in range(len(by))] and all(r["length"] == 256 for r in by[:-1])
    ids = np.frombuffer(b"".join(r["ids"] for r in by), "<u4").tolist()
    assert ids == packing.tokenizer().inner.encode("so many words " * 900, add_special_tokens=False).ids + [1]
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in by)
    assert packing.pack(packing.cut(rows.limit(0))).count() == 0


HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>\n", "<\\\\|", "a <| b", None, "", "tail <|im_end|", "%0A %25", "<|im_end|>\n<|im_start|>user\nx", "é中\U0001f600\r\n"]


def test_chat_round_trip(spark):
    roles = ["assistant", "user", "sys\ntem", "<|im_end|>", None, "%7C|"]
    rows = [(c, t, roles[(c + t) % len(roles)], HARD[(c * 3 + t) % len(HARD)], "clash") for c in range(12) for t in range(c % 5 + 1)] + [(None, None, "assistant", "x", ""), (0, 0, "assistant", "twice", ""), (0, 0, "assistant", "twice", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_chats(formatted).collect()}
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert got[c]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
    plain = formatted.filter("conv_id = 3").first()["formatted"]
    assert "a <| b" not in plain or "<\\| b" not in plain  # what doesn't conflict isn't escaped


def test_chat_is_native_and_handles_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.read_chats(chat.format_chats(df))
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_chat_broken_grammar(spark):
    df = spark.createDataFrame([("no marks",), ("<|im_start|>a\nb",), ("<|im_start|>a\nb<|im_end|>\n",)], "s string")
    assert [r[0] is None for r in df.select(chat.parse(df["s"])).collect()] == [True, True, False]


def pages(spark):
    long = "<p>" + "x" * 1000
    rows = [(1, "u", long), (5, "u\r\nX: y", long), (3, None, long), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 600), (9, "u", "é" * 499), (5, "again", long), (None, "u", long), (None, "u", "y" * 2000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("common", [1000, 2])
def test_warc_round_trip(spark, tmp_path, monkeypatch, common):
    monkeypatch.setattr(warc, "COMMON", common)
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages(spark), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 6 and spark.read.parquet(f"{path}/common").count() == (common == 2)
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.read_index(spark, path).collect()}
    assert got[(1, 1003)]["record_type"] == "revisit" and got[(1, 1003)]["refers_to"] == 5 and got[(5, 1003)]["record_type"] == "response"
    assert got[(None, 1003)]["refers_to"] == 5 and got[(None, 2000)]["record_type"] == "response"
    assert all(got[k]["record_type"] == "response" for k in ((2, 5), (4, 5), (6, 0), (7, 0), (8, 1200), (9, 998)))
    assert all(r["declared_digest"] == r["payload_digest"] for r in got.values())
    records = warc.read_records(spark, path).collect()
    assert len(records) == 12
    ids, refers = [], set()
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and block.endswith(b"\r\n\r\n") and len(block) == int(lines["Content-Length"]) + 4
        assert lines["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(r["payload"]).hexdigest() and "X" not in lines
        ids.append(lines["WARC-Record-ID"])
        refers |= {lines["WARC-Refers-To"]} if "WARC-Refers-To" in lines else set()
    assert len({*ids}) == 12 and refers <= {*ids} and len(refers) == 1


def test_warc_long_and_binary_like_payloads(spark, tmp_path):
    long = "WARC/1.1\r\n\r\n<\U0001f600>\x00" * 400_000
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "\r\n\r\n")], "page_id long, url string, html string")
    warc.write_archive(df, f"file://{tmp_path}/a")
    got = {r["page_id"]: r for r in warc.read_index(spark, f"file://{tmp_path}/a").collect()}
    assert got[1]["refers_to"] == 2 and got[2]["payload_bytes"] == len(long.encode()) and got[2]["payload_digest"] == got[1]["payload_digest"] == hashlib.sha1(long.encode()).hexdigest()
    assert got[3]["payload_bytes"] == 4 and got[1]["record_bytes"] < 1000 < got[2]["record_bytes"]


def test_warc_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages(spark), path)
    one, other = (spark.read.parquet(f"{path}/payloads").orderBy("digest").select("packed").collect()[i][0] for i in (0, 1))
    spark.read.parquet(f"{path}/payloads").withColumn("packed", F.when(F.col("packed") == one, F.lit(other)).otherwise(F.col("packed"))).write.parquet(f"{path}/b/payloads")
    for name in ("headers", "common"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{path}/b/{name}")
    with pytest.raises(Exception, match="digest"):
        warc.read_index(spark, f"{path}/b").collect()


def test_warc_empty(spark, tmp_path):
    warc.write_archive(pages(spark).limit(0), f"file://{tmp_path}/e")
    assert warc.read_index(spark, f"file://{tmp_path}/e").count() == 0

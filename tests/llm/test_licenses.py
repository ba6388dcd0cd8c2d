import random
import re

import numpy as np
import pytest

from packframe.llm import licenses
from packframe.llm.licenses import LEAST, TEMPLATES, Scanner


def words_of(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))


def brute_force(text, templates=TEMPLATES):
    """The names whose shingles are there to LEAST within some window of the template's length."""
    out = set()
    w = words_of(text)
    for name, t in templates.items():
        tw = words_of(t.encode())
        k = min(5, len(tw))
        grams = lambda x, k=k: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
        want, own = grams(tw), grams(w)
        need = {*want}
        if any(len(need & {*own[i : i + len(want)]}) >= LEAST * len(need) for i in range(len(own))):
            out.add(name)
    return out


def brute_spans(text, name, template):
    """Spans and shares of one template, place by place."""
    spots = [(m.start(), m.end()) for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", text)]
    w, tw = words_of(text), words_of(template.encode())
    k = min(5, len(tw))
    grams = lambda x: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
    own, length, need = grams(w), len(tw) - k + 1, {*grams(tw)}
    out = []
    for right in (i for i, g in enumerate(own) if g in need):
        inside = [i for i in range(max(0, right - length + 1), right + 1) if own[i] in need]
        share = len({own[i] for i in inside}) / len(need)
        if share >= LEAST:
            if out and inside[0] <= out[-1][1]:
                out[-1] = (out[-1][0], right, max(out[-1][2], share))
            else:
                out.append((inside[0], right, share))
    return [(name, spots[a][0], spots[b + k - 1][1], s) for a, b, s in out]


def noisy(rng, text, edits):
    w = text.split(" ")
    for _ in range(min(edits, len(w) - 1)):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], ["foo"], [w[i], "bar"], [w[i].upper()], [w[i] + ","]])
    return " ".join(w)


@pytest.mark.parametrize("seed", range(4))
def test_matches_are_brute_force(seed):
    rng = random.Random(seed)
    filler = ["the", "license", "under", "and", "all", "rights", "x9", "é"]
    texts = []
    for _ in range(150):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            name = rng.choice([*TEMPLATES])
            parts += [noisy(rng, TEMPLATES[name], rng.randint(0, 8)), " ".join(rng.choice(filler) for _ in range(rng.randint(0, 40)))]
        texts.append(rng.choice([" ", "\n", ". "]).join(parts).encode())
    for text, got in zip(texts, Scanner(TEMPLATES).scan(texts), strict=True):
        assert {m[0] for m in got} == brute_force(text)


def test_spans_and_shares_are_brute_force():
    rng = random.Random(11)
    filler = ["the", "license", "under", "software", "all", "rights"]
    every = TEMPLATES | licenses.RELATIVES
    hits = 0
    for name, template in every.items():
        texts = []
        for _ in range(12):
            parts = [" ".join(rng.choice(filler) for _ in range(rng.randint(0, 30)))]
            for _ in range(rng.randint(1, 3)):
                parts += [noisy(rng, template, rng.randint(0, 3)), " ".join(rng.choice(filler) for _ in range(rng.choice([0, 1, 30])))]
            texts.append(" ".join(parts).encode())
        for text, got in zip(texts, Scanner({name: template}).scan(texts), strict=True):
            want = brute_spans(text, name, template)
            assert [m[:3] for m in got] == [m[:3] for m in want] and np.allclose([m[3] for m in got], [m[3] for m in want])
            hits += len(want)
    assert hits > 12 * len(every)


def test_spans_and_edges():
    text = "é. All  Rights\nreserved! no; ALL RIGHTS RESERVED".encode()
    got = Scanner(TEMPLATES).scan([None, b"", text, b"all rights", b"  ", b"x " * 400_000 + b"released under the mit license"])
    assert got[0] == got[1] == got[3] == got[4] == []
    assert [(text[a:b].decode(), n, s) for n, a, b, s in got[2]] == [("All  Rights\nreserved", "all rights reserved", 1.0), ("ALL RIGHTS RESERVED", "all rights reserved", 1.0)]
    assert [m[:3] for m in got[5]] == [("mit notice", 800_000, 800_030)]
    assert Scanner({}).scan([text]) == [[]] and Scanner({"none": " .,"}).scan([text]) == [[]]


def test_windows_are_least_of_all():
    h = np.random.default_rng(0).integers(0, 1 << 32, (2, 50), dtype=np.uint32)
    for n, m in licenses._window_minima(h, {1, 3, 8, 13, 49}).items():
        assert all((m[:, i] == h[:, i : i + n].min(1)).all() for i in range(50))


def test_relatives_are_told_apart(spark):
    every = TEMPLATES | licenses.RELATIVES
    inner = {"apache-2.0 header": {"apache-2.0 notice"}}  # a notice within a header stays
    rows = [(i, f"x y. {t} z") for i, t in enumerate(every.values())]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {i: {n} | inner.get(n, set()) for i, n in enumerate(every)}


@pytest.mark.parametrize("edits", [1, 2])
def test_noisy_relatives_have_one_name_of_a_family(edits):
    rng = random.Random(edits)
    every = TEMPLATES | licenses.RELATIVES
    for family in licenses.FAMILIES:
        for name in sorted(family - {"gpl-2.0 notice", "gpl-3.0 notice"}):
            head = every[name].split(" ")
            text = " ".join([*head[:4], *noisy(rng, " ".join(head[4:12]), edits).split(" "), *head[12:]])
            text = f"{text} filler {every[name]}".encode()
            assert {m[0] for m in Scanner(every).scan([text])[0]} & family == {name}


def test_many_and_adjacent_relatives():
    every = TEMPLATES | licenses.RELATIVES
    notice = every["gpl-2.0 notice"]
    text = (every["gpl-2.0 header"] + " " + every["gpl-3.0 header"]).encode()
    got = Scanner(every).scan([text, f"{notice} filler ".encode() * 20_000])
    assert {m[0] for m in got[0]} == {"gpl-2.0 header", "gpl-3.0 header"}
    assert [m[0] for m in got[1]] == ["gpl-2.0 notice"] * 20_000


def test_table(spark):
    rows = [(1, "x. Released under the MIT License.", "clash"), (None, "All rights reserved.", "clash"), (1, "x. Released under the MIT License.", "clash"), (2, None, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(licenses.scan_licenses(df).collect(), key=str)
    assert sorted((r["doc_id"] or 0, r["license"], r["start_byte"], r["end_byte"]) for r in got) == [(0, "all rights reserved", 0, 19), (1, "mit notice", 3, 33), (1, "mit notice", 3, 33)]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    d = "/root/testdata/sf0.001"
    found = {(r["doc_id"], r["license"]) for r in licenses.op2_licenses(spark, d).collect()}
    want = {(r["doc_id"], n) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for n in brute_force((r["text"] or "").encode())}
    assert found == want and want

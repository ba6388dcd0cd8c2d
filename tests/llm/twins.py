"""Plain versions of the models, written from their definitions, one text and one number at a time."""

import math
import re
import zlib
from collections import Counter

import numpy as np

MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


class Languages:
    """learned: (text, lang) pairs."""

    def __init__(self, learned, dimensions=1024):
        self.dimensions, self.letters, self.grams = dimensions, {}, {}
        sums = {}
        for text, lang in learned:
            if text is not None and lang is not None:
                v = self.vector(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v
        units = {k: v / math.sqrt((v * v).sum()) for k, v in sums.items()}
        mean = sum(units.values()) / max(1, len(units)) if len(units) > 1 else 0
        self.prototypes = {k: (v - mean) / math.sqrt(((v - mean) ** 2).sum()) for k, v in sorted(units.items())}

    def letter(self, code):
        """The bytes of a letter's bits."""
        if code not in self.letters:
            start = mix(code + 0x5851F42D4C957F2D & MASK)
            self.letters[code] = b"".join(mix(start + j * 0x9E3779B97F4A7C15 & MASK).to_bytes(8, "little") for j in range(self.dimensions // 64))
        return self.letters[code]

    def gram(self, three):
        if three not in self.grams:
            turned = [b[-k:] + b[:-k] if k else b for b, k in zip(map(self.letter, three), (2, 1, 0), strict=True)]
            self.grams[three] = np.array([1 - 2 * int(bit) for bytes3 in zip(*turned, strict=True) for bit in f"{bytes3[0] ^ bytes3[1] ^ bytes3[2]:08b}"])
        return self.grams[three]

    def vector(self, text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        if not words:
            return None
        codes = [0, *(ord(c) for c in "\0".join(words)), 0]
        return sum(n * self.gram(g) for g, n in Counter(zip(codes, codes[1:], codes[2:], strict=False)).items()).astype(float)

    def predict(self, text):
        v = self.vector(text) if text and self.prototypes else None
        if v is None:
            return "und", 0.0
        scores = {k: float((p * v).sum()) / math.sqrt((v * v).sum()) for k, p in self.prototypes.items()}
        best = max(scores, key=lambda k: (scores[k], [-ord(c) for c in k]))
        return best, min(1.0, max(0.0, scores[best]))


def statistics(text):
    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return [0.0] * 14
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lower = [w.lower() for w in words]
    k = len(words)
    count = lambda test: sum(map(test, raw))
    among = lambda chars: count(lambda b: b in chars)
    upper, small, other = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: b >= 128)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / k if k else 0
    spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / k) if k else 0
    damped = lambda c: math.sqrt(c / (n + 100))
    return [
        math.log1p(k), math.log1p(mean), math.log1p(spread), math.sqrt(upper / n / max((upper + small + other) / n, 1e-9) * n / (n + 100)), damped(count(lambda b: 48 <= b <= 57)), damped(among(b"\n")),
        damped(among(b".,;:?")), damped(among(b"!")), damped(among(b"|")), damped(among(b"#$%&*+/<=>@[\\]^_`{}~")), math.sqrt(other / n), math.log((len({*lower}) + 1) / (k + 1) ** 0.85),
        math.sqrt(sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / (k + 30)), math.log1p(max(lengths, default=0)),
    ]


def quality(texts, labelled):
    """Scores of texts; labelled: (text, label) pairs."""
    x = {c: np.array([statistics(t) for t, q in labelled if q == c]) for c in (0, 1)}
    total = len(x[0]) + len(x[1])
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / total
    logs = []
    rows = np.array([statistics(t) for t in texts])
    for v in x.values():
        s = 0.9 * np.cov(v.T, bias=True) + 0.1 * np.diag(np.diag(pooled)) + np.eye(len(pooled)) * (1e-3 * np.trace(pooled) / len(pooled) + 1e-12)
        m = rows - v.mean(0)
        logs.append(math.log(len(v) / total) - 0.5 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(s), m) - 0.5 * np.linalg.slogdet(s)[1])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

"""Periodic runs against a plain search over all periods and places."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wattlens.llm import periodic_runs as runs

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def plain_runs(words):
    """Maximal stretches for every period; equal stretches keep the smallest one."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, p, n) for (s, n), p in found.items())


def plain_collapse(words, found):
    dropped = {i for s, p, n in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def random_words(rng, size):
    """Texts in which repetitions nest, overlap, touch and stop one word short."""
    out = []
    while len(out) < size:
        kind = rng.randrange(6)
        if kind == 0:
            out += [rng.choice("ab") for _ in range(rng.randint(1, 30))]
        elif kind == 1:
            unit = [rng.choice("abcdef") for _ in range(rng.randint(1, 40))]
            n = rng.randint(1, 6) * len(unit) + rng.randint(-1, 1) + rng.randint(0, len(unit))
            out += [unit[i % len(unit)] for i in range(max(0, n))]
        elif kind == 2:
            out += [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(1, 50))]
        elif kind == 3 and out:
            unit = out[-rng.randint(1, min(len(out), 150)):]
            out += unit * rng.randint(1, 4)
        elif kind == 4:
            out += ["a"] * rng.randint(1, 70)
        else:  # Fibonacci and Thue-Morse words
            a, b = ["a"], ["a", "b"]
            for _ in range(rng.randint(1, 7)):
                a, b = b, b + a
            out += b if rng.random() < 0.5 else ["ab"[bin(i).count("1") % 2] for i in range(len(b))]
    return out[:size]


def as_array(words):
    return np.array([zlib.crc32(w.encode()) * 2654435761 + 1 for w in words], np.uint64)


def test_fragments_equal_a_plain_search():
    rng = random.Random(11)
    for _ in range(60):
        texts = [random_words(rng, rng.choice([0, 1, 23, 24, 25, 60, 200, 700])) for _ in range(rng.randint(1, 6))]
        texts += [texts[0]] * 3  # equal neighbours don't make a period
        bounds = np.cumsum([0, *map(len, texts)])
        text, rows = runs.fragments_of_texts(as_array([w for t in texts for w in t]), bounds)
        got = [sorted((s, p, high - s + p) for i, (p, s, high) in zip(text, rows.tolist()) if i == k) for k in range(len(texts))]
        assert got == [plain_runs(t) for t in texts]


def test_pieces_of_long_texts_give_the_same_runs(monkeypatch):
    monkeypatch.setattr(runs, "PIECE_SPAN", 64)
    rng = random.Random(12)
    for _ in range(40):
        words = random_words(rng, rng.choice([30, 100, 500, 1500]))
        own, parts = as_array(words), []
        for low, high, first, last in runs.pieces_of_text(len(words)):
            begin, end = max(0, first - high), min(len(words), last + 4 * high)
            parts.append(runs.fragments_of_piece(own[begin:end], begin, low, high, first, last))
        rows = runs.stitched(np.concatenate(parts)) if parts else np.zeros((0, 3), int)
        got = sorted((s, p, high - s + p) for p, s, high in rows[runs.long_enough(rows)].tolist())
        assert got == plain_runs(words)


@pytest.mark.parametrize("long_words", [1 << 20, 300])
def test_operator_on_awkward_rows(spark, monkeypatch, long_words):
    monkeypatch.setattr(runs, "LONG_WORDS", long_words)
    monkeypatch.setattr(runs, "PIECE_SPAN", 128)
    rng = random.Random(13)
    rows = [(i, "\t ".join(random_words(rng, rng.randint(0, 900)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\x0b "), (103, "é " * 400), (104, "日 本 " * 13 + "x" * 60_000), (None, "a b " * 20),
             (None, "a b " * 20), (5, rows[5][1]), (5, "c " * 23), (106, "c " * 24), (107, " no run here "), (108, "q " * 3000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, row int, runs int, `a.b` int")
    out = runs.periodic_runs(docs).collect()
    expected = []
    for i, text in rows:
        words = WORDS.findall(text or "")
        found = plain_runs(words)
        left = plain_collapse(words, found)
        expected.append((i, len(words), found, left if found else None, hashlib.sha256(left.encode()).hexdigest()))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.collapsed_sha256) for r in out]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_texts_beyond_the_first_slice_of_a_batch(spark):
    """Slices end at about 2 MB: texts with and without runs in several of them."""
    rows = [(i, "y" * 900_000 + (" a b" * 20 if i % 2 else " c")) for i in range(8)]
    out = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)).collect()}
    for i, text in rows:
        words = text.split(" ")
        assert [tuple(x) for x in out[i].runs] == plain_runs(words)
        assert out[i].collapsed_sha256 == hashlib.sha256(plain_collapse(words, plain_runs(words)).encode()).hexdigest()


def test_registered_query_equals_a_plain_version(spark):
    rows = {r.doc_id: r for r in runs.op11_scale_tiled_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        words = WORDS.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
        r = rows[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (
            (len(found), best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (0, None, None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, q, length in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(words, found).encode()).hexdigest()


def test_prime_factors_and_joined_words():
    assert runs.least_factors(100)[[1, 2, 9, 35, 49, 97]].tolist() == [1, 2, 3, 5, 7, 97]
    data, offsets, starts, ends, doc, _ = runs.words_of(pa.array(["a  b", "", "c\n", None, " d\te"]))
    assert runs.joined(data, offsets, starts, ends, doc) == [b"a b", b"", b"c", b"", b"d e"]

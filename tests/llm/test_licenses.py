"""License scans against a plain scan of all notices over all windows."""
import random
import re

import numpy as np
import pyarrow as pa

from wattlens.llm import licenses

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_places(text):
    words, found = words_of(text), []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    return sorted(found)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.insert(at, "zz"), lambda: words.__setitem__(at, "qq"), lambda: words.pop(at)])()
    return words


def test_scan_finds_edited_notices_and_exact_phrases(spark):
    rng = random.Random(3)
    filler = lambda n: [rng.choice("lorem ipsum dolor sit the of software this license free copy é".split()) for _ in range(n)]
    rows, planted = [], {}
    for i in range(120):
        label, text = licenses.NOTICES[i % len(licenses.NOTICES)]
        notice = words_of(text)
        edits = rng.randint(0, licenses.edits_allowed(len(notice), licenses.TOLERANCE, licenses.GRAM_WORDS))
        before = filler(rng.randint(0, 400))
        rows.append((i, " ".join(before + edited(rng, notice, edits) + filler(rng.randint(0, 60)))))
        planted[i] = (label, len(notice), edits)
    rows += [(1000 + i, t) for i, t in enumerate(
        [None, "", " .,\n", "MIT License; the Mit\tLICENSE.", "cc-by", "cc é by", "gnu general public licenses", "apache license " * 900,
         "Licensed under CC BY-NC 4.0.", "mit", "license"])]
    rows += [(None, "Released under the MIT License"), (7, rows[7][1]), (7, "another text of the same id")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, k1 int, places int, `x.y` int")
    out = licenses.license_scan(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        texts = [t for i, t in rows if i == r.doc_id and len(words_of(t)) == r.n_words]
        assert texts and [(p.start, p.label) for p in r.places] in [plain_places(t) for t in texts]
        for s in r.spans:  # every span is as near to a notice of its label as it says
            notices = [words_of(t) for label, t in licenses.NOTICES if label == s.label]
            assert any(abs(1 - distance(n, words_of(t)[s.start:s.start + s.length]) / len(n) - s.score) < 1e-9
                       for n in notices for t in texts)
            assert s.score >= 1 - licenses.TOLERANCE / 100
    by_id = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id != 7}
    for i, (label, size, edits) in planted.items():
        if i != 7:
            best = max((s.score for s in by_id[i].spans), default=0)
            assert best >= 1 - edits / size - 1e-9
            assert edits or label in [s.label for s in by_id[i].spans]
    assert [s.label for s in by_id[1008].spans] == ["cc-by-nc"] and not by_id[1006].places
    assert sum(len(r.spans) for r in out if r.doc_id is None) == 1
    assert sorted(len(r.spans) > 0 for r in out if r.doc_id == 7) == [False, True, True]
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_grams_of_long_texts_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PART_GRAMS", 4)
    text = "a b c d e f g " * 3 + "released under the mit license " + "x y z " * 5
    row = licenses.license_scan(spark.createDataFrame([(1, text), (2, "x y")], "doc_id int, text string")).orderBy("doc_id").first()
    assert [(s.label, s.start, s.length, s.score) for s in row.spans] == [("mit", 21, 5, 1.0)]


def test_best_span_equals_the_distance_to_all_spans():
    rng = random.Random(5)
    for _ in range(60):
        words = np.array([rng.randrange(4) for _ in range(rng.randint(0, 14))], np.uint64)
        notice = np.array([rng.randrange(4) for _ in range(rng.randint(1, 6))], np.uint64)
        edits, start, end = licenses.best_span(notice, words)
        every = {(i, j): distance(notice.tolist(), words[i:j].tolist()) for i in range(len(words) + 1) for j in range(i, len(words) + 1)}
        assert edits == min(every.values()) == every[start, end]


def test_words_of_awkward_texts():
    words, bounds = licenses.text_words(pa.array(["Ünï_code ÄB", None, "", "a1-b2", "日本 x", "\x7f\x00"]))
    assert np.diff(bounds).tolist() == [3, 0, 0, 2, 2, 0] and len(set(words.tolist())) == 7

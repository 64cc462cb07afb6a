"""Token counts, packing, quality rules, language, page text: against plain versions, and on awkward rows."""
import collections
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wattlens.llm import html_text, language, packing, quality, tokens

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
AWKWARD = [None, "", " \n\t ", "a", "Ünïcode ÉCOLE don't 12,5 <|endoftext|>x <|STARTOFTEXT|>", "x" * 50_000,
           "word " * 3000, "日本語 テスト", "tie tie tie", "tie tie tie"]


def frame(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("doc_id", "text", "'keep' as n_tokens", "1 as score", "2 as kept") if extra else df


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_tokenizer())


def test_tokens_equal_the_library_on_random_texts(tokenizer):
    random.seed(1)
    parts = ["a", "B", "é", "É", "×", "'", "'s", "1", " ", "\n", ",", ".", "<|endoftext|>", "<|STARTOFTEXT|>", "<", "|", "“",
             "́", "̱", "h", "H", "İ", "Σ", "日", "\U0001F600", " ", "\x85", "²", "ß", "_", "\x1c"]
    own = tokens.pieces(tokens.default_tokenizer())
    for _ in range(800):
        texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(3)] + [None]
        ids, sizes = own.ids(pa.array(texts))
        expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for e in expected for i in e] and sizes.tolist() == [len(e) for e in expected]


def test_token_counts_on_awkward_rows(spark, tokenizer):
    rows = tokens.token_counts(frame(spark, AWKWARD, extra=True)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in AWKWARD]
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in AWKWARD] and rows[0].score == 1
    assert tokens.token_counts(frame(spark, [])).count() == 0


def test_pretokens_are_forgotten_without_changing_counts(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "KNOWN_PRETOKENS", 5)
    own = tokens.Pieces(tokens.default_tokenizer())
    for text in ("one two three four", "two five six seven", "one two eight"):
        assert own.ids(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_remembered_pretokens_take_little_memory(tokenizer):
    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in ("an", "eo", "iu", "oe", "ua") for c in map("".join, itertools.product("abcdefghij", repeat=3))]
    own = tokens.Pieces(tokens.default_tokenizer())
    texts = pa.array([" ".join(words[i:i + 500]) for i in range(0, len(words), 500)])
    own.ids(texts.slice(0, 1))
    tracemalloc.start()
    ids, sizes = own.ids(texts)
    kept = tracemalloc.get_traced_memory()[0] - ids.nbytes - sizes.nbytes
    tracemalloc.stop()
    assert kept < 80 * len(words)
    assert ids.tolist() == [i for t in texts.to_pylist() for i in tokenizer.encode(t, add_special_tokens=False).ids]


def check_packing(rows, ids_of, capacity):
    bins, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for doc, parts in docs.items():
        start = 0
        for number, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            piece = ids_of[doc][start:start + capacity]
            assert (r.piece, r.start, r.length) == (number, start, len(piece))
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            start += len(piece)
        assert start == len(ids_of[doc])
    return len(bins)


def test_packing_places_every_id_once(spark, tokenizer):
    rows = packing.pack(frame(spark, AWKWARD, extra=True), capacity=64, with_ids=True).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(AWKWARD)}
    check_packing(rows, ids, 64)
    assert all(list(r.ids) == ids[r.doc_id][r.start:r.start + r.length] for r in rows)
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_of_the_given_documents_is_near_the_lower_bound(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [0] for r in docs.collect()}
    used = check_packing(packing.pack(docs).collect(), ids, packing.CAPACITY)
    assert used <= 1.03 * -(-sum(map(len, ids.values())) // packing.CAPACITY) + 1


def best_fit(sizes, capacity):
    """The method item by item: large ones matched, then the tightest gap for each small one."""
    large, small = sorted((s for s in sizes if 3 * s > capacity), reverse=True), sorted((s for s in sizes if 3 * s <= capacity), reverse=True)
    gaps = []
    while large:
        gap = capacity - large.pop(0)
        partner = next((i for i, s in enumerate(large) if s <= gap), None)
        gaps.append(gap - large.pop(partner) if partner is not None else gap)
    for s in small:
        fitting = [g for g in gaps if g >= s]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_plan_on_counts_equals_the_method_item_by_item():
    random.seed(2)
    for _ in range(150):
        capacity = random.choice([10, 24, 50])
        sizes = [random.randint(1, capacity) for _ in range(random.randint(0, 60))]
        plan = packing.plan_bins(collections.Counter(sizes), capacity)
        bins = collections.Counter()
        for size, low, high, first, times, offset in plan.tolist():
            for rank in range(low, high):
                bins[first + (rank - low) // times] += size
        assert sum(bins.values()) == sum(sizes) and all(v <= capacity for v in bins.values())
        assert len(bins) == best_fit(sizes, capacity)


def plain_statistics(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_a_plain_version(spark):
    texts = AWKWARD + ["a b c\na b c\n\n a b c", "x y z x y z #|<", "\n\n", "a\nb\na\n b"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = np.stack(quality.text_statistics(pa.array(texts)), axis=1)
    assert [tuple(r) for r in found.tolist()] == [plain_statistics(t) for t in texts]


def quality_rows(spark, n=400):
    random.seed(3)
    rows = []
    for i in range(n):
        words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(80)]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else None, f"s{i % 2}"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_outliers_go_and_the_rest_stays(spark):
    found = quality.quality(quality_rows(spark)).collect()
    assert not any(r.base_failed for r in found)
    assert {r.doc_id for r in found if not r.kept} == set(range(0, 400, 20))


def test_small_tables_reject_by_the_limits_only(spark):
    docs = quality_rows(spark, 30).selectExpr("*", "5 as kept", "6 as distance")
    docs = docs.unionByName(spark.sql("select 1000L doc_id, cast(null as string) text, cast(null as string) lang, "
                                      "cast(null as string) source, 5 kept, 6 distance"))
    found = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert found[1000].base_failed and not found[1000].kept and found[1000].n_words == 0
    assert all(r.kept for i, r in found.items() if i != 1000)
    assert quality.quality(quality_rows(spark, 0)).count() == 0


def test_estimate_is_that_of_the_clean_rows():
    rng = np.random.default_rng(1)
    p = len(quality.FEATURES)
    clean = rng.normal(size=(2000, p)) @ np.diag([1, 2, 3, 1.5])
    dirty = np.concatenate([clean, rng.normal(20, 1, size=(300, p))])
    import pandas as pd
    mean, inverse = np.median(dirty, axis=0), np.eye(p)
    for _ in range(6):
        gaps = dirty - mean
        d2 = np.einsum("ni,ij,nj->n", gaps, inverse, gaps)
        bins = np.minimum(np.floor(np.log2(1 + d2) * quality.BINS_PER_DOUBLING), quality.LAST_BIN)
        frame_ = pd.DataFrame([{"key": "k", "bin": b, "n": int((bins == b).sum()), "sums": np.concatenate(
            [dirty[bins == b].sum(axis=0), (dirty[bins == b].T @ dirty[bins == b]).ravel()])} for b in np.unique(bins)])
        out = quality.concentrate(frame_).iloc[0]
        mean, inverse = np.array(out["mean"]), np.array(out["inverse"]).reshape(p, p)
    assert np.abs(mean - clean.mean(axis=0)).max() < 0.3


def test_language_is_learned_and_unknown_is_und(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn_from_documents(docs)
    found = language.identify(docs.filter(language.held_out()), model).collect()
    assert len(found) > 200 and np.mean([r.lang == r.lang_pred for r in found]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)
    odd = language.identify(frame(spark, [None, "", "12 34 !!", "the and of"], extra=True), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[3].lang_pred == "en" and odd[0].score == 0.0


def test_language_without_labels_or_rows(spark):
    docs = frame(spark, ["abc def"]).selectExpr("*", "cast(null as string) as lang")
    assert language.identify(docs, language.fit(docs)).first().lang_pred == "und"
    assert language.identify(docs.limit(0), language.fit(docs)).count() == 0


def test_kernel_is_the_share_of_common_grams():
    grams = language.grams_of(pa.array(["abc", "abd", "12", None]))
    assert grams[2] is None and grams[3] is None
    import pandas as pd
    model = language.KernelModel(pd.DataFrame({"lang": ["x", "y"], "grams": grams[:2]}))
    common = len(np.intersect1d(grams[0], grams[1]))
    assert model.kernel(grams[:1])[0].tolist() == pytest.approx([1.0, common / (len(grams[0]) * len(grams[1])) ** 0.5], rel=1e-5)


def test_page_text(spark):
    page = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href="/">x</a></nav>'
            '<div class="cookie notice">We use</div><main><article><header><h1>T &amp; U</h1></header><section><p>One &lt;b&gt;  two<br>three'
            '<p>x</p></section><ul><li>a<li>b</ul><!-- c --><section class="comments"><p>a long reader comment</p></section></article></main>'
            '<aside>z</aside><form><p>f</p></form><footer>&copy;</footer></body>')
    assert html_text.main_text(page) == "T & U\nOne <b> two three\nx\na\nb"
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain  text"), (5, "<p>" * 3000 + "deep")], "page_id int, html string")
    rows = {r.page_id: r for r in html_text.extract(pages.selectExpr("*", "'old' as text")).collect()}
    assert rows[2].text == "" and rows[3].n_chars == 0 and rows[4].text == "plain text" and rows[5].text == "deep"


@pytest.mark.parametrize("wrapper", ['div class="page has-sidebar"', 'div class="no-sidebar"', 'div class="menu"', "form action=x", 'div data-id="menu"'])
def test_names_of_wrappers_and_headings_lose_no_text(wrapper):
    text = "One sentence of an article that goes on for a while. " * 4
    page = (f'<body><{wrapper}><div class="post-header"><p>{text}</p></div><h2 id="related-work">Work</h2><h2 id="notice">Note</h2>'
            f'<section id="social-networks"><p>{text}</p></section><div class="sidebar"><p>side</p></div><form><p>f</p></form>'
            f'</{wrapper.split()[0]}></body>')
    assert html_text.main_text(page).split("\n") == [text.strip(), "Work", "Note", text.strip()]


def test_comments_longer_than_the_article_are_dropped():
    page = f'<body><article><p>Short text.</p></article><section class="comments"><p>{"a reader says " * 50}</p></section></body>'
    assert html_text.main_text(page) == "Short text."


def test_given_pages_give_their_articles(spark):
    import html
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)

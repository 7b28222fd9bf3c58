"""The dealt operators against brute force on small tables: nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from tidepost.llm import (bloom, components, fingerprint, license, linededup, markup, mixing, packing, quality, setsketch, store,
                          template, urlfilter, warc, words)

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, lang string, n_chars long, node string, key int, c0 string"


def _split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def _docs(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, (sources or ["s"])[i % len(sources or ["s"])], "en", None, "x", 1, "y")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", " \n\t ", "one", "Two words", "é" * 30, "x" * 5000, "a b c a b c a b c", "same", "same"]


# Words

def test_words_follow_documents_and_case():
    texts = ["Ab c", "", None, "ab\x0bC\xa0d", "c"]
    for group in words.groups(pa.array(texts), limit=4):
        found = words.words(group, fold_case=True)
        for i in range(len(group)):
            assert found.bounds[i + 1] - found.bounds[i] == len(_split(texts[group.first + i]))
    groups = list(words.groups(pa.array(["Ab", "aB", "AB c"])))
    hashes = words.words(groups[0], fold_case=True).hashes
    assert hashes[0] == hashes[1] == hashes[2] != hashes[3]
    plain = words.words(groups[0]).hashes
    assert len(set(plain.tolist())) == 4


def test_runs_do_not_cross_texts():
    group = next(words.groups(pa.array(["a b", "c d e"])))
    _, whole = words.words(group).runs(3)
    assert whole.tolist() == [False, False, True, False, False]


# 1 WARC

def test_sizes_of_records_under_one_id(spark):
    rows = [(5, "u", "abc"), (5, "u", "xxxxxxx"), (3, "u", "abc"), (2, "u", "xxxxxxx"), (None, "u", "only"), (None, "u", "only")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html").collect()
    want = [(p, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for p, _, h in rows]
    assert sorted(map(repr, ((r.key, r.payload_bytes, r.payload_digest) for r in got))) == sorted(map(repr, want))
    assert sorted((r.key, r.refers_to) for r in got if r.record_type == "revisit" and r.key) == [(2, 5), (3, 5)]


def test_archive_rejects_magic_in_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u1", "plain"), (2, "u2", inner * 3), (3, "u\r\n3", None), (4, None, ""), (5, "u5", "plain"),
            (6, "é", "WARC/1.1\r\n" * 500), (7, "x", "t WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (None, "n", "plain"),
            (8, "y", "a\r\n\r\nb" * 300)] + [(i, "f", inner * (i % 4) + "t" * i) for i in range(100, 130)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = warc.round_trip(pages, "page_id", "url", "html").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(rows)
    by_payload = {}
    for key, _, html in rows:
        if key is not None:
            by_payload[html or ""] = max(key, by_payload.get(html or "", key))
    seen = {r.key: r for r in got}
    for key, _, html in rows:
        body, r = (html or "").encode(), seen[key]
        first = by_payload[html or ""]
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first == key else ("revisit", first))


def test_archive_payloads_and_empty_table(spark, tmp_path):
    inner = "WARC/1.1\r\nContent-Length: 1\r\n\r\nx"
    pages = spark.createDataFrame([(1, "u", inner), (2, "u", "p")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"), "page_id", "url", "html")
    got = {r.key: bytes(r.payload).decode() for r in warc.read_archive(spark, str(tmp_path / "a"), True).collect()}
    assert got == {1: inner, 2: "p"}
    assert warc.round_trip(pages.limit(0), "page_id", "url", "html").count() == 0


# 2 Mixing

def test_raking_meets_all_margins():
    cells = {(s, l, t): 1.0 + i for i, (s, l, t) in enumerate(itertools.product("ab", "xy", "pq"))}
    targets = [{"a": 0.3, "b": 0.7}, {"x": 0.5, "y": 0.5}, {"p": 0.9, "q": 0.1}]
    got = mixing.rake(cells, targets)
    for axis, shares in enumerate(targets):
        for name, share in shares.items():
            assert sum(w for k, w in got.items() if k[axis] == name) == pytest.approx(share, abs=1e-6)
    odds = [got[("a", l, t)] / cells[("a", l, t)] / (got[("b", l, t)] / cells[("b", l, t)]) for l in "xy" for t in "pq"]
    assert max(odds) == pytest.approx(min(odds), rel=1e-6)  # product form: raking, not any fit
    assert mixing.rake({}, targets) == {}
    # A category far too scarce for its target is taken whole and spoils no other share.
    cells = {(s, l, t): 1.0 if t == "q" else 1000.0 for s, l, t in cells}
    got = mixing.rake(cells, [{"a": 0.3, "b": 0.7}, {"x": 0.5, "y": 0.5}, {"p": 0.7, "q": 0.3}], 0.5)
    total = sum(cells.values())
    assert all(got[k] * 0.5 * total <= cells[k] * (1 + 1e-9) for k in got)
    assert all(got[k] * 0.5 * total == pytest.approx(cells[k]) for k in got if k[2] == "q")
    assert sum(got.values()) > 0.69
    assert sum(w for k, w in got.items() if k[0] == "a") / sum(got.values()) == pytest.approx(0.3, abs=0.02)


def test_mixing_keeps_columns_and_shares(spark):
    texts = [_prose(i, 50) for i in range(600)]
    docs = _docs(spark, texts, sources=["a", "a", "a", "b"])
    targets = mixing.Targets({"a": 0.5, "b": 0.5}, {"en": 1.0}, {mixing.PROSE: 1.0})
    kept = mixing.mix(docs, targets)
    assert kept.columns == docs.columns
    counts = Counter(r.source for r in kept.collect())
    assert counts["b"] == 150 and 100 < counts["a"] < 200
    odd = _docs(spark, ODD)
    assert {r.doc_id for r in mixing.mix(odd).collect()} <= set(range(len(ODD)))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_keeps_what_has_no_target(spark):
    sources, langs = ["src0", "hot", None], ["en", "it", None, "fr"]
    rows = [(i, _prose(i, 20), sources[i % 3], langs[i // 3 % 4]) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kept = mixing.mix(docs).collect()
    for column, names in (("source", ["hot", None]), ("lang", ["it", None])):
        n = Counter(getattr(r, column) for r in kept)
        for name in names:  # half of all tokens are kept
            assert n[name] == pytest.approx(0.5 * sum(r[2 if column == "source" else 3] == name for r in rows), rel=0.15)
    alone = docs.filter("lang is null")  # no category with a target has tokens
    assert mixing.mix(alone).count() == pytest.approx(0.5 * alone.count(), rel=0.15)
    cells = {("a", "x"): 60.0, (mixing.OTHER, "x"): 40.0}
    assert mixing.rake(cells, [{"a": 1.0}, {"x": 1.0}])[(mixing.OTHER, "x")] == pytest.approx(0.4)
    assert mixing.rake(cells, [{"a": 0.9}, {"x": 1.0}])[(mixing.OTHER, "x")] == pytest.approx(0.1)
    assert mixing.rake(cells, [{"a": 1.0, mixing.OTHER: 0.0}, {"x": 1.0}])[(mixing.OTHER, "x")] == 0


# 3 HTML

def test_main_text_without_boilerplate(spark):
    def page(i, body):
        return (f"<html><head><title>t{i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
                f"<div id='cookie-notice'>We use cookies</div><header>Site</header><nav><a href=x>Home</a></nav>"
                f"<main>{body}<p>Share this story</p><form>Mail <input></form></main><div class='comments'><p>nice</p></div>"
                f"<aside>side</aside><ul class=x><li><a href=1>Other one</a></li></ul><footer>&copy; {i}</footer></body></html>")

    body = "<h1>Head &amp; tail {0}</h1><p>First   <b>bold</b> {0}<p>Second&nbsp;line<br>goes on {0}</p>"
    rows = [(i, f"https://h.example/{i}", page(i, body.format(i))) for i in range(12)]
    rows += [(100, None, None), (101, "no url", ""), (102, "https://one.example/", page(1, body.format(7))), (103, "x", "a < b <p")]
    got = {r.page_id: r for r in template.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i].text == f"Head & tail {i}\nFirst bold {i}\nSecond line goes on {i}"
        assert got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[100].n_chars, got[101].text) == ("", 0, "")
    assert got[102].text.startswith("Head & tail 7\nFirst bold 7\nSecond line goes on 7")
    assert got[103].text == "a < b"


PAGES = "page_id long, url string, html string"


def _texts(spark, rows):
    return {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<html><body><div>{0}</div><article><h1>Title</h1><p>All of the text</p></article></body></html>"
    rows = [(i, f"http://copies.example/?{i}", page.format("x")) for i in range(30)]
    rows += [(100 + i, f"http://near.example/{i}", page.format(i)) for i in range(30)]
    rows += [(200, "http://few.example/", page.format("x"))]
    assert set(_texts(spark, rows).values()) == {"Title\nAll of the text"}


def test_templates_of_layouts_and_empty_pages(spark):
    one = "<body><div>Legal {1}</div><div>Story {0} of one</div><div>Legal {1}</div></body>"
    two = "<body><div class=x><p>Tale {0} of two</p><p>Ask us</p></div></body>"
    rows = [(i, f"http://h.example/{i}", one.format(i, "notice" if i % 5 < 3 else i)) for i in range(40)]
    rows += [(100 + i, f"http://h.example/x{i}", two.format(i)) for i in range(15)]
    rows += [(200, "http://h.example/", None), (201, "http://h.example/e", "<body><h1>Error</h1></body>")]
    got = _texts(spark, rows)
    assert all(got[i] == (f"Story {i} of one" if i % 5 < 3 else f"Legal {i}\nStory {i} of one\nLegal {i}") for i in range(40))
    assert all(got[100 + i] == f"Tale {i} of two" for i in range(15))
    assert (got[200], got[201]) == ("", "Error")


def test_menus_of_rare_layouts_go(spark):
    plain = "<body><article><p>Story {0} goes here</p></article></body>"
    menu = "<body><div class=rare><ul><li><a href=1>Go {0}</a><li><a href=2>Off {0}</a></ul><p>Rare {0} goes here</p></div></body>"
    few = "<body><div class=rare><ul><li><a href=1>Go {0}</a><li><a href=2>Off {0}</a></ul><p>Few {0} goes here</p></div></body>"
    rows = [(i, f"http://big.example/{i}", plain.format(i)) for i in range(250)]
    rows += [(1000 + i, f"http://big.example/r{i}", menu.format(i)) for i in range(12)]
    rows += [(2000 + i, f"http://{('big', 'few')[i % 2]}2.example/{i}", few.format(i)) for i in range(4)]
    got = _texts(spark, rows)
    assert all(got[1000 + i] == f"Rare {i} goes here" for i in range(12))
    assert all(got[2000 + i] == f"Few {i} goes here" for i in range(4))


def test_text_of_the_article_stays(spark):
    page = ("<body><article><h1>Head {0}</h1><p>{1}</p><ul><li><a href=1>Source one {2}</a><li><a href=2>Two</a></ul></article>"
            "<section><article><a href=3>Next {0}</a></article></section><div id=discussion><p>Nice one {0}</p></div></body>")
    common = "The same paragraph stands in this article"
    for n in (1, 3, 9, 10, 40):
        rows = [(i, f"http://h{n}.example/{i}", page.format(i, common if i % 2 == 0 else f"Other {i}", i % 2)) for i in range(n)]
        for extra in (0, 200):
            more = [(10_000 + i, f"http://other.example/{i}", f"<body><p>Plain {i}</p></body>") for i in range(extra)]
            got = _texts(spark, rows + more)
            for i in range(n):
                own = common if i % 2 == 0 else f"Other {i}"
                assert got[i] == f"Head {i}\n{own}\nSource one {i % 2}\nTwo"


def test_support_is_a_weight(spark):
    """The more pages a host has, the smaller the share on which a text outside the article is the template's."""
    for n, share, gone in ((4, 1.0, False), (5, 1.0, True), (9, 1.0, True), (10, 0.6, False), (40, 0.6, True), (400, 0.6, True), (400, 0.4, False)):
        rows = [(i, f"http://h.example/{i}", f"<body><div>{'Legal' if i < share * n else f'Law {i}'}</div><p>Story {i}</p></body>")
                for i in range(n)]
        assert (_texts(spark, rows)[0] == "Story 0") == gone


def test_blocks_of_broken_markup():
    assert [b.text for b in markup.blocks("<p>a<p>b<div>c</p>d<!-- x --><script>no")] == ["a", "b", "c", "d"]
    assert markup.blocks("<nav><p>x</nav>y")[0].dropped and not markup.blocks("<nav><p>x</nav>y")[1].dropped
    page = "<div class='page-header'>Site</div><article><div class='post-header'><h1>T</h1></div><p>x</p></article>"
    assert [(b.text, b.dropped) for b in markup.blocks(page)] == [("Site", True), ("T", False), ("x", False)]
    assert [b.text for b in markup.blocks('<p title="a>b">c</p>&#8217;&eacute;&am')] == ["c", "’é&am"]


def test_names_around_the_article_drop_nothing():
    def kept(page):
        return [b.text for b in markup.blocks(page) if not b.dropped]

    body = "<h1>Title</h1><p>Text of it</p>"
    for name in ("content has-sidebar", "with-comments", "page-header-fixed", "no-ads", "search-result", "social-news"):
        assert kept(f"<body class=x><div class='{name}'>{body}</div></body>") == ["Title", "Text of it"]
    for name in ("ad", "ad-728", "big sidebar", "page-header", "cookie_notice", "comments-list", "site-footer"):
        assert kept(f"<body><div class='{name}'>Name</div><div>{body}</div></body>") == ["Title", "Text of it"]
    for tag in ("main", "article"):
        page = "<div class=search><div class=ad>buy</div><{0}>" + body + "</{0}><div class=comments><p>nice</p></div></div>"
        assert kept(page.format(tag)) == ["Title", "Text of it"]
    long = "<div class=comments><p>" + "many words " * 20 + "</p></div>"
    assert kept(f"<div class=search><article>{body}{long}</article></div>") == ["Title", "Text of it"]
    assert kept(f"<div class=widget><a href=1>All the links of the menu</a>{body}</div><p>End</p>")[1:] == ["Title", "Text of it", "End"]
    related = "<div class=related><article><p>A teaser that is longer than the article itself</p></article></div>"
    assert kept(f"<article>{body}</article>{related}") == ["Title", "Text of it"]


# 4 Packing

def _check_pieces(pieces, ids, window):
    for doc, own in itertools.groupby(sorted(pieces, key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(ids[doc][at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    padding = 0
    for _, own in itertools.groupby(sorted(pieces, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in own:
            assert r.offset == end
            end += r.length
        assert end <= window
        padding += window - end if end & (end - 1) else 0
    return padding


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    texts = ODD + [_prose(i, random.Random(i).randrange(1, 3000)) for i in range(60)] + [_prose(5, 700)] * 40
    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(texts)}
    got = packing.pack(_docs(spark, texts)).collect()
    assert {r.doc_id for r in got} == set(ids)
    total = sum(map(len, ids.values()))
    assert _check_pieces(got, ids, packing.WINDOW) < 0.01 * total
    assert packing.pack(_docs(spark, texts).limit(0)).count() == 0


def test_word_ids_equal_whole_text_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    encode = packing.WordIds(packing.public_tokenizer())
    texts = ["<|endoftext|> hi", "don't  İSTANBUĹ ́x ΣΑΣ. ﬁ\xa0é\x1cq \x85 a", "'s 's'T", "", "\n\x0b\x0c ", "12 3a-b"]
    for text, got in zip(texts, encode.batch([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_plan_uses_each_tail_once():
    rng = np.random.default_rng(3)
    histogram = np.bincount(rng.integers(1, 64, 500), minlength=65)
    plan = packing.make_plan(histogram, 64)
    filled = Counter()
    for length, first, per, repeats, sequence, offsets in plan.slots:
        assert len(offsets) == per
        for s in range(sequence, sequence + repeats):
            filled[s] += per * length
    assert max(filled.values()) <= 64 and min(filled.values()) >= 64 - packing.SLACK
    assert (plan.cut <= histogram).all()


def test_nnls_finds_the_mix():
    patterns = [(30, 34), (10, 54), (20, 20, 24)]
    histogram = np.zeros(65)
    for p, n in zip(patterns, (5, 7, 11), strict=True):
        for length in p:
            histogram[length] += n
    assert packing.solve_nnls(patterns, histogram, 2000) == pytest.approx([5, 7, 11], rel=1e-3)


# 5 URL filters

def test_captures_see_the_list_of_their_day(spark):
    changes = spark.createDataFrame(
        [("host", "a.example", "x", "add", 10), ("host", "a.example", "x", "remove", 20), ("host", "a.example", "x", "add", 30),
         ("host", "a.example", "x", "add", 35), ("domain", "example", "y", "add", 15), ("domain", "example", "y", "add", 18),
         ("domain", "example", "y", "remove", 18), ("prefix", "b.org/p/q", "z", "add", 0), (None, None, "n", "add", 0)],
        "kind string, value string, category string, action string, at int")
    captures = spark.createDataFrame(
        [(1, "http://A.example:80/x", 9), (2, "http://u@a.example/", 10), (3, "http://a.example", 20), (4, "http://a.example", 40),
         (5, "http://sub.a.example/", 16), (6, "http://b.org/p/q/r?x", 5), (7, "http://b.org/p/qq", 5), (8, None, 5), (9, "junk", 5),
         (10, "http://a.example", None), (2, "http://u@a.example/", 10)], "page_id long, url string, fetched_at int")
    got = sorted((r.key, r.categories) for r in urlfilter.judge(captures, changes).collect())
    assert got == [(1, ""), (2, "x"), (2, "x"), (3, ""), (4, "x"), (5, "y"), (6, "z"), (7, ""), (8, ""), (9, ""), (10, "")]
    assert not urlfilter.judge(captures, changes.limit(0)).filter("blocked").count()


def test_deep_entries_block(spark):
    deep = "a.b.c.d.e.f.g.h.i.example"
    changes = spark.createDataFrame([("prefix", "site.org/1/2/3/4/5/6", "p", "add", 0), ("domain", deep, "d", "add", 0)],
                                    "kind string, value string, category string, action string, at int")
    captures = spark.createDataFrame(
        [(1, "http://site.org/1/2/3/4/5/6/7/8", 1), (2, "http://site.org/1/2/3/4/5/66", 1), (3, f"http://{deep}/", 1),
         (4, f"http://x.y.{deep}", 1), (5, "http://b.c.d.e.f.g.h.i.example/", 1)], "page_id long, url string, fetched_at int")
    for kinds, want in (("prefix", ["p", "", "", "", ""]), ("domain", ["", "", "d", "d", ""])):
        got = sorted((r.key, r.categories) for r in urlfilter.judge(captures, changes.filter(F.col("kind") == kinds)).collect())
        assert got == list(enumerate(want, 1))
    got = sorted((r.key, r.categories) for r in urlfilter.judge(captures, changes).collect())
    assert got == [(1, "p"), (2, ""), (3, "d"), (4, "d"), (5, "")]


# 6 Near-duplicates

def _brute_components(texts, ids, k, percent):
    sets = []
    for t in texts:
        w = _split((t or "").translate(_ASCII))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(texts))]


def _copies(seed, n, words_each=120, most=24):
    rng = random.Random(seed)
    base = _prose(seed, words_each, 3000).split()
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


def test_components_equal_brute_force(spark):
    texts = ODD + _copies(1, 60) + _copies(2, 30) + [_prose(i, 40) for i in range(30)] + ["ONE", "two WORDS"]
    ids = list(range(len(texts)))
    random.Random(0).shuffle(ids)
    got = setsketch.near_duplicates(_docs(spark, texts, ids)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(_brute_components(texts, ids, 3, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(spark):
    texts = ["", None, "p q r s t u v w", "p q r s t u v w", "other words stand in here now ok"]
    docs = _docs(spark, texts, [7, 7, 3, 3, 9])
    got = setsketch.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([(7, ""), (7, ""), (3, texts[2]), (9, texts[4])])
    assert setsketch.one_of_each(docs.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(f"n{i * 7919 % 1000:04}", f"n{(i + 1) * 7919 % 1000:04}") for i in range(40)] + [("s", f"t{i}") for i in range(50)]
    got = components.components(spark.createDataFrame(links, "a string, b string")).collect()
    assert sorted(Counter(r.root for r in got).values()) == [41, 51]


def test_sketch_likelihood_is_close():
    rng = np.random.default_rng(1)
    sketcher = setsketch.Sketcher(400)
    common, a, b = (rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (800, 100, 150))
    one, two = np.concatenate([common, a]), np.concatenate([common, b])
    ra, rb = sketcher.registers(one), sketcher.registers(two)
    assert (np.maximum(ra, rb) == sketcher.registers(np.unique(np.concatenate([one, two])))).all()  # sketches merge
    estimate = setsketch.likeness(*[np.array([x]) for x in ((ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum(), 900, 950)])
    assert estimate[0] == pytest.approx(800 / 1050, abs=0.08)


# 7 Licences

def test_licence_scan(spark):
    texts = [*ODD, "Released under the MIT License.", "mit-license apache  LICENSE", "the general\npublic license license",
             "Licensed under CC BY-NC 4.0.", "permission is hereby granted, free of charge, to any person", "mit mit license mit license"]
    got = {r.doc_id: r for r in license.scan(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_ASCII))
        at = [(j, label) for j in range(len(w)) for p, label in license.BASE_PHRASES.items() if w[j:j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(j for j, _ in at), max(j for j, _ in at)) if at else (None, None))
        assert 0 <= r.score <= 1
    assert got[len(ODD)].labels == "mit" and got[len(ODD)].score == 1.0
    assert got[len(ODD) + 3].labels == "cc-by-nc"
    assert got[len(ODD) + 4].labels == "mit" and got[len(ODD) + 4].base_labels == ""
    assert license.scan(_docs(spark, texts).limit(0)).count() == 0


# 8 Quality

def _brute_measures(text):
    text = text or ""
    w = _split(text)
    lines = [x for x in text.split("\n") if _split(x)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force():
    rng = random.Random(4)
    texts = ODD + ["a\n\nb\na\n \n ", "x y z " * 10, "é#é\x0bü $ ", "a b c d e f g h a b c d e f g h i"]
    texts += ["".join(rng.choice("ab \n\t#é") for _ in range(rng.randrange(200))) for _ in range(200)]
    got = quality.measure_batch(pa.array(texts))
    assert list(zip(*[got[m].tolist() for m in quality.MEASURES], strict=True)) == [_brute_measures(t) for t in texts]


def test_hosts_take_their_documents_along(spark):
    good = [_prose(i, 60) for i in range(40)]
    bad = ["spam " * 60] * 38 + [_prose(99, 60), _prose(98, 60)]
    docs = _docs(spark, [x for pair in zip(good, bad, strict=True) for x in pair], sources=["good", "bad"])
    judged = quality.judge(docs).collect()
    assert {r.host for r in judged if r.host_rejected} == {"bad"}
    assert sum(r.kept for r in judged) == 40
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.source for r in kept.collect()} == {"good"} and kept.count() == 40
    odd = _docs(spark, ODD, sources=[None])
    assert not any(r.kept for r in quality.judge(odd).collect())
    assert quality.judge(odd.limit(0)).count() == 0 and quality.keep_good(odd.limit(0)).count() == 0


# 9 Line dedup

def _brute_lines(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate(_ASCII)
        return k if len(k) >= 20 else None

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [f"  A common line number {i} here " for i in range(6)] + ["short", "", "É" * 19, "é" * 20, "x" * 20, " X" + "x" * 19 + "\r"]
    rows = [(i, None if i == 5 else "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(40)]
    docs = _docs(spark, [t for _, t in rows])
    for bits in (1 << 12, linededup.FILTER_BITS):  # a filter that is far too small changes nothing
        got = linededup.drop_lines(docs, bits=bits).select("c0", "n_lines", "n_dropped", "kept_text").collect()
        assert sorted(map(tuple, got)) == _brute_lines(rows)
    done = linededup.without_repeats(docs)
    assert done.columns == docs.columns and {r.doc_id: r.text for r in done.collect()} == {x[0]: x[3] for x in _brute_lines(rows)}
    assert linededup.without_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    line = "this line is long enough"
    docs = _docs(spark, [line, line, line + "\nx", None, ""], [1, 1, 2, 3, 3])
    got = linededup.drop_lines(docs).collect()
    assert all(r.n_dropped == 0 for r in got) and len(got) == 5


def test_filters_merge_without_losing_keys():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2 ** 63, 500).astype(np.uint64)
    f = bloom.Filters(1 << 16)
    f.add(keys)
    f.add(keys[:50])
    assert f.suspects(keys[:50]).all() and f.suspects(keys[50:]).mean() < 0.05


# 10 Fingerprints

def test_fingerprints_and_edits(spark):
    texts = ODD + [_prose(i, 80) for i in range(30)] + [_prose(3, 80)]
    docs = _docs(spark, texts)
    got = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == list(range(len(texts)))
    for i, r in enumerate(got):
        text, following = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        one, two, three = fingerprint.cells(pa.array([text, changed, following]))
        assert r.fingerprint == one.astype(">u2").tobytes().hex() and r.edited_fingerprint == two.astype(">u2").tobytes().hex()
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(one, two), fingerprint.likeness(one, three))
    same = [r.fingerprint for r in got]
    assert same[8] == same[9] and same[len(ODD) + 3] == same[-1]
    assert np.mean([r.near_edited for r in got[10:]]) > 0.3 > np.mean([r.near_next for r in got[10:]])
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    assert fingerprint.fingerprints(docs.limit(0).union(docs.filter("doc_id = 4"))).first().near_next == 1.0


def test_fingerprints_follow_order_and_repeats():
    base = _prose(1, 200).split()
    moved = base[100:] + base[:100]
    a, b, c, d = fingerprint.cells(pa.array([" ".join(base), " ".join(moved), " ".join(base + base), " ".join(base)]))
    assert fingerprint.likeness(a, d) == 1.0
    assert fingerprint.likeness(a, b) < 0.95 and fingerprint.likeness(a, c) < 0.95


def test_null_and_equal_ids_are_ordered(spark):
    docs = spark.createDataFrame([Row(doc_id=None, text="n"), Row(doc_id=2, text="b"), Row(doc_id=2, text="a")],
                                 "doc_id long, text string").select("*", F.lit(1).alias("range"), F.lit(2).alias("follower"))
    got = fingerprint.fingerprints(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 1), (2, 1), (2, 1)]


def test_trimmed_steps_give_what_they_gave():
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    assert list(store.trimmed(lambda own: (b for b in own if b["x"][0].as_py() != 1))(iter(batches))) == [batches[0], batches[2]]
    assert list(store.trimmed(iter)(iter([]))) == []

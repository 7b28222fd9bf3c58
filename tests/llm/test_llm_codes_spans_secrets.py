"""Operators 11 to 13 against brute force: secrets, tokenizer spans, vector codes."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from tidepost.llm import alignment, gridcodes, secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# 11 secrets

def _base(text):
    """The fixed patterns by hand: (kind, start, end), sorted as listed."""
    out = []
    pattern = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
                         r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    at = 0
    while (m := pattern.search(text, at)) is not None:
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, m.end()))
        at = m.end()
    for kind, first, rest, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            j = i + len(first)
            if not text.startswith(first, i):
                i += 1
                continue
            while j < len(text) and text[j] in rest:
                j += 1
            if j == i + len(first):
                i += 1
                continue
            if j - i >= least:
                out.append((i, kind, j))
            i = j
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", "paſſwd", "toKen", " ", " = ", ":", "=", '"', "'", "AKIA", "AKIAAKIA",
             "0123456789abcdef", "deadbeef", "XYZ", "é", "日", "a+/=.-_", "\n", "g", "12345"]
    texts = [None, "", " "] + ["".join(rng.choice(parts) for _ in range(rng.choice([2, 5, 12, 40]))) for _ in range(1500)]
    rows = [(i % 1400, t, "k", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, spans string").repartition(3)
    got = sorted((r.key, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.scan(df, "doc_id", "text").collect())
    want = []
    for i, t, *_ in rows:
        listed = _base(t or "")
        kinds = Counter(x.split(":")[0] for x in listed.split(",") if x)
        want.append((i, hashlib.sha256(listed.encode()).hexdigest(), kinds["assign"], kinds["access"], kinds["hex"]))
    assert got == sorted(want)


def _found(text):
    return [text[start:end] for start, kind, end, *_ in secrets.secrets(text)[1] if kind == 3]


@pytest.mark.parametrize("text, want", [
    ('k = "zX9!qpL0vv"\nother = k\ndb_password = other\n', ["zX9!qpL0vv"]),
    ('part = "abcd" + "E5f6"\nclientCredential = part + "99x"\n', ["abcd", "E5f6"]),
    ('{"name": "DB_PASSPHRASE", "value": "hunter2x9"}', ["hunter2x9"]),
    ("db:\n  passphrase: s3cr3t-Val9\n  host: example\n", ["s3cr3t-Val9"]),
    ("<c><dbPwd>qwErty77</dbPwd><x>1</x></c>", ["qwErty77"]),
    ("dsn postgres://bob:p4ssw0rd9@host/db", ["p4ssw0rd9"]),
    ('headers = {"Authorization": "Bearer eyJhbGciOi12345"}', ["eyJhbGciOi12345"]),
    ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI7MDENGbPx\nFOO=$AWS_SECRET_ACCESS_KEY\n", ["wJalrXUtnFEMI7MDENGbPx"]),
    ('const pwd string = "Tr0ub4dor"\n', ["Tr0ub4dor"]),
    ('let pwd: String = "Tr0ub4dor";', ["Tr0ub4dor"]),
    ('a="x8Kq02Lm7"\nauthJwt="${a}"\n', ["x8Kq02Lm7"]),
    ('connect(user="me", passphrase="Zk3_pppQ1")', ["Zk3_pppQ1"]),
    ("cfg['private_key'] = 'MIIEvQIBADAN'", ["MIIEvQIBADAN"]),
    ("mysql --pwd Hx77ab91 -h x", ["Hx77ab91"]),
    # A later value does not reach a name that was given the earlier one; other names are not touched.
    ('k = "zX9qpL0vv"\npwd = k\nk = "Bb7other99"\nlabel = k', ["zX9qpL0vv"]),
])
def test_literals_reach_their_names(text, want):
    assert _found(text) == want


@pytest.mark.parametrize("text", [
    'passphrase = "changeme"', 'pwd_hint = "my-dog-12345"', 'credential_url = "https://x.y/z9"', 'name = "Bob12345x"',
    'pwd = "${PWD}"', "max_tokens = 409600", 'pwd = ""', "pwd =", 'k = "zX9qpL0vv"',
    "Note: the Secretary said: Credential: Harvard. Pass: Brenner and Pin: Berlin; salt: Himalaya."])
def test_decoys_are_left_alone(text):
    assert _found(text) == []


def test_covered_literals_are_listed_once():
    text = 'password = "aB3dE6gH9k"'
    assert [k for _, k, *_ in secrets.secrets(text)[1]] == [0]


def test_lexer_is_linear():
    for unit in ("a", "a.", "a=", "x=f(", "'a ", "a: ", "x=`", "<a>", 'a = "', "x='''", "a+", "a://", "x = 'a'+", "password="):
        seconds = []
        for n in (20_000, 80_000):
            start = time.perf_counter()
            secrets.secrets(unit * (n // len(unit)))
            seconds.append(time.perf_counter() - start)
        assert seconds[1] < 9 * seconds[0] + 0.2, unit


# 12 tokenizer spans

def _aligned(pair, text):
    """(n_a, n_b, n_groups, n_links, groups, links) of a whole text by its tokens' bytes."""
    if not text:
        return 0, 0, 0, 0, "", Counter()
    raw = (" " + text).encode()
    ids_a, ids_b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    bytes_a, bytes_b = [pair.bytes_a[i] for i in ids_a], [pair.bytes_b[i] for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return 0, 0, 0, 0, "", Counter()
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        left, right = [], []
        while i < len(ends_a) and ends_a[i] <= end:
            left.append(str(ids_a[i]))
            i += 1
        while j < len(ends_b) and ends_b[j] <= end:
            right.append(str(ids_b[j]))
            j += 1
        groups.append(",".join(left) + "|" + ",".join(right))
    links = Counter()
    for i, (end, start) in enumerate(zip(ends_a, [0, *ends_a])):
        for j, (other, before) in enumerate(zip(ends_b, [0, *ends_b])):
            links[ids_a[i], ids_b[j]] += start < other and before < end
    links = +links
    return (len(ids_a), len(ids_b), len(groups), sum(links.values()),
            hashlib.sha256(";".join(groups).encode()).hexdigest(), links)


def _texts(seed, n):
    rng = random.Random(seed)
    parts = [*"abAB  \n\n\t é日🤖.,'s1<>|\x00\u3000\xa0\u0301ß𝒳\r\x1c\x85\ufeff\u200d", "<|endoftext|>", " the", "<s>", "</s>", "<0x0A>",
             "ing", "\n\n", "  ", "ſ", "﷽", "ﬁ"]
    texts = [None, "", " ", "\n", "a", " a", "a ", "▁", "a▁ b", "same text", "same text", "é" * 40]
    for i in range(n):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 5, 10, 40])))
        texts.append(text + "▁" if i % 9 == 0 else text)
    return texts


def test_alignment_equals_brute_force(spark):
    pair = alignment.Pair(*PATHS)
    texts = _texts(5, 400)
    rows = [(i % 390, t, 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, key string").repartition(3)
    got = sorted(tuple(r) for r in alignment.align(df, "doc_id", "text", *PATHS).collect())
    whole = [_aligned(pair, t) for t in texts]
    counts = Counter(k for w in whole for k in w[5])
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    want = sorted((rows[i][0], *w[:4], sum(n for k, n in w[5].items() if counts[k] == best[k[0]]),
                   sum(n * counts[k] for k, n in w[5].items()), w[4]) for i, w in enumerate(whole))
    assert got == want
    links = {(r.a, r.b): r.documents for r in alignment.id_links(df, "text", *PATHS).collect()}
    assert links == dict(counts)


def test_forgetting_changes_nothing(monkeypatch):
    texts = _texts(6, 300)
    whole = alignment.aligned(alignment.Pair(*PATHS), texts)[0]
    monkeypatch.setattr(alignment, "MEMO_UNITS", 50)
    monkeypatch.setattr(alignment, "CHAIN_CHARS", 40)
    pair, parts = alignment.Pair(*PATHS), []
    for i in range(0, len(texts), 7):
        parts += alignment.aligned(pair, texts[i:i + 7])[0]
    assert parts == whole


def test_alignment_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, "doc_id", "text", *PATHS).collect() == []


# 13 vector codes

def _compressed(rows):
    """(codes, error) by vector id, label errors and codebooks, by plain loops."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max((len(v) for *_, v in kept), default=0) // 16)
    parts = [[(v + [0] * (16 * width - len(v)))[p * width:(p + 1) * width] for p in range(16)] for *_, v in kept]
    books = [[parts[e][p] for e in range(min(64, len(kept)))] for p in range(16)]

    def near(part, p):
        gaps = [sum((x - y) ** 2 for x, y in zip(part, entry)) for entry in books[p]]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(2):
        codes = [[near(own[p], p)[0] for p in range(16)] for own in parts]
        for p in range(16):
            for e in range(len(books[p])):
                mine = [own[p] for own, code in zip(parts, codes) if code[p] == e]
                if mine:
                    books[p][e] = [math.floor(sum(c) / len(mine)) for c in zip(*mine)]
    out = []
    for (i, label, _), own in zip(kept, parts):
        found = [near(own[p], p) for p in range(16)]
        out.append((i, label, [f[0] for f in found], sum(f[1] for f in found)))
    return out, books


def _vectors(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(dims)], rng.choice([None, 0, 0, 0, 1, 2])) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [None] * dims, 1), (n + 3, [float("nan")] + [0.0] * (dims - 1), 0),
             (n + 4, [float("-inf")] * dims, None), (n + 5, [0.5] * (dims - 3), 2), (n + 6, [], 2), (3, rows[3][1], 0),
             (None, [0.25] * dims, None), (n + 7, [-1 / 512] * dims, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, dims", [(200, 64), (40, 64), (90, 50), (0, 16)])
def test_codes_equal_brute_force(spark, n, dims):
    rows = _vectors(max(n, 4), dims, n) if n else []
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows],
                               "vec_id long, embedding array<double>, label int, key int, error string").repartition(3)
    got, books = gridcodes.compress(df, "vec_id", "embedding", "label")
    want, entries = _compressed(rows)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    have = sorted(((r.key, r.label, r.codes, r.error, r.label_error) for r in got.collect()), key=repr)
    assert have == sorted(((i, label, codes, error, sums[label]) for i, label, codes, error in want), key=repr)
    listed = ",".join(str(x) for p in entries for e in p for x in e)
    assert books.digest() == hashlib.sha256(listed.encode()).hexdigest()
    if n:
        back = {(r.key, r.error): r.vector for r in gridcodes.decode(got, books).collect()}
        for i, _, codes, error in want:
            own = [x for p, c in enumerate(codes) for x in entries[p][c]]
            assert np.allclose(np.array(back[i, error]) * 256, own)


def test_cells_never_lose_the_nearest_entry():
    rng = np.random.default_rng(2)
    for width in (1, 3, 8):
        entries = rng.integers(-60, 60, (64, width))
        entries[5] = entries[9]
        parts = rng.integers(-90, 90, (3000, width))
        gaps = ((parts[:, None, :] - entries) ** 2).sum(axis=2)
        for edge in (1, 8, 64):
            cells = gridcodes.GridCells(entries)
            cells.edge = edge
            code, gap = cells.nearest(parts)
            assert np.array_equal(code, gaps.argmin(axis=1)) and np.array_equal(gap, gaps.min(axis=1))


def test_large_components_stay_longs(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** 30] * 64, 0) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, _ = gridcodes.compress(df, "vec_id", "embedding", "label", entries=1)
    assert all(r.error >= 0 for r in got.collect())

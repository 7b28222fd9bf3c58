import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepost.functions import html as H
from tidepost.functions import text as X
from tidepost.functions import vectors
from tidepost.operators import embedding, keywords, terms


def one(spark, column, *values):
    """The column over one-column rows, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_clean_text(spark):
    rows = ["<b>Hi</b> the new\\nWorld 42!", "<a\nhref>left", None, "don't  stop\xa0now\x1cplease", "São Paulo"]
    got = one(spark, X.clean_text(F.col("x")), *rows)
    # Stop words go after the letters-only step: "a", "now", and what is left of "São".
    assert got == ["hi world", "hrefleft", "", "dont stop please", "paulo"]


def test_literal_cleaning_keeps_letters_and_backslashes(spark):
    assert one(spark, X.clean_text(F.col("x"), keep_backslash=True), "A b\\c <i>d</i> e") == ["ab\\cde"]


def test_tokens_split_like_python(spark):
    text = " a\tb\x0bc\x1cd\x85e\xa0f g h　i "
    assert one(spark, X.tokens(F.col("x")), text) == [text.split()]


def test_word_count(spark):
    values = ["", "a  b ", "one", None, "a b c"]
    assert one(spark, X.word_count(F.col("x")), *values) == [len((v or "").split(" ")) for v in values]


def test_company_in_description(spark):
    df = spark.createDataFrame([(0, None, "x"), (1, "", "x"), (2, "Acme", "at Acme now"), (3, "acme", "at Acme"),
                                (4, "Acme", None)], "i int, c string, d string")
    got = [r[0] for r in df.orderBy("i").select(X.company_in_description(F.col("c"), F.col("d"))).collect()]
    assert got == [False, True, True, False, False]


def test_rating_parse(spark):
    assert one(spark, X.parse_rating(F.col("x")), " +7 ", "7/10", "7.0", None, "99", "-3", "", "seven", "\t8\n") == \
        [7, 0, 0, 0, 99, -3, 0, 0, 8]


def test_ids(spark):
    assert one(spark, X.id_from_urn(F.col("x")), "urn:li:jobPosting:123", "x:y", None) == ["123", None, None]
    card = X.id_from_card(F.lit(None).cast("string"), F.col("x"))
    assert one(spark, card, "/jobs/view/77/?a=1", "/jobs/other", None) == ["77", None, None]
    assert one(spark, X.id_from_card(F.col("x"), F.lit("/view/5/")), "9", "") == ["9", "5"]


def test_pieces(spark):
    assert one(spark, X.strip_label(F.col("x"), "Seniority level"), " Seniority level  Entry ") == ["Entry"]
    assert one(spark, X.delimited_part(F.col("x"), "|", 2), "A | B | C", "A", "A|") == ["B", None, ""]


def test_keyword_hits_use_the_token_set(spark):
    df = spark.createDataFrame([("Python, python energy systems",), ("systems of energy",), ("python,",), (None,)],
                               "desc string")
    rows = keywords.keyword_hits(df, "desc").select("keyword_coding", "keyword_energy").collect()
    assert [tuple(r) for r in rows] == [(1, 1), (0, 1), (0, 0), (0, 0)]


def test_weighted_keywords(spark):
    df = spark.createDataFrame([("llm python climate battery gis opencv",)], "desc string")
    row = keywords.keyword_features(df).first()
    assert row.word_count == 6
    assert row.total_weighted_keywords == pytest.approx(1 + 1 + 0.7 + 1 + 0.8 + 0.3)
    assert row.weighted_keywords == pytest.approx(4.8 / 6)


def test_lemmatize_keeps_order_and_empty_documents(spark):
    df = spark.createDataFrame([("a", ["cats", "run", "cats"]), ("b", [])], "id string, w array<string>")
    lemmas = spark.createDataFrame([("cats", "cat")], "surface string, lemma string")
    got = {r.id: r.w for r in terms.lemmatize(df, "id", "w", lemmas).collect()}
    assert got == {"a": ["cat", "run", "cat"], "b": []}


def test_visible_text(spark):
    html = "<p>a<!-- x --> <b>b</b></p><script>var t='</p>'</script><style>p{}</style> &amp;lt; c&nbsp;d"
    assert one(spark, H.visible_text(F.col("x")), html) == ["a b &lt; c d"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(terms.ngrams(F.col("w"), 2)).collect()] == [["a b", "b c"], [], []]


def test_hashed_words_against_plain_python(spark):
    import hashlib

    import numpy as np

    texts = ["The cat the DOG\x85cat", "", None, "x", " a\x1cb\u2003a\u3000 \x0bc\xa0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, desc string")
    rows = embedding.embed_documents(df, embedding.hashed_words(16)).orderBy("i").collect()
    for text, row in zip(texts, rows):
        counts = np.zeros(16)
        for word in (text or "").lower().split():
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
        norm = np.linalg.norm(counts)
        assert row.embedding == pytest.approx(list(counts / norm if norm else counts))


def test_model_embedder_gets_templates_and_loads_once_per_task(spark):
    def load():
        import numpy as np
        return lambda texts: np.array([[len(t), t.count("<|endoftext|>")] for t in texts], dtype=float)

    df = spark.createDataFrame([("abc",), (None,)], "desc string").coalesce(1)
    docs = embedding.embed_documents(df, embedding.with_model(load)).collect()
    assert [r.embedding for r in docs] == [[16.0, 1.0], [13.0, 1.0]]
    query = embedding.embed_documents(df, embedding.with_model(load, as_query=True)).first().embedding
    assert query[0] > 80
    anchors = embedding.embed_anchors(df, {"p": "text"}, "crit", embedding.with_model(load)).first()
    assert anchors.embedding[0] == len("text\n\nKey Requirements:\ncrit<|endoftext|>")


def word_model(calls=None):
    """Each text's word count, its first word's number and a constant."""

    def model(texts):
        import numpy as np
        if calls is not None:
            open(calls, "a").write(f"{[len(t.split()) for t in texts]}\n")
        return np.array([[len(t.split()), float((t.split() or ["0"])[0]), 1.0] for t in texts])

    return lambda: model


def test_windows_cover_all_tokens_and_share_the_overlap():
    from tidepost.functions.vectors import token_windows

    for n in range(0, 60):
        for room, overlap in [(1, 0), (5, 0), (5, 2), (7, 6), (60, 3)]:
            spans = [(3 * i, 3 * i + 2) for i in range(n)]
            got = token_windows(spans, room, overlap)
            want, at = [], 0
            while True:
                part = spans[at:at + room]
                want.append((part[0][0], part[-1][1], len(part)) if part else (0, 0, 0))
                if at + room >= n:
                    break
                at += room - overlap
            assert got == want, (n, room, overlap)


@pytest.mark.parametrize("budget,partitions", [(1, 1), (25, 3), (10_000, 2)])
def test_long_texts_are_read_whole_whatever_the_batches(spark, budget, partitions):
    from tidepost.functions.vectors import white_space_spans, windowed_embedding

    lengths = [0, 1, 9, 10, 11, 18, 19, 500, 3]
    rows = [(i, " ".join(str(j) for j in range(n))) for i, n in enumerate(lengths)] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(partitions)
    vector = windowed_embedding(F.col("t"), word_model(), lambda: white_space_spans, context=10, overlap=2, budget=budget)
    got = {r.i: r.v for r in df.select("i", vector.alias("v")).collect()}
    for i, n in [*enumerate(lengths), (99, 0)]:
        starts = [0]
        while starts[-1] + 10 < n:
            starts.append(starts[-1] + 8)
        sizes = [min(10, n - a) for a in starts]
        weights = [max(s, 1) for s in sizes]
        want = [sum(x * w for x, w in zip(part, weights)) / sum(weights) for part in (sizes, starts, [1.0] * len(starts))]
        assert got[i] == pytest.approx(want), i


def test_calls_stay_within_the_token_budget(spark, tmp_path):
    from tidepost.functions.vectors import white_space_spans, windowed_embedding

    calls = str(tmp_path / "calls")
    df = spark.createDataFrame([(" ".join("1" for _ in range(n)),) for n in range(1, 40)], "t string").coalesce(1)
    vector = windowed_embedding(F.col("t"), word_model(calls), lambda: white_space_spans, context=16, overlap=4, budget=64)
    df.select(vector.alias("v")).write.format("noop").mode("overwrite").save()
    seen = [eval(line) for line in open(calls)]
    assert all(max(c) <= 16 and len(c) * (max(c) + 1) <= 64 for c in seen)
    assert any(len(c) > 6 for c in seen)


def test_templates_stand_around_each_window(spark):
    def load():
        import numpy as np
        return lambda texts: np.array([[t.count("<|endoftext|>"), len(t.split())] for t in texts], dtype=float)

    df = spark.createDataFrame([(" ".join(["w"] * 50),)], "desc string")
    row = embedding.embed_documents(df, embedding.with_windows(load, context=12, overlap=1, budget=24)).first()
    assert row.embedding[0] == 1.0 and row.embedding[1] <= 12
    with pytest.raises(ValueError, match="overlap"):
        embedding.with_windows(load, context=8, overlap=8)(F.col("desc"))


def test_hashed_counts_of_slices_equal_those_of_the_batch(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE_BYTES", 10)
    whole = vectors.bag_matrix
    texts = ["red green", None, "blue " * 20, "", "red red", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = [r.v for r in df.select("id", vectors.hashed_counts(F.col("text"), 8).alias("v")).orderBy("id").collect()]
    assert np.allclose(np.array(got), whole(pa.array(texts), 8))

    def counted(texts, width):  # runs in the worker; what it saw comes back as the first entry
        return np.full((len(texts), width), float(len(texts)))

    monkeypatch.setattr(vectors, "bag_matrix", counted)
    sizes = [r.v[0] for r in df.select("id", vectors.hashed_counts(F.col("text"), 8).alias("v")).orderBy("id").collect()]
    assert sizes == [2.0, 2.0, 1.0, 3.0, 3.0, 3.0]

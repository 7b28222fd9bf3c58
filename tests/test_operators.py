import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepost.functions import batches
from tidepost.operators import frames, keyed, metrics, phrases, ranking, rating, scaling, similarity, terms


def test_upsert_wipes_missing_columns_and_is_idempotent(spark):
    store = spark.createDataFrame([("a", "old", 9.0), ("b", "old", 8.0)], "job_id string, titles string, score double")
    fresh = spark.createDataFrame([("a", "new", 1), ("a", "newer", 2), ("c", "add", 1)],
                                  "job_id string, titles string, scraped_at int")
    once = keyed.upsert_replace(store, fresh, "job_id", ["scraped_at"])
    twice = keyed.upsert_replace(once, fresh, "job_id", ["scraped_at"])
    want = {("a", "newer", None, 2), ("b", "old", 8.0, None), ("c", "add", None, 1)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_update_sets_nulls_only_for_matched_keys(spark):
    store = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "k string, x double, y double")
    updates = spark.createDataFrame([("a", None), ("z", 5.0)], "k string, x double")
    got = {tuple(r) for r in keyed.update_columns(store, updates, "k").collect()}
    assert got == {("a", None, 2.0), ("b", 3.0, 4.0)}


def test_anti_and_semi_cover_the_input(spark):
    incoming = spark.range(100).withColumn("k", F.col("id") % 7)
    store = spark.range(3).withColumnRenamed("id", "k")
    new = keyed.new_rows(incoming, store, "k").count()
    assert new + incoming.join(store, "k", "left_semi").count() == 100
    assert new == sum(1 for i in range(100) if i % 7 > 2)


def test_refetch_needs_title_and_text(spark):
    store = spark.createDataFrame([("a", "t", "d"), ("b", "", "d"), ("c", "t", None)],
                                  "k string, titles string, desc string")
    incoming = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert sorted(r.k for r in keyed.rows_to_fetch(incoming, store, "k").collect()) == ["b", "c", "d"]


def test_drop_duplicates_keeps_first_and_matches_nulls(spark):
    rows = [(3, "x", None), (1, "x", None), (2, "x", ""), (4, "-", None), (5, None, "x"), (6, "1:x", ""), (7, "x", "1:")]
    df = spark.createDataFrame(rows, "o int, a string, b string")
    kept = {r.o for r in keyed.drop_duplicates_keep_first(df, ["a", "b"], "o").collect()}
    assert kept == {1, 2, 4, 5, 6, 7}


def test_hot_group_of_copies_is_folded_before_the_shuffle(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("o"), F.lit("text").alias("t"))
    kept = keyed.first_per_key(df, ["k"], ["o"], last=True)
    rows = {r.k: r.o for r in kept.collect()}
    assert rows[-1] == 19998 and len(rows) == 13334
    assert "partial_max_by" in kept._jdf.queryExecution().executedPlan().toString()


def test_top_n_per_group(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaaab"), rng.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, s int, id int")
    for n in (3, 150):
        got = {(r.g, r.rank, r.id) for r in ranking.top_n_per_group(
            df, ["g"], [F.desc("s"), F.asc("id")], n).collect()}
        want = set()
        for g in "ab":
            best = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))[:n]
            want |= {(g, i + 1, x[2]) for i, x in enumerate(best)}
        assert got == want
        top = [r.id for r in ranking.top_n(df, [F.desc("s"), F.asc("id")], n).collect()]
        assert top == [x[2] for x in sorted(data, key=lambda x: (-x[1], x[2]))[:n]]


def test_crawl_budget_counts_new_rows_within_the_source_cap(spark):
    listing = spark.range(30).select(F.lit("q").alias("q"), F.col("id").cast("string").alias("k"), "id")
    store = spark.createDataFrame([("0",), ("2",)], "k string")
    got = ranking.crawl_budget(listing, store, query="q", key="k", order=[F.asc("id")], max_pages=2,
                               page_size=3, source_cap=7).orderBy("rank").collect()
    assert [r.k for r in got] == ["1", "3", "4", "5", "6"]


def test_seeded_rank_is_a_permutation_per_class(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") < 9, None).otherwise(0).alias("y"))
    rows = ranking.seeded_rank(df, "y", "id", 5, digits=2).collect()
    assert len(rows) == 2000
    for y in (0, 1, None):
        group = [r for r in rows if r.y == y]
        assert sorted(r.position for r in group) == list(range(1, len(group) + 1))
        assert {r.group_size for r in group} == {len(group)}


@pytest.mark.parametrize("n", [3, 11, 403])
def test_folds_are_balanced_per_class(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    rows = ranking.stratified_folds(df, "y", "id").collect()
    for y in (0, 1):
        counts = Counter(r.fold for r in rows if r.y == y)
        sizes = [counts.get(f, 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(1 for r in rows if r.y == y)
    test = ranking.stratified_holdout(df, "y", "id").filter("is_test").groupBy("y").count().collect()
    for r in test:
        total = sum(1 for x in rows if x.y == r.y)
        assert r["count"] == math.floor(total * 0.25 + 0.5)


@pytest.mark.parametrize("spread", [4, 100000])
def test_auc_equals_pair_counting(spark, spread):
    rng = random.Random(spread)
    data = [(m, rng.randint(0, 1), rng.randint(0, spread) / spread) for m in "ab" for _ in range(150)]
    df = spark.createDataFrame(data, "m string, label int, probability double").withColumn(
        "prediction", (F.col("probability") >= 0.5).cast("int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.m: r for r in metrics.classification_metrics(df, ["m"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for m in "ab":
        pos = [p for k, y, p in data if k == m and y == 1]
        neg = [p for k, y, p in data if k == m and y == 0]
        wins = sum((p > q) + (p == q) / 2 for p, q in itertools.product(pos, neg))
        assert got[m].roc_auc == pytest.approx(wins / (len(pos) * len(neg)))
        tp = sum(p >= 0.5 for p in pos)
        assert got[m].recall == pytest.approx(tp / len(pos))
        assert got[m].precision == pytest.approx(tp / (tp + sum(q >= 0.5 for q in neg)))


def test_auc_without_groups_and_without_a_class(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.2, 0), (0, 0.5, 1)], "label int, probability double, prediction int")
    row = metrics.classification_metrics(df).first()
    assert row.roc_auc == pytest.approx(0.5) and row.accuracy == pytest.approx(1 / 3)
    assert metrics.roc_auc(df.filter("label = 1")).first().roc_auc is None


def test_confusion_and_distribution(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (None, 1)], "label int, prediction int")
    assert {tuple(r) for r in metrics.confusion_matrix(df.filter("label is not null")).collect()} == {(1, 1, 1), (0, 1, 0)}
    assert {(r.label, r.share) for r in metrics.class_distribution(df).collect()} == {(1, 2 / 3), (0, 1 / 3)}


def test_minmax(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5)], "x double, c int")
    bounds = scaling.fit_minmax(df, ["x", "c"])
    new = spark.createDataFrame([(5.0, 9)], "x double, c int")
    assert tuple(scaling.apply_minmax(new, bounds).first()) == (2.0, 0.0)


def test_scores_zero_opposite_null_and_rounding(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])],
                               "id int, embedding array<float>")
    rows = {r.id: r for r in similarity.score_profiles(df, {"p": [1.0, 0.0], "q": [0.0, 0.0]}).collect()}
    assert [rows[i].score_p for i in range(5)] == [100.0, -100.0, 0.0, None, 70.71]
    assert [rows[i].similarity_score for i in range(5)] == [100.0, 0.0, 0.0, None, 70.71]
    assert np.round(0.125, 2) == 0.12


def test_scores_refuse_other_widths(spark):
    df = spark.createDataFrame([([1.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="2 entries"):
        similarity.score_profiles(df, {"p": [1.0, 0.0]}).collect()
    profiles = spark.range(1500).select(F.col("id").cast("string").alias("profile"), F.array(F.lit(1.0)).alias("embedding"))
    assert len(similarity.anchor_vectors(profiles)) == 1500


def test_tfidf_against_plain_python(spark):
    texts = {"1": "red green blue red", "2": "red yellow", "3": "green", "4": "", "5": "red red yellow blue"}
    df = spark.createDataFrame(list(texts.items()), "id string, desc string")
    idf = terms.fit_idf(df, "id", "desc", max_df=0.5, max_features=4)
    grams = {}
    for key, text in texts.items():
        words = text.split()
        grams[key] = Counter(words + [" ".join(p) for p in zip(words, words[1:])])
    df_of, cf = Counter(), Counter()
    for counts in grams.values():
        df_of.update(counts.keys())
        cf.update(counts)
    kept = sorted((t for t in df_of if df_of[t] <= 2.5), key=lambda t: (-cf[t], t))[:4]
    assert {r.term for r in idf.collect()} == set(kept)
    weight = {t: math.log(6 / (1 + df_of[t])) + 1 for t in kept}
    got = {(r.id, r.term): r.weight for r in terms.tfidf(df, idf, "id", "desc").collect()}
    want = {}
    for key, counts in grams.items():
        row = {t: counts[t] * weight[t] for t in kept if t in counts}
        norm = math.sqrt(sum(w * w for w in row.values()))
        want |= {(key, t): w / norm for t, w in row.items()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 3, 7, 40, 1000])
def test_frequent_terms_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(d, f"t{min(int(rng.expovariate(0.05)), 300)}") for d in range(300) for _ in range(20)]
    tf = Counter(rows)
    counts = terms.written_counts(spark.createDataFrame([(d, t, c) for (d, t), c in tf.items()], "k long, term string, tf long"))
    df, cf = Counter(t for _, t in tf), Counter(t for _, t in rows)
    able = sorted((t for t in df if df[t] <= 200), key=lambda t: (-cf[t], t))
    least = cf[able[n - 1]] if len(able) >= n else 1
    want = {(t, df[t], cf[t]) for t in able if cf[t] >= least}
    allowed = F.col("df") <= 200
    assert {tuple(r) for r in terms.frequent_terms(counts, allowed, n).collect()} == want
    # Terms that share ids (here nearly all do) are still told apart.
    shared = terms.frequent_terms(counts, allowed, n, ids=lambda: F.pmod(F.xxhash64("term"), F.lit(5)))
    assert {tuple(r) for r in shared.collect()} == want
    empty = terms.frequent_terms(counts.limit(0), allowed, n)
    assert empty.count() == 0


def test_once_seen_terms_and_strings_stay_where_they_are(spark):
    common = spark.range(2000).select("id", F.concat(F.lit("c"), F.col("id") % 20).alias("term"), F.lit(1).cast("long").alias("tf"))
    once = spark.range(20000).select("id", F.concat(F.lit("once"), "id").alias("term"), F.lit(1).cast("long").alias("tf"))
    counts = terms.written_counts(common.unionByName(once))
    found = terms.frequent_terms(counts, F.lit(True), 20)
    assert {r.term for r in found.collect()} == {f"c{i}" for i in range(20)}
    idf = terms.with_idf(found, common).withColumn("number", F.monotonically_increasing_id())
    weights = terms.tfidf(counts, idf, "id", "", counts=counts)
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "term" not in window.splitlines()[0] and weights.count() == 2000


def test_term_counts_do_not_shuffle_exploded_terms(spark):
    df = spark.createDataFrame([("1", "red green")], "id string, desc string")
    plan = terms.term_counts(df, "id", "desc")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0


def test_grams_are_counted_in_slices_of_a_batch(spark, monkeypatch):
    """Slices of a few words give the counts of whole rows, in both forms, and weights without a shuffle."""
    assert [(s.start, s.stop) for s in batches.slices(np.array([5, 5, 20, 1, 0]), 10)] == [(0, 2), (2, 3), (3, 5)]
    monkeypatch.setattr(terms, "SLICE_WORDS", 6)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["red", "green", "blue", "red blue"]) for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(60)]
    df = spark.createDataFrame([*texts, (60, None)], "id long, desc string").coalesce(1)
    want = Counter()
    for key, text in texts:
        words = text.split()
        for n in (1, 2, 3):
            want.update((key, " ".join(p)) for p in zip(*[words[j:] for j in range(n)]))
    long = [tuple(r) for r in terms.term_counts(df, "id", "desc", ngram_range=(1, 3)).collect()]
    whole = [tuple(r) for r in terms.document_counts(df, "id", "desc", ngram_range=(1, 3)).collect()]
    assert len(long) == len(want) and {(k, t): n for k, t, n in long} == want and len(whole) == 61
    assert {(k, t): n for k, ts, ns in whole for t, n in zip(ts, ns)} == want
    idf = terms.fit_idf(df, "id", "desc", max_df=1.0, max_features=5)
    weights = terms.tfidf(df, idf, "id", "desc")
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    by_term = terms.tfidf(df, idf, "id", "desc", counts=terms.term_counts(df, "id", "desc"))
    got, other = ({(r.id, r.term): r.weight for r in x.collect()} for x in (weights, by_term))
    assert got == pytest.approx(other)
    twice = df.unionByName(spark.createDataFrame([(3, "red blue green"), (None, "red"), (None, "red green")], df.schema))
    both = [sorted((r.id is None, r.id or 0, r.term, round(r.weight, 9)) for r in terms.tfidf(twice, idf, "id", "desc", counts=c).collect())
            for c in (None, terms.term_counts(twice, "id", "desc"))]
    assert both[0] == both[1]
    monkeypatch.setattr(terms, "HELD_TERMS", 1)
    assert {(r.id, r.term): r.weight for r in terms.tfidf(df, idf, "id", "desc").collect()} == pytest.approx(other)


def test_frames(spark):
    empty = frames.union_sources([], T.StructType([T.StructField("x", T.StringType())]))
    assert empty.count() == 0 and empty.columns == ["x"]
    assert frames.union_sources([]) is None
    df = spark.createDataFrame([("a", None, -1), ("b", "here", 1), ("c", "x", None)], "k string, location string, label int")
    assert [r.k for r in frames.labelled_only(df).collect()] == ["b"]
    full = frames.with_defaults(df, {"location": "", "level": "none"}).first()
    assert (full.location, full.level) == ("", "none")


def test_search_recency_and_missing_text(spark):
    df = spark.sql("select * from values ('1', 'Data Job', null, 'San Jose', timestamp_ntz'2024-01-30 01:00:00'),"
                   "('2', null, 'a data job', 'Oslo', timestamp_ntz'2024-01-29 23:00:00'),"
                   "('3', 'data', 'x', 'San Jose', null) t(k, titles, desc, location, posted_at)")
    assert [r.k for r in frames.search(df, keywords="DATA", recency="r86400", as_of="2024-01-31 00:00:00").collect()] == ["1"]
    assert {r.k for r in frames.search(df, keywords="data", location="san").collect()} == {"1", "3"}
    with pytest.raises(ValueError):
        frames.search(df, recency="r86400")


def test_ratings_and_cost(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    replies = spark.createDataFrame([("a", " 7\n", 100), ("b", "99", 50)], "job_id string, raw string, total_tokens int")
    got = {r.job_id: (r.rating, r.rating_valid) for r in rating.attach_ratings(jobs, replies, "job_id").collect()}
    assert got == {"a": (7, True), "b": (99, False), "c": (0, False)}
    assert rating.token_cost(replies).first().cost == pytest.approx(150 / 1000 * 0.0006)
    prompts = rating.build_prompts(spark.createDataFrame([("a", "Acme {titles}")], "job_id string, companies string"),
                                   "job_id", "me", "near")
    text = prompts.first().prompt
    assert "- Company: Acme {titles}\n- Title: \n- Location: \n- Description: \n" in text
    assert text.startswith("You are a career advisor.") and "User Profile:\nme\n" in text


def test_python_workers_do_not_need_the_package(tmp_path):
    """As on a cluster: only the driver can import the library."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from tidepost.operators import embedding, many_profiles, similarity
from tidepost.session import build_session
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false"}})
df = spark.createDataFrame([("red green",)], "desc string")
vectors = embedding.embed_documents(df, embedding.hashed_words(4))
print(similarity.score_profiles(vectors, {{"p": [1.0, 1.0, 1.0, 1.0]}}).first().score_p)
windows = embedding.embed_documents(df, embedding.hashed_windows(4, context=2, overlap=0)).withColumn("job_id", vectors.desc)
print(many_profiles.best_matches(windows, windows.withColumnRenamed("job_id", "profile")).collect())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_equal_orders_are_settled_by_the_row(spark):
    rows = [("k", 1, f"text {i}") for i in range(50)]
    picks = {keyed.first_per_key(spark.createDataFrame(rows[i:] + rows[:i], "k string, o int, t string").repartition(4),
                                 ["k"], ["o"], last=True).first().t for i in (0, 7, 31)}
    assert len(picks) == 1


def test_repeated_replies_do_not_multiply_postings(spark):
    from tidepost.operators import rating

    postings = spark.createDataFrame([("a",), ("b",)], "k string")
    replies = spark.createDataFrame([("a", "3", 1), ("a", "8", 2), ("a", "5", 0)], "k string, raw string, at int")
    got = {r.k: r.rating for r in rating.attach_ratings(postings, replies, "k", order=["at"]).collect()}
    assert got == {"a": 8, "b": 0}
    assert rating.attach_ratings(postings, replies.drop("at"), "k").count() == 2


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_lemmas_by_any_join_are_the_same(spark, limit):
    rows = [(str(i), (["les", "x"] * 3 + ["los"]) if i % 3 else []) for i in range(40)] + [("n", None)]
    df = spark.createDataFrame(rows, "k string, w array<string>")
    lemmas = spark.createDataFrame([("les", "le"), ("los", "el"), ("unused", "u")], "surface string, lemma string")
    want = {k: w and [{"les": "le", "los": "el"}.get(x, x) for x in w] for k, w in rows}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        assert {r.k: r.w for r in terms.lemmatize(df, "k", "w", lemmas).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lemmas_of_nulls_and_repeated_keys(spark):
    rows = [("a", ["les", None, "x"]), ("a", ["x", "les"]), ("a", ["x", "les"]), ("b", None), ("c", []), (None, ["los"]), ("d", [None])]
    df = spark.createDataFrame(rows, "k string, w array<string>")
    lemmas = spark.createDataFrame([("les", "le"), ("los", "el"), (None, "none"), ("x", None)], "surface string, lemma string")
    want = [(k, w and [{"les": "le", "los": "el"}.get(x, x) for x in w]) for k, w in rows]
    got = terms.lemmatize(df, "k", "w", lemmas).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_large_phrase_table_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    table = [(f"b{i % 3}", " ".join(rng.choices(words, k=rng.choice([1, 2, 2, 3, 4])))) for i in range(100_000)]
    table += [("b0", "W1  w1"), ("b0", "w1"), ("b1", ""), ("b1", "  "), ("b2", None), ("b9", "w5")]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 30, 200])))) for i in range(60)] + [(100, None), (101, "w1 W1 W5")]
    got = phrases.keyword_hits(spark.createDataFrame(texts, "k int, t string").repartition(3), "k", "t",
                               spark.createDataFrame(table, "bin string, phrase string").repartition(4), ["b0", "b1", "b2"])
    sets = [(b, frozenset(p.lower().split())) for b, p in table if p and p.split()]
    for r in got.collect():
        own = set((dict(texts)[r.k] or "").lower().split())
        want = Counter(b for b, p in sets if p <= own)
        assert (r.keyword_b0, r.keyword_b1, r.keyword_b2) == (want["b0"], want["b1"], want["b2"])
    assert got.count() == len(texts)


def test_a_phrase_table_without_phrases(spark):
    texts = spark.createDataFrame([(1, "a b")], "k int, t string")
    none = spark.createDataFrame([], "bin string, phrase string")
    assert phrases.keyword_hits(texts, "k", "t", none, ["x"]).collect()[0].keyword_x == 0

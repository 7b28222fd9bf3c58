import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepost.operators import many_profiles as M


def brute_force(docs, profiles, n):
    """Rows (profile, rank, key, score) by one plain product."""

    def unit(v):
        v = np.asarray(v, float)
        return v / np.linalg.norm(v) if v.any() else v

    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    out = set()
    for name, p in profiles:
        if usable(p):
            scored = sorted((-round(float(unit(p) @ unit(v)) * 100, 2), k) for k, v in docs if usable(v))
            out |= {(name, i + 1, k, -s if s else 0.0) for i, (s, k) in enumerate(scored[:n])}
    return out


def clustered(seed, n_docs, n_profiles, width=8):
    """Vectors around six directions; a third of the rows are one vector, some are zero, null or not finite."""
    rng = np.random.default_rng(seed)
    towards = rng.normal(size=(6, width)) * 4
    docs = [(i, (towards[i % 6] + rng.normal(size=width) * 0.3).tolist()) for i in range(n_docs)]
    docs = [(i, docs[0][1]) if i % 3 == 0 else (i, v) for i, v in docs]
    docs[1], docs[2], docs[4] = (1, [0.0] * width), (2, None), (4, [float("nan")] * width)
    docs[5] = (5, [None] * width)
    profiles = [(f"p{i}", (towards[i % 6] + rng.normal(size=width) * 0.3).tolist()) for i in range(n_profiles)]
    profiles += [("zero", [0.0] * width), ("none", None), ("hot", docs[0][1])]
    return docs, profiles


def frames(spark, docs, profiles):
    return (spark.createDataFrame(docs, "id long, v array<double>").repartition(5),
            spark.createDataFrame(profiles, "name string, v array<double>"))


@pytest.mark.parametrize("n,block_rows,pivots", [(1, 16, 6), (3, 40, 1), (5, 8192, 64), (1000, 64, 12)])
def test_best_rows_equal_brute_force(spark, n, block_rows, pivots):
    docs, profiles = clustered(n, 240, 20)
    got = M.best_matches(*frames(spark, docs, profiles), n, "id", "name", "v", pivots, block_rows)
    assert got.columns == ["name", "rank", "id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_force(docs, profiles, n)


def test_cells_that_cannot_win_are_not_asked(spark):
    docs, profiles = clustered(3, 600, 30)
    rows, asking = frames(spark, docs, profiles[:30])
    centres = M.pick_pivots(rows, "id", "v", 64)
    placed = M.place(rows, centres, "id", "v")
    cells = [tuple(r) for r in placed.groupBy("cell").agg(F.count("*"), F.min("near")).collect()]
    bounds = M.bounded(asking, centres, cells, 2, "name", "v")
    found = M.best_matches(rows, asking, 2, "id", "name", "v")
    floors = found.withColumnsRenamed({"name": "_profile", "id": "_key"})
    asked = M.home_asks(bounds).count() + M.other_asks(bounds, floors, 2).count()
    assert asked < 30 * len(cells) * 0.6


def test_a_cell_of_copies_is_split_into_blocks(spark):
    docs = [(7, [1.0, 2.0])] * 500
    rows, asking = frames(spark, docs, [("a", [2.0, 4.0])])
    placed = M.place(rows, np.eye(1, 2), "id", "v")
    dealt = placed.groupBy(F.pmod("deal", F.lit(10))).count().collect()
    assert len(dealt) == 10 and max(r["count"] for r in dealt) < 120
    got = M.best_matches(rows, asking, 4, "id", "name", "v", block_rows=50).collect()
    assert sorted(tuple(r) for r in got) == [("a", i, 7, 100.0) for i in (1, 2, 3, 4)]


def test_nothing_to_match(spark):
    rows, asking = frames(spark, [(1, [1.0, 0.0])], [("a", [1.0, 1.0])])
    for docs, profiles in [(rows.filter("id > 1"), asking), (rows, asking.filter("name > 'a'")),
                           (rows.withColumn("v", F.lit(None).cast("array<double>")), asking)]:
        got = M.best_matches(docs, profiles, 2, "id", "name", "v")
        assert got.columns == ["name", "rank", "id", "score"] and got.collect() == []


def test_vectors_of_other_lengths_are_refused(spark):
    rows, asking = frames(spark, [(1, [1.0, 0.0])], [("a", [1.0, 1.0, 0.0])])
    with pytest.raises(Exception, match="vectors must all have 2 entries"):
        M.best_matches(rows, asking, 2, "id", "name", "v").collect()

import numpy as np
import pytest

from kbspark.llm import ann


def test_chi_square():
    assert abs(ann.chi_square(15.507, 8) - 0.95) < 1e-4 and abs(ann.chi_square(ann._threshold(0.99)) - 0.99) < 1e-9


@pytest.mark.parametrize("cell_rows", [ann.CELL_ROWS, 120])
def test_nearest_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((900, 24))
    v[300:320] = v[300] + 0.01 * rng.standard_normal((20, 24))
    v[400:410] = v[400]
    rows = spark.createDataFrame([(k, x.tolist(), "c") for k, x in enumerate(v)], "vec_id long, v array<double>, rank string")
    got = ann.nearest(rows.where("vec_id % 20 = 0").select(rows.vec_id.alias("query_id"), "v"), rows.select("vec_id", "v"), cell_rows=cell_rows).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 900, 20):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(900), -s))[:5]) & {r.vec_id for r in got if r.query_id == q})
    assert hits / (45 * 5) >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 400] == [401, 402, 403, 404, 405]
    assert all(abs(r.score - float(unit[r.query_id] @ unit[r.vec_id])) < 1e-12 for r in got)
    assert sorted((r.query_id, r.rank) for r in got) == [(q, n) for q in range(0, 900, 20) for n in range(1, 6)]


def test_cells_hold_every_row_of_a_length():
    p = np.random.default_rng(2).standard_normal((2_000, ann.M))
    cells = ann.Cells({24: p}, 100)
    of = cells.of(24, p)
    assert np.bincount(of)[np.unique(of)].max() <= 100 and (of >= 0).all() and (cells.of(7, p) == -1).all()
    assert len(set(ann.Cells({24: np.ones((50, ann.M))}, 10).of(24, np.ones((50, ann.M))))) == 1


def test_equal_vectors_repeated_ids_and_other_lengths(spark):
    rows = [(n, [1.0, 1.0]) for n in range(40)] + [(50, [1.0, 0.9]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (60, [0.1, 1.0]), (70, [1.0, 2.0, 3.0]), (71, [1.0, 2.0, 2.9])]
    table = spark.createDataFrame(rows, "vec_id long, v array<float>")
    got = ann.nearest(table.where("vec_id in (0, 7, 50, 70)").withColumnRenamed("vec_id", "query_id"), table).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 7, 50, 70)}
    assert by[0] == [1, 2, 3, 4, 5] and by[7] == [0, 1, 2, 3, 4] and by[70] == [71]
    assert len(by[50]) == 5 and 50 not in by[50]


def test_unusable_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (0, [1.0, 0.1]), (7, [])], "vec_id long, v array<double>")
    got = ann.nearest(rows.where("vec_id in (0, 2, 3)").withColumnRenamed("vec_id", "query_id"), rows).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 1)}
    assert ann.nearest(rows.where("false").withColumnRenamed("vec_id", "query_id"), rows).count() == 0

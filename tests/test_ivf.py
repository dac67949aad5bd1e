import numpy as np
import pytest
from test_neighbours import brute, collected, questions, table

from lodestone.operators import ivf
from lodestone.operators import neighbours as nn


@pytest.fixture(scope="module")
def trained(spark):
    rows, df = table(spark, n=600)
    centroids = ivf.train_centroids(df, partitions=12, sample_rate=30, max_iterations=10, dimension=8)
    quantizer = ivf.Quantizer.fit(df, unit=True, dimension=8)
    placed = ivf.encode_vectors(ivf.assign_partitions(df, centroids), quantizer).cache()
    return rows, placed, centroids, quantizer


def recall(found, wanted):
    hits = sum(len({k for k, _ in found[q]} & {k for k, _ in wanted[q]}) for q in wanted)
    return hits / sum(len(v) for v in wanted.values())


def test_every_vector_has_its_closest_partition(trained):
    rows, placed, centroids, _ = trained
    assert quantity(centroids) <= 12
    for row in placed.collect():
        v = row.vector
        usable = v is not None and len(v) == 8 and None not in v and not np.isnan(v[0]) and any(v)
        if not usable:
            assert row.part is None and row.codes is None
            continue
        unit = np.array(v) / np.linalg.norm(v)
        gaps = ((centroids.matrix - unit) ** 2).sum(axis=1)
        assert gaps[row.part] == pytest.approx(gaps.min(), abs=1e-12)
        assert len(row.codes) == 8 and min(row.codes) >= 0 and max(row.codes) <= 255


def quantity(centroids):
    return len(centroids.matrix)


def test_all_probes_are_exact_and_recall_rises(spark, trained):
    rows, placed, centroids, _ = trained
    asked, queries = questions(spark)
    wanted = brute(rows, asked, 20, "cosine")
    found = [
        recall(collected(ivf.probed_nearest(placed, centroids, queries, 20, n)), wanted)
        for n in (1, 4, quantity(centroids))
    ]
    assert found[0] <= found[1] <= found[2] == 1.0
    everything = ivf.probed_nearest(placed, centroids, queries, 20, quantity(centroids))
    assert collected(everything) == wanted


def test_probed_search_of_many_queries(spark, trained):
    _, placed, centroids, _ = trained
    _, queries = questions(spark)
    few = collected(ivf.probed_nearest(placed, centroids, queries, 10, 3))
    many = collected(ivf.probed_nearest(placed, centroids, queries, 10, 3, max_query_bytes=2000))
    assert few == many


def test_refining_everything_is_exact(spark, trained):
    rows, placed, centroids, quantizer = trained
    asked, queries = questions(spark)
    wanted = brute(rows, asked, 10, "cosine")
    assert collected(ivf.refined_nearest(placed, quantizer, queries, 10, 100)) == wanted
    many = ivf.refined_nearest(placed, quantizer, queries, 10, 100, max_query_bytes=2000)
    assert collected(many) == wanted
    for metric in ("l2", "l2_squared"):
        found = ivf.refined_nearest(placed, quantizer, queries, 10, 100, metric=metric)
        near = {k for v in brute(rows, asked, 11, metric).values() for k, _ in v} - {601}
        assert {k for v in collected(found).values() for k, _ in v} <= near
    some = ivf.refined_nearest(placed, quantizer, queries, 10, 20, centroids=centroids, nprobes=12)
    assert recall(collected(some), wanted) > 0.9


def test_codes(spark):
    df = spark.createDataFrame(
        [(0, [0.0, 5.0]), (1, [10.0, 5.0]), (2, [2.5, 5.0])], "row_key long, vector array<float>"
    )
    quantizer = ivf.Quantizer.fit(df)
    codes = {r.row_key: r.codes for r in ivf.encode_vectors(df, quantizer).collect()}
    assert codes == {0: [0, 0], 1: [255, 0], 2: [63, 0]}
    assert np.allclose(quantizer.decode(np.array([[255, 0]])), [[10, 5]])
    later = spark.createDataFrame([(3, [99.0, -9.0])], "row_key long, vector array<float>")
    assert ivf.encode_vectors(later, quantizer).first().codes == [255, 0]


def test_small_sets_round_trip(spark, trained):
    _, _, centroids, quantizer = trained
    again = ivf.Centroids.from_frame(centroids.frame(spark), unit=True)
    assert np.array_equal(again.matrix, centroids.matrix)
    held = ivf.Quantizer.from_frame(quantizer.frame(spark))
    assert np.array_equal(held.low, quantizer.low) and np.array_equal(held.high, quantizer.high)


def test_nothing_to_index(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "row_key long, vector array<float>")
    with pytest.raises(ValueError):
        ivf.train_centroids(df)
    with pytest.raises(ValueError):
        ivf.Quantizer.fit(df, unit=True)


def test_result_bound(spark):
    _, queries = questions(spark)
    assert nn.few_results(queries, 30) and not nn.few_results(queries, nn.BROADCAST_ROWS)


def test_partition_numbers_may_have_gaps(spark):
    centres = spark.createDataFrame([(5, [0.0, 1.0]), (0, [1.0, 0.0])], "part int, centroid array<double>")
    centroids = ivf.Centroids.from_frame(centres)
    df = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0])], "row_key long, vector array<float>")
    placed = ivf.assign_partitions(df, centroids)
    assert {r.row_key: r.part for r in placed.collect()} == {1: 0, 2: 5}
    asked = spark.createDataFrame([("q", [0.0, 3.0])], "query_id string, vector array<double>")
    assert collected(ivf.probed_nearest(placed, centroids, asked, 5, 1)) == {"q": [(2, 1)]}
    assert sorted(r.part for r in centroids.frame(spark).collect()) == [0, 5]


def test_places_and_codes_in_one_step(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(50)]
    rows += [(50, None), (51, [0.0] * 4), (52, [1.0, 2.0]), (53, [1.0, None, 2.0, 3.0]), (54, [1.0, float("nan"), 2.0, 3.0])]
    df = spark.createDataFrame(rows, "i int, vector array<float>")
    quantizer = ivf.Quantizer.fit(df, unit=True, dimension=4)
    whole = np.array([np.float32(v) for i, v in rows if i < 50])
    assert (quantizer.low == whole.min(0)).all() and (quantizer.high == whole.max(0)).all() and quantizer.rows == 50
    centroids = ivf.Centroids(np.eye(4), True)
    made = ivf.place_and_encode(df, centroids, quantizer)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    steps = ivf.encode_vectors(ivf.assign_partitions(df, centroids), quantizer)
    assert sorted(made.collect(), key=lambda r: r.i)[:54] == sorted(steps.collect(), key=lambda r: r.i)[:54]
    with pytest.raises(ValueError):
        ivf.place_and_encode(df, ivf.Centroids(np.eye(4)), quantizer)


def test_ranges_of_several_widths_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "vector array<float>")
    with pytest.raises(Exception, match="several widths"):
        ivf.Quantizer.fit(df)

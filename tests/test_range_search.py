"""The search for a row's range is one small expression, however many ranges there are."""

from retensa.functions.ordering import range_id


def test_range_search_does_not_grow_with_its_bounds(spark):
    order = ["a", "id"]

    def size(n):
        bounds = [(i / 7.0, i) for i in range(n)]
        return str(range_id(spark.createDataFrame([(1.0, 1)], "a double, id long"), bounds, order)).count("WHEN")

    assert size(200) == size(20) < 20

import pytest

from quarry.operators.query import Agg, Filter, Order, aggregate, distinct_values, predicate, select_rows, where


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "Ann", 5.0, True), (2, "bob", None, False), (3, None, 7.5, True), (4, "Bo%b", -1.0, None)]
    return spark.createDataFrame(data, "id INT, name STRING, score DOUBLE, ok BOOLEAN")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "entry, want",
    [
        ({"column": "id", "value": 2}, [2]),
        ({"column": "id", "op": "==", "value": 2}, [2]),
        ({"column": "id", "op": "<>", "value": 2}, [1, 3, 4]),
        ({"column": "score", "op": ">=", "value": 5}, [1, 3]),
        ({"column": "score", "op": "=", "value": None}, []),
        ({"column": "score", "op": "!=", "value": None}, []),
        ({"column": "name", "op": "LIKE", "value": None}, []),
        ({"column": "id", "op": "in", "value": [1, 3, 9]}, [1, 3]),
        ({"column": "id", "op": "NOTIN", "values": [1, 3]}, [2, 4]),
        ({"column": "id", "op": "NOT IN", "value": [1, None]}, []),
        ({"column": "name", "op": "LIKE", "value": "B%"}, [4]),
        ({"column": "name", "op": "ILIKE", "value": "B%"}, [2, 4]),
        ({"column": "name", "op": "NOT LIKE", "value": "%b"}, [1]),
        ({"column": "name", "op": "=~", "value": "n+"}, [1]),
        ({"column": "name", "op": "NOT MATCH", "value": "n+"}, [2, 4]),
        ({"column": "id", "op": "=", "value": True}, [1]),
        (Filter("id", ">", 3), [4]),
    ],
)
def test_filters(people, entry, want):
    assert ids(where(people, [entry])) == want


@pytest.mark.parametrize(
    "entry",
    [
        {"column": "id", "op": "BETWEEN", "value": 1},
        {"column": "id", "op": "IN", "value": []},
        {"column": "id", "op": "IN", "value": 3},
        {"column": "nope", "value": 1},
        {"column": "id; drop", "value": 1},
        {"column": "id", "value": {"a": 1}},
        {"op": "=", "value": 1},
        {"column": "id", "bogus": 1},
        "id = 1",
    ],
)
def test_bad_filters_are_rejected(people, entry):
    with pytest.raises(ValueError):
        predicate(people, entry)


@pytest.mark.parametrize("limit, want", [(5, 5), ("7", 7), (0, 1500), (-3, 1500), (None, 1500), ("x", 1500), (5000, 1500), (2.9, 2)])
def test_only_a_given_limit_cuts(spark, limit, want):
    numbers = spark.range(1500).toDF("id")
    assert select_rows(numbers, limit=limit).count() == want
    assert distinct_values(numbers, "id", limit=limit).count() == want
    assert aggregate(numbers, [{"func": "count", "alias": "n"}], group_by=["id"], limit=limit).count() == want


def test_boolean_literals_fit_the_column(spark):
    df = spark.createDataFrame([(True, 1), (False, 0), (None, 5)], "flag BOOLEAN, n INT")
    assert where(df, [{"column": "flag", "value": True}]).count() == 1
    assert where(df, [{"column": "flag", "op": "IN", "value": [True, False]}]).count() == 2
    assert where(df, [{"column": "n", "value": True}]).count() == 1


def test_order_puts_nulls_last_both_ways(people):
    up = select_rows(people, ["id"], order_by=[{"column": "score"}])
    down = select_rows(people, ["id"], order_by=[Order("score", "desc")])
    assert [r.id for r in up.collect()] == [4, 1, 3, 2]
    assert [r.id for r in down.collect()] == [3, 1, 4, 2]
    with pytest.raises(ValueError):
        select_rows(people, order_by=[{"column": "score", "dir": "sideways"}])


def test_select_keeps_all_columns_by_default(people):
    assert select_rows(people).columns == people.columns
    with pytest.raises(ValueError):
        select_rows(people, ["id", "nope"])


def test_aggregate_names_and_nulls(people):
    got = aggregate(people, [{"func": "COUNT"}, {"func": "count", "column": "name"}, Agg("avg", "score", "mean")])
    assert got.columns == ["count(*)", "count(name)", "mean"]
    assert tuple(got.first()) == (4, 3, pytest.approx(11.5 / 3))
    empty = aggregate(people, [Agg("sum", "score", "s"), Agg("count", alias="n")], filters=[Filter("id", ">", 99)])
    assert tuple(empty.first()) == (None, 0)


@pytest.mark.parametrize(
    "aggregations",
    [[], [{"func": "median", "column": "id"}], [{"func": "sum"}], [{"func": "sum", "column": "id", "alias": "a b"}], ["x"]],
)
def test_bad_aggregations_are_rejected(people, aggregations):
    with pytest.raises(ValueError):
        aggregate(people, aggregations)


def test_distinct_values(people):
    assert [r.value for r in distinct_values(people, "ok").collect()] == [False, True, None]
    assert [r.value for r in distinct_values(people, "id", [Filter("id", "<", 4)], limit=2).collect()] == [1, 2]

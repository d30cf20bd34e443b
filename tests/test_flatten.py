"""Names in JSON that hold dots are names, not paths."""

from quarry.operators import structure


def test_dotted_names_are_leaves_of_their_own(spark):
    df = spark.createDataFrame([(1, '{"a.b":1,"c":{"d.e":2,"f":[1]}}'), (2, '{"a.b":5}'), (3, None), (4, "no json")], "id long, j string")
    got = structure.flatten_json(df, "j", ["id"])
    assert got.columns == ["id", "a.b", "c.d.e", "c.f"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, [1]), (2, 5, None, None), (3, None, None, None), (4, None, None, None)]

"""Connected components on chains, stars, cycles and single edges."""

from railside.llm.graph import components


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = [*chain, (7, 3), (3, 9), (9, 7), (1, 50), (50, 60), (60, 1), (5, 5), (500, 499), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3, 1: 1, 50: 1, 60: 1, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

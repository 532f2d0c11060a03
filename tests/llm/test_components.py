"""Steps of the connected components stay small on the driver."""

from tickloom.llm import components


def watched(monkeypatch):
    """Joins in the plan, and bits of the guessed size, of each table that a step writes."""
    seen = []
    for name in ("cut", "store"):

        def noted(df, real=getattr(components, name, None)):
            plan = df._jdf.queryExecution().optimizedPlan()
            seen.append(plan.toString().count("Join "))
            out = real(df)
            assert int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 100
            return out

        monkeypatch.setattr(components, name, noted, raising=False)
    return seen


def test_a_step_has_few_joins(spark, monkeypatch):
    seen = watched(monkeypatch)
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 2000)]  # many rounds; a hub
    out = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in out} == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(2000)}}
    assert len(out) == 2101 and len(seen) > 20
    assert max(seen) <= 3


def test_no_edges_no_steps(spark, monkeypatch):
    seen = watched(monkeypatch)
    assert components.components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).collect() == []
    assert len(seen) == 1

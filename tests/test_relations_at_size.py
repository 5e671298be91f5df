"""Relations: whole results by less work, and tasks whose rows do not grow with the table."""

from __future__ import annotations

import random

import pytest

from verbatlas.operators import dealing, graph
from verbatlas.sources import tables

EDGE = "source long, target long, type string"


def by_hand(edges, roots, fan_out):
    near = {}
    for a, b, _ in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for root in roots:
        met = {root} | near.get(root, set())
        for parent in sorted(near.get(root, ())):
            fresh = sorted(near[parent] - met)
            out += [(root, parent, child) for child in fresh[:fan_out]]
            met |= near[parent]
    return sorted(out)


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that is kept, by name."""
    rows, kept = {}, tables.kept

    def counted(df, name):
        out = kept(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(tables, "kept", counted)
    return rows


@pytest.mark.parametrize("look", [1, 3, 16])
def test_two_hops_in_rounds(spark, look):
    draw = random.Random(look)
    edges = [(draw.randrange(40), int(draw.paretovariate(0.5)) % 300, draw.choice("ab")) for _ in range(700)]
    edges += edges[:50] + [(7, 7, "a"), (None, 3, "a"), (3, None, "a")]
    roots = [*range(0, 300, 7), 5, 5, 999]
    df, of = spark.createDataFrame(edges, EDGE), spark.createDataFrame([(r,) for r in roots], "root long")
    got = sorted(tuple(r) for r in graph.two_hops(df, of, 4, look=look).collect())
    assert got == by_hand(edges, sorted(set(roots)), 4) and len(got) > 200


def test_two_hops_of_hubs(spark, written):
    """Three hubs of 2,000 nodes around 20 roots: 120,000 rows on the second level, of which few are met."""
    hubs = [(root, hub, "a") for root in range(10_000, 10_020) for hub in (1, 2, 3)]
    edges = hubs + [(hub, 100 + 3 * i + hub, "a") for hub in (1, 2, 3) for i in range(2_000)]
    roots = spark.createDataFrame([(r,) for r in range(10_000, 10_020)], "root long")
    got = sorted(tuple(r) for r in graph.two_hops(spark.createDataFrame(edges, EDGE), roots).collect())
    assert got == by_hand(edges, range(10_000, 10_020), 4) and len(got) == 240
    assert 240 <= sum(written["second"]) < 1_500


def test_two_hops_where_children_are_taken(spark, written):
    """All first children of the second hub belong to the first one: its own come in a later round, and no child is met twice."""
    edges = [(1, 2, "a"), (1, 3, "a")] + [(2, 10 + i, "a") for i in range(60)] + [(3, 10 + i, "a") for i in range(70)]
    got = graph.two_hops(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(1,)], "root long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, c) for c in range(10, 14)] + [(1, 3, c) for c in range(70, 74)]
    assert len(written["second"]) == 2 and sum(written["second"]) == 130


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS", 100)
    df = spark.range(2_000).selectExpr("id % 1900 AS a")
    dealt = dealing.dealt(df, 2_000, "a")
    assert dealt.rdd.getNumPartitions() == 20
    assert dealing.parts(spark, 0) == dealing.parts(spark, 399) == 4 and dealing.parts(spark, 401) == 5


def test_distinct_edges_are_dealt(spark, monkeypatch):
    """Remapped, normalized, changed and listed edges: tasks by rows, repeats gone, nothing hashed before the deal."""
    monkeypatch.setattr(dealing, "ROWS", 100)
    rows = [(i % 90, i % 7, "AR"[i % 2]) for i in range(1_000)]
    edges = spark.createDataFrame(rows, EDGE)
    merged = spark.createDataFrame([(i, i // 10 * 10) for i in range(90) if i % 10], "old long, new long")
    to = lambda x: x // 10 * 10
    cases = {
        "remapped": (graph.remapped(edges, merged), {(to(a), to(b), t) for a, b, t in rows if to(a) != to(b)}),
        "normalized": (graph.normalized(edges, ["A"]), {(min(a, b), max(a, b), t) if t == "A" else (a, b, t) for a, b, t in rows if a != b}),
        "distinct": (dealing.distinct(edges, 1_000), set(rows)),
    }
    for name, (df, want) in cases.items():
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want, name
        assert df.rdd.getNumPartitions() == 10, name
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        above, below = plan.split("Exchange hashpartitioning", 1)
        assert "HashAggregate" in above and "HashAggregate" not in below, name


def test_changes_with_nulls_and_repeats(spark):
    ids = lambda *x: spark.createDataFrame([(1, i) for i in x], "source long, target long")
    got = graph.changes(ids(2, 2, 3, None), ids(1, 1, 3, None), ["source", "target"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "add"), (1, 2, "remove")]

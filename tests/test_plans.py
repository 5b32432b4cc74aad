import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.plans import planner, workload
from siltstone.plans.cnf import Bounds, Condition, Query, any_of, between, check_roles, equals, normalize, one_of, parse_filters

ROLES = {"a": "equality", "x": "range", "y": "range"}
conditions = st.one_of(
    st.builds(Condition, st.just("a"), st.just("="), st.sampled_from("pqr")),
    st.builds(Condition, st.sampled_from("xy"), st.sampled_from(["=", "<", "<=", ">", ">="]), st.integers(0, 6)),
)
queries = st.builds(lambda c: Query(tuple(map(tuple, c))), st.lists(st.lists(conditions, max_size=3), max_size=4))
TEST = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
ROWS = [{"a": a, "x": x, "y": y} for a in "pqr" for x in range(-1, 8) for y in (0, 3, 6)]


def holds(q, row):
    return all(any(TEST[c.op](row[c.attr], c.value) for c in clause) for clause in q.clauses)


@settings(max_examples=200, deadline=None)
@given(queries)
def test_normalizing_keeps_the_rows(q):
    assert [r for r in ROWS if holds(q, r)] == [r for r in ROWS if holds(normalize(q), r)]


@settings(max_examples=200, deadline=None)
@given(queries)
def test_lookups_and_rest_are_the_query(q):
    plan = planner.plan_lookups(normalize(q), ROLES)
    again = plan.rest
    for x in plan.lookups:
        again &= one_of(x.attr, x.values) if x.bounds is None else x.bounds.query(x.attr)
    assert [r for r in ROWS if holds(q, r)] == [r for r in ROWS if holds(again, r)]


def test_edges():
    assert Query().sql() == "TRUE" and Query(((),)).sql() == "FALSE" and one_of("a", []).clauses == ((),)
    assert equals("a", "o'x").sql() == "(a = 'o''x')"
    assert normalize(between("x", 5, 9) & between("x", 7, 20)) == between("x", 7, 9)
    assert normalize(between("x", 5, 5)).clauses == ((),)
    assert Bounds(1, False, 1, False).query("x") == equals("x", 1)
    with pytest.raises(ValueError):
        Condition("a", "!=", 1)
    with pytest.raises(ValueError):
        check_roles(between("a", 1, 2), ROLES)


def test_filters_json():
    q = parse_filters('{"filters": [{"attr": "A", "op": "eq", "value": "p"}, {"attr": "x", "op": "range", "lo": 1, "hi": 2}], "hint": "X"}', ROLES)
    assert q == equals("a", "p") & between("x", 1, 2) and q.hint == "x"
    for bad in ('[{"attr": "z", "op": "eq", "value": 1}]', '[{"attr": "a", "op": "like", "value": 1}]'):
        with pytest.raises(ValueError):
            parse_filters(bad, ROLES)
    again = parse_filters(workload.filter_json(q), ROLES)
    assert set(again.clauses) == set(q.clauses)


def test_hint_comes_first_and_top_k_is_stable():
    q = Query((equals("a", "p") & between("x", 1, 2)).clauses, "x")
    assert [x.attr for x in planner.plan_lookups(q, ROLES).lookups] == ["x", "a"]
    assert planner.choose_top_k([5, 1, 5, 1], 2) == [1, 3] and planner.choose_top_k([2, 1], 0) == [1, 0]
    assert planner.plan_lookups(any_of(Condition("a", "=", "p"), Condition("x", "<", 3)), ROLES).lookups == ()


def test_paths_hints_and_dialect():
    assert planner.bind("force_bi", {"bitmap"}) is planner.AccessPath.BITMAP
    for f in (lambda: planner.bind("force_composite", {"index"}), lambda: planner.with_hint("SELECT 1", "INDEX_MERGE(t)"), lambda: planner.with_hint("VALUES (1)", "MERGE(t)"), lambda: planner.bind("other", set())):
        with pytest.raises(ValueError):
            f()
    assert planner.where_of("select a from t where x = 1 and y < 2 group by a") == "x = 1 and y < 2" and planner.where_of("SELECT 1") == "TRUE"
    assert planner.q_error(0, 5) is None and planner.q_error(2, 8) == 4


def test_generators():
    assert len(workload.sweep({"a": [1, 2], "b": [3, 4, 5], "c": 6})) == 6
    for bad in ({"phases": [{"type": "pause", "seconds": 1}]}, {"pk_mode": "uuid", "phases": []}, {"pk_mode": "uuid", "phases": [{"type": "pause"}]}, {"pk_mode": "uuid", "phases": [{"type": "read_only"}]}):
        with pytest.raises(ValueError):
            workload.check_config(bad)
    assert workload.per_attribute(1e-5, 4, 3) is None and abs(workload.per_attribute(0.01, 2) - 0.1) < 1e-12
    assert 1 <= workload.selectivity_draw(random.Random(1), 1, 10) <= 10

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from lumisift.plans import running
from lumisift.operators.cutoff import apply_cutoff, otsu_threshold, parse_cutoff, pool_threshold

FLOOR = 0.2


def plain_otsu(scores, floor):
    """The same rule as a loop over one list of scores."""
    kept = sorted(s for s in scores if s >= floor)
    if len(kept) < 3:
        return floor
    best, chosen = 0.0, kept[0]
    for cut in range(1, len(kept)):
        low, high = kept[:cut], kept[cut:]
        gap = sum(low) / len(low) - sum(high) / len(high)
        if len(low) * len(high) * gap * gap > best + 1e-12:
            best = len(low) * len(high) * gap * gap
            chosen = (kept[cut - 1] + kept[cut]) / 2
    return max(chosen, floor)


CASES = {
    "two": [0.3, 0.9],
    "none_over_floor": [0.1, 0.05, -0.4],
    "equal": [0.5] * 6,
    "clusters": [0.3, 0.31, 0.32, 0.8, 0.81, 0.82],
    "tie_between_splits": [0.3, 0.5, 0.7],
    "nan": [0.3, 0.32, 0.9, float("nan"), 0.92],
    "negative": [-0.9, -0.8, 0.3, 0.35, 0.9],
    "copies": [0.25] * 50 + [0.3] * 3 + [0.9] * 20,
}


def pool(spark, cases):
    rows = [(name, i, s) for name, scores in cases.items() for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id string, image_id long, score double")


@pytest.mark.parametrize("way", ["small", "large", "windows"])
def test_otsu_cases(spark, monkeypatch, way):
    if way == "large":
        monkeypatch.setattr(running, "ONE_TASK_BYTES", 0)
    df = pool(spark, CASES)
    if way == "windows":
        found = pool_threshold(df, "query_id", FLOOR).select("query_id", "threshold").distinct()
    else:
        found = otsu_threshold(df, ["query_id"], FLOOR)
    got = {r.query_id: r.threshold for r in found.collect()}
    assert set(got) == set(CASES)
    for name, scores in CASES.items():
        want = plain_otsu([s for s in scores if not math.isnan(s)], FLOOR)
        assert got[name] == pytest.approx(want), name


def test_otsu_of_nothing(spark):
    assert otsu_threshold(pool(spark, {"a": [0.5]}).limit(0), ["query_id"], FLOOR).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-40, 100).map(lambda n: n / 100), max_size=30), min_size=1, max_size=20))
def test_otsu_property(spark, lists):
    cases = {f"q{i}": scores for i, scores in enumerate(lists) if scores}
    if not cases:
        return
    df = pool(spark, cases)
    apart = {r.query_id: r.threshold for r in otsu_threshold(df, ["query_id"], FLOOR).collect()}
    windows = pool_threshold(df, "query_id", FLOOR).select("query_id", "threshold").distinct().collect()
    for row in windows:
        want = _splits(cases[row.query_id], FLOOR)
        assert any(row.threshold == pytest.approx(w) for w in want)
        assert any(apart[row.query_id] == pytest.approx(w) for w in want)


def _splits(scores, floor):
    """All splits that are best up to rounding error."""
    kept = sorted(s for s in scores if s >= floor)
    if len(kept) < 3:
        return [floor]
    worth = []
    for cut in range(1, len(kept)):
        low, high = kept[:cut], kept[cut:]
        gap = sum(low) / len(low) - sum(high) / len(high)
        worth.append((len(low) * len(high) * gap * gap, (kept[cut - 1] + kept[cut]) / 2))
    best = max(w for w, _ in worth)
    if best < 1e-12:
        return [max(kept[0], floor)]
    return [max(t, floor) for w, t in worth if w > best - 1e-9]


def test_modes_drop_nan_and_none_drops_negative(spark):
    df = pool(spark, {"a": [0.5, 0.0, -0.1, float("nan")]})
    assert sorted(r.score for r in apply_cutoff(df, "none", FLOOR).collect()) == [0.0, 0.5]
    assert sorted(r.score for r in apply_cutoff(df, -0.5, FLOOR).collect()) == [-0.1, 0.0, 0.5]
    assert [r.score for r in apply_cutoff(df, "auto", FLOOR).collect()] == [0.5]
    assert [r.score for r in apply_cutoff(df, "auto", FLOOR, pooled=True).collect()] == [0.5]


def test_parse_cutoff():
    assert parse_cutoff("auto") == "auto"
    assert parse_cutoff("none") == "none"
    assert parse_cutoff("0.25") == 0.25
    assert parse_cutoff(0.5) == 0.5
    with pytest.raises(ValueError, match="is no cutoff"):
        parse_cutoff("best")

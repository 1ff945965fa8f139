import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quotemill.operators.kernels import BasisKalman, Book, Ema, FusedKalman, Observation, water_fill


@pytest.mark.parametrize("w,cap,want", [([0.9, 0.07, 0.03], 0.75, [0.75, 0.175, 0.075]), ([0.8, 0.15, 0.05], 0.4, [0.4, 0.4, 0.2]), ([0.9, 0.1], 0.3, [0.9, 0.1])])
def test_water_fill_goldens(w, cap, want):
    assert water_fill(np.array(w), cap) == pytest.approx(want)


@given(st.lists(st.floats(1e-3, 1e3), min_size=1, max_size=8), st.floats(0.15, 1.0))
def test_water_fill_properties(w, cap):
    out = water_fill(np.array(w), cap)
    assert out.sum() == pytest.approx(1)
    if len(w) > 1 and cap * len(w) >= 1:
        assert out.max() <= cap + 1e-9
        order = np.argsort(w)
        assert (np.diff(out[order]) >= -1e-9).all()


def test_fused_kalman_process_variance_golden():
    k = FusedKalman(q_base=0.0, move_alpha=1.0)
    assert k.step(0.0, [Observation("a", 100.0, 1.0)])["gain"] == 1.0
    assert k.step(1.0, [Observation("a", 110.0, 1.0)])["q"] == pytest.approx(100.0)


def test_fused_kalman_gates():
    k = FusedKalman()
    assert k.step(0.0, [Observation("a", math.nan, 1.0), Observation("b", 1.0, 1.0, age_ms=1e6), Observation("c", 1.0, 1.0, valid=False)]) is None


def test_basis_filter_finds_common_price_and_basis():
    k = BasisKalman(anchor="a")
    for i in range(200):
        out = k.step(i * 0.1, [Observation("a", 100.0, 0.05), Observation("b", 105.0, 0.05)])
    assert out["price"] == pytest.approx(100, abs=0.75)
    assert out["basis"]["b"] == pytest.approx(5, abs=0.75)
    assert out["basis"]["a"] == 0.0


def test_basis_filter_layout_and_anchor():
    k = BasisKalman(anchor="a", order=("k", "a"))
    assert k.step(0.0, [Observation("k", 1.0, 1.0)]) is None  # no state without the anchor
    k.step(0.0, [Observation("a", 1.0, 1.0), Observation("z", 1.0, 1.0), Observation("p_perp", 1.0, 1.0, perp=True)])
    assert k.index == {"k": 1, "z": 2, "p_perp": 3}
    before = k.P.copy()
    k.step(1.0, [Observation("k", 1.0, 1.0), Observation("y", 2.0, 1.0)])  # the anchor is needed only to begin
    assert k.index == {"k": 1, "y": 2, "z": 3, "p_perp": 4} and before.shape == (4, 4)
    assert np.allclose(k.P, k.P.T) and (np.diag(k.P) > 0).all()


def test_ema():
    e = Ema(0.5)
    assert [e.step(x) for x in (10.0, 20.0, 20.0)] == [10.0, 15.0, 17.5]
    with pytest.raises(ValueError):
        Ema(0.0)


def test_book_snapshot_delta_and_gap():
    b = Book(sequenced=True)
    assert b.step("delta", [("buy", 1.0, 1.0)], 5) == "dropped"
    assert b.step("snapshot", [("buy", 100.0, 2.0), ("buy", 99.0, 1.0), ("sell", 101.0, 3.0), ("sell", 102.0, 4.0)], 10) == "ok"
    assert b.step("delta", [("buy", 100.0, 0.0), ("buy", 100.5, 5.0), ("sell", 101.0, 1.5)], 11) == "ok"
    assert b.best() == (100.5, 5.0, 101.0, 1.5)
    assert b.step("delta", [], 13) == "resync" and b.step("delta", [], 14) == "dropped"


def test_book_checksum_and_depth():
    b = Book(depth=2, checked=True)
    levels = [("buy", 99.0, 1.0, "99.00", "1.00"), ("buy", 98.0, 1.0, "98.00", "1.00"), ("buy", 97.0, 1.0, "97.00", "1.00"), ("sell", 101.0, 2.0, "101.00", "2.00000000")]
    b.step("snapshot", levels)
    good = b.checksum()
    assert len(b.sides["buy"]) == 2
    assert b.step("delta", [], checksum=good) == "ok"
    assert b.step("delta", [], checksum=good + 1) == "resync"

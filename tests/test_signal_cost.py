"""What a recording costs: filters are made once for recordings of a length, and medians are those of NumPy."""

import numpy as np

from sigloom.signal import filters, peaks


def test_filter_is_made_once(monkeypatch):
    made, make = [], filters.power_response
    monkeypatch.setattr(filters, "power_response", lambda *a: (made.append(1), make(*a))[1])
    x = np.random.default_rng(1).normal(size=(3, 2000))
    got = [filters.bandpass(row, 97.0, 5.0, 15.0) for row in x]
    assert len(made) == 1 and all(len(y) == 2000 for y in got)
    assert np.array_equal(got[1], filters.bandpass(x[1], 97.0, 5.0, 15.0))


def test_median():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 118, 119):
        x = rng.normal(size=n)
        assert peaks._median(x) == np.median(x)
    assert np.isnan(peaks._median(np.array([1.0, np.nan])))

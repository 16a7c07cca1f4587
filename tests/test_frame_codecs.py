"""Fixed vectors of codecs, padding and metrics, and round trips."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesmith.operators import frame_codecs as C

A = np.array([1, 1, 1, 1, 2, 3, 5, 1, 2, 7, 1, 1, 1, 3, 1, 1, 5.0])
B = np.array([1, 1, 1, 1, 2, 1, 1, 1, 3, 1, 1, 5.0])
RAMP = np.arange(1, 13.0)


def decoded(x, codec, points=None):
    payload, _ = C.keyed_encode(x, codec, points=points)
    return C.decode(payload, codec, len(x))


def test_noop():
    assert list(C.noop_encode(np.ones(5))) == [250, 5, 2, 2, 2, 2, 2]
    assert list(C.noop_decode(C.noop_encode(np.array([1.5, 2.7, 3.3, 4.9])), 4)) == [2, 3, 3, 5]
    assert list(C.noop_decode(C.noop_encode(np.array([-2.5])), 1)) == [-3]


def test_constant():
    assert list(C.constant_encode(np.ones(5))) == [30, 3, 1]
    assert list(C.constant_encode(np.full(5, 1.23456))) == [30, 0, 56, 50, 143, 252, 193, 192, 243, 63]
    assert list(C.decode(C.constant_encode(np.array([4.0, 2.0])), "constant", 2)) == [2, 2]


def test_rle_starts():
    assert list(C.rle_encode(np.ones(512))) == [60, 3, 1, 1, 1, 0]
    five = np.repeat([1, 2, 3, 4, 5.0], [1, 2, 3, 4, 5])
    assert list(C.rle_encode(five)) == [60, 3, 5, 1, 1, 0, 2, 1, 1, 3, 1, 3, 4, 1, 6, 5, 1, 10]
    repeats = np.repeat([1, 2, 1, 2, 3, 1.0], [4, 2, 4, 2, 6, 9])
    assert list(C.rle_encode(repeats)) == [60, 3, 3, 1, 3, 0, 6, 18, 2, 2, 4, 10, 3, 1, 12]


def test_polynomial_bytes():
    x = np.array([1, 0, 1, 1, 2, 1, 1, 1, 3, 1, 1, 5.0])
    assert list(C.keyed_encode(x, "polynomial")[0]) == [0, 3, 4, 1, 2, 3, 5, *[0] * 8, 0, 0, 0, 0, 0, 0, 20, 64, 4]
    x[-1] = 500
    assert list(C.keyed_encode(x, "polynomial")[0])[:9] == [0, 2, 4, 2, 4, 6, 251, 232, 3]


@pytest.mark.parametrize(
    ("x", "codec", "expected"),
    [
        (A, "polynomial", [1, 1.4, 1.8, 2.2, 2.6, 3, 2.824, 2.392, 1.848, 1.336, 1, 1, 1, 1, 1, 1, 5]),
        (A, "idw", [1, 1.13167, 1.62573, 2.32782, 2.83429, 3, 2.8335, 2.34163, 1.68979, 1.184, 1, 1.18933, 1.64488, 1.9634, 1.77047, 1, 5]),
        (RAMP, "polynomial", list(RAMP)),
        (RAMP, "idw", [1, 1.62873, 3.51429, 4.84995, 5, 5.40622, 7.05871, 8.64807, 9, 9.37719, 11.18119, 12]),
    ],
)
def test_interpolation(x, codec, expected):
    np.testing.assert_allclose(decoded(x, codec), expected, atol=1e-9)


@pytest.mark.parametrize("n", [6000, 6001])
@pytest.mark.parametrize("step", [2, 3, 60, 100])
def test_convolved_inverse_distance_is_the_sum_over_keys(n, step):
    """Small and wide numbers, whole ones far from zero and an outlier, with the last key on the grid of steps and off it."""
    rng = np.random.default_rng(step)
    at = C.key_positions(n, step)
    for x in (rng.integers(1, 51, n), rng.normal(0, 1e5, n), 1e9 + rng.integers(0, 9, n), np.where(np.arange(n) == n // 2 // step * step, 1e12, np.arange(n) % 7), rng.normal(0, 1e300, n)):
        v = x[at].astype(float)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            w = 1 / (np.arange(n)[:, None] - at) ** 2.0
            direct = (w * v).sum(axis=1) / w.sum(axis=1)
            direct[at] = v
            np.testing.assert_array_equal(C.round_half_away(C.inverse_distance(at, v, n)), C.round_half_away(direct))


def test_whole_frame_of_inverse_distance_takes_seconds():
    x = np.random.default_rng(0).integers(1, 51, 131072).astype(float)
    began = time.process_time()
    payload, error = C.keyed_encode(x, "idw", 0.03)
    assert time.process_time() - began < 20
    assert error == 0 and np.array_equal(C.decode(payload, "idw", len(x)), x)


def test_fourier():
    payload, _ = C.fft_encode(B)
    np.testing.assert_allclose(C.fft_decode(payload, 12), [1, 1.87201, 2.25, 1, 1.82735, 1.689, 1.82735, 1, 2.75, 1.189, 1, 3.311], atol=2e-5)
    payload, _ = C.fft_encode(B, points=12)
    np.testing.assert_allclose(C.fft_decode(payload, 12), B, atol=2e-5)
    spectrum = np.fft.rfft(B)
    assert list(C.strongest(spectrum, 2)) == [0, 4]
    assert spectrum[0].real == pytest.approx(19)
    assert spectrum[4] == pytest.approx(-3.5 + 4.33013j, abs=1e-4)
    assert list(C.strongest(spectrum, 1)) == [0]


def test_padding():
    assert [C.padded_size(n) for n in (2048, 512, 256, 128, 12432, 127)] == [2187, 576, 288, 144, 13122, 127]
    y = C.pad(np.arange(2048.0))
    assert len(y) == 2187 and (y[:70] == 0).all() and (y[-70:] == 2047).all()


def test_bounded_fit_keeps_to_the_bound():
    x = 100 + 10 * np.sin(np.arange(1024) / 40)
    for codec in ("polynomial", "fft"):
        payload, error = C.encode(x, codec, 0.01)
        assert error <= 0.011
        assert C.mape(x, C.decode(payload, codec, len(x))) <= 0.011
        assert len(payload) < 8 * len(x) / 4
    rng = np.random.default_rng(0)
    noise = rng.uniform(1, 9, 600)
    payload, error = C.encode(noise, "polynomial", 0.001)
    assert error == 0 and np.abs(C.decode(payload, "polynomial", 600) - noise).max() <= 1e-5


def test_zeros_end_the_ladders():
    x = np.array([0.0, 1, 0, 2] * 100)

    codec, payload, error = C.choose(x, 0.05)
    assert codec == "rle" and error == 0
    np.testing.assert_array_equal(C.decode(payload, codec, len(x)), x)


def test_choice():
    assert C.choose(np.full(10, 7.0), 0.03)[0] == "constant"
    ramp = np.arange(1, 2001.0)
    codec, payload, error = C.choose(ramp, 0.03)
    assert error <= 0.03 and len(payload) < 2000
    assert C.choose(ramp, 0.03, sample=128)[0] in C.AUTO
    assert C.choose(np.array([3.0]), 0.03)[0] == "constant"


def test_choice_keeps_the_frame_itself_within_the_bound():
    """Not only the padded frame of a Fourier series, and no polynomial whose rounding loses small numbers."""
    rng, chosen = np.random.default_rng(1), set()
    frames = [np.round(100 + rng.uniform(1, 60) * np.sin(np.arange(512) * rng.uniform(0.2, 2)) + rng.normal(0, rng.uniform(0, 14), 512), 2) + 1000 * (k % 2) for k in range(120)]
    for x in (*frames, np.tile([1e-7, 2e-7, 5e-7, 3e-7], 200) + np.arange(800) * 1e-9):
        codec, payload, error = C.choose(x, 0.03)
        chosen.add(codec)
        assert error <= 0.03 and C.mape(x, C.decode(payload, codec, len(x))) <= 0.03
    assert "fft" in chosen


def test_ladder():
    counts = list(C.rungs(C.default_points(131072), 131072 // 10, 131072 // 100))
    steps = list(dict.fromkeys(131072 // c for c in counts))
    assert len(counts) == 23 and steps[:4] == [100, 9, 4, 3]
    fourier = list(C.rungs(1310, 1310 // 2, 1310 // 10))
    assert fourier[0] == 1310 and fourier[-1] == 13100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(-(2**40), 2**40).map(float), st.floats(-1e9, 1e9), st.sampled_from([0.0, -0.0, 1.0])), min_size=1, max_size=300))
def test_round_trips(values):
    x = np.array(values)
    np.testing.assert_array_equal(C.decode(C.rle_encode(x), "rle", len(x)), x)
    for codec in ("fft", "polynomial", "idw"):
        y = C.decode(C.encode(x, codec, 0.05)[0], codec, len(x))
        assert len(y) == len(x) and np.isfinite(y).all()


@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_numbers(values):
    r = C.Reader(C.put_unsigned(np.array(values, np.uint64)))
    assert [r.unsigned() for _ in values] == values
    signed = [v - 2**62 for v in values]
    r = C.Reader(C.put_signed(np.array(signed, np.int64)))
    assert r.signed(len(signed)).tolist() == signed


def test_cut_bytes_are_an_error():
    with pytest.raises(ValueError):
        C.decode(C.rle_encode(np.arange(9.0))[:-1], "rle", 9)
    assert math.isnan(C.mape(np.array([0.0]), np.array([0.0])))

"""Resampling, windows, colours and perturbation against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import pixels as X


def one(spark, x, f, **columns):
    df = spark.createDataFrame([(1, [float(v) for v in np.asarray(x).ravel()])], "id long, a array<double>").withColumns({k: F.lit(v) for k, v in columns.items()})
    return df.select(f(F.col("a")).alias("v")).first()["v"]


def weights(size, new, how):
    m = np.zeros((new, size))
    for o, (lo, w) in enumerate(X.taps(size, new, how)):
        m[o, lo : lo + len(w)] = w
    return m


@pytest.mark.parametrize("how", ["bilinear", "area"])
@pytest.mark.parametrize("shape", [(3, 4, 5, 2, 1), (6, 6, 3, 3, 3), (2, 2, 7, 5, 1), (1, 5, 3, 3, 3), (4, 1, 1, 1, 1)])
def test_resize(spark, how, shape):
    h, w, nw, nh, c = shape
    x = np.random.default_rng(1).random((h, w, c))
    want = np.einsum("oh,pw,hwc->opc", weights(h, nh, how), weights(w, nw, how), x)
    assert np.allclose(one(spark, x, lambda a: X.resize(a, w, h, nw, nh, how, c)), want.ravel())
    by_row = one(spark, x, lambda a: X.resize(a, F.col("w"), F.col("h"), F.col("nw"), F.col("nh"), how, c), w=w, h=h, nw=nw, nh=nh)
    assert np.allclose(by_row, want.ravel())


def test_taps():
    for how in ("bilinear", "area"):
        for size in range(1, 9):
            for new in range(1, 9):
                m = weights(size, new, how)
                assert np.allclose(m.sum(axis=1), 1) and (m >= -1e-12).all()
    assert np.allclose(weights(4, 2, "area"), [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]]) and np.allclose(weights(3, 3, "bilinear"), np.eye(3))
    with pytest.raises(ValueError):
        X.taps(2, 2, "cubic")


def test_window(spark):
    x = [-100, 0, 39.5, 40, 40.5, 50, 90, 1000]
    c, w = 40.0, 80.0
    want = [0 if v <= c - 0.5 - (w - 1) / 2 else 255 if v > c - 0.5 + (w - 1) / 2 else ((v - (c - 0.5)) / (w - 1) + 0.5) * 255 for v in x]
    assert np.allclose(one(spark, x, lambda a: X.window(a, F.lit(c), F.lit(w))), want)
    assert one(spark, [39.0, 40.0], lambda a: X.window(a, F.lit(40.0), F.lit(1.0))) == [0.0, 255.0]
    assert one(spark, [3, 4], lambda a: X.window(a, F.lit(None).cast("double"), F.lit(5.0))) == [3.0, 4.0]


def test_colours(spark):
    for name in ("turbo", "jet", "gray"):
        table = np.array(X.colour_table(name)).reshape(256, 3)
        assert table.min() >= 0 and table.max() <= 255 and len(table) == 256
    jet = np.array(X.colour_table("jet")).reshape(256, 3)
    assert jet[0].tolist()[:2] == [0, 0] and jet[255].tolist()[1:] == [0, 0] and jet[128].tolist()[1] == 255
    heat, image = np.array([[0.0, 1.0], [0.5, 0.25]]), np.arange(16.0).reshape(4, 4)
    table = np.array(X.colour_table()).reshape(256, 3)[np.floor(heat * 255).astype(int)].astype(float)
    table = (table - table.min()) / (table.max() - table.min()) * 255
    large = np.einsum("oh,pw,hwc->opc", weights(2, 4, "bilinear"), weights(2, 4, "bilinear"), table)
    want = large * 0.4 + image[:, :, None]
    got = one(spark, image, lambda a: X.colour_overlay(a, F.array(*[F.lit(float(v)) for v in heat.ravel()]), (4, 4), (2, 2), channels=1))
    assert np.allclose(got, (want / want.max()).ravel())


def test_hue_and_saturation_keep_brightness():
    for angle, length in ((0.3, 1.2), (-1.0, 0.5), (0.0, 1.0)):
        m = np.array([[eval(x) for x in row] for row in X.turned(repr(math.cos(angle) * length), repr(math.sin(angle) * length))])
        assert np.allclose(X.TO_YIQ[0] @ m, X.TO_YIQ[0])
        yiq = X.TO_YIQ @ m @ X.FROM_YIQ
        assert np.allclose(yiq[1:, 1:], length * np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]]), atol=1e-9)
    assert np.allclose([[eval(x) for x in row] for row in X.turned("1.0", "0.0")], np.eye(3))


def test_perturbation_is_the_same_however_rows_are_dealt(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 256, 2 * 3 * 3).tolist()) for i in range(20)] + [(99, None), (98, [1, 2])]
    df = spark.createDataFrame(rows, "id long, a array<int>")
    run = lambda d: {r["id"]: r["v"] for r in d.select("id", X.perturb("a", 3, 2, "id", seed=4).alias("v")).collect()}
    got = run(df.repartition(1))
    assert got == run(df.repartition(7, "id")) and got[99] is None and got[98] is None
    assert all(len(v) == 18 and 0 <= min(v) and max(v) <= 255 for k, v in got.items() if k < 50) and len({str(v) for v in got.values()}) >= 20
    same = df.where("id < 20").select("id", "a", X.perturb("a", 3, 2, "id", (1.0, 1.0), 0.0, (1.0, 1.0), 0.0, False).alias("v")).collect()
    assert all(np.allclose(r["a"], r["v"]) for r in same)


@pytest.mark.parametrize("size", [(2, 2), (5, 4), (4, 2), (3, 3), (1, 6)])
def test_crop_or_pad(spark, size):
    nw, nh = size
    x = np.arange(1, 13).reshape(3, 4)  # height 3, width 4
    want = np.zeros((nh, nw))
    off = lambda new, old: (new - old) // 2 if new >= old else -((old - new) // 2)
    for r in range(nh):
        for q in range(nw):
            i, j = r - off(nh, 3), q - off(nw, 4)
            if 0 <= i < 3 and 0 <= j < 4:
                want[r, q] = x[i, j]
    got = one(spark, x, lambda a: X.crop_or_pad(a, 4, 3, F.col("w"), F.col("h")), w=nw, h=nh)
    assert np.allclose(got, want.ravel())


def test_development_of_an_image():
    from cohortlens.operators import conversion

    row = dict.fromkeys(conversion.FIELDS) | {"rows": 4, "columns": 5, "photometric": "MONOCHROME2"}
    x = np.zeros((4, 5))
    x[1:3, 1:4] = [[10, 20, 40], [5, 0, 30]]
    got = conversion.develop(x.ravel(), row, None, False, True)
    assert got.tolist() == [[63, 127, 255], [31, 0, 191]]
    assert conversion.develop(x.ravel(), row | {"photometric": "MONOCHROME1"}, None, False, True).tolist() == [[192, 128, 0], [224, 255, 64]]
    assert conversion.develop(np.zeros(20), row, 8, False, True) is None
    assert conversion.develop(x.ravel(), row, 6, False, True).shape == (4, 6)
    flat = conversion.develop(np.full(20, 7), row, None, False, True)
    assert flat.shape == (4, 5) and (flat == 255).all()
    scaled = conversion.develop(x.ravel(), row | {"slope": 2.0, "intercept": -20.0}, None, True, True)
    assert scaled.tolist() == [[85, 255], [0, 170]]
    windowed = conversion.develop(x.ravel(), row | {"window_center": 20.5, "window_width": 21.0}, None, False, True)
    assert windowed.tolist() == [[127, 255], [0, 255]]
    colours = np.stack([x, x, x], axis=2).ravel()
    assert np.allclose(conversion.develop(colours, row | {"samples_per_pixel": 3}, None, False, True), got, atol=1)

import numpy as np
import pytest

from trailmark.functions import image as I
from trailmark.plans.device_queries import jpeg
from trailmark.sources.photos import exif_date, parse_date, read_photos


def test_exif_dates():
    text = b"2026:11:02 08:12:33"
    for little in (True, False):
        assert exif_date(jpeg(text, little)) == 1793607153000
    assert exif_date(jpeg(b"0000:00:00 00:00:00", True)) is None
    assert exif_date(b"\xff\xd8") is None and exif_date(b"") is None and exif_date(None) is None and exif_date(b"GIF89a") is None
    assert exif_date(jpeg(text, True)[:60]) is None
    assert parse_date("2026:02:31 00:00:00") == parse_date("2026:03:03 00:00:00") and parse_date("2026:13:01 00:00:00") is None


def test_photo_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(b"2026:11:02 08:12:33", True))
    (tmp_path / "b.jpg").write_bytes(b"no photo")
    rows = {r.name: r for r in read_photos(spark, str(tmp_path)).collect()}
    assert rows["a.jpg"].src == "exif" and rows["a.jpg"].t == 1793607153000 and rows["b.jpg"].src == "file" and rows["b.jpg"].st == "wait"


def screen():
    y, x = np.mgrid[0:220, 0:300]
    u, v = x - 150, y - 110
    page = (np.abs(u) < 115) & (np.abs(v) < 85)
    bars = page & (np.abs(v) < 70) & (v // 9 % 2 == 0) & (u // 7 % 4 != 3) & (np.abs(u) < 100)
    return I.box_blur(np.where(bars, 60.0, np.where(page, 210.0, 30.0)), 1).astype(np.uint8)


@pytest.mark.parametrize("deg", [-9, -3, 0, 2, 8])
def test_skew_and_frame_follow_the_rotation(deg):
    g = I.rotate(screen(), deg)
    angle, gain = I.skew_angle(g)
    assert abs(angle - deg) <= 0.3 and gain > 1.5
    found = I.find_quad(g)
    assert found and abs(found["tilt"] - abs(deg)) <= 1


def test_homography_and_its_inverse():
    h = I.homography([(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 2), (12, 1), (11, 13), (0, 9)])
    assert np.allclose(I.project(h, [0, 10], [0, 10]), [[1, 11], [2, 13]])
    assert np.allclose(I.project(I.inverse(h), *I.project(h, 3, 4)), [3, 4])
    assert I.homography([(0, 0)] * 4, [(1, 1)] * 4) is None


def test_box_blur_is_a_mean_with_repeated_edges():
    x = np.random.default_rng(2).integers(0, 256, (9, 7)).astype(float)
    r = 2
    padded = np.pad(x, r, mode="edge")
    want = np.array([[padded[i : i + 5, j : j + 5].mean() for j in range(7)] for i in range(9)])
    assert np.allclose(I.box_blur(x, r), want)


def test_contrast_and_threshold():
    g = np.where(np.arange(100) < 50, 40, 200).astype(np.uint8).reshape(10, 10)
    assert I.stretch_bounds(g) == (40, 200) and 40 <= I.otsu(g) < 200
    assert set(np.unique(I.stretch(g, 40, 200))) == {0, 255}
    assert np.array_equal(I.unsharp(g, 0, 2), g)
    assert I.screen_box(screen()) is not None and I.screen_box(np.full((20, 20), 7, np.uint8)) is None

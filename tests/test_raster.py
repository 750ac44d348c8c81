import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import bilevel, compose, images, jpeg, raster
from palimpsest.sources.pdf_syntax import Document, Name
from tests.pdf_samples import gray_image


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.floats(0, 1), st.integers(0, 99))
def test_bilevel_round_trip(h, w, share, seed):
    mask = np.random.default_rng(seed).random((h, w)) < share
    assert (bilevel.decode_generic(bilevel.encode_generic(mask)) == mask).all()


def test_bilevel_size_and_faults():
    assert 4 <= len(bilevel.encode_generic(np.zeros((100, 100), dtype=bool))) < 10_000
    for bad in (np.zeros((2, 2)), np.zeros((0, 2), dtype=bool)):
        with pytest.raises(ValueError):
            bilevel.encode_generic(bad)


def _decoded(spark, data, tmp_path):
    (tmp_path / "x.jpg").write_bytes(data)
    row = spark.read.format("image").load(str(tmp_path / "x.jpg")).select("image.*").first()
    got = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.nChannels)
    return got[..., ::-1] if row.nChannels == 3 else got[..., 0]


def test_jpeg(spark, tmp_path):
    y, x = np.mgrid[0:61, 0:83]
    gray = ((np.sin(x / 9) + np.cos(y / 7)) * 60 + 128).astype(np.uint8)
    color = np.stack([gray, gray.T[:61].repeat(2, axis=1)[:, :83], 255 - gray], axis=2)
    small, large = jpeg.encode_jpeg(gray, 50), jpeg.encode_jpeg(color, 50)
    assert len(small) < len(large) and small[:2] == b"\xff\xd8"
    assert raster.psnr(_decoded(spark, jpeg.encode_jpeg(gray, 85), tmp_path), gray) > 35
    assert raster.psnr(_decoded(spark, jpeg.encode_jpeg(color, 90), tmp_path), color) > 30
    noise = np.random.default_rng(0).integers(0, 256, (40, 40), dtype=np.uint8)
    assert raster.psnr(_decoded(spark, jpeg.encode_jpeg(noise, 95), tmp_path), noise) > 30
    for bad in (0, 101):
        with pytest.raises(ValueError):
            jpeg.encode_jpeg(gray, bad)


def test_jpeg_round_trip():
    y, x = np.mgrid[0:45, 0:70]
    gray = ((np.sin(x / 9) + np.cos(y / 7)) * 60 + 128).astype(np.uint8)
    color = np.stack([gray, np.flip(gray, axis=1), 255 - gray], axis=2)
    assert raster.psnr(jpeg.decode_jpeg(jpeg.encode_jpeg(gray, 90)), gray) > 35
    assert raster.psnr(jpeg.decode_jpeg(jpeg.encode_jpeg(color, 90)), color) > 30
    for bad in (b"", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc2\x00\x0b" + b"\x08" * 9):
        with pytest.raises(jpeg.JpegFault):
            jpeg.decode_jpeg(bad)
    stored = gray_image()
    stored.dict["Filter"], stored.raw = Name("DCTDecode"), jpeg.encode_jpeg(np.full((100, 100), 7, dtype=np.uint8), 90)
    out = compose.redacted_images(Document(), b"1 g 0 0 50 50 re f q 100 0 0 100 0 0 cm /Im0 Do Q", {"Im0": stored})["Im0"]
    pixels = jpeg.decode_jpeg(out["data"])
    assert out["filter"] == "DCTDecode" and pixels[60:, :40].min() > 240 and pixels[:40].max() < 20


def test_components_and_boxes():
    mask = np.zeros((100, 100), dtype=bool)
    mask[10:20, 20:40] = True
    assert raster.components(mask) == [(20, 10, 20, 10)] == raster.text_boxes(mask)
    mask[:] = False
    mask[10:12, 10:12] = True
    assert raster.components(mask) == [(10, 10, 2, 2)] and raster.text_boxes(mask) == []
    mask[12, 12] = True
    assert len(raster.components(mask)) == 2 and len(raster.components(mask, eight=True)) == 1


def test_components_by_flood():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((12, 15)) < 0.5
        seen, found = np.zeros_like(mask), []
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                cells.append((a, b))
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < 12 and 0 <= d < 15 and mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
            ys, xs = zip(*cells, strict=True)
            found.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        assert sorted(found) == sorted(raster.components(mask))


def test_otsu():
    gray = np.full((200, 200), 255, dtype=np.uint8)
    gray[:100] = 0
    mask = raster.otsu_mask(gray)
    assert mask[:100].all() and not mask[100:].any()
    assert not raster.otsu_mask(np.full((10, 10), 255, dtype=np.uint8)).any()


def test_page_outputs():
    bitmap = np.full((200, 300, 4), 255, dtype=np.uint8)
    bitmap[50:60, 40:90, :3] = 0
    out = compose.text_masked(Document(), b"q BT (x) Tj ET Q", {}, bitmap, 300.0, 200.0)
    assert out["content"].split() == [b"q", b"Q"]
    assert [r["box"] for r in out["regions"]] == [(40.0, 140.0, 90.0, 150.0)]
    assert compose.bw_mask(bitmap)["kind"] == "bw_mask"
    gray, color = (compose.layered(bitmap, m, 50, 30) for m in ("grayscale", "rgb"))
    assert gray["space"] == "DeviceGray" and len(gray["bg"]) < len(color["bg"]) and len(color["fg"]) <= len(color["bg"])


def test_redaction():
    doc, image = Document(), gray_image()
    stream = b"1 g 0 0 50 50 re f q 100 0 0 100 0 0 cm /Im0 Do Q"
    out = compose.redacted_images(doc, stream, {"Im0": image})["Im0"]
    pixels = np.frombuffer(out["data"], dtype=np.uint8).reshape(100, 100)
    assert (pixels[50:, :50] == 255).all() and (pixels[:50] == 7).all() and (pixels[:, 50:] == 7).all()
    assert compose.redacted_images(doc, b"1 g 200 200 5 5 re f 100 0 0 100 0 0 cm /Im0 Do", {"Im0": image}) == {}


def test_redaction_of_two_placements():
    stream = b"1 g 0 0 10 10 re f 390 390 10 10 re f q 100 0 0 100 0 0 cm /Im0 Do Q q 100 0 0 100 300 300 cm /Im0 Do Q"
    count = lambda out: (np.frombuffer(out["Im0"]["data"], dtype=np.uint8) == 255).sum()
    assert count(compose.redacted_images(Document(), stream, {"Im0": gray_image()})) == 200
    assert count(compose.redacted_images(Document(), stream, {"Im0": gray_image()}, parity=True)) == 100


def test_smallest_encoding():
    gray = np.zeros((64, 64), dtype=np.uint8)
    assert images.smallest_encoding(gray, 10_000)["filter"] == "JBIG2Decode"
    assert images.smallest_encoding(gray, 3) is None
    color = np.zeros((64, 64, 3), dtype=np.uint8)
    color[..., 0] = 200
    assert images.smallest_encoding(color, 10_000)["space"] == "DeviceRGB"

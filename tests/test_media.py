"""Features of generated images and sounds."""

import io
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import media


def png(rgb):
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(1)
    half = np.zeros((20, 30, 3), np.uint8)
    half[:, 15:] = 255
    return {"red": np.full((12, 16, 3), (200, 10, 10), np.uint8), "half": half, "noise": rng.integers(0, 256, (24, 18, 3), dtype=np.uint8), "dot": np.full((1, 1, 3), 250, np.uint8)}


@pytest.fixture(scope="module")
def features(spark, pictures, tmp_path_factory):
    d = tmp_path_factory.mktemp("pics")
    for name, rgb in pictures.items():
        (d / f"{name}.png").write_bytes(png(rgb))
    (d / "broken.png").write_bytes(b"no picture")
    for folder in "ab":  # two files of one name
        (d / folder).mkdir()
        (d / folder / "twin.png").write_bytes(png(np.full((4, 5, 3), 40 if folder == "a" else 90, np.uint8)))
    images = media.read_images(spark, str(d))
    rows = {r["path"].rpartition("/")[2].removesuffix(".png"): r for r in media.image_features(images.where("NOT endswith(path, 'twin.png')")).collect()}
    return images, rows


def test_colour(pictures, features):
    _, rows = features
    assert set(rows) == set(pictures)
    for name, rgb in pictures.items():
        x, r = rgb.astype(float), rows[name]
        for i, c in enumerate("rgb"):
            assert r[f"rgb_{c}_mean"] == pytest.approx(x[:, :, i].mean()) and r[f"rgb_{c}_std"] == pytest.approx(x[:, :, i].std(), abs=1e-9)
        light = x @ [0.299, 0.587, 0.114]
        assert r["brightness"] == pytest.approx(light.mean()) and r["contrast"] == pytest.approx(light.std(), abs=1e-9)
        assert r["whitespace_ratio"] == pytest.approx((rgb > 240).all(axis=2).mean())
    assert rows["red"]["hsv_h_mean"] == pytest.approx(0, abs=1e-6) and rows["red"]["dominant_color_1"] == "#C80A0A" and rows["half"]["dynamic_range"] == 255


def test_edges(pictures, features):
    _, rows = features
    assert rows["red"]["entropy"] == 0 and rows["half"]["entropy"] == pytest.approx(1) and rows["noise"]["entropy"] > 5
    assert rows["half"]["symmetry_h"] == 0 and rows["half"]["symmetry_v"] == 1 and rows["dot"]["symmetry_h"] == 1
    assert rows["half"]["visual_center_x"] == pytest.approx(0.5, abs=0.05)
    assert rows["half"]["aspect_ratio"] == 1.5 and rows["half"]["contour_count"] > 0


def test_guards(spark, features):
    manifest = spark.createDataFrame([(".\\half.png",), ("a\\half.png",), ("gone.png",), ("x.txt",), (" ",), (None,), ("broken.png",)], "file string")
    got = {r["file"]: r["error"] for r in media.guarded(manifest, features[0], "file").collect()}
    assert got == {".\\half.png": "", "a\\half.png": "file not found", "gone.png": "file not found", "x.txt": "not an image", " ": "empty path", None: "empty path", "broken.png": "cannot be decoded"}


def test_files_of_one_name(spark, features):
    manifest = spark.createDataFrame([("p1", "a/twin.png"), ("p2", "b\\twin.png")], "post string, file string")
    found = media.guarded(manifest, features[0], "file")
    means = {r["path"]: r["rgb_r_mean"] for r in media.image_features(features[0]).collect()}
    assert sorted((r["post"], means[r["path"]]) for r in found.collect()) == [("p1", 40), ("p2", 90)]


def test_video(spark):
    frames = spark.createDataFrame([("v", 1.0, "a", True), ("v", 3.0, "b", True), ("v", 9.0, "b", False), ("w", None, None, False)], "video string, x double, c string, ok boolean")
    rows = {r["video"]: r for r in media.video_features(frames, "video", ["x"], ["c"]).collect()}
    assert rows["v"]["x_mean"] == 2 and rows["v"]["x_std"] == pytest.approx(2**0.5) and rows["v"]["c"] == "a" and rows["v"]["ok_ratio"] == pytest.approx(2 / 3)
    assert not rows["w"]["ok"] and rows["w"]["frame_count"] == 1
    assert media.frame_functionals(frames.where("video = 'v'"), "video", ["x"]).first()["x_std"] == pytest.approx(np.std([1, 3, 9]))


def wav(x, rate=16000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((x * 32767).astype(np.int16).tobytes())
    return out.getvalue()


def test_audio(spark, tmp_path):
    t = np.arange(16000) / 16000
    for name, x in (("sine", 0.5 * np.sin(2 * np.pi * 440 * t)), ("silence", np.zeros(800))):
        (tmp_path / f"{name}.wav").write_bytes(wav(x))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "none.wav").write_bytes(wav(np.zeros(0)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "sine.wav").write_bytes(wav(np.zeros(400)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    manifest = spark.createDataFrame([(f,) for f in ("sine.wav", "silence.wav", "sub/sine.wav", "none.wav", "bad.wav", "no.wav", "x.doc", None)], "file string")
    rows = {r["file"]: r for r in media.audio_levels(manifest, files, "file", str(tmp_path)).collect()}
    assert {f: r["audio_status"] for f, r in rows.items()} == {"sine.wav": "ok", "silence.wav": "silent_or_near_silent", "sub/sine.wav": "silent_or_near_silent", "none.wav": "no_audio_stream", "bad.wav": "probe_error", "no.wav": "file_not_found", "x.doc": "unsupported_format", None: "file_not_found"}
    assert rows["sine.wav"]["audio_rms_dbfs"] == pytest.approx(-9.03, abs=0.02) and rows["silence.wav"]["audio_rms_dbfs"] == -120 and rows["sine.wav"]["audio_duration_s"] == 1


def test_music(spark):
    t = np.arange(44100) / 44100
    files = [(bytearray(wav(x, 44100)),) for x in (0.5 * np.sin(2 * np.pi * 440 * t), np.random.default_rng(3).uniform(-0.5, 0.5, 44100), np.zeros(44100), 0.5 * np.ones(100))]
    sine, noise, silent, short = (r[0] for r in spark.createDataFrame(files, "c binary").coalesce(1).select(media.music_features(F.col("c"))).collect())
    assert sine["seconds"] == 1 and sine["centroid_mean"] == pytest.approx(440, rel=0.2) and sine["zero_crossing_rate_mean"] == pytest.approx(880 / 22050, rel=0.1)
    assert noise["centroid_mean"] > 3000 and noise["flatness_mean"] > 10 * sine["flatness_mean"] and sine["rms_mean"] == pytest.approx(0.5 / 2**0.5, rel=0.05)
    assert silent["error"] == "empty or silent" and short["error"] == "too short (<100ms)" and short["rms_mean"] is None


def test_keys(spark):
    turned = lambda p, k: [float(p[(i - k) % 12]) for i in range(12)]
    df = spark.createDataFrame([(turned(media.MAJOR, 7),), (turned(media.MINOR, 9),), ([1.0] * 12,)], "c array<double>")
    got = [tuple(r[0])[:2] for r in df.select(media.key_and_mode(F.col("c"))).collect()]
    assert got == [("G", "major"), ("A", "minor"), ("", "")]


def tiff(entries, order="<"):
    """A TIFF block with one folder; values are bytes, (kind, count, bytes)."""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    rows, tail, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
    for tag, kind, n, raw in entries:
        if len(raw) <= 4:
            rows += struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            rows += struct.pack(order + "HHII", tag, kind, n, at + len(tail))
            tail += raw
    return head + struct.pack(order + "H", len(entries)) + rows + b"\0" * 4 + tail


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, order):
    from tallygrid.functions.exif import exif_fields

    p = lambda *v: struct.pack(order + "I" * len(v), *v)
    block = tiff([(0x010F, 2, 6, b"Maker\0"), (0x0132, 2, 20, b"2020:01:01 00:00:00\0"), (0xA002, 4, 1, p(640)), (0x0100, 4, 1, p(10)), (0x829A, 5, 1, p(1, 200)), (0x8827, 3, 1, struct.pack(order + "H", 400))], order)
    gps = struct.pack(order + "H", 2) + struct.pack(order + "HHI", 1, 2, 2) + b"S\0\0\0" + struct.pack(order + "HHII", 2, 5, 3, 300) + b"\0" * 4
    block2 = tiff([(0x8825, 4, 1, p(60))], order).ljust(60, b"\0") + gps
    block2 = block2.ljust(300, b"\0") + p(10, 1, 30, 1, 0, 1)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xd9"
    files = [(bytearray(x),) for x in (jpeg, block2, b"\xff\xd8\xff", b"II*\0\xff", b"text")] + [(None,)]
    rows = [r[0] for r in spark.createDataFrame(files, "content binary").coalesce(1).select(exif_fields("content")).collect()]
    assert (rows[0]["exif_camera_make"], rows[0]["exif_exposure_time"], rows[0]["exif_iso"]) == ("Maker", 0.005, 400)
    assert rows[0]["exif_datetime"].startswith("2020") and rows[0]["exif_image_width"] == 640 and rows[0]["exif_image_height"] is None
    assert rows[1]["exif_gps_lat"] == -10.5 and all(v is None for r in rows[2:] for v in r)

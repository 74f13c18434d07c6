"""Media features, one numpy pass per file inside a task.

Spark's ``image`` source decodes the files, and Spark deals them to tasks: an image is a row, never
a row per pixel, and nothing but its features leaves the task. Videos are images with a frame
number: their features aggregate the frames' features.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallygrid.functions.measures import SILENCE_DBFS, dbfs
from tallygrid.functions.text import has_extension, slashes

#: File types of images and of audio: fixed values.
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp")
AUDIO = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac", ".mp4", ".mov", ".mkv", ".webm")
#: Krumhansl and Kessler's profiles of the twelve pitch classes for a major and a minor key, and their names: fixed values.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Pixels sampled for dominant colours, clusters and rounds.
COLOUR_SAMPLE, CLUSTERS, ROUNDS = 1000, 5, 20
#: Samples of a frame of sound and between frames, and the share of energy below the rolloff: fixed values.
FRAME, HOP, ROLLOFF = 2048, 512, 0.85


def below(path: Column, folder: str) -> Column:
    """A file's path relative to a folder, with forward slashes."""
    base = urlparse(folder).path.rstrip("/") + "/"
    return F.substring(path, F.instr(path, base) + len(base), F.length(path))


def relative(path: Column) -> Column:
    """A manifest's path in the same form."""
    return F.regexp_replace(slashes(F.trim(path)), r"^(\./)+|^/+", "")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images below a folder with ``path``, ``file`` (relative to it), ``width``, ``height``,
    ``channels`` and ``data``; files that cannot be read have no data."""
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder).select("image.*")
    return raw.select(F.col("origin").alias("path"), below(F.col("origin"), folder).alias("file"), "width", "height", F.col("nChannels").alias("channels"), F.when(F.col("width") > 0, F.col("data")).alias("data"))


def guarded(manifest: DataFrame, images: DataFrame, file_col: str) -> DataFrame:
    """Manifest rows with their image, found by its path below the folder that was read, and an
    ``error`` for each that has none (V9, V10, J4)."""
    found = images.withColumnRenamed("file", "_file")
    joined = manifest.join(found, relative(F.col(file_col)) == F.col("_file"), "left")
    error = (
        F.when(F.trim(F.coalesce(F.col(file_col), F.lit(""))) == "", "empty path").when(~has_extension(F.col(file_col), IMAGES), "not an image")
        .when(F.col("path").isNull(), "file not found").when(F.col("data").isNull(), "cannot be decoded").otherwise("")
    )
    return joined.withColumn("error", error).withColumn("ok", F.col("error") == "").drop("_file")


def _filtered(gray: np.ndarray, kernel: Sequence[int], clip: bool = True) -> np.ndarray:
    """A 3 x 3 filter that keeps to 8 bits around 128; the border stays as it is."""
    out = gray.astype(np.int32).copy()
    if min(gray.shape) > 2:
        views = [gray[i:gray.shape[0] - 2 + i, j:gray.shape[1] - 2 + j].astype(np.int32) for i in range(3) for j in range(3)]
        out[1:-1, 1:-1] = np.clip(sum(k * v for k, v in zip(kernel, views, strict=True)) + 128, 0, 255)
    return out - 128


def _median(gray: np.ndarray) -> np.ndarray:
    padded = np.pad(gray, 1, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (3, 3)).reshape(*gray.shape, 9), axis=2).astype(np.int32)


def colour_features(rgb: np.ndarray, gray: np.ndarray) -> dict[str, float]:
    """Channel statistics, brightness, contrast, colourfulness (V2), hue, saturation, value and
    colour temperature (V3), range and size (V7), share of white (V6)."""
    r, g, b = (rgb[:, :, k].astype(float) for k in range(3))
    high, span = rgb.max(axis=2).astype(float), rgb.max(axis=2).astype(float) - rgb.min(axis=2)
    some = np.where(span == 0, 1, span)
    hue = np.select([span == 0, high == r, high == g], [0.0, (60 * (g - b) / some + 360) % 360, 60 * (b - r) / some + 120], 60 * (r - g) / some + 240)
    saturation = span / np.where(high == 0, 1, high)
    light, rg, yb = 0.299 * r + 0.587 * g + 0.114 * b, r - g, 0.5 * (r + g) - b
    out = {f"rgb_{c}_{n}": f(x) for c, x in zip("rgb", (r, g, b)) for n, f in (("mean", np.mean), ("std", np.std))}
    out |= {"brightness": light.mean(), "contrast": light.std(), "colorfulness": np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())}
    strong = np.radians(hue[saturation > 0.1])
    east, north = (np.cos(strong).mean(), np.sin(strong).mean()) if len(strong) >= 10 else (1.0, 0.0)
    reach = np.hypot(east, north)
    out |= {"hsv_h_mean": (np.degrees(np.arctan2(north, east)) + 360) % 360, "hsv_h_std": 0.0 if reach >= 1 else np.degrees(np.sqrt(-2 * np.log(max(reach, 1e-10))))}
    out |= {f"hsv_{c}_{n}": f(x) for c, x in (("s", saturation), ("v", high / 255)) for n, f in (("mean", np.mean), ("std", np.std))}
    warm, cool = ((hue < 60) | (hue > 300)).sum(), ((hue > 120) & (hue < 240)).sum()
    height, width = gray.shape
    return out | {
        "color_temp": warm / max(cool, 1), "whitespace_ratio": (rgb > 240).all(axis=2).mean(), "dynamic_range": float(gray.max() - gray.min()),
        "resolution": width * height / 1e6, "aspect_ratio": width / max(height, 1),
    }


def edge_features(rgb: np.ndarray, gray: np.ndarray) -> dict[str, float]:
    """Entropy, sharpness, edge density, noise (V4), contours, orientation (V5), thirds and
    visual centre (V6)."""
    height, width = gray.shape
    sx, sy = _filtered(gray, (-1, 0, 1, -2, 0, 2, -1, 0, 1)), _filtered(gray, (-1, -2, -1, 0, 0, 0, 1, 2, 1))
    lap, noise = _filtered(gray, (0, 1, 0, 1, -4, 1, 0, 1, 0)), gray - _median(gray)
    grad = np.sqrt((sx * sx + sy * sy).astype(float))
    edge, energy, total = grad > grad.mean() + grad.std(), grad * grad, grad.sum()
    third = np.zeros(gray.shape, bool)
    for axis, size in ((1, width), (0, height)):
        band = max(int(0.05 * size), 1)
        for k in (1, 2):
            centre = size * k // 3
            at = [slice(None)] * 2
            at[axis] = slice(max(centre - band, 0), centre + band)
            third[tuple(at)] = True
    share = np.bincount(gray.ravel(), minlength=256) / gray.size
    share = share[share > 0]
    angles = np.bincount((((np.degrees(np.arctan2(sy[edge], sx[edge])) + 360) % 180) // 10).astype(int), minlength=18)
    return {
        "sharpness": lap.var(), "edge_density": edge.mean(), "noise_estimate": noise.std(), "rule_of_thirds": energy[third].sum() / energy.sum() if energy.sum() else 0.0,
        "visual_center_x": (grad.sum(axis=0) @ np.arange(width)) / total / max(width - 1, 1) if total else 0.5,
        "visual_center_y": (grad.sum(axis=1) @ np.arange(height)) / total / max(height - 1, 1) if total else 0.5,
        "entropy": -(share * np.log2(share)).sum() + 0.0, "contour_count": int((edge[:, 1:] & ~edge[:, :-1]).sum()), "line_orientation": angles.argmax() * 10.0 + 5 if edge.any() else 0.0,
    }


def symmetry(rgb: np.ndarray, gray: np.ndarray) -> dict[str, float]:
    """Likeness of the halves of an image to each other's mirror image (V6)."""
    def one(x: np.ndarray) -> float:
        half = x.shape[1] // 2
        return 1 - np.abs(x[:, :half].astype(int) - x[:, ::-1][:, :half]).mean() / 255 if half else 1.0

    return {"symmetry_h": one(gray), "symmetry_v": one(gray.T)}


def dominant_colours(rgb: np.ndarray, gray: np.ndarray) -> dict[str, str]:
    """Three dominant colours of a bounded sample of an image's pixels (V1, V2), the largest cluster first."""
    points, rng = rgb.reshape(-1, 3).astype(float), np.random.default_rng(42)
    if len(points) > COLOUR_SAMPLE:
        points = points[rng.choice(len(points), COLOUR_SAMPLE, replace=False)]
    points = np.vstack([points, np.zeros((max(0, CLUSTERS - len(points)), 3))])
    centres = points[rng.choice(len(points), CLUSTERS, replace=False)]
    for _ in range(ROUNDS):
        nearest = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(CLUSTERS)])
    top = centres[np.argsort(-np.bincount(nearest, minlength=CLUSTERS), kind="stable")][:3].astype(int)
    return {f"dominant_color_{k + 1}": "#{:02X}{:02X}{:02X}".format(*top[k]) for k in range(3)}


CATEGORIES = {"colour": colour_features, "edge": edge_features, "symmetry": symmetry, "dominant": dominant_colours}
TYPES = {float: "double", int: "int", str: "string"}


def image_features(images: DataFrame, categories: Sequence[str] = ("colour", "edge", "symmetry", "dominant")) -> DataFrame:
    """The chosen features of each image that can be read, by ``path`` (V9)."""
    makers = [CATEGORIES[name] for name in categories]

    def of(width: int, height: int, channels: int, data: bytes) -> dict[str, object]:
        bgr = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3]
        rgb = (bgr[:, :, ::-1] if channels > 1 else np.repeat(bgr, 3, axis=2)).astype(np.int32)
        gray = (rgb @ np.array([19595, 38470, 7471]) + 32768) >> 16
        return {name: value for make in makers for name, value in make(rgb, gray).items()}

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": path} | of(*image) for path, *image in batch.itertuples(index=False)]
            if rows:
                yield pd.DataFrame(rows)

    shape = {name: TYPES.get(type(value), "double") for name, value in of(1, 1, 3, bytes(3)).items()}
    schema = ", ".join(["path string", *[f"{name} {kind}" for name, kind in shape.items()]])
    return images.where("data IS NOT NULL").select("path", "width", "height", "channels", "data").mapInPandas(stream, schema)


def video_features(frames: DataFrame, video: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Features of videos from those of their frames (E15, E16): mean, sample deviation,
    extremes, most frequent category; ok if any frame is."""
    good = F.coalesce("ok", F.lit(False))
    out = [f(F.when(good, F.col(c))).alias(f"{c}_{n}") for c in numeric for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    out += [F.mode(F.when(good, F.col(c)), True).alias(c) for c in categorical]
    return frames.groupBy(video).agg(*out, F.count(F.lit(1)).alias("frame_count"), F.avg(good.cast("double")).alias("ok_ratio"), F.bool_or(good).alias("ok"))


def frame_functionals(frames: DataFrame, key: str, descriptors: Sequence[str]) -> DataFrame:
    """Mean and population deviation of frame descriptors."""
    return frames.groupBy(key).agg(*[f(c).alias(f"{c}_{n}") for c in descriptors for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def wav_samples(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and their rate, of a 16-bit WAV file."""
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise wave.Error("not 16-bit")
        x = np.frombuffer(f.readframes(f.getnframes()), np.int16).reshape(-1, f.getnchannels()) / 32768.0
        return x.mean(axis=1), f.getframerate()


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, linearly between the old ones."""
    n = round(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x) if len(x) and rate != to else x


def wav_levels(content: Column) -> Column:
    """Struct ``rms``, ``peak``, ``seconds``, ``problem`` (a status, or null) and ``error`` of WAV files."""

    @pandas_udf("struct<rms double, peak double, seconds double, problem string, error string>")
    def of(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            problem = "probe_error"
            try:
                with wave.open(io.BytesIO(data)) as f:
                    some = f.getnframes() > 0
                problem = "extraction_error"
                x, rate = wav_samples(data) if some else (np.zeros(0), 1)
                rows.append((float(np.sqrt(np.mean(x * x))), float(np.abs(x).max()), len(x) / rate, None, None) if some else (None, None, None, "no_audio_stream", None))
            except Exception as e:  # the row records it
                rows.append((None, None, None, problem, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["rms", "peak", "seconds", "problem", "error"])

    return of(content)


def audio_levels(manifest: DataFrame, files: DataFrame, file_col: str, folder: str, threshold: float = SILENCE_DBFS) -> DataFrame:
    """Manifest rows with level, duration and a status of each audio file (V13 without speech
    features, J4). ``files`` is a ``binaryFile`` table of what is below ``folder``."""
    found = files.select(below(F.col("path"), folder).alias("_file"), "content")
    joined = manifest.join(found, relative(F.col(file_col)) == F.col("_file"), "left").withColumn("_a", F.when(F.col("content").isNotNull(), wav_levels(F.col("content"))))
    level, problem = dbfs(F.col("_a.rms")), F.col("_a.problem")
    status = (
        F.when(F.trim(F.coalesce(F.col(file_col), F.lit(""))) == "", "file_not_found").when(~has_extension(F.col(file_col), AUDIO), "unsupported_format")
        .when(F.col("content").isNull(), "file_not_found").when(problem.isNotNull(), problem).when(level > threshold, "ok").otherwise("silent_or_near_silent")
    )
    measured = F.col("_a.rms").isNotNull()
    return joined.select(
        *manifest.columns, F.when(measured | (problem == "extraction_error"), F.lit(True)).when(problem == "no_audio_stream", F.lit(False)).alias("audio_stream_present"),
        F.when(measured, level > threshold).when(problem == "no_audio_stream", F.lit(False)).alias("audio_signal_ok"), status.alias("audio_status"),
        F.when(measured, level).alias("audio_rms_dbfs"), F.when(measured, dbfs(F.col("_a.peak"))).alias("audio_peak_dbfs"), F.col("_a.seconds").alias("audio_duration_s"),
        F.coalesce("_a.error", F.lit("")).alias("audio_error"),
    )


DESCRIPTORS = ("rms", "zero_crossing_rate", "centroid", "bandwidth", "rolloff", "flatness")


def frame_descriptors(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, descriptors) of Hann-windowed frames, the sound centred in them."""
    framed = np.lib.stride_tricks.sliding_window_view(np.pad(x, FRAME // 2), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(framed * np.hanning(FRAME + 1)[:-1], axis=1)) ** 2
    size, hertz = np.sqrt(power), np.fft.rfftfreq(FRAME, 1 / rate)
    whole = np.maximum(size.sum(axis=1), 1e-12)
    centroid = size @ hertz / whole
    spread = np.sqrt((size * (hertz - centroid[:, None]) ** 2).sum(axis=1) / whole)
    upto = np.cumsum(size, axis=1)
    floor = np.maximum(power, 1e-10)
    return np.column_stack([
        np.sqrt((framed ** 2).mean(axis=1)), (np.signbit(framed[:, 1:]) != np.signbit(framed[:, :-1])).mean(axis=1), centroid, spread,
        hertz[(upto >= ROLLOFF * upto[:, -1:]).argmax(axis=1)], np.exp(np.log(floor).mean(axis=1)) / floor.mean(axis=1),
    ])


def music_features(content: Column, rate: int = 22_050) -> Column:
    """Struct of the mean and deviation of frame descriptors, ``seconds`` and ``error`` of WAV
    files (V14 as far as numpy goes); silent files and those under 100 ms have an error."""
    names = [f"{d}_{f}" for d in DESCRIPTORS for f in ("mean", "std")]

    @pandas_udf(", ".join(f"{n} double" for n in names) + ", seconds double, error string")
    def of(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                x, own = wav_samples(data)
                x = resampled(x, own, rate)
                if np.abs(x).max(initial=0) < 1e-5:
                    raise ValueError("empty or silent")
                if len(x) < 0.1 * rate:
                    raise ValueError("too short (<100ms)")
                d = frame_descriptors(x, rate)
                rows.append((*np.column_stack([d.mean(axis=0), d.std(axis=0)]).ravel().tolist(), len(x) / rate, None))
            except Exception as e:  # the row records it
                rows.append((*[None] * len(names), None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=[*names, "seconds", "error"])

    return of(content)


def key_and_mode(chroma: Column) -> Column:
    """Struct ``key``, ``mode`` and ``confidence`` of a twelve-class chroma vector (M9): the
    best correlation with the 24 rotated profiles; blank for none."""
    def centred(v: Sequence[float]) -> list[float]:
        m = sum(v) / 12
        norm = sum((x - m) ** 2 for x in v) ** 0.5
        return [(x - m) / norm for x in v]

    mean = F.aggregate(chroma, F.lit(0.0), lambda a, x: a + x) / 12
    flat = F.transform(chroma, lambda x: x - mean)
    norm = F.sqrt(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x * x))
    scores = []
    for rank, (mode, profile) in enumerate((("major", centred(MAJOR)), ("minor", centred(MINOR)))):
        for shift, note in enumerate(NOTES):
            turned = F.array(*[F.lit(profile[(i - shift) % 12]) for i in range(12)])
            r = F.aggregate(F.zip_with(flat, turned, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / norm
            scores.append(F.struct(r.alias("confidence"), F.lit(-rank * 12 - shift).alias("order"), F.lit(note).alias("key"), F.lit(mode).alias("mode")))
    best = F.array_max(F.array(*scores))
    some = norm > 0
    return F.struct(F.when(some, best["key"]).otherwise("").alias("key"), F.when(some, best["mode"]).otherwise("").alias("mode"), F.when(some, best["confidence"]).alias("confidence"))



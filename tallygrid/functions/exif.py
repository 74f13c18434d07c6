"""EXIF fields of JPEG and TIFF files (V8), from the bytes alone."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Tags of the EXIF standard: fixed values.
TEXT_TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x9003: "datetime", 0x0131: "software"}
NUMBER_TAGS = {0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x920A: "focal_length", 0x0112: "orientation", 0xA002: "image_width", 0xA003: "image_height"}
#: A tag that stands in where the other is missing.
INSTEAD = {0x9003: 0x0132}
FOLDERS, GPS = (0x8769,), 0x8825
#: Bytes and format of the value types.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "B"), 9: (4, "i"), 10: (8, "ii")}
NAMES = [*TEXT_TAGS.values(), *NUMBER_TAGS.values(), "gps_lat", "gps_lon"]
SCHEMA = StructType([StructField(f"exif_{n}", StringType() if n in TEXT_TAGS.values() else DoubleType()) for n in NAMES])


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure of a file: the file itself, or a JPEG's EXIF segment."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack(">H", data[at + 2:at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4:at + 10] == b"Exif\0\0":
            return data[at + 10:at + 2 + size]
        at += 2 + size
    return None


def entries(block: bytes, order: str, at: int) -> dict[int, object]:
    """Tags of one folder: text, a number, or a list of numbers."""
    out: dict[int, object] = {}
    if at + 2 > len(block):
        return out
    for k in range(struct.unpack(order + "H", block[at:at + 2])[0]):
        row = block[at + 2 + 12 * k:at + 14 + 12 * k]
        if len(row) < 12:
            break
        tag, kind, n = struct.unpack(order + "HHI", row[:8])
        width, code = TYPES.get(kind, (0, ""))
        place = struct.unpack(order + "I", row[8:])[0]
        raw = row[8:8 + width * n] if width * n <= 4 else block[place:place + width * n]
        if not width or n > 65_536 or len(raw) < width * n:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            continue
        numbers = [x for x in struct.iter_unpack(order + code, raw)]
        values = [x[0] if len(x) == 1 else x[0] / x[1] if x[1] else 0.0 for x in numbers]
        out[tag] = values[0] if len(values) == 1 else values
    return out


def exif_row(data: bytes | None) -> tuple:
    """The fields of a file in order of :data:`NAMES`; None where there is none."""
    found: dict[str, object] = {}
    block = tiff_block(data) if data else None
    if block and len(block) >= 8:
        order = "<" if block[:2] == b"II" else ">"
        tags = entries(block, order, struct.unpack(order + "I", block[4:8])[0])
        for folder in FOLDERS:
            if isinstance(tags.get(folder), int):
                tags |= entries(block, order, tags[folder])
        place = entries(block, order, tags[GPS]) if isinstance(tags.get(GPS), int) else {}
        tags |= {t: tags[other] for t, other in INSTEAD.items() if not tags.get(t) and tags.get(other)}
        found = {n: str(tags[t]) for t, n in TEXT_TAGS.items() if tags.get(t)}
        found |= {n: float(tags[t]) for t, n in NUMBER_TAGS.items() if isinstance(tags.get(t), (int, float))}
        for name, side, value, negative in (("gps_lat", 1, 2, "S"), ("gps_lon", 3, 4, "W")):
            if isinstance(place.get(value), list) and len(place[value]) == 3:
                d, m, s = place[value]
                found[name] = (d + m / 60 + s / 3600) * (-1 if place.get(side) == negative else 1)
    return tuple(found.get(n) for n in NAMES)


@pandas_udf(SCHEMA)
def exif_fields(content: pd.Series) -> pd.DataFrame:
    """A struct of EXIF fields per file; all null where there are none or they cannot be read."""
    rows = []
    for data in content:
        try:
            rows.append(exif_row(data))
        except struct.error:
            rows.append((None,) * len(NAMES))
    return pd.DataFrame(rows, columns=SCHEMA.names)

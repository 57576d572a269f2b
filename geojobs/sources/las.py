"""LAS 1.2 writer, point format 2."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd

from geojobs.operators.storage import open_store

POINT = np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")])


def encode(points: pd.DataFrame, scale: float = 0.001) -> bytes:
    """A whole LAS file of points (x, y, z, intensity, classification, red, green, blue)."""
    out = np.zeros(len(points), POINT)
    low = [float(points[c].min()) for c in "xyz"]
    for i, c in enumerate("xyz"):
        out[c.upper()] = np.round((points[c].to_numpy() - low[i]) / scale)
    for c in ("intensity", "classification", "red", "green", "blue"):
        out[c] = points[c].to_numpy()
    head = bytearray(227)
    struct.pack_into("<4s", head, 0, b"LASF")
    struct.pack_into("<BB", head, 24, 1, 2)
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 2, POINT.itemsize, len(points))
    struct.pack_into("<6d", head, 131, scale, scale, scale, *low)
    struct.pack_into("<6d", head, 179, *[v for c in "xyz" for v in (float(points[c].max()), float(points[c].min()))])
    return bytes(head) + out.tobytes()


def write(uri: str, points: pd.DataFrame) -> None:
    """To any file system that Arrow opens; ``uri`` has its scheme."""
    system, path = open_store(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(encode(points))

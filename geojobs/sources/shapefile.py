"""Shapefile writer: one polygon or point layer with text attributes."""

from __future__ import annotations

import struct

from geojobs.operators.storage import open_store


def encode(rows: list[tuple[dict[str, str], str, list]], fields: list[str], width: int = 60) -> tuple[bytes, bytes, bytes]:
    """(.shp, .shx, .dbf) of rows (attributes, type, rings); positions have three ordinates."""
    shapes, index, table, at = [], [], [], 50
    for number, (values, kind, rings) in enumerate(rows, 1):
        if kind == "Point":
            body = struct.pack("<i4d", 11, *rings[0][0], 0.0)
        else:
            flat = [p for r in rings for p in r]
            starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
            box = (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat))
            zs = [p[2] for p in flat]
            body = struct.pack("<i4d2i", 15, *box, len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts)
            body += b"".join(struct.pack("<2d", *p[:2]) for p in flat) + struct.pack("<2d", min(zs), max(zs)) + struct.pack(f"<{len(zs)}d", *zs)
        shapes.append(struct.pack(">2i", number, len(body) // 2) + body)
        index.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
        table.append(b" " + b"".join((values[f] or "").encode()[:width].ljust(width) for f in fields))
    head = bytearray(100)
    struct.pack_into(">i", head, 0, 9994)
    struct.pack_into("<2i", head, 28, 1000, 15)
    top = bytearray(32)
    struct.pack_into("<IHH", top, 4, len(rows), 33 + 32 * len(fields), 1 + width * len(fields))
    columns = b"".join(f.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15) for f in fields)
    return bytes(head) + b"".join(shapes), bytes(head) + b"".join(index), bytes(top) + columns + b"\r" + b"".join(table)


def write(uri: str, rows: list[tuple[dict[str, str], str, list]], fields: list[str]) -> None:
    """``uri``.shp, .shx and .dbf, on any file system that Arrow opens."""
    system, path = open_store(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    for suffix, data in zip((".shp", ".shx", ".dbf"), encode(rows, fields)):
        with system.open_output_stream(path + suffix) as out:
            out.write(data)

"""Polygon layers (SRC-13, SRC-14): ``.shp`` with ``.dbf``, loose or in a ZIP, as rows of attributes and WKT.

Written from the published format: big-endian record headers, little-endian shapes; polygon rings run
clockwise outside and counter-clockwise inside.
"""

from __future__ import annotations

import struct
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lavra.contracts import ContractError

POLYGONS = (5, 15, 25)


def _members(path: Path) -> dict[str, bytes]:
    if path.suffix.lower() == ".zip":
        with zipfile.ZipFile(path) as z:
            shapes = sorted(m for m in z.namelist() if m.lower().endswith(".shp"))
            if not shapes:
                raise ContractError(f"{path.name} holds no shapefile")
            stem = next((m for m in shapes if "setor" in m.lower()), shapes[0])[:-4].lower()
            return {m[-3:].lower(): z.read(m) for m in z.namelist() if m[:-4].lower() == stem}
    return {p.suffix[1:].lower(): p.read_bytes() for p in path.parent.glob(path.stem + ".*")}


def _rings(shp: bytes) -> list[list[list[tuple[float, float]]]]:
    at, out = 100, []
    while at + 8 <= len(shp):
        length = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        body = shp[at + 8 : at + 8 + length]
        kind = struct.unpack("<i", body[:4])[0]
        rings: list[list[tuple[float, float]]] = []
        if kind in POLYGONS:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        out.append(rings)
        at += 8 + length
    return out


def _attributes(dbf: bytes, encoding: str) -> tuple[list[str], list[list[str | None]]]:
    count, header, width = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(encoding), dbf[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        record, offset, row = dbf[header + i * width : header + (i + 1) * width], 1, []
        for _, size in fields:
            row.append(record[offset : offset + size].decode(encoding, "replace").strip() or None)
            offset += size
        rows.append(row)
    return [n for n, _ in fields], rows


def _wkt(rings: list[list[tuple[float, float]]]) -> str | None:
    if not rings:
        return None
    area = lambda r: sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]))
    text = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")"
    polygons: list[list[str]] = []
    for ring in rings:
        if area(ring) <= 0 or not polygons:
            polygons.append([])
        polygons[-1].append(text(ring))
    parts = ["(" + ", ".join(p) + ")" for p in polygons]
    return f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"


def read_polygons(spark: SparkSession, path: str | Path, encoding: str = "latin-1", require_crs: bool = True) -> DataFrame:
    """All attributes as texts and ``geometry_wkt``, ``crs_wkt``. A layer is metadata of bounded size (a mesh of
    sectors), read on the driver. A layer without reference system raises unless that is allowed."""
    files = _members(Path(path))
    crs = files.get("prj", b"").decode("utf-8", "replace").strip() or None
    if require_crs and not crs:
        raise ContractError(f"{path}: no coordinate reference system")
    names, rows = _attributes(files["dbf"], encoding)
    shapes = _rings(files["shp"])
    schema = ", ".join(f"`{n}` string" for n in [*names, "geometry_wkt", "crs_wkt"])
    return spark.createDataFrame([(*row, _wkt(rings), crs) for row, rings in zip(rows, shapes)], schema)


def read_optional_polygons(spark: SparkSession, path: str | Path | None, **options) -> DataFrame | None:
    """SRC-14: None where the layer is absent."""
    return read_polygons(spark, path, **options) if path and Path(path).exists() else None

"""Coordinate reference systems: what is known, what is only declared, and what is missing. Nothing is ever reprojected."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

CRS84 = "OGC:CRS84"
#: Only these two are known as geographic by id; they differ in axis order and are never taken for each other.
GEOGRAPHIC = {CRS84: "lon_lat", "EPSG:4326": "lat_lon"}


def definition_format(text: str) -> str:
    """wkt1, wkt2, projjson, proj or unknown, by how a definition begins."""
    head = text.lstrip()
    if head.startswith("{"):
        return "projjson"
    word = re.match(r"[A-Z0-9_]+", head.upper())
    if word and word[0] in ("GEOGCRS", "GEODCRS", "PROJCRS", "BOUNDCRS", "COMPOUNDCRS", "VERTCRS", "ENGCRS", "GEODETICCRS", "PROJECTEDCRS", "GEOGRAPHICCRS"):
        return "wkt2"
    if word and word[0] in ("GEOGCS", "PROJCS", "GEOCCS", "COMPD_CS", "VERT_CS", "LOCAL_CS", "FITTED_CS"):
        return "wkt1"
    return "proj" if head.startswith("+") else "unknown"


def root_epsg(definition: str) -> int | None:
    """The EPSG code of a definition's root, not of a base it is built on; several or none give None."""
    if definition_format(definition) == "projjson":
        try:
            found = json.loads(definition)
        except ValueError:
            return None
        ids = found.get("ids") or ([found["id"]] if "id" in found else [])
        codes = {int(i["code"]) for i in ids if str(i.get("authority", "")).upper() == "EPSG" and str(i.get("code", "")).isdigit()}
        return codes.pop() if len(codes) == 1 else None
    depth, codes, quoted = 0, set(), False
    for m in re.finditer(r'"|[\[\](]|\)|(?:AUTHORITY|ID)\s*[\[(]\s*"EPSG"\s*,\s*"?(\d+)"?', definition, re.I):
        token = m[0]
        if token == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif m[1]:
            if depth == 1:
                codes.add(int(m[1]))
            depth += 1
        elif token in "[(":
            depth += 1
        else:
            depth -= 1
    return codes.pop() if len(codes) == 1 else None


@dataclass(frozen=True)
class Crs:
    """resolution: resolved (id is known), declared (a definition that names no id) or missing."""

    resolution: str = "missing"
    id: str | None = None
    definition: str | None = None

    @property
    def kind(self) -> str:
        return "geographic" if self.id in GEOGRAPHIC else "unknown"

    @property
    def axis_order(self) -> str:
        if self.id in GEOGRAPHIC:
            return GEOGRAPHIC[self.id]
        head = (self.definition or "").lstrip().upper()
        return "easting_northing" if head.startswith(("PROJCS", "PROJCRS")) or '"PROJECTEDCRS"' in head else "unknown"

    @property
    def definition_format(self) -> str | None:
        return definition_format(self.definition) if self.definition else None

    @property
    def epsg(self) -> int | None:
        m = re.fullmatch(r"EPSG:(\d+)", self.id or "", re.I)
        return int(m[1]) if m else None

    def to_dict(self) -> dict:
        return {"resolution": self.resolution, "id": self.id, "definition": self.definition, "definition_format": self.definition_format, "axis_order": self.axis_order}


def resolved(identifier: str, definition: str | None = None) -> Crs:
    authority, _, code = identifier.strip().partition(":")
    return Crs("resolved", f"{authority.upper()}:{code.upper()}" if code else identifier.strip(), definition)


def from_definition(definition: str) -> Crs:
    code = root_epsg(definition)
    return Crs("resolved", f"EPSG:{code}", definition) if code else Crs("declared", None, definition)


MISSING = Crs()

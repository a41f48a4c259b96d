"""Sizes of icons, from their first bytes."""

from __future__ import annotations

import re
import struct


def icon_size(body: str | bytes | None, kind: str | None) -> tuple[float, float] | None:
    """(width, height) of a PNG, ICO or SVG; text bodies hold one byte per character."""
    if body is None:
        return None
    data = body if isinstance(body, bytes) else body.encode("latin-1", "ignore")
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return tuple(map(float, struct.unpack(">II", data[16:24])))
    if data[:4] == b"\x00\x00\x01\x00" and len(data) >= 8:
        return float(data[6] or 256), float(data[7] or 256)
    if "svg" in (kind or ""):
        text = data.decode("utf-8", "replace")
        if box := re.search(r"viewBox\s*=\s*[\"']\s*[-\d.]+[ ,]+[-\d.]+[ ,]+([\d.]+)[ ,]+([\d.]+)", text, re.I):
            return float(box[1]), float(box[2])
        sides = [re.search(rf"\b{side}\s*=\s*[\"']([\d.]+)", text, re.I) for side in ("width", "height")]
        if all(sides):
            return float(sides[0][1]), float(sides[1][1])
    return None

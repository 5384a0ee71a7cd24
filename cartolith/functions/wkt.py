"""Well-known text of all fifteen kinds in two to four dimensions."""

from __future__ import annotations

import math
import re

from .wkb import CHILDREN, LABELS, SIZES, Geometry, bad

_KIND = {v.upper(): k for k, v in LABELS.items()}
_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")
_SUFFIX = {"Z": "xyz", "M": "xym", "ZM": "xyzm"}


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise bad("not well-known text")
        out.append(m[1])
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at].upper() if self.at < len(self.tokens) else ""

    def next(self) -> str:
        token = self.peek()
        self.at += 1
        return token

    def expect(self, token: str) -> None:
        if self.next() != token:
            raise bad("not well-known text")

    def head(self, inherited: str | None) -> tuple[str, str | None]:
        kind = _KIND.get(self.peek())
        name = self.next()
        dims = None
        if kind is None:  # the suffix may be written without a blank
            for suffix in ("ZM", "Z", "M"):
                if name.endswith(suffix) and name[: -len(suffix)] in _KIND:
                    kind, dims = _KIND[name[: -len(suffix)]], _SUFFIX[suffix]
                    break
        elif self.peek() in _SUFFIX:
            dims = _SUFFIX[self.next()]
        if kind is None:
            raise bad("unknown type")
        return kind, dims or inherited

    def several(self, one) -> list:
        if self.peek() == "EMPTY":
            self.next()
            return []
        self.expect("(")
        out = [one()]
        while self.peek() == ",":
            self.next()
            out.append(one())
        self.expect(")")
        return out

    def ordinates(self) -> tuple:
        values = []
        while self.peek() not in (",", ")", ""):
            try:
                values.append(float(self.next()))
            except ValueError:
                raise bad("not a number") from None
        if not 2 <= len(values) <= 4 or not all(map(math.isfinite, values)):
            raise bad("wrong ordinates")
        self.sizes.add(len(values))
        return tuple(values)

    def geometry(self, inherited: str | None = None) -> Geometry:
        kind, dims = self.head(inherited)
        return self.body(kind, dims)

    def body(self, kind: str, dims: str | None) -> Geometry:
        if kind == "point":
            found = self.several(self.ordinates)
            if len(found) > 1:
                raise bad("a point has one position")
            content = found[0] if found else None
        elif kind in ("linestring", "circularstring"):
            content = self.several(self.ordinates)
        elif kind in ("polygon", "triangle"):
            content = self.several(lambda: self.several(self.ordinates))
        elif kind == "multipoint":
            content = self.several(lambda: self.body("point", dims) if self.peek() in ("(", "EMPTY") else Geometry("point", dims, self.ordinates()))
        else:
            bare = {"multilinestring": "linestring", "multipolygon": "polygon", "polyhedralsurface": "polygon", "tin": "triangle", "compoundcurve": "linestring", "curvepolygon": "linestring", "multicurve": "linestring", "multisurface": "polygon"}.get(kind)
            content = self.several(lambda: self.body(bare, dims) if bare and self.peek() in ("(", "EMPTY") else self.geometry(dims))
            if any(part.kind not in CHILDREN[kind] for part in content):
                raise bad("part of a type that does not belong there")
        return Geometry(kind, dims, content)


def _settle(g: Geometry, dims: str) -> Geometry:
    if g.dims not in (None, dims):
        raise bad("mixed dimensions")
    content = [_settle(p, dims) if isinstance(p, Geometry) else p for p in g.content] if isinstance(g.content, list) else g.content
    return Geometry(g.kind, dims, content)


def parse(text: str) -> Geometry:
    parser = _Parser(text)
    parser.sizes = set()
    g = parser.geometry()
    if parser.at != len(parser.tokens):
        raise bad("text after the geometry")
    if len(parser.sizes) > 1:
        raise bad("mixed dimensions")
    size = next(iter(parser.sizes), None)
    dims = g.dims or {None: "xy", 2: "xy", 3: "xyz", 4: "xyzm"}[size]
    if size is not None and SIZES[dims] != size:
        raise bad("ordinates do not match the dimensions")
    return _settle(g, dims)


def number(value: float) -> str:
    """Shortest text that reads back to the same number; whole numbers without a point."""
    if not math.isfinite(value):
        raise bad("not a finite ordinate")
    return repr(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def format(g: Geometry) -> str:  # noqa: A001
    suffix = {"xy": "", "xyz": " Z", "xym": " M", "xyzm": " ZM"}[g.dims]
    return LABELS[g.kind].upper() + suffix + _body(g)


def _run(points) -> str:
    return "(" + ",".join(" ".join(map(number, p)) for p in points) + ")"


def _body(g: Geometry) -> str:
    if not g.content:
        return " EMPTY"
    if g.kind == "point":
        return _run([g.content])
    if g.kind in ("linestring", "circularstring"):
        return _run(g.content)
    if g.kind in ("polygon", "triangle"):
        if not all(g.content):
            raise bad("an empty ring can't be written")
        return "(" + ",".join(map(_run, g.content)) + ")"
    bare = {"multipoint": "point", "multilinestring": "linestring", "multipolygon": "polygon", "polyhedralsurface": "polygon", "tin": "triangle", "multisurface": "polygon", "compoundcurve": "linestring", "curvepolygon": "linestring", "multicurve": "linestring"}.get(g.kind)
    for part in g.content:
        if not part.content and part.kind != "point":
            raise bad("an empty part can't be written")
    return "(" + ",".join(_body(p).strip() if p.kind == bare else format(p) for p in g.content) + ")"

"""Payloads of the R2000 and R2004 object records: one layout per type, read and written by the same function.

A layout names fields in file order; ``Fields`` reads them into a dict or writes them from it. Points are kept by index
(``x0``, ``y0``, ``z0``, …), in the order in which entity rows list them. References follow the fields at the bit that the
record's head names, so a reader needs a layout only up to its last wanted field.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from .bits import BitReader, BitWriter, resolve_handle

#: Type codes of the records that have a layout here.
TYPE_CODES = {
    "TEXT": 1, "ATTRIB": 2, "BLOCK": 4, "ENDBLK": 5, "SEQEND": 6, "INSERT": 7, "MINSERT": 8, "VERTEX_2D": 10, "VERTEX_3D": 11,
    "VERTEX_MESH": 12, "VERTEX_PFACE": 13, "VERTEX_PFACE_FACE": 14, "POLYLINE_2D": 15, "POLYLINE_3D": 16, "ARC": 17, "CIRCLE": 18,
    "LINE": 19, "DIM_ORDINATE": 20, "DIM_LINEAR": 21, "DIM_ALIGNED": 22, "DIM_ANG3PT": 23, "DIM_ANG2LN": 24, "DIM_RADIUS": 25,
    "DIM_DIAMETER": 26, "POINT": 27, "3DFACE": 28, "POLYLINE_PFACE": 29, "POLYLINE_MESH": 30, "SOLID": 31, "TRACE": 32, "ELLIPSE": 35,
    "SPLINE": 36, "RAY": 40, "XLINE": 41, "DICTIONARY": 42, "MTEXT": 44, "LEADER": 45, "MLINE": 47, "BLOCK_HEADER": 49, "LAYER": 51,
    "LWPOLYLINE": 77, "HATCH": 78,
}
NAMES = {v: k for k, v in TYPE_CODES.items()}
OBJECTS = ("DICTIONARY", "BLOCK_HEADER", "LAYER")
DIMENSIONS = tuple(k for k in TYPE_CODES if k.startswith("DIM_"))
#: What is written where a field has no value; 0 for kinds not named.
EMPTY = {"flag": False, "text": "", "extrusion": (0.0, 0.0, 1.0), "double": 0.0, "f64": 0.0, "thickness": 0.0}


class Fields:
    def __init__(self, bits: BitReader | BitWriter, f: dict[str, Any], codepage: str = "latin-1", later: bool = False):
        self.later = later  # R2004
        self.bits, self.f, self.codepage, self.reading = bits, f, codepage, isinstance(bits, BitReader)

    def __call__(self, kind: str, name: str, *args, default: Any = None):
        """Reads or writes one field by the codec of that name; ``default`` is written where the dict has none."""
        extra = (self.codepage,) if kind == "text" else args
        if self.reading:
            self.f[name] = getattr(self.bits, kind)(*extra)
        else:
            value = self.f.get(name)
            self.f[name] = value = (EMPTY.get(kind, 0) if default is None else default) if value is None else value
            getattr(self.bits, kind)(value, *extra)
        return self.f[name]

    def xyz(self, i: int, *z: float) -> None:
        for axis, d in zip("xyz", z or (0.0, 0.0, 0.0)):
            self("double", f"{axis}{i}", default=d)

    def xy(self, i: int) -> None:
        self("f64", f"x{i}")
        self("f64", f"y{i}")

    def near(self, i: int, j: int, axes: str = "xy") -> None:
        """Point i as differences from point j."""
        for axis in axes:
            self("double_from", f"{axis}{i}", self.f[f"{axis}{j}"], default=self.f[f"{axis}{j}"])

    def count(self, name: str, default: int, kind: str = "long") -> range:
        n = self(kind, name, default=default)
        # every member takes a bit at least, so other counts are damage
        if self.reading and n > self.bits.end - self.bits.at:
            raise ValueError(f"{n} members in {self.bits.end - self.bits.at} bits")
        return range(n)

    def listed(self, name: str, n: range, kind: str = "double") -> None:
        """A list of one codec's values."""
        if self.reading:
            self.f[name] = [getattr(self.bits, kind)() for _ in n]
        else:
            for v in self.f[name]:
                getattr(self.bits, kind)(v)

    def n_points(self) -> int:
        return sum(1 for k in self.f if k[0] == "x" and k[1:].isdigit())


def _line(x: Fields) -> None:
    flat = x("flag", "flat", default=not (x.f.get("z0") or x.f.get("z1")))
    for axis in "xy" if flat else "xyz":
        x("f64", f"{axis}0")
        x.near(1, 0, axis)
    x("thickness", "thickness")
    x("extrusion", "extrusion")


def _round(x: Fields) -> None:
    x.xyz(0)
    x("double", "radius")
    x("thickness", "thickness")
    x("extrusion", "extrusion")


def _arc(x: Fields) -> None:
    _round(x)
    x("double", "a0")
    x("double", "a1")


def _point(x: Fields) -> None:
    x.xyz(0)
    x("thickness", "thickness")
    x("extrusion", "extrusion")
    x("double", "rotation")


def _ellipse(x: Fields) -> None:
    x.xyz(0)
    x("point3", "axis", default=(1.0, 0.0, 0.0))
    x("point3", "extrusion", default=(0.0, 0.0, 1.0))
    for name, d in (("ratio", 1.0), ("a0", 0.0), ("a1", 2 * math.pi)):
        x("double", name, default=d)


def _text(x: Fields) -> None:
    """Bits of ``left_out`` say which fields are left out, in file order."""
    gone = x("u8", "left_out")
    if not gone & 1:
        x("f64", "z0")
    x.xy(0)
    if not gone & 2:
        for axis in "xy":
            x("double_from", f"align_{axis}", x.f[f"{axis}0"], default=x.f[f"{axis}0"])
    x("extrusion", "extrusion")
    x("thickness", "thickness")
    if not gone & 4:
        x("f64", "oblique")
    if not gone & 8:
        x("f64", "rotation")
    x("f64", "height")
    if not gone & 16:
        x("f64", "width_factor", default=1.0)
    x("text", "text")
    for bit, name in ((32, "generation"), (64, "h_align"), (128, "v_align")):
        if not gone & bit:
            x("short", name)


def _attrib(x: Fields) -> None:
    _text(x)
    x("text", "tag")
    x("short", "field_length")
    x("u8", "flags")


def _mtext(x: Fields) -> None:
    x.xyz(0)
    x("point3", "extrusion", default=(0.0, 0.0, 1.0))
    turn = x.f.get("rotation") or 0.0
    x("point3", "direction", default=(math.cos(turn), math.sin(turn), 0.0))
    x("double", "width")
    x("double", "height")
    x("short", "attachment", default=1)
    x("short", "flow", default=5)
    x("double", "extents_height")
    x("double", "extents_width")
    x("text", "text")
    x("short", "spacing_style")
    x("double", "spacing", default=1.0)
    x("flag", "unknown")
    if x.later and not x.reading:
        x("long", "background")


def _insert(x: Fields) -> None:
    x.xyz(0)
    s = [1.0 if x.f.get(k) is None else x.f[k] for k in ("sx", "sy", "sz")]
    form = x("bits2", "scales", default=3 if s == [1.0] * 3 else 2 if s[0] == s[1] == s[2] else 0)
    if form in (0, 2):
        x("f64", "sx")
    else:
        x.f["sx"] = 1.0
    if form in (0, 1):
        x("double_from", "sy", x.f["sx"], default=x.f["sx"])
        x("double_from", "sz", x.f["sx"], default=x.f["sx"])
    else:
        x.f["sy"] = x.f["sz"] = x.f["sx"]
    x("double", "rotation")
    x("point3", "extrusion", default=(0.0, 0.0, 1.0))
    if x("flag", "has_attribs") and x.later:
        x("long", "n_owned", default=max(0, len(x.f.get("parts") or ()) - 1))


def _minsert(x: Fields) -> None:
    _insert(x)
    for name in ("columns", "rows"):
        x("short", name, default=1)
    for name in ("column_step", "row_step"):
        x("double", name)


def _block(x: Fields) -> None:
    x("text", "name")


def _nothing(x: Fields) -> None:
    pass


def _vertex_2d(x: Fields) -> None:
    x("u8", "flags")
    x.xyz(0)
    if x("double", "width0") < 0:  # one negative width stands for both
        x.f["width0"] = x.f["width1"] = -x.f["width0"]
    else:
        x("double", "width1")
    x("double", "bulge")
    x("double", "tangent")


def _vertex(x: Fields) -> None:
    x("u8", "flags")
    x.xyz(0)


def _face_indices(x: Fields) -> None:
    for i in range(4):
        x("short", f"index{i}")


def _polyline_2d(x: Fields) -> None:
    x("short", "flags", default=int(bool(x.f.get("closed"))))
    x("short", "curve")
    x("double", "width0")
    x("double", "width1")
    x("thickness", "thickness")
    x("double", "elevation")
    x("extrusion", "extrusion")
    _owned(x)


def _owned(x: Fields) -> None:
    if x.later:
        x("long", "n_owned", default=max(0, len(x.f.get("parts") or ()) - 1))


def _polyline_3d(x: Fields) -> None:
    x("u8", "curve")
    x("u8", "flags", default=int(bool(x.f.get("closed"))))
    _owned(x)


def _shorts(*names: str) -> Callable[[Fields], None]:
    def layout(x: Fields) -> None:
        for name in names:
            x("short", name)

    return layout


def _dimension(*points: tuple[str, int], tail: tuple[str, ...] = ()) -> Callable[[Fields], None]:
    """The head that all dimensions share, then points (form, index) and doubles. Index 0 is the definition point, 1 and
    2 the measured ones, 3 the middle of the text."""

    def layout(x: Fields) -> None:
        x("point3", "extrusion", default=(0.0, 0.0, 1.0))
        x.xy(3)
        x("double", "elevation")
        x("u8", "flags")
        x("text", "text")
        x("double", "text_rotation")
        x("double", "horizontal")
        x("point3", "insert_scale", default=(1.0, 1.0, 1.0))
        x("double", "insert_rotation")
        x("short", "attachment", default=5)
        x("short", "spacing_style", default=1)
        x("double", "spacing", default=1.0)
        x("double", "measured")
        x("f64", "clone_x")
        x("f64", "clone_y")
        for form, i in points:
            getattr(x, form)(i)
        for name in tail:
            x("u8" if name == "ordinate" else "double", name)

    return layout


def _face(x: Fields) -> None:
    all_edges = x("flag", "all_edges", default=not x.f.get("hidden"))
    flat = x("flag", "flat", default=not x.f.get("z0"))
    x.xy(0)
    if flat:
        x.f["z0"] = 0.0
    else:
        x("f64", "z0")
    for i in (1, 2, 3):
        x.near(i, i - 1, "xyz")
    if not all_edges:
        x("short", "hidden")


def _solid(x: Fields) -> None:
    x("thickness", "thickness")
    x("double", "elevation")
    for i in range(4):
        x.xy(i)
    x("extrusion", "extrusion")


def _spline(x: Fields) -> None:
    fit = x("long", "scenario", default=1 if x.f.get("control") else 2) == 2
    x("long", "degree", default=3)
    if fit:
        x("double", "fit_tolerance")
        x("point3", "start_tangent", default=(0.0, 0.0, 0.0))
        x("point3", "end_tangent", default=(0.0, 0.0, 0.0))
        for i in x.count("n_fit", x.n_points()):
            x.xyz(i)
        return
    weighted = bool(x.f.get("weights"))
    x("flag", "rational", default=weighted)
    x("flag", "closed")
    x("flag", "periodic")
    x("double", "knot_tolerance")
    x("double", "control_tolerance")
    knots = x.count("n_knots", len(x.f.get("knots") or ()))
    control = x.count("n_control", len(x.f.get("control") or ()))
    weighted = x("flag", "weighted", default=weighted)
    x.listed("knots", knots)
    places, weights = ([], []) if x.reading else (x.f["control"], x.f.get("weights"))
    for i in control:
        if x.reading:
            places.append(x.bits.point3())
            weights += [x.bits.double()] if weighted else []
        else:
            x.bits.point3((*places[i], 0.0)[:3])
            if weighted:
                x.bits.double(weights[i])
    x.f["control"], x.f["weights"] = places, weights if weighted else None


def _way(x: Fields) -> None:
    x.xyz(0)
    x.xyz(1)


def _leader(x: Fields) -> None:
    x("flag", "unknown")
    x("short", "annotation")
    x("short", "path")
    for i in x.count("n_points", x.n_points()):
        x.xyz(i)
    for name, d in (("origin", (0.0, 0.0, 0.0)), ("extrusion", (0.0, 0.0, 1.0)), ("direction", (1.0, 0.0, 0.0)), ("offset", (0.0, 0.0, 0.0)), ("projection", (0.0, 0.0, 0.0))):
        x("point3", name, default=d)
    x("double", "box_height")
    x("double", "box_width")
    x("flag", "hook")
    x("flag", "arrow", default=True)
    x("short", "arrow_type")
    x("bits2", "unknown_tail")


def _mline(x: Fields) -> None:
    """Points are the vertices; each carries its direction, miter and the parameters of every line."""
    x("double", "scale", default=1.0)
    x("u8", "justification")
    x("point3", "base", default=(0.0, 0.0, 0.0))
    x("point3", "extrusion", default=(0.0, 0.0, 1.0))
    x("short", "open_closed", default=1)
    lines = x("u8", "n_lines")
    for i in x.count("n_points", x.n_points(), "short"):
        x.xyz(i)
        x("point3", f"direction{i}", default=(1.0, 0.0, 0.0))
        x("point3", f"miter{i}", default=(0.0, 1.0, 0.0))
        for j in range(lines):
            for part in ("segments", "fills"):
                x.listed(f"{part}{i}_{j}", x.count(f"n_{part}{i}_{j}", 0, "short"))


def _lwpolyline(x: Fields) -> None:
    """Flags: 1 extrusion, 2 thickness, 4 constant width, 8 elevation, 16 bulges, 32 widths, 512 closed."""
    bulges = x.f.get("bulges") or ()
    flags = x("short", "flags", default=(512 if x.f.get("closed") else 0) | (16 if any(bulges) else 0))
    for bit, kind, name in ((4, "double", "constant_width"), (8, "double", "elevation"), (2, "double", "thickness"), (1, "point3", "extrusion")):
        if flags & bit:
            x(kind, name)
    points = x.count("n_points", x.n_points())
    n_bulges = x.count("n_bulges", len(bulges)) if flags & 16 else range(0)
    widths = x.count("n_widths", 0) if flags & 32 else range(0)
    for i in points:
        if i:
            x.near(i, i - 1)
        else:
            x.xy(0)
    if flags & 16:
        x.listed("bulges", n_bulges)
    for i in widths:
        x("double", f"width{i}_0")
        x("double", f"width{i}_1")


def _hatch(x: Fields) -> None:
    """Elevation to boundary loops, which are written as polylines of a solid fill. Of loops of edges the starts of lines
    are kept. What follows the loops is not read."""
    if x.later:
        _gradient(x)
    x("double", "elevation")
    x("point3", "extrusion", default=(0.0, 0.0, 1.0))
    x("text", "name", default="SOLID")
    x("flag", "solid", default=True)
    x("flag", "associative")
    loops = x.count("n_paths", len(x.f.get("paths") or ()))
    if x.reading:
        x.f["paths"] = [_loop(x.bits) for _ in loops]
        return
    for points, bulges in x.f.get("paths") or ():
        bent = any(bulges or ())
        x.bits.long(3)  # an outer loop of one polyline
        x.bits.flag(bent)
        x.bits.flag(True)
        x.bits.long(len(points))
        for i, p in enumerate(points):
            x.bits.f64(p[0])
            x.bits.f64(p[1])
            if bent:
                x.bits.double(bulges[i])
        x.bits.long(0)
    x("short", "style")
    x("short", "pattern_type", default=1)
    x("long", "n_seeds")


def _gradient(x: Fields) -> None:
    x("long", "gradient")
    x("long", "reserved")
    x("double", "gradient_angle")
    x("double", "gradient_shift")
    x("long", "one_colour")
    x("double", "tint")
    for i in x.count("n_colours", 0):
        x("double", f"place{i}")
        x("short", f"index{i}")
        x("long", f"rgb{i}")
        x("u8", f"form{i}")
    x("text", "gradient_name")


def _loop(r: BitReader) -> tuple[list[tuple[float, float]], list[float]]:
    points, bulges = [], []
    if r.long() & 2:
        bent, _closed = r.flag(), r.flag()
        for _ in range(r.long()):
            points.append((r.f64(), r.f64()))
            bulges.append(r.double() if bent else 0.0)
    else:
        for _ in range(r.long()):
            if start := _edge(r):
                points.append(start)
                bulges.append(0.0)
    r.long()
    return points, bulges


def _edge(r: BitReader) -> tuple[float, float] | None:
    """Reads one boundary edge; the start of a line, None of other kinds."""
    kind = r.u8()
    if kind == 1:
        start = r.f64(), r.f64()
        r.f64(), r.f64()
        return start
    if kind in (2, 3):
        for _ in range(2 if kind == 2 else 4):
            r.f64()
        for _ in range(3):
            r.double()
        r.flag()
        return None
    if kind != 4:
        raise ValueError(f"edge of kind {kind}")
    r.long()
    rational, _periodic = r.flag(), r.flag()
    knots, control = r.long(), r.long()
    for _ in range(knots):
        r.double()
    for _ in range(control):
        r.f64(), r.f64()
        if rational:
            r.double()
    return None


def _layer(x: Fields) -> None:
    x("text", "name")
    x("flag", "referenced")
    x("short", "xref")
    x("flag", "dependent")
    x("short", "values")
    if not x.later:
        x("short", "color_index", default=7)
        return
    # the highest byte of the colour says what the rest is: 0xC3 an index, 0xC2 red, green and blue. Fixed values.
    x("short", "unused_index")
    value = x("long", "colour", default=0xC3 << 24 | (7 if x.f.get("color_index") is None else x.f["color_index"]))
    x("u8", "named")
    x.f["color_index"] = value & 0xFF if value >> 24 == 0xC3 else 256
    x.f["true_color"] = value & 0xFFFFFF if value >> 24 == 0xC2 else None


def _block_header(x: Fields) -> None:
    x("text", "name")
    x("flag", "referenced")
    x("short", "xref")
    for name in ("dependent", "anonymous", "has_attribs", "external", "overlaid", "loaded"):
        x("flag", name)
    _owned(x)
    x.xyz(0)
    x("text", "path")
    while x("u8", "insert"):  # one byte an insert, ended by zero
        pass
    x("text", "description")
    if n := x("long", "preview_size"):
        x.bits.raw(n)


def _dictionary(x: Fields) -> None:
    keys = x.f.get("keys") or []
    n = x.count("n_items", len(keys))
    x("short", "cloning", default=1)
    x("u8", "hard_owner")
    if x.reading:
        x.f["keys"] = [x.bits.text(x.codepage) for _ in n]
    else:
        for key in keys:
            x.bits.text(key, x.codepage)


LINEAR = (("xyz", 1), ("xyz", 2), ("xyz", 0))
LAYOUTS: dict[str, Callable[[Fields], None]] = {
    "LINE": _line, "CIRCLE": _round, "ARC": _arc, "POINT": _point, "ELLIPSE": _ellipse, "TEXT": _text, "ATTRIB": _attrib, "MTEXT": _mtext,
    "INSERT": _insert, "MINSERT": _minsert, "BLOCK": _block, "ENDBLK": _nothing, "SEQEND": _nothing, "VERTEX_2D": _vertex_2d, "VERTEX_3D": _vertex,
    "VERTEX_MESH": _vertex, "VERTEX_PFACE": _vertex, "VERTEX_PFACE_FACE": _face_indices, "POLYLINE_2D": _polyline_2d, "POLYLINE_3D": _polyline_3d,
    "POLYLINE_PFACE": _shorts("n_vertices", "n_faces"), "POLYLINE_MESH": _shorts("flags", "curve", "m", "n", "m_density", "n_density"),
    "DIM_ORDINATE": _dimension(("xyz", 0), ("xyz", 1), ("xyz", 2), tail=("ordinate",)),
    "DIM_LINEAR": _dimension(*LINEAR, tail=("oblique", "rotation")), "DIM_ALIGNED": _dimension(*LINEAR, tail=("oblique",)),
    "DIM_ANG3PT": _dimension(("xyz", 0), ("xyz", 1), ("xyz", 2), ("xyz", 4)), "DIM_ANG2LN": _dimension(("xy", 5), ("xyz", 1), ("xyz", 2), ("xyz", 4), ("xyz", 0)),
    "DIM_RADIUS": _dimension(("xyz", 0), ("xyz", 4), tail=("leader",)), "DIM_DIAMETER": _dimension(("xyz", 4), ("xyz", 0), tail=("leader",)),
    "3DFACE": _face, "SOLID": _solid, "TRACE": _solid, "SPLINE": _spline, "RAY": _way, "XLINE": _way, "LEADER": _leader, "MLINE": _mline,
    "LWPOLYLINE": _lwpolyline, "HATCH": _hatch, "LAYER": _layer, "BLOCK_HEADER": _block_header, "DICTIONARY": _dictionary,
}

def _extended_data(r: BitReader) -> None:
    while n := r.short():
        r.handle()
        r.raw(n)


def _colour(r: BitReader, f: dict[str, Any]) -> bool:
    """R2004: an index with flags in its high bits (alpha, book, red-green-blue); whether a book names the colour."""
    raw = r.short()
    f["color_index"] = raw & 0x1FF
    if raw & 0x2000:
        r.long()
    if raw & 0xC000 == 0x8000:
        f["true_color"] = r.long() & 0xFFFFFF
    return bool(raw & 0x4000)


def read(data: bytes, offset: int, codepage: str = "latin-1", version: str = "AC1015") -> dict[str, Any] | None:
    """The fields and references of the record at an offset, or None for a type without a layout.

    Damaged records raise ValueError: a number past the record's end, an impossible count, a reference of nine bytes.
    The layer of a colour-book entity is left out, as its place among the references is not settled.
    """
    r = BitReader(data, 8 * offset)
    size = r.modular_short()
    start = r.at
    if start + 8 * size > r.end:
        raise ValueError(f"record of {size} bytes at {offset} of {len(data)}")
    r.end = start + 8 * size
    name = NAMES.get(r.short())
    if name is None:
        return None
    refs_at = start + r.u32()
    handle = r.handle()[1]
    _extended_data(r)
    later = version == "AC1018"
    f: dict[str, Any] = {"type_name": name, "handle": handle, "mode": 2}
    bare = book = False
    if name in OBJECTS:
        f["reactors"] = r.long()
        bare = later and r.flag()
    else:
        if r.flag():
            r.raw(r.u32())
        f["mode"], f["reactors"] = r.bits(2), r.long()
        if later:
            bare, alone, book = r.flag(), True, _colour(r, f)
        else:
            alone, f["color_index"] = r.flag(), r.short()
        f["line_scale"], line_form, plot_form, f["invisible"], f["weight"] = r.double(), r.bits(2), r.bits(2), r.short(), r.u8()
    LAYOUTS[name](Fields(r, f, codepage, later))
    if not start < refs_at <= r.end:
        raise ValueError(f"references at bit {refs_at - start} of {8 * size}")
    r.at = refs_at

    def ref() -> int:
        return resolve_handle(*r.handle(), handle)

    f["owner"] = ref() if name in OBJECTS or f["mode"] == 0 else 0
    if f["reactors"] > r.end - r.at:
        raise ValueError(f"{f['reactors']} reactors")
    for _ in range(f["reactors"]):
        ref()
    if not bare:
        ref()  # the extension dictionary, null where there is none
    if name == "DICTIONARY":
        f["items"] = [ref() for _ in f["keys"]]
    if name in OBJECTS:
        return f
    if not alone:
        ref(), ref()  # the entities before and after
    f["layer"] = ref()
    for form in (line_form, plot_form):
        if form == 3:
            ref()
    if name in DIMENSIONS:
        ref()  # the style
    if name in ("INSERT", "MINSERT") or name in DIMENSIONS:
        f["block"] = ref()
    if book:
        f["layer"] = f["block"] = None
    return f


def write(f: dict[str, Any], codepage: str = "latin-1", version: str = "AC1015") -> bytes:
    """The payload after the type code of a record with these fields; ``read`` gives them back."""
    f, name, later = dict(f), f["type_name"], version == "AC1018"
    w, mode = BitWriter(), f.get("mode", 2)
    w.handle(0, f["handle"])
    w.short(0)
    if name in OBJECTS:
        w.long(0)
        if later:
            w.flag(True)
    else:
        w.flag(False)
        w.bits(mode, 2)
        w.long(0)
        w.flag(True)  # R2000: no entity before and after; R2004: no extension dictionary
        index, rgb = 256 if f.get("color_index") is None else f["color_index"], f.get("true_color")
        w.short(index if rgb is None or not later else 0x8000 | index)
        if later and rgb is not None:
            w.long(0xC2 << 24 | rgb)
        w.double(1.0 if f.get("line_scale") is None else f["line_scale"])
        w.bits(0, 4)
        w.short(f.get("invisible") or 0)
        w.u8(29 if f.get("weight") is None else f["weight"])  # 29: by layer
    LAYOUTS[name](Fields(w, f, codepage, later))
    refs_at = w.at
    if name in OBJECTS or mode == 0:
        w.handle(4, f.get("owner") or 0)
    if not later:
        w.handle(3, 0)
    for h in f.get("items") or ():
        w.handle(2, h)
    if name not in OBJECTS:
        w.handle(5, f.get("layer") or 0)
    if name in DIMENSIONS:
        w.handle(5, f.get("style") or 0)
    if name in ("INSERT", "MINSERT") or name in DIMENSIONS:
        w.handle(5, f.get("block") or 0)
    for h in f.get("parts") or ():  # vertices or attributes: the first, the last and the end of the sequence
        w.handle(3, h)
    head, code = BitWriter(), BitWriter()
    code.short(TYPE_CODES[name])
    head.u32(code.at + 32 + refs_at)
    head.bits(w.value, w.at)
    return head.done()

"""Rectangles, bands, viewports and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded


def overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """The area that two rectangles share."""
    w, h = F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def rect_key(page: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.concat_ws(":", page, *(rounded(v * 10) for v in (x, y, w, h)))


def band(x: Column, y: Column, angle: Column, length: Column, bottom: Column, top: Column) -> Column:
    """The rectangle around a band along a baseline."""
    ux, uy = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    xs = [x - uy * t + ux * s for t in (bottom, top) for s in (F.lit(0.0), length)]
    ys = [y + ux * t + uy * s for t in (bottom, top) for s in (F.lit(0.0), length)]
    left, low = F.least(*xs), F.least(*ys)
    return F.struct(left.alias("x"), low.alias("y"), (F.greatest(*xs) - left).alias("w"), (F.greatest(*ys) - low).alias("h"))


#: Fixed values, in ems: the removed middle of a line's glyphs (inset at the ends, bottom, top), and how far a cover reaches beyond them.
MIDDLE, COVER = (0.08, 0.18, 0.52), 0.12


def removal_band(x: Column, y: Column, angle: Column, width: Column, size: Column) -> Column:
    """The middle of a line's glyphs, kept clear of the lines above and below."""
    inset = F.when(width > size * 0.5, size * MIDDLE[0]).otherwise(0.0)
    return band(x + F.cos(F.radians(angle)) * inset, y + F.sin(F.radians(angle)) * inset, angle, F.greatest(F.lit(0.5), width - inset * 2), size * MIDDLE[1], size * MIDDLE[2])


def cover_band(x: Column, y: Column, angle: Column, width: Column, size: Column, ascent: Column, descent: Column) -> Column:
    """What is painted over where the glyphs are pixels."""
    pad = size * COVER
    return band(x - F.cos(F.radians(angle)) * pad, y - F.sin(F.radians(angle)) * pad, angle, width + pad * 2, descent * size - pad, ascent * size + pad)


def viewport(x1: Column, y1: Column, x2: Column, y2: Column, rotate: Column, scale: Column) -> Column:
    """The transform (a, b, c, d, e, f) from page to device, with width and height."""
    turn = F.pmod(rotate, F.lit(360))
    of = lambda at0, at90, at180, at270: F.when(turn == 180, at180).when(turn == 90, at90).when(turn == 270, at270).otherwise(at0).cast("double")
    a, b, c, d = of(1, 0, -1, 0), of(0, 1, 0, -1), of(0, 1, 0, -1), of(-1, 0, 1, 0)
    cx, cy, side = (x1 + x2) / 2, (y1 + y2) / 2, (turn == 90) | (turn == 270)
    ox, oy = F.when(side, F.abs(cy - y1)).otherwise(F.abs(cx - x1)) * scale, F.when(side, F.abs(cx - x1)).otherwise(F.abs(cy - y1)) * scale
    e, f = ox - a * scale * cx - c * scale * cy, oy - b * scale * cx - d * scale * cy
    w, h = F.when(side, y2 - y1).otherwise(x2 - x1) * scale, F.when(side, x2 - x1).otherwise(y2 - y1) * scale
    return F.struct(F.array(a * scale, b * scale, c * scale, d * scale, e, f).alias("m"), w.alias("width"), h.alias("height"))


def applied(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def inverted(m: Column) -> Column:
    det = m[0] * m[3] - m[1] * m[2]
    return F.array(m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det)


def mapped_box(m: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box around a rectangle's four corners after a transform."""
    corners = [applied(m, px, py) for px in (x, x + w) for py in (y, y + h)]
    left, top = F.least(*(p[0] for p in corners)), F.least(*(p[1] for p in corners))
    return F.struct(left.alias("left"), top.alias("top"), (F.greatest(*(p[0] for p in corners)) - left).alias("width"), (F.greatest(*(p[1] for p in corners)) - top).alias("height"))


def page_size(w: Column, h: Column, size: str, orientation: str) -> Column:
    """Page width and height for an image; fixed values: points of the two paper sizes."""
    paper = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}
    if size == "auto":
        return F.struct(w.cast("double").alias("w"), h.cast("double").alias("h"))
    short, long = paper[size]
    turned = F.lit(orientation == "landscape") | (F.lit(orientation == "auto") & (w > h))
    return F.struct(F.when(turned, long).otherwise(short).alias("w"), F.when(turned, short).otherwise(long).alias("h"))


def draw_size(w: Column, h: Column, page_w: Column, page_h: Column, margin: float, fit: str) -> Column:
    if fit == "original":
        return F.struct(w.cast("double").alias("w"), h.cast("double").alias("h"))
    by_w, by_h = (page_w - 2 * margin) / w, (page_h - 2 * margin) / h
    scale = F.greatest(by_w, by_h) if fit == "fill" else F.least(by_w, by_h)
    return F.struct((w * scale).alias("w"), (h * scale).alias("h"))


def clamped(w: Column, h: Column, most: int) -> Column:
    """Width and height scaled down to at most `most`, each at least 1."""
    scale = F.least(F.lit(most) / w, F.lit(most) / h)
    one = lambda v: F.when((w <= most) & (h <= most), v.cast("long")).otherwise(F.greatest(F.lit(1), rounded(v * scale)).cast("long"))
    return F.struct(one(w).alias("w"), one(h).alias("h"))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    part = lambda v: F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), rounded(v))).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def hex_rgb(said: Column) -> Column:
    clean = F.replace(said, F.lit("#"), F.lit(""))
    full = F.when(F.length(clean) == 3, F.regexp_replace(clean, "(.)", "$1$1")).otherwise(clean)
    n = F.coalesce(F.conv(full, 16, 10).cast("long"), F.lit(0))
    return F.array(*(F.shiftright(n, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def chroma(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def distance(r: Column, g: Column, b: Column, to: tuple[int, int, int]) -> Column:
    return F.sqrt((r - to[0]) * (r - to[0]) + (g - to[1]) * (g - to[1]) + (b - to[2]) * (b - to[2]))


#: Fixed values: (level, chroma) below which ink is black, and from which on paper is white.
INK, PAPER = (22, 10), (246, 6)


def is_black(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) < INK[0]) & (chroma(r, g, b) < INK[1])


def is_white(r: Column, g: Column, b: Column) -> Column:
    return (F.least(r, g, b) > PAPER[0]) & (chroma(r, g, b) < PAPER[1])


def as_rgb(color: Column) -> Column:
    """Red, green and blue (0 to 1) of a colour given as gray, RGB or CMYK by its number of components; black for others."""
    ink = lambda k: (1 - color[k]) * (1 - color[3])
    return (
        F.when(F.size(color) == 1, F.array(color[0], color[0], color[0])).when(F.size(color) == 3, color)
        .when(F.size(color) == 4, F.array(ink(0), ink(1), ink(2))).otherwise(F.array(*[F.lit(0.0)] * 3))
    )


def color_key(rgb: Column) -> Column:
    return F.array_join(F.transform(rgb, lambda v: rounded(v * 255).cast("string")), ",")


def union_of(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The rectangle around all rectangles of a group."""
    left, low = F.min(x), F.min(y)
    return F.struct(left.alias("x"), low.alias("y"), (F.max(x + w) - left).alias("w"), (F.max(y + h) - low).alias("h"))


def expanded(r: Column, by: float) -> Column:
    return F.struct((r["x"] - by).alias("x"), (r["y"] - by).alias("y"), (r["w"] + 2 * by).alias("w"), (r["h"] + 2 * by).alias("h"))


def text_frame(m: Column, x: Column, y: Column, angle: Column) -> Column:
    """Where a text that starts at a page's point lands on the device, and its turn there, clockwise."""
    left, top = applied(m, x, y)
    rad = F.radians(angle)
    dx, dy = m[0] * F.cos(rad) + m[2] * F.sin(rad), m[1] * F.cos(rad) + m[3] * F.sin(rad)
    return F.struct(left.alias("left"), top.alias("top"), F.degrees(F.atan2(dy, dx)).alias("rotation"))


def moved_on_page(m: Column, dx: Column, dy: Column) -> Column:
    """How far a move on the device moves a thing on the page."""
    inv = inverted(m)
    (x0, y0), (x1, y1) = applied(inv, F.lit(0.0), F.lit(0.0)), applied(inv, dx, dy)
    return F.struct((x1 - x0).alias("x"), (y1 - y0).alias("y"))


#: Fixed value: the least side of a box that is dragged smaller, in pixels.
LEAST = 6.0


def dragged(m: Column, x: Column, y: Column, w: Column, h: Column, dx: Column, dy: Column, resize: Column, keep: Column) -> Column:
    """A page's rectangle after its box on the device is moved by (dx, dy), or resized at its lower right corner; `keep` holds the shape, as of images."""
    box = mapped_box(m, x, y, w, h)
    wide = F.greatest(F.lit(LEAST), box["width"] + dx)
    high = F.when(keep, wide / (box["width"] / F.greatest(F.lit(1.0), box["height"]))).otherwise(F.greatest(F.lit(LEAST), box["height"] + dy))
    left, top = box["left"] + F.when(resize, 0.0).otherwise(dx), box["top"] + F.when(resize, 0.0).otherwise(dy)
    back = mapped_box(inverted(m), left, top, F.when(resize, wide).otherwise(box["width"]), F.when(resize, high).otherwise(box["height"]))
    return F.struct(back["left"].alias("x"), back["top"].alias("y"), back["width"].alias("w"), back["height"].alias("h"))


def thumbnail(w: Column, h: Column, most_w: int, most_h: int) -> Column:
    """Width and height in whole pixels of a page scaled into a box."""
    scale = F.least(F.lit(most_w) / w, F.lit(most_h) / h)
    return F.struct(F.ceil(w * scale).alias("w"), F.ceil(h * scale).alias("h"))


def centred(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    return F.struct(((page_w - w) / 2).alias("x"), ((page_h - h) / 2).alias("y"))

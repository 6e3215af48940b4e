"""Colors of groups and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid_hex(color: Column) -> Column:
    """Seven characters, of which the last six are hexadecimal."""
    return color.rlike(r"\A.[0-9A-Fa-f]{6}\z")


def _part(color: Column, at: int) -> Column:
    return F.conv(F.substring(color, at, 2), 16, 10).cast("int")


def hex_to_rgb(color: Column) -> Column:
    return F.struct(_part(color, 2).alias("r"), _part(color, 4).alias("g"), _part(color, 6).alias("b"))


def brightness(color: Column) -> Column:
    return (299 * _part(color, 2) + 587 * _part(color, 4) + 114 * _part(color, 6)) / 1000


def saturation(color: Column) -> Column:
    rgb = [_part(color, k) for k in (2, 4, 6)]
    top, low = F.greatest(*rgb), F.least(*rgb)
    return F.when(top > 0, (top - low) / top).otherwise(0.0)


def text_color(color: Column) -> Column:
    """Black on light colors, and for black itself; white on others."""
    light = 0.299 * _part(color, 2) + 0.587 * _part(color, 4) + 0.114 * _part(color, 6) > 186
    return F.when(light | (F.lower(color) == "#000000"), "#000000").otherwise("#FFFFFF")


#: Hashes of a key that are looked at together: most keys have a color among the first two.
STEPS = (0, 2, 6, 14, 30)


def assign_color(key: Column, tries: int = 64) -> Column:
    """The first acceptable color among the hashes of a key: neither dark nor pale nor grey.

    Hashes are made in steps, further ones only where those before have none.
    """
    color = lambda i: F.concat(F.lit("#"), F.substring(F.md5(F.concat_ws(":", key, i.cast("string"))), 1, 6))
    colors = lambda low, high: F.transform(F.sequence(F.lit(low), F.lit(high - 1)), color)
    fits = lambda c: (brightness(c) > 127) & (brightness(c) < 300) & (saturation(c) > 0.3) & (saturation(c) < 0.8)
    edges = [*(s for s in STEPS if s < tries), tries]
    return F.coalesce(*[F.try_element_at(F.filter(colors(a, b), fits), F.lit(1)) for a, b in zip(edges, edges[1:], strict=False)], color(F.lit(0)))


def dot_alpha(significant: Column, color: Column) -> Column:
    """Opacity of a dot: faint unless significant, less for black."""
    return F.when(~significant, 0.25).when(F.lower(color) == "#000000", 0.75).otherwise(0.9)

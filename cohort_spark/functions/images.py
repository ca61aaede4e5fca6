"""Grey values of an image that is one list of pixels in a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort_spark.functions.text import col, windowed

# Three windows (name, centre, width) of each body region.
REGION_WINDOWS = {
    "thorax": (("lung", -600.0, 1500.0), ("mediastinum", 40.0, 400.0), ("bone", 300.0, 1500.0)),
    "thorax_abdomen": (("lung", -600.0, 1500.0), ("soft_tissue", 50.0, 400.0), ("bone", 300.0, 1500.0)),
    "abdomen_pelvis": (("soft_tissue", 50.0, 400.0), ("abdomen_detail", 60.0, 180.0), ("bone", 300.0, 1500.0)),
    "head_neck": (("soft_tissue", 50.0, 350.0), ("neck_detail", 60.0, 180.0), ("bone", 300.0, 1500.0)),
    "mixed_sarc": (("soft_tissue", 50.0, 400.0), ("bone", 300.0, 1500.0), ("wide_detail", 50.0, 800.0)),
    "generic": (("soft_tissue", 50.0, 400.0), ("bone", 300.0, 1500.0), ("wide_detail", 50.0, 800.0)),
}


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def pixel_values(pixels) -> Column:
    return F.transform(col(pixels), lambda x: x.cast("double"))


def masked_pixels(pixels, padding=None) -> Column:
    """Pixels as doubles, null where they are padding, null or not finite; without a mask none is padding."""
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    values = pixel_values(pixels)
    if padding is None:
        return F.transform(values, finite)
    return F.zip_with(values, col(padding), lambda x, p: F.when(~F.coalesce(p, F.lit(False)), finite(x)))


def order_statistic(ordered: Column, share: float) -> Column:
    """The linearly interpolated quantile of a sorted list without nulls; null if it is empty."""
    spot = (F.size(ordered) - 1) * F.lit(float(share))
    at = lambda f: F.get(ordered, f(spot).cast("int"))
    return F.when(F.size(ordered) > 0, at(F.floor) + (at(F.ceil) - at(F.floor)) * (spot - F.floor(spot)))


def rescaled(pixels, padding=None, low: float = 0.01, high: float = 0.99) -> Column:
    """Pixels between two quantiles of the image scaled to 0..255, halves to even, as a list of ints.

    Quantiles are taken over finite pixels that are not padding. If they are
    equal the least and largest such pixel serve; if these are equal, too, or
    there is none, all is 0. Padding, null and NaN become 0; infinite pixels are
    clipped. A null image is null.
    """
    valid = F.array_sort(F.filter(masked_pixels(pixels, padding), lambda x: x.isNotNull()))

    def limits(xs: Column) -> Column:
        inner, outer = F.struct(order_statistic(xs, low).alias("lo"), order_statistic(xs, high).alias("hi")), F.struct(F.get(xs, F.lit(0)).alias("lo"), F.get(xs, F.size(xs) - 1).alias("hi"))
        return bound(inner, lambda i: F.when(i["hi"] > i["lo"], i).otherwise(outer))

    def grey(b: Column) -> Column:
        clipped = lambda x: F.least(F.greatest(x, b["lo"]), b["hi"])
        scaled = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (b["hi"] > b["lo"]), F.rint((clipped(x) - b["lo"]) / (b["hi"] - b["lo"]) * 255).cast("int")).otherwise(0)
        return without_padding(F.transform(pixel_values(pixels), scaled), padding)

    return F.when(col(pixels).isNotNull(), bound(bound(valid, limits), grey))


def without_padding(grey: Column, padding=None) -> Column:
    """Grey values with 0 where the mask is set."""
    return grey if padding is None else F.zip_with(grey, col(padding), lambda g, p: F.when(F.coalesce(p, F.lit(False)), 0).otherwise(g))


def window_channels(pixels, windows: Sequence[tuple[str, float, float]], padding=None) -> Column:
    """One list of grey values for each of the first three windows (name, centre, width); padding, null and NaN are 0."""
    shown = lambda c, w: F.transform(pixel_values(pixels), lambda x: F.when(x.isNotNull() & ~F.isnan(x), windowed(x, c, w)).otherwise(0))
    return F.array(*[without_padding(shown(c, w), padding) for _, c, w in windows[:3]])


def region_channels(pixels, region, padding=None) -> Column:
    """``window_channels`` with the windows of the row's body region; an unknown region has the generic ones."""
    out = window_channels(pixels, REGION_WINDOWS["generic"], padding)
    for name, windows in REGION_WINDOWS.items():
        out = F.when(col(region) == name, window_channels(pixels, windows, padding)).otherwise(out)
    return out

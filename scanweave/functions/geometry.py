"""Boxes and regions.  Pixel values are INT, fractions are DOUBLE."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.text import let


def as_column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def roi(x1, y1, x2, y2) -> Column:
    return F.struct(
        x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
        x2.cast("int").alias("x2"), y2.cast("int").alias("y2"),
    )


EDGES = ("x1", "y1", "x2", "y2")


def packed_roi(edges) -> Column:
    """Four edges for a shuffle: in one number if they are 0 to 65535, else as they are."""
    fit = functools.reduce(Column.__and__, [e.between(0, 65535) for e in edges])
    short = functools.reduce(Column.bitwiseOR, [F.shiftleft(e.cast("long"), 16 * i) for i, e in enumerate(edges)])
    return F.struct(F.when(fit, short).alias("short"), F.when(~F.coalesce(fit, F.lit(False)), roi(*edges)).alias("wide"))


def unpacked_edges(packed: Column) -> list[Column]:
    """The edges of a packed region."""
    def edge(i, name):
        short = F.shiftrightunsigned(packed["short"], 16 * i).bitwiseAND(F.lit(65535)).cast("int")
        return F.coalesce(short, packed["wide"][name]).alias(name)

    return [edge(i, name) for i, name in enumerate(EDGES)]


def box_bounds(box: Column) -> Column:
    """Bounding region of a corner list, truncated to pixels; NULL for no box."""
    xs, ys = box["x"], box["y"]
    return F.when(
        F.size(box) > 0, roi(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    )


def fraction_to_pixels(window, width: Column, height: Column) -> Column:
    """Fractional window to pixels, truncating like an int conversion."""
    x1, y1, x2, y2 = [as_column(v) for v in window]
    return roi(x1 * width, y1 * height, x2 * width, y2 * height)


def template_rois(templates=None) -> Column:
    """Array of (field, x1, y1, x2, y2) literals; ``templates`` is a map of four fractions."""
    rows = (templates or K.DEFAULT_ROIS).items()
    return F.array(*[
        F.struct(F.lit(f).alias("field"), *[F.lit(float(v)).alias(n)
                 for n, v in zip(("x1", "y1", "x2", "y2"), box)])
        for f, box in rows
    ])


def fixed_rois(width: Column, height: Column, templates: Column = None) -> Column:
    templates = template_rois() if templates is None else templates
    return F.transform(templates, lambda t: F.struct(
        t["field"].alias("field"),
        fraction_to_pixels((t["x1"], t["y1"], t["x2"], t["y2"]), width, height).alias("roi"),
    ))


def shifted_rois(width: Column, height: Column, scale: Column, offset: Column,
                 templates: Column = None) -> Column:
    """Template regions moved by the fitted vertical transform.  NULL unless every region
    is at least 12 pixels high and the fields keep their order down the page."""
    templates = template_rois() if templates is None else templates

    def moved(t, fit):
        top = F.bround(height * t["y1"] * fit["scale"] + fit["offset"]).cast("int")
        low = F.bround(height * t["y2"] * fit["scale"] + fit["offset"]).cast("int")
        y1 = F.greatest(F.lit(0), F.least(height.cast("int") - 2, top))
        y2 = F.greatest(y1 + 1, F.least(height.cast("int"), low))
        return F.struct(t["field"].alias("field"),
                        roi(width * t["x1"], y1, width * t["x2"], y2).alias("roi"))

    def checked(rs):
        tall = ~F.exists(rs, lambda r: r["roi"]["y2"] - r["roi"]["y1"] < 12)
        tops = F.transform(
            F.array_sort(F.filter(F.transform(rs, lambda r: F.struct(
                F.array_position(F.array(*[F.lit(f) for f in K.FIELD_ORDER]), r["field"]).alias("o"),
                r["roi"]["y1"].alias("y"))), lambda r: r["o"] > 0)),
            lambda r: r["y"],
        )
        return F.when(tall & (tops == F.array_sort(tops)), rs)

    fit = F.struct(scale.alias("scale"), offset.alias("offset"))
    return let(let(fit, lambda f: F.transform(templates, lambda t: moved(t, f))), checked)


def choose_rois(dynamic_clean: Column, dynamic_base: Column, fixed: Column) -> Column:
    """Layout of the cleaned page, else of the base page, else the fixed template."""
    return F.coalesce(dynamic_clean, dynamic_base, fixed)


def contains_center(region: Column, box: Column) -> Column:
    cx, cy = (box["x1"] + box["x2"]) / 2.0, (box["y1"] + box["y2"]) / 2.0
    return (
        (cx >= region["x1"]) & (cx < region["x2"]) & (cy >= region["y1"]) & (cy < region["y2"])
    )


#: regions to try as (left, top, right, bottom): 0 the edge of the base, 1 grown, 2 cut
CANDIDATE_MOVES = [
    (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (0, 1, 0, 0), (0, 0, 0, 1), (1, 1, 1, 1), (2, 0, 0, 0), (0, 2, 0, 0),
    (2, 2, 0, 0), (0, 0, 2, 0), (0, 0, 0, 2), (2, 0, 1, 0), (0, 2, 0, 1),
]


def with_candidate_rois(regions: DataFrame, field: Column, base: Column, width, height) -> DataFrame:
    """Adds ``rois``: the base region and its grown and shrunk variants within the page, distinct,
    first kept.  Variants with less than 12 pixels on an axis appear as one NULL, to be dropped
    after the array is exploded.  The variants share three places per edge; these are exploded
    first, so that they are worked out once and the generated code stays small."""
    width, height = as_column(width), as_column(height)

    sides = ("px", "py", "qx", "qy")
    pads = F.create_map(*[v for f, shares in K.FIELD_PADDING.items() for v in (
        F.lit(f), F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(sides, shares)]))])

    def once(rows, name, *columns):
        return rows.withColumn(name, F.explode(F.array(F.struct(*columns))))

    def step(axis, least, share):
        size = F.greatest(F.lit(1), F.col(f"_b.{axis}2") - F.col(f"_b.{axis}1"))
        return F.greatest(F.lit(least), (size * F.col(f"_b.p.{share}{axis}")).cast("int")).alias(f"{share}{axis}")

    rows = once(regions, "_b", *[base[e].alias(e) for e in ("x1", "y1", "x2", "y2")], F.try_element_at(pads, field).alias("p"))
    rows = once(rows, "_s", step("x", 4, "p"), step("y", 4, "p"), step("x", 3, "q"), step("y", 3, "q"))

    def places(axis, size):
        low, high, wide, cut = F.col(f"_b.{axis}1"), F.col(f"_b.{axis}2"), F.col(f"_s.p{axis}"), F.col(f"_s.q{axis}")
        starts = [F.greatest(F.lit(0), F.least(size - 1, v)) for v in (low, low - wide, low + cut)]
        stops = [F.least(size, v) for v in (high, high + wide, high - cut)]
        return [c.alias(f"{axis}{edge}{i}") for edge, cs in (("1", starts), ("2", stops)) for i, c in enumerate(cs)]

    rows = once(rows, "_p", *places("x", width), *places("y", height))

    def variant(*move):
        return F.struct(*[F.col(f"_p.{e}{i}").alias(e) for e, i in zip(("x1", "y1", "x2", "y2"), move)])

    def whole(left, top, right, bottom):
        wide, tall = F.col(f"_p.x2{right}") - F.col(f"_p.x1{left}"), F.col(f"_p.y2{bottom}") - F.col(f"_p.y1{top}")
        return F.when((wide >= 12) & (tall >= 12), variant(left, top, right, bottom))

    rois = F.array(*[whole(*m) for m in CANDIDATE_MOVES])
    return rows.withColumn("rois", F.array_distinct(rois)).drop("_b", "_s", "_p")


def roi_distance(region: Column, base: Column) -> Column:
    movement = sum(
        (F.abs(region[n] - base[n]) for n in ("x1", "y1", "x2", "y2")), F.lit(0)
    )
    return movement / F.greatest(
        F.lit(1), (base["x2"] - base["x1"]) + (base["y2"] - base["y1"])
    )


def checkbox_window(label: Column, page_height: Column) -> Column:
    """Where the tick box of a gender label is: left of the label, in label heights."""
    h = F.greatest(F.lit(1), label["y2"] - label["y1"])
    left = F.greatest(F.lit(0), label["x1"] - (h * 1.45).cast("int"))
    return roi(
        left,
        F.greatest(F.lit(0), label["y1"] - (h * 0.2).cast("int")),
        F.greatest(left + 1, label["x1"] - (h * 0.12).cast("int")),
        F.least(page_height, label["y2"] + (h * 0.12).cast("int")),
    )


def named_windows(windows, width: Column, height: Column) -> Column:
    """Array of (name, roi) for a map or list of fractional windows."""
    rows = windows.items() if isinstance(windows, dict) else enumerate(windows)
    return F.array(*[
        F.struct(F.lit(k).alias("name"), fraction_to_pixels(v, width, height).alias("roi"))
        for k, v in rows
    ])


def is_dob_box(w: Column, h: Column, crop_w: Column, crop_h: Column) -> Column:
    """Is a rectangle one of the date's digit boxes, by size and shape?"""
    min_w = F.greatest(F.lit(18), (crop_w * 0.04).cast("int"))
    max_w = F.greatest(min_w + 1, (crop_w * 0.09).cast("int"))
    min_h = F.greatest(F.lit(18), (crop_h * 0.35).cast("int"))
    max_h = F.greatest(min_h + 1, (crop_h * 0.8).cast("int"))
    return w.between(min_w, max_w) & h.between(min_h, max_h) & (w / h).between(0.75, 1.3)


def fixed_dob_boxes(crop_w: Column, crop_h: Column) -> Column:
    """The eight fixed digit boxes when the crop is large enough, else none."""
    boxes = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("x", "y", "w", "h"), b)])
        for b in K.DOB_FIXED_BOXES
    ])
    return F.when(
        (crop_w >= K.DOB_FIXED_MIN_WIDTH) & (crop_h >= K.DOB_FIXED_MIN_HEIGHT), boxes
    ).otherwise(F.slice(boxes, 1, 0))


def dedupe_boxes(boxes: Column, tolerance: int = 4) -> Column:
    """Sorted (x, y, w, h) boxes; within ``tolerance`` of the last kept one the larger stays."""

    def step(kept, b):
        last = F.try_element_at(kept, F.lit(-1))
        head = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        close = F.coalesce(F.abs(b["x"] - last["x"]) <= tolerance, F.lit(False))
        larger = b["w"] * b["h"] > last["w"] * last["h"]
        return (
            F.when(close & larger, F.concat(head, F.array(b)))
            .when(close, kept)
            .otherwise(F.concat(kept, F.array(b)))
        )

    ordered = F.array_sort(boxes)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def drag_box(x_from: Column, y_from: Column, x_to: Column, y_to: Column) -> Column:
    """Calibration drag to a fractional region: corners ordered and kept within the page."""
    ax, ay, bx, by = [
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in (x_from, y_from, x_to, y_to)
    ]
    return F.struct(
        F.least(ax, bx).alias("x1"), F.least(ay, by).alias("y1"),
        F.greatest(ax, bx).alias("x2"), F.greatest(ay, by).alias("y2"),
    )

"""Box algebra as Column expressions (no Python in the data path)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


@dataclass(frozen=True)
class Box:
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @classmethod
    def of(cls, parent: str | None = None, names=BOX) -> "Box":
        """Box columns of the frame, or the fields of a struct column ``parent``."""
        return cls(*(F.col(f"{parent}.{n}" if parent else n) for n in names))

    def columns(self, names=BOX) -> dict[str, Column]:
        return dict(zip(names, (self.xmin, self.ymin, self.xmax, self.ymax)))

    def width(self, plus: int = 0) -> Column:
        return self.xmax - self.xmin + plus if plus else self.xmax - self.xmin

    def height(self, plus: int = 0) -> Column:
        return self.ymax - self.ymin + plus if plus else self.ymax - self.ymin

    def area(self, plus: int = 0) -> Column:
        return self.width(plus) * self.height(plus)

    def scale(self, y: Column | float, x: Column | float) -> "Box":
        return Box(self.xmin * x, self.ymin * y, self.xmax * x, self.ymax * y)

    def shift(self, x: Column | float, y: Column | float) -> "Box":
        return Box(self.xmin + x, self.ymin + y, self.xmax + x, self.ymax + y)

    def clip(self, window: "Box") -> "Box":
        def between(v, lo, hi):
            return F.greatest(F.least(v, hi), lo)

        return Box(
            between(self.xmin, window.xmin, window.xmax),
            between(self.ymin, window.ymin, window.ymax),
            between(self.xmax, window.xmin, window.xmax),
            between(self.ymax, window.ymin, window.ymax),
        )

    def change_frame(self, window: "Box") -> "Box":
        """Express the box in coordinates where ``window`` is the unit square."""
        w, h = window.width(), window.height()
        return Box(
            (self.xmin - window.xmin) / w,
            (self.ymin - window.ymin) / h,
            (self.xmax - window.xmin) / w,
            (self.ymax - window.ymin) / h,
        )

    def flip_left_right(self) -> "Box":
        return Box(1 - self.xmax, self.ymin, 1 - self.xmin, self.ymax)

    def flip_up_down(self) -> "Box":
        return Box(self.xmin, 1 - self.ymax, self.xmax, 1 - self.ymin)

    def rot90(self) -> "Box":
        """Rotate normalised boxes by 90 degrees counter-clockwise."""
        return Box(self.ymin, 1 - self.xmax, self.ymax, 1 - self.xmin)

    def undo_rot90_clockwise(self) -> "Box":
        """Boxes found on a clockwise-rotated tile, back on the original tile."""
        return Box(self.ymin, 1 - self.xmax, self.ymax, 1 - self.xmin)

    def undo_mirror(self) -> "Box":
        """Mirror x without re-ordering corners, as done for flipped tiles."""
        return Box(1 - self.xmin, self.ymin, 1 - self.xmax, self.ymax)

    def sanitize(self) -> "Box":
        """Swap inverted corners and clamp to the unit square."""
        def unit(v):
            return F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))

        return Box(
            unit(F.least(self.xmin, self.xmax)),
            unit(F.least(self.ymin, self.ymax)),
            unit(F.greatest(self.xmin, self.xmax)),
            unit(F.greatest(self.ymin, self.ymax)),
        )

    def erode(self, e: int) -> "Box":
        """Shrink by ``e`` on every side; corners that cross are re-ordered."""
        x0, x1, y0, y1 = self.xmin + e, self.xmax - e, self.ymin + e, self.ymax - e
        return Box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))

    def grow(self, m: int, width: int, height: int) -> "Box":
        """Grow by ``m`` on every side, staying inside the image."""
        return Box(
            F.greatest(self.xmin - m, F.lit(0)),
            F.greatest(self.ymin - m, F.lit(0)),
            F.least(self.xmax + m, F.lit(width)),
            F.least(self.ymax + m, F.lit(height)),
        )

    def inside(self, window: "Box") -> Column:
        return (
            (self.xmin >= window.xmin)
            & (self.ymin >= window.ymin)
            & (self.xmax <= window.xmax)
            & (self.ymax <= window.ymax)
        )

    def inside_half_open(self, window: "Box") -> Column:
        return (
            (self.xmin >= window.xmin)
            & (self.ymin >= window.ymin)
            & (self.xmax < window.xmax)
            & (self.ymax < window.ymax)
        )

    def outside(self, window: "Box") -> Column:
        """Completely outside; sharing only an edge counts as outside."""
        return (
            (self.xmin >= window.xmax)
            | (self.ymin >= window.ymax)
            | (self.xmax <= window.xmin)
            | (self.ymax <= window.ymin)
        )


def window(xmin, ymin, xmax, ymax) -> Box:
    return Box(*(v if isinstance(v, Column) else F.lit(v) for v in (xmin, ymin, xmax, ymax)))


def center_floor(lo: Column, hi: Column) -> Column:
    return F.floor((lo + hi) / 2)


def center_rint(lo: Column, hi: Column) -> Column:
    """Centre rounded half to even."""
    return F.rint((lo + hi) / 2).cast("long")


def intersection(a: Box, b: Box, plus: int = 0) -> Column:
    w = F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin) + plus
    h = F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin) + plus
    zero = F.lit(0)
    return F.greatest(w, zero) * F.greatest(h, zero)


def iou(a: Box, b: Box, plus: int = 0) -> Column:
    """Intersection over union; 0 where both areas are 0."""
    inter = intersection(a, b, plus)
    union = a.area(plus) + b.area(plus) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the area of the *second* box."""
    return F.when(b.area() > 0, intersection(a, b) / b.area()).otherwise(F.lit(0.0))


def sq_dist(a: Box, b: Box) -> Column:
    dx0, dy0, dx1, dy1 = a.xmin - b.xmin, a.ymin - b.ymin, a.xmax - b.xmax, a.ymax - b.ymax
    return dx0 * dx0 + dy0 * dy0 + dx1 * dx1 + dy1 * dy1


def enclosing(a: Box, b: Box) -> Box:
    return Box(
        F.least(a.xmin, b.xmin),
        F.least(a.ymin, b.ymin),
        F.greatest(a.xmax, b.xmax),
        F.greatest(a.ymax, b.ymax),
    )


def to_xywh(b: Box) -> dict[str, Column]:
    return {"x": b.xmin, "y": b.ymin, "w": b.width(), "h": b.height()}


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def thresholded_score(similarity: Column, threshold: float, score: Column) -> Column:
    """``score`` where the similarity reaches the threshold, else 0."""
    return F.when(similarity >= threshold, score).otherwise(F.lit(0.0))


SIMILARITIES = {
    "iou": iou,
    "ioa": ioa,
    "neg_sq_dist": lambda a, b: -sq_dist(a, b),
}


def similarity(name: str):
    """Look up a pair similarity by name."""
    try:
        return SIMILARITIES[name]
    except KeyError:
        raise ValueError(f"unknown similarity {name!r}; choose from {sorted(SIMILARITIES)}") from None

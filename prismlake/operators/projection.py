"""Views of 2-D and 3-D coordinates: normalisation, screen transform, spatial picking, framing, camera."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells per axis of the spatial grid, reach of a pick in pixels, shares of the screen.
GRID, REACH, FILL = 128, 11.0, 0.9
#: The camera's start, limits, speeds and lens.
YAW, PITCH, DISTANCE = 0.36, 0.24, 3.25
NEAREST, FARTHEST, STEEPEST = 0.16, 12.0, math.pi / 2 - 0.055
FIELD_OF_VIEW = 46 * math.pi / 180
TURN, PADDING, LEAST_RADIUS = 0.006, 1.16, 0.015
NEAR_PLANE, FAR_PLANE, EDGE = 0.025, 40.0, 1.08
#: Zoom limits and speed of the 2-D view.
LEAST_ZOOM, MOST_ZOOM, WHEEL = 0.65, 28.0, 0.0012


def bounds(rows: DataFrame, axes: list[str]) -> DataFrame:
    return rows.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def unit_radius(rows: DataFrame, axes: list[str]) -> DataFrame:
    """Coordinates around their mean, the farthest at distance 1; raises if all coincide."""
    centre = rows.agg(*[F.avg(a).alias(f"c_{a}") for a in axes])
    c = rows.crossJoin(F.broadcast(centre))
    moved = c.select(*[x for x in rows.columns if x not in axes], *[(F.col(a) - F.col(f"c_{a}")).alias(a) for a in axes])
    size = F.sqrt(sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0)))
    radius = moved.agg(F.max(size).alias("radius"))
    r = F.when(F.col("radius") > 0, F.col("radius")).otherwise(F.raise_error(F.lit("all points coincide")).cast("double"))
    return moved.crossJoin(F.broadcast(radius)).select(*[x for x in rows.columns if x not in axes], *[(F.col(a) / r).alias(a) for a in axes])


@dataclass(frozen=True)
class View:
    """A 2-D view of known bounds on a screen."""

    min_x: float
    max_x: float
    min_y: float
    max_y: float
    width: float
    height: float
    zoom: float = 1.0
    pan_x: float = 0.0
    pan_y: float = 0.0

    @property
    def spans(self) -> tuple[float, float]:
        return (self.max_x - self.min_x) or 1.0, (self.max_y - self.min_y) or 1.0

    @property
    def scale(self) -> float:
        sx, sy = self.spans
        return min(self.width * FILL / sx, self.height * FILL / sy) * self.zoom

    def to_screen(self, x: Column, y: Column) -> tuple[Column, Column]:
        cx, cy = (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2
        return (x - cx) * self.scale + self.width / 2 + self.pan_x, (cy - y) * self.scale + self.height / 2 + self.pan_y

    def from_screen(self, sx: float, sy: float) -> tuple[float, float]:
        cx, cy = (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2
        return (sx - self.width / 2 - self.pan_x) / self.scale + cx, cy - (sy - self.height / 2 - self.pan_y) / self.scale

    def zoomed(self, pointer_x: float, pointer_y: float, wheel: float) -> "View":
        """Zoom about the pointer: what lies under it stays there."""
        z = min(MOST_ZOOM, max(LEAST_ZOOM, self.zoom * math.exp(-wheel * WHEEL)))
        px, py, k = pointer_x - self.width / 2, pointer_y - self.height / 2, z / self.zoom
        return replace(self, zoom=z, pan_x=px - (px - self.pan_x) * k, pan_y=py - (py - self.pan_y) * k)

    def dragged(self, dx: float, dy: float) -> "View":
        return replace(self, pan_x=self.pan_x + dx, pan_y=self.pan_y + dy)

    def located(self, x: float, y: float, zoom: float) -> "View":
        """One point in the middle of the screen."""
        v = replace(self, zoom=zoom, pan_x=0.0, pan_y=0.0)
        cx, cy = (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2
        return replace(v, pan_x=-(x - cx) * v.scale, pan_y=(y - cy) * v.scale)


def cells(rows: DataFrame, view: View, grid: int = GRID) -> DataFrame:
    """rows (x, y) with their grid cell (gx, gy)."""
    sx, sy = view.spans
    at = lambda c, low, span: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor((F.col(c) - low) / span * grid).cast("int")))
    return rows.withColumn("gx", at("x", view.min_x, sx)).withColumn("gy", at("y", view.min_y, sy))


def nearest_points(rows: DataFrame, picks: DataFrame, view: View, key: str, grid: int = GRID, reach: float = REACH) -> DataFrame:
    """(pick, key, distance): for each pick (pick, x, y) the nearest row within `reach` pixels, ties by key.

    A range join as an equi-join: each pick looks into the cells its reach can touch, nothing else is compared.
    """
    sx, sy = view.spans
    rx, ry = (min(grid, math.ceil(reach / view.scale / (s / grid))) for s in (sx, sy))
    offsets = [(a, b) for a in range(-rx, rx + 1) for b in range(-ry, ry + 1)]
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    p = cells(picks, view, grid).select("pick", F.col("x").alias("px"), F.col("y").alias("py"), "gx", "gy", F.inline(near))
    p = p.select("pick", "px", "py", (F.col("gx") + F.col("a")).alias("gx"), (F.col("gy") + F.col("b")).alias("gy"))
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2) * view.scale
    found = p.join(cells(rows, view, grid), ["gx", "gy"]).withColumn("distance", F.round(d, 9)).where(F.col("distance") <= reach)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("pick").orderBy("distance", key))).where("place = 1").select("pick", key, "distance")


def frame(rows: DataFrame, axes: list[str], by: str) -> DataFrame:
    """(by, centres, radius) of each group: middle of its box and the farthest member from there."""
    box = rows.groupBy(by).agg(*[((F.min(a) + F.max(a)) / 2).alias(f"c_{a}") for a in axes])
    away = F.sqrt(sum(((F.col(a) - F.col(f"c_{a}")) ** 2 for a in axes), F.lit(0.0)))
    return rows.join(F.broadcast(box), by).groupBy(by, *[f"c_{a}" for a in axes]).agg(F.max(away).alias("radius"))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


@dataclass(frozen=True)
class Camera:
    """An orbiting perspective camera; everything but `project` is arithmetic on the driver."""

    yaw: float = YAW
    pitch: float = PITCH
    distance: float = DISTANCE
    target: tuple[float, float, float] = field(default=(0.0, 0.0, 0.0))

    def position(self) -> np.ndarray:
        flat = math.cos(self.pitch)
        return np.array(self.target) + self.distance * np.array([math.sin(self.yaw) * flat, math.sin(self.pitch), math.cos(self.yaw) * flat])

    def orbit(self, dx: float, dy: float) -> "Camera":
        return replace(self, yaw=self.yaw - TURN * dx, pitch=float(np.clip(self.pitch + TURN * dy, -STEEPEST, STEEPEST)))

    def zoom(self, factor: float) -> "Camera":
        return replace(self, distance=float(np.clip(self.distance * factor, NEAREST, FARTHEST)))

    def axes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Right, up and backward."""
        back = _unit(self.position() - np.array(self.target))
        right = np.cross([0.0, 1.0, 0.0], back)
        right = np.array([1.0, 0.0, 0.0]) if np.linalg.norm(right) < 1e-6 else _unit(right)
        return right, np.cross(back, right), back

    def pan(self, dx: float, dy: float, height: float, aspect: float) -> "Camera":
        right, up, _ = self.axes()
        unit = 2 * self.distance * math.tan(vertical_field(aspect) / 2) / max(height, 1)
        return replace(self, target=tuple(np.array(self.target) + unit * (dy * up - dx * right)))

    def fit(self, centre, radius: float, aspect: float) -> "Camera":
        v = vertical_field(aspect)
        h = 2 * math.atan(math.tan(v / 2) * max(aspect, 0.05))
        d = PADDING * max(radius, LEAST_RADIUS) / math.sin(min(v, h) / 2)
        return replace(self, target=tuple(map(float, centre)), distance=float(np.clip(d, NEAREST, FARTHEST)))

    def matrix(self, aspect: float) -> np.ndarray:
        """4 x 4: world to clip coordinates, for column vectors."""
        right, up, back = self.axes()
        view = np.eye(4)
        view[:3, :3] = np.stack([right, up, back])
        view[:3, 3] = -view[:3, :3] @ self.position()
        f, depth = 1 / math.tan(vertical_field(aspect) / 2), NEAR_PLANE - FAR_PLANE
        lens = np.zeros((4, 4))
        lens[0, 0], lens[1, 1], lens[3, 2] = f / max(aspect, 0.05), f, -1.0
        lens[2, 2], lens[2, 3] = (FAR_PLANE + NEAR_PLANE) / depth, 2 * FAR_PLANE * NEAR_PLANE / depth
        return lens @ view

    def project(self, rows: DataFrame, width: float, height: float, axes=("x", "y", "z")) -> DataFrame:
        """rows with screen_x, screen_y, depth, visible."""
        m = self.matrix(width / max(height, 1))
        clip = [sum((F.col(a) * float(m[r, i]) for i, a in enumerate(axes)), F.lit(float(m[r, 3]))) for r in range(4)]
        w = clip[3]
        nx, ny, nz = (F.try_divide(c, w) for c in clip[:3])
        front = w > 0
        shown = front & nz.between(-1, 1) & nx.between(-EDGE, EDGE) & ny.between(-EDGE, EDGE)
        return rows.withColumns({
            "screen_x": F.when(front, (nx * 0.5 + 0.5) * width).otherwise(0.0), "screen_y": F.when(front, (0.5 - ny * 0.5) * height).otherwise(0.0),
            "depth": w, "visible": F.coalesce(shown, F.lit(False)),
        })


def vertical_field(aspect: float) -> float:
    """Tall screens see as wide as high ones."""
    a = max(aspect, 0.05)
    return FIELD_OF_VIEW if a >= 1 else 2 * math.atan(math.tan(FIELD_OF_VIEW / 2) / a)

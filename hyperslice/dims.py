"""Dimensions, views and the transforms between them: the rules that become literals of a query.

Everything here runs on the driver over a handful of axes and yields numbers and column
expressions; rows are never touched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: a tolerance from this on means that an axis is not sliced; this is what such axes get.
UNSLICED, EXTENDED = 1e9, 1e10
#: Fixed: how far a discrete coordinate may be from the slice, in points; in steps for fetching.
DISCRETE_REACH, FETCH_STEPS = 0.5, 0.25


@dataclass(frozen=True)
class Dimension:
    """One axis of a scene. Categories make it discrete over 0..k-1 with step 1; ``spatial`` follows ``display`` unless given."""

    name: str
    display: bool = False
    discrete: bool = False
    spatial: bool | None = None
    low: float | None = None
    high: float | None = None
    step: float | None = None
    unit: str = ""
    categories: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        put = lambda **k: [object.__setattr__(self, n, v) for n, v in k.items()]
        if self.categories:
            if len(set(self.categories)) < len(self.categories) or not all(self.categories):
                raise ValueError(f"{self.name}: categories must be distinct and not empty")
            put(discrete=True, low=0.0, high=float(len(self.categories) - 1), step=1.0)
        if self.spatial is None:
            put(spatial=self.display)
        if not self.spatial and not self.display:
            put(discrete=True)
        if self.discrete and self.spatial and not self.display:
            raise ValueError(f"{self.name}: a hidden spatial axis can't be discrete")
        if self.low is not None and self.high is not None and (self.high < self.low or self.high == self.low and not self.discrete):
            raise ValueError(f"{self.name}: empty range {self.low}..{self.high}")

    def stepping(self) -> float:
        """The step, else 1 on a discrete axis, else a hundredth of the range, else 0.1."""
        if self.step is not None:
            return self.step
        if self.discrete:
            return 1.0
        return (self.high - self.low) / 100 if self.low is not None and self.high is not None else 0.1


def checked(dims: Sequence[Dimension]) -> list[Dimension]:
    names = [d.name for d in dims]
    if len(set(names)) < len(names):
        raise ValueError(f"names of dimensions repeat: {names}")
    if sum(d.display for d in dims) > 3:
        raise ValueError("more than three displayed dimensions")
    return list(dims)


@dataclass(frozen=True)
class View:
    """A query: position and tolerance on every axis, and the hidden axes that are shown whole."""

    dims: tuple[Dimension, ...]
    position: dict[str, float] = field(default_factory=dict)
    tolerance: dict[str, float] = field(default_factory=dict)
    extend: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        checked(self.dims)
        if unknown := set(self.extend) - {d.name for d in self.dims}:
            raise ValueError(f"unknown dimensions to extend: {sorted(unknown)}")

    def hidden(self) -> list[Dimension]:
        return [d for d in self.dims if not d.display]

    def shown(self) -> list[Dimension]:
        return [d for d in self.dims if d.display]

    def at(self, d: Dimension) -> float:
        return float(self.position.get(d.name, 0.0))

    def within(self, d: Dimension) -> float:
        return EXTENDED if d.name in self.extend else float(self.tolerance.get(d.name, d.stepping() / 2))

    def sliced(self) -> list[Dimension]:
        """Hidden axes that restrict rows."""
        return [d for d in self.hidden() if self.within(d) < UNSLICED]

    def fetch_tolerance(self, d: Dimension, max_radius: float = 0.0) -> float:
        """How far a chunk may be away from the slice and still be read; never less than membership allows on padded bounds."""
        if d.display or d.name in self.extend:
            return EXTENDED
        if d.spatial:
            return max_radius
        return FETCH_STEPS * d.stepping() if d.discrete else self.within(d)

    def load_all(self) -> bool:
        return any(d.name in self.extend for d in self.hidden())


def partition_margin(step: float | None, at: float) -> float:
    """How far a part's bounds may be away: half a unit or three quarters of a step, and a little of the position's size."""
    return max(0.5, 0.75 * (step or 0.0)) + 1e-6 * abs(at)


def resolve_extend(dims: Sequence[Dimension], wanted: str | Sequence[str] | None) -> list[str]:
    """``all`` is every hidden axis, None none; names are checked."""
    if wanted is None:
        return []
    hidden = [d.name for d in dims if not d.display]
    if wanted == "all":
        return hidden
    if unknown := [n for n in wanted if n not in hidden]:
        raise ValueError(f"not hidden dimensions: {unknown}")
    return list(dict.fromkeys(wanted))


@dataclass(frozen=True)
class Affine:
    """world = scale * local + offset on one axis; discrete axes round to the grid."""

    scale: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        if not (math.isfinite(self.scale) and math.isfinite(self.offset)) or self.scale == 0:
            raise ValueError(f"not an invertible transform: {self}")


@dataclass(frozen=True)
class Permutation:
    """world category = order[local category]."""

    order: tuple[int, ...]

    def __post_init__(self) -> None:
        if sorted(self.order) != list(range(len(self.order))):
            raise ValueError(f"not a bijection: {self.order}")


Transform = dict[str, Affine | Permutation]


def check_transform(transform: Transform, dims: Sequence[Dimension]) -> None:
    by = {d.name: d for d in dims}
    for name, t in transform.items():
        if name not in by:
            raise ValueError(f"unknown dimension {name}")
        if by[name].display:
            raise ValueError(f"{name} is displayed; its transform belongs to the matrix")
        if isinstance(t, Permutation) and len(t.order) != len(by[name].categories):
            raise ValueError(f"{name}: {len(t.order)} of {len(by[name].categories)} categories")


def compose(*transforms: Transform) -> Transform:
    """From the root to the leaf: the leaf's transform applies first. Axes with transforms of different kinds raise."""
    out: Transform = {}
    for child in transforms:
        for name, c in child.items():
            p = out.get(name)
            if p is None:
                out[name] = c
            elif isinstance(p, Affine) and isinstance(c, Affine):
                out[name] = Affine(p.scale * c.scale, p.scale * c.offset + p.offset)
            elif isinstance(p, Permutation) and isinstance(c, Permutation):
                out[name] = Permutation(tuple(p.order[i] for i in c.order))
            else:
                raise ValueError(f"{name}: an affine and a permutation do not compose")
    return out


def half_up(x: float) -> float:
    return math.floor(x + 0.5)


def discrete_preimage(world: float, t: Affine, step: float = 1.0, anchor: float = 0.0) -> float | None:
    """The local grid point that maps to the world point after rounding; the nearest to the exact inverse, or None."""
    exact = (world - t.offset) / t.scale
    at = (exact - anchor) / step
    found = [anchor + k * step for k in (math.floor(at), math.ceil(at))]
    found = [x for x in found if half_up(t.scale * x + t.offset) == half_up(world)]
    return min(found, key=lambda x: abs(x - exact), default=None)


def inverted(view: View, transform: Transform) -> View | None:
    """The view in the leaf's own coordinates, so that the data stay as they are and predicates reach the scan; None: nothing can match."""
    position, tolerance = dict(view.position), dict(view.tolerance)
    for d in view.hidden():
        t = transform.get(d.name)
        if t is None or view.within(d) >= UNSLICED:
            continue
        if isinstance(t, Permutation):
            at = int(half_up(view.at(d)))
            if at not in t.order:
                return None
            position[d.name] = float(t.order.index(at))
        elif d.discrete:
            local = discrete_preimage(view.at(d), t, d.stepping(), d.low or 0.0)
            if local is None:
                return None
            position[d.name] = local
        else:
            position[d.name] = (view.at(d) - t.offset) / t.scale
            tolerance[d.name] = view.within(d) / abs(t.scale)
    return View(view.dims, position, tolerance, view.extend)


def applied(x: Column, t: Affine | Permutation, discrete: bool = False) -> Column:
    """The world coordinate of a local one."""
    if isinstance(t, Permutation):
        return F.element_at(F.array(*[F.lit(float(i)) for i in t.order]), (F.floor(x + 0.5) + 1).cast("int"))
    world = x * t.scale + t.offset
    return F.floor(world + 0.5).cast("double") if discrete else world


def on_bounds(low: Column, high: Column, t: Affine) -> tuple[Column, Column]:
    a, b = low * t.scale + t.offset, high * t.scale + t.offset
    return F.least(a, b), F.greatest(a, b)


def advance(at: float, low: float, high: float, step: float, mode: str = "loop", direction: int = 1) -> tuple[float, int, bool]:
    """(next position, direction, playing). A step that reaches an end lands on it; only the next one stops, wraps or turns."""
    end, other = (high, low) if direction > 0 else (low, high)
    if at == end:
        if mode == "once":
            return at, direction, False
        if mode == "loop":
            return other, direction, True
        direction = -direction
        end = other
    moved = at + direction * step
    return (min(moved, end) if direction > 0 else max(moved, end)), direction, True


def navigate(at: float, d: Dimension, steps: int, cyclic: bool = False) -> float:
    """A step along an axis within its range: wrapped on a cyclic axis, else held at the ends."""
    low, high = d.low or 0.0, d.high if d.high is not None else math.inf
    moved = at + steps * d.stepping()
    if cyclic and math.isfinite(high):
        width = high - low + (d.stepping() if d.discrete else 0.0)
        return low + (moved - low) % width
    return min(max(moved, low), high)


def parse_threshold(text: str) -> tuple[str, float]:
    """``p90`` or ``90%`` is a percentile, anything else an absolute number."""
    bare = text.strip()
    kind = "percentile" if bare[:1] in "pP" or bare[-1:] == "%" else "absolute"
    value = float(bare.strip("pP%"))
    if kind == "percentile" and not 0 <= value <= 100:
        raise ValueError(f"percentile out of range: {text}")
    return kind, value


def parse_bbox(text: str, ndim: int) -> list[tuple[float, float]]:
    """2 * ndim numbers, a low and a high for each axis."""
    numbers = [float(x) for x in text.replace(",", " ").split()]
    pairs = list(zip(numbers[::2], numbers[1::2], strict=False))
    if len(numbers) != 2 * ndim or any(a > b for a, b in pairs):
        raise ValueError(f"not a box of {ndim} dimensions: {text}")
    return pairs


def parse_ranges(text: str, ndim: int) -> list[tuple[float | None, float | None]]:
    """A ``low:high`` for each axis, either may be left out."""
    parts = text.split(",")
    if len(parts) != ndim or any(p.count(":") != 1 for p in parts):
        raise ValueError(f"not {ndim} ranges: {text}")
    return [tuple(float(x) if x.strip() else None for x in p.split(":")) for p in parts]  # type: ignore[misc]


def parse_axes(text: str, ndim: int) -> list[int]:
    axes = [int(x) for x in text.split(",")]
    if len(set(axes)) < len(axes) or any(not 0 <= a < ndim for a in axes):
        raise ValueError(f"not distinct axes below {ndim}: {text}")
    return axes


def check_version(found: tuple[int, int], supported: Sequence[tuple[int, int]]) -> str:
    """``ok``, or ``newer`` for a later minor version of a supported major one; others raise."""
    if found in supported:
        return "ok"
    if any(found[0] == a and found[1] > b for a, b in supported):
        return "newer"
    raise ValueError(f"version {found} is not supported")


def extrapolated(previous: View, current: View) -> View:
    """The view that comes next if hidden axes go on as they went: current + (current - previous), held in the axis' range."""
    position = dict(current.position)
    for d in current.hidden():
        at = 2 * current.at(d) - previous.at(d)
        at = at if d.low is None else max(at, d.low)
        position[d.name] = at if d.high is None else min(at, d.high)
    return View(current.dims, position, dict(current.tolerance), current.extend)


def is_plain_3d(ndim: int, shown: Sequence[int]) -> bool:
    """Whether a projection changes nothing: three axes, all shown, in their order."""
    return ndim == 3 and list(shown) == [0, 1, 2]

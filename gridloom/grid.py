"""Arrays as relations: a row a voxel, integer coordinates named by axis, the value in ``v``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from .meta import ArrayMeta, Box


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    meta: ArrayMeta

    @property
    def axes(self) -> tuple[str, ...]:
        return self.meta.axes

    def length(self, axis: str) -> int:
        return self.meta.shape[self.axes.index(axis)]

    def along(self, axis: str):
        """A window over the lines of one axis."""
        return Window.partitionBy(*[a for a in self.axes if a != axis]).orderBy(axis)

    def map(self, value: Column, dtype: str | None = None, kind: str | None = None) -> Grid:
        """Another value at every voxel. The kind goes unless it is named anew."""
        return Grid(self.df.select(*self.axes, value.alias("v")), replace(self.meta, dtype=dtype or self.meta.dtype, kind=kind))

    def read(self, box: Box) -> Grid:
        """The voxels inside ``box``, at the coordinates that they have; a range on every axis, pushed to the scan."""
        box = box.clip(self.meta.shape)
        inside = F.lit(True)
        for a, lo, hi in zip(self.axes, box.start, box.stop, strict=True):
            inside = inside & (F.col(a) >= lo) & (F.col(a) < hi)
        return Grid(self.df.where(inside), self.meta)

    def cropped(self, box: Box) -> Grid:
        """An array that is exactly ``box``: coordinates count from its corner, the translation moves along."""
        box = box.clip(self.meta.shape)
        if box.empty:
            raise ValueError("the box holds no voxels")
        df = self.read(box).df.select(*[(F.col(a) - lo).alias(a) for a, lo in zip(self.axes, box.start, strict=True)], "v")
        moved = tuple(t + lo * s for t, lo, s in zip(self.meta.translation, box.start, self.meta.voxel_size, strict=True))
        return Grid(df, replace(self.meta, shape=box.shape, translation=moved, chunk=tuple(min(c, n) for c, n in zip(self.meta.chunk, box.shape, strict=True))))


def finite_or(value: Column, other: float) -> Column:
    """A double with ``other`` for NaN; Spark, unlike numpy, holds NaN the largest of values."""
    return F.when(F.isnan(value), F.lit(other)).otherwise(value)

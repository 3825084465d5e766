"""Transforms attached to a table: targets for every split, augmentation for training only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


class Chain:
    """A source table and the transforms that will run on it, in the order they were added.

    ``then(fn)`` is for training rows only, ``then(fn, targets=True)`` for
    validation too.  Once a table was built nothing more can be added.
    """

    def __init__(self, source: DataFrame) -> None:
        self.source = source
        self.steps: list[tuple[Transform, bool]] = []
        self.built = False

    def then(self, fn: Transform, targets: bool = False) -> Chain:
        if self.built:
            raise RuntimeError("a table was built already; add transforms before")
        self.steps.append((fn, targets))
        return self

    def table(self, split: str) -> DataFrame:
        """The table of a split: ``train`` or ``val``."""
        if split not in ("train", "val"):
            raise ValueError(f"a split is train or val, not {split}")
        self.built = True
        out = self.source
        for fn, targets in self.steps:
            out = out.transform(fn) if targets or split == "train" else out
        return out

"""R1: provider normalisers and sanctions sources by name, plain callables from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


class Registry:
    """The first registration of a name stays; an unknown name is an error."""

    def __init__(self, what: str):
        self.what, self._steps = what, {}

    def register(self, name: str, step: Step) -> bool:
        """Whether the name was free."""
        return self._steps.setdefault(name, step) is step

    def get(self, name: str) -> Step:
        if name not in self._steps:
            raise KeyError(f"unknown {self.what}: {name}")
        return self._steps[name]

    def names(self) -> list[str]:
        return sorted(self._steps)


providers = Registry("provider")
sanctions_sources = Registry("sanctions source")

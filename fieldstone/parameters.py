"""Named parameters with descriptions."""

from __future__ import annotations

from collections.abc import Iterator


class Parameters:
    """Values with descriptions; a name that was not declared raises, on reading as on writing."""

    def __init__(self, declared: dict[str, tuple[object, str]]):
        self._values = {k: v for k, (v, _) in declared.items()}
        self._about = {k: about for k, (_, about) in declared.items()}

    def _known(self, name: str) -> str:
        if name not in self._values:
            raise KeyError(f"{name} is not a parameter; there are: {', '.join(sorted(self._values))}")
        return name

    def __getitem__(self, name: str):
        return self._values[self._known(name)]

    def __setitem__(self, name: str, value) -> None:
        self._values[self._known(name)] = value

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def update(self, **values) -> Parameters:
        for k, v in values.items():
            self[k] = v
        return self

    def about(self, name: str) -> str:
        return self._about[self._known(name)]

"""Layers of features, in order and by name."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Layer:
    """A table of features (id, geometry, attributes) and how it is shown."""

    label: str
    df: DataFrame
    crs: str = "EPSG:4326"
    source: str | None = None
    show: bool = True
    default_color: list[int] = field(default_factory=lambda: [150, 150, 150])


class Layers:
    """Layers from bottom to top; each has a name of its own. No rows are touched here."""

    def __init__(self) -> None:
        self._order: list[str] = []
        self._by_name: dict[str, Layer] = {}

    def __getitem__(self, key: str | int) -> Layer:
        if isinstance(key, int):
            return self.get_layer_at_pos(key)
        if key not in self._by_name:
            raise KeyError(f"no layer {key!r}; there are {self._order}")
        return self._by_name[key]

    def __setitem__(self, key: str | int, layer: Layer) -> None:
        """Put ``layer`` in the place of the one of this name or position; a new name goes on top."""
        if not isinstance(layer, Layer):
            raise TypeError("a layer is needed")
        if isinstance(key, int):
            old = self._order[key]
        elif key in self._by_name:
            old = key
        else:
            layer.label = key
            self.insert_at(len(self._order), layer)
            return
        name = layer.label if isinstance(key, int) else key
        if name != old and name in self._by_name:
            raise KeyError(f"there is a layer {name!r} already")
        layer.label = name
        del self._by_name[old]
        self._order[self._order.index(old)] = name
        self._by_name[name] = layer

    def __contains__(self, name: object) -> bool:
        return name in self._by_name

    def __iter__(self) -> Iterator[str]:
        return iter(list(self._order))

    def __len__(self) -> int:
        return len(self._order)

    def __str__(self) -> str:
        return ", ".join(self._order)

    def add(self, layer: Layer, pos: int | None = None, first: bool = False, before: str | None = None, after: str | None = None) -> None:
        """On top, or at ``pos``, at the bottom (``first``), below ``before`` or above ``after``; the first that is given counts."""
        if pos is not None:
            if isinstance(pos, bool) or not isinstance(pos, int):
                raise TypeError("pos must be a whole number")
            self.insert_at(pos, layer)
        elif first:
            self.insert_at(0, layer)
        elif before is not None:
            self.insert_at(self.pos_at_label(before), layer)
        elif after is not None:
            self.insert_at(self.pos_at_label(after) + 1, layer)
        else:
            self.insert_at(len(self._order), layer)

    def insert_at(self, pos: int, layer: Layer) -> None:
        if isinstance(pos, bool) or not isinstance(pos, int):
            raise ValueError("a position is a whole number")
        if layer.label in self._by_name:
            raise KeyError(f"there is a layer {layer.label!r} already")
        self._order.insert(pos, layer.label)
        self._by_name[layer.label] = layer

    def get_layer_at_pos(self, pos: int) -> Layer:
        if not 0 <= pos < len(self._order):
            raise IndexError(f"no layer at position {pos}")
        return self._by_name[self._order[pos]]

    def pos_at_label(self, label: str) -> int:
        if label not in self._by_name:
            raise ValueError(f"no layer {label!r}")
        return self._order.index(label)

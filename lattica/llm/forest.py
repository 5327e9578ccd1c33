"""Union-find inside a task, to pass on only the links that join something."""

from __future__ import annotations


class Forest:
    """Keeps of the links it is shown those that join two of its trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def joining(self, pairs) -> list[tuple[int, int]]:
        out = []
        for a, b in pairs:
            if (a := self.root(a)) != (b := self.root(b)):
                self.parent[max(a, b)] = min(a, b)
                out.append((a, b))
        return out

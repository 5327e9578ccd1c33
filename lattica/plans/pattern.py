"""Small pattern graphs on the driver, and the orders in which their edges are joined and walked."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """``labels``: a label or None for each vertex; ``edges``: (from, to, label or None)."""

    labels: tuple[int | None, ...]
    edges: tuple[tuple[int, int, int | None], ...]

    def order(self, sizes: dict[int, int] | None = None, fan: dict[tuple[int, int], float] | None = None, as_given: bool = False) -> list[int]:
        """Edge numbers, each after the first sharing a vertex with those before where one can.

        Edges that close a cycle come as soon as they can; among others the one of
        which a bound vertex has the fewest (``fan``, by edge and vertex), then the
        one with the fewest candidates (``sizes``), else the first given. A few
        edges that all lead to a hub would multiply what is bound. ``as_given``: of
        those that share a vertex, the first given.
        """
        left, bound, out = list(range(len(self.edges))), set(), []
        while left:

            def cost(k: int) -> tuple:
                u, v, _ = self.edges[k]
                ties = (u in bound) + (v in bound)
                met = min(((fan or {}).get((k, w), 0) for w in (u, v) if w in bound), default=0)
                return (not ties, 0, 0, k) if as_given else (0 if ties == 2 else 1 if ties else 2, met, (sizes or {}).get(k, 0), k)

            k = min(left, key=cost)
            left.remove(k)
            out.append(k)
            bound |= set(self.edges[k][:2])
        return out

    def walk(self, root: int = 0) -> list[tuple[int, str]]:
        """(edge number, how) of every edge once, along depth-first walks from ``root`` and then from the least vertex not seen.

        How: ``out`` or ``in``, from a vertex seen to a new one along the edge or
        against it; ``close``, between two seen; ``start``, the first of a further part.
        """
        seen, done, out = set(), set(), []

        def visit(u: int) -> None:
            seen.add(u)
            for k, (a, b, _) in enumerate(self.edges):
                if k in done or u not in (a, b):
                    continue
                other = b if a == u else a
                done.add(k)
                if other in seen:
                    out.append((k, "close"))
                else:
                    out.append((k, "out" if a == u else "in"))
                    visit(other)

        for u in [root, *range(len(self.labels))]:
            if u not in seen:
                first = len(out)
                visit(u)
                if u != root and len(out) > first:
                    out[first] = (out[first][0], "start")
        return out

    def parts(self) -> list[set[int]]:
        """Connected sets of vertices, by their least."""
        out: list[set[int]] = []
        for u in range(len(self.labels)):
            tied = [p for p in out if any((a in p) != (b in p) and u in (a, b) for a, b, _ in self.edges)]
            out = [p for p in out if p not in tied] + [set().union({u}, *tied)]
        return sorted(out, key=min)

    def degree(self, u: int) -> tuple[int, int]:
        """(in, out) over distinct neighbours."""
        return len({a for a, b, _ in self.edges if b == u}), len({b for a, b, _ in self.edges if a == u})

    def neighbour_labels(self, u: int) -> tuple[Counter, Counter]:
        """Counts of the labels of distinct in- and out-neighbours."""
        into = Counter(self.labels[a] for a in {a for a, b, _ in self.edges if b == u})
        out = Counter(self.labels[b] for b in {b for a, b, _ in self.edges if a == u})
        return into, out

"""Minimum-cost flow on small graphs with convex arc costs; runs on the driver."""

from __future__ import annotations

import heapq
from collections.abc import Hashable


class FlowGraph:
    """Nodes are any hashable names; arcs have integer capacities and costs of 0 or more."""

    def __init__(self) -> None:
        self.index: dict[Hashable, int] = {}
        self.out: list[list[int]] = []
        self.head: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.named: list[tuple[int, Hashable]] = []

    def node(self, name: Hashable) -> int:
        if name not in self.index:
            self.index[name] = len(self.out)
            self.out.append([])
        return self.index[name]

    def arc(self, tail: Hashable, head: Hashable, capacity: int, cost: int = 0, name: Hashable = None) -> None:
        """An arc; its flow is reported under ``name`` if that isn't None."""
        a, b = self.node(tail), self.node(head)
        if capacity <= 0:
            return
        if name is not None:
            self.named.append((len(self.head), name))
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.left.append(c)
            self.cost.append(w)

    def convex_arc(self, tail: Hashable, head: Hashable, capacity: int, target: float, weight: int, name: Hashable = None) -> None:
        """An arc on which the k-th helping of ``target`` units costs weight * (k - 1) a unit.

        Beyond eight helpings their size doubles, so that the number of pieces stays small.
        """
        size, used, k = max(1, round(target)), 0, 0
        while used < capacity:
            piece = min(capacity - used, size)
            self.arc(tail, head, piece, weight * k, name)
            used += piece
            k += 1
            if k >= 8:
                size *= 2

    def run(self, source: Hashable, sink: Hashable, amount: int) -> int:
        """Send up to ``amount`` at least cost, by shortest paths with potentials; returns what went."""
        s, t = self.node(source), self.node(sink)
        potential, sent = [0] * len(self.out), 0
        while sent < amount:
            far = [None] * len(self.out)
            far[s], via, heap, done = 0, {}, [(0, s)], set()
            while heap:
                d, x = heapq.heappop(heap)
                if x in done:
                    continue
                done.add(x)
                for e in self.out[x]:
                    if self.left[e] > 0:
                        y = self.head[e]
                        n = d + self.cost[e] + potential[x] - potential[y]
                        if far[y] is None or n < far[y]:
                            far[y], via[y] = n, e
                            heapq.heappush(heap, (n, y))
            if far[t] is None:
                break
            most = max(d for d in far if d is not None)
            for x, d in enumerate(far):
                potential[x] += most if d is None else d
            sent += self._augment(s, t, potential, amount - sent)
        return sent

    def _augment(self, s: int, t: int, potential: list[int], amount: int) -> int:
        """Everything that goes along arcs without reduced cost: a maximum flow on them (Dinic)."""
        total = 0
        while total < amount:
            depth, queue = {s: 0}, [s]
            for x in queue:
                for e in self.out[x]:
                    y = self.head[e]
                    if self.left[e] > 0 and y not in depth and self.cost[e] + potential[x] - potential[y] == 0:
                        depth[y] = depth[x] + 1
                        queue.append(y)
            if t not in depth:
                break
            at = [0] * len(self.out)
            while total < amount:
                path, x = [], s
                while x != t:
                    while at[x] < len(self.out[x]):
                        e = self.out[x][at[x]]
                        y = self.head[e]
                        if self.left[e] > 0 and depth.get(y) == depth[x] + 1 and self.cost[e] + potential[x] - potential[y] == 0:
                            break
                        at[x] += 1
                    if at[x] == len(self.out[x]):
                        if not path:
                            break
                        x = self.head[path.pop() ^ 1]
                        at[x] += 1
                        continue
                    path.append(self.out[x][at[x]])
                    x = self.head[path[-1]]
                if x != t:
                    break
                push = min(amount - total, *(self.left[e] for e in path))
                for e in path:
                    self.left[e] -= push
                    self.left[e ^ 1] += push
                total += push
        return total

    def flows(self) -> dict[Hashable, int]:
        """The flow of named arcs, summed by name."""
        out: dict[Hashable, int] = {}
        for e, name in self.named:
            if f := self.left[e ^ 1]:
                out[name] = out.get(name, 0) + f
        return out

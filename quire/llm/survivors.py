"""Survivor paths of a Viterbi search, kept as a backpointer tree that emits what is settled.

Every state has one survivor: its cost and the last node of its path. A node counts the nodes
and survivors that hold it; one that nothing holds any more goes, and its parent with it if it
was the last to hold that. Once all survivors share an ancestor, the path up to it is settled:
it is handed out and leaves memory. Equal costs are decided by the texts of the two paths,
compared from the common root to their ends.
"""

from __future__ import annotations

from collections.abc import Iterable


class _Node:
    __slots__ = ("parent", "text", "note", "kids", "held")

    def __init__(self, parent: _Node | None, text: str, note):
        self.parent, self.text, self.note, self.kids, self.held = parent, text, note, set(), 0


class Survivors:
    """``settled`` lists the (text, note) of the path's settled steps in order; the caller may empty it."""

    def __init__(self, state):
        self.root = _Node(None, "", None)
        self.root.held = 1
        self.live = {state: (0, self.root)}
        self.settled: list[tuple] = []

    def _path(self, node: _Node) -> list[_Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _text(self, node: _Node, more: str) -> str:
        return "".join(n.text for n in self._path(node)) + more

    def _better(self, new: tuple, old: tuple | None) -> bool:
        """A candidate is (cost, node, text, note); of equal costs the smaller text wins."""
        if old is None or new[0] != old[0]:
            return old is None or new[0] < old[0]
        return self._text(new[1], new[2]) < self._text(old[1], old[2])

    def step(self, moves: Iterable[tuple], stay: bool = False) -> None:
        """All survivors make one move (from, to, cost, text, note). ``stay``: or none, and moves go on until nothing gains."""
        moves = list(moves)
        if stay:
            gained = True
            while gained:
                gained = False
                for a, b, cost, text, note in moves:
                    if a in self.live:
                        c, node = self.live[a]
                        have = self.live.get(b)
                        if self._better((c + cost, node, text, note), have and (*have, "", None)):
                            self._put(b, (c + cost, node, text, note))
                            gained = True
        else:
            best: dict = {}
            for a, b, cost, text, note in moves:
                if a in self.live:
                    c, node = self.live[a]
                    if self._better((c + cost, node, text, note), best.get(b)):
                        best[b] = (c + cost, node, text, note)
            old, self.live = self.live, {}
            for state, candidate in best.items():
                self._put(state, candidate)
            for _, node in old.values():
                self._release(node)
        self._settle()

    def _put(self, state, candidate: tuple) -> None:
        cost, parent, text, note = candidate
        node = _Node(parent, text, note)
        node.held = 1
        parent.kids.add(node)
        before = self.live.get(state)
        self.live[state] = (cost, node)
        if before:
            self._release(before[1])

    def drop(self, state) -> None:
        """Give up a survivor that the caller knows to lose to another whatever follows."""
        _, node = self.live.pop(state)
        self._release(node)
        self._settle()

    def _release(self, node: _Node) -> None:
        node.held -= 1
        while node is not self.root and not node.held and not node.kids:
            node.parent.kids.discard(node)
            node = node.parent

    def _settle(self) -> None:
        while not self.root.held and len(self.root.kids) == 1:
            (self.root,) = self.root.kids
            self.settled.append((self.root.text, self.root.note))

    def finish(self, states: Iterable) -> int | None:
        """Settle the best survivor among ``states``; its cost, or None if none survives there."""
        ends = [self.live[s] for s in states if s in self.live]
        if not ends:
            return None
        cost, node = min(ends, key=lambda x: (x[0], self._text(x[1], "")))
        self.settled += [(n.text, n.note) for n in self._path(node)]
        return cost

"""Adaptive radix tree over byte strings: nodes that grow with their children, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from codefacts.llm.suffix_runs import common_prefix


class Few:
    """Up to ``room`` children beside their sorted branch bytes: layouts of 4 and of 16."""

    __slots__ = ("room", "bytes", "kids")

    def __init__(self, room: int, branch: bytes = b"", kids: tuple = ()):
        self.room, self.bytes, self.kids = room, bytearray(branch), list(kids)

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: Node) -> Few | Indexed:
        if len(self.kids) == self.room:
            wider = Few(16, bytes(self.bytes), tuple(self.kids)) if self.room == 4 else Indexed(self)
            return wider.put(byte, kid)
        at = bisect_left(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.kids, strict=True)


class Indexed:
    """Up to 48 children, found through one byte per branch byte."""

    __slots__ = ("slots", "kids")
    ROOM = 48

    def __init__(self, narrow: Few):
        self.slots, self.kids = bytearray(256), list(narrow.kids)
        for slot, byte in enumerate(narrow.bytes):
            self.slots[byte] = slot + 1

    def get(self, byte: int) -> Node | None:
        slot = self.slots[byte]
        return self.kids[slot - 1] if slot else None

    def put(self, byte: int, kid: Node) -> Indexed | Direct:
        if len(self.kids) == self.ROOM:
            return Direct(self).put(byte, kid)
        self.kids.append(kid)
        self.slots[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.kids[slot - 1]) for byte, slot in enumerate(self.slots) if slot)


class Direct:
    """One place for each of the 256 branch bytes."""

    __slots__ = ("kids",)

    def __init__(self, narrow: Indexed):
        self.kids: list[Node | None] = [None] * 256
        for byte, kid in narrow.items():
            self.kids[byte] = kid

    def get(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> Direct:
        self.kids[byte] = kid
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)


class Node:
    """``path``: the bytes between the branch byte that leads here and this node. ``value``: of the key that ends here, if one does."""

    __slots__ = ("path", "value", "kids")

    def __init__(self, path: bytes, value: int | None = None, kids: Few | Indexed | Direct | None = None):
        self.path, self.value, self.kids = path, value, kids


class RadixTree:
    """Keys of any length, one key may begin with another; each has a number."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: int) -> None:
        node, at = self.root, 0
        while True:
            if not key.startswith(node.path, at):
                same = common_prefix(key[at : at + len(node.path)], node.path)
                rest = Node(node.path[same + 1 :], node.value, node.kids)
                node.kids = Few(4, node.path[same : same + 1], (rest,))
                node.path, node.value = node.path[:same], None
            at += len(node.path)
            if at == len(key):
                node.value = value
                return
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                node.kids = (node.kids or Few(4)).put(key[at], Node(key[at + 1 :], value))
                return
            node, at = kid, at + 1

    def walk(self) -> Iterator[tuple[int, bytes, int | None]]:
        """Every node in key order, parents first: byte depth of its parent node, the bytes from there, its value."""
        left = [(0, b"", self.root)]
        while left:
            above, branch, node = left.pop()
            yield above, branch + node.path, node.value
            if node.kids:
                at = above + len(branch) + len(node.path)
                left.extend([(at, bytes((byte,)), kid) for byte, kid in node.kids.items()][::-1])

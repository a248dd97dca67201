"""A balanced search tree (AVL) of (key, value) pairs with the smallest key at or above a bound."""

from __future__ import annotations


class _Node:
    __slots__ = ("height", "item", "left", "right")

    def __init__(self, item):
        self.item, self.left, self.right, self.height = item, None, None, 1


def _height(node) -> int:
    return node.height if node else 0


def _fixed(node):
    """``node`` with its height set and, where its sides differ by two, rotated."""

    def measured(x):
        x.height = 1 + max(_height(x.left), _height(x.right))
        return x

    def lean(x) -> int:
        return _height(x.left) - _height(x.right)

    def turned_right(x):
        top = x.left
        x.left, top.right = top.right, x
        measured(x)
        return measured(top)

    def turned_left(x):
        top = x.right
        x.right, top.left = top.left, x
        measured(x)
        return measured(top)

    measured(node)
    if lean(node) > 1:
        if lean(node.left) < 0:
            node.left = turned_left(node.left)
        return turned_right(node)
    if lean(node) < -1:
        if lean(node.right) > 0:
            node.right = turned_right(node.right)
        return turned_left(node)
    return node


class BalancedTree:
    """Items are tuples that compare; no item is held twice."""

    def __init__(self, items=()):
        self._root = None
        for x in items:
            self.add(x)

    def add(self, item) -> None:
        def put(node):
            if node is None:
                return _Node(item)
            if item < node.item:
                node.left = put(node.left)
            else:
                node.right = put(node.right)
            return _fixed(node)

        self._root = put(self._root)

    def remove(self, item) -> None:
        def without_least(node):
            if node.left is None:
                return node.right, node.item
            node.left, least = without_least(node.left)
            return _fixed(node), least

        def cut(node):
            if node is None:
                raise KeyError(item)
            if item == node.item:
                if node.left is None or node.right is None:
                    return node.left or node.right
                node.right, node.item = without_least(node.right)
            elif item < node.item:
                node.left = cut(node.left)
            else:
                node.right = cut(node.right)
            return _fixed(node)

        self._root = cut(self._root)

    def at_least(self, bound):
        """The smallest item that is not below ``bound``, or None."""
        node, best = self._root, None
        while node:
            if node.item >= bound:
                node, best = node.left, node.item
            else:
                node = node.right
        return best

"""Deep-shallow sorting of suffixes of byte strings.

Suffixes are first sorted to a shallow depth by multikey quicksort, eight bytes at a time. Suffixes that still agree
share a long prefix; they are put in order by a blind trie, which looks at one byte for each branching on the way down
and compares strings once for each suffix.
"""

from __future__ import annotations

Suffix = tuple[int, int]  # which text, and where in it

SHALLOW = 32
_WORD = 8


def _word(text: bytes, at: int, end: int) -> bytes:
    """Up to eight bytes; shorter ones, at an end, sort before longer ones that begin with them."""
    return text[at : min(at + _WORD, end)]


def _quicksort(texts: list[bytes], suffixes: list[Suffix], at: int, depth: int, found: list[list[Suffix]]) -> None:
    """Appends groups in order; those of several suffixes agree in their first bytes up to the shallow depth."""
    todo = [(suffixes, at)]
    while todo:
        group, at = todo.pop()
        if len(group) == 1 or at >= min(SHALLOW, depth):
            found.append(group)
            continue
        words = [_word(texts[i], p + at, p + depth) for i, p in group]
        middle = sorted(words[:: max(1, len(words) // 9)])
        pivot = middle[len(middle) // 2]
        less = [s for s, w in zip(group, words, strict=True) if w < pivot]
        same = [s for s, w in zip(group, words, strict=True) if w == pivot]
        more = [s for s, w in zip(group, words, strict=True) if w > pivot]
        # what is pushed last is sorted first
        if more:
            todo.append((more, at))
        todo.append((same, at + _WORD if len(pivot) == _WORD else depth))
        if less:
            todo.append((less, at))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    difference = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (difference.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children", "members", "string")

    def __init__(self, depth: int, members: list[Suffix] | None = None, string: bytes = b""):
        self.depth, self.members, self.string = depth, members, string
        self.children: dict[int, _Node] = {}


def _blind_trie(texts: list[bytes], group: list[Suffix], depth: int) -> list[list[Suffix]]:
    """Classes of suffixes that agree to the depth, in order."""
    i, p = group[0]
    string = texts[i][p : p + depth]
    root = _Node(len(string), [group[0]], string)
    for i, p in group[1:]:
        string = texts[i][p : p + depth]
        node, path = root, []
        while node.members is None:  # blindly down to some leaf
            path.append(node)
            byte = string[node.depth] if node.depth < len(string) else -1
            node = node.children.get(byte) or next(iter(node.children.values()))
        shared = common_prefix(string, node.string)
        if shared == len(string) == len(node.string):
            node.members.append((i, p))
            continue
        parent, below = None, root
        for step in [*path, node]:
            below = step
            if step.depth >= shared if step.members is None else True:
                break
            parent = step
        leaf = _Node(len(string), [(i, p)], string)
        byte = string[shared] if shared < len(string) else -1
        if below.members is None and below.depth == shared:
            below.children[byte] = leaf
            continue
        branch = _Node(shared)
        other = below
        while other.members is None:
            other = next(iter(other.children.values()))
        branch.children[other.string[shared] if shared < len(other.string) else -1] = below
        branch.children[byte] = leaf
        if parent is None:
            root = branch
        else:
            parent.children[string[parent.depth] if parent.depth < len(string) else -1] = branch
    ordered, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.members is not None:
            ordered.append(node.members)
        else:
            todo += [node.children[b] for b in sorted(node.children, reverse=True)]
    return ordered


def sorted_classes(texts: list[bytes], suffixes: list[Suffix], depth: int) -> list[list[Suffix]]:
    """All suffixes in the order of their first `depth` bytes; those that agree in all of these are one class."""
    groups: list[list[Suffix]] = []
    _quicksort(texts, suffixes, 0, depth, groups)
    classes: list[list[Suffix]] = []
    for group in groups:
        classes += [group] if len(group) == 1 else _blind_trie(texts, group, depth)
    return classes

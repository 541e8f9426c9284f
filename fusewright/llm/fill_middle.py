"""Fill-in-the-middle: documents cut at two lines and rearranged, by ropes.

A rope is a binary tree over pieces of a text.  Every node caches how many units (lines) and code points lie below it, so the
tree is split at any rank of either without reading the text that stays whole: two splits by unit cut a
document, sentinels and the parts are put together in the new order, and the way back finds the sentinels in the output, splits a
rope of it by code points and puts the parts together again.

Defined cases: a null text counts as empty; an empty text, or one that contains a sentinel, stays plain, with null for the parts'
lengths; a null ``doc_id`` is hashed as an empty number; rows of equal ``doc_id`` are cut by equal chances, each at its own lines; an
empty table gives an empty result; other columns are not read; a very long text is one row of its own batch.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batchwise, column, picked, rows_of

PREFIX, SUFFIX, MIDDLE = SENTINELS = "<P>", "<S>", "<M>"
LEAF = 2048  # code points in a leaf before its last line ends
PART = 2 << 20  # code points given at once


class Rope:
    """A leaf with text, or a branch; ``units`` and ``points`` are those of everything below."""

    __slots__ = ("left", "right", "text", "units", "points")

    def __init__(self, text: str = "", units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        self.units, self.points = (units, len(text)) if left is None else (left.units + right.units, left.points + right.points)

    @staticmethod
    def lines(text: str) -> Rope:
        """A balanced rope whose units are lines with their ends."""
        level, at = [], 0
        while at < len(text):
            to = text.find("\n", at + LEAF - 1) + 1 or len(text)
            piece = text[at:to]
            level.append(Rope(piece, piece.count("\n") + (piece[-1] != "\n")))
            at = to
        while len(level) > 1:
            level = [join(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else Rope()

    def _cut(self, rank: int, by: str) -> tuple[Rope, Rope]:
        """A leaf, cut within."""
        at = rank
        if by == "units":
            at = 0
            for _ in range(rank):
                at = self.text.find("\n", at) + 1
        units = rank if by == "units" else self.text.count("\n", 0, at) + (at > 0 and self.text[at - 1] != "\n")
        return Rope(self.text[:at], units), Rope(self.text[at:], max(0, self.units - units))

    def split(self, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """The first ``rank`` units or points, and the rest."""
        node, before, after = self, [], []
        while 0 < rank < getattr(node, by):
            if node.left is None:
                a, b = node._cut(rank, by)
                before.append(a)
                after.append(b)
                break
            in_left = getattr(node.left, by)
            if rank < in_left:
                after.append(node.right)
                node = node.left
            else:
                before.append(node.left)
                node, rank = node.right, rank - in_left
        else:
            (before if rank > 0 else after).append(node)
        return join(*before), join(*reversed(after))

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                out.append(node.text)
            else:
                stack += [node.right, node.left]
        return "".join(out)


def join(*ropes: Rope) -> Rope:
    """One after the other; no text is copied."""
    some = [r for r in ropes if r.points]
    out = some[-1] if some else Rope()
    for r in reversed(some[:-1]):
        out = Rope(left=r, right=out)
    return out


def chances(doc_id: int | None, seed: int = 7) -> list[int]:
    """Four numbers of 32 bits from seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: str, doc_id: int | None, rate: int = 100, spm: int = 50, seed: int = 7):
    """(lines, form, prefix points, middle points, output) of one document."""
    rope = Rope.lines(text)
    n = rope.units
    h1, h2, h3, h4 = chances(doc_id, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = rope.split(b)
    prefix, middle = head.split(a)
    p, s, m = (Rope(x) for x in SENTINELS)
    form, out = ("spm", join(s, suffix, p, prefix, m, middle)) if h4 % 100 < spm else ("psm", join(p, prefix, s, suffix, m, middle))
    return n, form, prefix.points, middle.points, str(out)


def restore(output: str, form: str) -> str:
    """The text again, from output and form alone; sentinels overlap neither themselves nor each other, so the first of each is the one put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    i, j = output.index(second), output.index(MIDDLE)
    whole, middle = Rope.lines(output).split(j, "points")
    whole, two = whole.split(i, "points")
    one = whole.split(len(first), "points")[1]
    two, middle = two.split(len(second), "points")[1], middle.split(len(MIDDLE), "points")[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return str(join(prefix, middle, suffix))


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string()), ("restored", pa.large_string())])


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and restored of each row.

    rate: how many of a hundred documents are rearranged; spm: how many of a hundred of these have the suffix first.
    """

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), column(batch, "text")):
                n, form, a, b, out = transform(text.as_py() or "", doc_id, rate, spm, seed)
                rows.append((doc_id, n, form, a, b, out, restore(out, form)))
                size += len(out)
                if size > PART:
                    yield rows_of(_OUT, list(zip(*rows)))
                    rows, size = [], 0
            if rows:
                yield rows_of(_OUT, list(zip(*rows)))

    plain = picked(docs, doc_id="long", text="string")
    return plain.mapInArrow(batchwise(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")

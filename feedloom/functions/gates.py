"""Gate words: which expressions can a text match at all?

Every gate expression has a list of words of which each of its matches holds at least one as a whole word (digits may
follow it).  The words of all gates form one expression, a tree of letters, so one pass over a text finds
them; each word found sets the bits of its gates.  A check tests its bits before any expression of its own runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_LONG = 62


def tree_regex(words: Iterable[str]) -> str:
    """One expression for all words that branches on one letter at a time."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def text(node: dict) -> str:
        arms = [_quoted(letter) + text(below) for letter, below in sorted(node.items()) if letter]
        if not arms:
            return ""
        joined = arms[0] if len(arms) == 1 and "" not in node else "(?:" + "|".join(arms) + ")"
        return joined + ("?" if "" in node else "")

    return text(tree)


def _quoted(letter: str) -> str:
    return letter if letter.isalnum() or letter == "_" else "\\" + letter


class WordGates:
    """Bits for lists of words.  ``lists[k]`` belongs to bit k."""

    def __init__(self, lists: Sequence[tuple[str, ...]]):
        self.lists = list(dict.fromkeys(lists))
        self.words = sorted({w for words in self.lists for w in words})

    def masks(self, word: str) -> list[int]:
        """What a found word says: the bits of all lists that hold it."""
        out = [0] * self.longs
        for k, words in enumerate(self.lists):
            if word in words:
                out[k // PER_LONG] |= 1 << (k % PER_LONG)
        return out

    @property
    def longs(self) -> int:
        return -(-len(self.lists) // PER_LONG)

    def found(self, low: Column) -> Column:
        """Distinct gate words of a text in lower case."""
        return F.array_distinct(F.regexp_extract_all(low, F.lit("(?<![a-z0-9_])" + tree_regex(self.words) + "(?![a-z_])"), F.lit(0)))

    def bits(self, found: Column) -> list[Column]:
        """The bit sets of the words found, as longs."""

        def long(k: int) -> Column:
            mask = F.create_map(*[x for w in self.words for x in (F.lit(w), F.lit(self.masks(w)[k]).cast("long"))])
            return F.aggregate(found, F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(F.element_at(mask, w)))

        return [long(k) for k in range(self.longs)]

    def test(self, words: tuple[str, ...], name: str) -> Column:
        """Whether the bit of a list is set in the columns ``name0``, ``name1``, ..."""
        k = self.lists.index(words)
        return F.col(f"{name}{k // PER_LONG}").bitwiseAND(F.lit(1 << (k % PER_LONG)).cast("long")) != 0

"""Token counts that follow edits without encoding a document again.

A document is a segment tree: its leaves are short runs of pre-tokens with their characters and tokens, inner nodes the sums of
both. Trees are kept in a table beside the texts, so that a later batch of edits starts from them. An edit goes down by
characters to the leaf it touches, takes a few characters of context before it, splits and counts from the begin of that leaf until the end of
an old leaf is met again, and updates the sums above. The rest of the document is neither split nor encoded again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, portions

LEAF = 8  # pre-tokens of a leaf; edits let a leaf grow to four times as many before it is cut
CACHED = 300_000


def context_of(pattern: str) -> int:
    """How many characters behind a pre-token can bear on where it ends, at most.

    A repetition looks one character ahead, and a fixed part can fail at its last one. Patterns that look
    behind, refer back, have anchors, or look ahead at more than one character are refused.
    """
    item = r"(?:\\[pP]\{\w+\}|\\.|\[(?:\\.|[^\]\\])*\]|[^\\\[\](){}|*+?])"
    if bad := [x for x in re.findall(r"\(\?[=!](.*?)\)", pattern) if not re.fullmatch(item, x)]:
        raise ValueError(f"a pattern that looks ahead at more than a character: {bad[0]}")
    plain = re.sub(r"\(\?[=!].*?\)|\[(?:\\.|[^\]\\])*\]|\\[pP]\{\w+\}", "", pattern)
    if re.search(r"\(\?<?[=!<]|\\[bBAZzGK0-9]|[\^$]", plain):
        raise ValueError("a pattern that looks behind, refers back or has anchors")
    literals = re.sub(r"\(\?[a-z]*:|\\.|[(){}|*+?.]", "", plain)
    return 2 + len(literals)


class Counter(dict):
    """Token counts of pre-tokens, kept up to a bound."""

    def __init__(self, ranks: str, pattern: str) -> None:
        super().__init__()
        with open(ranks, "rb") as file:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})
        self.split, self.context = regex.compile(pattern), context_of(pattern)

    def __missing__(self, piece: str) -> int:
        count = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = count
        return count

    def of(self, pieces: list[str]) -> list[int]:
        if len(self) > CACHED:
            self.clear()
        return list(map(self.__getitem__, pieces))


@lru_cache(maxsize=2)
def counter(ranks: str, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class CountTree:
    """Characters and tokens of the leaves of one text, and their sums over a binary tree: node 1 is the root.

    Node ``i`` has the children ``2 * i`` and ``2 * i + 1``; the leaves are the upper half. ``chars`` and ``tokens`` are all that is
    kept of a tree beside its text.
    """

    def __init__(self, text: str, counts: Counter, chars: list[int] | None = None, tokens: list[int] | None = None) -> None:
        self.text, self.counter = text, counts
        self.counted_again = 0  # characters split and counted by edits
        if chars is None or tokens is None:
            pieces = counts.split.findall(text)
            self._build(self._leaves(pieces))
        else:
            self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2

    def _leaves(self, pieces: list[str]) -> list[tuple[int, int]]:
        """Characters and tokens of runs of pre-tokens."""
        lengths, counted = list(map(len, pieces)), self.counter.of(pieces)
        return [(sum(lengths[i : i + LEAF]), sum(counted[i : i + LEAF])) for i in range(0, len(pieces), LEAF)]

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.size = 1 << max(len(leaves) - 1, 0).bit_length()
        empty = [0] * (self.size - len(leaves))
        self.chars, self.tokens = (self._summed([x[i] for x in leaves] + empty) for i in (0, 1))

    @staticmethod
    def _summed(level: list[int]) -> list[int]:
        """All nodes from the lowest level up, the unused node 0 first."""
        levels = [level]
        while len(level) > 1:
            levels.append(level := list(map(add, level[::2], level[1::2])))
        return [0, *chain.from_iterable(reversed(levels))]

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _update(self, first: int, last: int) -> None:
        """Sums above the leaves ``first`` to ``last``, each once."""
        first, last = (first + self.size) // 2, (last + self.size) // 2
        while first:
            for node in range(first, last + 1):
                self._sum(node)
            first, last = first // 2, last // 2

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts."""
        node, rest = 1, char
        while node < self.size:
            node *= 2
            if rest >= self.chars[node]:
                rest -= self.chars[node]
                node += 1
        return node - self.size, char - rest

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters from ``at`` on; places outside the text are moved to its ends."""
        old = len(self.text)
        at = min(max(at, 0), old)
        deleted = min(max(deleted, 0), old - at)
        self.text = self.text[:at] + inserted + self.text[at + deleted :]
        leaf, start = self._find(max(min(at - self.counter.context, old - 1), 0)) if old else (0, 0)
        shift = len(inserted) - deleted
        # ends of old leaves from here on, while the new text is split
        last, old_end = leaf, start + self.chars[self.size + leaf]
        pieces, new_end = [], start
        for match in self.counter.split.finditer(self.text, start):
            pieces.append(match.group())
            new_end = match.end()
            while old_end < max(new_end - shift, at + deleted) and last + 1 < self.size:
                last += 1
                old_end += self.chars[self.size + last]
            if new_end >= at + len(inserted) and old_end == new_end - shift:
                break
        else:  # the text ends without a common boundary: all that is left goes
            last = self.size - 1
        self.counted_again += new_end - start
        self._replace(leaf, last, pieces)

    def _replace(self, leaf: int, last: int, pieces: list[str]) -> None:
        if len(pieces) <= 4 * LEAF:
            found = [(sum(map(len, pieces)), sum(self.counter.of(pieces)))]
        else:
            found = self._leaves(pieces)
        if len(found) > last - leaf + 1:
            every = list(zip(self.chars[self.size :], self.tokens[self.size :], strict=True))
            every[leaf : last + 1] = found
            while every and every[-1] == (0, 0):
                every.pop()
            self._build(every)
            return
        found += [(0, 0)] * (last - leaf + 1 - len(found))
        for i, (chars, tokens) in enumerate(found, self.size + leaf):
            self.chars[i], self.tokens[i] = chars, tokens
        self._update(leaf, last)


#: What is kept of a tree, and what a batch of edits adds.
KEPT, COUNTED = ("chars", "tokens"), ("n_tokens_before", "n_tokens", "n_edits", "counted_again")


def _edited(
    rows: DataFrame, ranks: str, pattern: str, text: str, edits: str | None, chars: str | None, tokens: str | None, told: list[str]
) -> DataFrame:
    """Other columns as they are, the text after the edits, its tree, and the four numbers of ``COUNTED``, under the names ``told``."""
    others = [c for c in rows.columns if c not in (text, edits, chars, tokens)]
    wanted = [F.col(f"`{text}`").cast("string").alias("text")]
    kind = "array<struct<at:bigint,deleted:bigint,inserted:string>>"
    wanted.append((F.col(f"`{edits}`") if edits else F.lit(None)).cast(kind).alias("edits"))
    wanted += [(F.col(f"`{c}`") if c else F.lit(None)).cast("array<int>").alias(n) for c, n in ((chars, "chars"), (tokens, "tokens"))]
    inner = rows.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("others") if others else F.lit(0).alias("others"), *wanted)
    schema = f"others {inner.schema['others'].dataType.simpleString()}, text string, chars array<int>, tokens array<int>, before long, after long, edits long, again long"

    def counted(value: str | None, changes: Iterable[dict] | None, chars, tokens, counts: Counter) -> tuple:
        tree = CountTree(value or "", counts, chars, tokens)
        before, applied = tree.total, 0
        for change in changes or ():
            if change is not None:
                at = change["at"] if change["at"] is not None else len(tree.text)
                tree.edit(at, change["deleted"] or 0, change["inserted"] or "")
                applied += 1
        return tree.text, tree.chars, tree.tokens, before, tree.total, applied, tree.counted_again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(ranks, pattern)
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4)
        for batch in portions(batches):
            values = zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)
            found = zip(*(counted(*v, counts) for v in values), strict=True)
            arrays = [pa.array(list(c), t) for c, t in zip(found, kinds, strict=True)]
            names = ["others", "text", *KEPT, "before", "after", "edits", "again"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    done = inner.mapInArrow(run, schema)
    kept = [F.col("others")[c].alias(c) for c in others]
    numbers = [F.col(c).alias(n) for c, n in zip(("before", "after", "edits", "again"), told[2:], strict=True)]
    return done.select(*kept, F.col("text").alias(text), F.col("chars").alias(told[0]), F.col("tokens").alias(told[1]), *numbers)


def plant(docs: DataFrame, ranks: str, pattern: str, text: str = "text", edits: str | None = None) -> DataFrame:
    """``docs`` with the trees of its texts: the columns of ``KEPT`` and ``COUNTED`` added, the text after ``edits`` if there are any.

    Where ``docs`` has a column of such a name, the added one ends in an underscore. To be kept, the result is written as a table.
    """
    names = fresh(docs.drop(*([edits] if edits else [])), *KEPT, *COUNTED)
    return _edited(docs, ranks, pattern, text, edits, None, None, names)


def apply_edits(trees: DataFrame, ranks: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Kept ``trees`` after the column ``edits``, as ``plant`` gives them; only regions that edits touch are split and counted.

    ``edits`` is ``array<struct<at, deleted, inserted>>``: applied in their order, each to the text the one before left. Null texts
    are empty; null edits, and null members of one, change nothing. Places beyond the text are its end. Repeated rows are counted
    one by one; texts of any length are held whole. ``counted_again`` is how many characters were split again. The trees'
    columns must have the names of ``KEPT``; edits of another table are joined to them first, see ``with_edits``.
    """
    rest = trees.drop(*COUNTED)
    return _edited(rest, ranks, pattern, text, edits, *KEPT, [*KEPT, *COUNTED])


def with_edits(trees: DataFrame, batch: DataFrame, id: str = "doc_id", edits: str = "edits") -> DataFrame:
    """``trees`` with the edits of ``batch`` ``(id, edits)``; documents without any have null, which changes nothing."""
    known = batch.select(F.col(f"`{id}`"), F.col(f"`{edits}`"))
    return trees.join(known, id, "left")


def count_edited(
    docs: DataFrame, ranks: str, pattern: str, id: str = "doc_id", text: str = "text", edits: str = "edits"
) -> DataFrame:
    """``(id, n_tokens_before, n_tokens, n_edits, counted_again)`` for every row of ``docs``; ``edits`` as in ``apply_edits``.

    Null texts are empty and have no tokens; repeated rows and null ids are counted one by one; a text of any length is held
    whole by one task. Other columns of ``docs`` are not read, whatever their names; an empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{edits}`").alias("edits"))
    planted = plant(narrow, ranks, pattern, edits="edits")
    return planted.select(F.col("id").alias(id), *COUNTED)

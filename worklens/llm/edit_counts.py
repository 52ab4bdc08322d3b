"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Leaves hold up to ``LEAF`` pre-tokens with their lengths and token counts; inner nodes
hold the sums of their subtrees. An edit walks down to the leaves it touches, parts the
text anew from a little before the change until a boundary of the old parting is met again
behind it, encodes only those pre-tokens, and updates the sums on the way up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.tokens import RANKS, Counter, pretokens

LEAF = 32
#: Pre-tokens before an edit that are parted anew: the pattern looks at most two characters past a pre-token.
BACK = 3

EDITS = "array<struct<start:int,end:int,text:string>>"


class PretokenTree:
    """Pre-tokens of one text, editable."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        pieces = pretokens.findall(text)
        self.made = len(pieces)
        self._build(list(map(len, pieces)), counter.counts(pieces))

    def _build(self, lengths: list[int], tokens: list[int]) -> None:
        self.leaves = [(lengths[a : a + LEAF], tokens[a : a + LEAF]) for a in range(0, len(lengths), LEAF)] or [([], [])]
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (n, t) in enumerate(self.leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(n), sum(t)
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with text, at the end), and where it begins."""
        node, before = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def prefix_tokens(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before character ``at``, from subtree sums and one leaf."""
        leaf, before = self.find(at)
        node, total = leaf + self.size, 0
        while node > 1:
            if node & 1:
                total += self.tokens[node - 1]
            node //= 2
        for n, t in zip(*self.leaves[leaf], strict=True):
            before += n
            if before > at:
                break
            total += t
        return total

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters ``start`` to ``end`` by ``new``; returns the pre-tokens that were encoded anew."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        first, at = self.find(start)
        # A few pre-tokens before the one that the edit touches.
        while first > 0 and self._before(first, at, start) < BACK:
            first -= 1
            at -= self.chars[self.size + first]
        lengths, tokens = self.leaves[first]
        kept = max(0, self._before(first, at, start) - BACK)
        begin = at + sum(lengths[:kept])
        last, offset, old = first, kept, begin
        pieces, here = [], begin
        for match in pretokens.finditer(self.text, begin):
            pieces.append(match.group())
            here = match.end()
            if here < start + len(new):
                continue
            while last < len(self.leaves) and old < here - shift:
                n = self.leaves[last][0]
                while offset < len(n) and old < here - shift:
                    old += n[offset]
                    offset += 1
                if offset == len(n):
                    last, offset = last + 1, 0
            if old == here - shift and old >= end:
                break
        else:
            last, offset = len(self.leaves), 0
        made = self.counter.counts(pieces)
        tail = self.leaves[last] if last < len(self.leaves) else ([], [])
        lengths = lengths[:kept] + list(map(len, pieces)) + tail[0][offset:]
        tokens = tokens[:kept] + made + tail[1][offset:]
        self.made += len(pieces)
        self._replace(first, min(last, len(self.leaves) - 1), lengths, tokens)
        return len(pieces)

    def _before(self, leaf: int, at: int, start: int) -> int:
        """Pre-tokens of a leaf (and those after it) that end at or before ``start``."""
        n = 0
        while leaf < len(self.leaves):
            for length in self.leaves[leaf][0]:
                at += length
                if at > start:
                    return n
                n += 1
            leaf += 1
        return n

    def _replace(self, first: int, last: int, lengths: list[int], tokens: list[int]) -> None:
        """Put new contents into leaves ``first`` to ``last`` and update their paths; a leaf that grew large parts the tree anew."""
        share = -(-len(lengths) // (last - first + 1))
        if share > 4 * LEAF:
            n = [x for leaf in self.leaves[:first] for x in leaf[0]] + lengths + [x for leaf in self.leaves[last + 1 :] for x in leaf[0]]
            t = [x for leaf in self.leaves[:first] for x in leaf[1]] + tokens + [x for leaf in self.leaves[last + 1 :] for x in leaf[1]]
            self._build(n, t)
            return
        touched = set()
        for k in range(first, last + 1):
            a = (k - first) * share
            self.leaves[k] = lengths[a : a + share], tokens[a : a + share]
            self.chars[self.size + k], self.tokens[self.size + k] = sum(self.leaves[k][0]), sum(self.leaves[k][1])
            touched.add((self.size + k) // 2)
        while touched - {0}:
            for k in touched:
                self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]
            touched = {k // 2 for k in touched if k > 1}


def counted(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """Token counts of ``rows`` (doc_id, text, edits) before and after their edits, applied in order.

    ``edits`` is an array of (start, end, text) in code points of the text as
    the edits before left it; places beyond it are moved to its end, a NULL place is 0 and a NULL text
    empty. Returns doc_id, n_pretokens, n_tokens, n_edits, tokens_after, recoded (pre-tokens
    encoded anew by the edits). NULL and empty texts have no tokens until an edit puts some in; NULL edits are
    none. Repeated rows are counted one by one.
    An empty table gives no rows; texts are taken whole at any length. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = PretokenTree(text.as_py() or "", counter)
                pieces, before = tree.made, tree.total
                done = [tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in edits.as_py() or ()]
                out.append((pieces, before, len(done), tree.total, sum(done)))
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_pretokens", "n_tokens", "n_edits", "tokens_after", "recoded"])

    rows = rows.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_edits long, tokens_after long, recoded long")


def edited_counts(docs: DataFrame, edits: DataFrame, path: str = RANKS) -> DataFrame:
    """``counted`` for ``docs`` (doc_id, text) with an edit table (doc_id, seq, start, end, text): those of a document by seq."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("edits"))
    listed = listed.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"))).alias("edits"))
    return counted(docs.select("doc_id", "text").join(listed, "doc_id", "left"), path)

"""Prefix trie of conversations: padded matrices of turn ids, sorted by NumPy, nodes found by change masks.

Conversations are dealt to shards by range of their turn ids, so a node's members
follow each other. A slice of a shard is a padded matrix: lexsort puts its rows in order, the
changes from row to row, or-ed from left to right, mark where nodes start, and reduceat sums every depth.
Nodes of a slice's first and last row may go on in another slice: they stay open, and come back as two
rows of partial sums. The same step over ranges of such rows closes them, level by level, until one slice holds all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.words import mix
from worklens.session import checkpoint, small

#: Cells of a slice's matrix, and rows that it has at least, whatever their length.
CELLS, LEAST = 400_000, 8
_MOST = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
_PATH, _SUMS = ("a", "b", "w"), ("n", "low", "kids", "leaves", "saved")
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_KINDS = {"kind": pa.int32(), **dict.fromkeys(_NODE, pa.int64()), "ends_sha256": pa.string(), **dict.fromkeys(("k1", "k2", "p1", "p2"), pa.int64())}
_KINDS |= {**dict.fromkeys(_PATH + _SUMS, pa.list_(pa.int64())), "first": pa.int64(), "piece": pa.string()}
_SCHEMA = ", ".join(f"{k} {({pa.int32(): 'int', pa.int64(): 'long', pa.string(): 'string'}).get(t, 'array<long>')}" for k, t in _KINDS.items())
#: Kinds of rows that a slice gives: whole nodes, rows of open nodes, and ids that end in open nodes.
NODE, OPEN, PIECE = 0, 1, 2


def _batch(kind: int, rows: int, /, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(rows, kind, np.int32)
    made = [pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(made, list(_KINDS))


def _padded(column: pa.Array, width: int, fill: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(column), width), fill, np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _numbers(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the ids (a, b) where ``alive``, in their order; 0 elsewhere."""
    x, y = a[alive], b[alive]
    order = np.lexsort((y, x))
    new = np.ones(len(x), np.int64)
    new[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    out = np.zeros(a.shape, np.int64)
    numbers = np.empty(len(x), np.int64)
    numbers[order] = np.cumsum(new)
    out[alive] = numbers
    return out


class Slice:
    """The part of the trie that some paths make, nodes by the row at which they start."""

    def __init__(self, table: pa.Table, whole: bool):
        column = {k: table[k].combine_chunks() for k in table.column_names}
        lengths = column["a"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.count, self.width, self.whole = len(lengths), int(lengths.max()), whole
        deep = np.arange(self.width + 1)
        a, b, w = (_padded(column[k], self.width, 0) for k in _PATH)
        ids = _numbers(a, b, lengths[:, None] > deep[:-1])
        conv = column["conv_id"].to_numpy() if "conv_id" in column else np.zeros(self.count, np.int64)
        order = np.lexsort((conv, *(ids[:, d] for d in reversed(range(self.width)))))
        ids, self.lengths, self.conv = ids[order], lengths[order], conv[order]
        self.a, self.b, self.w = a[order], b[order], w[order]
        self.alive = self.lengths[:, None] >= deep
        if "n" in column:
            self.sums = {k: _padded(column[k], self.width + 1, _MOST if k == "low" else 0)[order] for k in _SUMS}
        else:
            zero = np.zeros(self.alive.shape, np.int64)
            self.sums = dict.fromkeys(_SUMS, zero) | {"n": self.alive.astype(np.int64), "low": np.where(self.alive, self.conv[:, None], _MOST)}
        fresh = np.zeros(self.alive.shape, bool)
        fresh[0] = True
        fresh[1:, 1:] = np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1)
        self.node = fresh & self.alive
        self.starts = [np.flatnonzero(fresh[:, d]) for d in range(self.width + 1)]
        self._keys()
        self._total()

    def _keys(self) -> None:
        """Two 64-bit keys of every path from the root."""
        self.k1, self.k2 = (np.zeros(self.alive.shape, np.uint64) for _ in range(2))
        for d in range(self.width):
            for k, ids, step in ((self.k1, self.a, 0x9E3779B97F4A7C15), (self.k2, self.b, 0xC2B2AE3D27D4EB4F)):
                k[:, d + 1] = mix(k[:, d] * np.uint64(step) + ids[:, d].astype(np.uint64) + np.uint64(1))
        self.k1, self.k2 = self.k1.view(np.int64), self.k2.view(np.int64)

    def _total(self) -> None:
        """Sums of every node's members, then of its subtree; open nodes count neither as leaves nor their own copies."""
        shape = self.alive.shape
        self.n, self.kids, self.leaves, self.saved = (np.zeros(shape, np.int64) for _ in range(4))
        self.low, self.open = np.full(shape, _MOST), np.zeros(shape, bool)
        for d, s in enumerate(self.starts):
            total = lambda k: np.add.reduceat(self.sums[k][:, d], s)  # noqa: B023, E731
            self.n[s, d], self.low[s, d] = total("n"), np.minimum.reduceat(self.sums["low"][:, d], s)
            self.kids[s, d] = total("kids") + (np.add.reduceat(self.node[:, d + 1].astype(np.int64), s) if d < self.width else 0)
            if not self.whole:
                self.open[0, d] = self.alive[0, d]
                self.open[s[-1], d] |= self.alive[-1, d]
            closed = self.node[s, d] & ~self.open[s, d]
            self.leaves[s, d] = total("leaves") + (closed & (self.kids[s, d] == 0))
            self.saved[s, d] = total("saved") + (np.where(closed, (self.n[s, d] - 1) * self.w[s, d - 1], 0) if d else 0)
        for values in (self.leaves, self.saved):
            right = np.cumsum((values * self.node)[:, ::-1], axis=1)[:, ::-1].copy()
            for d, s in enumerate(self.starts):
                values[s, d] = np.add.reduceat(right[:, d], s)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All that the slice gives."""
        pieces: list[tuple] = []
        for d, s in enumerate(self.starts):
            ends = self._ends(d, s, pieces)
            at = np.flatnonzero(self.node[s, d] & ~self.open[s, d])
            r = s[at]
            if len(r) == 0:
                continue
            made = {"conv_id": self.low[r, d], "depth": np.full(len(r), d), "n_convs": self.n[r, d], "n_children": self.kids[r, d], "n_leaves": self.leaves[r, d], "saved_tokens": self.saved[r, d]}
            if d:
                above = self.starts[d - 1][np.searchsorted(self.starts[d - 1], r, "right") - 1]
                unknown = self.open[above, d - 1]  # its smallest member may be in another slice
                made["parent_conv_id"] = pa.array(self.low[above, d - 1], mask=unknown)
                made["p1"], made["p2"] = (pa.array(k[above, d - 1], mask=~unknown) for k in (self.k1, self.k2))
            yield _batch(NODE, len(r), **made, k1=self.k1[r, d], k2=self.k2[r, d], ends_sha256=[ends[k] for k in at])
        if pieces:
            yield _batch(PIECE, len(pieces), **{k: list(v) for k, v in zip(("k1", "k2", "first", "piece"), zip(*pieces, strict=True), strict=True)})
        if not self.whole:
            edges = [self._edge(last) for last in (False, True)][: 2 if self._apart() else 1]
            yield _batch(OPEN, len(edges), **{k: [e[k] for e in edges] for k in _PATH + _SUMS})

    def _ends(self, d: int, s: np.ndarray, pieces: list[tuple]) -> list[str]:
        """Digest of the ids that end in each node of a depth: they come first among its rows. Open nodes give pieces."""
        digests = [_EMPTY] * len(s)
        ending = np.add.reduceat((self.lengths == d).astype(np.int64), s)
        for k in np.flatnonzero((ending > 0) & self.node[s, d]):
            row = s[k]
            text = ",".join(map(str, self.conv[row : row + ending[k]].tolist()))
            if self.open[row, d]:
                pieces.append((int(self.k1[row, d]), int(self.k2[row, d]), int(self.conv[row]), text))
            else:
                digests[k] = hashlib.sha256(text.encode()).hexdigest()
        return digests

    def _apart(self) -> bool:
        """Whether the last row has open nodes that the first has not."""
        return any(s[-1] > 0 and self.alive[-1, d] for d, s in enumerate(self.starts))

    def _edge(self, last: bool) -> dict[str, np.ndarray]:
        """The path of the first or last row; per open node its members and what is under it, without open nodes. The first row has what both share."""
        row = self.count - 1 if last else 0
        length = int(self.lengths[row])
        sums = {k: np.full(length + 1, _MOST if k == "low" else 0) for k in _SUMS}
        for d in range(length + 1):
            s = self.starts[d]
            start, stop = (s[-1], self.count) if last else (0, s[1] if len(s) > 1 else self.count)
            if last and start == 0:
                continue
            below = set()
            if d < self.width:
                below = {int(c) for c, r in ((0, 0), (self.starts[d + 1][-1], self.count - 1)) if self.alive[r, d + 1] and start <= c < stop}
            sums["n"][d], sums["low"][d] = self.n[start, d], self.low[start, d]
            sums["kids"][d] = self.kids[start, d] - len(below)
            for k, under in (("leaves", self.leaves), ("saved", self.saved)):
                sums[k][d] = under[start, d] - sum(under[c, d + 1] for c in below)
        return {k: getattr(self, k)[row, :length] for k in _PATH} | sums


def _slices(batches: Iterator[pa.RecordBatch], whole: bool, cells: int) -> Iterator[pa.Table]:
    """Rows in order, as many as a matrix may hold at a time; all together if ``whole``."""
    held: list[pa.RecordBatch] = []
    count = width = 0
    for batch in batches:
        first = 0
        for i, length in enumerate(batch.column("a").value_lengths().to_pylist()):
            wider = max(width, length + 1)
            if not whole and count >= LEAST and (count + 1) * wider > cells:
                yield pa.Table.from_batches([*held, batch.slice(first, i - first)])
                held, first, count, wider = [], i, 0, length + 1
            count, width = count + 1, wider
        held.append(batch.slice(first))
    if count:
        yield pa.Table.from_batches(held)


def _folded(rows: DataFrame, whole: bool, cells: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, whole, cells):
            yield from Slice(table, whole).rows()

    return checkpoint(rows.mapInArrow(run, _SCHEMA))


def _digests(pieces: DataFrame) -> DataFrame:
    """(k1, k2, digest): pieces of a node joined by commas in order of their first id, streamed through one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for k1, k2, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (k1, k2), hashlib.sha256()
                digest.update(piece.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "digest"), d, strict=True)) for d in done], pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.string())]))
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"k1": node[0], "k2": node[1], "digest": digest.hexdigest()}])

    ordered = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return ordered.select("k1", "k2", "first", "piece").mapInArrow(run, "k1 long, k2 long, digest string")


def paths(conversations: DataFrame) -> DataFrame:
    """Per conv_id of ``conversations`` (conv_id, turn, role, text): conv_id and its turns, an array of (a, b, w).

    (a, b) is a 128-bit id of role and text, w the words of the text; NULL role or text is empty.
    Turns come in order of ``turn``, NULL first; rows with the same turn in order of role, then of id, none is
    dropped. Texts are read whole, but only their ids are gathered, so a conversation of any number of turns that fits one row (24 bytes
    a turn) is taken. Rows without conv_id belong to no conversation; an empty table gives none. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"),
                 F.xxhash64(F.lit(17), text, role).alias("b"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")).alias("t"),
    )
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["w"].alias("w"))).alias("path"))


def prefix_trie(found: DataFrame, cells: int = CELLS) -> DataFrame:
    """Per node of the trie of ``found`` (conv_id, path as ``paths`` gives it): one row for each distinct beginning of a path, the empty one among them.

    conv_id (smallest member), depth, parent_conv_id (NULL for the root), n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (over the subtree: members but one, times words of the node's last turn) and ends_sha256 (of the members' ids that end
    there, rising, joined by commas). A path may be empty or long; equal paths are members of the same nodes; without paths there are no nodes.
    ``cells`` bounds a slice's matrix and changes no result.
    """
    start = checkpoint(found.select("conv_id", "path"))
    ordered = start.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    level = _folded(ordered.select("conv_id", *(F.col("path")[k].alias(k) for k in _PATH)), False, cells)
    nodes, pieces, later = level.where(F.col("kind") == NODE), level.where(F.col("kind") == PIECE), None
    before = None
    while True:
        edges = level.where(F.col("kind") == OPEN).select(*_PATH, *_SUMS)
        count, width = edges.agg(F.count("*"), F.max(F.size("n"))).first()
        if not count:
            break
        # One slice for the rest once it is small, or if there is nothing to win by another level.
        whole = count * width <= cells or count <= LEAST or (before is not None and count >= before)
        before = count
        turns = F.arrays_zip("a", "b")
        edges = edges.repartition(1) if whole else edges.repartitionByRange(max(1, count // (8 * LEAST)), turns).sortWithinPartitions(turns)
        level = _folded(edges, whole, cells)
        closed = level.where(F.col("kind") == NODE)
        later = closed if later is None else later.unionByName(closed)
        if whole:
            break
    columns = (*_NODE, "ends_sha256")
    if later is None:
        return nodes.select(*columns)
    # Nodes that were open: their members' ids came in pieces, and their children wait for their smallest member.
    later = checkpoint(later.drop("ends_sha256").join(_digests(pieces), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(_EMPTY))))
    above = small(later.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above")))
    every = nodes.select(*columns, "p1", "p2").unionByName(later.select(*columns, "p1", "p2"))
    known = every.where("p1 is null").select(*columns)
    waiting = every.where("p1 is not null").join(above, ["p1", "p2"], "left").withColumn("parent_conv_id", F.col("above"))
    return known.unionByName(waiting.select(*columns))

"""License scan: ordered signature rules behind a keyword filter, overlaps resolved by priority and containment.

Texts become plain words on Arrow buffers. A rule's regex runs only where its
keyword occurs. A detection goes if it lies within that of an earlier rule.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.license_rules import BASE_RULES, RULES, Rule
from worklens.llm.words import LOWER, parts

#: Bytes as they stand in plain words: blank is whatever is neither digit, letter nor beyond ASCII.
_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
#: Keywords are looked for only in texts with their root.
ROOTS = ("licen", "cc", "gnu", "gpl", "apache", "commons", "public", "right", "permission", "redistribut", "commercial", "domain", "use", "software")


def _by_root(rules: list[Rule]) -> dict[str, dict[str, list[Rule]]]:
    """Rules by keyword, keywords by the first root that they contain (a keyword without one is its own)."""
    roots: dict[str, dict[str, list[Rule]]] = {}
    for rule in rules:
        root = next((r for r in ROOTS if r in rule.keyword), rule.keyword)
        roots.setdefault(root, {}).setdefault(rule.keyword, []).append(rule)
    return roots


class Plain:
    """The plain words of some texts: `` one two three `` for each, and where its words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        plain = _PLAIN[data]
        inside = plain != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] = inside[edges]
        starts = np.flatnonzero(first)
        # One blank stands before every word, and one at the end.
        place = np.cumsum(inside) - 1 + np.cumsum(first)
        out = np.full(int(inside.sum()) + len(starts) + 1, 32, np.uint8)
        out[place[inside]] = plain[inside]
        self.text = out.tobytes().decode("latin-1")
        self.begins = place[starts] if len(starts) else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(starts, offsets)

    def of(self, row: int) -> tuple[str, np.ndarray]:
        """A text and the places of its words in it."""
        a, b = int(self.bounds[row]), int(self.bounds[row + 1])
        if a == b:
            return "", np.zeros(0, np.int64)
        low = int(self.begins[a]) - 1
        high = int(self.begins[b]) if b < len(self.begins) else len(self.text)
        return self.text[low:high], self.begins[a:b] - low


def unsuppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Of detections (first word, word behind the last, rule) those within none of an earlier rule, by start.

    Whatever lies within a suppressed detection lies within what suppressed
    it, so only kept ones are compared: of them, those within no other kept one form stairs,
    whose starts and ends both rise.
    """
    kept, lows, highs = [], [], []
    for low, high, rule in sorted(found, key=lambda d: (d[2].order, d[0], -d[1])):
        at = bisect_right(lows, low)
        if at and highs[at - 1] >= high:
            continue
        kept.append((low, high, rule))
        a, b = bisect_left(lows, low), bisect_right(highs, high)
        lows[a : max(a, b)], highs[a : max(a, b)] = [low], [high]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].order))


def detections(text: str, begins: np.ndarray, roots: dict[str, dict[str, list[Rule]]]) -> list[tuple[int, int, Rule]]:
    """What the rules find in a plain text, as word ranges."""
    found = []
    for root, keywords in roots.items():
        if root not in text:
            continue
        for keyword, rules in keywords.items():
            if keyword not in text:
                continue
            for rule in rules:
                for m in rule.regex.finditer(text):
                    low, high = np.searchsorted(begins, m.span())
                    found.append((int(low), int(high), rule))
    return found


_FOUND = "array<struct<start:long,stop:long,label:string,confidence:double>>"


def license_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, base and found, arrays of (start, stop, label, confidence) in words.

    ``base`` has every place of a base phrase, ``found`` the detections of all rules
    that no earlier rule's detection contains (base phrases among them). NULL, empty and
    blank texts have no words and two empty arrays; texts are read whole at any length.
    Repeated rows each come back; a NULL doc_id stays NULL; an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, base = _by_root(RULES), {rule.order for rule in BASE_RULES}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))
        listed = lambda spans: [(low, high, rule.label, rule.confidence) for low, high, rule in spans]
        for batch in batches:
            counts, bases, others = [], [], []
            for _, data, offsets in parts(batch.column(1)):
                plain = Plain(data, offsets)
                counts.append(np.diff(plain.bounds))
                for row in range(len(offsets) - 1):
                    found = detections(*plain.of(row), roots)
                    bases.append(listed(sorted(d for d in found if d[2].order in base)))
                    others.append(listed(unsuppressed(found)))
            if bases:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(bases, kind), pa.array(others, kind)], ["doc_id", "n_words", "base", "found"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, base {_FOUND}, found {_FOUND}")


def labels_of(*spans: str) -> Column:
    """Distinct labels of span columns, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(s)["label"] for s in spans]))), ",")


def score_of(spans: str) -> Column:
    """How sure the surest detection is; 0 without one."""
    return F.coalesce(F.array_max(F.col(spans)["confidence"]), F.lit(0.0))

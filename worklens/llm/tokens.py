"""Public byte-level BPE vocabularies: the file is a parameter and is read where it is needed, never copied."""

from __future__ import annotations

import base64
import functools
import os

import regex
import tiktoken

#: Vocabulary file of ranks (base64 bytes, blank, rank on each line) and the pattern that parts texts into pre-tokens.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens whose counts a process remembers at most; beyond it the memory starts anew.
REMEMBERED = 500_000


@functools.lru_cache(maxsize=2)
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


pretokens = regex.compile(PATTERN)


class Counter:
    """Tokens of pre-tokens; ``made`` counts those that were encoded for a text, remembered or not."""

    def __init__(self, path: str = RANKS):
        self.encode = encoding(path).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = {p for p in pieces if p not in known}
        for p in new:
            known[p] = len(self.encode(p))
        return [known[p] for p in pieces]

"""Values at unknown places of JSON texts, found with one iterative walk.

A text that is no JSON, or is nested too deeply for the JSON reader, holds no value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

#: Levels below the top that an envelope is searched.
ENVELOPE_DEPTH = 4

_TERMINAL = re.compile("\x1b\\[[0-9;]*m")
_OPENING = re.compile(r"[\[{]")
_reader = json.JSONDecoder()


def first_value(text: str | None) -> Any:
    """The first JSON object or list in a text, behind terminal codes and other noise."""
    plain = _TERMINAL.sub("", text or "")
    for kind in _OPENING.finditer(plain):
        try:
            return _reader.raw_decode(plain, kind.start())[0]
        except ValueError:
            continue
        except RecursionError:
            break
    return None


def children(node: Any) -> list:
    """Values of an object, members of a list, the value written in a text."""
    if isinstance(node, dict):
        return list(node.values())
    if isinstance(node, list):
        return node
    inner = first_value(node) if isinstance(node, str) else None
    return [] if inner is None else [inner]


def walk(root: Any, below: Callable[[Any], list] = children, depth: int | None = None) -> Iterator[Any]:
    """Nodes of a tree, parents first and in order, down to ``depth`` levels below the root."""
    waiting = [(root, 0)]
    while waiting:
        node, level = waiting.pop()
        yield node
        if depth is None or level < depth:
            waiting.extend((child, level + 1) for child in reversed(below(node)))


def result_list(root: Any, depth: int | None = ENVELOPE_DEPTH) -> list | None:
    """The first list named ``results``. Members of a list are searched only if they are objects."""

    def below(node: Any) -> list:
        return [x for x in children(node) if not isinstance(node, list) or isinstance(x, dict)]

    return next((n["results"] for n in walk(root, below, depth) if isinstance(n, dict) and isinstance(n.get("results"), list)), None)


def message(root: Any, depth: int | None = ENVELOPE_DEPTH) -> str | None:
    """The first written text among ``error``, ``message`` and ``msg`` of an object, or inside their objects."""

    def below(node: Any) -> list:
        if not isinstance(node, dict):
            return children(node)
        named = [node.get(k) for k in ("error", "message", "msg")]
        return [(x,) if isinstance(x, str) else x for x in named if isinstance(x, (str, dict))]

    return next((n[0].strip() for n in walk(root, below, None if depth is None else depth + 1) if isinstance(n, tuple) and n[0].strip()), None)


def described_job(root: Any) -> dict | None:
    """The first object with a title and a description."""
    for node in walk(root, lambda n: children(n) if isinstance(n, (dict, list)) else []):
        if isinstance(node, dict) and {"jobDescription", "description"} & node.keys() and {"title", "jobTitle", "job_title"} & node.keys():
            return node
    return None

"""Trees of any depth: functions of trees call themselves once or more a level, and JSON is written and read without calls where its own
functions give up."""

from __future__ import annotations

import json
import re
import sys

#: Calls that a character of a text can lead to within each other; a bracket of a condition takes six.
CALLS = 8


def room(characters: int) -> None:
    """Lets functions call themselves as deeply as a text of this length can make them. Calls among Python functions take memory
    as they go, and no stack of the process."""
    needed = 20_000 + CALLS * characters
    if needed > sys.getrecursionlimit():
        sys.setrecursionlimit(needed)


class _Mark(str):
    """What is written as it stands."""


def to_json(value) -> str:
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return _written(value)


def _written(value) -> str:
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Mark):
            out.append(x)
        elif isinstance(x, dict) and x:
            todo.append(_Mark("}"))
            for i, (k, v) in reversed(list(enumerate(x.items()))):
                todo += [v, _Mark(f"{', ' if i else '{'}{json.dumps(k, ensure_ascii=False)}: ")]
        elif isinstance(x, (list, tuple)) and x:
            todo.append(_Mark("]"))
            for i, v in reversed(list(enumerate(x))):
                todo += [v, _Mark(", " if i else "[")]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_TOKEN = re.compile(rf'({STRING})|([\[\]{{}}])|([^\s\[\]{{}},:"]+)')


def from_json(text: str):
    """The value of what to_json() has written."""
    room(len(text))
    try:
        return json.loads(text)
    except RecursionError:
        return _read(text)


def _read(text: str):
    whole: list = []
    todo = [(whole, [])]  # what is being filled, and a key that waits for its value

    def put(value) -> None:
        into, key = todo[-1]
        if isinstance(into, list):
            into.append(value)
        elif key:
            into[key.pop()] = value
        else:
            key.append(value)

    for m in _TOKEN.finditer(text):
        if m[2] in ("{", "["):
            value = {} if m[2] == "{" else []
            put(value)
            todo.append((value, []))
        elif m[2]:
            todo.pop()
        else:
            put(json.loads(m[0]))
    return whole[0]

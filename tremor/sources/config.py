"""Configurations: JSON and ``name = value`` texts, flattened, updated, merged; derived windows; short formats."""

from __future__ import annotations

import ast
import datetime as dt
import json
import math
import re

_LINE = re.compile(r"^(?P<name>[A-Za-z_][\w./@]*)\s*=\s*(?P<value>.*)$")


def flattened(tree: dict, prefix: str = "") -> dict:
    """Nested mappings as dotted keys."""
    out = {}
    for k, v in tree.items():
        out |= flattened(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def updated(tree: dict, changes: dict) -> dict:
    """``tree`` with dotted or nested changes; parts that are missing are made."""
    out = json.loads(json.dumps(tree))
    for key, value in flattened(changes).items():
        node, *path = out, *key.split(".")
        for name in path[:-1]:
            node = node.setdefault(name, {})
        node[path[-1]] = value
    return out


def read_json(text: str) -> dict:
    """Strict JSON: comments and trailing commas are errors."""
    return json.loads(text)


def plain(value: object) -> object:
    """Values that JSON can hold: NaN and infinities are null, arrays lists."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def parse_bindings(text: str) -> dict[str, object]:
    """Bindings of ``name = value`` lines; see ``parse_config``."""
    return parse_config(text)["bindings"]


def parse_config(text: str) -> dict[str, object]:
    """{"includes": files, "bindings": values by name}.

    ``#`` starts a comment. A value goes on over further lines while a bracket is open. A line
    that ends in a colon opens a scope: the indented lines after it bind ``scope.name``. An
    ``include`` line names another file. Values that are no literals stay text; other lines are an error.
    """
    includes, bindings, scope, name, value = [], {}, None, None, ""
    for number, line in enumerate(text.splitlines(), 1):
        body = _uncommented(line)
        if name is not None:
            value += "\n" + body
        elif not body.strip():
            continue
        elif found := re.match(r"include\s+(.+)$", body.strip()):
            includes.append(found[1].strip().strip("'\""))
            continue
        elif re.fullmatch(r"[A-Za-z_][\w./@]*\s*:", body.strip()):
            scope = body.strip()[:-1].rstrip()
            continue
        elif found := _LINE.match(body.strip()):
            scope = scope if body[:1].isspace() else None
            name, value = f"{scope}.{found['name']}" if scope else found["name"], found["value"]
        else:
            raise ValueError(f"line {number} binds nothing: {line!r}")
        if not _open(value):
            bindings[name], name = _literal(value), None
    if name is not None:
        raise ValueError(f"a bracket of {name} is never closed")
    return {"includes": includes, "bindings": bindings}


def _literal(value: str) -> object:
    try:
        return ast.literal_eval(value.strip())
    except (ValueError, SyntaxError):
        return value.strip()


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        elif c == "#":
            return line[:i].rstrip()
    return line.rstrip()


def _open(value: str) -> bool:
    return sum(value.count(c) for c in "([{") > sum(value.count(c) for c in ")]}")


def update_bindings(text: str, changes: dict[str, object]) -> str:
    """``text`` with values replaced in place, comments, scopes and order kept; new names come last.

    A name with a scope is found as ``scope.name`` at the margin or as ``name`` within the
    scope; a bare name is never replaced within a scope. Values that refer (``@``, ``%``) stay bare.
    """
    left, out, scope, open_ = dict(changes), [], None, ""
    shown = lambda v: v if isinstance(v, str) and v[:1] in ("@", "%") else repr(v)
    for line in text.splitlines():
        body = _uncommented(line)
        if open_:
            open_ += "\n" + body
            open_ = open_ if _open(open_) else ""
            continue
        found = _LINE.match(body.strip())
        if re.fullmatch(r"[A-Za-z_][\w./@]*\s*:", body.strip()):
            scope = body.strip()[:-1].rstrip()
        elif found:
            indent = body[: len(body) - len(body.lstrip())]
            scope = scope if indent else None
            name = f"{scope}.{found['name']}" if scope else found["name"]
            if name in left:
                out.append(f"{indent}{found['name']} = {shown(left.pop(name))}{line[len(body) :]}")
                open_ = found["value"] if _open(found["value"]) else ""
                continue
        out.append(line)
    return "\n".join([*out, *(f"{k} = {shown(v)}" for k, v in left.items())]) + "\n"


def year_windows(first: dt.datetime, last: dt.datetime, auxiliary_years: float, test_years: float) -> dict[str, dt.datetime]:
    """Days-aligned windows of a catalog; raises if they are not in order."""
    year = dt.timedelta(days=365.25)
    day = dt.timedelta(days=1)
    floor = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    end = floor(last + day - dt.timedelta(microseconds=1))
    out = {"auxiliary_start": floor(first), "timewindow_start": floor(first + auxiliary_years * year), "timewindow_end": floor(end - test_years * year), "testwindow_end": end}
    times = list(out.values())
    if any(a >= b for a, b in zip(times, times[1:])):
        raise ValueError(f"windows are not in order: {out}")
    return out


def between(a: dt.datetime, b: dt.datetime, share: float) -> dt.datetime:
    """A point between two times, such as the end of training before validation."""
    return a + (b - a) * share


def short_duration(seconds: float) -> str:
    """Days, hours or seconds with a unit."""
    if seconds >= 86400:
        return f"{seconds / 86400:.2f}d"
    return f"{seconds / 3600:.2f}h" if seconds >= 3600 else f"{seconds:.0f}s"

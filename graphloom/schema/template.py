"""Text templates: fields, conditions and loops in double braces.

`{{.a.b}}` writes a field, `{{index .a 0}}` an element, `{{json .a}}` it as JSON; `{{if .a}} ... {{else}} ...
{{end}}` and `{{range .a}} ... {{end}}` enclose text, in a loop `.` is the element and `$` the
whole context, `{{$i}}` its number from 0. A field that is missing is empty.
"""

from __future__ import annotations

import json
import re

_TAG = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)


class TemplateError(ValueError):
    pass


def _parse(text: str) -> list:
    """Nested lists of texts, (expression,) and (kind, expression, then, otherwise)."""
    stack: list[list] = [[]]
    opened: list[list] = []
    at = 0
    for m in _TAG.finditer(text):
        stack[-1].append(text[at : m.start()])
        at, tag = m.end(), m[1]
        word, _, rest = tag.partition(" ")
        if word in ("if", "range"):
            opened.append([word, rest.strip(), [], []])
            stack.append(opened[-1][2])
        elif tag == "else":
            if not opened:
                raise TemplateError("else without if")
            stack[-1] = opened[-1][3]
        elif tag == "end":
            if not opened:
                raise TemplateError("end without if or range")
            stack.pop()
            stack[-1].append(tuple(opened.pop()))
        else:
            stack[-1].append((tag,))
    if opened:
        raise TemplateError(f"{opened[-1][0]} without end")
    stack[-1].append(text[at:])
    return stack[0]


def _value(expression: str, here, whole, number: int):
    if expression.startswith("json "):
        return json.dumps(_value(expression[5:].strip(), here, whole, number))
    if expression.startswith("index "):
        name, _, key = expression[6:].strip().rpartition(" ")
        held = _value(name, here, whole, number)
        key = key.strip('"')
        try:
            return held[int(key)] if isinstance(held, (list, tuple)) else held.get(key, held.get(int(key)) if key.isdigit() else None)
        except (IndexError, AttributeError):
            return None
    if expression == "$i":
        return number
    if not expression.startswith((".", "$.")):
        raise TemplateError(f"no expression: {expression}")
    held = whole if expression.startswith("$.") else here
    for name in filter(None, expression.lstrip("$").split(".")):
        held = held.get(name) if isinstance(held, dict) else None
    return held


def render(text: str, context: dict) -> str:
    def write(parts: list, here, number: int) -> str:
        out = []
        for p in parts:
            if isinstance(p, str):
                out.append(p)
            elif len(p) == 1:
                v = _value(p[0], here, context, number)
                out.append("" if v is None else str(v))
            elif p[0] == "if":
                out.append(write(p[2] if _value(p[1], here, context, number) else p[3], here, number))
            else:
                held = _value(p[1], here, context, number) or []
                out += [write(p[2], x, k) for k, x in enumerate(held)] or [write(p[3], here, number)]
        return "".join(out)

    return write(_parse(text), context, 0)

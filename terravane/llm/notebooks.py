"""Blocks (cells, outputs, paragraphs) of notebook texts in three styles, each with its kind."""

from __future__ import annotations

import json
import re

TEXT, CODE, OUTPUT = range(3)
PERCENT = re.compile(r"^# ?%%", re.M)
PROMPT = re.compile(r"\n\s*\n(?=\S)|^(?=In \[|Out\[)", re.M)
LABEL = re.compile(r"^(?:In \[[^\]\n]*\]:|Out\[[^\]\n]*\]:|\.\.\.:) ?", re.M)


def _joined(value: object) -> str:
    if isinstance(value, list):
        return "".join(x for x in value if isinstance(x, str))
    return value if isinstance(value, str) else ""


STRINGS = r'"(?:[^"\\]|\\.)*"?'
LISTS = re.compile(rf'"(?:source|text|traceback|[a-z]+/[a-z+]+)"\s*:\s*(\[\s*(?:{STRINGS}[\s,]*)*|{STRINGS})', re.S)
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"?', re.S)
UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")


def _literal(text: str) -> str:
    """The content of a JSON string literal, as far as it can be read."""
    text = text.replace("\\\\", "\x01").replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\n").replace('\\"', '"').replace("\\/", "/")
    if "\\u" in text:
        text = UNICODE.sub(lambda m: chr(int(m[1], 16)), text)
    return text.replace("\x01", "\\")


def _broken_json_blocks(text: str) -> list[str]:
    """Blocks of a document that is cut off or damaged: its lists of strings, one by one."""
    return ["".join(_literal(s) for s in STRING.findall(found)) for found in LISTS.findall(text)]


def _json_parts(text: str) -> list[tuple[int, str]] | None:
    try:
        document = json.loads(text, strict=False)
    except (ValueError, RecursionError):
        return [(TEXT, b) for b in _broken_json_blocks(text)] or None
    cells = document.get("cells") if isinstance(document, dict) else None
    if not isinstance(cells, list):
        return None
    out = []
    for cell in cells:
        if not isinstance(cell, dict):
            continue
        out.append((CODE if cell.get("cell_type") == "code" else TEXT, _joined(cell.get("source"))))
        outputs = cell.get("outputs")
        for output in outputs if isinstance(outputs, list) else []:
            if isinstance(output, dict):
                data = output.get("data")
                shown = [output.get("text"), output.get("traceback"), *(data.values() if isinstance(data, dict) else [])]
                out += [(OUTPUT, _joined(v)) for v in shown]
    return out


def _uncommented(text: str) -> str:
    """Lines without the comment mark of the percent style."""
    return ("\n" + text).replace("\n# ", "\n").replace("\n#\n", "\n\n")[1:]


def parts(text: str, style: str | None) -> list[tuple[int, str]]:
    """(kind, block) without markup of the style; of a text in no known style its paragraphs.

    The kind is CODE or OUTPUT where the style says so of the block, else TEXT.
    """
    text = text.replace("\r\n", "\n")
    if style == "json" or (style is None and text.lstrip()[:1] == "{"):
        if (found := _json_parts(text)) is not None:
            return [part for part in found if part[1]]
        text = text.replace("\\n", "\n")
    out = []
    if style == "percent" or (style is None and PERCENT.search(text)):
        for n, part in enumerate(PERCENT.split(text)):
            head, _, body = part.partition("\n")
            code, _, output = body.partition("\n# Out:")
            marked = "[" in head
            out.append((CODE if n and not marked else TEXT, _uncommented(code) if marked else code))
            out.append((OUTPUT, _uncommented(output)))
    else:
        for part in PROMPT.split(text):
            kind = CODE if part.startswith("In [") else OUTPUT if part.startswith("Out[") else TEXT
            out.append((kind, LABEL.sub("", part)))
    return [part for part in out if part[1]]


def blocks(text: str, style: str | None) -> list[str]:
    """The blocks alone."""
    return [block for _, block in parts(text, style)]

"""Rich-text trees, given as JSON, to markdown."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ADF_DEPTH, BLOCK_DEPTH = 24, 8
INDENT = "  "


def _attr(node: dict, name: str, default=""):
    return (node.get("attrs") or {}).get(name, default)


def _day(raw) -> str:
    try:
        return f"{datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=int(raw)):%Y-%m-%d}"
    except (ValueError, TypeError, OverflowError):
        return str(raw)


def _span(node: dict, depth: int) -> str:
    """A node as running text."""
    if depth > ADF_DEPTH:
        return ""
    kind = node.get("type")
    if kind == "text":
        text = node.get("text") or ""
        links = (((m.get("attrs") or {}).get("href") or "") for m in node.get("marks") or () if m.get("type") == "link")
        target = next(links, "")
        return f"[{text}]({target})" if target else text
    leaf = {"hardBreak": lambda: "\n", "inlineCard": lambda: _attr(node, "url"), "emoji": lambda: _attr(node, "shortName"),
            "mention": lambda: _attr(node, "text"), "status": lambda: _attr(node, "text"), "date": lambda: _day(_attr(node, "timestamp"))}.get(kind)
    return (leaf() or "") if leaf else _spans(node, depth)


def _spans(node: dict, depth: int) -> str:
    return "".join(_span(c, depth + 1) for c in node.get("content") or ())


def _lines(node: dict, depth: int) -> list[str]:
    """A node as lines without the indentation of what it stands in."""
    if depth > ADF_DEPTH:
        return []
    kind, content = node.get("type"), node.get("content") or ()

    def below(nodes, at=depth + 1):
        return [line for n in nodes for line in _lines(n, at)]

    if kind in ("doc", "panel", "table"):
        out = below(content)
    elif kind == "heading":
        text = _spans(node, depth)
        out = [f"{'#' * min(6, max(1, int(_attr(node, 'level', 1) or 1)))} {text}"] if text else []
    elif kind in ("bulletList", "orderedList"):
        out = []
        for item in content:
            if item.get("type") == "listItem":
                first, *rest = below(item.get("content") or (), depth + 2) or [None]
                out += [] if first is None else [f"- {first}", *(INDENT + line for line in rest)]
            else:
                out += _lines(item, depth + 1)
    elif kind == "blockquote":
        out = [f"> {line}" for line in below(content)]
    elif kind == "codeBlock":
        out = [f"```{_attr(node, 'language') or ''}", *_spans(node, depth).split("\n"), "```"]
    elif kind == "tableRow":
        out = [" | ".join(" ".join(below(cell.get("content") or (), depth + 2)) for cell in content)]
    elif kind == "rule":
        out = ["---"]
    else:
        out = [_spans(node, depth) if kind == "paragraph" else _span(node, depth)]
    return [line for line in out if line]


def issue_text(tree: str | dict | None) -> str:
    """An issue tracker's document tree as markdown; nodes below ADF_DEPTH are left out."""
    node = json.loads(tree) if isinstance(tree, str) and tree else tree
    return "\n".join(_lines(node, 0)).strip() if isinstance(node, dict) else ""


_PREFIX = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "quote": "> "}


def _rich(items) -> str:
    out = []
    for item in items or ():
        text, target = item.get("plain_text") or "", item.get("href") or ""
        out.append(text if not target else target if text in ("", target) else f"[{text}]({target})")
    return "".join(out).strip()


def _block(block: dict, depth: int) -> str | None:
    kind = block.get("type")
    body = block.get(kind) or {}
    if kind == "divider":
        return "---"
    if kind == "code":
        return f"```{body.get('language') or ''}\n{_rich(body.get('rich_text'))}\n```"
    if kind == "table_row":
        return " | ".join(map(_rich, body["cells"])) if body.get("cells") else None
    if kind == "child_page":
        return body.get("title") or None
    text = _rich(body.get("rich_text"))
    if kind in ("bulleted_list_item", "numbered_list_item"):
        mark = "- "
    elif kind == "to_do":
        mark = "- [x] " if body.get("checked") else "- [ ] "
    else:
        return _PREFIX.get(kind, "") + text if text else None
    return INDENT * depth + mark + text if text else None


def _walk(blocks, depth: int):
    if depth <= BLOCK_DEPTH:
        for block in blocks or ():
            line = _block(block, depth)
            if line is not None:
                yield line
            if block.get("type") != "child_page":  # a child page is a document of its own
                yield from _walk(block.get("children"), depth + 1)


def page_text(tree: str | list | None) -> str:
    """A wiki page's blocks as markdown; blocks below BLOCK_DEPTH are left out."""
    blocks = json.loads(tree) if isinstance(tree, str) and tree else tree
    return "\n".join(_walk(blocks, 0)).rstrip("\n") if blocks else ""


def _over(function):
    def column(tree: Column) -> Column:
        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(function)

        return run(tree)

    return column


#: Spark schemas can't be recursive, so trees stay JSON text and are flattened in Arrow batches.
flatten_issue = _over(issue_text)
flatten_page = _over(page_text)

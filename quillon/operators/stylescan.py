"""The lines of a document's markup with what they declare of their look, for learning a style from a copied sample.

One pass over a page's tags, as for its content; which values are valid, what a line's role is and what a document's style
comes to is decided by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .htmlscan import FORMATTING, VOID, events
from .linescan import strip

SCHEMA = """scope string, at bigint, line int, run int, text string, in_list boolean, tagged boolean, margin_top string, margin_bottom string, line_height string, rule string,
 bold boolean, italic boolean, families array<string>, sizes array<string>, colors array<string>"""
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li".split())
UNSEEN = re.compile(r"display\s*:\s*none|mso-list\s*:\s*ignore")
DRAWN = re.compile(r"solid|dotted|dashed|double")
COLOR = re.compile(r"#[0-9a-f]{3,6}\b|rgba?\([^)]*\)", re.IGNORECASE)
WIDTH = re.compile(r"([0-9]*\.?[0-9]+)\s*(?:pt|px)")
#: The colour of a rule that names none (a fixed value).
GREY = "#999999"


def declarations(attrs: dict) -> dict[str, str]:
    pairs = (part.partition(":") for part in (attrs.get("style") or "").split(";"))
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon and name.strip()}


def border(css: dict[str, str], side: str) -> str | None:
    """The colour of a drawn border, if there is one."""
    value = css.get(f"border-{side}", "")
    if not DRAWN.search(value) or (w := WIDTH.search(value)) and float(w[1]) == 0:
        return None
    return (m := COLOR.search(value)) and m[0] or GREY


class _Sample:
    """Open elements, and the lines that are open among them; a list item that holds a line is none itself."""

    def __init__(self) -> None:
        self.stack: list[dict] = []
        self.lines: list[dict] = []
        self.rule: str | None = None

    def start(self, tag: str, attrs: dict) -> None:
        css = declarations(attrs)
        if tag == "hr":
            self.rule = css.get("border-top-color") or css.get("color") or GREY
            return
        if tag in VOID:
            return
        if tag in LINES and tag != "li":
            self.close(next((i for i, e in enumerate(self.stack) if e["tag"] in LINES and e["tag"] != "li"), None))
        elif tag == "li":
            last = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["tag"] in ("li", "ul", "ol")), None)
            self.close(last if last is not None and self.stack[last]["tag"] == "li" else None)
        above = self.stack[-1] if self.stack else {"bold": False, "italic": False, "families": (), "sizes": (), "colors": (), "unseen": False}
        bold = above["bold"] or tag in ("b", "strong") or re.fullmatch("h[1-6]", tag) is not None
        italic = above["italic"] or tag in ("i", "em")
        if weight := css.get("font-weight"):
            bold = "bold" in weight or weight.isdigit() and int(weight) >= 600
        if look := css.get("font-style"):
            italic = "italic" in look or "oblique" in look
        more = lambda name, key: above[name] + ((css[key],) if css.get(key) else ())
        unseen = UNSEEN.search((attrs.get("style") or "").lower()) is not None or (above["unseen"] and not attrs.get("style"))
        element = {"tag": tag, "bold": bold, "italic": italic, "families": more("families", "font-family"), "sizes": more("sizes", "font-size"), "colors": more("colors", "color"), "unseen": unseen or tag in ("style", "script", "title"), "line": None}
        self.stack.append(element)
        if tag in LINES:
            if tag != "li" and (item := next((e["line"] for e in reversed(self.stack[:-1]) if e["tag"] == "li"), None)):
                item["holds"] = True
            listed = any(e["tag"] == "li" for e in self.stack) or "mso-list" in (attrs.get("style") or "")
            element["line"] = {"runs": [], "listed": listed, "tagged": tag[0] == "h", "css": css, "holds": False}
            self.lines.append(element["line"])

    def close(self, at: int | None) -> None:
        if at is not None:
            del self.stack[at:]

    def end(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["tag"] == tag), None)
        if at is not None and (tag in FORMATTING and any(e["tag"] in LINES for e in self.stack[at:])):
            at = None if any(e["tag"] in LINES for e in self.stack[at + 1 :]) else at
        self.close(at)

    def text(self, raw: str) -> None:
        inner = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["line"] is not None), None)
        if inner is None or self.stack[-1]["unseen"] or any(e["tag"] in ("ul", "ol") for e in self.stack[inner:]):
            return
        self.stack[inner]["line"]["runs"].append((raw, self.stack[-1]))

    def rows(self) -> Iterator[dict]:
        """A row a run of every line that shows."""
        for at, line in enumerate(self.lines):
            css = line["css"]
            if line["holds"] or not strip("".join(raw for raw, _ in line["runs"])):
                continue
            for n, (raw, e) in enumerate(line["runs"]):
                yield {
                    "line": at, "run": n, "text": raw, "in_list": line["listed"], "tagged": line["tagged"], "margin_top": css.get("margin-top"), "margin_bottom": css.get("margin-bottom"), "line_height": css.get("line-height"),
                    "rule": line.get("rule") or border(css, "top"), "bold": e["bold"], "italic": e["italic"], "families": list(e["families"]), "sizes": list(e["sizes"]), "colors": list(e["colors"]),
                }


def sample_rows(html: str) -> list[dict]:
    sample = _Sample()
    pending: list[tuple[int, str]] = []
    for what, name, attrs in events(html):
        if what == "start":
            before = sample.rule
            sample.start(name, attrs)
            if sample.rule != before:
                pending.append((len(sample.lines), sample.rule))
        elif what == "end":
            sample.end(name)
        else:
            sample.text(name)
    rule = None
    for at, line in enumerate(sample.lines):
        rule = next((r for n, r in reversed(pending) if n == at), rule)
        shows = not line["holds"] and strip("".join(raw for raw, _ in line["runs"]))
        if shows:
            line["rule"], rule = rule, border(line["css"], "bottom")
        elif not line["holds"]:
            rule = border(line["css"], "bottom") or rule
    return list(sample.rows())


def sample_lines(samples: DataFrame) -> DataFrame:
    """Rows of samples with ``scope, at, html``; ``at`` tells their order in time."""
    names = [x.split()[0] for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                scope, at, html = (batch.column(k)[i].as_py() for k in range(3))
                rows = [r | {"scope": scope, "at": at} for r in sample_rows(html or "")]
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=_ARROW)

    return samples.select("scope", "at", "html").mapInArrow(run, SCHEMA)


_TEXTS = pa.list_(pa.string())
_ARROW = pa.schema(
    [("scope", pa.string()), ("at", pa.int64()), ("line", pa.int32()), ("run", pa.int32()), ("text", pa.string()), ("in_list", pa.bool_()), ("tagged", pa.bool_()), ("margin_top", pa.string()), ("margin_bottom", pa.string())]
    + [("line_height", pa.string()), ("rule", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("families", _TEXTS), ("sizes", _TEXTS), ("colors", _TEXTS)]
)

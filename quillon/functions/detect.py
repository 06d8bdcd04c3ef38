"""What a payload is, where it goes, and how: ordered decisions as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, TERMINAL, col, is_blank, trim_space

#: Signs of Markdown. One strong sign, or three different weak ones, decide.
STRONG_MARKDOWN = (
    r"\*\*[^*\n]+\*\*",
    r"__[^_\n]+__",
    rf"\[[^\]\n]+\]\((?:https?:|mailto:|www\.)[^){SPACE}]+\)",
    rf"(?m)^#{{1,6}}[ \t]+[^{SPACE}]",
    r"(?m)^```",
    r"(?m)^\|.+\|[ \t]*\n\|?[ \t]*:?-{3,}",
)
WEAK_MARKDOWN = (
    rf"(?m)(^|[{SPACE}])\*[^{SPACE}*][^*\n]*\*(?=[{SPACE}]|[.,;:!?]|$)",
    rf"(?m)(^|[{SPACE}])_[^{SPACE}_][^_\n]*_(?=[{SPACE}]|[.,;:!?]|$)",
    r"`[^`\n]+`",
    rf"(?m)^>[ \t]+[^{SPACE}]",
    rf"(?m)^[ \t]*[-*+][ \t]+[^{SPACE}]",
    rf"(?m)^[ \t]*[0-9]{{1,3}}\.[ \t]+[^{SPACE}]",
)
#: What a text must hold for each of these to match.
_WEAK_SIGNS = ("*", "_", "`", ">", None, None)
#: Markup that tells an application apart, first match wins.
HTML_ORIGINS = (
    (r"docs-internal-guid", "Google Docs"),
    (r"(?i)google-sheets-html-origin|ProgId content=Excel|x:str|<col\b", "Spreadsheet"),
    (r'(?i)urn:schemas-microsoft-com:office:word|class="?Mso', "Microsoft Word"),
    (rf'data-message-author-role|class="[^"]*markdown prose|data-start="[0-9]+"[{SPACE}]+data-end="[0-9]+"', "AI chat"),
)
MEANINGFUL_TAG = r"(?i)<(?:h[1-6]|ul|ol|li|table|a[ \t\r\n\f]|b|strong|i|em|blockquote|pre|code|img|s|del|u)\b"
TAB_ROW = rf"[^{SPACE}]\t+[^{SPACE}]"
#: UTF-16 units of html and text together beyond which a payload is left alone.
MOST_UNITS = 1_000_000

DESTINATIONS = ("google-docs", "gmail", "slack", "notion", "rich", "plain")
#: Hosts of destinations and of sources, first match wins.
SITE_RULES = (
    (r"\Adocs\.google\.com\z", "google-docs"),
    (r"\Amail\.google\.com\z", "gmail"),
    (r"\Aapp\.slack\.com\z|\.slack\.com\z", "slack"),
    (r"(\A|\.)notion\.so\z|\.notion\.site\z", "notion"),
)
SITE_NAMES = (
    (r"(\A|\.)chatgpt\.com\z|\Achat\.openai\.com\z", "ChatGPT"),
    (r"\Aclaude\.ai\z", "Claude"),
    (r"\Agemini\.google\.com\z", "Gemini"),
    (r"\Adocs\.google\.com\z", "Google Docs"),
    (r"\Amail\.google\.com\z", "Gmail"),
    (r"(\A|\.)slack\.com\z", "Slack"),
    (r"(\A|\.)notion\.so\z|\.notion\.site\z", "Notion"),
    (r"(\A|\.)github\.com\z", "GitHub"),
    (r"(\A|\.)wikipedia\.org\z", "Wikipedia"),
    (r"(\A|\.)medium\.com\z", "Medium"),
    (r"(\A|\.)stackoverflow\.com\z", "Stack Overflow"),
)


def first_match(value: Column, rules: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    out = F.when(value.rlike(rules[0][0]), rules[0][1])
    for pattern, result in rules[1:]:
        out = out.when(value.rlike(pattern), result)
    return out.otherwise(otherwise)


def markdown_signs(text: Column | str) -> tuple[Column, Column]:
    """Whether a strong sign is there, and how many weak ones."""
    c = F.coalesce(col(text), F.lit(""))
    strong = F.lit(False)
    for pattern in STRONG_MARKDOWN:
        strong = strong | c.rlike(pattern)
    weak = F.lit(0)
    for sign, pattern in zip(_WEAK_SIGNS, WEAK_MARKDOWN):  # a text without the sign never meets the pattern
        found = c.rlike(pattern) if sign is None else F.contains(c, F.lit(sign)) & c.rlike(pattern)
        weak = weak + found.cast("int")
    return strong, weak


def looks_like_markdown(text: Column | str) -> Column:
    strong, weak = markdown_signs(text)
    return strong | (weak >= 3)


def is_hard_wrapped(lines: Column, longest: Column | None = None) -> Column:
    """Whether an array of trimmed lines was broken by width: long lines, some of them ending mid-sentence.

    ``longest`` is the longest line's length; it is best computed before, as functions of arrays repeat it for every line.
    """
    longest = F.array_max(F.transform(lines, F.length)) if longest is None else longest
    body = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1)))
    long = F.size(F.filter(body, lambda x: F.length(x) >= longest * 0.6))
    return (F.size(lines) >= 2) & (longest >= 40) & (long / (F.size(lines) - 1) >= 0.6) & F.exists(body, lambda x: ~x.rlike(TERMINAL))


def is_tab_row(line: Column) -> Column:
    """Tabs between values, not only before them; lines without a tab never meet the pattern."""
    return F.contains(line, F.lit("\t")) & line.rlike(TAB_ROW)


def has_visible_text(html: Column) -> Column:
    rest = F.substring_index(html, ">", -1)  # no tag ends there, so none is looked for: many signs would each look to the end
    tagged = F.substring(html, F.lit(1), F.length(html) - F.length(rest))
    return F.replace(F.concat(F.regexp_replace(tagged, r"<[^>]*>", ""), rest), F.lit("&nbsp;"), F.lit("")).rlike(rf"[^{SPACE}]")


def chunks_of(text: Column, least: int = 1) -> Column:
    """Arrays of trimmed lines between blank lines, of at least so many lines each."""
    chunks = F.transform(F.split(text, rf"\n[{SPACE}]*\n", -1), lambda chunk: F.split(chunk, "\n", -1))
    return F.transform(F.filter(chunks, lambda c: F.size(c) >= least) if least > 1 else chunks, lambda c: F.transform(c, trim_space))


def detect_source(html: Column | str, text: Column | str) -> Column:
    """``STRUCT<kind, label>``: rich HTML wins unless it only wraps text that is Markdown."""
    h = trim_space(F.coalesce(col(html), F.lit("")))
    t = F.coalesce(col(text), F.lit(""))
    markdown = looks_like_markdown(t)
    takes_html = has_visible_text(h) & (h.rlike(MEANINGFUL_TAG) | is_blank(t) | ~markdown)
    rows = F.size(F.filter(F.split(t, "\n", -1), is_tab_row))  # a carriage return is white space
    measured = F.transform(chunks_of(t, 3), lambda c: F.struct(c.alias("l"), F.array_max(F.transform(c, F.length)).alias("m")))
    wrapped = F.exists(measured, lambda c: is_hard_wrapped(c["l"], c["m"]))

    def found(kind: str, label: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(label) if isinstance(label, str) else label).alias("label"))

    plain = F.when(rows >= 2, "Spreadsheet").when(wrapped, "PDF text").otherwise("Plain text")
    return (
        F.when(takes_html, found("html", first_match(h, HTML_ORIGINS, F.lit("Web page"))))
        .when(is_blank(t), found("empty", "Nothing"))
        .when(markdown, found("markdown", "Markdown"))
        .otherwise(found("text", plain))
    )


def gate(html: Column | str, text: Column | str, kind: Column) -> Column:
    """Why a payload is not worked on: ``empty``, ``too-large`` or null."""
    from .text import utf16_length

    units = utf16_length(F.coalesce(col(html), F.lit(""))) + utf16_length(F.coalesce(col(text), F.lit("")))
    return F.when(kind == "empty", "empty").when(units > MOST_UNITS, "too-large")


def site_name(host: Column | str) -> Column:
    h = F.coalesce(col(host), F.lit(""))
    bare = F.regexp_replace(h, r"\Awww\.", "")
    return first_match(h, SITE_NAMES, F.when(bare == "", "Unknown").otherwise(bare))


def destination_for_host(host: Column | str) -> Column:
    return first_match(F.coalesce(col(host), F.lit("")), SITE_RULES, F.lit("rich"))


#: Fixed value: types of inputs that hold prose; passwords, numbers and dates are never touched.
TEXT_INPUTS = ("", "text", "search", "url", "tel", "email")


def paste_target(f: dict[str, Column]) -> Column:
    """``STRUCT<kind, single_line, empty>`` of what receives a paste, or null where it is to be left alone.

    Keys: tag, type, locked (read-only or disabled), editable, plaintext_only, host, width, height, visible_text. Whether an
    editor is blank is unknown (null) where its text is not in the page.
    """
    field = F.when((f["tag"] == "input") & f["type"].isin(*TEXT_INPUTS), "input").when(f["tag"] == "textarea", "textarea")
    is_field = f["tag"].isin("input", "textarea")
    kind = F.when(is_field, F.when(~f["locked"], field)).when(f["editable"], F.when(f["plaintext_only"], "plaintext-editable").otherwise("rich"))
    hidden = (f["host"] == "docs.google.com") | (f["width"] < 4) | (f["height"] < 4)
    empty = F.when(~is_field & ~hidden, is_blank(f["visible_text"]))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), (kind == "input").alias("single_line"), empty.alias("empty")))


def suppressed(ms_since_shortcut: Column) -> Column:
    """A paste right behind the plain-paste shortcut is left alone."""
    return F.coalesce(ms_since_shortcut < 1000, F.lit(False))


def detect_destination(host: Column, kind: Column, code_editor: Column, override: Column, aware: Column) -> Column:
    """Destination id, or null where pasting is left to a code editor."""
    return (
        F.when(code_editor, F.lit(None).cast("string"))
        .when(override.isin(*DESTINATIONS), override)
        .when(F.coalesce(kind != "rich", F.lit(True)), "plain")
        .when(F.coalesce(aware, F.lit(True)), destination_for_host(host))
        .otherwise("rich")
    )


def paste_mode(destination: Column, empty: Column, learned: Column) -> Column:
    """A null ``empty`` means unknown and counts as blank."""
    return F.when(destination.isin("plain", "slack"), "adapt").when(F.coalesce(learned, F.lit(False)), "match-style").when(empty.eqNullSafe(F.lit(False)), "adapt").otherwise("preserve")


def delivery(destination: Column, has_html: Column) -> Column:
    """How a result would reach its editor."""
    return F.when((destination == "plain") | ~has_html, "insert-text").when(destination == "google-docs", "editor-only").otherwise("insert-rich")


CLEANED_MARKER = "<!--quillon:cleaned-->"


def skip_reason(c: dict[str, Column]) -> Column:
    """Why a paste is left alone, first reason that holds; null where it is not.

    Keys: active, ms_since_shortcut, editable, destination, has_data, n_files, html, text, ok, changed, delivered.
    """
    return (
        F.when(~F.coalesce(c["active"], F.lit(False)), "disabled")
        .when(suppressed(c["ms_since_shortcut"]), "plain-paste-shortcut")
        .when(~c["editable"], "not-editable")
        .when(c["destination"].isNull(), "code-editor")
        .when(~c["has_data"], "no-data")
        .when((c["n_files"] > 0) & (F.coalesce(c["text"], F.lit("")) == ""), "files")
        .when(F.contains(F.substring(F.coalesce(c["html"], F.lit("")), 1, 200), F.lit(CLEANED_MARKER)), "already-cleaned")
        .when(~c["ok"], "transform-failed")
        .when(~c["changed"], "nothing-to-fix")
        .when(~c["delivered"], "not-delivered")
    )

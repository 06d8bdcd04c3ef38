"""Character cleanup, whitespace, escaping and line joining as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of web scripting (wider than Java's \s), for use inside a character class.
SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Line breaks, characters that do not show, spaces that do not wrap, ends of sentences, page markers, numbers.
LINE_BREAKS = r"\r\n?|[\u2028\u2029]"
INVISIBLE = r"[\u200b\u2060\ufeff\u00ad]"
ODD_SPACES = r"[\u00a0\u2007\u202f\u2009\u200a\u3000]"
TERMINAL = r'[.!?:;"”’)\]]\z'
PAGE_MARKER = rf"(?i)\A[{SPACE}]*(?:.{{0,80}}?[{SPACE}]{{2,}})?page[{SPACE}]+[0-9]{{1,4}}(?:[{SPACE}]+(?:of|/)[{SPACE}]+[0-9]{{1,4}})?[{SPACE}]*\z"
NUMERIC_CELL = r"\A[-+$€£¥]?[0-9][0-9,.]*%?\z|\A[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}\z"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, and stands once in the plan, however often ``f`` uses it.

    The value is what an aggregate of nothing ends with; a ``transform`` of one element would copy what ``f`` makes, strings and all.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, f)


def count_matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern)).cast("bigint")


def clean_characters(text: Column | str) -> Column:
    """One line break, no invisible characters, plain spaces."""
    out = F.regexp_replace(col(text), LINE_BREAKS, "\n")
    return F.regexp_replace(F.regexp_replace(out, INVISIBLE, ""), ODD_SPACES, " ")


def hidden_characters(text: Column | str) -> Column:
    """How many invisible characters the cleanup removes."""
    return count_matches(text, INVISIBLE)


def collapse_spaces(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[ \t]{2,}", " ")


def space_runs(text: Column | str) -> Column:
    return count_matches(text, r"[ \t]{2,}")


def trim_space(text: Column | str) -> Column:
    """Trim all white space, not only U+0020. What stays is taken out: no run of spaces inside is looked at."""
    return F.regexp_extract(col(text), rf"(?s)\A[{SPACE}]*(.*[^{SPACE}])?", 1)


def right_trim_blanks(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[ \t]+\z", "")


def is_blank(text: Column | str) -> Column:
    return ~F.coalesce(col(text), F.lit("")).rlike(rf"[^{SPACE}]")


def escape_html(text: Column | str) -> Column:
    out = col(text)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: one more for every character beyond the basic plane."""
    c = col(text)
    return (F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")


def single_line(text: Column | str) -> Column:
    return trim_space(F.regexp_replace(col(text), rf"[{SPACE}]*\n[{SPACE}]*", " "))


def indent_width(blanks: Column | str) -> Column:
    return F.length(F.replace(col(blanks), F.lit("\t"), F.lit("    ")))


def is_dehyphenated(left: Column, right: Column) -> Column:
    return left.rlike(r"[a-z]{2}-\z") & right.rlike(r"\A[a-z]")


def join_wrapped(left: Column, right: Column) -> Column:
    """Join two wrapped lines, mending a word split by a hyphen."""
    return F.when(is_dehyphenated(left, right), F.concat(F.regexp_replace(left, r"-\z", ""), right)).otherwise(F.concat(left, F.lit(" "), right))


def is_page_marker(line: Column | str) -> Column:
    return col(line).rlike(PAGE_MARKER)


def without_page_markers(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~is_page_marker(line))


def lines_of(text: Column | str) -> Column:
    """Lines of cleaned text, blanks trimmed on the right."""
    return F.transform(F.split(clean_characters(text), "\n", -1), right_trim_blanks)


def tab_cells(line: Column | str) -> Column:
    return F.transform(F.split(F.regexp_replace(col(line), rf"\A +|[{SPACE}]+\z", ""), "\t", -1), trim_space)


def pipe_cells(line: Column | str) -> Column:
    inner = F.regexp_replace(F.regexp_replace(trim_space(line), r"\A\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"\|", -1), trim_space)


def is_numeric_cell(cell: Column) -> Column:
    return cell.rlike(NUMERIC_CELL)


def bullet_class(glyph: Column | str) -> Column:
    g = col(glyph)
    return F.when(g.rlike("[○◦◇]"), "circle").when(g.rlike("[▪▫■□‣⁃]"), "square").otherwise("disc")


def plural(n: Column, word: str) -> Column:
    return F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s"))


def and_list(parts: Column) -> Column:
    """``a, b and c`` of an array of texts."""
    n = F.size(parts)
    return F.when(n < 2, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n - 1), ", "), F.lit(" and "), F.element_at(parts, -1)))


def ago(at: Column, now: Column) -> Column:
    """Age between two epoch-millisecond columns in the largest fitting unit."""
    minutes = F.floor((now - at) / 60000 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    return F.when(minutes < 1, "now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24 + 0.5).cast("string"), F.lit("d")))


#: Months, points in time, and a date behind a separator at the end of a text.
_MONTH = rf"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?[{SPACE}]+"
_POINT = rf"(?:{_MONTH})?(?:19|20)[0-9]{{2}}"
TRAILING_DATE = rf"(?is)\A(.*?)[{SPACE}]*(?:[·|•,–—-]|[{SPACE}]{{2,}}|\t)[{SPACE}]*({_POINT}[{SPACE}]*(?:[-–—]|to)[{SPACE}]*(?:{_POINT}|present|current|now)|{_POINT})[{SPACE}]*\z"


def split_trailing_date(text: Column | str) -> Column:
    """``STRUCT<main, date>``; the date is null where the text doesn't end in one behind a separator."""
    c = col(text)
    found = c.rlike(TRAILING_DATE)
    return F.struct(F.when(found, F.regexp_extract(c, TRAILING_DATE, 1)).otherwise(c).alias("main"), F.when(found, F.regexp_extract(c, TRAILING_DATE, 2)).alias("date"))

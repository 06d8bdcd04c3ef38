"""What a user is told after a paste, as ``STRUCT<tone, title, meta, lines>``; null where it is obvious why nothing happened."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reason, tone, title, whether the destination is named, and what is said (``%s`` is the destination).
SKIPPED = (
    ("nothing-to-fix", "normal", "Pasted normally", True, "Already clean: nothing to fix."),
    ("not-delivered", "warning", "Not cleaned", True, "%s didn’t accept the cleaned version, so this was a normal paste."),
    ("already-cleaned", "cleaned", "Pasted the cleaned version", True, "This was cleaned before it was pasted."),
    ("transform-failed", "normal", "Pasted normally", True, "Nothing here could be improved."),
    ("plain-paste-shortcut", "normal", "Pasted as plain text", False, "That shortcut is the browser’s own plain paste, which is left alone."),
    ("files", "normal", "Pasted normally", False, "Images and files pass through untouched."),
)


def _told(tone: str, title: Column | str, meta: Column, lines: Column) -> Column:
    return F.struct(F.lit(tone).alias("tone"), (F.lit(title) if isinstance(title, str) else title).alias("title"), meta.alias("meta"), lines.alias("lines"))


def cleaned(mode: Column, label: Column, notes: Column) -> Column:
    """After a cleaned paste: which way the formatting went, and the notes."""
    title = F.when(mode == "preserve", "Pasted with its original look").when(mode == "match-style", "Pasted in your document’s style").otherwise("Pasted cleanly")
    return _told("cleaned", title, label, F.transform(notes, lambda n: n["message"]))


def skipped(reason: Column, label: Column) -> Column:
    """After a paste that was left alone."""
    none = F.lit(None).cast("string")
    out = None
    for name, tone, title, named, said in SKIPPED:
        line = F.replace(F.lit(said), F.lit("%s"), F.coalesce(label, F.lit("This editor")))
        told = _told(tone, title, label if named else none, F.array(line))
        out = F.when(reason == name, told) if out is None else out.when(reason == name, told)
    return out


def feedback(reason: Column, mode: Column, label: Column, notes: Column) -> Column:
    return F.when(reason.isNull(), cleaned(mode, label, notes)).otherwise(skipped(reason, label))

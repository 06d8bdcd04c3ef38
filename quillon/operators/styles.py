"""Styles learned from samples: lines with a role, a profile a sample, profiles over time, and a store of them by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.css import clean_color, clean_font_family, clean_font_size, clean_length, clean_line_height
from quillon.functions.text import SPACE, and_list, trim_space

from .relational import line_role
from .runs import last_valid
from .stylescan import sample_lines

ROLES = ("heading", "entry", "bullet", "body")
#: Fixed value: what a date on the right looks like.
DATEISH = r"(?i)\b(19|20)[0-9]{2}\b|\bpresent\b|\bcurrent\b"


def lines_with_roles(samples: DataFrame) -> DataFrame:
    """A row a line of samples with ``scope, at, html``: its text, role, look and what stands above it."""
    rows = sample_lines(samples)
    look = F.struct(
        last_valid("families", clean_font_family).alias("fontFamily"), last_valid("sizes", clean_font_size).alias("fontSize"), last_valid("colors", clean_color).alias("color"), F.col("bold").alias("bold"), F.col("italic").alias("italic")
    )
    rows = rows.withColumn("look", look).withColumn("solid", F.col("text").rlike(rf"[^{SPACE}]"))
    grouped = rows.groupBy("scope", "at", "line").agg(
        F.array_sort(F.collect_list(F.struct("run", F.col("text").alias("t"), F.col("solid").alias("s"), F.col("bold").alias("b"), F.col("italic").alias("i")))).alias("runs"),
        F.max_by("look", F.struct(F.length(trim_space("text")), -F.col("run"))).alias("dominant"), F.min_by("look", F.when(F.col("solid") & ~F.col("bold"), F.col("run"))).alias("first_plain"),
        *[F.first(c).alias(c) for c in ("in_list", "tagged", "rule")],
        F.first(F.struct(clean_length("margin_top").alias("marginTop"), clean_length("margin_bottom").alias("marginBottom"), clean_line_height("line_height").alias("lineHeight"))).alias("block"),
    )
    whole = F.regexp_replace(F.replace(F.array_join(F.transform("runs", lambda r: r["t"]), ""), F.lit("\u00a0"), F.lit(" ")), r"\A +| +\z", "")
    visible = F.filter("runs", lambda r: r["s"])
    grouped = grouped.withColumns({"text": whole, "visible": visible})
    lead = F.coalesce(F.get("visible", F.lit(0))["b"], F.lit(False)) & F.exists("visible", lambda r: ~r["b"])
    role = line_role(F.col("text"), F.forall("visible", lambda r: r["b"]), lead, F.col("tagged"))
    caps = F.col("text").rlike("[A-Z]") & (F.upper("text") == F.col("text"))
    said = F.array_join(F.transform("runs", lambda r: r["t"]), "")
    after = F.when(said.contains("\t"), F.regexp_extract(said, r"\t([^\t]*)\z", 1))
    # Runs behind the last tab tell whether dates stand on the right, and in italics.
    tabs = F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda k: F.get("runs", k)["t"].contains("\t"))
    last_tab = F.coalesce(F.array_max(tabs), F.lit(-1))
    slanted = F.exists(F.slice("runs", F.greatest(last_tab + 1, F.lit(1)), F.size("runs")), lambda r: r["i"] & r["s"]) & (last_tab >= 0)
    return grouped.withColumns({"role": F.when(F.col("in_list"), "bullet").otherwise(role), "caps": caps, "date": after, "date_italic": slanted}).drop("visible", "runs")


def _plain(look: Column) -> Column:
    return F.struct(look["fontFamily"].alias("fontFamily"), look["fontSize"].alias("fontSize"), look["color"].alias("color"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))


def learn(samples: DataFrame) -> DataFrame:
    """``scope, at, heading, entry, bullet, body``: of each sample, the first line of each role and the longest of the body.

    One aggregation a sample, no window; samples that teach nothing give no row.
    """
    lines = lines_with_roles(samples)
    first = lambda role, value: F.min_by(value, F.when(F.col("role") == role, F.col("line")))
    d, block = F.col("dominant"), F.col("block")
    heading = F.struct(d.alias("text"), block.alias("block"), F.col("caps").alias("caps"), F.col("rule").isNotNull().alias("ruleBefore"), clean_color("rule").alias("ruleColor"))
    entry = F.struct(_plain(F.coalesce("first_plain", d)).alias("text"), block.alias("block"), F.coalesce(F.col("date").rlike(DATEISH), F.lit(False)).alias("datesRight"), F.coalesce("date_italic", F.lit(False)).alias("dateItalic"))
    plain = F.struct(_plain(d).alias("text"), block.alias("block"))
    body = F.max_by(plain, F.when(F.col("role") == "body", F.struct(F.length("text"), -F.col("line"))))
    return lines.groupBy("scope", "at").agg(first("heading", heading).alias("heading"), first("entry", entry).alias("entry"), first("bullet", plain).alias("bullet"), body.alias("body"))


def merged(profiles: DataFrame) -> DataFrame:
    """One profile a scope: of each role what the newest sample that has it teaches."""
    newest = lambda role: F.max_by(role, F.when(F.col(role).isNotNull(), F.col("at"))).alias(role)
    return profiles.groupBy("scope").agg(F.max("at").alias("at"), *[newest(r) for r in ROLES])


def described(profile: dict[str, Column]) -> Column:
    """One line that tells what a profile holds."""
    heading, entry, font = profile["heading"], profile["entry"], F.coalesce(profile["body"]["text"], profile["bullet"]["text"])
    color = heading["text"]["color"]
    traits = F.array_join(F.filter(F.array(F.when(heading["caps"], "all caps"), F.when(color.isNotNull() & ~color.isin("#000000", "#222222"), "coloured"), F.when(heading["ruleBefore"], "line above")), lambda x: x.isNotNull()), ", ")
    family = F.replace(F.split(font["fontFamily"], ",")[0], F.lit("'"), F.lit(""))
    parts = F.array(
        F.when(heading.isNotNull(), F.when(traits != "", F.concat(F.lit("headings ("), traits, F.lit(")"))).otherwise("headings")),
        F.when(entry.isNotNull(), F.when(entry["datesRight"], "entries with dates on the right").otherwise("entry lines")), F.when(profile["bullet"].isNotNull(), "bullets"),
        F.concat(F.lit("text in "), family, F.coalesce(F.concat(F.lit(" "), font["fontSize"]), F.lit(""))),
    )
    said = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(said) > 0, F.concat(F.lit("Learned "), and_list(said), F.lit("."))).otherwise("Learned the text style.")


def upsert(store: DataFrame, learned: DataFrame) -> DataFrame:
    """The store of profiles by scope after new samples: newer roles win, others stay. One grouping over both."""
    return merged(store.select("scope", "at", *ROLES).unionByName(learned.select("scope", "at", *ROLES)))


def forgotten(store: DataFrame, scopes: DataFrame) -> DataFrame:
    return store.join(scopes.select("scope").distinct(), "scope", "left_anti")


def latest_lines(lines: DataFrame) -> DataFrame:
    """Lines of the newest sample of each scope."""
    newest = F.rank().over(Window.partitionBy("scope").orderBy(F.desc("at")))
    return lines.withColumn("_rank", newest).where("_rank = 1").drop("_rank")

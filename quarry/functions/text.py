"""Text expressions: cleaning, token estimates, heading outline and rendering, all as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The line ends that Python's splitlines knows, Unicode white space, and the CJK range that counts in full.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
BLANK = "[\\s\x1c-\x1f\x85\\p{Z}]"
CJK = "[一-鿿]"
HEADING = "(?U)^(#{1,6})\\s+(.*)$"
CHARS_PER_TOKEN = 4


def lines(text: Column) -> Column:
    """The lines of a text, as splitlines gives them (no empty last line)."""
    cut = F.split(text, LINE_END, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)


def clean(text: Column) -> Column:
    """Right-trimmed lines with runs of blank lines folded to one, joined by line feeds; null gives null."""
    trimmed = F.transform(lines(text), lambda x: F.regexp_replace(x, f"{BLANK}+$", ""))
    bound = F.transform(F.array(trimmed), lambda xs: F.filter(xs, lambda x, i: (x != "") | (i == 0) | (F.coalesce(F.get(xs, i - 1), F.lit("")) != "")))
    return F.array_join(F.get(bound, F.lit(0)), "\n")


def token_estimate(text: Column) -> Column:
    """CJK characters count one token each, all others a quarter (floor)."""
    cjk = F.length(F.regexp_replace(text, CJK.replace("[", "[^"), ""))
    return (cjk + F.floor((F.length(text) - cjk) / CHARS_PER_TOKEN)).cast("long")


def outline(docs: DataFrame, key: str = "doc_id", text: str = "text", level_column: str | None = None) -> DataFrame:
    """(key, line_no, level, title, breadcrumb) of every heading line: `Top > Sub`, over the nearest open ancestors.

    A heading of level l closes all headings of level l and deeper, so an ancestor of level m is open if no heading of a
    lower level came after it."""
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    rows = rows.select(key, F.col("line_no").cast("long").alias("line_no"), F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("title")).where("level > 0")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = {m: F.max(F.when(F.col("level") == m, F.col("line_no"))).over(w) for m in range(1, 7)}
    name = {m: F.last(F.when(F.col("level") == m, F.col("title")), True).over(w) for m in range(1, 7)}
    rows = rows.withColumns({f"_at{m}": at[m] for m in at} | {f"_t{m}": name[m] for m in name})
    parts = []
    for m in range(1, 7):
        above = F.greatest(*[F.coalesce(F.col(f"_at{j}"), F.lit(-1)) for j in range(1, m)], F.lit(-1)) if m > 1 else F.lit(-1)
        parts.append(F.when((F.col("level") >= m) & (F.col(f"_at{m}") > above), F.col(f"_t{m}")))
    return rows.select(key, "line_no", "level", "title", F.concat_ws(" > ", *[F.when(p != "", p) for p in parts]).alias("breadcrumb"))


def render_segment(segment: Column) -> Column:
    return F.when(segment["pref"] == "", segment["text"]).otherwise(F.concat(segment["pref"], F.lit("\n"), segment["text"]))


def render(segments: Column) -> Column:
    """A chunk's text without summaries: its segments, each under its breadcrumb, parted by a blank line."""
    return F.array_join(F.transform(segments, render_segment), "\n\n")


def paths(segments: Column) -> Column:
    """The distinct source paths in order of first appearance."""
    return F.array_distinct(F.transform(segments, lambda s: s["file_path"]))


def specials(segments: Column) -> Column:
    return F.flatten(F.transform(segments, lambda s: s["special_content"]))

"""Checklists as lines of text: headings of sections and rows with bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import clean_text
from scrivener.operators.ranges import last_known

#: Sections of a checklist by their number.
SECTIONS = {"2": "Pre-Submission Checks", "3": "Medical Review", "4": "Legal Review", "5": "Regulatory Review", "6": "Final Approval Checks"}
#: Who reviews a section, by a word of its name.
REVIEWERS = {"medical": "Medical", "legal": "Legal", "regulatory": "Regulatory", "final": "System / All Reviewers", "pre-submission": "Therapy Lead / System"}


def section_of(line: Column) -> Column:
    """The section that a line opens: by number, or because it names one; null for other lines."""
    number = F.coalesce(F.nullif(F.regexp_extract(line, r"(?i)^section\s+([2-6])\b", 1), F.lit("")), F.nullif(F.regexp_extract(line, r"^([2-6])\.\s+.+", 1), F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    out = F.when(number.isNotNull(), F.try_element_at(names, number))
    for name in SECTIONS.values():
        out = out.when(F.lower(line).contains(name.lower()), name)
    return out


def reviewer_of(section: Column) -> Column:
    """Who reviews a section; empty if nobody is named."""
    low = F.lower(F.coalesce(section, F.lit("")))
    out = F.when(F.lit(False), "")
    for word, reviewer in REVIEWERS.items():
        out = out.when(low.contains(word), reviewer)
    return out.otherwise("")


def checklist_rows(lines: DataFrame) -> DataFrame:
    """``doc, line_no, section, item_code, description, reviewer, mandatory`` of lines ``doc, line_no, line``.

    A row has three or more parts between bars, stands under a section, is no table header and its description has
    letters. Of four or more parts the last are reviewer and mandatory; of three the reviewer is that of the section. A
    line that opens or names a section is no row. line_no is a whole number, unique within ``doc``.
    """
    cleaned = lines.select("doc", "line_no", clean_text(F.col("line")).alias("line"))
    opened = cleaned.withColumn("opens", section_of(F.col("line")))
    carried = last_known(opened, "doc", "line_no", "opens", "section").where("opens is null and section is not null and line like '%|%'")
    rows = carried.withColumn("p", F.filter(F.transform(F.split("line", r"\|"), clean_text), lambda x: x != "")).where("size(p) >= 3")
    n = F.size("p")
    joined = F.lower(F.array_join("p", " "))
    header = F.lower(F.regexp_replace(F.col("p")[0], "^#+|#+$", "")).isin("item", "check item") | (joined.contains("check item") & joined.rlike("mandatory|owner|reviewer"))
    middle = F.when(n >= 4, F.array_join(F.expr("slice(p, 2, size(p) - 3)"), " | ")).otherwise(F.col("p")[1])
    out = rows.where(~header).select(
        "doc", "line_no", "section", F.col("p")[0].alias("item_code"), middle.alias("description"),
        F.when(n >= 4, F.expr("p[size(p) - 2]")).otherwise(reviewer_of(F.col("section"))).alias("reviewer"), F.element_at("p", -1).alias("mandatory"),
    )
    return out.where(F.col("description").rlike("[A-Za-z]"))

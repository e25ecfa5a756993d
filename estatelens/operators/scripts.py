"""Write statements of SQL scripts: a lexer as one regular alternation, and the lines that may write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line comment, a block comment, a quoted run (two quotes in a row end one and begin the next), or neither. Comments and quotes
#: that nothing closes go to the end.
LEXEMES = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|'[^']*(?:'|\z)|[^-/']+|[\s\S]"
_HIDDEN = r"^(?:--|/\*|')"
#: Fixed patterns: lines that write, and those that select into.
WRITES = r"(?i)^[ \t]*(INSERT|UPDATE|DELETE|MERGE|TRUNCATE)\b"
INTO = r"(?i)^[ \t]*INTO[ \t]+[#@]|^[ \t]*SELECT\b[^;]*\bINTO\b"


def masked(source: Column) -> Column:
    """SQL with comments and quoted text as blanks; line feeds stay, and so does every other character's place."""
    cut = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(LEXEMES), F.lit(0))
    return F.array_join(F.transform(cut, lambda x: F.when(x.rlike(_HIDDEN), F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "")


def line_count(source: Column) -> Column:
    """Lines of a text; a last line feed begins no line."""
    text = F.coalesce(source, F.lit(""))
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")))


def write_markers(scripts: DataFrame) -> DataFrame:
    """(definition, line, operation, text) of lines of scripts(definition, content) that may write.

    Comments and quoted text do not count. A null script has no lines.
    """
    lines = F.arrays_zip(F.split(masked(F.col("content")), "\n").alias("m"), F.split(F.coalesce("content", F.lit("")), "\n").alias("s"))
    # through a generator, below which no filter goes: a script is cut once
    cut = scripts.select("definition", F.posexplode(lines).alias("at", "x")).select("definition", (F.col("at") + 1).alias("line"), "x.m", "x.s")
    write = F.lower(F.regexp_extract("m", WRITES, 1))
    operation = F.when(write != "", write).when(F.col("m").rlike(INTO), "select_into")
    return cut.select("definition", "line", operation.alias("operation"), F.trim(F.regexp_replace("s", r"[\t\r]", " ")).alias("text")).where("operation is not null")

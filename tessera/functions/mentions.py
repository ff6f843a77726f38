"""Mentions with the section and the role that the lines around them give. Frames are bounded (``back`` lines before, ``around`` on either side) and stay within a document's row: no window over lines, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse

# Words of headings, of reference lists, and of lines that say what a dataset is mentioned for.
HEADINGS = r"(?i)^(?:\d+(?:\.\d+)*\s+)?(?:datasets?|experimental setup|experiments?|evaluation|results?|methods?|appendix|supplementary|related work|references|bibliography)\b"
REFERENCES = r"(?i)^(?:\d+\s+)?(?:references|bibliography)\s*$"
CONTEXT = r"(?i)\b(?:dataset|data set|benchmark|corpus|test set|training set|evaluation set|image collection|image-text pairs|question-answer pairs|user study|stimuli)\b"
INTRODUCTION = r"(?i)\b(?:introduc(?:e|ed|ing)|propos(?:e|ed)|construct(?:ed)?|creat(?:e|ed)|curat(?:e|ed)|collect(?:ed)?|release(?:d)?)\b"
DERIVATION = r"(?i)\b(?:deriv(?:e|ed)|annotat(?:e|ed|ion)|subset|filter(?:ed)?|augment(?:ed)?|synthetic)\b"
EVALUATION = r"(?i)\b(?:evaluat(?:e|ed|ion)|test(?:ed|ing)?|benchmark(?:ed|ing)?|experiments?)\b"
TRAINING = r"(?i)\b(?:train(?:ed|ing)?|pretrain(?:ed|ing)?|fine.?tun(?:e|ed|ing))\b"
RELATED = r"(?i)related work|prior work|previous work"
#: The first role all of whose patterns the frame has.
ROLES = (("introduction", (INTRODUCTION, CONTEXT)), ("derived collection", (DERIVATION, CONTEXT)), ("evaluation", (EVALUATION,)), ("training", (TRAINING,)), ("related-work mention", (RELATED,)))


def framed_mentions(documents: DataFrame, id_column: str, text_column: str, names: str, *, headings: str = HEADINGS, references: str = REFERENCES, roles: tuple = ROLES, back: int = 35, around: int = 1) -> DataFrame:
    """id, line (from 1), name, section, role, excerpt: matches of the pattern ``names``, each name once a line whatever its case.

    The section is the last heading of the line or of the ``back`` lines before it, cut at 100 characters; the role goes by the line and ``around`` lines on either side. From a line that
    begins the references on, the section is "References" and the role that of a reference alone. A document's lines are one row; only lines with names leave it."""
    rows = documents.select(F.col(id_column).alias("id"), F.split(text_column, r"\r\n|\n|\r").alias("lines"))
    heads = F.transform("lines", lambda x: F.when(F.trim(x).rlike(headings), F.substring(F.trim(x), 1, 100)))
    listed = F.array_position(F.transform("lines", lambda x: collapse(x).rlike(references)), True)
    rows = rows.select("id", "lines", heads.alias("heads"), F.coalesce(listed, F.lit(0)).alias("listed"))

    def once(found: Column) -> Column:
        lower = F.transform(found, F.lower)
        return F.filter(found, lambda n, i: F.array_position(lower, F.lower(n)) == i + 1)

    at = F.transform("lines", lambda x, i: F.struct(i.alias("i"), once(F.regexp_extract_all(x, F.lit(names), F.lit(0))).alias("names")))
    rows = rows.select("id", "lines", "heads", "listed", F.filter(at, lambda x: F.size(x["names"]) > 0).alias("found"))

    def frame(x: Column) -> Column:
        i = x["i"]
        start = F.greatest(i - around, F.lit(0))
        near = F.array_join(F.slice(F.col("lines"), start + 1, i + around + 1 - start), " ")
        first = F.greatest(i - back, F.lit(0))
        above = F.filter(F.slice(F.col("heads"), first + 1, i + 1 - first), lambda h: h.isNotNull())
        return F.struct((i + 1).alias("line"), x["names"].alias("names"), near.alias("near"), F.try_element_at(above, F.lit(-1)).alias("section"), ((F.col("listed") > 0) & (i + 1 >= F.col("listed"))).alias("only"))

    out = rows.select("id", F.explode(F.transform("found", frame)).alias("x")).select("id", "x.*")
    role = F.when(F.col("only"), "bibliography-only reference")
    for name, patterns in roles:
        role = role.when(reduce(lambda a, b: a & b, [F.col("near").rlike(p) for p in patterns]), name)
    section = F.when(F.col("only"), "References").otherwise(F.col("section"))
    return out.select("id", "line", F.explode("names").alias("name"), section.alias("section"), role.otherwise("unclassified").alias("role"), F.substring(collapse(F.col("near")), 1, 500).alias("excerpt"))

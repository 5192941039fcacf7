"""Films, performances and names out of a dump of triples, one on each line: subject, predicate and object, by tabs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predicates of a performance: its film, its actor, and the character.
FILM, ACTOR, CHARACTER = "performance.film", "performance.actor", "performance.character"
NAME = "object.name"
PERFORMANCE = (FILM, ACTOR, CHARACTER)
_RESOURCE = r"<[^>]*/ns/([^>]+)>"
#: What "." in a regular expression does not match.
_LINE_ENDS = "\n\r\u0085\u2028\u2029"
_OBJECT = r"\t(?:<[^>]*/ns/([^>]+)>|\"(.*)\"(?:@en)?)\t\.$"


def _of_reference(field: Column) -> tuple[Column, Column]:
    """Whether a field is one resource and nothing else, and its name: as ``_RESOURCE``, without a regular expression."""
    name = F.substring_index(F.rtrim(field, F.lit(">")), "/ns/", -1)
    return field.startswith("<") & field.contains("/ns/") & (F.instr(field, ">") == F.length(field)) & (name != ""), name


def parsed(lines: DataFrame, column: str = "value", *predicates: str) -> DataFrame:
    """(subject, predicate, object) of the lines that are triples, of ``predicates`` if any are named; literals in other languages than English are not.

    Regular expressions say what a triple is. Most lines are plain (four fields, each a resource or a literal and nothing
    else); string functions read these, at a fifth of the time. Each line is read once: a filter on columns would go
    below them and have the same expressions evaluated again, which it cannot on a generated row.
    """
    c = F.col("line")
    rows = lines.select(F.col(column).alias("line"))
    if predicates:
        # Lines of others need not be read.
        rows = rows.where(reduce(or_, (c.contains(f"/ns/{p}>") for p in predicates)))
    first, second = F.substring_index(c, "\t", 1), F.substring_index(F.substring_index(c, "\t", 2), "\t", -1)
    rows = rows.select("line", first.alias("a"), second.alias("b"), F.substring_index(F.substring_index(c, "\t", -2), "\t", 1).alias("o"))
    (a, subject), (b, predicate), (reference, name) = map(_of_reference, map(F.col, "abo"))
    o = F.col("o")
    literal = o.startswith('"') & ((F.length("o") >= 2) & o.endswith('"') | (F.length("o") >= 5) & o.endswith('"@en'))
    literal &= ~reduce(or_, (o.contains(x) for x in _LINE_ENDS))
    text = F.substring(o, F.lit(2), F.length("o") - F.when(o.endswith('"'), 2).otherwise(5))
    # Three tabs: what the fields are made of is the whole line.
    whole = (c == F.concat(F.col("a"), F.lit("\t"), F.col("b"), F.lit("\t"), o, F.lit("\t.")))
    rows = rows.select("line", subject.alias("s"), predicate.alias("p"), F.when(reference, name).when(literal, text).alias("t"), (whole & a & b & (reference | literal)).alias("plain"))
    plain = F.struct(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("t").alias("object"))
    # Of the two objects one is empty.
    other = F.struct(F.regexp_extract(c, "^" + _RESOURCE, 1).alias("subject"), F.regexp_extract(c, "^[^\t]*\t" + _RESOURCE, 1).alias("predicate"), F.concat(F.regexp_extract(c, _OBJECT, 1), F.regexp_extract(c, _OBJECT, 2)).alias("object"))
    triples = rows.select(F.inline(F.array(F.when(F.col("plain"), plain).otherwise(other)))).where("subject <> '' AND predicate <> '' AND object <> ''")
    return triples.where(F.col("predicate").isin(*predicates)) if predicates else triples


def wanted(triples: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The triples of performances, and the names of what they refer to (``names`` as for ``named``)."""
    names = triples if names is None else names
    performances = triples.where(F.col("predicate").isin(FILM, ACTOR, CHARACTER))
    seen = performances.where(F.col("predicate") != CHARACTER).select(F.col("object").alias("subject")).distinct()
    return performances.unionByName(names.where(F.col("predicate") == NAME).join(seen, "subject", "left_semi"))


def named(triples: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(performance, film, title, actor, name, role): performances whose film and actor have names; of two objects the lesser counts.

    ``names``: triples that hold all names, if they are read apart.
    """
    names = triples if names is None else names
    # The least of texts takes a sort; by a number it compares no texts, which begin alike.
    performances = triples.where(F.col("predicate").isin(FILM, ACTOR, CHARACTER)).groupBy(F.xxhash64("subject").alias("order"), F.col("subject").alias("performance"))
    rows = performances.agg(*(F.min(F.when(F.col("predicate") == p, F.col("object"))).alias(n) for p, n in ((FILM, "film"), (ACTOR, "actor"), (CHARACTER, "role")))).where("film IS NOT NULL AND actor IS NOT NULL")
    names = names.where(F.col("predicate") == NAME).groupBy("subject").agg(F.min("object").alias("label"))
    titled = rows.join(names.select(F.col("subject").alias("film"), F.col("label").alias("title")), "film")
    return titled.join(names.select(F.col("subject").alias("actor"), F.col("label").alias("name")), "actor").select("performance", "film", "title", "actor", "name", "role")


def loaded(triples: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``named`` without the performances' own ids: what is loaded of them."""
    return named(triples, names).drop("performance")

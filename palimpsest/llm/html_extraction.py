"""Main-text extraction with a wrapper inferred for each host.

The token streams of all of a host's pages are aligned, in groups and then the groups' expressions, into a union-free
expression (``wrappers``), and the parts that hold main text are marked in it. Every page is then matched to its
host's expression, and what lies in the marked parts is its text.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import BROADCAST_KEYS, arrow_map, checkpoint, table
from palimpsest.llm.html_tree import parse
from palimpsest.llm.wrappers import Part, align, choose, dumped, generalise, loaded, main_text, packed, unpacked

#: Pages, and then expressions, of a host that one group aligns.
PAGES_PER_GROUP = 8
#: As many bytes of hosts' wrappers are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


@contextmanager
def _without_cycles() -> Iterator[None]:
    """The collector of cycles rests: pages and expressions are many objects and have none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _aligned(group: pd.DataFrame) -> Part:
    """The expression of a group's pages or, from the second round on, of its expressions."""
    with _without_cycles():
        return reduce(align, (unpacked(x) for x in group["expression"]) if "expression" in group else (generalise(parse(p)) for p in group["html"]))


def host_wrappers(pages: DataFrame, per_group: int = PAGES_PER_GROUP) -> DataFrame:
    """(host, wrapper): each host's expression over all its pages, with the parts that hold main text marked.

    A host's different pages are dealt by hash to groups of about ``per_group``, and each group is aligned; then the groups'
    expressions are, as many at a time, until one is left. So a host of any size is no task's alone, and the
    order depends on the pages only.
    """
    own = pages.select(host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("h", F.xxhash64("html"))
    # Copies of a page tell nothing more.
    counts = checkpoint(own.groupBy("host").agg(F.count_distinct("h").alias("n")))
    if counts.count() <= BROADCAST_KEYS:
        # No page of a great host is sent to where the host's count is.
        counts = F.broadcast(counts)
    rows = own.join(counts.select("host", F.ceil(F.col("n") / per_group).cast("long").alias("groups")), "host").withColumn("g", F.pmod("h", "groups"))

    def pages_of(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        different = group.drop_duplicates("html").sort_values(["h", "html"])
        return pd.DataFrame({"host": [first["host"]], "groups": [first["groups"]], "g": [first["g"]], "expression": [packed(_aligned(different))]})

    def groups_of(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        return pd.DataFrame({"host": [first["host"]], "groups": [first["groups"]], "g": [first["g"]], "expression": [packed(_aligned(group.sort_values("before")))]})

    schema = "host string, groups long, g long, expression binary"
    done = checkpoint(rows.select("host", "groups", "g", "h", "html").groupBy("host", "groups", "g").applyInPandas(pages_of, schema))
    while (done.agg(F.max("groups")).first()[0] or 0) > 1:
        fewer = F.ceil(F.col("groups") / per_group).cast("long")
        dealt = done.select("host", fewer.alias("groups"), F.pmod("g", fewer).alias("g"), F.col("g").alias("before"), "expression")
        done = checkpoint(dealt.groupBy("host", "groups", "g").applyInPandas(groups_of, schema))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("host"), pa.array([dumped(choose(unpacked(x))) for x in b.column("expression").to_pylist()], pa.string())], ["host", "wrapper"])

    return arrow_map(done.select("host", "expression"), batch, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Edge cases: a null or empty html gives an empty text; pages without a host share one
    wrapper; a page that its host's wrapper does not fit is read by its own; a tag that never
    ends is text; repeated rows are read each; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select("page_id", "url", "html")
    wrappers = checkpoint(host_wrappers(rows))
    if (wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    known = rows.withColumn("host", host()).join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        expression = lru_cache(256)(loaded)
        pairs = zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist(), strict=True)
        with _without_cycles():
            out = [main_text(page, expression(w) if w else None) if page else "" for page, w in pairs]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(known, batch, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op8_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Line dedup by site-relative frequency, in DataFrame operations only.

Per host, the number of pages that contain a line is divided by the host's pages; lines above a
ratio are boilerplate and leave every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import cut

#: The table of boilerplate lines is broadcast up to this measured size, else joined by shuffle.
BROADCAST_BYTES = 32 << 20


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def helper_names(taken: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, whatever their case."""
    low = {c.lower() for c in taken}
    mark = "_dedup"
    while any(f"{mark}_{n}" in low for n in names):
        mark += "_"
    return [f"{mark}_{n}" for n in names]


def boilerplate(pages: DataFrame, ratio: float, least_pages: int, text: str, host: str) -> DataFrame:
    """host, and ``lines``: the distinct lines on more than ``ratio`` of the host's pages and on ``least_pages`` at least."""
    own = pages.select(F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").cast("string").alias("text")).filter("host is not null")
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # a page counts a line once, so distinct lines of a page are found before they leave it
    lines = own.select("host", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("line"))
    lines = lines.filter(~_blank(F.col("line")))
    counted = lines.groupBy("host", F.xxhash64("line").alias("mark")).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= least_pages)
    over = counted.join(totals, "host").filter(F.col("held") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def line_dedup(pages: DataFrame, ratio: float = 0.05, least_pages: int = 10, text: str = "text", host: str = "source") -> DataFrame:
    """All columns of ``pages`` with boilerplate lines removed from ``text``, and ``lines_dropped``.

    Lines are cut at \\n and compared whole, by 64-bit hash; a line without a word is never dropped.
    Pages with a null host or text stay as they are (0 lines dropped); a null text counts as a page of its
    host. Repeated rows are pages of their own; a very long text is split where it lies. An input column
    ``lines_dropped`` is replaced; columns of any other names are kept. An empty table gives no rows.
    """
    pages = pages.drop("lines_dropped")
    own = helper_names(pages.columns, "host", "marks", "kept")
    # written first: the join then sees a plain small table, and Spark can split a large host's pages
    hosts = cut(boilerplate(pages, ratio, least_pages, text, host).select(F.col("host").alias(own[0]), F.col("marks").alias(own[1])))
    size = hosts.agg(F.sum(8 * F.size(own[1]) + 64)).first()[0] or 0
    hosts = F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts
    column = F.col(f"`{text}`").cast("string")
    every = F.split(column, "\n", -1)
    keep = F.filter(every, lambda x: _blank(x) | ~F.array_contains(F.col(own[1]), F.xxhash64(x)))
    joined = pages.join(hosts, F.col(f"`{host}`").cast("string") == F.col(own[0]), "left")
    touched = F.col(own[1]).isNotNull() & column.isNotNull()
    joined = joined.withColumn(own[2], F.when(touched, keep))
    columns = [F.when(F.col(own[2]).isNotNull(), F.array_join(own[2], "\n")).otherwise(column).alias(text) if c == text else F.col(f"`{c}`") for c in pages.columns]
    return joined.select(*columns, F.coalesce(F.size(every) - F.size(own[2]), F.lit(0)).cast("bigint").alias("lines_dropped"))


#: DuckDB, for documents with ``source`` as host: the cleaned rows.
ORACLE = r"""
with lines as (
  select doc_id, source, u.line, u.pos
  from documents, lateral (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos) u
  where source is not null and text is not null
), counted as (
  select source, line, count(distinct doc_id) as held from lines
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by all
), bad as (
  select source, line from counted join (select source, count(*) as pages from documents group by source) using (source)
  where held >= 2 and held > 0.05 * pages
), marked as (
  select l.*, b.line is not null as gone from lines l left join bad b on l.source = b.source and l.line = b.line
), cleaned as (
  select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text, count(*) filter (gone) as lines_dropped
  from marked group by doc_id
)
select d.doc_id, coalesce(c.text, d.text) as text, d.lang, d.source, d.n_chars, coalesce(c.lines_dropped, 0) as lines_dropped
from documents d left join cleaned c on d.doc_id = c.doc_id
"""

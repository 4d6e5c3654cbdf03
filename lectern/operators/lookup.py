"""Lookups along an order: page labels, outlines, levels, trees and runs, without range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import chapter_filename, page_label


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], descending: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the row of ``right`` that has the greatest ``at`` not above its own (or the least not below).

    Both sides meet in one window a key, so each row moves once; ties on ``right`` go to the greatest values.
    """
    order = F.desc(at) if descending else F.asc(at)
    best = right.groupBy(*by, at).agg(F.max(F.struct(*values)).alias("__found"))
    none = F.lit(None).cast(best.schema["__found"].dataType)
    rows = left.select(*by, at, F.struct("*").alias("__row"), none.alias("__found"), F.lit(1).alias("__late"))
    both = rows.unionByName(best.select(*by, at, F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "__found", F.lit(0).alias("__late")))
    window = Window.partitionBy(*by).orderBy(order, "__late").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__found", F.last("__found", ignorenulls=True).over(window)).filter("__row is not null")
    return met.select("__row.*", *[F.col(f"__found.{v}").alias(v) for v in values])


def page_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``pages(book_id, page_index)`` with ``label``: by the last of ``ranges(start_index, prefix, style, start_number)`` that began.

    Books whose ranges don't begin at 0 count in plain numbers until they do; books without ranges have page numbers.
    """
    first = ranges.groupBy("book_id").agg(F.min("start_index").alias("at")).filter("at > 0").select("book_id", F.lit(0).cast("long").alias("page_index"), F.lit("").alias("prefix"), F.lit("D").alias("style"), F.lit(1).cast("long").alias("start_number"))
    known = ranges.select("book_id", F.col("start_index").cast("long").alias("page_index"), F.coalesce("prefix", F.lit("")).alias("prefix"), "style", F.coalesce("start_number", F.lit(1)).cast("long").alias("start_number"))
    every = known.unionByName(first).withColumn("start_index", F.col("page_index"))
    met = as_of(pages.withColumn("page_index", F.col("page_index").cast("long")), every, ["book_id"], "page_index", ["start_index", "prefix", "style", "start_number"])
    number = F.col("start_number") + F.col("page_index") - F.col("start_index")
    label = F.when(F.col("start_index").isNull(), (F.col("page_index") + 1).cast("string")).otherwise(page_label("style", "prefix", number))
    return met.withColumn("label", label).drop("start_index", "prefix", "style", "start_number")


def outline_of_pages(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """``pages(book_id, page)`` with ``item``: of the outline items on the last page that has any, not after it, the deepest, then the last."""
    items = outline.select("book_id", "page", "level", "item")
    return as_of(pages, items, ["book_id"], "page", ["level", "item"]).drop("level")


def clamped_levels(rows: DataFrame, by: str = "book_id", at: str = "item", level: str = "level") -> DataFrame:
    """``by, at, level`` where each level is at least 1 and at most one below the one before it."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(level).cast("int").alias("level")))).alias("rows"))
    zero = F.struct(F.lit(0).alias("before"), F.array().cast(listed.schema["rows"].dataType).alias("out"))

    def step(acc: Column, row: Column) -> Column:
        now = F.greatest(F.lit(1), F.least(row["level"], acc["before"] + 1))
        return F.struct(now.alias("before"), F.array_append(acc["out"], F.struct(row["at"].alias("at"), now.alias("level"))).alias("out"))

    folded = listed.select(by, F.explode(F.aggregate("rows", zero, step, lambda acc: acc["out"])).alias("r"))
    return folded.select(by, F.col("r.at").alias(at), F.col("r.level").alias(level))


def parents(rows: DataFrame, by: str = "book_id", at: str = "preorder", level: str = "level") -> DataFrame:
    """``by, at, parent, above``: the latest row before each with a smaller level, and all rows open above it, outermost
    first; the topmost have a null parent.

    A stack folded over each book's rows: the open rows have ascending levels, so each row closes those that are not
    above it.
    """
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(level).cast("int").alias("level")))).alias("rows"))
    kind = listed.schema["rows"].dataType.elementType["at"].dataType.simpleString()
    zero = F.struct(F.array().cast(listed.schema["rows"].dataType).alias("open"), F.array().cast(f"array<struct<at:{kind},above:array<{kind}>>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        kept = F.filter(acc["open"], lambda o: o["level"] < row["level"])
        above = F.transform(kept, lambda o: o["at"])
        return F.struct(F.array_append(kept, row).alias("open"), F.array_append(acc["out"], F.struct(row["at"].alias("at"), above.alias("above"))).alias("out"))

    folded = listed.select(by, F.explode(F.aggregate("rows", zero, step, lambda acc: acc["out"])).alias("r"))
    return folded.select(by, F.col("r.at").alias(at), F.get("r.above", F.size("r.above") - 1).alias("parent"), F.col("r.above").alias("above"))


def sole(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def first_source(rows: DataFrame, by: str = "book_id", rank: str = "source_rank") -> DataFrame:
    """Of several sources of a key's rows, the rows of the first that has any."""
    best = rows.groupBy(by).agg(F.min(rank).alias(rank))
    return rows.join(best, [by, rank], "left_semi")


def unmatched(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner; null keys never have one."""
    return left.join(right.select(*by).distinct(), by, "left_anti")


def zipped_differences(planned: DataFrame, prepared: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows differ or are missing on one side."""
    left = planned.select(*by, F.struct(*values).alias("planned"))
    right = prepared.select(*by, F.struct(*values).alias("prepared"))
    return left.join(right, by, "full").filter(~F.col("planned").eqNullSafe(F.col("prepared")))


def runs(rows: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``rows`` with ``run``: the number, from 0, of the run of equal neighbouring values."""
    order = Window.partitionBy(by).orderBy(at)
    changed = F.coalesce((~F.lag(value).over(order).eqNullSafe(F.col(value))).cast("int"), F.lit(0)) * (F.row_number().over(order) > 1).cast("int")
    marked = rows.withColumn("__changed", changed)
    return marked.withColumn("run", F.sum("__changed").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__changed")


def chapter_texts(units: DataFrame) -> DataFrame:
    """``book_id, chapter, section_id, file_name, text``: the units of each run of a section, one a line."""
    lined = runs(units.select("book_id", "unit_ord", "section_id", "text"), "book_id", "unit_ord", "section_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", "text"))), lambda x: x["text"]), "\n")
    grouped = lined.groupBy("book_id", "run").agg(F.first("section_id").alias("section_id"), text.alias("text"))
    named = grouped.withColumn("chapter", F.col("run") + 1)
    return named.select("book_id", "chapter", "section_id", chapter_filename("chapter", "section_id").alias("file_name"), "text")


def linked_walk(items: DataFrame, most: int | None = 10_000, deepest: int | None = 128) -> DataFrame:
    """``book_id, item, object, level, problem``: the objects of ``items(book_id, object, first, next, top)`` in the order of a walk from the top ones.

    ``first`` is the first object below one, ``next`` the one after it; several tops are walked by number. An object
    that the walk meets again, a missing one, and more objects or levels than allowed give the book one row with a
    problem and no others. One book is one group: the walk holds at most ``most`` objects of it. The defaults are the
    bounds of files that may be broken; ``None`` walks all of a table's objects and levels.
    """
    import pyarrow as pa

    schema = pa.schema([("book_id", pa.string()), ("item", pa.int64()), ("object", pa.int64()), ("level", pa.int32()), ("problem", pa.string())])

    def walk(table: pa.Table) -> pa.Table:
        rows = table.select(["object", "first", "next", "top"]).to_pylist()
        known = {r["object"]: r for r in rows}
        todo = [(r["object"], 1) for r in sorted((r for r in rows if r["top"]), key=lambda r: r["object"], reverse=True)]
        seen: dict[int, int] = {}
        problem = None
        while todo and problem is None:
            at, level = todo.pop()
            problem = (
                "an item is missing" if at not in known else "the items form a circle" if at in seen else f"there are over {most} items" if len(seen) == most else f"there are over {deepest} levels" if deepest is not None and level > deepest else None
            )
            if problem is None:
                seen[at] = level
                todo += [(x, n) for x, n in ((known[at]["next"], level), (known[at]["first"], level + 1)) if x is not None]
        book = table.column("book_id")[0].as_py()
        out = [(book, None, None, None, problem)] if problem else [(book, n, at, level, None) for n, (at, level) in enumerate(seen.items())]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    typed = items.select(F.col("book_id").cast("string").alias("book_id"), *[F.col(c).cast("long").alias(c) for c in ("object", "first", "next")], F.coalesce("top", F.lit(False)).alias("top"))
    return typed.groupBy("book_id").applyInArrow(walk, "book_id string, item bigint, object bigint, level int, problem string")

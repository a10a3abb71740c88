"""Optical marks: filtering, grouping into answer rows, values and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LETTERS = ("A", "B", "C", "D", "E", "F", "G")
TOLERANCE, CONFIDENCE = 15.0, 0.85


def usable_marks(marks: Column, confidence: float = CONFIDENCE) -> Column:
    """Selected marks that are sure enough and have a shape."""
    return F.filter(marks, lambda m: (m["state"] == "selected") & (m["confidence"] >= confidence) & (F.size(m["polygon"]) >= 3) & F.get(m["polygon"], F.lit(0)).isNotNull())


def mark_rows(marks: Column, tolerance: float = TOLERANCE) -> Column:
    """Marks grouped by height: in the order (y, x), a mark joins the first row whose first mark is less than tolerance away.

    Marks come by rising y and first marks stand at least the tolerance apart, so only the last row can fit: one pass over a page's
    marks finds where rows begin, and the rows are cut out there."""
    at = lambda m: F.get(m["polygon"], F.lit(0))
    ordered = F.array_sort(F.transform(marks, lambda m: F.struct(at(m)["y"].alias("y"), at(m)["x"].alias("x"), m.alias("m"))))
    none = F.array().cast("array<int>")
    first = F.struct(F.lit(None).cast("double").alias("y"), F.lit(1).alias("next"), none.alias("starts"))

    def step(a: Column, m: Column) -> Column:
        fits = F.coalesce(F.abs(a["y"] - m["y"]) < tolerance, F.lit(False))
        return F.struct(
            F.when(fits, a["y"]).otherwise(m["y"]).alias("y"), (a["next"] + 1).alias("next"),
            F.when(fits, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["next"]))).alias("starts"),
        )

    starts = F.aggregate(ordered, first, step, lambda a: a["starts"])
    # bound once by transform over a single element: otherwise each row would sort and fold the page again
    page = F.transform(F.array(F.struct(ordered.alias("marks"), starts.alias("starts"))), lambda p: F.transform(p["starts"], lambda s, i: F.slice(p["marks"], s, F.coalesce(F.get(p["starts"], i + 1), F.size(p["marks"]) + 1) - s)))
    return F.transform(F.flatten(page), lambda r: F.transform(F.array_sort(F.transform(r, lambda m: F.struct(m["x"].alias("x"), m["m"].alias("m")))), lambda s: s["m"]))


def read_pages(pages: DataFrame, keys: list[str], page: str | None = None, marks: str = "marks", prefix: str = "P") -> DataFrame:
    """(keys..., page, row, id, type, value, confidence, box): an item for each row of marks of each page.

    The value is the letter of the number of marks; two marks are true or false. Ids count through all pages of a sheet, which
    the keys name, in the order of `page`; without it each sheet is one page. row counts from 0 on each page."""
    own = [*keys, page] if page else keys
    rows = pages.select(*own, mark_rows(usable_marks(F.col(marks))).alias("_rows"))
    before = F.lit(0)
    if page:  # a sheet has few pages, each one row here
        earlier = W.partitionBy(*keys).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.size("_rows")).over(earlier), F.lit(0))
    rows = rows.withColumn("_before", before).select(*own, "_before", F.posexplode("_rows").alias("row", "_marks"))
    n, first, last = F.size("_marks"), F.get("_marks", F.lit(0)), F.element_at("_marks", -1)
    corner, far = F.get(first["polygon"], F.lit(0)), F.coalesce(F.get(last["polygon"], F.lit(2)), F.element_at(last["polygon"], -1))
    box = F.array(corner["x"], corner["y"], far["x"] - corner["x"], far["y"] - corner["y"])
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return rows.select(
        *own,
        "row",
        F.concat(F.lit(prefix), (F.col("_before") + F.col("row") + 1).cast("string")).alias("id"),
        F.when(n == 2, "true_false").otherwise("multiple_choice").alias("type"),
        F.element_at(letters, F.least(n, F.lit(len(LETTERS)))).alias("value"),
        F.array_min(F.transform("_marks", lambda m: m["confidence"])).alias("confidence"),
        box.alias("box"),
    )


def mean_confidence(items: DataFrame) -> DataFrame:
    return items.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def to_confirm(confidence: Column, limit: float = 0.98) -> Column:
    """Whether a capture needs confirming; without a confidence it is sure."""
    return F.coalesce(confidence, F.lit(1.0)) < limit

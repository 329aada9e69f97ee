"""Numeric band join: lines near an item's price, by an absolute band or by a relative one.

Prices and unit prices are whole cents. Linear buckets serve the absolute band, logarithmic ones the
relative band: each is one equi-join on the bucket, an item's band reaching into one or two buckets, with
an exact check behind it; the relative branch keeps only pairs outside the absolute band, so no pair is
found twice.

The joins run over distinct prices and distinct unit prices. Of the lines of one unit price only the count,
the sum of checksums and the first few lines are needed, and these are made before anything meets: however
many lines or items share a price, it is one row on its side. What an item must not pair with, the lines of
its own id, is counted by (item, unit price) and taken off.

Only DataFrame functions run. Nothing that grows with the input is collected or broadcast: hot prices, at
most ten for each shuffle partition, are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import hot_join, written

#: The absolute band in cents, the relative band in thousandths of the price, the pairs listed of an item.
ABSOLUTE, PER_MILLE, FIRST = 10, 2, 5


def cents(value: Column) -> Column:
    """floor(100 x + 0.5) in doubles, as a long; null for null, NaN and amounts of 10^15 and more."""
    return F.when(F.abs(value) < 1e15, F.floor(value * 100 + F.lit(0.5)).cast("long"))


def unit_cents(amount: Column, quantity: Column) -> Column:
    """The amount (cents) for one piece, halves rounded up, in whole numbers; null for a quantity of 0."""
    sign = F.when(quantity < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    n, d = (2 * amount + quantity) * sign, 2 * quantity * sign
    return F.when(quantity != 0, _floor_div(n, d))


def _floor_div(n: Column, d: Column | int) -> Column:
    d = d if isinstance(d, Column) else F.lit(d)
    return F.call_function("div", n - F.pmod(n, d), d)


def in_band(gap: Column, p: Column, absolute: int, per_mille: int) -> Column:
    return (gap <= absolute) | (1000 * gap <= per_mille * p)


def near_values(prices: DataFrame, units: DataFrame, absolute: int = ABSOLUTE, per_mille: int = PER_MILLE) -> DataFrame:
    """All columns of both sides and gap, for each price p and unit price u with |u - p| in either band.

    ``prices`` has a row for each p, ``units`` for each u (longs). A price of 0 or less has no relative band.
    """
    gap = F.abs(F.col("u") - F.col("p")).alias("gap")
    width = 2 * absolute + 1
    reached = F.sequence(_floor_div(F.col("p") - absolute, width), _floor_div(F.col("p") + absolute, width))
    linear = prices.withColumn("bucket", F.explode(reached)).join(units.withColumn("bucket", _floor_div(F.col("u"), width)).hint("merge"), "bucket")
    branches = [linear.drop("bucket").withColumn("gap", gap).filter(F.col("gap") <= absolute)]
    if per_mille > 0:
        step = math.log1p(2 * per_mille / 1000)  # a bucket spans two bands, so a band reaches into two at most
        reach = -math.log1p(-per_mille / 1000) / step + 0.02  # more than any error of a logarithm
        place = lambda v, by: F.floor(F.ln(v.cast("double")) / step + by)
        wide = prices.filter(per_mille * F.col("p") >= 1000 * (absolute + 1))  # others have nothing outside the absolute band
        wide = wide.withColumn("bucket", F.explode(F.sequence(place(F.col("p"), -reach), place(F.col("p"), reach))))
        logarithmic = wide.join(units.filter("u > 0").withColumn("bucket", place(F.col("u"), 0.0)).hint("merge"), "bucket")
        branches.append(logarithmic.drop("bucket").withColumn("gap", gap).filter((F.col("gap") > absolute) & (1000 * F.col("gap") <= per_mille * F.col("p"))))
    out = branches[0]
    for more in branches[1:]:
        out = out.unionByName(more)
    return out


def _first_lines(lines: DataFrame, first: int) -> DataFrame:
    """u, lines, sure: of each unit price the lines that can be among an item's first, and how many of them any item has at least.

    An item leaves out its own lines. Of one item_id no more than ``first`` lines can be among an item's
    first; of lines so thinned the first 2 * ``first`` hold ``first`` others, whoever leaves his own out.
    """
    by_item = Window.partitionBy("u", "line_item_id").orderBy("sale_id", "line_no")
    by_unit = Window.partitionBy("u").orderBy("sale_id", "line_no", "line_item_id")
    kept = lines.withColumn("nth", F.row_number().over(by_item)).filter(F.col("nth") <= first)
    kept = kept.withColumn("nth", F.row_number().over(by_unit)).filter(F.col("nth") <= 2 * first)
    found = kept.groupBy("u").agg(F.collect_list(F.struct("sale_id", "line_no", "line_item_id")).alias("lines"))  # at most 2 * first
    most = F.array_max(F.transform("lines", lambda x: F.size(F.filter("lines", lambda y: y["line_item_id"] == x["line_item_id"]))))
    return found.withColumn("sure", F.size("lines") - most)


def near_lines(lines: DataFrame, items: DataFrame, absolute: int = ABSOLUTE, per_mille: int = PER_MILLE, first: int = FIRST) -> DataFrame:
    """Each item's first pairs with lines of near unit price, and sums over all its pairs.

    ``items`` has item_id and price, ``lines`` sale_id, line_no, item_id, quantity and amount. An item pairs
    with the lines of other item ids whose unit price is at most ``absolute`` cents or ``per_mille``
    thousandths of its price away. Returned: item_id, rank (from 1), gap, u, sale_id, line_no,
    line_item_id in ascending order of these five, and n_pairs, gap_sum, lines_crc of the item.

    Null: a line without sale_id, item_id, quantity or amount, and an item without id or price, pairs with
    nothing, nor does a line of quantity 0 or an amount or price that is not a number; a null line_no sorts
    first and is an empty text in the checksum. Repeated lines each count and take a rank; repeated
    items each have their rows. Items without pairs have one row of rank 0, and so has every item where
    there are no lines; no items give no rows. Other columns are dropped, whatever their names. A
    sum that no long can hold is null.
    """
    q, a = F.col("quantity").cast("long"), cents(F.col("amount").cast("double"))
    known = lines.select(F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("item_id").cast("long").alias("line_item_id"), unit_cents(a, q).alias("u"))
    known = known.filter("sale_id is not null and line_item_id is not null and u is not null")
    asked = items.select("item_id", cents(F.col("price").cast("double")).alias("p"))
    valid = asked.filter("item_id is not null and p is not null")

    told = F.concat_ws(",", "sale_id", F.coalesce(F.col("line_no").cast("string"), F.lit("")), "line_item_id")
    by_item = written(known.groupBy("line_item_id", "u").agg(F.count(F.lit(1)).alias("n"), F.try_sum(F.crc32(told.cast("binary"))).alias("crc")), "units-of-items")
    units = by_item.groupBy("u").agg(F.sum("n").alias("n"), F.try_sum("crc").alias("crc"))
    firsts = written(_first_lines(known, first), "first-lines")
    units = units.join(firsts.select("u", "sure").hint("merge"), "u")
    prices = valid.groupBy("p").agg(F.count(F.lit(1)).alias("n_items"))

    pairs = written(near_values(prices, units, absolute, per_mille), "near-values")
    sums = pairs.groupBy("p").agg(F.first("n_items").alias("n_items"), F.sum("n").alias("n_pairs"), F.try_sum(F.try_multiply("gap", "n")).alias("gap_sum"), F.try_sum("crc").alias("lines_crc"))
    before = Window.partitionBy("p").orderBy("gap", "u").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the band has cents
    needed = pairs.select("p", "u", "gap", "sure").withColumn("had", F.coalesce(F.sum("sure").over(before), F.lit(0))).filter(F.col("had") < first)
    listed = needed.join(firsts.select("u", "lines").hint("merge"), "u")
    listed = listed.select("p", F.explode(F.transform("lines", lambda x: F.struct(F.col("gap"), F.col("u"), x["sale_id"].alias("sale_id"), x["line_no"].alias("line_no"), x["line_item_id"].alias("line_item_id")))).alias("line"))
    listed = listed.groupBy("p").agg(F.array_sort(F.collect_list("line")).alias("near"))  # a band's cents times 2 * first at most
    by_price = written(sums.join(listed.hint("merge"), "p"), "by-price")

    own = by_item.withColumnRenamed("line_item_id", "item_id").join(valid.distinct().hint("merge"), "item_id").withColumn("gap", F.abs(F.col("u") - F.col("p"))).filter(in_band(F.col("gap"), F.col("p"), absolute, per_mille))
    own = own.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.try_sum(F.try_multiply("gap", "n")).alias("own_gap"), F.try_sum("crc").alias("own_crc"))
    own = own.select(F.col("item_id").alias("own_id"), F.col("p").alias("own_p"), "own_n", "own_gap", "own_crc")
    met = asked.join(own.hint("merge"), (F.col("item_id") == F.col("own_id")) & (F.col("p") == F.col("own_p")), "left").drop("own_id", "own_p")
    met = met.withColumn("p", F.when(F.col("item_id").isNotNull(), F.col("p")))
    met = hot_join(met, by_price, "p", "n_items")
    less = lambda total, part: F.when(F.col("n_pairs").isNull(), F.lit(0).cast("long")).when(F.col("own_n").isNull(), F.col(total)).otherwise(F.try_subtract(total, part)).alias(total)
    others = F.slice(F.filter("near", lambda x: x["line_item_id"] != F.col("item_id")), 1, first)
    met = met.select("item_id", others.alias("near"), less("n_pairs", "own_n"), less("gap_sum", "own_gap"), less("lines_crc", "own_crc"))
    ranked = met.select("*", F.posexplode_outer("near").alias("at", "line"))
    return ranked.select("item_id", F.coalesce(F.col("at") + 1, F.lit(0)).cast("int").alias("rank"), "line.gap", "line.u", "line.sale_id", "line.line_no", "line.line_item_id", "n_pairs", "gap_sum", "lines_crc")

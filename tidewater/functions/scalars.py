"""Column expressions that the operators share."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_fields(line: Column, sep: str = ",") -> Column:
    """Fields of a line; empty ones at its end are dropped."""
    return F.split(F.regexp_replace(line, f"{sep}+$", ""), sep)


def clean_token(token: Column) -> Column:
    """token without anything but ASCII letters, digits and underscores."""
    return F.regexp_replace(token, r"\W", "")


def clean_line(line: Column) -> Column:
    """line without anything but ASCII letters, digits, underscores and spaces: its tokens are clean, at the cost of one pass."""
    return F.regexp_replace(line, r"[^0-9A-Za-z_ ]+", "")


def split_white(line: Column) -> Column:
    """Fields of a line that white space parts; none of an empty line."""
    return F.array_remove(F.split(line, r"\s+"), "")


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a date or an instant."""
    return F.unix_millis(ts.cast("timestamp"))


def within(ts: Column, start: str, end: str, closed: str = "left") -> Column:
    """Whether ts lies between two instants; closed is 'left' or 'neither'. False where ts can't be read."""
    t = F.try_to_timestamp(ts.cast("string"))
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return F.coalesce(((t >= low) if closed == "left" else (t > low)) & (t < high), F.lit(False))


def date_range(begin: Column, end: Column) -> Column:
    """All dates from begin to end; only begin if end is earlier."""
    return F.when(end < begin, F.array(begin)).otherwise(F.sequence(begin, end, F.expr("interval 1 day")))


def weekday(date: Column) -> Column:
    """1 for Sunday to 7 for Saturday."""
    return F.dayofweek(date)


def date_text(date: Column) -> Column:
    return F.date_format(date, "yyyy/MM/dd HH:mm:ss E")


def euclidean(a: Column, b: Column) -> Column:
    """Distance in double precision; NaN if the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))).otherwise(F.lit(float("nan")))


def subsets(items: Column, size: int) -> Column:
    """All sorted subsets of `size` of the distinct items: each subset is grown by items beyond its last one."""
    start = F.array_sort(F.array_distinct(items))
    if size == 0:
        return F.array(F.slice(start, 1, 0))
    out = F.transform(start, lambda x: F.array(x))
    for _ in range(size - 1):
        out = F.flatten(F.transform(out, lambda s: F.transform(F.filter(start, lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))
    return out


def all_subsets(items: Column, most: int) -> Column:
    """All sorted subsets of 0 to `most` of the distinct items."""
    return F.concat(*[subsets(items, k) for k in range(most + 1)])


#: Items of an array whose subsets stand in one row: 2^16 of them.
ROW_ITEMS = 16


def every_subset(items: Column) -> Column:
    """All subsets but the empty one of an array of distinct items, each in the array's order: an item is added to all subsets of
    the items before it. All of them stand in one row, so arrays of more than ROW_ITEMS items raise an error."""
    fits = F.when(F.size(items) <= ROW_ITEMS, items).otherwise(F.raise_error(F.lit(f"more than {ROW_ITEMS} items in one row")))
    grown = F.aggregate(fits, F.array(F.slice(items, 1, 0)), lambda have, x: F.concat(have, F.transform(have, lambda s: F.concat(s, F.array(x)))))
    return F.slice(grown, F.lit(2), F.size(grown))


#: Combinations that stand in one row while their numbers are dealt out.
RANKS = 4096


def combination_count(n: Column, size: int) -> Column:
    """How many sets of `size` of n items there are, as long as that and its product with n fit 64 bits."""
    n = n.cast("bigint")
    steps = F.sequence(F.lit(0), F.lit(size - 1)) if size else F.array().cast("array<int>")
    return F.when(n < size, F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, F.lit(1).cast("bigint"), lambda c, i: F.call_function("div", c * (n - i), i + 1)))


def combination_at(items: Column, size: int, rank: Column) -> Column:
    """The combination of `size` of the items with this number, from 0, in the items' order: with c combinations of r of the m items that are left,
    c * r / m hold the first of them."""
    start = F.struct(rank.cast("bigint").alias("rank"), combination_count(F.size(items), size).alias("c"), F.lit(size).cast("bigint").alias("r"), F.size(items).cast("bigint").alias("m"), F.slice(items, 1, 0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        with_it = F.call_function("div", s["c"] * s["r"], s["m"])
        takes = s["rank"] < with_it
        return F.struct(
            F.when(takes, s["rank"]).otherwise(s["rank"] - with_it).alias("rank"), F.when(takes, with_it).otherwise(s["c"] - with_it).alias("c"),
            F.when(takes, s["r"] - 1).otherwise(s["r"]).alias("r"), (s["m"] - 1).alias("m"), F.when(takes, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(items, start, step, lambda s: s["out"])


def rolling_hash(text: Column, start: int = 1125899906842597) -> Column:
    """h = 31 * h + unit over the UTF-16 units of text, from start, modulo 2^64 as a signed number. The halves are kept apart, so that nothing
    overflows under ANSI rules."""
    over = lambda c: c - 0x10000
    units = F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) < 0x10000, F.array(F.ascii(c))).otherwise(F.array(F.shiftright(over(F.ascii(c)), 10) + 0xD800, over(F.ascii(c)).bitwiseAND(F.lit(0x3FF)) + 0xDC00))))
    low = F.lit((1 << 32) - 1)

    def step(h: Column, c: Column) -> Column:
        below = h["low"] * 31 + c
        return F.struct((h["high"] * 31 + F.shiftright(below, 32)).bitwiseAND(low).alias("high"), below.bitwiseAND(low).alias("low"))

    parts = F.struct(F.lit(start >> 32 & (1 << 32) - 1).cast("bigint").alias("high"), F.lit(start & (1 << 32) - 1).cast("bigint").alias("low"))
    return F.aggregate(units, parts, step, lambda h: F.shiftleft(h["high"], 32).bitwiseOR(h["low"]))


def natural_partition(key: Column, partitions: int) -> Column:
    """The partition of a text key among so many: its rolling hash's remainder, without the sign; 0 for null."""
    return F.coalesce(F.abs(rolling_hash(key) % partitions).cast("int"), F.lit(0))


def sorted_combinations(items: list, size: int | None = None) -> list[list]:
    """The same of a Python list."""
    own = sorted(set(items))
    return [list(c) for k in ([size] if size is not None else range(len(own) + 1)) for c in combinations(own, k)]


def list_text(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def json_int(text: Column, field: str, default: int = -1) -> Column:
    """An integer field of a JSON object; default where there is none."""
    return F.coalesce(F.get_json_object(text, f"$.{field}").try_cast("int"), F.lit(default))

"""Review tables: filters, facets, sorting, pages, counts, updates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import digits
from tessella.functions.values import round_half_up

#: Order of comparison states in a table.
STATUS_RANK = {"encontrado": 1, "faltante": 2, "extra_no_ocr": 3}


def search_results(df: DataFrame, identifier: str, state: str, search: str | None = None, wanted: str | None = None) -> DataFrame:
    """Rows whose identifier's digits hold those of search, and of the state wanted; each is optional."""
    number = "".join(c for c in search or "" if c in "0123456789")
    if number:
        df = df.filter(F.contains(digits(F.col(identifier)), F.lit(number)))
    return df.filter(F.col(state) == wanted) if wanted else df


def text_filter(column: str, search: str) -> Column:
    """A blank search takes every row, also those without a value."""
    return F.contains(F.lower(column), F.lit(search.lower())) if search.strip() else F.lit(True)


def range_filter(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Both ends inclusive, either open."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    if high is not None:
        out = out & (F.col(column) <= high)
    return out


def state_counts(df: DataFrame, state: str, states: list[str], by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states], F.count("*").alias("n_all"))


def batch_message(total: Column, failed: Column) -> Column:
    return F.when(failed == 0, F.concat(total.cast("string"), F.lit(" documents processed"))).when(failed == total, F.lit("all documents failed")).otherwise(F.concat((total - failed).cast("string"), F.lit(" processed, "), failed.cast("string"), F.lit(" failed")))


def mean_progress(df: DataFrame, progress: str, by: list[str], order: str | None = None) -> DataFrame:
    """The mean, halves up. Sums of doubles depend on the order of the rows in their last bits, so a mean of exactly one half would fall either way:
    groups whose values have at most ten decimals are added as decimals and divided as whole numbers; others stay doubles.

    With order, a column without ties, values are added as doubles in its order instead, as a loop over the rows does (and SQL, read in that order by one thread)."""
    if order:
        return _mean_in_order(df, progress, by, order)
    p, exact = F.col(progress), F.col(progress).try_cast("decimal(24,10)")
    same = F.coalesce(exact.cast("double") == p.cast("double"), p.isNull())
    sums = df.groupBy(*by).agg(F.avg(progress).alias("_mean"), F.bool_and(same).alias("_exact"), F.sum(exact).alias("_sum"), F.count(progress).alias("_n"))
    whole = F.expr("(2 * _sum + _n - pmod(2 * _sum + _n, 2 * _n)) div (2 * _n)")  # floor(sum / n + 1 / 2)
    return sums.select(*by, F.when(F.col("_exact") & (F.col("_n") > 0), whole).otherwise(round_half_up(F.col("_mean")).cast("long")).alias("progress"))


def _mean_in_order(df: DataFrame, progress: str, by: list[str], order: str) -> DataFrame:
    """Only groups whose mean is so near to a half that the order can matter are gone through in order, by a running sum; a sum's error is far below the bound."""
    rows = df.withColumn(progress, F.col(progress).cast("double"))
    means = rows.groupBy(*by).agg(F.avg(progress).alias("_mean"), F.avg(F.abs(progress)).alias("_size"))
    up = F.col("_mean") + 0.5
    close = F.coalesce(F.abs(up - F.rint(up)) <= 1e-6 + 1e-9 * F.col("_size"), F.lit(False))
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    open_ = means.filter(close).select(*[F.col(c).alias(n) for c, n in names.items()])
    met = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    running = F.sum(progress).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = rows.join(open_, met, "left_semi").withColumn("_sum", running).groupBy(*by).agg((F.max_by("_sum", order) / F.count(progress)).alias("_mean"))
    out = means.filter(~close).select(*by, "_mean").unionByName(summed)
    return out.select(*by, round_half_up(F.col("_mean")).cast("long").alias("progress"))


def all_complete(df: DataFrame, done: Column, by: list[str]) -> DataFrame:
    """Whether every row is done; a group has at least one row."""
    return df.groupBy(*by).agg(F.bool_and(done).alias("all_complete"), F.count_if(done).alias("n_done"), F.count("*").alias("n_all"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): the distinct values of each column as text; array cells count by element."""
    kinds = dict(df.dtypes)
    cells = [F.transform(F.col(c), lambda x: x.cast("string")) if kinds[c].startswith("array") else F.array(F.col(c).cast("string")) for c in columns]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), v.alias("values")) for c, v in zip(columns, cells)])).alias("f"))
    return rows.select("f.facet", F.explode("f.values").alias("value")).groupBy("facet", "value").agg(F.count("*").alias("n"))


def facets_under(df: DataFrame, filters: dict[str, Column], columns: list[str]) -> DataFrame:
    """(facet, value, n) as of facets, where each facet counts the rows that meet all filters but the one on its own column, as a table does
    that offers other values of a filtered column. filters has a condition for each filtered column, which needn't be a facet.

    One scan: a row's failed filters are a bit mask, and it counts for a facet whose own bit is all that is left of it.
    A condition that is null fails. A value that other filters leave no row isn't listed.
    """
    if len(filters) > 62:
        raise ValueError("at most 62 filters")
    bits = {c: 1 << i for i, c in enumerate(filters)}
    failed = F.lit(0).cast("long")
    for c, met in filters.items():
        failed = failed + F.when(F.coalesce(met, F.lit(False)), 0).otherwise(bits[c])
    kinds = dict(df.dtypes)
    cell = lambda c: F.transform(F.col(c), lambda x: x.cast("string")) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
    counted = lambda c: F.col("_failed").bitwiseAND(~bits.get(c, 0)) == 0
    rows = df.withColumn("_failed", failed).filter(F.greatest(F.lit(False), *[counted(c) for c in columns]))
    cells = F.array(*[F.struct(F.lit(c).alias("facet"), F.when(counted(c), cell(c)).alias("values")) for c in columns])
    return rows.select(F.explode(cells).alias("f")).select("f.facet", F.explode("f.values").alias("value")).groupBy("facet", "value").agg(F.count("*").alias("n"))


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def ranked(df: DataFrame, state: str, position: str, by: list[str]) -> DataFrame:
    """With place: order by state rank, then position; place is within a group."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[F.col(state)], F.lit(4))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(rank, position)))


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 10) -> DataFrame:
    """Rows of a 1-based page under a total order; a top-k query, so no full sort in one task."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.ceil(F.count("*") / size).alias("pages"))


def page_buttons(page: int, pages: int, width: int = 5) -> list[int]:
    """Up to width page numbers around the current one, kept within 1..pages."""
    first = max(1, min(page - width // 2, pages - width + 1))
    return list(range(first, min(pages, first + width - 1) + 1))


def retained(df: DataFrame, ts: str, seq: str, now: Column, days: int = 30, most: int = 100) -> DataFrame:
    """Rows newer than so many days, and of those the last so many by (ts, seq)."""
    return df.filter(F.col(ts) > now - F.make_dt_interval(F.lit(days))).orderBy(F.desc(ts), F.desc(seq)).limit(most)


def day_bucket(ts: Column, now: Column) -> Column:
    return F.when(F.date_trunc("day", ts) == F.date_trunc("day", now), "today").otherwise("earlier")


def updated(df: DataFrame, changes: DataFrame, key: str, columns: list[str], nulls: bool = False) -> DataFrame:
    """df with the columns of the row in changes with the same key, where there is one; nulls of changes count only if asked for."""
    new = changes.select(F.col(key), F.lit(True).alias("_changed"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(new, key, "left")
    value = lambda c: F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"_{c}", c)
    return out.select(*[value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def appended(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def without(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def first_where(df: DataFrame, by: list[str], condition: Column, value: str, order: str) -> DataFrame:
    """The value of the first row by order that meets the condition; groups without one are left out."""
    return df.filter(condition).groupBy(*by).agg(F.min_by(value, order).alias(value))


def latest(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")).select(*by, *[f"_s.{c}" for c in columns])


def distinct_in_order(df: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """(by, position, value): each value once, where it comes first."""
    return df.groupBy(*by, value).agg(F.min(position).alias(position))


def unread(df: DataFrame, read: str = "read") -> DataFrame:
    return df.filter(~F.coalesce(F.col(read), F.lit(False)))


def with_value(df: DataFrame, column: str, value, most: int | None = None) -> DataFrame:
    """Rows of one id or batch; at most so many, if given."""
    found = df.filter(F.col(column) == value)
    return found if most is None else found.limit(most)


def mentions(columns: list[str], word: str) -> Column:
    """Whether any of the columns holds word."""
    return F.greatest(*[F.coalesce(F.contains(F.col(c), F.lit(word)), F.lit(False)) for c in columns])


def within_cap(new: DataFrame, existing: DataFrame, by: str, most: int) -> DataFrame:
    """The new rows of those batches that keep within the cap with the rows that are there already; other batches are rejected whole."""
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    fits = count(new, "_new").join(count(existing, "_old"), by, "left").filter(F.col("_new") + F.coalesce("_old", F.lit(0)) <= most)
    return new.join(fits.select(by), by, "left_semi")


def complete(df: DataFrame, columns: list[str]) -> Column:
    """Whether every required column has something: no null, empty text or empty list."""
    kinds, out = dict(df.dtypes), F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.size(c) if kinds[c].startswith("array") else F.length(F.col(c).cast("string")), F.lit(0)) > 0)
    return out


def succeeded(df: DataFrame, result: str) -> DataFrame:
    return df.filter(F.col(result).isNotNull())


def result_row(finished: DataFrame, identifier: str, name: str, result: str) -> DataFrame:
    """A finished document as a result: nested counts with 0 and a name and identifier with a text where there is none."""
    got = F.col(result)
    counts = F.struct(F.coalesce(got["missing"], F.lit(0)).alias("missing"), F.coalesce(got["extra"], F.lit(0)).alias("extra"))
    return finished.select(F.coalesce(identifier, F.lit("unknown")).alias("identifier"), F.coalesce(name, F.lit("no name")).alias("name"), F.struct(counts.alias("counts"), got.isNotNull().alias("done")).alias("result"))

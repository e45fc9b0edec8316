"""Aggregations: offer and shopper statistics, per-entity condensation, profiles and baselines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import kept
from . import prefix
from .relational import NARROW_ROWS, small

#: The field sets of offers that statistics are made for. Fixed values.
FIELD_SETS = [("category",), ("company",), ("brand",), ("company", "brand"), ("company", "category"), ("brand", "category"), ("category", "company", "brand")]
SPANS = [7, 30, 60, 180]
#: The largest code of several columns.
WORD = 1 << 62


def offer_stats(transactions: DataFrame, offers: DataFrame) -> DataFrame:
    """Per value of each field set that occurs in offers: count, avg_price, total_quantity, return_rate, avg_return.

    All sums are additive, so transactions are aggregated once by the three fields and the sets are rolled up from that
    small table. A return is a row whose quantity is not positive; the mean price is over all rows.
    """
    sold, back = F.col("quantity") > 0, F.coalesce(F.col("quantity") <= 0, F.lit(True))
    base = transactions.groupBy("category", "company", "brand").agg(
        F.count("*").alias("n"), F.sum(F.when(sold, F.col("amount") / F.col("quantity")).otherwise(0.0)).alias("price"), F.sum("quantity").alias("quantity"),
        F.sum(back.cast("long")).alias("returns"), F.sum(F.when(back, F.col("amount")).otherwise(0.0)).alias("returned"),
    )
    all_ = base.groupingSets([[F.col(c) for c in s] for s in FIELD_SETS], "category", "company", "brand").agg(
        F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("price").alias("price"), F.sum("quantity").alias("quantity"), F.sum("returns").alias("returns"), F.sum("returned").alias("returned"),
    )
    asked = offers.groupingSets([[F.col(c) for c in s] for s in FIELD_SETS], "category", "company", "brand").agg(F.grouping_id().alias("gid"))
    same = [all_[c].eqNullSafe(asked[c]) for c in ("gid", "category", "company", "brand")]
    kept = all_.join(asked, same, "left_semi")
    return kept.select(
        "gid", "category", "company", "brand", F.col("n").alias("count"), (F.col("price") / F.col("n")).alias("avg_price"), F.col("quantity").alias("total_quantity"),
        (F.col("returns") / F.col("n")).alias("return_rate"), F.try_divide("returned", "returns").alias("avg_return"),
    )


def offer_stats_wide(offers: DataFrame, stats: DataFrame) -> DataFrame:
    """Offers with the statistics of their own values: five columns for each field set. An offer asks once for each field set, all
    in one join, and the answers are brought together by offer."""
    names, three = ["count", "avg_price", "total_quantity", "return_rate", "avg_return"], ("category", "company", "brand")
    gid = {s: sum(1 << (2 - i) for i, c in enumerate(three) if c not in s) for s in FIELD_SETS}
    asks = F.array(*[F.struct(F.lit(g).cast("long").alias("gid"), *[(F.col(c) if c in s else F.lit(None).cast(offers.schema[c].dataType)).alias(c) for c in three]) for s, g in gid.items()])
    asked = offers.select("offer", F.inline(asks))
    same = [asked[c].eqNullSafe(stats[c]) for c in ("gid", *three)]
    found = asked.join(stats, same).select("offer", asked["gid"], *names)
    wide = found.groupBy("offer").agg(*[F.expr(f"max(CASE WHEN gid = {g} THEN `{n}` END) AS {'_'.join(s)}_{n}") for s, g in gid.items() for n in names])
    return offers.join(wide, "offer", "left")


def offer_pct_discount(wide: DataFrame) -> DataFrame:
    """For each field set, by how many percent the mean price is above the price that the offer gives."""
    price = F.col("offervalue") / F.col("quantity")
    return wide.select("offer", price.alias("offer_price"), *[(100 * (F.try_divide(F.col("_".join(s) + "_avg_price"), price) - 1)).alias("_".join(s) + "_discount") for s in FIELD_SETS])


def _conversion(n: Column, repeats: Column, trips: Column) -> list[Column]:
    return [F.try_divide(repeats, n).alias("repeat_freq"), F.try_divide(trips, n).alias("avg_repeat_per_user"), F.try_divide(trips, repeats).alias("avg_repeat_per_repeat_user"), n.alias("num_users"), repeats.alias("num_repeats"), trips.alias("total_repeat_trips")]


def offer_conversion(history: DataFrame) -> DataFrame:
    sums = history.groupBy("offer").agg(F.count("*").alias("n"), F.count_if(F.col("repeattrips") > 0).alias("r"), F.sum("repeattrips").alias("t"))
    return sums.select("offer", *_conversion(F.col("n"), F.col("r"), F.col("t")))


def offer_conversion_rollup(history: DataFrame, offers: DataFrame) -> DataFrame:
    """The same ratios for each field set, from sums by offer (ratios of sums)."""
    sums = history.groupBy("offer").agg(F.count("*").alias("n"), F.count_if(F.col("repeattrips") > 0).alias("r"), F.sum("repeattrips").alias("t"))
    held = offers.join(sums, "offer", "left")
    rolled = held.groupingSets([[F.col(c) for c in s] for s in FIELD_SETS], "category", "company", "brand").agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("t").alias("t"))
    return rolled.select("gid", "category", "company", "brand", *_conversion(F.col("n"), F.col("r"), F.col("t")))


def packed(tables: Sequence[DataFrame], columns: Sequence[str]) -> tuple[list[DataFrame], dict[str, str]]:
    """Tables with the columns' values as digits of numbers code_0, code_1, ... (each up to WORD, unless one column needs more), which take less of
    an exchange than texts do; and for each column the expression of its digit: 0 for a missing value or one that the first table does not have."""
    first = tables[0]
    bases = {c: n + 1 for c, n in first.agg(*[F.count_distinct(c).alias(c) for c in columns]).first().asDict().items()}
    words, digits = [], {}
    for c in columns:
        if not words or words[-1][1] * bases[c] > WORD:
            words.append(([], 1))
        names, size = words[-1]
        digits[c], words[-1] = f"code_{len(words) - 1} DIV {size} % {bases[c]}", ([*names, f"coalesce(__{c} + 1, 0) * {size}"], size * bases[c])
    codes = [small(prefix.integerize([first], c).withColumnRenamed("code", f"__{c}")) for c in columns]
    made = [f"{' + '.join(names)} AS code_{i}" for i, (names, _) in enumerate(words)]
    return [reduce(lambda d, k: d.join(k, k.columns[0], "left"), codes, t).selectExpr(*[c for c in t.columns if c not in columns], *made) for t in tables], digits


def sums_by_agreement(transactions: DataFrame, asked: DataFrame, same: Sequence[str], windows: Sequence[str], baskets: DataFrame | None = None, kept: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """n, amount and quantity of a shopper's transactions by `agree` (bit i: condition i of `same` holds between the row and the shopper's row of asked)
    and `span` (place of the first of the windows, each within the next, whose condition holds for `ago`, the days from the row to the offer; their
    number if none does), and by the columns of asked in `kept`. Rows that agree in nothing have only n, or all sums if `whole`.

    With baskets (basket, id, date), transactions have a basket in place of id and date. Offers then meet the baskets, which are fewer, and a
    basket's rows are summed where they meet it, so that few and narrow rows are exchanged by shopper."""
    within = "CASE " + "".join(f"WHEN {w} THEN {i} " for i, w in enumerate(windows)) + f"ELSE {len(windows)} END AS span"
    shown = ["id", within, *[c for c in asked.columns if c not in ("id", "offerdate")]]
    ago = lambda df: df.withColumn("ago", F.datediff("offerdate", "date"))
    if baskets is None:
        keys, held = ["id"], ago(transactions.join(asked, "id")).selectExpr(*shown, *[c for c in transactions.columns if c not in ("id", "date")])
    else:
        keys, held = ["basket", "id"], transactions.join(ago(baskets.join(asked, "id")).selectExpr("basket", *shown), "basket")
    by, agree = ["agree", "span", *kept], " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(same))
    held = held.selectExpr(*keys, f"{agree} AS agree", "span", *kept, "amount", "quantity")
    first = held.groupBy(*keys, *by).agg(F.count("*").alias("n"), *[F.sum(F.col(c) if whole else F.when(F.col("agree") > 0, F.col(c))).alias(c) for c in ("amount", "quantity")])
    return first.repartition("id").groupBy("id", *by).agg(*[F.sum(c).alias(c) for c in ("n", "amount", "quantity")])


def _with_products(transactions: DataFrame, offers: DataFrame, products: DataFrame | None, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Transactions, offers, and for each of kinds the condition that a row has the offer's; products' columns are packed, and join transactions."""
    if products is None:
        return transactions, offers, {c: f"{c} = o_{c}" for c in kinds}
    (offers, products), digits = packed([offers, products.select("product", *kinds)], kinds)
    return transactions.join(small(products, NARROW_ROWS), "product"), offers, {c: f"{d} > 0 AND {d} = o_{d}" for c, d in digits.items()}


def shopper_offer_features(
    transactions: DataFrame, history: DataFrame, offers: DataFrame, sets: Sequence[tuple[str, ...]] = (("chain",), *FIELD_SETS), spans: Sequence[int] = SPANS, baskets: DataFrame | None = None, products: DataFrame | None = None
) -> DataFrame:
    """Per shopper, for each field set of its offer and each window before the offer (and all time): how often, what share
    of all its rows, whether, for how much and how many. The many sums are made from `sums_by_agreement`, never from rows of an exchange.
    With baskets (basket, id, date) and products (product, category, company, brand), transactions have their keys in place of those columns."""
    kinds, ends = ("category", "company", "brand"), sorted(set(spans))
    transactions, offers, same = _with_products(transactions, offers.select("offer", *kinds), products, kinds)
    same = {"chain": "chain = o_chain"} | same
    fields = [c for c in offers.columns if c != "offer"]
    asked = history.select("id", F.col("chain").alias("o_chain"), "offer", "offerdate").join(offers.select("offer", *[F.col(c).alias(f"o_{c}") for c in fields]), "offer", "left").drop("offer")
    key = ["id", "date"] if baskets is None else ["basket"]
    held = sums_by_agreement(transactions.select(*key, "chain", *fields, "amount", "quantity"), asked, list(same.values()), [f"ago BETWEEN 0 AND {s}" for s in ends], baskets)
    bits = {f: sum(1 << list(same).index(c) for c in set(f)) for f in sets}
    names = {("_".join(f) + (f"_{s}" if s else "")): f"agree & {bits[f]} = {bits[f]}" + (f" AND span <= {ends.index(s)}" if s else "") for f in sets for s in (None, *spans)}
    sums = {"all_rows": "sum(n)"}
    for tag, hit in names.items():
        sums |= {f"{tag}_{short}": f"coalesce(sum(CASE WHEN {hit} THEN {c} END), {zero})" for short, c, zero in (("num", "n", "0L"), ("amt", "amount", "0D"), ("quant", "quantity", "0D"))}
    made = held.groupBy("id").agg(*[F.expr(f"{e} AS {c}") for c, e in sums.items()])
    shown = [x for t in names for x in (f"{t}_num", f"{t}_num / all_rows AS {t}_freq", f"CAST({t}_num > 0 AS INT) AS {t}_has", f"CAST({t}_num = 0 AS INT) AS {t}_never", f"{t}_amt", f"{t}_quant")]
    return made.selectExpr("id", *shown)


def shopper_recency_spend(transactions: DataFrame, history: DataFrame) -> DataFrame:
    """days_since_last (nearest purchase to the offer), avg_weekly (null over zero days), amt_week_of_offer."""
    held = transactions.join(history.select("id", "offerdate"), "id").withColumn("away", F.abs(F.datediff("date", "offerdate")))
    days = F.datediff(F.max("date"), F.min("date"))
    return held.groupBy("id").agg(F.min("away").alias("days_since_last"), (F.try_divide(F.sum("amount"), days) * 7).alias("avg_weekly"), F.coalesce(F.sum(F.when(F.col("away") < 7, F.col("amount"))), F.lit(0.0)).alias("amt_week_of_offer"))


def shopper_features_long(
    transactions: DataFrame, history: DataFrame, offers: DataFrame, spans: Sequence[int] = (30, 60, 90, 180), baskets: DataFrame | None = None, products: DataFrame | None = None
) -> DataFrame:
    """offer value and quantity, total spend, and for company, category and brand of the offer: count, quantity and amount, all
    time and for purchases less than a span before the offer (later ones count too); never-bought flags; combined flags; label.
    With baskets and products as in `shopper_offer_features`."""
    kinds, ends, own = ("company", "category", "brand"), sorted(set(spans)), ("offervalue", "offer_quantity")
    transactions, offers, same = _with_products(transactions, offers.select("offer", "offervalue", F.col("quantity").alias("offer_quantity"), *kinds), products, kinds)
    fields = [c for c in offers.columns if c not in ("offer", *own)]
    asked = history.select("id", "offer", "offerdate", "repeater").join(offers.select("offer", *own, *[F.col(c).alias(f"o_{c}") for c in fields]), "offer").drop("offer")
    key = ["id", "date"] if baskets is None else ["basket"]
    held = sums_by_agreement(transactions.select(*key, *fields, "amount", "quantity"), asked, list(same.values()), [f"ago < {s}" for s in ends], baskets, (*own, "repeater"), whole=True)
    aggs = [F.first("offervalue").alias("offer_value"), F.first("offer_quantity").alias("offer_quantity"), F.first("repeater").alias("repeater"), F.sum("amount").alias("total_spend")]
    for i, c in enumerate(kinds):
        for s in (None, *spans):
            hit, tag = f"agree & {1 << i} > 0" + (f" AND span <= {ends.index(s)}" if s else ""), f"has_{c}" + (f"_{s}" if s else "")
            aggs += [F.expr(f"coalesce(sum(CASE WHEN {hit} THEN {x} END), {zero}) AS {tag}{end}") for x, zero, end in (("n", "0L", ""), ("quantity", "0D", "_q"), ("amount", "0D", "_a"))]
    sums = held.groupBy("id").agg(*aggs)
    has = {c: F.col(f"has_{c}") > 0 for c in kinds}
    return sums.withColumns({
        **{f"never_bought_{c}": (~has[c]).cast("int") for c in kinds}, "has_brand_company": (has["brand"] & has["company"]).cast("int"),
        "has_brand_category": (has["brand"] & has["category"]).cast("int"), "has_brand_company_category": (has["brand"] & has["company"] & has["category"]).cast("int"),
        "label": F.when(F.col("repeater") == "t", 1.0).when(F.col("repeater") == "f", 0.0).otherwise(0.5),
    }).drop("repeater")


def condense_count_distinct(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Numbers of distinct values; a missing value is one."""
    return df.groupBy(key).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"{c}_count") for c in columns])


def condense_mean(df: DataFrame, key: str, columns: Sequence[str], above: float = -1) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(F.when(F.col(c) > above, F.col(c))).alias(f"{c}_avg") for c in columns])


def condense_last(df: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Values of the last row by an explicit order (which must be unique within the key)."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(f"{c}_last") for c in columns])


def condense_cheapest(df: DataFrame, key: str, columns: Sequence[str], cost: str) -> DataFrame:
    """Means over the rows with the key's smallest cost; two aggregates and a join, so no window holds a key's rows."""
    least = df.groupBy(key).agg(F.min(cost).alias("__least"))
    return df.join(least, key).where(F.col(cost) == F.col("__least")).groupBy(key).agg(*[F.avg(c).alias(f"{c}_cheap") for c in columns])


def condense_customers(quotes: DataFrame, options: Sequence[str] = tuple("abcdefg")) -> DataFrame:
    """Quote rows condensed to a row for each customer, with the purchased options as <option>_res where there was a purchase."""
    shown = quotes.where("record_type = 0")
    last = F.max_by(F.struct("cost", "car_value", *options), "shopping_pt").alias("r")
    one = shown.groupBy("customer_id").agg(F.count("*").alias("n_quotes"), F.avg("cost").alias("cost_avg"), F.min("cost").alias("cost_min"), last).select("customer_id", "n_quotes", "cost_avg", "cost_min", *[F.col(f"r.{c}").alias(f"{c}_last") for c in ("cost", "car_value", *options)])
    bought = quotes.where("record_type = 1").select("customer_id", *[F.col(c).alias(f"{c}_res") for c in options])
    return one.join(condense_cheapest(shown, "customer_id", options, "cost"), "customer_id").join(bought, "customer_id", "left")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of each combination of values."""
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(*columns).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(*columns, "n", (F.col("n") / F.col("total")).alias("share"))


def missing_profile(df: DataFrame) -> DataFrame:
    """column_name, n_null, pct_null, n_inf, pct_inf for each column, in one pass."""
    aggs = [F.count("*").alias("__n")]
    for c, kind in df.dtypes:
        inf = F.count_if(F.abs(F.col(c)) == float("inf")) if kind in ("double", "float") else F.lit(0).cast("long")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"), inf.alias(f"{c}__inf")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__null").alias("n_null"), F.col(f"{c}__inf").alias("n_inf")) for c in df.columns])
    out = one.select("__n", F.inline(rows))
    return out.select("column_name", "n_null", (100 * F.try_divide("n_null", "__n")).alias("pct_null"), "n_inf", (100 * F.try_divide("n_inf", "__n")).alias("pct_inf"))


def missing_totals(df: DataFrame) -> DataFrame:
    """Numbers and percents of rows and cells with nulls, and the number of columns with any."""
    width = len(df.columns)
    in_row = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    one = df.withColumn("__k", in_row).agg(F.count("*").alias("n"), F.count_if(F.col("__k") > 0).alias("n_rows"), F.sum("__k").alias("n_cells"), *[F.max(F.col(c).isNull().cast("int")).alias(f"__c_{i}") for i, c in enumerate(df.columns)])
    columns = sum((F.col(f"__c_{i}") for i in range(width)), F.lit(0))
    return one.select(columns.cast("long").alias("n_columns"), (100.0 * columns / width).alias("pct_columns"), "n_rows", (100 * F.try_divide("n_rows", "n")).alias("pct_rows"), "n_cells", (100 * F.try_divide("n_cells", F.col("n") * width)).alias("pct_cells"))


def impute_constants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, mean, median (exact), mode (smallest of the most frequent): all from one count by column and value."""
    held = prefix.long_form(df, columns).where(F.col("value").isNotNull())
    counts = kept(held.groupBy("name", "value").agg(F.count("*").alias("n")), "counts")
    run = prefix.global_prefix_sum(counts, "value", ["n"], by=["name"], totals=True)
    place = (F.col("total_n") - 1) / 2
    at = lambda i: F.max(F.when((F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n")), F.col("value")))
    mode = F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"]
    found = run.groupBy("name").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), ((at(F.floor(place)) + at(F.ceil(place))) / 2).alias("median"), mode.alias("mode"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(found, F.col("column_name") == F.col("name"), "left").drop("name")


def rate_table(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Mean label and its rounding for each combination of keys."""
    return df.groupBy(*keys).agg(F.avg(label).alias("rate"), F.count("*").alias("n")).withColumn("predicted", (F.col("rate") >= 0.5).cast("int"))


def group_median_fill(df: DataFrame, column: str, group: str) -> DataFrame:
    """Missing values become the median of their group."""
    medians = prefix.percentiles(df, column, [0.5], [group]).select(group, F.col("p")[0].alias("__m"))
    return df.join(small(medians), group, "left").withColumn(column, F.coalesce(column, "__m")).drop("__m")


def range_compare(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether test's range of a column reaches beyond train's, and the ratio of ranges."""

    def ends(df: DataFrame, tag: str) -> DataFrame:
        one = df.agg(*[x for c in columns for x in (F.min(c).cast("double").alias(f"{c}__lo"), F.max(c).cast("double").alias(f"{c}__hi"))])
        return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__lo").alias(f"{tag}_min"), F.col(f"{c}__hi").alias(f"{tag}_max")) for c in columns])))

    both = ends(train, "train").join(ends(test, "test"), "column_name")
    wider = (F.col("test_min") < F.col("train_min")) | (F.col("test_max") > F.col("train_max"))
    return both.withColumn("wider", wider).withColumn("ratio", F.try_divide(F.col("test_max") - F.col("test_min"), F.col("train_max") - F.col("train_min")))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins (1 to bins; the upper end belongs to the last); shares within the group."""
    b = F.least(F.greatest(F.floor((F.col(column) - lo) / ((hi - lo) / bins)).cast("int") + 1, F.lit(1)), F.lit(bins))
    counts = df.where(F.col(column).between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))


def percentiles(df: DataFrame, column: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles by linear interpolation, one column for each (p0_1 for 0.1)."""
    p = prefix.percentiles(df, column, [x / 100 for x in at], by)
    return p.select(*by, *[F.col("p")[i].alias(f"p{str(x).replace('.', '_')}") for i, x in enumerate(at)])


def weighted_center(df: DataFrame, by: str, x: str, y: str, weight: Column) -> DataFrame:
    return df.groupBy(by).agg(F.try_divide(F.sum(F.col(x) * weight), F.sum(weight)).alias("x_center"), F.try_divide(F.sum(F.col(y) * weight), F.sum(weight)).alias("y_center"))

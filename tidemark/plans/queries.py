"""Registered queries: each operator on the recast tables, with its SQL twin.

Both sides are rounded by the same list of columns, as the order of a sum differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates as agg
from ..operators import metrics, prefix, prep, relational, spatial
from .recast import as_sql, rounded, rounded_sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None, columns: str = "", places: int = 9):
    """Adds a query: a function of a view reader; columns: those to round, separated by blanks."""
    names = columns.split()

    def add(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(make(lambda n: view(spark, sf_dir, n)), names, places)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(as_sql(sql), names, places)
        return make

    return add


# Projections, filters, predicates


register("project_columns", "SELECT offer, brand FROM {offers}")(lambda v: v("offers").select("offer", "brand"))
register("drop_columns", "SELECT id, survived, pclass, sex FROM {passengers}")(lambda v: v("passengers").drop("fare", "embarked", "age"))
register("split_target", "SELECT id, pclass, sex, fare, embarked, age, survived AS target, true AS is_train FROM {passengers}", "fare")(
    lambda v: (lambda t: t[0].withColumn("is_train", F.lit(t[1])))(relational.split_target(v("passengers").withColumnRenamed("survived", "target"), "target"))
)
register("filter_conj_eq", "SELECT id, fare FROM {passengers} WHERE sex = 'female' AND pclass = 2", "fare")(lambda v: relational.filter_conj_eq(v("passengers"), {"sex": "female", "pclass": 2}).select("id", "fare"))
register("filter_mask", "SELECT id, sex = 'male' AND pclass = 1 AS mask FROM {passengers}")(lambda v: relational.with_mask(v("passengers"), {"sex": "male", "pclass": 1}).select("id", "mask"))
register("filter_record_type", "SELECT customer_id, shopping_pt, cost FROM {quotes} WHERE record_type = 1", "cost")(lambda v: v("quotes").where("record_type = 1").select("customer_id", "shopping_pt", "cost"))
register("filter_isin", "SELECT id, market FROM {history} WHERE market IN ('BUILDING', 'MACHINERY')")(lambda v: v("history").where(F.col("market").isin("BUILDING", "MACHINERY")).select("id", "market"))
register("replace_sentinel", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(var4, 'Z') AS var4 FROM {loss}")(lambda v: relational.replace_sentinel(v("loss"), ["var4"], "Z").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "var4"))
register("code_by_dict", "SELECT customer_id, shopping_pt, CASE car_value WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 ELSE -1 END AS code FROM {quotes}")(lambda v: relational.code_by_dict(v("quotes"), "car_value", {"a": 1, "b": 2, "c": 3}, "code", -1).select("customer_id", "shopping_pt", "code"))
register("cast_columns", "SELECT id, CAST(pclass AS VARCHAR) AS pclass, CAST(survived AS DOUBLE) AS survived FROM {passengers}")(lambda v: relational.cast_columns(relational.cast_columns(v("passengers"), ["pclass", "absent"], "string"), ["survived"], "double").select("id", "pclass", "survived"))
register("binarize_target", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(target > 0 AS INT) AS y FROM {loss}")(lambda v: v("loss").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("target") > 0).cast("int").alias("y")))
register("bool_to_int", "SELECT id, CAST(repeater = 't' AS INT) AS repeats FROM {history}")(lambda v: v("history").select("id", (F.col("repeater") == "t").cast("int").alias("repeats")))
register("derive_difference", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, var13 - var10 AS diff FROM {loss}", "diff")(lambda v: v("loss").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("var13") - F.col("var10")).alias("diff")))
register("derive_pairwise", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, var11 * var10 AS var11_x_var10, var11 + var10 AS var11_p_var10, var13 * var10 AS var13_x_var10, var13 + var10 AS var13_p_var10, var13 * var11 AS var13_x_var11, var13 + var11 AS var13_p_var11 FROM {loss}", "var11_x_var10 var11_p_var10 var13_x_var10 var13_p_var10 var13_x_var11 var13_p_var11")(
    lambda v: relational.pairwise(v("loss"), ["var10", "var11", "var13"]).drop("target", "var4", "var8", "var10", "var11", "var13", "var15")
)
register("inf_to_mean", "WITH t AS (SELECT id, CASE WHEN repeattrips = 0 THEN 'infinity'::DOUBLE ELSE chain / CAST(repeattrips AS DOUBLE) END AS r FROM {history}) SELECT id, CASE WHEN isinf(r) THEN (SELECT avg(r) FROM t WHERE NOT isinf(r)) ELSE r END AS r FROM t", "r")(
    lambda v: relational.inf_to_mean(v("history").select("id", F.when(F.col("repeattrips") == 0, float("inf")).otherwise(F.col("chain") / F.col("repeattrips")).alias("r")), ["r"])
)
register("clip_cap", "SELECT id, CASE WHEN fare >= 40 THEN 39.0 ELSE fare END AS fare FROM {passengers}", "fare")(lambda v: v("passengers").select("id", F.when(F.col("fare") >= 40, 39.0).otherwise(F.col("fare")).alias("fare")))
register("label_concat", "SELECT customer_id, shopping_pt, concat(a, b, c, d, e, f, g) AS label FROM {quotes}")(lambda v: relational.label_concat(v("quotes"), list("abcdefg"), "label").select("customer_id", "shopping_pt", "label"))
register("label_split", "SELECT customer_id, shopping_pt, c AS third FROM {quotes}")(lambda v: relational.label_split(relational.label_concat(v("quotes"), list("abcdefg"), "label"), "label", 2, "third").select("customer_id", "shopping_pt", "third"))
register("preview_head", "SELECT id, market FROM {history} ORDER BY id LIMIT 10")(lambda v: v("history").select("id", "market").orderBy("id").limit(10))
register("date_holiday_flags", "SELECT id, isodow(offerdate) - 1 AS weekday, CAST(isodow(offerdate) >= 6 AS INT) AS weekend, CAST(DATE '1999-02-14' - offerdate BETWEEN 1 AND 6 AS INT) AS week_before, CAST(DATE '1999-02-14' - offerdate BETWEEN 1 AND 13 AS INT) AS two_before, CAST(offerdate - DATE '1999-02-14' BETWEEN 1 AND 6 AS INT) AS week_after, CAST(offerdate - DATE '1999-02-14' BETWEEN 1 AND 13 AS INT) AS two_after FROM {history}")(
    lambda v: scalars.holiday_flags(v("history"), "offerdate", "1999-02-14").select("id", F.col("weekday").cast("long"), "weekend", "week_before", "two_before", "week_after", "two_after")
)
register("angle_0_2pi", "WITH t AS (SELECT galaxy, atan2(e2, e1) AS w FROM {skies}) SELECT galaxy, CASE WHEN w < 0 THEN w + 2 * pi() ELSE w END AS angle FROM t", "angle")(lambda v: v("skies").select("galaxy", scalars.angle(F.col("e2"), F.col("e1")).alias("angle")))

# Joins

register("join_left_star", "SELECT h.id, h.offer, o.category, o.company, o.brand, o.offervalue, t.total FROM {history} h LEFT JOIN {offers} o ON h.offer = o.offer LEFT JOIN (SELECT id, sum(amount) AS total FROM {transactions} GROUP BY id) t ON h.id = t.id", "offervalue total")(
    lambda v: relational.join_star(v("history").select("id", "offer"), {"offer": v("offers").select("offer", "category", "company", "brand", "offervalue"), "id": v("transactions").groupBy("id").agg(F.sum("amount").alias("total"))}).select("id", "offer", "category", "company", "brand", "offervalue", "total")
)
register("join_left_offer", "SELECT h.id, h.offer, o.brand FROM {history} h LEFT JOIN {offers} o ON h.offer = o.offer")(lambda v: v("history").select("id", "offer").join(relational.small(v("offers").select("offer", "brand")), "offer", "left").select("id", "offer", "brand"))
register("join_left_new_columns", "SELECT h.id, h.chain, h.market, p.survived, p.sex FROM {history} h LEFT JOIN {passengers} p ON h.id = p.id")(lambda v: relational.join_new_columns(v("history").select("id", "chain", "market"), v("passengers").select("id", F.lit(0).alias("chain"), "survived", "sex"), "id"))
register("join_index_chain", "SELECT s.customer_id, s.m, s.n, r.cost AS cost_res FROM (SELECT customer_id, avg(cost) AS m, count(*) AS n FROM {quotes} WHERE record_type = 0 GROUP BY customer_id) s LEFT JOIN {quotes} r ON s.customer_id = r.customer_id AND r.record_type = 1", "m cost_res")(
    lambda v: v("quotes").where("record_type = 0").groupBy("customer_id").agg(F.avg("cost").alias("m"), F.count("*").alias("n")).join(v("quotes").where("record_type = 1").select("customer_id", F.col("cost").alias("cost_res")), "customer_id", "left")
)
register("join_semi_ids", "SELECT id, count(*) AS n FROM {transactions} WHERE id IN (SELECT id FROM {history} WHERE repeater = 't') GROUP BY id")(lambda v: v("transactions").join(v("history").where("repeater = 't'").select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")))
register("join_semi_or", "SELECT id, count(*) AS n, sum(amount) AS amount FROM {transactions} WHERE brand IN (SELECT brand FROM {offers}) OR company IN (SELECT company FROM {offers} WHERE quantity = 1) GROUP BY id", "amount")(
    lambda v: relational.semi_or(v("transactions"), v("offers").select("brand", F.when(F.col("quantity") == 1, F.col("company")).alias("company")), ["brand", "company"]).groupBy("id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
)
register("join_anti_unseen", "WITH te AS (SELECT fare FROM {passengers} WHERE id % 4 = 0) SELECT fare, count(*) AS n, count(*) / CAST((SELECT count(*) FROM te) AS DOUBLE) AS share FROM te WHERE fare NOT IN (SELECT fare FROM {passengers} WHERE id % 4 <> 0 AND fare IS NOT NULL) GROUP BY fare", "fare share")(
    lambda v: relational.unseen_share(v("passengers").where("id % 4 <> 0"), v("passengers").where("id % 4 = 0"), "fare").where("fare is not null")
)
register("join_left_default", "SELECT h.id, coalesce(s.total, 0) AS total FROM {history} h LEFT JOIN (SELECT id, sum(amount) AS total FROM {transactions} WHERE brand = 'Brand#11' GROUP BY id) s ON h.id = s.id", "total")(
    lambda v: relational.join_default(v("history"), v("transactions").where("brand = 'Brand#11'").groupBy("id").agg(F.sum("amount").alias("total")), "id", "total")
)
register("join_lookup_mark", "SELECT t.id, count(*) AS n, sum(CAST(t.category = o.category AS INT))::BIGINT AS category, sum(CAST(t.company = o.company AS INT))::BIGINT AS company, sum(CAST(t.brand = o.brand AS INT))::BIGINT AS brand FROM {transactions} t JOIN {history} h ON t.id = h.id JOIN {offers} o ON h.offer = o.offer GROUP BY t.id")(
    lambda v: relational.mark_same(v("transactions"), v("history").select("id", "offer").join(v("offers"), "offer"), "id", ["category", "company", "brand"]).groupBy("id").agg(F.count("*").alias("n"), *[F.sum(f"same_{c}").alias(c) for c in ("category", "company", "brand")])
)
register("join_interval_window", "SELECT t.id, " + ", ".join(f"count(*) FILTER (h.offerdate - t.date BETWEEN 0 AND {s}) AS n_{s}, coalesce(sum(amount) FILTER (h.offerdate - t.date BETWEEN 0 AND {s}), 0) AS sum_{s}" for s in (7, 30, 60, 180)) + " FROM {transactions} t JOIN {history} h ON t.id = h.id GROUP BY t.id", "sum_7 sum_30 sum_60 sum_180")(
    lambda v: relational.windows_before(v("transactions"), v("history"), "id", "date", "offerdate", F.col("amount"), (7, 30, 60, 180))
)
register("join_grid_bin", "SELECT sky_id, CAST(floor(x / 280) AS INT) AS i, CAST(floor(y / 280) AS INT) AS j, count(*) AS n FROM {skies} GROUP BY ALL")(lambda v: v("skies").groupBy("sky_id", F.floor(F.col("x") / 280).cast("int").alias("i"), F.floor(F.col("y") / 280).cast("int").alias("j")).agg(F.count("*").alias("n")))
_BIN = "CASE WHEN fare IS NULL THEN 3 - pclass ELSE CAST(least(floor(fare / 10), 3) AS INT) END"
register("join_bin_lookup", f"WITH b AS (SELECT *, {_BIN} AS bin FROM {{passengers}}), t AS (SELECT sex, pclass, bin, CAST(avg(survived) >= 0.5 AS INT) AS predicted FROM b GROUP BY ALL) SELECT b.id, b.bin, t.predicted FROM b JOIN t ON b.sex = t.sex AND b.pclass = t.pclass AND b.bin = t.bin")(
    lambda v: (lambda b: b.join(relational.small(agg.rate_table(b, ["sex", "pclass", "bin"], "survived")), ["sex", "pclass", "bin"]).select("id", F.col("bin").cast("long"), "predicted"))(v("passengers").withColumn("bin", F.expr(_BIN)))
)
register("bind_columns_by_key", "SELECT p.id, p.sex, h.market, h.repeattrips FROM {passengers} p JOIN {history} h ON p.id = h.id")(lambda v: v("passengers").select("id", "sex").join(v("history").select("id", "market", "repeattrips"), "id"))
register("join_scatter_back", "WITH m AS (SELECT sex, pclass, avg(survived) AS r FROM {passengers} GROUP BY ALL) SELECT id, CASE WHEN p.pclass = 3 THEN m.r ELSE 0.0 END AS predicted FROM {passengers} p JOIN m ON p.sex = m.sex AND p.pclass = m.pclass", "predicted")(
    lambda v: v("passengers").join(relational.small(agg.rate_table(v("passengers").where("pclass = 3"), ["sex", "pclass"], "survived").select("sex", "pclass", "rate")), ["sex", "pclass"], "left").select("id", F.coalesce("rate", F.lit(0.0)).alias("predicted"))
)

# Aggregations

_STATS = "count(*) AS count, sum(CASE WHEN quantity > 0 THEN amount / quantity ELSE 0 END) / count(*) AS avg_price, sum(quantity) AS total_quantity, count(*) FILTER (quantity <= 0) / CAST(count(*) AS DOUBLE) AS return_rate, sum(amount) FILTER (quantity <= 0) / nullif(count(*) FILTER (quantity <= 0), 0) AS avg_return"
_SETS = "(category), (company), (brand), (company, brand), (company, category), (brand, category), (category, company, brand)"
_GROUPED = f"SELECT CAST(grouping(category, company, brand) AS BIGINT) AS gid, category, company, brand, {_STATS} FROM {{transactions}} GROUP BY GROUPING SETS ({_SETS})"
_KEPT = f"SELECT s.* FROM ({_GROUPED}) s WHERE EXISTS (SELECT 1 FROM (SELECT CAST(grouping(category, company, brand) AS BIGINT) AS gid, category, company, brand FROM {{offers}} GROUP BY GROUPING SETS ({_SETS})) o WHERE o.gid = s.gid AND o.category IS NOT DISTINCT FROM s.category AND o.company IS NOT DISTINCT FROM s.company AND o.brand IS NOT DISTINCT FROM s.brand)"
register("offer_stats_grouping_sets", _KEPT, "avg_price total_quantity return_rate avg_return")(lambda v: agg.offer_stats(v("transactions"), v("offers")))
_NAMES = ["count", "avg_price", "total_quantity", "return_rate", "avg_return"]
_WIDE = "SELECT o.*" + "".join(f", s{i}.{n} AS {'_'.join(s)}_{n}" for i, s in enumerate(agg.FIELD_SETS) for n in _NAMES) + " FROM {offers} o" + "".join(f" LEFT JOIN (SELECT {', '.join(s)}, {_STATS} FROM {{transactions}} GROUP BY ALL) s{i} ON " + " AND ".join(f"o.{c} = s{i}.{c}" for c in s) for i, s in enumerate(agg.FIELD_SETS))
register("offer_stats_wide", _WIDE, "offervalue " + " ".join(f"{'_'.join(s)}_{n}" for s in agg.FIELD_SETS for n in _NAMES[1:]))(lambda v: agg.offer_stats_wide(v("offers"), agg.offer_stats(v("transactions"), v("offers"))))
register("offer_pct_discount", "SELECT offer, offervalue / quantity AS offer_price" + "".join(f", 100 * ({'_'.join(s)}_avg_price / (offervalue / quantity) - 1) AS {'_'.join(s)}_discount" for s in agg.FIELD_SETS) + f" FROM ({_WIDE}) w", "offer_price " + " ".join(f"{'_'.join(s)}_discount" for s in agg.FIELD_SETS))(
    lambda v: agg.offer_pct_discount(agg.offer_stats_wide(v("offers"), agg.offer_stats(v("transactions"), v("offers"))))
)
_CONV = "r / nullif(CAST(n AS DOUBLE), 0) AS repeat_freq, t / nullif(CAST(n AS DOUBLE), 0) AS avg_repeat_per_user, t / nullif(CAST(r AS DOUBLE), 0) AS avg_repeat_per_repeat_user, n AS num_users, r AS num_repeats, t AS total_repeat_trips"
_BY_OFFER = "SELECT offer, count(*) AS n, count(*) FILTER (repeattrips > 0) AS r, CAST(sum(repeattrips) AS BIGINT) AS t FROM {history} GROUP BY offer"
register("offer_conversion", f"SELECT offer, {_CONV} FROM ({_BY_OFFER}) h", "repeat_freq avg_repeat_per_user avg_repeat_per_repeat_user")(lambda v: agg.offer_conversion(v("history")))
register("offer_conversion_rollup", f"SELECT gid, category, company, brand, {_CONV} FROM (SELECT CAST(grouping(category, company, brand) AS BIGINT) AS gid, category, company, brand, CAST(sum(n) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS r, CAST(sum(t) AS BIGINT) AS t FROM {{offers}} o LEFT JOIN ({_BY_OFFER}) h ON o.offer = h.offer GROUP BY GROUPING SETS ({_SETS})) g", "repeat_freq avg_repeat_per_user avg_repeat_per_repeat_user")(
    lambda v: agg.offer_conversion_rollup(v("history"), v("offers"))
)


def _shopper_sql() -> tuple[str, str]:
    sums, out, rounded = ["count(*) AS all_rows"], ["id"], []
    for fields in (("chain",), *agg.FIELD_SETS):
        for span in (None, *agg.SPANS):
            tag = "_".join(fields) + (f"_{span}" if span else "")
            hit = " AND ".join(f"t.{c} = {'h' if c == 'chain' else 'o'}.{c}" for c in fields) + (f" AND h.offerdate - t.date BETWEEN 0 AND {span}" if span else "")
            sums += [f"count(*) FILTER ({hit}) AS {tag}_num", f"coalesce(sum(amount) FILTER ({hit}), 0) AS {tag}_amt", f"coalesce(sum(t.quantity) FILTER ({hit}), 0) AS {tag}_quant"]
            out += [f"{tag}_num", f"{tag}_num / CAST(all_rows AS DOUBLE) AS {tag}_freq", f"CAST({tag}_num > 0 AS INT) AS {tag}_has", f"CAST({tag}_num = 0 AS INT) AS {tag}_never", f"{tag}_amt", f"{tag}_quant"]
            rounded += [f"{tag}_freq", f"{tag}_amt", f"{tag}_quant"]
    return f"SELECT {', '.join(out)} FROM (SELECT t.id, {', '.join(sums)} FROM {{transactions}} t JOIN {{history}} h ON t.id = h.id LEFT JOIN {{offers}} o ON h.offer = o.offer GROUP BY t.id) s", " ".join(rounded)


register("shopper_offer_features", *_shopper_sql())(
    lambda v: agg.shopper_offer_features(v("lines").join(relational.small(v("sellers"), relational.NARROW_ROWS), "seller"), v("history"), v("offers"), baskets=v("baskets"), products=v("products"))
)
register("shopper_recency_spend", "SELECT t.id, min(abs(t.date - h.offerdate)) AS days_since_last, sum(amount) / nullif(max(t.date) - min(t.date), 0) * 7 AS avg_weekly, coalesce(sum(amount) FILTER (abs(t.date - h.offerdate) < 7), 0) AS amt_week_of_offer FROM {transactions} t JOIN {history} h ON t.id = h.id GROUP BY t.id", "avg_weekly amt_week_of_offer")(
    lambda v: agg.shopper_recency_spend(v("transactions"), v("history")).withColumn("days_since_last", F.col("days_since_last").cast("long"))
)


def _windows_sql() -> tuple[str, str]:
    sums, rounded = ["t.id", "min(o.offervalue) AS offer_value", "min(o.quantity) AS offer_quantity", "sum(amount) AS total_spend", "min(repeater) AS repeater"], ["offer_value", "total_spend"]
    for c in ("company", "category", "brand"):
        for s in (None, 30, 60, 90, 180):
            tag = f"has_{c}" + (f"_{s}" if s else "")
            hit = f"t.{c} = o.{c}" + (f" AND h.offerdate - t.date < {s}" if s else "")
            sums += [f"count(*) FILTER ({hit}) AS {tag}", f"coalesce(sum(t.quantity) FILTER ({hit}), 0) AS {tag}_q", f"coalesce(sum(amount) FILTER ({hit}), 0) AS {tag}_a"]
            rounded += [f"{tag}_q", f"{tag}_a"]
    never = "".join(f", CAST(has_{c} = 0 AS INT) AS never_bought_{c}" for c in ("company", "category", "brand"))
    combos = ", CAST(has_brand > 0 AND has_company > 0 AS INT) AS has_brand_company, CAST(has_brand > 0 AND has_category > 0 AS INT) AS has_brand_category, CAST(has_brand > 0 AND has_company > 0 AND has_category > 0 AS INT) AS has_brand_company_category"
    return f"SELECT * EXCLUDE (repeater){never}{combos}, CASE repeater WHEN 't' THEN 1.0 WHEN 'f' THEN 0.0 ELSE 0.5 END AS label FROM (SELECT {', '.join(sums)} FROM {{transactions}} t JOIN {{history}} h ON t.id = h.id JOIN {{offers}} o ON h.offer = o.offer GROUP BY t.id) s", " ".join([*rounded, "label"])


register("shopper_offer_features_windows", *_windows_sql())(
    lambda v: agg.shopper_features_long(v("lines").join(relational.small(v("sellers"), relational.NARROW_ROWS), "seller"), v("history"), v("offers"), baskets=v("baskets"), products=v("products"))
)
register("condense_count_distinct", "SELECT customer_id" + "".join(f", count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)) AS {c}_count" for c in ("a", "k", "risk_factor", "car_value")) + " FROM {quotes} GROUP BY customer_id")(lambda v: agg.condense_count_distinct(v("quotes"), "customer_id", ["a", "k", "risk_factor", "car_value"]))
register("condense_cond_mean", "SELECT customer_id, avg(cost) FILTER (cost > -1) AS cost_avg, avg(b) FILTER (b > 0) AS b_avg FROM {quotes} GROUP BY customer_id", "cost_avg b_avg")(lambda v: agg.condense_mean(v("quotes"), "customer_id", ["cost"]).join(agg.condense_mean(v("quotes"), "customer_id", ["b"], 0), "customer_id"))
register("condense_last", "SELECT customer_id, arg_max(a, shopping_pt) AS a_last, arg_max(cost, shopping_pt) AS cost_last FROM {quotes} GROUP BY customer_id", "cost_last")(lambda v: agg.condense_last(v("quotes"), "customer_id", ["a", "cost"], "shopping_pt"))
register("condense_cheapest", "SELECT customer_id, avg(a) AS a_cheap, avg(g) AS g_cheap FROM {quotes} q WHERE cost = (SELECT min(cost) FROM {quotes} p WHERE p.customer_id = q.customer_id) GROUP BY customer_id", "a_cheap g_cheap")(lambda v: agg.condense_cheapest(v("quotes"), "customer_id", ["a", "g"], "cost"))
_OPT = "abcdefg"
register("condense_customers", "WITH s AS (SELECT * FROM {quotes} WHERE record_type = 0), o AS (SELECT customer_id, count(*) AS n_quotes, avg(cost) AS cost_avg, min(cost) AS cost_min, arg_max(cost, shopping_pt) AS cost_last, arg_max(car_value, shopping_pt) AS car_value_last" + "".join(f", arg_max({c}, shopping_pt) AS {c}_last" for c in _OPT) + " FROM s GROUP BY customer_id), ch AS (SELECT s.customer_id" + "".join(f", avg({c}) AS {c}_cheap" for c in _OPT) + " FROM s JOIN o ON s.customer_id = o.customer_id AND s.cost = o.cost_min GROUP BY s.customer_id) SELECT o.*" + "".join(f", ch.{c}_cheap" for c in _OPT) + "".join(f", r.{c} AS {c}_res" for c in _OPT) + " FROM o JOIN ch ON o.customer_id = ch.customer_id LEFT JOIN {quotes} r ON o.customer_id = r.customer_id AND r.record_type = 1", "cost_avg cost_min cost_last " + " ".join(f"{c}_cheap" for c in _OPT))(
    lambda v: agg.condense_customers(v("quotes"))
)
register("value_counts", "SELECT category, brand, count(*) AS n, count(*) / CAST((SELECT count(*) FROM {transactions}) AS DOUBLE) AS share FROM {transactions} GROUP BY category, brand", "share")(lambda v: agg.value_counts(v("transactions"), ["category", "brand"]))
_PCOLS = ["id", "survived", "pclass", "sex", "fare", "embarked", "age"]
register("missing_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, 100 * (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS pct_null, CAST(0 AS BIGINT) AS n_inf, 0.0 AS pct_inf FROM {{passengers}}" for c in _PCOLS), "pct_null pct_inf")(lambda v: agg.missing_profile(v("passengers")))
register("missing_totals", "SELECT CAST(2 AS BIGINT) AS n_columns, 200 / 7.0 AS pct_columns, count(*) FILTER (fare IS NULL OR age IS NULL) AS n_rows, 100 * count(*) FILTER (fare IS NULL OR age IS NULL) / CAST(count(*) AS DOUBLE) AS pct_rows, 2 * count(*) - count(fare) - count(age) AS n_cells, 100 * (2 * count(*) - count(fare) - count(age)) / CAST(7 * count(*) AS DOUBLE) AS pct_cells FROM {passengers}", "pct_columns pct_rows pct_cells")(lambda v: agg.missing_totals(v("passengers")))
register("impute_constants", " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg({c}) AS mean, median({c}) AS median, (SELECT {c} FROM {{loss}} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode FROM {{loss}}" for c in ("var8", "var11", "var13", "var15")), "mean median mode")(lambda v: agg.impute_constants(v("loss"), ["var8", "var11", "var13", "var15"]))
register("survival_pivot", f"WITH b AS (SELECT *, {_BIN} AS bin FROM {{passengers}}) SELECT sex, pclass, coalesce(avg(survived) FILTER (bin = 0), 0) AS bin_0, coalesce(avg(survived) FILTER (bin = 1), 0) AS bin_1, coalesce(avg(survived) FILTER (bin = 2), 0) AS bin_2, coalesce(avg(survived) FILTER (bin = 3), 0) AS bin_3 FROM b GROUP BY sex, pclass", "bin_0 bin_1 bin_2 bin_3")(
    lambda v: v("passengers").withColumn("bin", F.expr(_BIN)).groupBy("sex", "pclass").pivot("bin", [0, 1, 2, 3]).agg(F.avg("survived")).select("sex", "pclass", *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"bin_{i}") for i in range(4)])
)
register("group_rate_baseline", "SELECT p.id, t.rate, CAST(t.rate >= 0.5 AS INT) AS predicted FROM {passengers} p JOIN (SELECT sex, avg(survived) AS rate FROM {passengers} GROUP BY sex) t ON p.sex = t.sex", "rate")(lambda v: v("passengers").join(relational.small(agg.rate_table(v("passengers"), ["sex"], "survived")), "sex").select("id", "rate", "predicted"))
register("group_median_fill", "SELECT p.id, coalesce(p.fare, m.m) AS fare FROM {passengers} p JOIN (SELECT pclass, median(fare) AS m FROM {passengers} GROUP BY pclass) m ON p.pclass = m.pclass", "fare")(lambda v: agg.group_median_fill(v("passengers"), "fare", "pclass").select("id", "fare"))
register("range_compare", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(min({c}) FILTER (id % 4 <> 0) AS DOUBLE) AS train_min, CAST(max({c}) FILTER (id % 4 <> 0) AS DOUBLE) AS train_max, CAST(min({c}) FILTER (id % 4 = 0) AS DOUBLE) AS test_min, CAST(max({c}) FILTER (id % 4 = 0) AS DOUBLE) AS test_max, min({c}) FILTER (id % 4 = 0) < min({c}) FILTER (id % 4 <> 0) OR max({c}) FILTER (id % 4 = 0) > max({c}) FILTER (id % 4 <> 0) AS wider, CAST(max({c}) FILTER (id % 4 = 0) - min({c}) FILTER (id % 4 = 0) AS DOUBLE) / (max({c}) FILTER (id % 4 <> 0) - min({c}) FILTER (id % 4 <> 0)) AS ratio FROM {{passengers}}" for c in ("fare", "age")), "train_min train_max test_min test_max ratio")(
    lambda v: agg.range_compare(v("passengers").where("id % 4 <> 0"), v("passengers").where("id % 4 = 0"), ["fare", "age"])
)
register("histogram", "WITH t AS (SELECT survived, least(CAST(floor(fare / 5.0) AS INT) + 1, 20) AS bin FROM {passengers} WHERE fare BETWEEN 0 AND 100) SELECT survived, bin, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY survived) AS share FROM t GROUP BY survived, bin", "share")(lambda v: agg.histogram(v("passengers"), "fare", 0, 100, 20, ["survived"]))
_AT = (0.1, 1, 5, 10, 20, 30, 50, 75)
register("percentiles", "SELECT pclass" + "".join(f", quantile_cont(fare, {x / 100}) AS p{str(x).replace('.', '_')}" for x in _AT) + " FROM {passengers} GROUP BY pclass", " ".join(f"p{str(x).replace('.', '_')}" for x in _AT))(lambda v: agg.percentiles(v("passengers"), "fare", _AT, ["pclass"]))
register("weighted_center", "SELECT sky_id, sum(x * (1 + abs(e1))) / sum(1 + abs(e1)) AS x_center, sum(y * (1 + abs(e1))) / sum(1 + abs(e1)) AS y_center FROM {skies} GROUP BY sky_id", "x_center y_center")(lambda v: agg.weighted_center(v("skies"), "sky_id", "x", "y", 1 + F.abs("e1")))
register("crosstab", "SELECT embarked, count(*) FILTER (pclass = 1) AS c1, count(*) FILTER (pclass = 2) AS c2, count(*) FILTER (pclass = 3) AS c3 FROM {passengers} GROUP BY embarked")(lambda v: v("passengers").groupBy("embarked").pivot("pclass", [1, 2, 3]).count().select("embarked", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"c{i}") for i in (1, 2, 3)]))
register("majority_value", "SELECT id, (SELECT embarked FROM {passengers} GROUP BY embarked ORDER BY count(*) DESC, embarked LIMIT 1) AS predicted FROM {passengers}")(lambda v: v("passengers").select("id").crossJoin(F.broadcast(prefix.most_frequent(v("passengers"), "embarked").select(F.col("mode").alias("predicted")))))

# Prefix sums

register("rank_as_quantile", "SELECT id, rank() OVER (ORDER BY score) - 1 AS below FROM {scores}")(lambda v: prefix.rank_as_quantile(v("scores"), "score", "below").select("id", "below"))
register("empirical_cdf", "SELECT id, cume_dist() OVER (ORDER BY score) AS cdf FROM {scores}", "cdf")(lambda v: prefix.empirical_cdf(v("scores"), "score", "cdf").select("id", "cdf"))
register("integerize", "SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS code FROM (SELECT DISTINCT brand FROM {transactions}) t")(lambda v: prefix.integerize([v("transactions"), v("offers")], "brand"))
register("reverse_map", "WITH m AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM {part}) t) SELECT p_partkey, m.code, m.p_type FROM {part} p JOIN m ON p.p_type = m.p_type")(
    lambda v: (lambda m: v("part").select("p_partkey", "p_type").join(relational.small(m), "p_type").select("p_partkey", "code").join(relational.small(m), "code"))(prefix.integerize([v("part")], "p_type"))
)
_LORENZ = "SELECT sum(l1 * r0 - l0 * r1) AS gini FROM (SELECT sum(w) OVER o / sum(w) OVER () AS r1, (sum(w) OVER o - w) / sum(w) OVER () AS r0, sum(a * w) OVER o / sum(a * w) OVER () AS l1, (sum(a * w) OVER o - a * w) / sum(a * w) OVER () AS l0 FROM (SELECT id, CAST(y AS DOUBLE) AS a, {p} AS p, weight AS w FROM {{scores}}) t WINDOW o AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)) u"
register("lorenz_gini", _LORENZ.format(p="score"), "gini", 6)(lambda v: prefix.lorenz_gini(v("scores"), "y", "score", "weight", ["id"]))
register("gini_normalized", f"SELECT ({_LORENZ.format(p='score')}) / ({_LORENZ.format(p='CAST(y AS DOUBLE)')}) AS gini", "gini", 6)(lambda v: prefix.gini_normalized(v("scores"), "y", "score", "weight", ["id"]))
_IMP = "SELECT p_type AS name, sum(p_retailprice) / (SELECT sum(p_retailprice) FROM {part}) AS value FROM {part} GROUP BY p_type"
register("cumulative_importance", f"SELECT name, value, sum(value) OVER (ORDER BY value DESC, name ROWS UNBOUNDED PRECEDING) AS cumulative FROM ({_IMP}) t", "value cumulative")(
    lambda v: prefix.cumulative(v("part").groupBy(F.col("p_type").alias("name")).agg(F.sum("p_retailprice").alias("s")).crossJoin(v("part").agg(F.sum("p_retailprice").alias("t"))).select("name", (F.col("s") / F.col("t")).alias("value")), "name", "value")
)
register("topk_features", f"SELECT * FROM (SELECT name, value, sum(value) OVER (ORDER BY value DESC, name ROWS UNBOUNDED PRECEDING) AS cumulative FROM ({_IMP}) t) u WHERE cumulative - value < 0.5", "value cumulative")(
    lambda v: prefix.top_features(v("part").groupBy(F.col("p_type").alias("name")).agg(F.sum("p_retailprice").alias("s")).crossJoin(v("part").agg(F.sum("p_retailprice").alias("t"))).select("name", (F.col("s") / F.col("t")).alias("value")), "name", "value", 0.5)
)
_RUN = "SELECT score, sum(sum(y)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - y)) OVER (ORDER BY score DESC) AS fp, sum(y) AS p, sum(1 - y) AS n FROM {scores} GROUP BY score"
register("roc_curve", f"SELECT score, tp / CAST((SELECT sum(y) FROM {{scores}}) AS DOUBLE) AS tpr, fp / CAST((SELECT sum(1 - y) FROM {{scores}}) AS DOUBLE) AS fpr FROM ({_RUN}) r", "score tpr fpr")(lambda v: prefix.roc_curve(v("scores"), "y", "score"))
register("metric_auc", f"SELECT sum(n * (tp - p / 2.0)) / ((SELECT sum(y) FROM {{scores}}) * (SELECT sum(1 - y) FROM {{scores}})) AS auc FROM ({_RUN}) r", "auc")(lambda v: prefix.auc(v("scores"), "y", "score"))
register("metric_average_precision", f"SELECT sum(p * tp / CAST(tp + fp AS DOUBLE)) / (SELECT sum(y) FROM {{scores}}) AS average_precision FROM ({_RUN}) r", "average_precision")(lambda v: prefix.average_precision(v("scores"), "y", "score"))
register("calibration_table", "SELECT bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS rate FROM (SELECT y, score, least(greatest(CAST(floor(score / 1000.0) AS INT) + 1, 1), 10) AS bin FROM {scores}) t GROUP BY bin", "mean_score rate")(lambda v: prefix.calibration_table(v("scores"), "y", "score", 0, 10000, 10))

# Top-k, set operations

register("topk_per_sky", "SELECT sky_id, galaxy, e1 FROM (SELECT s.*, row_number() OVER (PARTITION BY s.sky_id ORDER BY e1 DESC, galaxy) AS k, h.n_halos FROM {skies} s JOIN {halo_counts} h ON s.sky_id = h.sky_id) t WHERE k <= n_halos", "e1")(
    lambda v: relational.top_per_group(v("skies").join(v("halo_counts"), "sky_id"), "sky_id", [F.desc("e1"), F.col("galaxy")], F.col("n_halos")).select("sky_id", "galaxy", "e1")
)
register("topk_corr", "SELECT column_name, abs_r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, abs(corr({c}, target)) AS abs_r FROM {{loss}}" for c in ("var8", "var10", "var11", "var13", "var15")) + ") t ORDER BY abs_r DESC, column_name LIMIT 3", "abs_r", 6)(lambda v: metrics.top_corr(v("loss"), ["var8", "var10", "var11", "var13", "var15"], "target", 3))
register("sort_scores", "SELECT fold, mae FROM (SELECT id % 5 AS fold, avg(abs(y - weight / 3)) AS mae FROM {scores} GROUP BY ALL) t ORDER BY mae DESC", "mae")(lambda v: v("scores").groupBy((F.col("id") % 5).alias("fold")).agg(metrics.mae(F.col("y"), F.col("weight") / 3)).orderBy(F.desc("mae")))
register("every_nth", "SELECT id, market FROM {history} WHERE id % 10 = 0")(lambda v: relational.every_nth(v("history"), "id", 10).select("id", "market"))
register("union_by_name", "SELECT id, sex, survived FROM {passengers} WHERE id % 4 <> 0 UNION ALL SELECT id, sex, NULL FROM {passengers} WHERE id % 4 = 0")(lambda v: v("passengers").where("id % 4 <> 0").select("id", "sex", "survived").unionByName(v("passengers").where("id % 4 = 0").select("id", "sex"), allowMissingColumns=True))
register("union_all", "SELECT id, brand FROM {transactions} WHERE quantity < 0 UNION ALL SELECT offer, brand FROM {offers}")(lambda v: v("transactions").where("quantity < 0").select("id", "brand").union(v("offers").select("offer", "brand")))
register("distinct_combos", "SELECT DISTINCT category, company, brand FROM {offers}")(lambda v: v("offers").select("category", "company", "brand").distinct())
register("except_values", "SELECT company, brand FROM {transactions} EXCEPT SELECT company, brand FROM {offers}")(lambda v: v("transactions").select("company", "brand").subtract(v("offers").select("company", "brand")))
register("intersect_values", "SELECT company, brand FROM {transactions} INTERSECT SELECT company, brand FROM {offers}")(lambda v: v("transactions").select("company", "brand").intersect(v("offers").select("company", "brand")))
register("is_subset", "SELECT count(*) = 0 AS subset FROM (SELECT brand FROM {offers} EXCEPT SELECT brand FROM {transactions}) t")(lambda v: v("offers").select("brand").subtract(v("transactions").select("brand")).agg((F.count("*") == 0).alias("subset")))
register("product_of_uniques", "SELECT a.brand, b.category, count(t.id) AS n FROM (SELECT DISTINCT brand FROM {offers}) a CROSS JOIN (SELECT DISTINCT category FROM {offers}) b LEFT JOIN (SELECT offer AS id, brand, category FROM {offers}) t ON a.brand = t.brand AND b.category = t.category GROUP BY ALL")(lambda v: relational.product_of_uniques(v("offers"), ["brand", "category"]))
register("segment_split", "SELECT sex, pclass, count(*) AS n, avg(survived) AS rate FROM {passengers} GROUP BY sex, pclass", "rate")(lambda v: v("passengers").groupBy("sex", "pclass").agg(F.count("*").alias("n"), F.avg("survived").alias("rate")))

# Preparation and splits

_NUM = ["var8", "var11", "var13", "var15"]
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ROWKEY = _KEY.split(", ")
register("fill_missing", f"SELECT {_KEY}, CAST(var8 AS DOUBLE) AS var8, coalesce(var15, (SELECT median(var15) FROM {{loss}})) AS var15 FROM {{loss}}", "var15")(lambda v: prep.fill_missing(v("loss"), ["var8", "var15"], "median").select(*_ROWKEY, "var8", "var15"))
register("fill_from_constants", f"SELECT {_KEY}, coalesce(var15, (SELECT avg(var15) FROM {{loss}} WHERE l_partkey % 4 <> 0)) AS var15 FROM {{loss}} WHERE l_partkey % 4 = 0", "var15")(lambda v: prep.fill_from(v("loss").where("l_partkey % 4 = 0"), prep.fit_fill(v("loss").where("l_partkey % 4 <> 0"), ["var15"])).select(*_ROWKEY, "var15"))
register("impute_mean_strategy", "WITH tr AS (SELECT * FROM {passengers} WHERE id % 4 <> 0) SELECT id, coalesce(CAST(fare AS DOUBLE), (SELECT avg(fare) FROM tr)) AS fare, coalesce(CAST(age AS DOUBLE), (SELECT age FROM tr WHERE age IS NOT NULL GROUP BY age ORDER BY count(*) DESC, age LIMIT 1)) AS age FROM {passengers} WHERE id % 4 = 0", "fare age")(
    lambda v: (lambda tr, te: prep.fill_from(prep.fill_from(te, prep.fit_fill(tr, ["fare"])), prep.fit_fill(tr, ["age"], "most_frequent")).select("id", "fare", "age"))(v("passengers").where("id % 4 <> 0"), v("passengers").where("id % 4 = 0"))
)
register("scale_standard", f"SELECT {_KEY}, (var11 - (SELECT avg(var11) FROM {{loss}})) / (SELECT stddev_pop(var11) FROM {{loss}}) AS var11, (var13 - (SELECT avg(var13) FROM {{loss}})) / (SELECT stddev_pop(var13) FROM {{loss}}) AS var13 FROM {{loss}}", "var11 var13")(lambda v: prep.scale_standard(v("loss"), ["var11", "var13"]).select(*_ROWKEY, "var11", "var13"))
register("scale_minmax", f"SELECT {_KEY}, (var11 - (SELECT min(var11) FROM {{loss}})) / (SELECT max(var11) - min(var11) FROM {{loss}}) AS var11, 0.0 AS one FROM {{loss}}", "var11 one")(lambda v: prep.scale_minmax(v("loss").withColumn("one", F.lit(7.0)), ["var11", "one"]).select(*_ROWKEY, "var11", "one"))
register("scale_l2_row", f"SELECT {_KEY}, var11 / sqrt(var10 * var10 + var11 * var11) AS var11, var10 / sqrt(var10 * var10 + var11 * var11) AS var10 FROM {{loss}}", "var11 var10")(lambda v: prep.scale_l2_row(v("loss"), ["var11", "var10"]).select(*_ROWKEY, "var11", "var10"))
register("one_hot", "SELECT id, CAST(pclass = 1 AS INT) AS pclass_1, CAST(pclass = 2 AS INT) AS pclass_2, CAST(pclass = 3 AS INT) AS pclass_3 FROM {passengers}")(lambda v: prep.one_hot(v("passengers"), "pclass", [1, 2, 3]).select("id", "pclass_1", "pclass_2", "pclass_3"))
register("select_f_test", " UNION ALL ".join(f"SELECT '{c}' AS column_name, pow(corr({c}, target), 2) / (1 - pow(corr({c}, target), 2)) * (count(target) - 2) AS f FROM {{loss}}" for c in ("var8", "var10", "var11", "var13")), "f", 3)(lambda v: prep.f_test(v("loss"), ["var8", "var10", "var11", "var13"], "target"))
register("load_code_impute", f"SELECT {_KEY}, var11 AS weight, target, CAST(target > 0 AS INT) AS y, coalesce(CASE nullif(var4, 'Z') WHEN 'STANDARD' THEN 1.0 WHEN 'SMALL' THEN 2.0 WHEN 'MEDIUM' THEN 3.0 ELSE 0.0 END, 0.0) AS var4, coalesce(var15, (SELECT avg(var15) FROM {{loss}})) AS var15 FROM {{loss}}", "weight target var4 var15")(
    lambda v: prep.fill_from(relational.code_by_dict(relational.replace_sentinel(v("loss"), ["var4"], "Z"), "var4", {"STANDARD": 1.0, "SMALL": 2.0, "MEDIUM": 3.0}, "var4", 0.0), prep.fit_fill(v("loss"), ["var15"])).select(*_ROWKEY, F.col("var11").alias("weight"), "target", (F.col("target") > 0).cast("int").alias("y"), "var4", "var15")
)
register("load_loan_table", "SELECT id, CAST(pclass AS DOUBLE) AS pclass, CAST(survived AS INT) - pclass AS diff, CAST(sex = 'male' AS INT) AS sex_male, CAST(sex = 'female' AS INT) AS sex_female FROM {passengers}", "pclass")(
    lambda v: prep.one_hot(v("passengers").drop("fare", "age"), "sex", ["male", "female"]).select("id", F.col("pclass").cast("double").alias("pclass"), (F.col("survived") - F.col("pclass")).alias("diff"), "sex_male", "sex_female")
)
_H = "(id * 2654435761 + {s}) % 4294967296"
register("split_stratified", f"SELECT id, survived, row_number() OVER (PARTITION BY survived ORDER BY {_H.format(s=7)}, id) <= round(count(*) OVER (PARTITION BY survived) * 0.25) AS is_train FROM {{passengers}}")(lambda v: prep.split_stratified(v("passengers"), "survived", "id", 0.25, 7).select("id", "survived", "is_train"))
register("cv_stratified_shuffle", " UNION ALL ".join(f"SELECT id, {s} AS split, row_number() OVER (PARTITION BY survived ORDER BY {_H.format(s=s)}, id) <= round(count(*) OVER (PARTITION BY survived) * 0.5) AS is_train FROM {{passengers}}" for s in (1, 2, 3)))(lambda v: prep.cv_stratified_shuffle(v("passengers"), "survived", "id", 0.5, [1, 2, 3]).select("id", "split", "is_train"))
register("cv_kfold", f"SELECT id, CAST({_H.format(s=3)} % 5 AS INT) AS fold FROM {{passengers}}")(lambda v: prep.cv_kfold(v("passengers"), "id", 5, 3).select("id", "fold"))
register("cv_stratified_kfold", f"SELECT id, CAST((row_number() OVER (PARTITION BY survived ORDER BY {_H.format(s=0)}, id) - 1) % 4 AS INT) AS fold FROM {{passengers}}")(lambda v: prep.cv_stratified_kfold(v("passengers"), "survived", "id", 4).select("id", "fold"))
register("cv_by_group", "SELECT id, fold, CASE fold WHEN 0 THEN embarked IN ('A', 'B') ELSE embarked IN ('F') END AS is_train FROM {passengers} CROSS JOIN (SELECT unnest([0, 1]) AS fold) f")(lambda v: prep.cv_by_group(v("passengers"), "embarked", [["A", "B"], ["F"]]).select("id", "fold", "is_train"))
register("sample_fraction", f"SELECT id, market FROM {{history}} WHERE {_H.format(s=0)} < 0.2 * 4294967296")(lambda v: prep.sample_fraction(v("history"), "id", 0.2).select("id", "market"))
register("split_train_val_sample", f"SELECT id, angle, CASE WHEN row_number() OVER (PARTITION BY survived, angle ORDER BY {_H.format(s=0)}, id) <= round(count(*) OVER (PARTITION BY survived, angle) * 0.8) THEN 'train' ELSE 'val' END AS part, id % 10 = 0 AS is_sample FROM {{passengers}} CROSS JOIN (SELECT unnest([0, 90, 180, 270]) AS angle) a")(
    lambda v: prep.split_copies(v("passengers").withColumn("angle", F.explode(F.array(*map(F.lit, (0, 90, 180, 270))))), "id", "survived", 0.8).select("id", "angle", F.when(F.col("is_train"), "train").otherwise("val").alias("part"), (F.pmod("id", F.lit(10)) == 0).alias("is_sample"))
)

# Metrics

_SCORED = "(SELECT id, y, toxic AS p, id % 3 AS split, score / 10000 AS s, weight FROM {scores}) t"


def _scored(v):
    return v("scores").select("id", "y", F.col("toxic").alias("p"), (F.col("id") % 3).alias("split"), (F.col("score") / 10000).alias("s"), "weight")


for _name, _column, _sql in (
    ("accuracy", lambda: metrics.accuracy("y", "p"), "avg(CAST(y = p AS DOUBLE))"),
    ("precision", lambda: metrics.precision("y", "p"), "count(*) FILTER (y = 1 AND p = 1) / nullif(CAST(count(*) FILTER (p = 1) AS DOUBLE), 0)"),
    ("recall", lambda: metrics.recall("y", "p"), "count(*) FILTER (y = 1 AND p = 1) / nullif(CAST(count(*) FILTER (y = 1) AS DOUBLE), 0)"),
    ("f1", lambda: metrics.f1("y", "p"), "2 * count(*) FILTER (y = 1 AND p = 1) / nullif(CAST(count(*) FILTER (y = 1) + count(*) FILTER (p = 1) AS DOUBLE), 0)"),
    ("hinge", lambda: metrics.hinge("y", F.col("s")), "avg(greatest(0, 1 - (2 * y - 1) * s))"),
    ("mae", lambda: metrics.mae(F.col("y"), F.col("s")), "avg(abs(y - s))"),
    ("r_squared", lambda: metrics.r_squared("y", "s"), "pow(corr(y, s), 2)"),
):
    register(f"metric_{_name}", f"SELECT {_sql} AS {_name} FROM {_SCORED}", _name)(lambda v, c=_column: _scored(v).agg(c()))
register("metric_zero_one_by_class", f"SELECT avg(a) AS accuracy, avg(z) AS on_zeros, avg(o) AS on_ones FROM (SELECT split, avg(CAST(y = p AS DOUBLE)) AS a, avg(CAST(y = p AS DOUBLE)) FILTER (y = 0) AS z, avg(CAST(y = p AS DOUBLE)) FILTER (y = 1) AS o FROM {_SCORED} GROUP BY split) u", "accuracy on_zeros on_ones")(lambda v: metrics.zero_one_by_class(_scored(v), "split", "y", "p"))
_PROBS = "SELECT vec_id, label, p, exp(e) / sum(exp(e)) OVER (PARTITION BY vec_id) AS q FROM {cells} WHERE p < 10"


def _probs(v):
    return v("embeddings").select("vec_id", "label", metrics.softmax(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))).alias("q"))


register("metric_multiclass_logloss", f"SELECT avg(-ln(least(greatest(q, 1e-15), 1 - 1e-15))) AS logloss FROM ({_PROBS}) t WHERE p = label", "logloss")(lambda v: _probs(v).agg(metrics.multiclass_logloss("label", "q")))
register("metric_nll", f"SELECT avg(-ln(q)) AS nll FROM ({_PROBS}) t WHERE p = label", "nll")(lambda v: _probs(v).agg(metrics.nll("label", "q")))
register("argmax_class", f"SELECT vec_id, CAST(arg_max(p, (q, -p)) AS INT) AS predicted FROM ({_PROBS}) t GROUP BY vec_id")(lambda v: relational.argmax_class(_probs(v).select("vec_id", *[F.col("q")[i].alias(f"q{i}") for i in range(10)]), [f"q{i}" for i in range(10)], "predicted").select("vec_id", "predicted"))
register("mean_over_variants", f"SELECT vec_id // 5 AS item, p, avg(q) AS q FROM ({_PROBS}) t GROUP BY ALL", "q")(lambda v: _probs(v).select(F.floor(F.col("vec_id") / 5).alias("item"), F.posexplode("q").alias("p", "q")).groupBy("item", "p").agg(F.avg("q").alias("q")))
register("confusion_matrix", f"SELECT y AS actual, p AS predicted, count(*) AS n FROM {_SCORED} GROUP BY ALL")(lambda v: metrics.confusion_matrix(_scored(v), "y", "p"))
register("classification_report", " UNION ALL ".join(f"SELECT {k} AS class, count(*) FILTER (y = {k} AND p = {k}) / nullif(CAST(count(*) FILTER (p = {k}) AS DOUBLE), 0) AS precision, count(*) FILTER (y = {k} AND p = {k}) / CAST(count(*) FILTER (y = {k}) AS DOUBLE) AS recall, 2 * count(*) FILTER (y = {k} AND p = {k}) / CAST(count(*) FILTER (y = {k}) + count(*) FILTER (p = {k}) AS DOUBLE) AS f1, count(*) FILTER (y = {k}) AS support FROM {_SCORED}" for k in (0, 1)), "precision recall f1")(lambda v: metrics.classification_report(_scored(v), "y", "p"))
_CT = ("var8", "var10", "var11", "var13", "var15")


_CORRELATED = " UNION ALL ".join(f"SELECT '{c}' AS column_name, corr({c}, target) AS r, count(*) FILTER ({c} IS NOT NULL AND target IS NOT NULL) AS n FROM {{loss}}" for c in _CT)


def _p(by: str) -> str:
    """Expressions p: by, p, of a table c with r and n: under no correlation asin(r) has a density in proportion to cos(angle) to the power
    n - 3, and p is its share beyond |asin(r)|, by Simpson's rule."""
    part = lambda low: f"sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp((n - 3) * ln(cos({low} + (top - {low}) * i / 2000)))) * (max(top) - max({low}))"
    return f"q AS (SELECT *, 0.0 AS zero, asin(abs(r)) AS low, greatest(asin(abs(r)), least(pi() / 2, 14 / sqrt(n - 2.0))) AS top FROM c), p AS (SELECT {by}, {part('low')} / ({part('zero')}) AS p FROM q CROSS JOIN (SELECT unnest(range(2001)) AS i) g GROUP BY {by})"


register("corr_with_target", f"WITH c AS ({_CORRELATED}), {_p('column_name')} SELECT c.column_name, abs(r) AS abs_r, n, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, p FROM c JOIN p ON c.column_name = p.column_name", "abs_r t p")(lambda v: metrics.corr_with_target(v("loss"), _CT, "target"))
_CC = ["var8", "var10", "var11", "var13"]
_PAIRS = [(a, b) for i, a in enumerate(_CC) for b in _CC[i + 1 :]]
register("corr_matrix", f"WITH c AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM {{loss}}" for a, b in _PAIRS)}), {_p('a, b')} SELECT c.*, p FROM c JOIN p ON c.a = p.a AND c.b = p.b", "r p")(lambda v: metrics.corr_matrix(v("loss"), _CC))
register("attribute_distance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, 1 - abs(corr({a}, {b})) AS distance FROM {{loss}}" for a, b in _PAIRS), "distance")(lambda v: metrics.attribute_distance(v("loss"), _CC))
register("attribute_statistics", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM {{loss}}" for c in _NUM), "mean sd min max")(lambda v: metrics.attribute_statistics(v("loss"), _NUM))
register("cv_summary", f"SELECT avg(m) AS mean, stddev_pop(m) AS sd, stddev_pop(m) / avg(m) AS ratio FROM (SELECT split, avg(abs(y - s)) AS m FROM {_SCORED} GROUP BY split) u", "mean sd ratio", 6)(lambda v: metrics.cv_summary(_scored(v), "split", "y", "s"))

# Images and skies

register("image_moments", "WITH m AS (SELECT image_id, sum(w) AS m00, sum(w * c) AS m10, sum(w * r) AS m01, sum(w * c * r) AS m11, sum(w * c * c) AS m20, sum(w * r * r) AS m02 FROM (SELECT image_id, r, c, CASE WHEN v < 255 THEN 255 - v ELSE 0 END AS w FROM {pixels}) p GROUP BY image_id), k AS (SELECT *, m10 / nullif(m00, 0) AS x_center, m01 / nullif(m00, 0) AS y_center FROM m) SELECT *, 0.5 * atan2(2 * (m11 / m00 - x_center * y_center), m20 / m00 - x_center * x_center - (m02 / m00 - y_center * y_center)) AS angle FROM k", "m00 m10 m01 m11 m20 m02 x_center y_center angle")(lambda v: spatial.image_moments(v("pixels")))
register("image_trim", "WITH b AS (SELECT image_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM {pixels} WHERE v < 255 GROUP BY image_id) SELECT p.image_id, r - r0 AS r, c - c0 AS c, v FROM {pixels} p JOIN b ON p.image_id = b.image_id WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1", "v")(lambda v: spatial.image_trim(v("pixels")))
register("image_pixel_stats", "WITH m AS (SELECT *, avg(v) OVER (PARTITION BY image_id) AS mean FROM {pixels}) SELECT image_id, count(*) AS area, avg(CAST(v < 255 AS DOUBLE)) AS filled, avg(v) FILTER (v < 255) AS mean_filled, avg(CAST(v < mean AS DOUBLE)) AS below_mean" + "".join(f", quantile_cont(v, {x / 100}) AS p{x}" for x in (5, 25, 50, 75, 95)) + " FROM m GROUP BY image_id", "filled mean_filled below_mean p5 p25 p50 p75 p95")(lambda v: spatial.image_pixel_stats(v("pixels")))
_TAN = "-(e1 * cos(2 * atan2(y - cy, x - cx)) + e2 * sin(2 * atan2(y - cy, x - cx)))"
_SIGNAL = f"SELECT g.sky_id, g.i, g.j, coalesce(s.signal, 0) AS signal FROM (SELECT DISTINCT sky_id, i, j FROM {{skies}} CROSS JOIN (SELECT CAST(unnest(range(15)) AS INT) AS i) a CROSS JOIN (SELECT CAST(unnest(range(15)) AS INT) AS j) b) g LEFT JOIN (SELECT sky_id, i, j, avg({_TAN}) AS signal FROM (SELECT *, CAST(floor(x / 280) AS INT) AS i, CAST(floor(y / 280) AS INT) AS j, (floor(x / 280) + 0.5) * 280 AS cx, (floor(y / 280) + 0.5) * 280 AS cy FROM {{skies}}) q GROUP BY sky_id, i, j) s ON g.sky_id = s.sky_id AND g.i = s.i AND g.j = s.j"
register("grid_tangential_signal", _SIGNAL, "signal")(lambda v: spatial.grid_signal(v("skies")))
register("topk_cells_per_sky", f"SELECT sky_id, i, j, i * 280.0 AS x, j * 280.0 AS y FROM (SELECT t.*, n_halos, row_number() OVER (PARTITION BY t.sky_id ORDER BY round(signal, 9) DESC, i, j) AS k FROM ({_SIGNAL}) t JOIN {{halo_counts}} h ON t.sky_id = h.sky_id) u WHERE k <= n_halos", "x y")(
    lambda v: relational.top_per_group(spatial.grid_signal(v("skies")).join(v("halo_counts"), "sky_id"), "sky_id", [F.round("signal", 9).desc(), F.col("i"), F.col("j")], F.col("n_halos")).select("sky_id", "i", "j", (F.col("i") * 280.0).alias("x"), (F.col("j") * 280.0).alias("y"))
)
_POINTS = "(SELECT *, (i + 0.5) * {w} AS gx, (j + 0.5) * {w} AS gy FROM {{skies}} CROSS JOIN (SELECT CAST(unnest(range({n})) AS INT) AS i) a CROSS JOIN (SELECT CAST(unnest(range({n})) AS INT) AS j) b) q"
_LIKE = "SELECT sky_id, i, j, exp(-0.5 * sum(pow(e1 + cos(2 * a) / r, 2) + pow(e2 + sin(2 * a) / r, 2))) AS likelihood FROM (SELECT sky_id, i, j, e1, e2, greatest(sqrt(pow(x - gx, 2) + pow(y - gy, 2)), 1) AS r, atan2(y - gy, x - gx) AS a FROM " + _POINTS.format(w=420, n=10) + ") z GROUP BY sky_id, i, j"
register("grid_likelihood", _LIKE, "likelihood", 6)(lambda v: spatial.grid_likelihood(v("skies")))
register("argmax_likelihood", f"SELECT sky_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY sky_id ORDER BY round(likelihood, 12) DESC, i, j) AS k FROM ({_LIKE}) l) m WHERE k = 1")(lambda v: spatial.argmax_likelihood(v("skies")))
_KERNEL = "SELECT sky_id, i, j, sum(w * e1) / sum(w) AS e1_mean, sum(w * e2) / sum(w) AS e2_mean, sum(w * e1 * e1) / sum(w) - pow(sum(w * e1) / sum(w), 2) AS e1_var, sum(w * e2 * e2) / sum(w) - pow(sum(w * e2) / sum(w), 2) AS e2_var, sum(w * e1 * e2) / sum(w) - sum(w * e1) / sum(w) * sum(w * e2) / sum(w) AS e_cov FROM (SELECT *, exp(-(pow(x - gx, 2) + pow(y - gy, 2)) / 2e6) AS w FROM " + _POINTS.format(w=30, n=140) + ") z GROUP BY sky_id, i, j"
register("grid_kernel_maps", _KERNEL, "e1_mean e2_mean e1_var e2_var e_cov")(lambda v: spatial.grid_kernel_maps(v("skies"), 140))
_EXTREMES = ["e1_mean", "e2_mean", "e1_var", "e2_var", "var_sum", "var_gap", "e_cov"]
_ROUNDED = "SELECT sky_id, i, j, " + ", ".join(f"round({ {'var_sum': 'e1_var + e2_var', 'var_gap': 'abs(e1_var - e2_var)'}.get(c, c)}, 9) AS {c}" for c in _EXTREMES) + f" FROM ({_KERNEL}) k"
_ENDS = [(c, t) for c in _EXTREMES for t in ("max", "min")]
register("argmax_argmin_maps", f"WITH r AS MATERIALIZED ({_ROUNDED}), m AS (SELECT sky_id, " + ", ".join(f"{t}({c}) AS {c}_{t}" for c, t in _ENDS) + " FROM r GROUP BY sky_id) SELECT m.sky_id" + "".join(f", any_value(m.{c}_{t}) AS {c}_{t}, min(i * 1000 + j) FILTER (r.{c} = m.{c}_{t}) // 1000 AS {c}_{t}_i, min(i * 1000 + j) FILTER (r.{c} = m.{c}_{t}) % 1000 AS {c}_{t}_j" for c, t in _ENDS) + " FROM m JOIN r ON r.sky_id = m.sky_id GROUP BY m.sky_id", " ".join(f"{c}_{t}" for c, t in _ENDS))(
    lambda v: spatial.argmax_argmin(v("skies"), _EXTREMES, 140)
)
register("join_grid_cross", "SELECT sky_id, i, j, count(*) AS n, sum(sqrt(pow(x - gx, 2) + pow(y - gy, 2))) AS far FROM " + _POINTS.format(w=840, n=5) + " GROUP BY sky_id, i, j", "far", 2)(lambda v: spatial.grid_distances(v("skies"), 5))
register("pad_center_flatten", "WITH c AS (SELECT sky_id, galaxy, x - avg(x) OVER (PARTITION BY sky_id) AS x, e1 - avg(e1) OVER (PARTITION BY sky_id) AS e1 FROM {skies}) SELECT sky_id, count(*) AS n, array_to_string([round(z, 3) + 0.0 FOR z IN list(x ORDER BY galaxy)], ',') AS xs, list_sum(list(e1 ORDER BY galaxy)[1:5]) AS head FROM c GROUP BY sky_id", "head")(
    lambda v: spatial.pad_flatten(v("skies"), "sky_id", "galaxy", ["x", "e1"], 740).select("sky_id", "n", F.array_join(F.transform(F.slice("flat", F.lit(1), F.col("n").cast("int")), lambda z: (scalars.round_binary(z, 3) + 0.0).cast("string")), ",").alias("xs"), F.aggregate(F.slice("flat", 741, 5), F.lit(0.0), lambda a, x: a + x).alias("head"))
)
register("append_features", "SELECT vec_id, 66 AS width, sum(e) + min(e) + max(e) AS total FROM {cells} GROUP BY vec_id", "total")(
    lambda v: spatial.append_features(v("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("flat")), v("cells").groupBy("vec_id").agg(F.min("e").alias("lo"), F.max("e").alias("hi")), "vec_id", "flat", ["lo", "hi"]).select("vec_id", F.size("flat").alias("width"), F.aggregate("flat", F.lit(0.0), lambda a, x: a + x).alias("total"))
)
_HALO = "(SELECT sky_id, i, (sky_id * 53 * (i + 1)) % 4200 AS tx, (sky_id * 71 * (i + 1)) % 4200 AS ty, (sky_id * 97 * (i + 2)) % 4200 AS px, (sky_id * 89 * (i + 2)) % 4200 AS py, 1 + sky_id % 3 AS n FROM (SELECT DISTINCT sky_id FROM {skies}) s CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) k WHERE i <= sky_id % 3)"
_PERM = "(SELECT unnest([1, 2, 2, 3, 3, 3, 3, 3, 3]) AS n, unnest([[0], [0, 1], [1, 0], [0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]) AS o)"


def _points(a: int, b: int, k: int):
    at = lambda n, m: ((F.col("sky_id") * m * (n + k)) % 4200).cast("double")
    return F.transform(F.sequence(F.lit(1), F.col("n_halos").cast("int")), lambda n: F.struct(at(n, a).alias("x"), at(n, b).alias("y")))


register("metric_halo_match", f"WITH h AS {_HALO}, m AS (SELECT a.sky_id, p.o, sum(sqrt(pow(a.tx - b.px, 2) + pow(a.ty - b.py, 2))) AS d FROM h a JOIN {_PERM} p ON a.n = p.n JOIN h b ON b.sky_id = a.sky_id AND b.i = p.o[a.i + 1] GROUP BY a.sky_id, p.o), best AS (SELECT sky_id, o FROM (SELECT *, row_number() OVER (PARTITION BY sky_id ORDER BY d, o) AS k FROM m) z WHERE k = 1), f AS (SELECT sqrt(pow(a.tx - b.px, 2) + pow(a.ty - b.py, 2)) AS far, atan2(b.py - a.ty, b.px - a.tx) - atan2(2100.5 - a.ty, 2100.5 - a.tx) AS phi FROM h a JOIN best ON a.sky_id = best.sky_id JOIN h b ON b.sky_id = a.sky_id AND b.i = best.o[a.i + 1]) SELECT avg(far) AS mean_distance, sqrt(pow(avg(cos(phi)), 2) + pow(avg(sin(phi)), 2)) AS direction, avg(far) / 1000 + sqrt(pow(avg(cos(phi)), 2) + pow(avg(sin(phi)), 2)) AS score FROM f", "mean_distance direction score")(
    lambda v: metrics.halo_match(v("halo_counts").select("sky_id", F.lit(2100.5).alias("x_ref"), F.lit(2100.5).alias("y_ref"), _points(53, 71, 0).alias("truth"), _points(97, 89, 1).alias("guess")))
)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

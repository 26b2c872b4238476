"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import money
from tessera.operators import pairs, series, shop
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("bigint").alias("series"), F.col("event_id").cast("bigint").alias("pos"), F.col("value").cast("double").alias("x"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("series"), F.col("p_partkey").cast("bigint").alias("pos"), F.col("p_size").cast("double").alias("x"))


def _products(spark: SparkSession, d: str, factor: int = 1) -> DataFrame:
    stock = (F.greatest(F.col("p_size") - 10, F.lit(0)) * factor).cast("int")
    return table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("sku"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("double").alias("price"), stock.alias("stock"), F.col("p_partkey").cast("bigint").alias("seq"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("cart_id"), F.col("l_linenumber").cast("int").alias("line_no"), F.col("l_partkey").cast("bigint").alias("sku"), F.col("l_quantity").cast("int").alias("qty"))


def _carts(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("o_orderpriority").startswith("1"), "SAVE10").when(F.col("o_orderpriority").startswith("2"), "FLAT50")
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("cart_id"), F.lit(0.0).alias("discount_pct"), code.alias("coupon"))


_TRIMMED = """
with raw as (select user_id as series, event_id as pos, value::double as x from events),
st as (select series, count(*) n, avg(x) m, stddev_pop(x) s, bool_and(x is not null) valid, bool_and(x between -1000 and 1000) inside from raw group by series),
kept as (select raw.* from raw join st using (series) where valid and inside and (n < 2 or s = 0 or abs((x - m) / nullif(s, 0)) <= 2.0)),
numbered as (select *, row_number() over (partition by series order by x) - 1 as i, count(*) over (partition by series) as k from kept),
feat as (select series, count(*)::bigint as cnt, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as std_dev, min(x) as lo, max(x) as hi,
  max(case when i = least(floor(k * 25 / 100), k - 1) then x end) as p25, max(case when i = least(floor(k * 50 / 100), k - 1) then x end) as p50,
  max(case when i = least(floor(k * 75 / 100), k - 1) then x end) as p75, avg(x) as raw_mean from numbered group by series)
"""


@query(_TRIMMED + """select series, n::bigint as input_size, coalesce(cnt, 0)::bigint as preprocessed_size, mean, std_dev, lo as min_value, hi as max_value, p25, p50, p75,
 n::bigint as transformed_size, case when coalesce(raw_mean, 0) > coalesce(p50, 0) then 'positive' else 'negative' end as skewness, round(m, 6) as average,
 case when coalesce(cnt, 0) > 0 then 'success' else 'empty_result' end as status from st left join feat using (series)""")
def series_report(spark: SparkSession, d: str) -> DataFrame:
    r, f = F.col("report"), F.col("report.features")
    return series.report(_events(spark, d)).select(
        "series", r["input_size"].alias("input_size"), r["preprocessed_size"].alias("preprocessed_size"), F.round(f["mean"], 4).alias("mean"), F.round(f["std_dev"], 4).alias("std_dev"), f["min"].alias("min_value"), f["max"].alias("max_value"),
        f["p25"].alias("p25"), f["p50"].alias("p50"), f["p75"].alias("p75"), r["transformed_size"].alias("transformed_size"), r["distribution_analysis"]["skewness"].alias("skewness"), F.round(r["average"], 6).alias("average"), r["status"].alias("status"),
    )


@query(_TRIMMED + "select series, mean, std_dev, lo as min_value, hi as max_value, cnt as n, p25, p50, p75 from feat")
def series_features(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("features")
    return series.features(_events(spark, d)).select("series", F.round(f["mean"], 4).alias("mean"), F.round(f["std_dev"], 4).alias("std_dev"), f["min"].alias("min_value"), f["max"].alias("max_value"), f["count"].alias("n"), f["p25"].alias("p25"), f["p50"].alias("p50"), f["p75"].alias("p75"))


@query(_TRIMMED + "select series, n::bigint as transformed_count, case when coalesce(raw_mean, 0) > coalesce(p50, 0) then 'positive' else 'negative' end as skewness from st left join feat using (series)")
def series_analysis(spark: SparkSession, d: str) -> DataFrame:
    return series.analysis(_events(spark, d)).select("series", "transformed_count", "skewness")


@query("select user_id as series, count(value)::bigint as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std_dev, min(value)::double as lowest, max(value)::double as highest from events group by 1")
def series_stats(spark: SparkSession, d: str) -> DataFrame:
    return series.stats(_events(spark, d)).select("series", "n", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"), "lowest", "highest")


@query(_TRIMMED + "select series, pos, x from kept")
def series_trim(spark: SparkSession, d: str) -> DataFrame:
    return series.preprocess(_events(spark, d))[0]


@query("""with r as (select user_id as series, value::double as x, row_number() over (partition by user_id order by value) - 1 as i, count(*) over (partition by user_id) as n from events)
select series, max(case when i = least(floor(n * 0 / 100), n - 1) then x end) as p0, max(case when i = least(floor(n * 10 / 100), n - 1) then x end) as p10,
max(case when i = least(floor(n * 50 / 100), n - 1) then x end) as p50, max(case when i = least(floor(n * 90 / 100), n - 1) then x end) as p90, max(case when i = least(floor(n * 150 / 100), n - 1) then x end) as p150 from r group by series""")
def series_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return series.percentiles(_events(spark, d), [0, 10, 50, 90, 150])


@query("""select p_brand as series, p_partkey as pos, round(case when lo = hi then 0.5 else (p_size - lo)::double / (hi - lo) end, 6) as x
from part join (select p_brand, min(p_size) lo, max(p_size) hi from part group by 1) using (p_brand)""")
def series_normalize(spark: SparkSession, d: str) -> DataFrame:
    return series.transform(_sizes(spark, d), "normalize").select("series", "pos", F.round("x", 6).alias("x"))


@query("""select p_brand as series, p_partkey as pos, round(case when lo = hi then 0.5 else (p_size - lo)::double / (hi - lo) end * 100, 6) as x
from part join (select p_brand, min(p_size) lo, max(p_size) hi from part group by 1) using (p_brand)""")
def series_scale(spark: SparkSession, d: str) -> DataFrame:
    return series.scale(_sizes(spark, d)).select("series", "pos", F.round("x", 6).alias("x"))


@query("""select c_mktsegment || '/' || c_nationkey as series, case when not bool_and(c_acctbal between -1000 and 9900) then 'Bounds check failed' end as error from customer group by 1""")
def bounds_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("series"), F.col("c_custkey").alias("pos"), F.col("c_acctbal").cast("double").alias("x"))
    return series.preprocess(rows, low=-1000, high=9900)[1]


@query("""with raw as (select user_id as series, event_id as pos, case when event_id % 61 <> 0 then value::double end as x from events),
st as (select series, bool_and(x is not null) as valid, avg(x) m, stddev_pop(x) s, count(*) n, min(x) lo, max(x) hi from raw group by 1),
t as (select series, count(*) as kept from raw join st using (series) where n < 2 or s = 0 or abs((x - m) / nullif(s, 0)) <= 2.0 group by 1)
select series, case when not valid then 'Invalid input data' end as trim_error, case when valid then kept else 0 end::bigint as kept,
case when not valid then 'Invalid input for normalization' end as normal_error, case when not valid then 'Input validation failed in transformation' end as transform_error,
case when not valid then 'Input validation failed' end as analysis_error, case when valid then n end::bigint as transformed_count from st left join t using (series)""")
def series_refused(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("x", F.when(F.col("pos") % 61 != 0, F.col("x")))
    told = lambda df, name: df.groupBy("series").agg(F.max("error").alias(name), F.count("pos").alias("kept"))
    out = told(series.trim(rows), "trim_error")
    for df, name in ((series.normalize(rows), "normal_error"), (series.transform(rows, "other"), "transform_error")):
        out = out.join(told(df, name).drop("kept"), "series")
    return out.join(series.analysis(rows).select("series", F.col("error").alias("analysis_error"), "transformed_count"), "series")


@query("""with p as (select a.p_brand as series, a.p_partkey as i, b.p_partkey as j, row_number() over (partition by a.p_brand order by b.p_partkey, a.p_partkey desc) as r
from part a join part b on a.p_brand = b.p_brand and a.p_size = 50 - b.p_size and a.p_partkey < b.p_partkey)
select brands.series, coalesce(i, -1)::bigint as i, coalesce(j, -1)::bigint as j from (select distinct p_brand as series from part) brands left join (select * from p where r = 1) f using (series)""")
def two_sum(spark: SparkSession, d: str) -> DataFrame:
    pair = pairs.two_sum(_sizes(spark, d), 50.0)
    return pair.select("series", F.coalesce(F.get("pair", F.lit(0)), F.lit(-1)).cast("bigint").alias("i"), F.coalesce(F.get("pair", F.lit(1)), F.lit(-1)).cast("bigint").alias("j"))


@query("""with b as (select event_id, value * 2 as amount, case event_id % 3 when 0 then 'SAVE10' when 1 then 'FLAT50' end as code, (event_id % 5)::double as pct from events where event_type = 'purchase'),
c as (select event_id, case when code = 'SAVE10' then dd - dd * 10 / 100 when code = 'FLAT50' then greatest(dd - 50, 0.0) else dd end as a from (select *, amount - amount * pct / 100 as dd from b)),
t as (select event_id, a, printf('%.2f', a * 0.18)::double as tax, case when a >= 500 then 0.0 else 40.0 end as shipping from c)
select event_id, tax, shipping::double as shipping, printf('%.2f', a + tax + shipping)::double as total from t""")
def price_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("event_type = 'purchase'")
    code = F.when(F.col("event_id") % 3 == 0, "SAVE10").when(F.col("event_id") % 3 == 1, "FLAT50")
    amount, percent = F.col("value").cast("double") * 2, (F.col("event_id") % 5).cast("double")
    left = money.coupon(money.discount(amount, percent), code)
    return rows.select("event_id", money.tax(left).alias("tax"), money.shipping(left).alias("shipping"), money.price(amount, percent, code).alias("total"))


@query("""with s as (select l_orderkey as cart_id, sum(round(p_retailprice * 100)::bigint * l_quantity::int) / 100 as subtotal from lineitem join part on l_partkey = p_partkey group by 1),
c as (select o_orderkey as cart_id, coalesce(subtotal, 0)::double as subtotal, case when o_orderpriority like '1%' then 'SAVE10' when o_orderpriority like '2%' then 'FLAT50' end as code from orders left join s on o_orderkey = cart_id),
e as (select cart_id, subtotal, case when code = 'SAVE10' then subtotal - subtotal * 10 / 100 when code = 'FLAT50' then greatest(subtotal - 50, 0.0) else subtotal end as a from c),
t as (select *, printf('%.2f', a * 0.18)::double as tax, case when a >= 500 then 0.0 else 40.0 end as fee from e)
select cart_id, subtotal, printf('%.2f', a + tax + fee)::double as total from t""")
def cart_totals(spark: SparkSession, d: str) -> DataFrame:
    return shop.totals(_carts(spark, d), _lines(spark, d), _products(spark, d)).select("cart_id", "subtotal", "total")


@query("select p_partkey as sku, p_name as name, greatest(p_size - 10, 0)::int as stock from part where p_size > 10")
def catalog_in_stock(spark: SparkSession, d: str) -> DataFrame:
    return shop.in_stock(_products(spark, d)).select("sku", "name", "stock")


@query("select p_partkey as sku, p_name as name, p_retailprice::double as price, greatest(p_size - 10, 0)::int as stock from part where p_partkey = 7")
def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    return shop.get(_products(spark, d), 7).drop("seq")


@query("""select p_partkey as sku, p_name as name, p_retailprice::double as price, greatest(p_size - 10, 0)::int as stock from part
where translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%ring%'""")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return shop.search(_products(spark, d), "RING")


@query("select user_id as sku, min(event_id)::bigint as seq, arg_max(event_type, event_id) as name, arg_max(value, event_id)::double as price from events group by 1")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("sku"), F.col("event_type").alias("name"), F.col("value").cast("double").alias("price"), F.col("event_id").cast("bigint").alias("seq"))
    return shop.upsert(rows)


@query("""with need as (select l_orderkey as cart_id, l_partkey as sku, sum(l_quantity::int) as need from lineitem group by 1, 2)
select cart_id, bool_and(coalesce(greatest(p_size - 10, 0) * 20 >= need, false)) as fits from need left join part on sku = p_partkey group by 1""")
def stock_check(spark: SparkSession, d: str) -> DataFrame:
    return shop.stock_check(_lines(spark, d), _products(spark, d, 20))


@query("""select o_orderkey as cart_id, case when o_orderstatus = 'F' then 'card' else 'upi' end as method, case when o_orderstatus = 'F' then right('41110000' || o_orderkey, 4) end as last4,
case when o_orderstatus <> 'F' then 'u' || o_custkey || '@bank' end as handle, o_totalprice::double as amount, 'paid' as status from orders""")
def receipts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "card").otherwise("upi")
    detail = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("41110000"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@bank")))
    made = table(spark, d, "orders").select(F.col("o_orderkey").alias("cart_id"), shop.receipt(kind, detail, F.col("o_totalprice").cast("double")).alias("r"))
    return made.select("cart_id", "r.method", "r.last4", "r.handle", "r.amount", "r.status")


@query("""select l_orderkey as cart_id, string_agg(l_partkey || 'x' || l_quantity::int, ',' order by l_linenumber, l_partkey, l_quantity::int) as items from lineitem group by 1""")
def order_items(spark: SparkSession, d: str) -> DataFrame:
    return shop.order_items(_lines(spark, d)).select("cart_id", F.array_join(F.transform("items", lambda i: F.concat(i["sku"].cast("string"), F.lit("x"), i["qty"].cast("string"))), ",").alias("items"))


@query("select user_id as cart_id, arg_max(event_type, event_id) as coupon from events group by 1")
def last_coupons(spark: SparkSession, d: str) -> DataFrame:
    return shop.coupons(table(spark, d, "events").select(F.col("user_id").alias("cart_id"), F.col("event_type").alias("code"), F.col("event_id").alias("seq")))


@query("""select l_orderkey as cart_id, l_linenumber::int as line_no, (l_quantity::int - 9) as qty,
case when l_partkey % 7 = 0 then 'unknown sku: ' || (-1 - l_partkey) when l_quantity::int - 9 < 1 then 'quantity must be a positive integer, got ' || (l_quantity::int - 9) end as error from lineitem""")
def line_errors(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).withColumn("qty", F.col("qty") - 9).withColumn("sku", F.when(F.col("sku") % 7 == 0, -1 - F.col("sku")).otherwise(F.col("sku")))
    return shop.bound_lines(lines, _products(spark, d)).select("cart_id", "line_no", "qty", "error")


@query("""with u as (select user_id as sku, arg_max(event_type, event_id) as name, arg_max(value, event_id)::double as price from events group by 1)
select sku, name, price, 1 as stock from u where translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%c_i%'""")
def catalog_upsert_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("sku"), F.col("event_type").alias("name"), F.col("value").cast("double").alias("price"), F.lit(1).alias("stock"), F.col("event_id").cast("bigint").alias("seq"))
    return shop.search(shop.upsert(rows), "C_I")


@query("""with s as (select l_orderkey as cart_id, sum(p_retailprice::decimal(20,8) * l_quantity::int)::double as subtotal, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1),
c as (select o_orderkey as cart_id, coalesce(subtotal, 0) as subtotal, coalesce(n, 0) as n, case when o_orderpriority like '1%' then 'SAVE10' when o_orderpriority like '2%' then 'FLAT50' when o_orderpriority like '5%' then 'save10' end as code,
  case o_orderstatus when 'F' then 'card' when 'O' then 'upi' else 'cash' end as kind from orders left join s on o_orderkey = cart_id),
e as (select *, case when code = 'SAVE10' then subtotal - subtotal * 10 / 100 when code = 'FLAT50' then greatest(subtotal - 50, 0.0) else subtotal end as a,
  case when code = 'save10' then 'unknown coupon code: ' || chr(39) || 'save10' || chr(39) when kind = 'cash' then 'unknown payment method: cash' end as error from c),
t as (select *, printf('%.2f', a * 0.18)::double as tax, case when a >= 500 then 0.0 else 40.0 end as fee from e)
select cart_id, case when error is null then 'ok' end as status, case when error is null then printf('%.2f', a + tax + fee)::double end as total, case when error is null then kind end as method,
n::bigint as n_items, error from t""")
def checkout_ample(spark: SparkSession, d: str) -> DataFrame:
    """Checkout where stock never runs out: what is refused is refused for its coupon or its payment."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("cart_id"), "o_orderpriority", "o_orderstatus")
    code = F.col("o_orderpriority")
    carts = orders.select("cart_id", F.lit(0.0).alias("discount_pct"), F.when(code.startswith("1"), "SAVE10").when(code.startswith("2"), "FLAT50").when(code.startswith("5"), "save10").alias("coupon"))
    kind = F.when(F.col("o_orderstatus") == "F", "card").when(F.col("o_orderstatus") == "O", "upi").otherwise("cash")
    payments = orders.select("cart_id", kind.alias("kind"), F.lit("41110000").alias("detail"))
    products = _products(spark, d).withColumn("stock", F.lit(1_000_000_000))
    done = shop.checkout(carts, _lines(spark, d), products, payments)
    return done.select("cart_id", "status", "total", F.col("receipt.method").alias("method"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), "error")


@query()
def orders_in_arrival_order(spark: SparkSession, d: str) -> DataFrame:
    return shop.accept_in_order(_lines(spark, d), _products(spark, d, 20)).select("cart_id", "accepted")

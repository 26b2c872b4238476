"""Catalog, carts, stock, payments and orders as relations.

products (sku, name, price, stock, seq), lines (cart_id, line_no, sku, qty, and
price where it was taken when the line was added), carts (cart_id, discount_pct,
coupon), payments (cart_id, kind, detail).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import money, text
from tessera.functions.errors import MissingKey

EMPTY = "sku string, name string, price double, stock int, seq bigint"


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EMPTY)


def upsert(rows: DataFrame, key: str = "sku", seq: str = "seq") -> DataFrame:
    """One row per key: the values of its last ``seq``, at the place of its first."""
    values = [c for c in rows.columns if c not in (key, seq)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("_last"), F.min(seq).alias(seq))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in values], seq)


def get(products: DataFrame, sku: str) -> DataFrame:
    """The row of ``sku``; a sku that isn't there is an error."""
    found = products.filter(F.col("sku") == F.lit(sku))
    if found.isEmpty():
        raise MissingKey(sku)
    return found


def scan(products: DataFrame) -> DataFrame:
    return products.orderBy("seq")


def in_stock(products: DataFrame) -> DataFrame:
    return products.filter(F.col("stock") > 0).orderBy("seq")


def search(products: DataFrame, term: str) -> DataFrame:
    """sku, name, price, stock of the products whose name contains ``term``, which is bound, never spliced.

    ``products`` is any source, a JDBC table (``sources.tables.external``) included.
    """
    query = f"""SELECT sku, name, price, stock FROM {{products}}
        WHERE translate(name, '{text.UPPER}', '{text.LOWER}') LIKE
          concat('%', translate(replace(:term, '\\\\', '\\\\\\\\'), '{text.UPPER}', '{text.LOWER}'), '%')"""
    return products.sparkSession.sql(query, args={"term": term}, products=products)


def quantity_error(df: DataFrame, column: str = "qty") -> Column:
    """The message of a quantity that isn't a positive integer; a column of another type is refused for all rows."""
    if dict(df.dtypes)[column] not in ("tinyint", "smallint", "int", "bigint"):
        return F.format_string("quantity must be a positive integer, got %s", F.col(column).cast("string"))
    bad = F.col(column).isNull() | (F.col(column) < 1)
    return F.when(bad, F.format_string("quantity must be a positive integer, got %s", F.coalesce(F.col(column).cast("string"), F.lit("None"))))


def add_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """``lines`` with the price that each sku has now, which they keep whatever the catalog says later; null for an unknown sku."""
    return lines.join(products.select("sku", "price"), "sku", "left").select(*lines.columns, "price")


def bound_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with name, price (their own, if they have one), stock, amount and error (an unknown sku, then a bad quantity)."""
    columns = ["name", "stock", *(["price"] if "price" not in lines.columns else [])]
    both = lines.withColumn("_bad", quantity_error(lines)).join(products.select("sku", *columns, F.lit(True).alias("_known")), "sku", "left")
    error = F.when(F.col("_known").isNull(), unknown_sku(F.col("sku"))).otherwise(F.col("_bad"))
    return both.withColumn("error", error).withColumn("amount", F.col("price") * F.col("qty")).drop("_bad", "_known")


def unknown_sku(sku: Column) -> Column:
    return F.format_string("unknown sku: %s", sku.cast("string"))


def coupons(events: DataFrame) -> DataFrame:
    """(cart_id, coupon): a cart's last code (cart_id, code, seq)."""
    return events.groupBy("cart_id").agg(F.max_by("code", "seq").alias("coupon"))


def totals(carts: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """(cart_id, subtotal, total, error) of every cart; one without lines pays shipping.

    Prices count to eight places, and sums are exact, whatever their order.
    """
    bound = bound_lines(lines, products)
    amount = F.col("price").cast("decimal(20,8)") * F.col("qty").cast("decimal(10,0)")
    sums = bound.groupBy("cart_id").agg(F.sum(amount).alias("_sum"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("_error"))
    both = carts.join(sums, "cart_id", "left").withColumn("subtotal", F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)))
    both = both.withColumn("error", F.coalesce("_error", money.coupon_error(F.col("coupon"))))
    price = money.price(F.col("subtotal"), F.coalesce("discount_pct", F.lit(0.0)), F.col("coupon"))
    return both.select("cart_id", "subtotal", F.when(F.col("error").isNull(), price).alias("total"), "error")


def stock_check(lines: DataFrame, products: DataFrame) -> DataFrame:
    """(cart_id, fits): each cart alone against the whole stock, all of its lines or none."""
    need = lines.groupBy("cart_id", "sku").agg(F.sum("qty").alias("need"))
    both = need.join(products.select("sku", "stock"), "sku", "left")
    return both.groupBy("cart_id").agg(F.every(F.coalesce(F.col("stock") >= F.col("need"), F.lit(False))).alias("fits"))


def accept_in_order(lines: DataFrame, products: DataFrame) -> DataFrame:
    """(cart_id, accepted, error): carts in order of cart_id reserve line by line, all or nothing, what a refused one reserved going back.

    The error tells the first line that can't be reserved: an unknown sku, a
    quantity that isn't a positive integer, or how many were left then. Whether a
    cart fits depends on all accepted before, so this is one ordered pass in one
    task, streaming, with the stock of each sku in memory: serial by nature. Lines
    meet their products, and are checked, in all tasks before that.
    """
    rows = lines.withColumn("_bad", quantity_error(lines)).join(products.select("sku", F.coalesce("stock", F.lit(0)).cast("long").alias("stock")), "sku", "left")
    error = F.when(F.col("stock").isNull(), unknown_sku(F.col("sku"))).otherwise(F.col("_bad"))
    rows = rows.select("cart_id", "line_no", F.col("sku").cast("string").alias("sku"), F.col("qty").cast("long").alias("qty"), "stock", error.alias("error"))
    kind = dict(lines.dtypes)["cart_id"]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, int] = {}
        open_cart, cart, taken, error = False, None, [], None

        def settle() -> tuple:
            if error is not None:
                for sku, qty in taken:
                    left[sku] += qty
            return cart, error is None, error

        def out(settled: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*settled, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], like), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.string())], ["cart_id", "accepted", "error"])

        like = None
        for batch in batches:
            like, settled = batch.schema.field(0).type, []
            for this, sku, qty, stock, bad in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True):
                if not open_cart or this != cart:
                    if open_cart:
                        settled.append(settle())
                    open_cart, cart, taken, error = True, this, [], None
                if error is not None:
                    continue
                now = left.setdefault(sku, stock)
                error = bad if bad is not None else f"only {now} of {sku} left" if now < qty else None
                if error is None:
                    left[sku] -= qty
                    taken.append((sku, qty))
            yield out(settled, like)
        if open_cart:
            yield out([settle()], like)

    return rows.repartition(1).sortWithinPartitions("cart_id", "line_no").mapInArrow(folded, f"cart_id {kind}, accepted boolean, error string")


#: What a payment's record holds beside method, amount and status, by kind: fields made of its detail.
PAYMENTS: dict[str, Callable[[Column], dict[str, Column]]] = {}


def payment(kind: str) -> Callable:
    """Register a kind of payment by the fields of its record; a later one replaces an earlier."""

    def register(fields: Callable[[Column], dict[str, Column]]) -> Callable[[Column], dict[str, Column]]:
        PAYMENTS[kind] = fields
        return fields

    return register


@payment("card")
def _card(detail: Column) -> dict[str, Column]:
    return {"last4": F.right(detail, F.lit(4))}


@payment("upi")
def _upi(detail: Column) -> dict[str, Column]:
    return {"handle": detail}


def receipt(kind: Column, detail: Column, amount: Column) -> Column:
    """One record for all kinds, a kind's own fields null for others; null for an unknown kind (see ``payment_error``)."""
    own = {name: fields(detail) for name, fields in PAYMENTS.items()}
    names = dict.fromkeys(n for fields in own.values() for n in fields)
    out = None
    for name, fields in own.items():
        record = F.struct(F.lit(name).alias("method"), *[fields.get(n, F.lit(None).cast("string")).alias(n) for n in names], amount.alias("amount"), F.lit("paid").alias("status"))
        out = F.when(kind == name, record) if out is None else out.when(kind == name, record)
    return out


def payment_error(kind: Column) -> Column:
    return F.when(~F.coalesce(kind.isin(*PAYMENTS), F.lit(False)), F.format_string("unknown payment method: %s", kind))


def order_items(lines: DataFrame) -> DataFrame:
    """(cart_id, items): a cart's lines as structs (sku, qty) in order of line."""
    found = lines.groupBy("cart_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "sku", "qty"))).alias("items"))
    return found.select("cart_id", F.transform("items", lambda i: F.struct(i["sku"].alias("sku"), i["qty"].alias("qty"))).alias("items"))


def checkout(carts: DataFrame, lines: DataFrame, products: DataFrame, payments: DataFrame) -> DataFrame:
    """(cart_id, status, total, receipt, items, error): carts in order, each all or nothing; refused ones say why.

    Guards (unknown sku, bad quantity, payment method, coupon) come before stock,
    and refused carts take none.
    """
    due = totals(carts, lines, products).join(payments, "cart_id", "left").withColumn("error", F.coalesce("error", payment_error(F.col("kind"))))
    sound = lines.join(due.filter("error is null").select("cart_id"), "cart_id", "left_semi")
    taken = accept_in_order(sound, products).select("cart_id", F.col("error").alias("_short"))
    both = due.join(taken, "cart_id", "left").join(order_items(lines), "cart_id", "left").withColumn("error", F.coalesce("error", "_short"))
    fine = F.col("error").isNull()
    return both.select("cart_id", F.when(fine, "ok").alias("status"), F.when(fine, F.col("total")).alias("total"), F.when(fine, receipt(F.col("kind"), F.col("detail"), F.col("total"))).alias("receipt"), "items", "error")


def remaining(products: DataFrame, lines: DataFrame, orders: DataFrame) -> DataFrame:
    """products with the stock that accepted orders (cart_id, status) leave."""
    used = lines.join(orders.filter("status = 'ok'").select("cart_id"), "cart_id", "left_semi").groupBy("sku").agg(F.sum("qty").alias("_used"))
    return products.join(used, "sku", "left").withColumn("stock", (F.col("stock") - F.coalesce("_used", F.lit(0))).cast("int")).drop("_used")

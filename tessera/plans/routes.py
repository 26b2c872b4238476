"""A router from paths to builders of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.errors import MissingKey
from tessera.operators import shop
from tessera.sources.tables import append_orders, read_orders

ROUTES: dict[str, Callable[..., DataFrame]] = {}


def route(path: str) -> Callable:
    """Register a builder for ``path``; a later one replaces an earlier."""

    def register(builder: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ROUTES[path] = builder
        return builder

    return register


def handle(path: str, **request) -> DataFrame:
    if path not in ROUTES:
        raise MissingKey(path)
    return ROUTES[path](**request)


@route("/products")
def products_in_stock(products: DataFrame, **_) -> DataFrame:
    return shop.in_stock(products).select("name")


@route("/orders")
def orders_logged(spark, log: str, **_) -> DataFrame:
    return read_orders(spark, log)


@route("/search")
def products_named(products: DataFrame, q: str, **_) -> DataFrame:
    return shop.search(products, q)


@route("/checkout")
def check_out(carts: DataFrame, lines: DataFrame, products: DataFrame, payments: DataFrame, log: str | None = None, **_) -> DataFrame:
    """Check carts out (without discounts or coupons, which requests can't set) and log those that went through."""
    plain = carts.select("cart_id", F.lit(0.0).alias("discount_pct"), F.lit(None).cast("string").alias("coupon"))
    done = shop.checkout(plain, lines, products, payments)
    if log is not None:
        append_orders(done.filter("status = 'ok'").select(F.col("cart_id").cast("bigint").alias("seq"), "total", F.col("items").cast("array<struct<sku:string,qty:int>>").alias("items")), log)
    return done

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import money
from tessera.functions.errors import MissingKey, strict
from tessera.operators import shop
from tessera.plans.routes import handle
from tessera.sources.tables import external


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([("A1", "Lamp", 100.0, 5, 0), ("B2", "Desk", 450.0, 1, 1), ("C3", "Bob's Chair", 80.0, 0, 2), ("D4", None, 1.0, 0, 3)], "sku string, name string, price double, stock int, seq bigint")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_money(spark):
    lit = F.lit
    assert one(spark, money.discount(lit(200.0), lit(10))) == 180 and one(spark, money.price(lit(100.0))) == 158 and one(spark, money.price(lit(0.0))) == 40
    assert [one(spark, money.shipping(lit(x))) for x in (499.0, 500.0)] == [40, 0]
    assert [one(spark, money.coupon(lit(a), lit(c))) for a, c in ((200.0, "SAVE10"), (200.0, "FLAT50"), (30.0, "FLAT50"), (100.0, "save10"))] == [180, 150, 0, None]
    assert one(spark, money.coupon_error(lit("save10"))) and one(spark, money.coupon_error(lit(""))) and one(spark, money.coupon_error(lit(None).cast("string"))) is None
    rng = random.Random(2)
    amounts = [0.25, 2.75, 3.25, 4.75] + [round(rng.uniform(0, 2000), 2) for _ in range(3000)]
    got = spark.createDataFrame([(a,) for a in amounts], "a double").select(money.tax(F.col("a")).alias("t")).collect()
    assert [r["t"] for r in got] == [round(a * 0.18, 2) for a in amounts]


@pytest.mark.parametrize(("term", "names"), [("lam", ["Lamp"]), ("es", ["Desk"]), ("Bob's", ["Bob's Chair"]), ("zzz' OR '1'='1", []), ("x'; DROP TABLE products; --", []), ("\\", []), ("L_mp", ["Lamp"]), ("", ["Bob's Chair", "Desk", "Lamp"])])
def test_search(products, term, names):
    assert sorted(r["name"] for r in shop.search(products, term).collect()) == names


def test_catalog(spark, products):
    again = products.unionAll(spark.createDataFrame([("A1", "Lamp 2", 90.0, 7, 9)], products.schema))
    assert [(r["sku"], r["name"]) for r in shop.scan(shop.upsert(again)).collect()][:2] == [("A1", "Lamp 2"), ("B2", "Desk")]
    assert [r["name"] for r in handle("/products", products=products).collect()] == ["Lamp", "Desk"]
    assert shop.get(products, "A1").first()["price"] == 100 and shop.catalog(spark).count() == 0
    with pytest.raises(MissingKey):
        shop.get(products, "nope")
    with pytest.raises(MissingKey):
        handle("/nope")


def test_totals_and_quantities(spark, products):
    carts = spark.createDataFrame([(1, 0.0, None), (2, 0.0, "SAVE10"), (3, 0.0, "FLAT50"), (4, 0.0, "BOGUS"), (5, 0.0, None), (6, 0.0, None), (7, 0.0, None)], "cart_id long, discount_pct double, coupon string")
    lines = spark.createDataFrame([(1, 1, "A1", 2), (2, 1, "A1", 2), (3, 1, "A1", 2), (4, 1, "A1", 1), (6, 1, "A1", -5), (7, 1, "X", 1)], "cart_id long, line_no int, sku string, qty int")
    got = {r["cart_id"]: r for r in shop.totals(carts, lines, products).collect()}
    assert [got[k]["total"] for k in range(1, 8)] == [276.0, 252.4, 217.0, None, 40.0, None, None]
    assert "BOGUS" in got[4]["error"] and "-5" in got[6]["error"] and "unknown sku" in got[7]["error"]
    with pytest.raises(ValueError, match="BOGUS"):
        strict(shop.totals(carts.filter("cart_id = 4"), lines, products))
    for kind in ("double", "string", "boolean"):
        bad = lines.withColumn("qty", F.lit(1).cast(kind))
        assert bad.filter(shop.quantity_error(bad).isNull()).count() == 0


def test_checkout_and_log(spark, products, tmp_path):
    carts = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "cart_id long")
    lines = spark.createDataFrame([(1, 1, "A1", 2), (2, 1, "A1", 1), (2, 2, "B2", 2), (3, 1, "A1", 4), (4, 1, "A1", 3), (5, 1, "B2", 1)], "cart_id long, line_no int, sku string, qty int")
    pay = spark.createDataFrame([(1, "card", "4111111111111111"), (2, "upi", "me@bank"), (3, "card", "1"), (4, "upi", "me@bank"), (5, "cash", "")], "cart_id long, kind string, detail string")
    log = str(tmp_path / "log")
    done = handle("/checkout", carts=carts, lines=lines, products=products, payments=pay, log=log)
    got = {r["cart_id"]: r for r in done.collect()}
    assert [got[k]["status"] for k in range(1, 6)] == ["ok", None, None, "ok", None]
    assert got[1]["total"] == 276.0 and got[1]["receipt"]["last4"] == "1111" and got[4]["receipt"]["handle"] == "me@bank"
    assert got[2]["error"] == "only 1 of B2 left" and "cash" in got[5]["error"]
    assert [(r["total"], [tuple(i) for i in r["items"]]) for r in handle("/orders", spark=spark, log=log).collect()] == [(276.0, [("A1", 2)]), (394.0, [("A1", 3)])]
    assert {r["sku"]: r["stock"] for r in shop.remaining(products, lines, done).collect()}["A1"] == 0


def test_orders_in_order_against_a_plain_model(spark, products):
    """Who is accepted and what the others are told, line by line; quantities of 0 and less and unknown skus take nothing."""
    rng = random.Random(3)
    rows = [(k, n, rng.choice("ABCX" if k % 9 == 0 else "ABC"), rng.randint(0 if k % 7 == 0 else 1, 4) * (-1 if k % 11 == 0 else 1)) for k in range(60) for n in range(rng.randint(1, 3))]
    stock = spark.createDataFrame([("A", 20), ("B", 15), ("C", 30)], "sku string, stock int")
    left, want = {"A": 20, "B": 15, "C": 30}, {}
    for k in range(60):
        reserved, want[k] = [], None
        for _, _, sku, qty in (r for r in rows if r[0] == k):
            if sku not in left:
                want[k] = f"unknown sku: {sku}"
            elif qty < 1:
                want[k] = f"quantity must be a positive integer, got {qty}"
            elif left[sku] < qty:
                want[k] = f"only {left[sku]} of {sku} left"
            if want[k]:
                break
            left[sku] -= qty
            reserved.append((sku, qty))
        for sku, qty in reserved if want[k] else ():
            left[sku] += qty
    lines = spark.createDataFrame(rows, "cart_id long, line_no int, sku string, qty int")
    got = {r["cart_id"]: (r["accepted"], r["error"]) for r in shop.accept_in_order(lines, stock).collect()}
    assert got == {k: (e is None, e) for k, e in want.items()} and sum(e is not None and e.startswith("only") for e in want.values()) > 3
    assert shop.accept_in_order(lines.limit(0), stock).count() == 0


def test_a_shortage_tells_what_earlier_orders_left(spark, products):
    carts = spark.createDataFrame([(1,), (2,), (3,)], "cart_id long")
    lines = spark.createDataFrame([(1, 1, "A1", 2), (2, 1, "A1", 10), (3, 1, "A1", 2), (3, 2, "A1", 2)], "cart_id long, line_no int, sku string, qty int")
    pay = spark.createDataFrame([(k, "card", "42") for k in (1, 2, 3)], "cart_id long, kind string, detail string")
    got = {r["cart_id"]: r["error"] for r in handle("/checkout", carts=carts, lines=lines, products=products, payments=pay).collect()}
    assert got == {1: None, 2: "only 3 of A1 left", 3: "only 1 of A1 left"}


def test_prices_of_when_a_line_was_added_and_beyond_cents(spark, products):
    cheap = products.withColumn("price", F.lit(0.125))
    lines = spark.createDataFrame([(1, 1, "A1", 2)], "cart_id long, line_no int, sku string, qty int")
    carts = spark.createDataFrame([(1, 0.0, None)], "cart_id long, discount_pct double, coupon string")
    assert shop.totals(carts, lines, cheap).first()["subtotal"] == 0.25
    assert shop.totals(carts, shop.add_lines(lines, cheap), products).first()["subtotal"] == 0.25
    assert shop.totals(carts, lines, products).first()["subtotal"] == 200


def test_last_coupon(spark):
    events = spark.createDataFrame([(1, "SAVE10", 1), (1, "FLAT50", 2), (2, "BOGUS", 1)], "cart_id long, code string, seq long")
    assert {r["cart_id"]: r["coupon"] for r in shop.coupons(events).collect()} == {1: "FLAT50", 2: "BOGUS"}


def test_a_further_kind_of_payment(spark):
    assert shop.receipt(F.lit("cash"), F.lit("x"), F.lit(1.0)) is not None

    @shop.payment("voucher")
    def voucher(detail):
        return {"code": F.upper(detail)}

    try:
        got = spark.range(1).select(shop.receipt(F.lit("voucher"), F.lit("ab"), F.lit(9.0)).alias("r"), shop.receipt(F.lit("card"), F.lit("12345"), F.lit(1.0)).alias("c"), shop.payment_error(F.lit("voucher")).alias("e")).first()
        assert got["r"].asDict() == {"method": "voucher", "last4": None, "handle": None, "code": "AB", "amount": 9.0, "status": "paid"}
        assert got["c"]["last4"] == "2345" and got["c"]["code"] is None and got["e"] is None
    finally:
        del shop.PAYMENTS["voucher"]
    assert one(spark, shop.payment_error(F.lit("voucher"))) == "unknown payment method: voucher"


def test_search_in_a_database(spark, products):
    url, driver = "jdbc:derby:memory:tessera;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    products.filter("name is not null").select(*[F.col(c).alias(c.upper()) for c in products.columns]).coalesce(1).write.jdbc(url, "PRODUCTS", "overwrite", {"driver": driver, "createTableColumnTypes": "SKU VARCHAR(20), NAME VARCHAR(99)"})
    found = shop.search(external(spark, url, "PRODUCTS", driver=driver), "es")
    assert [tuple(r) for r in found.collect()] == [("B2", "Desk", 450.0, 1)]

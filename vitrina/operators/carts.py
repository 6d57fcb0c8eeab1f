"""Cart queries and batch cart jobs.

The shop changes carts one row per HTTP request inside a transaction; here
the same rules run as set-shaped batch jobs: a batch of requests is
pre-aggregated per cart key, joined to products and to the current cart
snapshot, and every request gets an action and a reason. Jobs return their
per-request results; ``*_snapshot`` functions return the cart after the job
(write it with ``sinks.write_snapshot``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import money
from ..sources.literals import FLAT_SHIPPING, MAX_CART_PRODUCTS, MAX_LINE_QTY
from ..sources.tables import Tables

# --- fixed values -----------------------------------------------------------
ACTION_INSERT = "insert"
ACTION_UPDATE = "update"
ACTION_SKIP = "skip"
ACTION_REJECT = "reject"
ACTION_REMOVE = "remove"
REASON_UNKNOWN = "unknown product"
REASON_INACTIVE = "inactive product"
REASON_RANGE = "quantity out of range"
REASON_INVALID = "invalid quantity"
REASON_NOT_FOUND = "item not found"
REASON_FULL = "cart holds the most products"
OWNER_CUSTOMER = "customer"
OWNER_SESSION = "session"
AS_OF_CARTS = "2024-02-15 00:00:00"
RETENTION_DAYS = 30
# ---------------------------------------------------------------------------

KEY = ["owner_type", "owner_id", "product_id", "size", "color"]


def owner_type() -> Column:
    return F.when(F.col("customer_id").isNotNull(), F.lit(OWNER_CUSTOMER)).otherwise(F.lit(OWNER_SESSION))


def owner_id() -> Column:
    return F.coalesce(F.col("customer_id").cast("string"), F.col("session_id"))


def line_owners(cart: DataFrame) -> DataFrame:
    """(id, owner_type, owner_id, quantity, product_id, size, color) for every identity that owns a cart line.

    A line may carry both a customer and a session id; it answers to both.
    """
    columns = ["id", "quantity", "product_id", "size", "color"]
    cart = cart.select("customer_id", "session_id", *columns)
    by_customer = cart.filter(F.col("customer_id").isNotNull()).select(
        *columns, F.lit(OWNER_CUSTOMER).alias("owner_type"), F.col("customer_id").cast("string").alias("owner_id")
    )
    by_session = cart.filter(F.col("session_id").isNotNull()).select(
        *columns, F.lit(OWNER_SESSION).alias("owner_type"), F.col("session_id").alias("owner_id")
    )
    return by_customer.unionByName(by_session)


def cart_contents(t: Tables) -> DataFrame:
    """Q36: cart lines of registered customers on active products, with line totals."""
    return (
        t.cart_items.filter(F.col("customer_id").isNotNull())
        .select("id", "customer_id", "quantity", "size", "color", "product_id")
        .join(
            t.products.filter("is_active").select("product_id", "product_name", "price", "image_url", "stock", "category_id"),
            "product_id",
        )
        .join(t.categories.select("category_id", "category_name"), "category_id", "left")
        .select(
            "id", "customer_id", "quantity", "size", "color", F.col("product_id").cast("long").alias("product_id"),
            "product_name", money("price").alias("price"), "image_url", "stock", "category_name",
            money(F.col("price") * F.col("quantity")).alias("item_total"),
        )
    )


def cart_totals(t: Tables) -> DataFrame:
    """Q37: per customer subtotal, flat shipping when the cart is not empty, total."""
    lines = (
        t.cart_items.filter(F.col("customer_id").isNotNull())
        .select("customer_id", "product_id", "quantity")
        .join(t.products.filter("is_active").select("product_id", "price"), "product_id")
    )
    agg = lines.groupBy("customer_id").agg(
        F.sum(F.col("price") * F.col("quantity")).alias("_subtotal"), F.count(F.lit(1)).alias("_n")
    )
    shipping = F.when(F.col("_n") > 0, F.lit(FLAT_SHIPPING)).otherwise(F.lit(0)).cast("decimal(10,2)")
    return agg.select(
        "customer_id",
        money("_subtotal").alias("subtotal"),
        money(shipping).alias("shipping"),
        money(F.col("_subtotal") + shipping).alias("total"),
    )


def cart_item_count(t: Tables) -> DataFrame:
    """Q38: Σ quantity per cart owner; registered customers without a cart get 0.

    A line with a customer and a session counts for both, as either sees it.
    """
    per_owner = line_owners(t.cart_items).groupBy("owner_type", "owner_id").agg(
        F.sum("quantity").cast("long").alias("count")
    )
    customers = t.customers.select(F.lit(OWNER_CUSTOMER).alias("owner_type"), F.col("customer_id").cast("string").alias("owner_id"))
    empty = customers.join(per_owner, ["owner_type", "owner_id"], "left_anti").withColumn("count", F.lit(0).cast("long"))
    return per_owner.unionByName(empty)


def cart_distinct_products(t: Tables) -> DataFrame:
    """Q39: distinct products per cart owner and whether the 50-product limit is reached."""
    return (
        line_owners(t.cart_items)
        .groupBy("owner_type", "owner_id")
        .agg(F.countDistinct("product_id").cast("long").alias("distinct_products"))
        .withColumn("at_limit", F.col("distinct_products") >= F.lit(MAX_CART_PRODUCTS))
    )


def _asked(quantity: Column, number: Column) -> Column:
    """Quantities of a derived batch: some are missing, negative or above the limit."""
    turn = number % 20
    return F.when(turn == 3, F.lit(None)).when(turn == 7, -1).when(turn == 11, 20).otherwise(quantity).cast("int")


def guest_sync_batch(t: Tables) -> DataFrame:
    """Guest cart lines handed to the account of the same user at login.

    Sessions are named ``s<user id>``; the batch has the sync request shape
    (customer_id, product_id, size, color, quantity) and an ``arrival`` order.
    """
    return t.cart_items.filter(F.col("session_id").isNotNull()).select(
        F.substring("session_id", 2, 1 << 20).cast("long").alias("customer_id"),
        "product_id",
        "size",
        "color",
        _asked(F.col("quantity"), F.col("id")).alias("quantity"),
        F.col("id").alias("arrival"),
    )


def add_batch(t: Tables) -> DataFrame:
    """Additions by every owner, guests too: each cart line again, of it or of one of the next products."""
    return t.cart_items.select(
        "customer_id",
        "session_id",
        (F.col("product_id") + F.col("id") % 3).alias("product_id"),
        "size",
        "color",
        _asked(F.col("quantity"), F.col("id")).alias("quantity"),
        F.col("id").alias("arrival"),
    )


def _requests(batch: DataFrame) -> DataFrame:
    """Requests (owner_type, owner_id, product_id, size, color, quantity, at, alone).

    ``at`` is the arrival order; without an ``arrival`` column it is arbitrary but
    fixed. A NULL size or color equals nothing, so such a request is ``alone``.
    """
    if "session_id" not in batch.columns:
        batch = batch.withColumn("session_id", F.lit(None).cast("string"))
    values = ["customer_id", "session_id", "product_id", "size", "color", "quantity"]
    at = F.col("arrival") if "arrival" in batch.columns else F.xxhash64(*values)
    return batch.select(
        owner_type().alias("owner_type"),
        owner_id().alias("owner_id"),
        F.col("product_id").cast("long").alias("product_id"),
        "size",
        "color",
        F.col("quantity").cast("int").alias("quantity"),
        at.cast("long").alias("at"),
        F.when(F.col("size").isNull() | F.col("color").isNull(), F.struct(at.alias("at"), F.xxhash64(*values).alias("h"))).alias("alone"),
    )


def _merged(t: Tables, batch: DataFrame, limited: bool, top: int | None) -> DataFrame:
    """Per cart key, what the shop does with the requests one after the other.

    A line takes min(old + quantity, 15, stock) with each request. As quantities are
    positive, after several that is min(old + sum, 15, stock). A line that does not
    exist is born with the first request that leaves 1 to 15 units; those before it
    fail. With ``limited``, an owner's requests end with the one that brings the cart
    to ``MAX_CART_PRODUCTS`` products: that is the birth of the last new product the
    cart has room for, so only the first births of each owner are ranked.
    """
    req = _requests(batch)
    lines = (
        line_owners(t.cart_items)
        .withColumn("product_id", F.col("product_id").cast("long"))
        .groupBy(*KEY)
        .agg(F.min("id").alias("line_id"), F.min_by("quantity", "id").alias("old_quantity"))
    )
    products = t.products.select("product_id", F.col("stock").alias("_stock"), F.col("is_active").alias("_active"))
    rows = req.join(products, "product_id", "left").join(lines, KEY, "left")
    q, stock, cap = F.col("quantity"), F.col("_stock"), F.lit(MAX_LINE_QTY)
    exists = F.col("line_id").isNotNull()
    invalid = q.isNull() | (q < 1) | ((q > cap) if top else F.lit(False))
    usable = ~invalid & F.coalesce(F.col("_active"), F.lit(False))
    first = F.least(q, stock)
    rows = rows.withColumn("_fits", usable & F.when(exists, stock >= 1).otherwise((first >= 1) & (first <= cap)))
    births = rows.filter("_fits AND line_id IS NULL").groupBy(*KEY, "alone").agg(F.min("at").alias("_birth"))
    over = F.lit(False)
    if limited:
        owner = ["owner_type", "owner_id"]
        held = line_owners(t.cart_items).select(*owner, F.col("product_id").cast("long").alias("product_id")).distinct()
        new = births.groupBy(*owner, "product_id").agg(F.min("_birth").alias("_birth")).join(held, [*owner, "product_id"], "left_anti")
        place = F.row_number().over(Window.partitionBy(*owner).orderBy("_birth", "product_id"))
        ranked = new.withColumn("_place", place).filter(F.col("_place") <= top)
        counts = held.groupBy(*owner).agg(F.count(F.lit(1)).alias("_held"))
        last = (
            ranked.join(counts, owner, "left")
            .filter(F.col("_place") == top - F.coalesce(F.col("_held"), F.lit(0)))
            .select(*owner, F.col("_birth").alias("_last"))
        )
        full = counts.filter(F.col("_held") >= top).select(*owner, F.lit(-(1 << 62)).alias("_last"))
        rows = rows.join(last.unionByName(full), owner, "left")
        over = F.coalesce(F.col("at") > F.col("_last"), F.lit(False))
    b = births.select(*(F.col(c).alias(f"b_{c}") for c in [*KEY, "alone"]), "_birth")
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in [*KEY, "alone"]]
    rows = rows.withColumn("_over", over).join(b, same, "left")
    counted = usable & ~F.col("_over") & F.when(exists, stock >= 1).otherwise(F.col("at") >= F.col("_birth"))
    rows = rows.withColumn("_counted", F.coalesce(counted, F.lit(False)))
    reason = (
        F.when(F.lit(bool(top)) & invalid, REASON_INVALID)
        .when(F.col("_over"), REASON_FULL)
        .when(F.col("_active").isNull(), REASON_UNKNOWN)
        .when(~F.col("_active"), REASON_INACTIVE)
        .when(invalid, REASON_INVALID)
        .otherwise(REASON_RANGE)
    )
    got = rows.withColumn("_reason", reason).groupBy(*KEY, "alone").agg(
        F.min("line_id").alias("line_id"),
        F.min("old_quantity").alias("old_quantity"),
        F.min("_stock").alias("_stock"),
        F.count(F.lit(1)).cast("long").alias("requests"),
        F.count(F.when(F.col("_counted"), 1)).cast("long").alias("accepted"),
        F.sum(F.when(F.col("_counted"), q)).alias("_added"),
        F.max_by("_reason", F.struct("at", "quantity")).alias("_reason"),
    )
    taken = F.col("accepted") > 0
    new_quantity = F.least(F.coalesce(F.col("old_quantity"), F.lit(0)) + F.col("_added"), cap, F.col("_stock"))
    skipped = F.col("_reason").isin(REASON_UNKNOWN, REASON_INACTIVE)
    return got.select(
        *KEY,
        "line_id",
        F.col("old_quantity").cast("int").alias("old_quantity"),
        F.when(taken, new_quantity).cast("int").alias("new_quantity"),
        "requests",
        "accepted",
        F.when(taken & exists, ACTION_UPDATE).when(taken, ACTION_INSERT).when(skipped, ACTION_SKIP).otherwise(ACTION_REJECT).alias("action"),
        F.when(~taken, F.col("_reason")).alias("reason"),
    )


def cart_merge(t: Tables, batch: DataFrame | None = None) -> DataFrame:
    """Q40: merge a batch into carts as the login sync does, request after request.

    Per owner and key: the line, its quantity before and after, the requests and how
    many of them counted, and an action; a key none of whose requests counted has the
    last one's reason. Unknown and inactive products are skipped, missing quantities
    and those below 1 rejected; a new line would break the table's CHECK if it
    started outside 1..15.
    """
    return _merged(t, guest_sync_batch(t) if batch is None else batch, limited=False, top=None)


def cart_add(t: Tables, batch: DataFrame | None = None, max_products: int = MAX_CART_PRODUCTS) -> DataFrame:
    """Q40 for single additions, of customers and guests: as ``cart_merge``, but a quantity must be 1..15
    and a cart that holds ``max_products`` products takes nothing more, not even of those."""
    return _merged(t, add_batch(t) if batch is None else batch, limited=True, top=max_products)


def cart_merge_snapshot(
    t: Tables, batch: DataFrame | None = None, batch_tag: int | None = None, now: str | None = None, result: DataFrame | None = None
) -> DataFrame:
    """Cart after ``cart_merge`` (or after ``result`` of it or of ``cart_add``): updated lines replaced, inserted lines appended.

    New lines get id NULL, or, with ``batch_tag``, a negative id hashed from
    (tag, cart key): the same batch always yields the same ids, so a retried
    micro-batch rewrites an identical snapshot. ``now`` stamps touched lines.
    """
    res = cart_merge(t, batch) if result is None else result
    stamp = F.lit(now).cast("timestamp_ntz") if now else None
    updates = res.filter(F.col("action") == ACTION_UPDATE).select(F.col("line_id").alias("id"), F.col("new_quantity").alias("_newq"))
    kept = t.cart_items.join(updates, "id", "left").withColumn(
        "quantity", F.coalesce(F.col("_newq"), F.col("quantity"))
    )
    if stamp is not None:
        kept = kept.withColumn("updated_at", F.when(F.col("_newq").isNotNull(), stamp).otherwise(F.col("updated_at")))
    kept = kept.drop("_newq")
    new_id = (
        F.lit(None).cast("long")
        if batch_tag is None
        else -F.abs(F.xxhash64(F.lit(batch_tag), *[F.col(c) for c in KEY])) - 1
    )
    of = lambda kind: F.when(F.col("owner_type") == kind, F.col("owner_id"))
    inserts = res.filter(F.col("action") == ACTION_INSERT).select(
        new_id.alias("id"), of(OWNER_SESSION).alias("session_id"), of(OWNER_CUSTOMER).cast("long").alias("customer_id"),
        F.col("product_id").cast(t.cart_items.schema["product_id"].dataType).alias("product_id"),
        F.col("new_quantity").alias("quantity"), "size", "color",
        (stamp if stamp is not None else F.lit(None).cast("timestamp_ntz")).alias("updated_at"),
    )
    return kept.unionByName(inserts)


def quantity_requests(t: Tables) -> DataFrame:
    """Update requests derived from the carts: every line asks for 3 more units,
    as its user; guest lines are asked for by the user's customer account
    (which does not own them)."""
    uid = F.coalesce(F.col("customer_id").cast("string"), F.substring("session_id", 2, 1 << 20))
    return t.cart_items.select(
        "id", F.lit(OWNER_CUSTOMER).alias("owner_type"), uid.alias("owner_id"), (F.col("quantity") + 3).alias("quantity")
    )


def cart_set_quantity(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Q41: set line quantities: min(requested, stock, 15); reject <1, >15, unknown, inactive."""
    if requests is None:
        requests = quantity_requests(t)
    lines = (
        line_owners(t.cart_items)
        .withColumnRenamed("quantity", "old_quantity")
        .join(t.products.select("product_id", F.col("stock").alias("_stock"), F.col("is_active").alias("_active")), "product_id")
    )
    rows = requests.select("id", "owner_type", "owner_id", F.col("quantity").alias("requested")).join(
        lines, ["id", "owner_type", "owner_id"], "left"
    )
    q = F.col("requested")
    invalid = q.isNull() | (q < 1) | (q > MAX_LINE_QTY)
    missing = F.col("_active").isNull()
    final = F.least(q, F.col("_stock"), F.lit(MAX_LINE_QTY))
    out_of_range = final < 1
    reason = (
        F.when(invalid, REASON_INVALID)
        .when(missing, REASON_NOT_FOUND)
        .when(~F.col("_active"), REASON_INACTIVE)
        .when(out_of_range, REASON_RANGE)
    )
    ok = reason.isNull()
    return rows.select(
        "id",
        "owner_type",
        "owner_id",
        q.cast("int").alias("requested"),
        F.when(~invalid, F.col("old_quantity")).cast("int").alias("old_quantity"),
        F.when(ok, final).cast("int").alias("new_quantity"),
        F.when(ok, ACTION_UPDATE).otherwise(ACTION_REJECT).alias("action"),
        reason.alias("reason"),
    )


def cart_set_quantity_snapshot(t: Tables, requests: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """Cart after ``cart_set_quantity``: accepted updates replace the line's quantity.

    Several accepted requests for one line resolve to the largest requested
    quantity's result (one aggregate per line id, deterministic).
    """
    res = cart_set_quantity(t, requests).filter(F.col("action") == ACTION_UPDATE)
    per_line = res.groupBy("id").agg(F.max_by("new_quantity", F.struct("requested", "new_quantity")).alias("_newq"))
    out = t.cart_items.join(per_line, "id", "left").withColumn("quantity", F.coalesce(F.col("_newq"), F.col("quantity")))
    if now:
        out = out.withColumn(
            "updated_at", F.when(F.col("_newq").isNotNull(), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
        )
    return out.drop("_newq")


def removal_requests(t: Tables) -> DataFrame:
    """Removal requests derived from the carts: owners drop their lines on
    inactive products; guest lines are asked for by the user's customer account."""
    inactive = t.cart_items.join(t.products.filter(~F.col("is_active")).select("product_id"), "product_id", "left_semi")
    own = inactive.select("id", owner_type().alias("owner_type"), owner_id().alias("owner_id"))
    foreign = t.cart_items.filter(F.col("session_id").isNotNull()).select(
        "id", F.lit(OWNER_CUSTOMER).alias("owner_type"), F.substring("session_id", 2, 1 << 20).alias("owner_id")
    )
    return own.unionByName(foreign)


def cart_remove(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Q42: delete lines by (id, owner); each request reports whether a line was removed."""
    if requests is None:
        requests = removal_requests(t)
    found = line_owners(t.cart_items).select("id", "owner_type", "owner_id", F.lit(True).alias("_hit")).distinct()
    rows = requests.select("id", "owner_type", "owner_id").join(found, ["id", "owner_type", "owner_id"], "left")
    hit = F.col("_hit").isNotNull()
    return rows.select(
        "id",
        "owner_type",
        "owner_id",
        hit.alias("removed"),
        F.when(hit, ACTION_REMOVE).otherwise(ACTION_REJECT).alias("action"),
        F.when(~hit, REASON_NOT_FOUND).alias("reason"),
    )


def cart_remove_snapshot(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Cart lines that survive ``cart_remove``."""
    if requests is None:
        requests = removal_requests(t)
    hits = line_owners(t.cart_items).join(requests.select("id", "owner_type", "owner_id"), ["id", "owner_type", "owner_id"], "left_semi")
    return t.cart_items.join(hits.select("id").distinct(), "id", "left_anti")


def _expired(as_of: str, days: int) -> Column:
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.col("customer_id").isNull() & (F.col("updated_at") < cutoff)


def retention_cleanup(t: Tables, as_of: str = AS_OF_CARTS, days: int = RETENTION_DAYS) -> DataFrame:
    """Q43: guest cart lines idle for more than ``days`` are marked expired."""
    return t.cart_items.withColumn("expired", F.coalesce(_expired(as_of, days), F.lit(False)))


def retention_snapshot(t: Tables, as_of: str = AS_OF_CARTS, days: int = RETENTION_DAYS) -> DataFrame:
    """Q43 write path: the cart lines that survive the cleanup."""
    return retention_cleanup(t, as_of, days).filter(~F.col("expired")).drop("expired")


def retention_counts(t: Tables, as_of: str = AS_OF_CARTS, days: int = RETENTION_DAYS) -> DataFrame:
    """Q43 (counts): lines kept and expired."""
    return (
        retention_cleanup(t, as_of, days)
        .groupBy(F.when(F.col("expired"), "expired").otherwise("kept").alias("class"))
        .agg(F.count(F.lit(1)).cast("long").alias("lines"))
    )


def cart_product_popularity(t: Tables) -> DataFrame:
    """Q44: per product, carts holding it and units in carts."""
    owner = F.concat(owner_type(), F.lit(":"), owner_id())
    return t.cart_items.groupBy("product_id").agg(
        F.countDistinct(owner).cast("long").alias("carts"), F.sum("quantity").cast("long").alias("units")
    )

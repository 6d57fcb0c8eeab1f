"""Catalog queries: stock, listing pages, search, product detail, reviews.

Variant-aware stock (Q17) is computed once per product from a single
aggregation of active variants and joined 1:1 to products, instead of the
three correlated sub-queries per product row the shop issues.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import after_row, count_pages, full_name, money, paginate
from ..sources.tables import Tables

# --- fixed values -----------------------------------------------------------
# Storefront sort options (key -> column, ascending?).
SORT_OPTIONS = {
    "newest": ("created_at", False),
    "oldest": ("created_at", True),
    "price-asc": ("price", True),
    "price-desc": ("price", False),
    "name": ("product_name", True),
    "name-desc": ("product_name", False),
}
DEFAULT_SORT = "newest"
# Storefront stock labels and admin stock bands.
LABEL_AVAILABLE = "Disponible"
LABEL_LAST_UNITS = "Últimas {n} unidades"
LABEL_SOLD_OUT = "Agotado"
BAND_OUT = "out-of-stock"
BAND_LOW = "low-stock"
BAND_IN = "in-stock"
# Admin "no upper price bound" sentinel.
ADMIN_MAX_PRICE = 999999
# ---------------------------------------------------------------------------

PRODUCT_COLUMNS = [
    "product_id",
    "product_name",
    "description",
    "category_id",
    "price",
    "wholesale_price",
    "stock",
    "is_active",
    "created_at",
    "image_url",
]


#: Names are ordered linguistically: accents and case decide only between equal letters.
NAME_COLLATION = "UNICODE"


def sort_columns(sort: str) -> list[Column]:
    """Sort option -> ordering, with the key as tie-breaker (PostgreSQL null order)."""
    name, asc = SORT_OPTIONS.get(sort, SORT_OPTIONS[DEFAULT_SORT])
    c = F.collate(F.col(name), NAME_COLLATION) if name == "product_name" else F.col(name)
    return [c.asc_nulls_last() if asc else c.desc_nulls_first(), F.col("product_id").asc()]


def following(rows: DataFrame, sort: str, after: tuple | None) -> DataFrame:
    """Rows beyond ``after`` = (sort value, product_id) of the last row seen; all rows for None."""
    if after is None:
        return rows
    name, asc = SORT_OPTIONS.get(sort, SORT_OPTIONS[DEFAULT_SORT])
    return rows.filter(after_row(name, asc, "product_id", after, NAME_COLLATION if name == "product_name" else None))


def variant_stock(t: Tables) -> DataFrame:
    """(product_id, _vstock, _vcount) over active variants, one row per product."""
    return (
        t.product_variants.filter("is_active")
        .groupBy("product_id")
        .agg(F.sum("stock").alias("_vstock"), F.count(F.lit(1)).alias("_vcount"))
    )


def with_available_stock(products: DataFrame, t: Tables) -> DataFrame:
    """Add ``available_stock`` (Σ active variant stock, else own stock) and ``has_variants``."""
    has = F.col("_vcount").isNotNull()
    return (
        products.join(variant_stock(t), "product_id", "left")
        .withColumn("has_variants", has)
        .withColumn(
            "available_stock",
            F.when(has, F.coalesce(F.col("_vstock"), F.lit(0))).otherwise(F.col("stock")).cast("long"),
        )
        .drop("_vstock", "_vcount")
    )


def _named_products(t: Tables) -> DataFrame:
    """products LEFT JOIN categories (money kept exact)."""
    return t.products.select(*PRODUCT_COLUMNS).join(t.categories.select("category_id", "category_name"), "category_id", "left")


def _page(rows: DataFrame, t: Tables, sort: str, page: int, limit: int, show_all: bool, after: tuple | None = None) -> DataFrame:
    """A sorted page of products, and only then the stock of what is on it."""
    if show_all:
        return with_available_stock(rows, t).orderBy(*sort_columns(sort))
    chosen = paginate(following(rows, sort, after), sort_columns(sort), 1 if after else page, limit)
    # places on the page, to sort by in the end: a sort like the one below could be left out as done
    chosen = chosen.withColumn("_place", F.row_number().over(Window.orderBy(*sort_columns(sort))))
    # at most ``limit`` ids, which the planner knows: variants are filtered by them before they are added up
    ids = chosen.select(F.col("product_id").alias("_id"))
    variants = t.product_variants.join(ids, F.col("product_id") == F.col("_id"), "left_semi")
    return with_available_stock(chosen, t.replace(product_variants=variants)).orderBy("_place").drop("_place")


def _product_out(df: DataFrame) -> DataFrame:
    return df.select(
        *[money(c).alias(c) if c in ("price", "wholesale_price") else F.col(c) for c in PRODUCT_COLUMNS],
        "category_name",
        "available_stock",
        "has_variants",
    )


def available_stock(t: Tables) -> DataFrame:
    """Q17: every product with category name, available stock and has_variants."""
    return _product_out(with_available_stock(_named_products(t), t))


def _catalog_filter(
    df: DataFrame,
    categories: list[str] | None,
    min_price: float,
    max_price: float | None,
) -> DataFrame:
    cond = F.col("is_active")
    if categories:
        cond = cond & F.col("category_name").isin(*categories)
    if min_price and min_price > 0:
        cond = cond & (F.col("price") >= F.lit(min_price))
    if max_price:  # 0 / None means no bound
        cond = cond & (F.col("price") <= F.lit(max_price))
    return df.filter(cond)


def catalog_page(
    t: Tables,
    *,
    categories: list[str] | None = None,
    min_price: float = 0,
    max_price: float | None = None,
    sort: str = DEFAULT_SORT,
    page: int = 1,
    limit: int = 10,
    show_all: bool = False,
    after: tuple | None = None,
) -> DataFrame:
    """Q18: filtered, sorted page of active products.

    ``after`` = (sort value, product_id) of the last row of a page gives the page that
    follows, whatever its number, at the cost of the first.
    """
    rows = _catalog_filter(_named_products(t), categories, min_price, max_price)
    return _product_out(_page(rows, t, sort, page, limit, show_all, after))


def catalog_names(t: Tables, page: int = 2, limit: int = 10) -> DataFrame:
    """Q18 by name, with each row's place in the linguistic order."""
    names = catalog_page(t, sort="name", page=page, limit=limit)
    # one page of rows
    place = F.row_number().over(Window.orderBy(*sort_columns("name"))) + (page - 1) * limit
    return names.withColumn("place", place.cast("int"))


def catalog_count(t: Tables, **filters) -> DataFrame:
    """Q18 total: rows matching the catalog filter (one row), without the stock sub-plan."""
    rows = t.products.join(t.categories.select("category_id", "category_name"), "category_id", "left")
    keep = {k: filters[k] for k in ("categories", "min_price", "max_price") if k in filters}
    return _catalog_filter(rows, keep.get("categories"), keep.get("min_price", 0), keep.get("max_price")).agg(
        F.count(F.lit(1)).cast("long").alias("total")
    )


def slug_map(t: Tables, routes: DataFrame | None = None) -> DataFrame:
    """(route_slug, route_category_name): the route table, or the categories' own slugs."""
    if routes is not None:
        return routes
    return t.categories.select(F.col("slug").alias("route_slug"), F.col("category_name").alias("route_category_name"))


def category_page(
    t: Tables,
    slug: str,
    *,
    routes: DataFrame | None = None,
    min_price: float = 0,
    max_price: float | None = None,
    sort: str = DEFAULT_SORT,
    page: int = 1,
    limit: int = 10,
    show_all: bool = False,
) -> DataFrame:
    """Q19: Q18 restricted to the category a slug resolves to (empty if unknown)."""
    rows = _category_rows(t, slug, routes, min_price, max_price)
    return _product_out(_page(rows, t, sort, page, limit, show_all))


def _category_rows(t: Tables, slug: str, routes: DataFrame | None, min_price: float, max_price: float | None) -> DataFrame:
    names = slug_map(t, routes).filter(F.col("route_slug") == F.lit(slug)).select(
        F.col("route_category_name").alias("category_name")
    )
    return _catalog_filter(_named_products(t), None, min_price, max_price).join(names, "category_name", "left_semi")


def category_total(
    t: Tables, slug: str, *, routes: DataFrame | None = None, min_price: float = 0, max_price: float | None = None, limit: int = 10
) -> DataFrame:
    """Q19: products and pages of a category."""
    return count_pages(_category_rows(t, slug, routes, min_price, max_price), limit)


def search_products(
    t: Tables,
    term: str,
    *,
    category: str | None = None,
    sort: str = DEFAULT_SORT,
    page: int = 1,
    limit: int = 10,
    show_all: bool = False,
) -> DataFrame:
    """Q20: case-insensitive substring search on name or description.

    The term is not escaped: ``%`` and ``_`` act as wildcards (trap S13).
    Price filters do not apply to search.
    """
    return _product_out(_page(_search_rows(t, term, category), t, sort, page, limit, show_all))


def like_pattern(term: str) -> str:
    """``%term%`` with backslashes as PostgreSQL reads them: before any other character they only quote it."""
    return re.sub(r"\\(.)", lambda m: m.group(0) if m.group(1) in "%_\\" else m.group(1), f"%{term}%", flags=re.DOTALL)


def _search_rows(t: Tables, term: str, category: str | None) -> DataFrame:
    term = term.strip()
    if not term:
        raise ValueError("empty search term")
    pattern = F.lower(F.lit(like_pattern(term)))
    cond = F.col("is_active") & (F.like(F.lower("product_name"), pattern) | F.like(F.lower("description"), pattern))
    if category:
        cond = cond & (F.col("category_name") == F.lit(category))
    return _named_products(t).filter(cond)


def search_total(t: Tables, term: str, *, category: str | None = None, limit: int = 10) -> DataFrame:
    """Q20: products and pages a search finds."""
    return count_pages(_search_rows(t, term, category), limit)


def band_of(c: Column) -> Column:
    return F.when(c == 0, BAND_OUT).when((c > 0) & (c < 5), BAND_LOW).when(c >= 5, BAND_IN)


def admin_product_list(
    t: Tables,
    *,
    search: str = "",
    category: str = "",
    status: str = "",
    sort: str = DEFAULT_SORT,
    min_price: float = 0,
    max_price: float = ADMIN_MAX_PRICE,
    stock: str = "",
    page: int = 1,
    limit: int = 10,
    show_all: bool = False,
) -> DataFrame:
    """Q21: admin product list with stock, filters, sort and paging."""
    rows, stocked = _admin_rows(t, search, category, status, min_price, max_price, stock)
    if stocked:  # the stock band decides what is on the page
        page_rows = paginate(rows, sort_columns(sort), page, limit, show_all)
    else:
        page_rows = _page(rows, t, sort, page, limit, show_all)
    return admin_out(page_rows)


def admin_out(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("available_stock", "total_stock").select(
        "product_id",
        "product_name",
        money("price").alias("price"),
        "stock",
        "image_url",
        "is_active",
        "created_at",
        "category_name",
        "total_stock",
        "has_variants",
    )


def _admin_rows(
    t: Tables, search: str, category: str, status: str, min_price: float, max_price: float, stock: str
) -> tuple[DataFrame, bool]:
    """Products of the admin list, and whether they carry their stock (they do when it is filtered on)."""
    rows = t.products.select(
        "product_id", "product_name", "price", "stock", "image_url", "is_active", "created_at", "category_id"
    ).join(t.categories.select("category_id", "category_name"), "category_id", "left")
    cond = F.lit(True)
    if search.strip():
        cond = cond & F.ilike("product_name", F.lit(like_pattern(search.strip())))
    if category:
        cond = cond & (F.col("category_name") == F.lit(category))
    if status == "active":
        cond = cond & F.col("is_active")
    elif status == "inactive":
        cond = cond & ~F.col("is_active")
    if min_price and min_price > 0:
        cond = cond & (F.col("price") >= F.lit(min_price))
    if max_price < ADMIN_MAX_PRICE:
        cond = cond & (F.col("price") <= F.lit(max_price))
    rows = rows.filter(cond)
    if stock in (BAND_OUT, BAND_LOW, BAND_IN):
        return with_available_stock(rows, t).filter(band_of(F.col("available_stock")) == F.lit(stock)), True
    return rows, False


def admin_total(
    t: Tables,
    *,
    search: str = "",
    category: str = "",
    status: str = "",
    min_price: float = 0,
    max_price: float = ADMIN_MAX_PRICE,
    stock: str = "",
    limit: int = 10,
    show_all: bool = False,
) -> DataFrame:
    """Q21: products and pages of the admin list (one page when showing all)."""
    rows, _ = _admin_rows(t, search, category, status, min_price, max_price, stock)
    return count_pages(rows, limit, show_all)


def price_range(t: Tables) -> DataFrame:
    """Q22: min / max price of active products."""
    return t.products.filter("is_active").agg(
        money(F.min("price")).alias("min_price"), money(F.max("price")).alias("max_price")
    )


def price_range_by_category(t: Tables) -> DataFrame:
    """Q22 (grouped form): min / max active price per category name."""
    return (
        t.products.filter("is_active")
        .join(t.categories.select("category_id", "category_name"), "category_id", "left")
        .groupBy("category_name")
        .agg(money(F.min("price")).alias("min_price"), money(F.max("price")).alias("max_price"))
    )


def sample_key(c: Column, seed: int) -> Column:
    """Pseudo-random sort key: another seed gives another order, whatever the ids are."""
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def featured_sample(t: Tables, n: int = 6, seed: int = 42) -> DataFrame:
    """Q23: ``n`` pseudo-random active products; a new seed per request gives a new sample.

    Ordering by a scrambled key is a top-n (per-partition partial, then a
    merge of n rows per partition), never a full sort; the same seed always
    yields the same sample.
    """
    rows = _named_products(t).filter("is_active").orderBy(sample_key(F.col("product_id"), seed), "product_id").limit(n)
    ids = rows.select(F.col("product_id").alias("_id"))
    variants = t.product_variants.join(ids, F.col("product_id") == F.col("_id"), "left_semi")
    return _product_out(with_available_stock(rows, t.replace(product_variants=variants)))


def category_list(t: Tables) -> DataFrame:
    """Q24: all categories in linguistic (UNICODE collation) name order."""
    return t.categories.select("category_id", "category_name", "slug").orderBy(
        F.collate("category_name", "UNICODE"), "category_id"
    )


def products_by_ids(t: Tables, ids: DataFrame | list[int] | None = None) -> DataFrame:
    """Q25: batch lookup of active products by id with their category slug.

    ``ids`` is a frame with a ``product_id`` column (or a list); by default
    the products referenced by carts, which is how the storefront uses it.
    """
    if ids is None:
        ids = t.cart_items.select("product_id")
    elif isinstance(ids, list):
        ids = t.spark.createDataFrame([(int(i),) for i in ids], "product_id long")
    wanted = ids.select(F.col("product_id").cast("long").alias("product_id")).distinct()
    return (
        t.products.filter("is_active")
        .join(wanted, "product_id", "left_semi")
        .join(t.categories.select("category_id", F.col("slug").alias("category_slug")), "category_id", "left")
        .select("product_id", "product_name", money("price").alias("price"), "image_url", "stock", "category_slug")
    )


DETAIL_CHUNK = 1000


def approved_reviews(t: Tables) -> DataFrame:
    """Approved reviews by a known customer, with the customer's name (trap S16)."""
    return (
        t.product_reviews.filter("is_approved")
        .join(t.customers.select("customer_id", full_name().alias("customer_name")), "customer_id")
        .select("product_id", "review_id", "rating", "review_text", "is_verified_purchase", "created_at", "customer_name")
    )


def positions(rows: DataFrame, key: str, bucket: list[Column], order: list[Column]) -> DataFrame:
    """``rows`` with ``position``: the row's 1-based place in its key, by ``bucket``, then ``order``.

    Rows are counted per (key, bucket); running sums of these few counts give each
    bucket its offset, and rows are numbered inside their bucket only. No task holds
    a whole key's rows.
    """
    names = [f"_b{k}" for k in range(len(bucket))]
    rows = rows.withColumns(dict(zip(names, bucket)))
    counts = rows.groupBy(key, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(key).alias("_key"), *(F.col(n).alias(f"{n}o") for n in names), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    same = [F.col(key) == F.col("_key"), *(F.col(n).eqNullSafe(F.col(f"{n}o")) for n in names)]
    inside = F.row_number().over(Window.partitionBy(key, *names).orderBy(*order))
    numbered = rows.withColumn("_i", inside).join(offsets, same)
    return numbered.withColumn("position", F.col("_offset") + F.col("_i")).drop("_key", "_offset", "_i", *names, *(f"{n}o" for n in names))


def chunked_lists(rows: DataFrame, key: str, item: Column, chunk: int, name: str) -> DataFrame:
    """(key, part, name): rows with ``position`` as arrays of ``chunk``; part p holds places p * chunk + 1 and on,
    so the parts one after the other are the whole list in order."""
    part = F.floor((F.col("position") - 1) / F.lit(chunk)).cast("long")
    placed = rows.select(key, part.alias("part"), F.struct(F.col("position").alias("k"), item.alias("v")).alias("_e"))
    lists = placed.groupBy(key, "part").agg(F.array_sort(F.collect_list("_e")).alias("_l"))
    return lists.select(key, "part", F.transform("_l", lambda e: e["v"]).alias(name))


def product_detail_parts(t: Tables, chunk: int = DETAIL_CHUNK, ids: DataFrame | None = None) -> DataFrame:
    """Q26: per active product a product struct, its active variants and approved reviews.

    Variants are ordered by (size, color) with NULLs last, reviews newest first
    (ties: higher review id first). A row holds at most ``chunk`` entries of either
    list: part 0 the first ones, part 1 the next, and so on; every product has a
    part 0. ``ids`` (a frame with ``product_id``) restricts it to some products.
    """
    products, variants_of, reviews_of = t.products.filter("is_active"), t.product_variants.filter("is_active"), t.product_reviews
    if ids is not None:
        wanted = ids.select(F.col("product_id").cast("long").alias("_id")).distinct()
        products, variants_of, reviews_of = (
            df.join(wanted, F.col("product_id") == F.col("_id"), "left_semi") for df in (products, variants_of, reviews_of)
        )
    product = products.join(
        t.categories.select("category_id", "category_name", F.col("slug").alias("category_slug")), "category_id", "left"
    ).select(
        "product_id",
        F.struct(
            *[money(c).alias(c) if c in ("price", "wholesale_price") else F.col(c) for c in PRODUCT_COLUMNS],
            "category_name",
            "category_slug",
        ).alias("product"),
    )
    variant = F.struct(
        "variant_id", "variant_name", "sku", "size", "color", "material",
        money("additional_price").alias("additional_price"), "stock", "is_active",
    )
    looks = [F.col("size").isNull(), F.col("size"), F.col("color").isNull(), F.col("color")]
    variants = chunked_lists(positions(variants_of, "product_id", looks, [F.col("variant_id")]), "product_id", variant, chunk, "variants")
    review = F.struct("review_id", "rating", "review_text", "is_verified_purchase", "created_at", "customer_name")
    # newest first: by hours back from the year 2200, then by time and id
    hour = [F.timestamp_diff("HOUR", F.date_trunc("hour", "created_at").cast("timestamp_ntz"), F.lit("2200-01-01").cast("timestamp_ntz"))]
    newest = [F.col("created_at").desc(), F.col("review_id").desc()]
    reviews = chunked_lists(
        positions(approved_reviews(t.replace(product_reviews=reviews_of)), "product_id", hour, newest), "product_id", review, chunk, "reviews"
    )
    lists = variants.join(reviews, ["product_id", "part"], "full")
    first = product.select("product_id", F.lit(0).cast("long").alias("part"))
    parts = first.join(lists, ["product_id", "part"], "full")
    empty_v = F.array().cast(variants.schema["variants"].dataType)
    empty_r = F.array().cast(reviews.schema["reviews"].dataType)
    return product.join(parts, "product_id").select(
        "product_id",
        "part",
        "product",
        F.coalesce(F.col("variants"), empty_v).alias("variants"),
        F.coalesce(F.col("reviews"), empty_r).alias("reviews"),
    )


def product_detail(t: Tables, chunk: int = DETAIL_CHUNK) -> DataFrame:
    """Q26 flat: the product's columns, and per part its lists as JSON text."""
    from ..sinks.files import JSON_OPTIONS

    rows = product_detail_parts(t, chunk)
    text = lambda c: F.when(F.size(c) > 0, F.to_json(c, JSON_OPTIONS)).otherwise("[]")
    return rows.select("product.*", "part", text("variants").alias("variants"), text("reviews").alias("reviews"))


def product_facets(t: Tables) -> DataFrame:
    """Q27: distinct non-empty sizes / colours / materials of active variants, sorted, as text."""

    def facet(c: str) -> Column:
        v = F.col(c)
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(v.isNotNull() & (v != ""), v))))

    return (
        t.products.filter("is_active")
        .select("product_id")
        .join(t.product_variants.filter("is_active"), "product_id")
        .groupBy("product_id")
        .agg(facet("size").alias("sizes"), facet("color").alias("colors"), facet("material").alias("materials"))
    )


def half_up_1dp(total: Column, n: Column) -> Column:
    """round(total / n, 1) half-up, exact for integer totals."""
    a = (total * 20 + n).cast("long")
    b = (n * 2).cast("long")
    return F.when(n > 0, ((a - F.pmod(a, b)) / b).cast("long") / F.lit(10.0))


def product_ratings(t: Tables) -> DataFrame:
    """Q28: approved-review count and 1-dp average rating per product (0 if none)."""
    stats = approved_reviews(t).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("review_count"), F.sum("rating").alias("_sum")
    )
    return t.products.select("product_id").join(stats, "product_id", "left").select(
        "product_id",
        F.coalesce(F.col("review_count"), F.lit(0)).cast("long").alias("review_count"),
        F.coalesce(half_up_1dp(F.col("_sum"), F.col("review_count")), F.lit(0.0)).alias("average_rating"),
    )


def latest_reviews(t: Tables, n: int = 3) -> DataFrame:
    """Q29: newest ``n`` approved reviews per product (ties: higher review id first, as in the detail).

    ``row_number() <= n`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so even a product with a huge share of reviews sends
    at most n rows per map task to its window task.
    """
    w = Window.partitionBy("product_id").orderBy(F.col("created_at").desc(), F.col("review_id").desc())
    return (
        approved_reviews(t)
        .select("product_id", "review_id", "rating", "created_at")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= n)
    )


def stock_label(t: Tables) -> DataFrame:
    """Q30: storefront stock label from available stock."""
    s = F.col("available_stock")
    label = (
        F.when(s > 10, LABEL_AVAILABLE)
        .when(s > 0, F.replace(F.lit(LABEL_LAST_UNITS), F.lit("{n}"), s.cast("string")))
        .otherwise(LABEL_SOLD_OUT)
    )
    return with_available_stock(t.products.select("product_id", "stock"), t).select(
        "product_id", "available_stock", label.alias("label")
    )


def stock_band(t: Tables) -> DataFrame:
    """Q31: admin stock band per product."""
    return with_available_stock(t.products.select("product_id", "stock"), t).select(
        "product_id", F.col("available_stock").alias("total_stock"), band_of(F.col("available_stock")).alias("band")
    )


def stock_band_counts(t: Tables) -> DataFrame:
    """Q31 (grouped): products per stock band."""
    return stock_band(t).groupBy("band").agg(F.count(F.lit(1)).cast("long").alias("products"))


def product_detail_json(t: Tables, chunk: int = DETAIL_CHUNK) -> DataFrame:
    """Q26 as the JSON documents the storefront serves, one line per detail row."""
    from ..sinks import json_lines

    return json_lines(product_detail_parts(t, chunk))

"""Tables built once and read by many requests: a search index, rank directories, and bitmaps of customers.

Each is written with ``build_*`` to a folder and read back by its query; partitions of
the folder are what a query prunes by.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import not_cancelled
from ..sources.tables import Tables
from .catalog import ADMIN_MAX_PRICE, _admin_rows, _named_products, _page, _product_out, admin_out, like_pattern, sort_columns
from .reports import customer_lifetime_value

# --- search index -----------------------------------------------------------

#: Longest run of characters that is posted.
GRAM = 3
GRAM_BUCKETS, PRODUCT_BUCKETS = 64, 64


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - (n - 1))
    found = F.transform(places, lambda k: F.substring(text, k, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def build_search_index(t: Tables, path: str, gram_buckets: int = GRAM_BUCKETS, product_buckets: int = PRODUCT_BUCKETS) -> None:
    """Write the index: ``postings`` (gram, field, product_id) in folders by gram bucket, ``products`` in folders by id bucket.

    Posted are the runs of 1, 2 and 3 characters of the lower-cased name and description of
    every active product. A posting list is spread over files by the writer, so that a
    common gram is no single task's.
    """
    rows = _named_products(t).filter("is_active")
    fields = F.array(F.struct(F.lit(0).alias("field"), F.lower("product_name").alias("text")), F.struct(F.lit(1).alias("field"), F.lower("description").alias("text")))
    texts = rows.select("product_id", F.explode(fields).alias("f")).select("product_id", "f.*").filter(F.col("text").isNotNull())
    every = reduce(F.concat, [_grams(F.col("text"), n) for n in range(1, GRAM + 1)])
    postings = texts.select("product_id", "field", F.explode(every).alias("gram")).withColumn("gram_bucket", _bucket(F.col("gram"), gram_buckets))
    postings.repartition("gram_bucket", F.pmod(F.xxhash64("gram", "product_id"), F.lit(8))).sortWithinPartitions("gram_bucket", "gram").write.mode("overwrite").partitionBy("gram_bucket").parquet(f"{path}/postings")
    kept = rows.withColumn("id_bucket", _bucket(F.col("product_id"), product_buckets))
    kept.repartition("id_bucket").write.mode("overwrite").partitionBy("id_bucket").parquet(f"{path}/products")


def literal_parts(pattern: str) -> list[str]:
    """The runs of ordinary characters in a LIKE pattern."""
    parts, now, quoted = [], "", False
    for c in pattern:
        if quoted:
            now, quoted = now + c, False
        elif c == "\\":
            quoted = True
        elif c in "%_":
            parts, now = [*parts, now], ""
        else:
            now += c
    return [p for p in [*parts, now] if p]


def search_candidates(spark: SparkSession, path: str, term: str, gram_buckets: int = GRAM_BUCKETS) -> DataFrame | None:
    """(product_id) of the products one of whose fields has every gram of the term's literal parts; None if it has no such part."""
    parts = literal_parts(like_pattern(term))
    if not parts:
        return None
    lowered = spark.createDataFrame([(p,) for p in parts], "part string").select(F.lower("part")).collect()  # a handful
    grams = sorted({p[k : k + n] for (p,) in lowered for n in [min(GRAM, len(p))] for k in range(len(p) - n + 1)})
    one_row = spark.createDataFrame([(g,) for g in grams], "g string").select("g", _bucket(F.col("g"), gram_buckets).alias("b")).collect()
    posted = spark.read.parquet(f"{path}/postings").filter(F.col("gram_bucket").isin(*sorted({r.b for r in one_row})) & F.col("gram").isin(*grams))
    complete = posted.groupBy("product_id", "field").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return complete.select("product_id").distinct()


def search_indexed(t: Tables, path: str, term: str, *, sort: str = "newest", page: int = 1, limit: int = 10, show_all: bool = False, product_buckets: int = PRODUCT_BUCKETS) -> DataFrame:
    """Q20 from the index: the grams' postings are intersected, and what is left is verified by LIKE.

    Only the folders of the term's grams are read, and products by the candidates' id
    buckets (dynamic partition pruning). A term without an ordinary character is
    answered from all products.
    """
    term = term.strip()
    if not term:
        raise ValueError("empty search term")
    rows = t.spark.read.parquet(f"{path}/products")
    found = search_candidates(t.spark, path, term)
    if found is not None:
        ids = found.select(F.col("product_id").alias("_id"), _bucket(F.col("product_id"), product_buckets).alias("_b"))
        rows = rows.join(ids, (F.col("id_bucket") == F.col("_b")) & (F.col("product_id") == F.col("_id")), "left_semi")
    pattern = F.lower(F.lit(like_pattern(term)))
    rows = rows.filter(F.like(F.lower("product_name"), pattern) | F.like(F.lower("description"), pattern)).drop("id_bucket")
    return _product_out(_page(rows, t, sort, page, limit, show_all))


def indexed_search(t: Tables, path: str, term: str) -> DataFrame:
    """Q20 with its index built first: all products that the term finds."""
    build_search_index(t, path)
    return search_indexed(t, path, term, show_all=True)


# --- rank directory ---------------------------------------------------------

#: Rows that a range of the directory aims at.
RANGE_ROWS = 500


def build_rank_directory(rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> None:
    """Write ``rows`` in folders by range of the order, and ``ranges``: the rows before each range.

    One range shuffle and a sort inside each range; the running sum is over one count a
    range.
    """
    if ranges is None:
        ranges = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    counts = rows.sparkSession.read.parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts.select("_range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def ranked_page(spark: SparkSession, path: str, order: list[Column], page: int, limit: int) -> DataFrame:
    """Page ``page`` (1-based) of a directory: the ranges it lies in are read and sorted, none before them."""
    offset = (page - 1) * limit
    if limit < 0 or offset < 0:
        raise ValueError(f"page must be >= 1 and limit >= 0, got {page}, {limit}")
    touched = spark.read.parquet(f"{path}/ranges").filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    found = touched.orderBy("_range").collect()  # the ranges of one page
    if not found:
        return spark.read.parquet(f"{path}/rows").drop("_range").limit(0)
    here = spark.read.parquet(*(f"{path}/rows/_range={r['_range']}" for r in found))
    return here.orderBy(*order).offset(offset - found[0]["before"]).limit(limit)


def build_catalog_directory(t: Tables, path: str, sort: str = "price-asc", ranges: int | None = None) -> None:
    """The directory of all active products in one of the catalog's orders."""
    build_rank_directory(_named_products(t).filter("is_active"), sort_columns(sort), path, ranges)


def catalog_deep_page(t: Tables, path: str, sort: str = "price-asc", page: int = 1, limit: int = 10) -> DataFrame:
    """Q18 from the directory: the page's products, and the stock of those alone."""
    rows = ranked_page(t.spark, path, sort_columns(sort), page, limit)
    return _product_out(_page(rows, t, sort, 1, limit, False))


def directory_page(t: Tables, path: str, sort: str = "price-asc", page: int = 8, limit: int = 20) -> DataFrame:
    """Q18: a deep page, the directory built first."""
    build_catalog_directory(t, path, sort)
    return catalog_deep_page(t, path, sort, page, limit)


def clv_order() -> list[Column]:
    return [F.col("lifetime_value").desc_nulls_last(), F.col("customer_id").asc()]


def clv_directory_page(t: Tables, path: str, page: int = 20, limit: int = 20) -> DataFrame:
    """Q35: a deep page of the lifetime-value report, the directory built first."""
    build_rank_directory(customer_lifetime_value(t), clv_order(), path)
    return ranked_page(t.spark, path, clv_order(), page, limit)


def admin_directory_page(t: Tables, path: str, sort: str = "name", page: int = 8, limit: int = 20) -> DataFrame:
    """Q21 without filters: a deep page of the admin list, the directory built first."""
    rows, _ = _admin_rows(t, "", "", "", 0, ADMIN_MAX_PRICE, "")
    build_rank_directory(rows, sort_columns(sort), path)
    return admin_out(_page(ranked_page(t.spark, path, sort_columns(sort), page, limit), t, sort, 1, limit, False))


# --- bitmaps ----------------------------------------------------------------


def customer_bitmaps(orders: DataFrame) -> DataFrame:
    """(month, bucket, bitmap): the customers with a non-cancelled order in each month, 32,768 to a bucket.

    Bits are set before the shuffle, so a month's orders send one bitmap of 4 KB for each
    bucket and task, however many there are. Rows of months or tasks merge by OR; the table
    can be kept and added to. It pays where customers are many to a bucket: if a task
    sees fewer than some 250 of a bucket in a month, the pairs themselves are smaller
    (``monthly_revenue`` counts those).
    """
    rows = orders.filter(not_cancelled() & F.col("customer_id").isNotNull())
    month = F.trunc("order_date", "month").cast("timestamp_ntz").alias("month")
    return rows.groupBy(month, F.bitmap_bucket_number("customer_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("customer_id")).alias("bitmap"))


def distinct_customers(bitmaps: DataFrame, period: Column) -> DataFrame:
    """Exact number of customers by period: bitmaps of a bucket are united, then their bits counted."""
    united = bitmaps.groupBy(period.alias("period"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return united.groupBy("period").agg(F.sum(F.bitmap_count("bitmap")).cast("long").alias("customers"))


def active_customers(t: Tables) -> DataFrame:
    """Customers with a non-cancelled order, each counted once, by month, quarter, year and in all, from one table of bitmaps."""
    bitmaps = customer_bitmaps(t.orders)
    kinds = {"month": F.col("month"), "quarter": F.trunc("month", "quarter").cast("timestamp_ntz"), "year": F.trunc("month", "year").cast("timestamp_ntz"), "all": F.lit(None).cast("timestamp_ntz")}
    periods = F.array(*(F.struct(F.lit(kind).alias("kind"), start.alias("start")) for kind, start in kinds.items()))
    spread = bitmaps.withColumn("p", F.explode(periods))
    return distinct_customers(spread, F.col("p")).select(F.col("period.kind").alias("kind"), F.col("period.start").alias("start"), "customers")

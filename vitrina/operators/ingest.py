"""Ingest jobs: validating product and customer input, applying product
change sets, linking external identities, slugs.

Every job takes a batch frame and returns one result row per input row (or
per key) with a status and a reason, instead of failing on the first bad
row. Registered instances derive their batch from the shop tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import money
from ..session import checkpointed
from ..sources import literals
from ..sources.tables import Tables

# --- fixed values -----------------------------------------------------------
ACCEPTED = "accepted"
REJECTED = "rejected"
REASON_REQUIRED = "name, price and category are required"
REASON_PRICE = "invalid price"
REASON_CATEGORY = "invalid category"
REASON_NEGATIVE = "negative price or stock"
PROVIDERS = ("google", "facebook")
REASON_FIELDS = "all fields are required"
REASON_EMAIL = "invalid email"
REASON_PASSWORD_MATCH = "passwords do not match"
REASON_PASSWORD_SHORT = "password shorter than 8 characters"
REASON_EMAIL_TAKEN = "email already registered"
REASON_BATCH_DUP = "email repeated in batch"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
MIN_PASSWORD = 8
# Accent folding of the product slug rule (vowels only, as the shop does).
ACCENTED = "áàäâéèëêíìïîóòöôúùüû"
FOLDED = "aaaaeeeeiiiioooouuuu"
# ---------------------------------------------------------------------------


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def product_form_batch(t: Tables) -> DataFrame:
    """Product form posts derived from the catalog: every product re-submitted
    as text, stock shifted by -5 (so small sizes post a negative stock)."""
    return t.products.select(
        F.col("product_id").alias("form_id"),
        "product_name",
        F.concat(F.lit("  "), F.col("description"), F.lit(" ")).alias("description"),
        F.col("price").cast("string").alias("price"),
        (F.col("stock") - 5).cast("string").alias("stock"),
        F.col("category_id").cast("string").alias("category_id"),
        F.when(F.col("is_active"), F.lit("true")).alias("is_active"),
        F.when(F.col("stock") % 2 == 0, F.col("image_url")).otherwise(F.lit(" ")).alias("image_url"),
    )


def _form_values() -> dict[str, Column]:
    """The columns a product form sets, as the shop stores them (see ``clean_products``)."""
    image = F.trim(F.col("image_url"))
    return {
        "product_name": F.trim(F.col("product_name")),
        "description": F.coalesce(F.trim(F.col("description")), F.lit("")),
        "price": F.trim(F.col("price")).try_cast("decimal(10,2)"),
        "stock": F.coalesce(F.trim(F.col("stock")).try_cast("int"), F.lit(0)),
        "category_id": F.trim(F.col("category_id")).try_cast("int"),
        "is_active": F.coalesce(F.col("is_active") == "true", F.lit(False)),
        "image_url": F.when(image != "", image),
    }


def clean_products(t: Tables, batch: DataFrame | None = None) -> DataFrame:
    """Q50: validate and normalise product form input.

    Required: name, price, category (a missing or zero price counts as
    missing, trap S19); price and category must parse completely (no numeric
    prefixes); stock defaults to 0; description trimmed or ''; image trimmed
    or NULL; ``is_active`` is true only for 'true'. An unknown category breaks the
    foreign key, a negative price or stock the table's CHECK: both are rejected.
    """
    if batch is None:
        batch = product_form_batch(t)
    values = _form_values()
    price, cat, stock = values["price"], values["category_id"], values["stock"]
    known = t.categories.select(F.col("category_id").alias("_known")).distinct()
    batch = batch.join(known, cat == F.col("_known"), "left")
    missing = _blank(F.col("product_name")) | _blank(F.col("price")) | _blank(F.col("category_id")) | (price == 0) | (cat == 0)
    reason = (
        F.when(missing, REASON_REQUIRED)
        .when(price.isNull(), REASON_PRICE)
        .when(cat.isNull(), REASON_CATEGORY)
        .when(F.col("_known").isNull(), REASON_CATEGORY)
        .when((price < 0) | (stock < 0), REASON_NEGATIVE)
    )
    return batch.select(
        "form_id",
        *((money(c) if name == "price" else c).alias(name) for name, c in values.items()),
        F.when(reason.isNull(), ACCEPTED).otherwise(REJECTED).alias("status"),
        reason.alias("reason"),
    )


#: Columns that a product update or creation sets.
PRODUCT_VALUES = ["product_name", "description", "price", "stock", "category_id", "is_active", "image_url"]


def product_change_batch(t: Tables) -> DataFrame:
    """Change set derived from the catalog, in order of ``seq``: products that never
    sold are deleted, accepted form posts update their product or, for every eleventh,
    create a copy under a new id, some copies are updated, every seventh product is
    deleted afterwards, and some changes are for products that do not exist."""
    forms = clean_products(t).filter(F.col("status") == ACCEPTED)
    key = F.col("form_id")
    values = [F.col(c).cast("decimal(10,2)").alias(c) if c == "price" else F.col(c) for c in PRODUCT_VALUES]

    def post(op: str, seq: int, shift: int, wanted: Column) -> Column:
        return F.when(wanted, F.struct(F.lit(op).alias("op"), F.lit(seq).alias("seq"), F.lit(shift).alias("shift")))

    # a form is validated once and may come several times
    posts = F.array(
        post("update", 1, 10_000_000, key % 22 == 0),  # before the copy is there
        post("update", 2, 0, F.lit(True)),
        post("insert", 2, 10_000_000, key % 11 == 0),
        post("update", 3, 10_000_000, key % 33 == 0),
        post("update", 2, 20_000_000, key % 50 == 0),
    )
    posted = forms.select(key, *values, F.explode(F.array_compact(posts)).alias("p")).select((key + F.col("p.shift")).alias("product_id"), "p.op", "p.seq", *PRODUCT_VALUES)

    def deletes(ids: DataFrame, seq: int) -> DataFrame:
        return ids.select("product_id", F.lit("delete").alias("op"), F.lit(seq).alias("seq"))

    sold = t.order_items.select("product_id").distinct()
    parts = [posted, deletes(t.products.join(sold, "product_id", "left_anti"), 1), deletes(t.products.filter(F.col("product_id") % 7 == 0), 4)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def apply_product_changes(t: Tables, changes: DataFrame | None = None) -> DataFrame:
    """Q51: the effect of a change set, as if its changes came one after the other by ``seq``.

    A product that is not there is born with its first ``insert``; what comes before
    that is not found. The latest update or insert gives all columns, the latest
    operation whether the product is active (a delete only deactivates). An insert of
    a product that is there is ignored. Changes of equal ``seq``: a delete is the last.
    """
    if changes is None:
        changes = product_change_batch(t)
    current = t.products.select(F.col("product_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in PRODUCT_VALUES))
    births = changes.filter(F.col("op") == "insert").groupBy(F.col("product_id").alias("_born")).agg(F.min("seq").alias("_birth"))
    is_insert = F.col("op") == "insert"
    rows = changes.join(births, F.col("product_id") == F.col("_born"), "left")
    # what has an effect if the product is there, and if it is not: the products are met once, by the result
    born = F.coalesce((F.col("seq") > F.col("_birth")) | ((F.col("seq") == F.col("_birth")) & (is_insert | (F.col("op") == "delete"))), F.lit(False))
    order = F.struct("seq", (F.col("op") == "delete").cast("int"), (F.col("op") == "update").cast("int"), F.xxhash64(*PRODUCT_VALUES))

    def effects(effective: Column, name: str) -> list[Column]:
        writes = effective & (F.col("op") != "delete")
        return [
            F.max_by("op", F.when(effective, order)).alias(f"op_{name}"),
            F.max_by(F.struct(*PRODUCT_VALUES), F.when(writes, order)).alias(f"w_{name}"),
            F.count(F.when(writes, 1)).alias(f"writes_{name}"),
            F.count(F.when(effective, 1)).alias(f"effects_{name}"),
        ]

    latest = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("changes"), *effects(~is_insert, "old"), *effects(born, "new"))
    exists = F.col("_id").isNotNull()
    either = lambda name: F.when(exists, F.col(f"{name}_old")).otherwise(F.col(f"{name}_new"))
    out = latest.join(current, F.col("product_id") == F.col("_id"), "left").withColumns(
        {"_existed": exists, "op": either("op"), "w": either("w"), "_writes": either("writes"), "_effects": either("effects")}
    )
    deleted = F.col("op") == "delete"

    def value(c: str) -> Column:
        v = F.when(F.col("_writes") > 0, F.col(f"w.{c}")).otherwise(F.col(f"_{c}"))
        return F.when(deleted, F.lit(False)).otherwise(v) if c == "is_active" else v

    found = F.col("_effects") > 0
    return out.select(
        "product_id",
        F.when(found, F.col("op")).alias("op"),
        "changes",
        F.when(~found, "not found").when(deleted, "deleted").when(F.col("_existed"), "updated").otherwise("created").alias("result"),
        *(F.when(found, money(value(c)) if c == "price" else value(c)).alias(c) for c in PRODUCT_VALUES),
    )


def product_snapshot_after_changes(t: Tables, changes: DataFrame | None = None) -> DataFrame:
    """Products with the change set applied: changed ones replaced, created ones added."""
    res = apply_product_changes(t, changes).filter(F.col("result") != "not found")
    res = res.select(F.col("product_id").alias("_id"), F.col("price").cast("decimal(10,2)").alias("_price"), *(F.col(c).alias(f"_{c}") for c in PRODUCT_VALUES if c != "price"))
    p = t.products.join(res, F.col("product_id") == F.col("_id"), "full")
    touched = F.col("_id").isNotNull()
    columns = {c: F.when(touched, F.col(f"_{c}")).otherwise(F.col(c)) for c in PRODUCT_VALUES}
    columns["product_id"] = F.coalesce("product_id", "_id")
    return p.select(*(columns.get(c, F.col(c)).alias(c) for c in t.products.columns))


def registration_batch(t: Tables) -> DataFrame:
    """Registrations derived from the shop, in order of ``arrival``: guest checkouts
    register with their guest name and e-mail, some with a missing, short or mistyped
    password; every third tries again in capitals; and customers sign up again."""
    guests = t.orders.filter(F.col("customer_id").isNull())
    number = F.col("order_id")
    good = F.concat(F.lit("secret-"), number.cast("string"), F.lit("-word"))
    password = F.when(number % 9 == 1, F.lit(None)).when(number % 9 == 2, "short").otherwise(good)
    confirm = F.when(number % 9 == 4, "other").when(number % 9 == 5, F.lit(None)).otherwise(password)
    name = lambda k: F.split_part(F.col("guest_name"), F.lit(" "), F.lit(k))
    first = guests.select(
        F.concat(F.lit("o"), number.cast("string")).alias("request_id"),
        number.alias("arrival"),
        name(1).alias("first_name"),
        name(2).alias("last_name"),
        F.concat(F.lit(" "), F.col("guest_email")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        password.alias("password"),
        confirm.alias("password_confirm"),
    )
    retry = guests.filter(number % 3 == 0).select(
        F.concat(F.lit("p"), number.cast("string")).alias("request_id"),
        (number + 1_000_000_000_000).alias("arrival"),
        F.lit("Guest").alias("first_name"),
        number.cast("string").alias("last_name"),
        F.upper("guest_email").alias("email"),
        F.lit("555").alias("phone"),
        good.alias("password"),
        good.alias("password_confirm"),
    )
    again = t.customers.select(
        F.concat(F.lit("c"), F.col("customer_id").cast("string")).alias("request_id"),
        (F.col("customer_id") + 2_000_000_000_000).alias("arrival"),
        "first_name",
        "last_name",
        F.upper("email").alias("email"),
        "phone",
        F.lit("long enough").alias("password"),
        F.lit("long enough").alias("password_confirm"),
    )
    return first.unionByName(retry).unionByName(again)


def clean_customers(t: Tables, batch: DataFrame | None = None) -> DataFrame:
    """Q52: registrations in order of arrival: trim, lower-case e-mail, required
    fields, e-mail pattern, password rules, e-mail already registered.

    The first valid request of an e-mail creates the account; later valid ones find it
    registered ("repeated in batch"). A batch without password columns is not checked
    for them; one without ``arrival`` is ordered by request id.
    """
    if batch is None:
        batch = registration_batch(t)

    def clean(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)), F.lit(""))

    has_password = "password" in batch.columns
    at = F.col("arrival").cast("long") if "arrival" in batch.columns else F.lit(0).cast("long")
    rows = batch.select(
        "request_id",
        at.alias("_at"),
        clean("first_name").alias("first_name"),
        clean("last_name").alias("last_name"),
        F.lower(clean("email")).alias("email"),
        clean("phone").alias("phone"),
        *(["password", "password_confirm"] if has_password else []),
    )
    required = (F.col("first_name") == "") | (F.col("last_name") == "") | (F.col("email") == "")
    if has_password:
        required = required | _blank(F.col("password"))
    reason = F.when(required, REASON_FIELDS).when(~F.col("email").rlike(EMAIL_PATTERN), REASON_EMAIL)
    if has_password:
        reason = reason.when(~F.col("password").eqNullSafe(F.col("password_confirm")), REASON_PASSWORD_MATCH).when(
            F.length("password") < MIN_PASSWORD, REASON_PASSWORD_SHORT
        )
    rows = rows.withColumn("_invalid", reason).withColumn("_email", F.when(F.col("_invalid").isNull(), F.col("email")))
    # only valid requests look for their e-mail: blank and broken ones have no key to meet on
    valid = rows.filter(F.col("_email").isNotNull())
    first = valid.groupBy(F.col("_email").alias("_e")).agg(F.min(F.struct("_at", "request_id")).alias("_first"))
    taken = t.customers.select(F.lower("email").alias("_t")).distinct()
    rows = rows.join(taken, F.col("_email") == F.col("_t"), "left").join(first, F.col("_email") == F.col("_e"), "left")
    reason = (
        F.when(F.col("_invalid").isNotNull(), F.col("_invalid"))
        .when(F.col("_t").isNotNull(), REASON_EMAIL_TAKEN)
        .when(F.struct("_at", "request_id") != F.col("_first"), REASON_BATCH_DUP)
    )
    return rows.select(
        "request_id",
        "first_name",
        "last_name",
        "email",
        F.when(F.col("phone") != "", F.col("phone")).alias("phone"),
        F.when(reason.isNull(), ACCEPTED).otherwise(REJECTED).alias("status"),
        reason.alias("reason"),
    )


def oauth_login_batch(t: Tables) -> DataFrame:
    """OAuth logins derived from the shop, in order of ``arrival``.

    Every customer signs in with Google (its stored id, or a fresh one; e-mail
    upper-cased), every fourth then with another id and with the first again. That other
    id, free again, comes back with the next customer's e-mail and moves there; later it
    is used with the first e-mail once more. Some logins bring no e-mail, with ids that
    are held and with ids that aren't. Guest e-mails sign in with Facebook, some repeat
    the login, some come back with Google."""
    c, number = t.customers, F.col("customer_id")
    own = F.coalesce(F.col("google_id"), F.concat(F.lit("new-g"), number.cast("string")))
    none = F.lit(None).cast("string")

    def customer(step: int, provider_id: Column, wanted: Column, email: Column | None = None) -> DataFrame:
        return c.filter(wanted).select(
            (number + step * 1_000_000_000_000).alias("arrival"), F.lit("google").alias("provider"), provider_id.alias("provider_id"),
            (F.upper("email") if email is None else email).alias("email"), F.col("first_name").alias("given_name"), F.col("last_name").alias("family_name"),
        )

    guests, order = t.orders.filter(F.col("customer_id").isNull()), F.col("order_id")

    def guest(step: int, provider: str, wanted: Column, prefix: str | None = None, email: Column | None = None) -> DataFrame:
        return guests.filter(wanted).select(
            (order + step * 1_000_000_000_000).alias("arrival"), F.lit(provider).alias("provider"),
            F.concat(F.lit(prefix or provider[0] + "b-"), order.cast("string")).alias("provider_id"), (F.col("guest_email") if email is None else email).alias("email"),
            F.split_part(F.col("guest_name"), F.lit(" "), F.lit(1)).alias("given_name"),
            F.split_part(F.col("guest_name"), F.lit(" "), F.lit(2)).alias("family_name"),
        )

    other = F.concat(F.lit("other-g"), number.cast("string"))
    before = F.concat(F.lit("other-g"), (number - 1).cast("string"))
    parts = [
        customer(0, own, F.lit(True)), guest(1, "facebook", F.lit(True)), guest(2, "google", order % 5 == 0),
        guest(3, "facebook", order % 7 == 0), customer(4, other, number % 4 == 0), customer(5, own, number % 4 == 0),
        customer(6, before, number % 8 == 1), customer(7, own, number % 8 == 1, none), customer(8, before, number % 8 == 1, none),
        customer(9, other, number % 8 == 0), guest(10, "google", order % 11 == 0, "gx-", none),
    ]
    return reduce(DataFrame.unionByName, parts)


def _arrival(logins: DataFrame) -> Column:
    return F.col("arrival").cast("long") if "arrival" in logins.columns else F.xxhash64("provider", "provider_id", "email")


def _login_events(t: Tables, logins: DataFrame) -> DataFrame:
    """Logins (equal ones counted) and, before all of them, the ids that customers store.

    ``account``: the customer of the e-mail (the lowest id), else the e-mail itself, else
    null. ``at``: the place in time.
    """
    rows = logins.select(_arrival(logins).alias("_at"), "provider", "provider_id", "email").groupBy("_at", "provider", "provider_id", "email").agg(F.count("*").alias("times"))
    c = t.customers
    by_email = c.groupBy(F.lower("email").alias("_e")).agg(F.min("customer_id").alias("_owner"))
    account = F.coalesce(F.concat(F.lit("c:"), F.col("_owner").cast("string")), F.concat(F.lit("e:"), F.lower("email")))
    rows = rows.join(by_email, F.lower("email") == F.col("_e"), "left").select(
        "provider", "provider_id", account.alias("account"), F.struct(F.lit(1).alias("k"), "_at", "provider_id", "email").alias("at"), "times"
    )
    start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("_at"), F.col("provider_id"), F.lit(None).cast("string").alias("email"))
    stored = [
        c.filter(F.col(f"{p}_id").isNotNull())
        .groupBy(F.lit(p).alias("provider"), F.col(f"{p}_id").alias("provider_id"))
        .agg(F.concat(F.lit("c:"), F.min("customer_id").cast("string")).alias("account"))
        .select("provider", "provider_id", "account", start.alias("at"), F.lit(0).cast("long").alias("times"))
        for p in PROVIDERS
    ]
    return reduce(DataFrame.union, stored, rows)


def _held_round(events: DataFrame) -> DataFrame:
    """One round: ``puts`` (does the login put its id into its account?) anew from the ``puts`` of earlier events.

    An id is held from the event that puts it into an account until another id is put there.
    """
    # without an account nothing is put, and a null id is never found: those rows are spread
    mine = F.when(F.col("account").isNull(), F.col("provider_id"))
    later = Window.partitionBy("provider", "account", mine).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    until = F.last(F.when(F.col("puts"), F.col("at")), ignorenulls=True).over(later)
    theirs = F.when(F.col("provider_id").isNull(), F.col("at"))
    before = Window.partitionBy("provider", "provider_id", theirs).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    put = F.last(F.when(F.col("puts"), F.struct("account", "until")), ignorenulls=True).over(before)
    held = F.col("put").isNotNull() & (F.col("put.until").isNull() | (F.col("put.until") >= F.col("at")))
    return (
        events.withColumnRenamed("puts", "was")
        .withColumn("puts", F.col("was"))
        .withColumn("until", until)
        .withColumn("put", put)
        .withColumn("holder", F.when(held, F.col("put.account")))
        .withColumn("puts", (F.col("at.k") == 0) | (F.col("account").isNotNull() & F.col("holder").isNull()))
        .drop("until", "put")
    )


def link_identities(t: Tables, logins: DataFrame | None = None) -> DataFrame:
    """Q53: logins in order of arrival: by provider id, else linked by e-mail
    (case-insensitive; the lowest customer id), else an account is created; without an
    e-mail too, or with another provider, rejected.

    An account holds one id of a provider. A login whose id no account holds puts it into
    the account of its e-mail, which frees the id held there; a freed id may then move to
    another e-mail's account. So what a login does depends on earlier logins of the same
    id and of the same account only.

    - Ids that come with one account: each login of the account that brings another id
      than the one before puts it. One window by account decides.
    - Accounts with an id that comes with several (or without an e-mail): rounds of two
      windows (what ends each holding, by account; the last holding of each id), starting
      from that guess, until nothing changes. As every event depends on earlier ones only,
      the labels that no longer change are those of the sequence.

    The rounds run on those accounts alone and are checkpointed. Groups are one id or one
    account, equal logins are counted before, and windows run over sorted rows without
    holding a group in memory. Stored provider ids are unique (``uniqueness_audit``).
    ``customer_id`` is NULL for accounts created by the batch.
    """
    if logins is None:
        logins = oauth_login_batch(t)
    # no id and no e-mail, or no known provider: nothing to find and nothing to store
    void = ~F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False)) | (F.col("provider_id").isNull() & F.col("email").isNull())
    events = checkpointed(_login_events(t, logins.filter(~void)))
    by_account = Window.partitionBy("provider", F.coalesce(F.col("account"), F.col("provider_id"))).orderBy("at")
    same = F.coalesce(F.lag("provider_id").over(by_account) == F.col("provider_id"), F.lit(False))
    several = (
        events.filter(F.col("provider_id").isNotNull())
        .groupBy("provider", "provider_id")
        .agg(F.min("account").alias("_low"), F.max("account").alias("_high"), F.count(F.when(F.col("account").isNull(), 1)).alias("_none"))
        .filter((F.col("_low") != F.col("_high")) | (F.col("_none") > 0))
    )
    open_ = events.join(several, ["provider", "provider_id"], "left_semi").filter(F.col("account").isNotNull())
    open_ = open_.select(F.col("provider").alias("_p"), F.col("account").alias("_a"), F.lit(True).alias("_open")).distinct()
    events = events.withColumn("puts", (F.col("at.k") == 0) | (F.col("account").isNotNull() & ~same))
    events = checkpointed(
        events.join(open_, (F.col("provider") == F.col("_p")) & (F.col("account") == F.col("_a")), "left")
        .withColumn("open", F.col("account").isNull() | F.col("_open").isNotNull())
        .drop("_p", "_a", "_open")
    )
    done = events.filter(~F.col("open")).withColumn("holder", F.when(~F.col("puts"), F.col("account"))).drop("open")
    labels = events.filter("open").drop("open")
    while True:
        labels = checkpointed(_held_round(labels))
        changed = labels.filter(F.col("puts") != F.col("was")).limit(1).count()
        labels = labels.drop("was")
        if not changed:
            break
        labels = labels.drop("holder")
    every = done.unionByName(labels).filter("times > 0")
    fresh = F.col("puts") & F.col("account").startswith("e:")
    moment = F.struct("at._at", "provider", "provider_id", "at.email")
    births = every.filter(fresh).groupBy(F.col("account").alias("_born")).agg(F.min(moment).alias("_birth"))
    every = every.join(births, fresh & (F.col("account") == F.col("_born")), "left")
    action = (
        F.when(F.col("holder").isNotNull(), "login")
        .when(~F.col("puts"), "reject")
        .when(moment == F.col("_birth"), "create")
        .otherwise("link")
    )
    who = F.coalesce(F.col("holder"), F.col("account"))
    every = every.withColumn("action", action).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    again = (F.col("_copy") > 1) & (F.col("action") != "reject") & F.col("provider_id").isNotNull()
    out = every.select(
        "provider", "provider_id", F.col("at.email").alias("email"), F.col("at._at").alias("arrival"),
        F.when(again, "login").when((F.col("_copy") > 1) & (F.col("action") == "create"), "link").otherwise(F.col("action")).alias("action"),
        F.when(who.startswith("c:"), F.substring(who, 3, 20).cast("long")).alias("customer_id"),
    )
    rest = logins.filter(void).select("provider", "provider_id", "email", _arrival(logins).alias("arrival"), F.lit("reject").alias("action"), F.lit(None).cast("long").alias("customer_id"))
    return out.union(rest)


def product_slug(name: Column, suffix: Column) -> Column:
    """lower, fold accented vowels, non [a-z0-9] runs -> '-', trim '-', add ``-suffix``."""
    s = F.translate(F.lower(name), ACCENTED, FOLDED)
    s = F.regexp_replace(s, "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.concat(s, F.lit("-"), suffix.cast("string"))


def category_slug(name: Column) -> Column:
    """lower, spaces -> '-' (accents kept, as the shop does)."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def slugify(t: Tables) -> DataFrame:
    """Q54: product slugs (with id suffix) and category slugs."""
    products = t.products.select(
        F.lit("product").alias("kind"), F.col("product_id").cast("long").alias("id"), F.col("product_name").alias("name"),
        product_slug(F.col("product_name"), F.col("product_id")).alias("slug"),
    )
    categories = t.categories.select(
        F.lit("category").alias("kind"), F.col("category_id").cast("long").alias("id"), F.col("category_name").alias("name"),
        category_slug(F.col("category_name")).alias("slug"),
    )
    return products.unionByName(categories)


def slug_consistency(t: Tables, routes: DataFrame | None = None) -> DataFrame:
    """Q55: categories whose stored slug is not a route key (broken links)."""
    if routes is None:
        routes = literals.category_slugs(t.spark)
    return t.categories.join(routes, t.categories["slug"] == routes["route_slug"], "left_anti").select(
        "category_id", "category_name", "slug"
    )

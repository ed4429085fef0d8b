"""Joins, reports, keys, loads and constraint checks on whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.functions.text import sentences
from shelfseek.operators import catalog as C
from shelfseek.operators import quality as Q
from shelfseek.operators import reports as R
from shelfseek.operators import upsert as U
from shelfseek.operators.catalog import split_requests
from shelfseek.operators.keys import continue_ids, positional_ids
from shelfseek.operators.topk import top_k_per_group
from shelfseek.plans import seeding
from shelfseek.plans.querylog import publish_log
from shelfseek.plans.search import search
from shelfseek.registered import views as W
from shelfseek.registered.registry import query
from shelfseek.registered.vector_queries import search_sql
from shelfseek.schemas import CATEGORY, PRODUCT, QUERY_LOG
from shelfseek.sources.publish import publish, read_published
from shelfseek.workspace import new_path

AT = dt.datetime(2024, 5, 6, 7, 8, 9)


def _log(spark, sf_dir) -> DataFrame:
    return W.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("query_text"),
        F.col("o_custkey").alias("user_id"),
    )


def _bridge(spark, sf_dir) -> DataFrame:
    return W.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("product_id")
    )


# --- joins ------------------------------------------------------------------------------------------


@query("c3_category_lookup", """WITH c AS (
  SELECT title, row_number() OVER (ORDER BY title) AS category_id FROM (SELECT DISTINCT p_type AS title FROM part))
SELECT p_partkey, category_id AS main_category_id FROM part JOIN c ON title = p_type""")
def c3(spark, sf_dir):
    rows = W.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit(" "), "p_type", F.lit("\t")).alias("main_category")
    )
    categories, _ = U.get_or_create_categories(rows, spark.createDataFrame([], CATEGORY))
    return U.with_category(rows, categories).select("p_partkey", "main_category_id")


@query("c4_bridge_join", """SELECT DISTINCT l_orderkey AS query_id, o_orderpriority AS query_text, l_partkey AS product_id, p_name AS title
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""")
def c4(spark, sf_dir):
    linked = C.through_bridge(
        _log(spark, sf_dir), _bridge(spark, sf_dir), W.products(spark, sf_dir).select("product_id", "title"),
        "query_id", "product_id",
    )
    return linked.select("query_id", "query_text", "product_id", "title")


def _users(spark, sf_dir) -> DataFrame:
    return W.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "c_mktsegment"
    )


@query("c5_user_role_resolve", """WITH last AS (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY o_custkey)
SELECT c_custkey AS user_id, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'curator' ELSE 'enduser' END AS role,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN strftime(t, '%Y-%m-%d') END AS last_activity
FROM customer LEFT JOIN last ON o_custkey = c_custkey""")
def c5(spark, sf_dir):
    users = _users(spark, sf_dir)
    active = W.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max("o_orderdate").alias("last_activity")
    )
    ends = users.where("c_mktsegment not in ('BUILDING', 'MACHINERY')").join(active, "user_id", "left")
    resolved = C.resolve_roles(
        users.drop("c_mktsegment"), users.where("c_mktsegment = 'BUILDING'"),
        users.where("c_mktsegment = 'MACHINERY'"), ends,
    )
    return resolved.withColumn("last_activity", F.date_format("last_activity", "yyyy-MM-dd"))


@query("c6_fk_anti_join", """SELECT l_partkey AS key, count(*) AS n_rows FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') GROUP BY l_partkey""")
def c6(spark, sf_dir):
    parents = W.table(spark, sf_dir, "part").where("p_type <> 'PROMO'")
    return Q.orphans(W.table(spark, sf_dir, "lineitem"), "l_partkey", parents, "p_partkey")


@query("c8_store_dimension_join", """SELECT l_partkey AS product_id, p_name AS title, l_suppkey AS store_id, s_name AS store, count(*) AS n_children
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def c8(spark, sf_dir):
    supplied = W.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id")
    )
    stores = W.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"))
    joined = C.products_with_stores(W.products(spark, sf_dir).select("product_id", "title"), supplied, stores)
    return joined.select("product_id", "title", "store_id", "store", "n_children")


@query("c8_child_rows", f"""WITH {W.sentences_sql()},
shown AS (SELECT product_id, i - 1 AS place, s AS feature FROM sents)
SELECT product_id, source AS title, place, feature FROM shown JOIN documents ON doc_id = product_id""")
def c8_children(spark, sf_dir):
    """The features of a product as rows of a table of their own, joined back by key."""
    products = W.documents(spark, sf_dir, "source").withColumnRenamed("source", "title")
    children = C.child_rows(products, sentences(F.col("text")), "feature")
    joined = children.join(products.select("product_id", "title"), "product_id")
    return joined.select("product_id", "title", F.col("place").cast("bigint").alias("place"), "feature")


# --- reports ----------------------------------------------------------------------------------------


@query("d5_search_history", """SELECT o_orderkey AS query_id, o_orderpriority AS query_text, o_custkey AS user_id,
  count(DISTINCT l_partkey) AS n_results FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def d5(spark, sf_dir):
    return R.search_history(_log(spark, sf_dir), _bridge(spark, sf_dir))


@query("d6_popular_queries", """SELECT lower(event_type) AS query_text, count(*) AS n_searches FROM events
GROUP BY 1 ORDER BY n_searches DESC, query_text LIMIT 3""")
def d6(spark, sf_dir):
    log = W.table(spark, sf_dir, "events").select(
        F.when(F.col("value") > 10, F.upper("event_type")).otherwise(F.concat(F.lit("  "), "event_type")).alias("query_text")
    )
    return R.popular_queries(log, 3)


@query("d7_category_listing", "SELECT p_type AS category, count(*) AS n_products FROM part GROUP BY p_type")
def d7(spark, sf_dir):
    return R.category_listing(W.products(spark, sf_dir))


# --- orders and keys --------------------------------------------------------------------------------


@query("e1_order_by_key", f"WITH {W.PRODUCTS} SELECT product_id, title, price FROM products ORDER BY product_id")
def e1(spark, sf_dir):
    return W.products(spark, sf_dir).select("product_id", "title", "price").orderBy("product_id")


@query("e2_topk_per_query", """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
  FROM lineitem) WHERE rank <= 5""")
def e2(spark, sf_dir):
    items = W.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    top = top_k_per_group(items, ["l_partkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query("e5_positional_id", """SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS position, doc_id, source FROM documents""")
def e5(spark, sf_dir):
    docs = W.table(spark, sf_dir, "documents").select("doc_id", "source")
    return positional_ids(docs, ["source", "doc_id"], "position")


@query("e6_surrogate_key", """SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)
  + (SELECT max(o_orderkey) FROM orders) AS query_id, l_orderkey, l_linenumber FROM lineitem""")
def e6(spark, sf_dir):
    new = W.table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    numbered = continue_ids(
        new, _log(spark, sf_dir), ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"], "query_id"
    )
    return numbered.select("query_id", "l_orderkey", "l_linenumber")


# --- appends ----------------------------------------------------------------------------------------


@query("h1_insert_ignore", """SELECT o_orderkey AS query_id,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'first ' || o_orderpriority END AS query_text FROM orders""")
def h1(spark, sf_dir):
    """The target holds the finished orders; every order comes in again, twice."""
    orders = W.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "query_id")
    target = orders.where("o_orderstatus = 'F'").select("query_id", F.col("o_orderpriority").alias("query_text"))
    texts = [F.concat(F.lit(word), "o_orderpriority") for word in ("first ", "second ")]
    incoming = W.variants(orders.select("query_id", "o_orderpriority"), "query_text", texts)
    return U.insert_ignore(target, incoming, ["query_id"], ["variant"])


_OLD = "(SELECT DISTINCT p_type AS title FROM part WHERE p_type > 'M')"
_CATEGORIES = f"""old AS (SELECT row_number() OVER (ORDER BY title) * 10 AS category_id, title FROM {_OLD}),
new AS (
  SELECT row_number() OVER (ORDER BY title) + (SELECT max(category_id) FROM old) AS category_id, title
  FROM (SELECT DISTINCT p_type AS title FROM part UNION SELECT 'Uncategorized') WHERE title NOT IN (SELECT title FROM old)),
categories AS (SELECT category_id, title, false AS created FROM old UNION ALL SELECT category_id, title, true FROM new)"""


@query("h2_get_or_create_category", f"WITH {_CATEGORIES} SELECT category_id, title, created FROM categories")
def h2(spark, sf_dir):
    part = W.table(spark, sf_dir, "part")
    known = part.where("p_type > 'M'").select(F.col("p_type").alias("title")).distinct()
    old = positional_ids(known, ["title"], "n", start=1).select((F.col("n") * 10).alias("category_id"), "title")
    asked = W.variants(part.select("p_type"), "main_category", [F.concat(F.lit(" "), "p_type"), F.lit(" ")])
    categories, created = U.get_or_create_categories(asked, old)
    return categories.join(created.select("category_id", F.lit(True).alias("new")), "category_id", "left").select(
        "category_id", "title", F.coalesce("new", F.lit(False)).alias("created")
    )


def _raw_catalog(spark, sf_dir) -> DataFrame:
    """The parts as raw text rows: some without text, category, price or counts."""
    part = W.table(spark, sf_dir, "part")
    price = F.format_string("%.2f", "p_retailprice")
    textless = (F.col("p_brand") == "Brand#3") & (F.col("p_size") > 25)
    return part.select(
        F.col("p_partkey").alias("row"),
        F.when(~textless, F.concat(F.lit("  "), "p_name")).alias("title"),
        F.when(textless, " \t").when(F.col("p_type") == "SMALL", "").otherwise(F.concat("p_name", F.lit(" \n"))).alias("description"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("$"), price)).otherwise(price).alias("price"),
        F.when(F.col("p_size") > 5, F.format_string("%.1f", F.col("p_size") / 10)).otherwise("0").alias("average_rating"),
        F.concat(F.col("p_size").cast("string"), F.lit(".7")).alias("rating_number"),
        F.col("p_brand").alias("store"), F.lit("nan").alias("details"), F.col("p_name").alias("features"),
        F.lit(None).cast("string").alias("images"),
        F.when(F.col("p_type") != "LARGE", F.col("p_type")).alias("main_category"),
    )


_LOADED = """raw AS (SELECT *, p_brand = 'Brand#3' AND p_size > 25 AS textless, CASE WHEN p_type = 'LARGE' THEN 'Uncategorized' ELSE p_type END AS c FROM part),
cats AS (SELECT c AS title, row_number() OVER (ORDER BY c) AS category_id FROM (SELECT DISTINCT c FROM raw)),
loaded AS (
  SELECT row_number() OVER (ORDER BY p_partkey) AS product_id, p_name AS title, p_name AS description,
    CASE WHEN p_type = 'PROMO' THEN NULL ELSE printf('%.2f', p_retailprice)::DOUBLE END AS price,
    CASE WHEN p_size > 5 THEN p_size / 10.0::DOUBLE END AS average_rating, p_size::BIGINT AS rating_number,
    p_brand AS store, p_name AS features, category_id AS main_category_id
  FROM raw JOIN cats ON cats.title = c WHERE NOT textless)"""
_LOADED_COLUMNS = "product_id, title, description, price, average_rating, rating_number, store, features, main_category_id"


def _load(spark, sf_dir) -> seeding.Load:
    return seeding.seed(
        _raw_catalog(spark, sf_dir), spark.createDataFrame([], PRODUCT), spark.createDataFrame([], CATEGORY), ["row"], AT
    )


@query("h3_insert_products", f"""WITH {W.PRODUCTS}
SELECT product_id, title, category AS source, processed, loaded FROM (
  SELECT product_id, title, category, true AS processed, '2024-01-01 00:00:00' AS loaded FROM products
  UNION ALL
  SELECT row_number() OVER (ORDER BY product_id) + (SELECT max(product_id) FROM products), title, category, false,
         '2024-05-06 07:08:09' FROM products)""")
def h3(spark, sf_dir):
    """Every product is there already and is inserted once more as a new one."""
    given = W.products(spark, sf_dir).withColumn("main_category_id", F.lit(1)).withColumn("source", F.col("category"))
    for name in ("description", "images", "features", "details"):
        given = given.withColumn(name, F.lit(None))
    old = given.withColumns({"processed": F.lit(True), "timestamp": U.load_time(dt.datetime(2024, 1, 1))})
    present = seeding.product_rows(old, ["product_id"])
    added = seeding.insert_products(
        given.withColumnRenamed("product_id", "old_id"), present, ["old_id"], AT
    )
    return present.unionByName(added).select(
        "product_id", "title", "source", "processed", F.col("timestamp").cast("string").alias("loaded")
    )


@query("h4_seed_catalog", f"WITH {_LOADED} SELECT {_LOADED_COLUMNS} FROM loaded")
def h4(spark, sf_dir):
    return _load(spark, sf_dir).products.select(*[name.strip() for name in _LOADED_COLUMNS.split(",")])


@query("d1_seed_metrics", f"""WITH {_LOADED}
SELECT count(*) AS rows_read, count_if(NOT textless) AS products_inserted, count_if(textless) AS rows_skipped,
       (SELECT count(*) FROM cats) AS categories_created FROM raw""")
def d1(spark, sf_dir):
    return _load(spark, sf_dir).metrics


@query("a11_seed_tables_sink", f"""WITH {_LOADED}
SELECT l.product_id, l.title, l.price, cats.title AS category FROM loaded l JOIN cats ON category_id = main_category_id""")
def a11(spark, sf_dir):
    """Two halves loaded one after the other give the published tables of one load."""
    base = new_path(spark, "catalog")
    raw = _raw_catalog(spark, sf_dir)
    middle = raw.agg(F.percentile_approx("row", 0.5)).first()[0]
    for half in (F.col("row") <= middle, F.col("row") > middle):
        seeding.seed_and_publish(raw.where(half), base, ["row"], AT)
    categories = read_published(spark, base, "category").select(
        F.col("category_id").alias("main_category_id"), F.col("title").alias("category")
    )
    return read_published(spark, base, "product").join(categories, "main_category_id").select(
        "product_id", "title", "price", "category"
    )


@query("h5_insert_product_embedding", """WITH pairs AS (
  SELECT label::BIGINT AS product_id, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
joined AS (SELECT product_id, p_name, p_type, p_retailprice, embedding FROM pairs JOIN embeddings USING (vec_id) JOIN part ON p_partkey = product_id)
SELECT row_number() OVER (ORDER BY product_id) AS embedding_id, product_id, p_name AS description,
  round(list_sum(embedding::DOUBLE[]), 6) AS total, CASE WHEN p_type <> 'ECONOMY' THEN p_name END AS title,
  CASE WHEN p_type <> 'ECONOMY' THEN p_retailprice END AS price, CASE WHEN p_type <> 'ECONOMY' THEN '{}' END AS details
FROM joined""")
def h5(spark, sf_dir):
    """The first vector of every labelled product; products of one category are there already and stay."""
    products = W.products(spark, sf_dir)
    incoming = W.vectors(spark, sf_dir).join(products, "product_id").withColumns(
        {
            "description": F.col("title"), "main_category_id": F.lit(1), "images": F.lit(None).cast("map<string,string>"),
            "features": F.lit(None).cast("array<string>"), "details": F.lit(None).cast("map<string,string>"),
        }
    )
    base = new_path(spark, "inserted")
    known = seeding.product_rows(products.where("category = 'ECONOMY'").withColumn("main_category_id", F.lit(1)).withColumns(
        {name: F.lit(None) for name in ("description", "images", "features", "details")}
    ), ["product_id"], AT)
    publish(spark, base, {"product": known.select(*PRODUCT.names)})
    seeding.publish_with_embeddings(incoming, base, ["chunk_id"], AT)
    rows = read_published(spark, base, "product").join(known.select("product_id"), "product_id", "left_anti")
    embedded = read_published(spark, base, "product_embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return embedded.join(rows.select("product_id", "title", "price", "details"), "product_id", "left").select(
        "embedding_id", "product_id", "description", F.round(total, 6).alias("total"), "title", "price", "details"
    )


@query("h6_ensure_prerequisites", """SELECT c_custkey AS user_id, c_name AS name, 'customer' AS origin FROM customer
UNION ALL
SELECT DISTINCT o_custkey + 1000000000, 'User ' || (o_custkey + 1000000000), 'referenced' FROM orders
UNION ALL
SELECT k, 'Category ' || k, CASE WHEN k < 4 THEN 'category' ELSE 'referenced category' END
FROM (SELECT DISTINCT label::BIGINT AS k FROM embeddings UNION SELECT unnest(range(4)))""")
def h6(spark, sf_dir):
    """Orders refer to known customers and to unknown ones, which get a placeholder row."""
    users = _users(spark, sf_dir).select("user_id", "name", F.lit("customer").alias("origin"))
    asked = _log(spark, sf_dir).select(F.explode(F.array(F.col("user_id"), F.col("user_id") + 10**9)).alias("user_id"))
    missing = U.missing_parents(asked, users, "user_id")
    named = missing.select(
        "user_id", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"), F.lit("referenced").alias("origin")
    )
    known = spark.range(4).select(F.col("id").alias("category_id"))
    labels = W.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("category_id"))
    missing = U.missing_parents(labels, known, "category_id")
    categories = known.withColumn("origin", F.lit("category")).unionByName(missing.withColumn("origin", F.lit("referenced category")))
    title = F.concat(F.lit("Category "), F.col("category_id").cast("string"))
    return users.unionByName(named).union(categories.select("category_id", title, "origin"))


@query("h7_constraint_report", """SELECT 'product' AS table_name, 'primary key' AS rule, (SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'query_log_product', 'primary key', (SELECT count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'users', 'unique name', (SELECT count(*) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'document', 'unique text', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'query_log_product', 'product exists', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'query_log_product', 'query exists', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'query_log', 'user is a buyer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
UNION ALL SELECT 'users', 'name missing', (SELECT count(*) FROM customer WHERE c_name IS NULL)
UNION ALL SELECT 'users', 'role not allowed', (SELECT count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))
UNION ALL SELECT 'users', 'name over 100', (SELECT count(*) FROM customer WHERE length(c_name) > 100)
UNION ALL SELECT 'document', 'text missing', (SELECT count(*) FROM documents WHERE text IS NULL)
UNION ALL SELECT 'document', 'text over 255', (SELECT count(*) FROM documents WHERE length(text) > 255)""")
def h7(spark, sf_dir):
    part, lines, orders, customers, docs = (
        W.table(spark, sf_dir, name) for name in ("part", "lineitem", "orders", "customer", "documents")
    )
    return Q.report(
        [
            Q.duplicate_keys(part, "product", "primary key", ["p_partkey"]),
            Q.duplicate_keys(lines, "query_log_product", "primary key", ["l_orderkey", "l_partkey"]),
            Q.duplicate_keys(customers, "users", "unique name", ["c_name"]),
            Q.duplicate_keys(docs, "document", "unique text", ["text"], long_text=True),
            Q.foreign_key(lines, "l_partkey", part, "p_partkey", "query_log_product", "product exists"),
            Q.foreign_key(lines, "l_orderkey", orders, "o_orderkey", "query_log_product", "query exists"),
            Q.foreign_key(
                orders, "o_custkey", customers.where("c_acctbal > 0"), "c_custkey", "query_log", "user is a buyer"
            ),
            Q.row_rules(
                customers, "users",
                {
                    "name missing": F.col("c_name").isNull(),
                    "role not allowed": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
                    "name over 100": F.length("c_name") > 100,
                },
            ),
            Q.row_rules(
                docs, "document", {"text missing": F.col("text").isNull(), "text over 255": F.length("text") > 255}
            ),
        ]
    )


@query("h8_delete_cascade", """SELECT vec_id AS chunk_id, label::BIGINT AS product_id FROM embeddings
WHERE label NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""")
def h8(spark, sf_dir):
    """Deleting the products of a category leaves a new published version without their vectors."""
    deleted = W.products(spark, sf_dir).where("category = 'ECONOMY'")
    vectors = W.vectors(spark, sf_dir)
    base = new_path(spark, "embeddings")
    publish(spark, base, {"embeddings": vectors})
    publish(spark, base, {"embeddings": U.delete_cascade(read_published(spark, base, "embeddings"), deleted, "product_id")})
    return read_published(spark, base, "embeddings").select("chunk_id", "product_id")


@query("h9_apply_defaults", """SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'enduser' END AS role,
  c_acctbal > 0 AS processed FROM customer""")
def h9(spark, sf_dir):
    customers = W.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "admin").alias("role"),
        F.when(F.col("c_acctbal") > 0, True).alias("processed"),
    )
    return U.apply_defaults(customers, {"role": "enduser", "processed": False})


@query("h10_log_queries", f"""WITH {search_sql(100)},
logged AS (SELECT item_id, row_number() OVER (ORDER BY item_id) + (SELECT max(o_orderkey) FROM orders) AS query_id, text FROM benchmark)
SELECT l.query_id, text AS query_text, 1::BIGINT AS user_id, product_id FROM logged l LEFT JOIN found f ON f.query_id = item_id""")
def h10(spark, sf_dir):
    asked = W.requests(spark, sf_dir, 100)
    accepted, _ = split_requests(asked)
    found = search(asked, W.vectors(spark, sf_dir), W.products(spark, sf_dir), W.DIM)
    base = new_path(spark, "log")
    log = _log(spark, sf_dir)
    timed = log.withColumn("timestamp", U.load_time(AT))
    publish(spark, base, {"query_log": timed.select(*[F.col(f.name).cast(f.dataType) for f in QUERY_LOG.fields])})
    publish_log(accepted, found, base, AT)
    entries = read_published(spark, base, "query_log").join(log.select("query_id"), "query_id", "left_anti")
    bridge = read_published(spark, base, "query_log_product")
    return entries.join(bridge, "query_id", "left").select(
        "query_id", "query_text", F.col("user_id").cast("bigint").alias("user_id"), "product_id"
    )


@query("h11_rebuild_schema", f"WITH {W.PRODUCTS} SELECT product_id, title FROM products WHERE category <> 'PROMO'")
def h11(spark, sf_dir):
    """A full refresh: the second load alone is what readers see."""
    base = new_path(spark, "refresh")
    products = W.products(spark, sf_dir).select("product_id", "title", "category")
    publish(spark, base, {"product": products})
    publish(spark, base, {"product": products.where("category <> 'PROMO'")}, replace_all=True)
    return read_published(spark, base, "product").select("product_id", "title")

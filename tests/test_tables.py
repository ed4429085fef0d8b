from __future__ import annotations

from functools import partial

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfseek.operators import catalog as C
from shelfseek.operators import quality as Q
from shelfseek.operators import reports as R
from shelfseek.operators import upsert as U
from shelfseek.operators.chunking import paragraph_chunks
from shelfseek.operators.embedding import from_model
from shelfseek.operators.keys import continue_ids, positional_ids
from shelfseek.operators.topk import top_k_per_group
from shelfseek.plans import seeding
from shelfseek.plans.index import build_index
from shelfseek.schemas import CATALOG_CSV, CATEGORY, PRODUCT
from shelfseek.sources import publish as P
from shelfseek.sources import scan
from shelfseek.workspace import new_path


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- sources ----------------------------------------------------------------------------------------

CSV = '''title,description,price,average_rating,rating_number,store,details,features,images,main_category
"A, ""quoted""","two
lines",12.5,4.5,12.7,S,{'a': 1},NA,,Audio
,,1,0,0,,,,,Video
Only title,   ,$9,x,inf,N/A,null,f,i,
Zero,d,0,0,0,s,,,,Audio
'''


@pytest.fixture()
def csv_path(tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_csv_scan(spark, csv_path):
    got = scan.csv_scan(spark, csv_path, CATALOG_CSV).collect()
    assert [r["title"] for r in got] == ['A, "quoted"', None, "Only title", "Zero"]
    assert got[0]["description"] == "two\nlines" and got[0]["features"] is None
    assert got[2]["store"] is None and got[2]["description"] == "   "


def test_csv_descriptions_keep_gaps(spark, csv_path):
    assert rows(scan.csv_descriptions(spark, csv_path, CATALOG_CSV), "product_id") == [(0, "two\nlines"), (3, "d")]


def test_csv_positions_over_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, items in (("b", ["3", "4"]), ("a", ["0", "1", "2"])):
        (folder / f"{name}.csv").write_text("title\n" + "\n".join(items) + "\n")
    got = scan.csv_rows(spark, str(folder), T.StructType([CATALOG_CSV["title"]]))
    assert rows(got, "row_number") == [(i, str(i)) for i in range(5)]


def test_text_files(spark, tmp_path):
    for name, text in (("a.txt", "alpha\nbeta"), ("b.csv", "x"), ("c.txt", "é")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert rows(scan.text_files(spark, str(tmp_path)).select("product_id", "text"), "product_id") == [(0, "alpha\nbeta"), (2, "é")]


def test_source_order(spark, csv_path, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "t.txt").write_text("text")
    full = spark.createDataFrame([(7, "title", "d"), (8, "other", " ")], "product_id bigint, title string, description string")
    none = full.where("false")
    assert rows(scan.load_documents(full, csv_path, CATALOG_CSV, str(folder)), "product_id") == [(7, "title")]
    assert rows(scan.load_documents(none, csv_path, CATALOG_CSV, str(folder)), "product_id") == [(0, "two\nlines"), (3, "d")]
    assert rows(scan.load_documents(none, csv_path + ".no", CATALOG_CSV, str(folder)), "product_id") == [(0, "text")]


def test_jdbc_options():
    options = scan.jdbc_options("jdbc:x", "product", "u", "p", 0, 100, 8)
    assert options["partitionColumn"] == "product_id" and options["numPartitions"] == "8"


# --- publishing -------------------------------------------------------------------------------------


def test_publish_versions(spark):
    base = new_path(spark, "t")
    assert P.latest(spark, base) == {}
    P.publish(spark, base, {"a": spark.range(3), "b": spark.range(1)})
    first = P.read_published(spark, base, "a")
    P.publish(spark, base, {"a": spark.range(5)})
    assert P.read_published(spark, base, "a").count() == 5
    assert P.read_published(spark, base, "b").count() == 1
    assert first.count() == 3


def test_failed_publish_shows_nothing(spark):
    base = new_path(spark, "t")
    P.publish(spark, base, {"a": spark.range(3)})
    broken = spark.range(2).select(F.raise_error(F.lit("boom")).cast("int").alias("x"))
    with pytest.raises(Exception, match="boom"):
        P.publish(spark, base, {"a": spark.range(9), "b": broken})
    assert P.read_published(spark, base, "a").count() == 3
    assert set(P.latest(spark, base)) == {"a"}


def test_one_version_is_claimed_once(spark):
    base = new_path(spark, "t")
    P.publish(spark, base, {"a": spark.range(3)})
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        spark.range(1).write.mode("errorifexists").json(f"{base}/_manifests/version=1")


def test_index_is_rebuilt_when_its_source_changes(spark):
    base = new_path(spark, "t")
    docs = spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "product_id bigint, text string")
    changed = docs.withColumn("text", F.concat("text", F.lit(" More.")))
    built = [build_index(d, base, 16, paragraph_chunks)[1] for d in (docs, docs, changed, changed)]
    assert built == [True, False, True, False]
    assert build_index(changed, base, 16, paragraph_chunks, rebuild=True)[1]
    assert build_index(docs.where("false"), new_path(spark, "t"), 16, paragraph_chunks)[0].count() == 0


def test_rows_that_come_in_pairs_count(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "product_id bigint, text string")
    other = spark.createDataFrame([(1, "c"), (1, "c"), (2, "b")], "product_id bigint, text string")
    assert P.fingerprint(docs, "product_id", "text") != P.fingerprint(other, "product_id", "text")


def test_settings_are_part_of_the_mark(spark):
    base = new_path(spark, "t")
    docs = spark.createDataFrame([(1, "One two three four. " * 20)], "product_id bigint, text string")
    with pytest.raises(ValueError, match="settings"):
        build_index(docs, base, 16, lambda d: paragraph_chunks(d, 5))
    sizes = []
    for words in (5, 40, 40):
        chunks, built = build_index(docs, base, 16, partial(paragraph_chunks, target_words=words), settings=f"paragraphs-{words}")
        sizes.append((chunks.count(), built))
    assert sizes == [(20, True), (2, True), (2, False)]


def test_index_embeds_only_what_changed(spark):
    base = new_path(spark, "t")
    seen = spark.sparkContext.accumulator(0)

    def make():
        def embed_texts(texts):
            seen.add(len(texts))
            return [[float(len(text))] for text in texts]

        return embed_texts

    model = from_model("length", 1, make)
    whole = lambda d: d.selectExpr("product_id", "product_id as chunk_id", "text as chunk_text")
    rows_then = [(i, f"text {i}") for i in range(20)]
    rows_now = [(i, f"text {i}" if i else "changed") for i in range(15)] + [(30, "new")]
    counts = []
    for content in (rows_then, rows_now):
        before = seen.value
        docs = spark.createDataFrame(content, "product_id bigint, text string")
        chunks, _ = build_index(docs, base, 1, whole, embedder=model, settings="whole")
        assert sorted((r.product_id, r.embedding[0]) for r in chunks.collect()) == sorted((i, float(len(t))) for i, t in content)
        counts.append(seen.value - before)
    assert counts == [20, 2]


# --- keys and groups --------------------------------------------------------------------------------


def test_positional_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = positional_ids(df, ["v"], "p")
    assert rows(got, "v") == [(i, i) for i in range(1000)]
    assert positional_ids(df.where("false"), ["v"], "p").count() == 0


def test_continue_ids(spark):
    new = spark.createDataFrame([("b",), ("a",)], "t string")
    assert rows(continue_ids(new, spark.createDataFrame([(41,)], "id bigint"), ["t"], "id"), "id") == [(42, "a"), (43, "b")]
    assert rows(continue_ids(new, spark.createDataFrame([], "id bigint"), ["t"], "id"), "id") == [(1, "a"), (2, "b")]


def test_top_k_with_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), "id").repartition(9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    plain = {tuple(r) for r in top_k_per_group(df, ["g"], [F.desc("id")], 4).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        salted = top_k_per_group(df, ["g"], [F.desc("id")], 4)
        assert {tuple(r) for r in salted.collect()} == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- appends ----------------------------------------------------------------------------------------


def test_insert_ignore_is_idempotent(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    incoming = spark.createDataFrame([(1, "x", 0), (2, "first", 1), (2, "second", 2), (3, "y", 3)], "k int, v string, o int")
    once = U.insert_ignore(target, incoming, ["k"], ["o"])
    assert rows(once, "k") == [(1, "old"), (2, "first"), (3, "y")]
    assert rows(U.insert_ignore(once, incoming, ["k"], ["o"]), "k") == rows(once, "k")


def test_seed(spark, csv_path):
    raw = scan.csv_rows(spark, csv_path, CATALOG_CSV)
    load = seeding.seed(raw, spark.createDataFrame([], PRODUCT), spark.createDataFrame([(5, "Audio")], CATEGORY), ["row_number"])
    assert rows(load.categories, "category_id") == [(5, "Audio"), (6, "Uncategorized"), (7, "Video")]
    assert tuple(load.metrics.first()) == (4, 3, 1, 2)
    got = load.products.orderBy("product_id").collect()
    assert [(r["product_id"], r["title"], r["description"], r["price"], r["rating_number"], r["main_category_id"]) for r in got] == [
        (1, 'A, "quoted"', "two\nlines", 12.5, 12, 5),
        (2, "Only title", "Only title", None, None, 6),
        (3, "Zero", "d", None, None, 5),
    ]
    assert all(r["processed"] is False and r["timestamp"] is not None for r in got)
    again = seeding.seed(raw, load.products, load.categories, ["row_number"])
    assert again.new_categories.count() == 0
    assert sorted(r["product_id"] for r in again.new_products.collect()) == [4, 5, 6]


def test_seed_publish_is_all_or_nothing(spark, csv_path):
    base = new_path(spark, "t")
    raw = scan.csv_rows(spark, csv_path, CATALOG_CSV)
    seeding.seed_and_publish(raw, base, ["row_number"])
    assert P.read_published(spark, base, "product").count() == 3
    assert P.read_published(spark, base, "category").count() == 3
    seeding.seed_and_publish(raw, base, ["row_number"])
    assert sorted(r["product_id"] for r in P.read_published(spark, base, "product").collect()) == [1, 2, 3, 4, 5, 6]
    assert P.read_published(spark, base, "category").count() == 3
    assert len(P.latest(spark, base)["product"][0]) == 2


def test_cascade_and_parents(spark):
    children = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert rows(U.delete_cascade(children, spark.createDataFrame([(2,), (2,)], "k int"), "k"), "k") == [(1, "a")]
    missing = U.missing_parents(children.select("k"), spark.createDataFrame([(1,)], "k int"), "k")
    assert rows(missing, "k") == [(2,)]


# --- reports and checks -----------------------------------------------------------------------------


def test_drop_null_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, b string, c string")
    assert C.drop_null_columns(df).columns == ["a", "c"]


def test_lookups(spark):
    products = spark.createDataFrame([(1, "a", float("inf"))], "product_id int, title string, price double")
    assert [tuple(r) for r in C.product_by_id(products, 1).collect()] == [(1, "a", None)]
    assert C.product_by_id(products, 2).count() == 0


def test_requests(spark):
    df = spark.createDataFrame([(1, "q", 5), (2, " ", 5), (3, None, 5), (4, "q", 0), (5, "q", None)], "query_id int, query string, k int")
    accepted, rejected = C.split_requests(df)
    assert rows(accepted.select("query_id", "k"), "query_id") == [(1, 5), (5, 5)]
    assert rows(rejected.select("query_id", "reason"), "query_id") == [
        (2, "blank query"), (3, "blank query"), (4, "k below 1"),
    ]


def test_roles(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "user_id int, name string")
    ids = lambda *items: spark.createDataFrame([(i,) for i in items], "user_id int")
    ends = ids(3).withColumn("last_activity", F.lit("t"))
    assert rows(C.resolve_roles(users, ids(1), ids(2), ends), "user_id") == [
        (1, "a", "admin", None), (2, "b", "curator", None), (3, "c", "enduser", "t"),
    ]


def test_constraint_report(spark):
    df = spark.createDataFrame([(1, "admin", "t"), (1, "guest", "x" * 300), (2, None, None)], "k int, role string, title string")
    parents = spark.createDataFrame([(1,)], "k int")
    report = Q.report(
        [
            Q.duplicate_keys(df, "t", "primary key", ["k"]),
            Q.foreign_key(df, "k", parents, "k", "t", "parent exists"),
            Q.row_rules(
                df, "t",
                {
                    "role": ~F.col("role").isin("admin", "curator", "enduser"),
                    "title missing": F.col("title").isNull(), "title over 255": F.length("title") > 255,
                },
            ),
        ]
    )
    assert {(r["rule"], r["violations"]) for r in report.collect()} == {
        ("primary key", 1), ("parent exists", 1), ("role", 1), ("title missing", 1), ("title over 255", 1),
    }


def test_history_and_popular(spark):
    log = spark.createDataFrame([(1, "A "), (2, "a"), (3, "b")], "query_id int, query_text string")
    bridge = spark.createDataFrame([(1, 7), (1, 7), (1, 8)], "query_id int, product_id int")
    assert rows(R.search_history(log, bridge).select("query_id", "n_results"), "query_id") == [(1, 2), (2, 0), (3, 0)]
    assert [tuple(r) for r in R.popular_queries(log, 1).collect()] == [("a", 2)]

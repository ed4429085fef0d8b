"""Column transforms, each as a job over a whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.functions import numbers as N
from shelfseek.functions import semistructured as S
from shelfseek.functions import text as T
from shelfseek.operators.reports import cards
from shelfseek.operators.upsert import load_time
from shelfseek.registered import views as W
from shelfseek.registered.registry import query
from shelfseek.registered.vector_queries import spaced_sql
from shelfseek.workspace import spread

_WS = W.sql_space()
_JS = r"[\t-\r\x{FEFF}\p{Z}]"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _blanks(spark, sf_dir, *kept: str) -> DataFrame:
    """All documents, and for each of them the shapes of "no text"."""
    texts = [F.col("text"), F.concat(F.lit("\u00a0\t"), "text", F.lit(" \u001c"))]
    shapes = [F.lit(s) for s in ("", "   ", "\t", "\u00a0", "\u001c")]
    docs = W.documents(spark, sf_dir, *kept)
    return W.variants(docs, "shape", [*texts, F.lit(None).cast("string"), *shapes]).drop("text")


_BLANKS = """blanks AS (
  SELECT doc_id AS product_id, unnest(range(8)) AS variant, unnest([text, chr(160) || chr(9) || text || ' ' || chr(28),
    NULL, '', '   ', chr(9), chr(160), chr(28)]) AS shape FROM documents)"""


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


@query("b1_nonblank_filter", f"""WITH {_BLANKS}
SELECT product_id, variant, shape IS NOT NULL AND trim(shape, ' ') <> '' AS by_sql,
       shape IS NOT NULL AND {_strip_sql('shape')} <> '' AS by_text,
       shape IS NOT NULL AND regexp_replace(shape, '^{_JS}+|{_JS}+$', '', 'g') <> '' AS by_page FROM blanks""")
def b1(spark, sf_dir):
    shape = F.col("shape")
    return _blanks(spark, sf_dir).select(
        "product_id", _long("variant"), T.has_text_sql(shape).alias("by_sql"), T.has_text(shape).alias("by_text"),
        (shape.isNotNull() & (T.strip_js(shape) != "")).alias("by_page"),
    )


@query("g1_clean_or_fallback", f"""WITH {_BLANKS}
SELECT product_id, variant, coalesce(nullif({_strip_sql('shape')}, ''), 'Untitled') AS title,
       nullif({_strip_sql('shape')}, '') AS store FROM blanks""")
def g1(spark, sf_dir):
    shape = F.col("shape")
    return _blanks(spark, sf_dir).select(
        "product_id", _long("variant"), T.clean_or(shape, T.UNTITLED).alias("title"), T.clean_or(shape).alias("store")
    )


@query("g2_description_or_title", f"""WITH {_BLANKS},
t AS (SELECT product_id, variant, shape, CASE WHEN variant % 2 = 0 THEN source END AS title
      FROM blanks JOIN documents ON doc_id = product_id)
SELECT product_id, variant, coalesce(nullif({_strip_sql('shape')}, ''), nullif({_strip_sql('title')}, '')) AS description
FROM t""")
def g2(spark, sf_dir):
    titled = _blanks(spark, sf_dir, "source").withColumn("title", F.when(F.col("variant") % 2 == 0, F.col("source")))
    return titled.select(
        "product_id", _long("variant"), T.description_or_title(F.col("shape"), F.col("title")).alias("description")
    )


# Number texts: the price itself, printed in ways that are and are not numbers, and fixed odd ones.
_ODD = ["", "0", "0.0", "nan", "inf", "-Infinity", "1_000", "1e3", ".5", "12.7", "-3.9", "1e999", "0x10", "1.0f"]


def _number_texts(spark, sf_dir) -> DataFrame:
    price = F.format_string("%.2f", F.col("price"))
    shaped = [
        price, F.concat(F.lit("$"), price), F.concat(F.lit(" "), price, F.lit("\t")), F.concat(price, F.lit("d")),
        F.concat(F.lit("-"), price), F.lit(None).cast("string"), *[F.lit(s) for s in _ODD],
    ]
    return W.variants(W.products(spark, sf_dir).select("product_id", "price"), "raw", shaped)


_ODD_SQL = ", ".join(f"'{s}'" for s in _ODD)
_NUMBER_TEXTS = f"""raws AS (
  SELECT product_id, unnest(range({6 + len(_ODD)})) AS variant, unnest([s, '$' || s, ' ' || s || chr(9), s || 'd',
    '-' || s, NULL, {_ODD_SQL}]) AS raw
  FROM (SELECT p_partkey AS product_id, printf('%.2f', p_retailprice) AS s FROM part)),
trimmed AS (SELECT *, {_strip_sql('raw')} AS x FROM raws),
numbers AS (
  SELECT *, CASE WHEN regexp_matches(x, '^[-+]?(\\d|[.]\\d)') AND regexp_full_match(x, '[-+0-9._eE]+')
      AND NOT regexp_matches(x, '(^|[^0-9])_|_([^0-9]|$)')
    THEN try_cast(replace(x, '_', '') AS DOUBLE) END AS y FROM trimmed),
parsed AS (SELECT *, CASE WHEN isinf(y) OR isnan(y) OR y = 0 THEN NULL ELSE y END AS z FROM numbers)"""


@query("g3_price_cast", f"WITH {_NUMBER_TEXTS} SELECT product_id, variant, z AS price FROM parsed")
def g3(spark, sf_dir):
    return _number_texts(spark, sf_dir).select("product_id", _long("variant"), N.price(F.col("raw")).alias("price"))


@query("g4_rating_cast", f"WITH {_NUMBER_TEXTS} SELECT product_id, variant, z AS average_rating FROM parsed")
def g4(spark, sf_dir):
    return _number_texts(spark, sf_dir).select(
        "product_id", _long("variant"), N.rating(F.col("raw")).alias("average_rating")
    )


@query("g5_count_cast", f"""WITH {_NUMBER_TEXTS}
SELECT product_id, variant, try_cast(trunc(z) AS BIGINT) AS rating_number FROM parsed""")
def g5(spark, sf_dir):
    return _number_texts(spark, sf_dir).select(
        "product_id", _long("variant"), N.count(F.col("raw")).alias("rating_number")
    )


def _unclean(spark, sf_dir) -> DataFrame:
    """Every product, with its price as it is and as NaN, infinities and a decimal."""
    price = F.col("price")
    shapes = [price, F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(None).cast("double")]
    products = W.products(spark, sf_dir).select("product_id", "title", "price")
    shaped = W.variants(products, "score", shapes)
    return shaped.withColumn("amount", F.col("price").cast("decimal(10,2)"))


_UNCLEAN = """unclean AS (
  SELECT p_partkey AS product_id, p_name AS title, unnest(range(5)) AS variant,
    unnest([p_retailprice, 'nan'::DOUBLE, 'inf'::DOUBLE, '-inf'::DOUBLE, NULL]) AS score,
    p_retailprice::DECIMAL(10, 2)::DOUBLE AS amount FROM part)"""


@query("g6_sanitize_numbers", f"""WITH {_UNCLEAN}
SELECT product_id, variant, title, amount, CASE WHEN isnan(score) OR isinf(score) THEN NULL ELSE score END AS score
FROM unclean""")
def g6(spark, sf_dir):
    return N.sanitize(_unclean(spark, sf_dir)).select("product_id", _long("variant"), "title", "amount", "score")


@query("g16_nan_price_guard", f"""WITH {_UNCLEAN}
SELECT product_id, variant, CASE WHEN isnan(score) THEN NULL ELSE score END AS price FROM unclean""")
def g16(spark, sf_dir):
    return _unclean(spark, sf_dir).select("product_id", _long("variant"), N.nan_to_null(F.col("score")).alias("price"))


def _printed(spark, sf_dir) -> DataFrame:
    """Documents as a catalog prints them: lists of quoted strings with shop phrases around."""
    quoted = F.concat(
        F.lit("  ['Product Description "), "text", F.lit("' 'AMAZON.com, it'S\tFrom the Manufacturer',  'Best'\\n{x}' \"] "),
    )
    docs = W.documents(spark, sf_dir)
    return docs.select("product_id", "text", quoted.alias("printed"))


_PRINTED = """printed AS (
  SELECT doc_id AS product_id, text, '  [''Product Description ' || text || ''' ''AMAZON.com, it''S' || chr(9)
    || 'From the Manufacturer'',  ''Best''\\n{x}'' "] ' AS printed FROM documents)"""


def _chain_sql(c: str, *steps: tuple[str, str]) -> str:
    for pattern, replacement in steps:
        quote = pattern.replace("'", "''")
        c = f"regexp_replace({c}, '{quote}', '{replacement}', 'g')"
    return c


def clean_description_sql(c: str) -> str:
    bare = _strip_sql(_chain_sql(
        c, (r"\bProduct Description\b", ""), (r"(?i)Amazon\.com\b", ""), (r"\bFrom the Manufacturer\b", "")
    ))
    return _chain_sql(
        f"trim({bare}, '''\"[]')", (f"{_WS}+", " "), (f"'{_WS}*'", " "), ("'([A-Z])", r" \1")
    )


@query("g7_clean_description", f"""WITH {_PRINTED}
SELECT product_id, {clean_description_sql('printed')} AS description FROM printed""")
def g7(spark, sf_dir):
    return _printed(spark, sf_dir).select("product_id", T.clean_description(F.col("printed")).alias("description"))


@query("g8_clean_text", f"""WITH {_PRINTED}
SELECT product_id, {spaced_sql(_chain_sql('printed', ("[][{}'" + '"]', ' '), ('\\\\[nrt]', ' ')))} AS cleaned FROM printed""")
def g8(spark, sf_dir):
    return _printed(spark, sf_dir).select("product_id", T.clean_text(F.col("printed")).alias("cleaned"))


def display_text_sql(c: str) -> str:
    shown = _chain_sql(
        c, (r"[][]", ""), (f"'([^']*?)'{_JS}*'", r"\1 "), (f"'{_JS}*'", " "), ("^'|'$", ""), (f"{_JS}+", " ")
    )
    return f"regexp_replace({shown}, '^{_JS}+|{_JS}+$', '', 'g')"


@query("g9_ui_clean_text", f"WITH {_PRINTED} SELECT product_id, {display_text_sql('printed')} AS shown FROM printed")
def g9(spark, sf_dir):
    return _printed(spark, sf_dir).select("product_id", T.clean_display_text(F.col("printed")).alias("shown"))


def _image_texts(spark, sf_dir) -> DataFrame:
    """Every product with its image lists printed by numpy, as JSON, partly empty, and broken."""
    link = F.concat(F.lit("http://img/"), F.col("product_id").cast("string"), F.lit(".jpg"))
    shapes = [
        F.concat(F.lit("{'hi_res': array(['h"), link, F.lit("'], dtype=object), 'large': array(['l"), link,
                 F.lit("', None], dtype=object), 'thumb': array(['t"), link, F.lit("'], dtype=object)}")),
        F.concat(F.lit("{'hi_res': array(['h"), link, F.lit("'], dtype=object), 'large': array(['l"), link,
                 F.lit("'], dtype=object), 'thumb': array([], dtype=object)}")),
        F.concat(F.lit('{"large": [], "hi_res": [""], "thumb": ["t'), link, F.lit('"]}')),
        F.concat(F.lit('{"hi_res": ["h'), link, F.lit('"]}')),
        F.concat(F.lit('{"large": ["l'), link, F.lit('"]} trailing')),
        F.lit("{}"), F.lit(""), F.lit(None).cast("string"),
    ]
    return W.variants(W.products(spark, sf_dir).select("product_id"), "images", shapes)


@query("g10_first_image", """WITH shaped AS (
  SELECT product_id, unnest(range(8)) AS variant, unnest([
    '{''hi_res'': array([''h' || u || '''], dtype=object), ''large'': array([''l' || u || ''', None], dtype=object), ''thumb'': array([''t' || u || '''], dtype=object)}',
    '{''hi_res'': array([''h' || u || '''], dtype=object), ''large'': array([''l' || u || '''], dtype=object), ''thumb'': array([], dtype=object)}',
    '{"large": [], "hi_res": [""], "thumb": ["t' || u || '"]}', '{"hi_res": ["h' || u || '"]}',
    '{"large": ["l' || u || '"]} trailing', '{}', '', NULL]) AS images
  FROM (SELECT p_partkey AS product_id, 'http://img/' || p_partkey || '.jpg' AS u FROM part)),
json AS (
  SELECT *, regexp_replace(replace(replace(images, '''', '"'), 'array([', '['), '\\],\\s*dtype=object\\)', ']', 'g') AS j
  FROM shaped),
checked AS (SELECT *, CASE WHEN json_valid(j) THEN j END AS k FROM json)
SELECT product_id, variant, coalesce(nullif(k ->> '$.large[0]', ''), nullif(k ->> '$.hi_res[0]', ''),
       nullif(k ->> '$.thumb[0]', '')) AS image FROM checked""")
def g10(spark, sf_dir):
    return _image_texts(spark, sf_dir).select("product_id", _long("variant"), S.first_image(F.col("images")).alias("image"))


def _details(spark, sf_dir) -> DataFrame:
    """Events with their properties printed as a Python dictionary, sound and with an apostrophe inside."""
    events = spread(W.table(spark, sf_dir, "events").select("event_id", "event_type", "props"), "event_id")
    body = F.replace(F.replace("props", F.lit('"'), F.lit("'")), F.lit("}"), F.lit(""))
    shapes = [
        F.concat(body, F.lit(", 'kind': '"), "event_type", F.lit("', 'True Wireless': True, 'Color': None}")),
        F.concat(body, F.lit(", 'kind': ['it's  a', '"), "event_type", F.lit("']}")),
    ]
    return W.variants(events, "details", shapes)


_DETAILS = """shaped AS (
  SELECT event_id, unnest(range(2)) AS variant, unnest([
    b || ', ''kind'': ''' || event_type || ''', ''True Wireless'': True, ''Color'': None}',
    b || ', ''kind'': [''it''s  a'', ''' || event_type || ''']}']) AS details
  FROM (SELECT event_id, event_type, replace(replace(props, '"', ''''), '}', '') AS b FROM events)),
json AS (
  SELECT *, replace(replace(replace(replace(details, '''', '"'), 'True', 'true'), 'False', 'false'), 'None', 'null') AS j
  FROM shaped)"""


@query("g11_details_rows", f"""WITH {_DETAILS},
sound AS (SELECT * FROM json WHERE json_valid(j)),
keys AS (SELECT event_id, variant, j, unnest(json_keys(j)) AS key FROM sound)
SELECT event_id, variant, key, j ->> ('$."' || key || '"') AS value, NULL AS fallback FROM keys
UNION ALL
SELECT event_id, variant, NULL, NULL,
       regexp_replace(regexp_replace({display_text_sql('details')}, '[{{}}]|{_JS}+', ' ', 'g'), '^{_JS}+|{_JS}+$', '', 'g')
FROM json WHERE NOT json_valid(j)""")
def g11(spark, sf_dir):
    read = _details(spark, sf_dir).withColumn("parsed", S.details_map(F.col("details")))
    rows = read.select("event_id", "variant", "details", "parsed", F.explode_outer("parsed").alias("key", "value"))
    return rows.select(
        "event_id", _long("variant"), "key", "value",
        F.when(F.col("parsed").isNull(), S.details_fallback(F.col("details"))).alias("fallback"),
    )


@query("g12_to_json_columns", """SELECT p_partkey AS product_id,
  to_json({'brand': p_brand, 'size': p_size})::VARCHAR AS details,
  CASE WHEN p_type = 'PROMO' THEN '{}' ELSE to_json(string_split(p_name, ' '))::VARCHAR END AS features FROM part""")
def g12(spark, sf_dir):
    part = W.table(spark, sf_dir, "part")
    words = F.when(F.col("p_type") != "PROMO", F.split("p_name", " "))
    return part.select(
        F.col("p_partkey").alias("product_id"),
        S.json_or_empty(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("details"),
        S.json_or_empty(words).alias("features"),
    )


@query("g13_snippet", """SELECT doc_id AS product_id, substr(text, 1, 300) AS card, substr(text, 1, 250) AS line
FROM documents""")
def g13(spark, sf_dir):
    text = F.col("text")
    return W.documents(spark, sf_dir).select(
        "product_id", T.snippet(text).alias("card"), T.snippet(text, 250).alias("line")
    )


@query("g14_display_columns", f"""WITH {W.PRODUCTS},
p AS (SELECT *, floor(average_rating + 0.5)::INT AS n FROM products)
SELECT product_id, CASE WHEN store = 'Brand#1' THEN 'Unknown Store' ELSE store END AS store,
       '$' || printf('%.2f', price) AS price, repeat('★', n) || repeat('☆', 5 - n) AS stars,
       printf('%.1f', average_rating) AS rating, format('{{:,}}', rating_number * 1000) || ' reviews' AS reviews FROM p""")
def g14(spark, sf_dir):
    products = W.products(spark, sf_dir).withColumns(
        {
            "store": F.when(F.col("store") == "Brand#1", "").otherwise(F.col("store")),
            "rating_number": F.col("rating_number") * 1000,
        }
    )
    return cards(products)


@query("g15_load_timestamp", """SELECT p_partkey AS product_id, '2024-05-06 07:08:09' AS loaded FROM part""")
def g15(spark, sf_dir):
    stamped = W.products(spark, sf_dir).withColumn("timestamp", load_time(dt.datetime(2024, 5, 6, 7, 8, 9)))
    return stamped.select("product_id", F.col("timestamp").cast("string").alias("loaded"))

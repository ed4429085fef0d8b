"""Canonical tables of the catalog."""

from __future__ import annotations

from pyspark.sql import types as T

_INT, _LONG, _DOUBLE, _TEXT = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
_TIME, _FLAG, _VECTOR = T.TimestampNTZType(), T.BooleanType(), T.ArrayType(T.FloatType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


USERS = _table(user_id=_INT, name=_TEXT, email=_TEXT)
CATEGORY = _table(category_id=_LONG, title=_TEXT)
PRODUCT = _table(
    product_id=_LONG, title=_TEXT, type=_TEXT, source=_TEXT, added_by=_INT, main_category_id=_LONG, store=_TEXT,
    timestamp=_TIME, processed=_FLAG, description=_TEXT, price=_DOUBLE, images=_TEXT, average_rating=_DOUBLE,
    rating_number=_LONG, features=_TEXT, details=_TEXT,
)
PRODUCT_EMBEDDINGS = _table(
    embedding_id=_LONG, product_id=_LONG, description=_TEXT, embedding=_VECTOR, created_at=_TIME
)
QUERY_LOG = _table(query_id=_LONG, query_text=_TEXT, user_id=_INT, timestamp=_TIME)
QUERY_LOG_PRODUCT = _table(query_id=_LONG, product_id=_LONG)
CHUNK_VECTORS = _table(chunk_id=_LONG, product_id=_LONG, chunk_idx=_INT, chunk_text=_TEXT, embedding=_VECTOR)
SEARCH_REQUEST = _table(query_id=_LONG, query=_TEXT, k=_INT, user_id=_INT)

# The columns of the catalog CSV, all read as text.
CATALOG_CSV = _table(
    title=_TEXT, description=_TEXT, price=_TEXT, average_rating=_TEXT, rating_number=_TEXT, store=_TEXT,
    details=_TEXT, features=_TEXT, images=_TEXT, main_category=_TEXT,
)

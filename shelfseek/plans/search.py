"""Answer a whole table of search requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.operators.catalog import MAX_DISTANCE, join_products, split_requests, within_cutoff
from shelfseek.operators.embedding import TextEmbedder, hashing
from shelfseek.operators.nearest import L2_SQUARED, nearest
from shelfseek.operators.topk import best_hit_per_product, rerank
from shelfseek.plans.ann import CellIndex, search_cells


def request_vectors(requests: DataFrame, dim: int, embedder: TextEmbedder | None = None) -> DataFrame:
    """(query_id, k, embedding) of the accepted requests; the text is embedded as it was sent."""
    accepted, _ = split_requests(requests)
    vector = (embedder or hashing(dim)).vector
    return accepted.select("query_id", "k", vector(F.col("query")).alias("embedding"))


def search(
    requests: DataFrame, vectors: DataFrame | CellIndex, products: DataFrame, dim: int, limit: float = MAX_DISTANCE,
    embedder: TextEmbedder | None = None, probes: int | None = None,
) -> DataFrame:
    """The ranked products of every request. ``embedder`` must be the one that made the vectors.

    ``vectors`` may be an index of cells; then ``probes`` of them are looked into for each request.

    k bounds the chunks that are found, before the distance limit and before several chunks of one
    product become one result; a query may so get fewer than k products.
    """
    asked = request_vectors(requests, dim, embedder)
    if isinstance(vectors, CellIndex):
        found = search_cells(vectors, asked, dim, probes, L2_SQUARED)
    else:
        found = nearest(vectors, asked, dim)
    hits = within_cutoff(found, limit)
    return rerank(join_products(best_hit_per_product(hits).drop("rank"), products))

"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cursors import strict_limit
from ..model import CANDIDATES_PER_LIST, RequestError, SectionFilters
from .filters import active, with_facets, with_status


def cosine_distance(embedding: Column, query: list[float]) -> Column:
    """1 - cosine similarity in double precision, one matrix product per Arrow batch.

    A vector of another length, or without length, has no distance.
    """
    target = np.asarray(query, dtype=np.float64)
    norm = float(np.linalg.norm(target))

    @F.pandas_udf("double")
    def distance(vectors: pd.Series) -> pd.Series:
        usable = vectors.map(lambda vector: vector is not None and len(vector) == len(target)).to_numpy(dtype=bool)
        result = np.full(len(vectors), np.nan)
        if usable.any():
            matrix = np.stack(vectors[usable].to_numpy()).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                result[usable] = 1.0 - (matrix @ target) / (np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * norm)
        return pd.Series(result).where(~np.isnan(result), None)

    return distance(embedding)


def check_query_vector(query: list[float], dimensions: int) -> list[float]:
    if len(query) != dimensions or not np.isfinite(np.asarray(query, dtype=np.float64)).all():
        raise RequestError("semantic_unavailable", "query vector does not fit the index", 503)
    return [float(value) for value in query]


def neighbours(chunks: DataFrame, query: list[float], limit: int, embedding: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """Nearest chunks with distance and 1-based rank; the chunk id breaks ties.

    The top-k is a per-partition heap; only k rows per partition travel, and the
    final numbering sees at most `limit` rows.
    """
    return nearest(measured(chunks, query, embedding), limit, tie)


def measured(chunks: DataFrame, query: list[float], embedding: str = "embedding") -> DataFrame:
    """Chunks with their distance in place of the vector, so that no join or sort moves vectors."""
    return chunks.withColumn("distance", cosine_distance(F.col(embedding), query)).drop(embedding)


def nearest(scored: DataFrame, limit: int, tie: str = "chunk_id") -> DataFrame:
    # Chunks without a distance sort last and leave after the cut, so that no
    # filter makes Spark compute the distance twice.
    near = scored.orderBy(F.asc_nulls_last("distance"), tie).limit(strict_limit(limit)).filter(F.col("distance").isNotNull())
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", tie)))


def page_neighbours(page_chunks: DataFrame, pages: DataFrame, query: list[float], status: str = "published", limit: int = CANDIDATES_PER_LIST, model: str | None = None) -> DataFrame:
    """Nearest page chunks among live pages of a status, of one embedding model if it is given.

    Page ids are unique, so the inner join keeps each chunk once; unlike a
    semi-join it is not pushed below the distance.
    """
    eligible = with_status(active(pages), status).select(F.col("id").alias("page_id"))
    return nearest(measured(_of_model(page_chunks, model), query).join(eligible, "page_id"), limit)


def section_neighbours(
    section_chunks: DataFrame, searchable: DataFrame, query: list[float], filters: SectionFilters = SectionFilters(), tags: list[str] = (), status: str = "published", properties: dict | None = None,
    limit: int = CANDIDATES_PER_LIST, model: str | None = None,
) -> DataFrame:
    """Nearest section chunks; every facet is applied before the ranking."""
    eligible = with_facets(searchable, filters, list(tags), status, properties).select("section_id", "document_id", "version_id", "page_id")
    return nearest(measured(_of_model(section_chunks, model), query).join(eligible, "section_id"), limit)


def _of_model(chunks: DataFrame, model: str | None) -> DataFrame:
    """Chunks embedded by the wanted model: distances to vectors of another one mean nothing."""
    return chunks if model is None else chunks.filter(F.col("model") == model).drop("model")

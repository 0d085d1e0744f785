"""Composed retrieval over a whole table of queries.

Two paths exist and rank differently; both are kept:

* :func:`retrieve` — routed: the route sets *k* and the boost; hits are cut to *k* first, then boosted.
* :func:`search` — over-fetching: fetch up to twice as many hits, boost, then cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.functions import routing
from scrivano.functions.text import is_blank
from scrivano.operators import knn as nn
from scrivano.operators.embedding import DEFAULT_MODEL, embed, section_id
from scrivano.operators.rerank import boost_definitions, cut
from scrivano.session import cut_lineage
from scrivano.sources import vector_files

# Default number of results and the over-fetch factor.
DEFAULT_RESULTS = 5
OVER_FETCH = 2

Router = Callable[[DataFrame], DataFrame]
Embedder = Callable[[DataFrame], DataFrame]


def drop_blank(queries: DataFrame, query: str = "query") -> DataFrame:
    return queries.filter(~is_blank(F.col(query)))


def route(queries: DataFrame) -> DataFrame:
    """Add ``query_type, complexity, strategy`` to every query."""
    routed = queries.withColumn("_route", routing.route(F.col("query")))
    return routed.select(*queries.columns, "_route.*")


def expand(queries: DataFrame) -> DataFrame:
    """One row per query variant, the original first."""
    return queries.select(
        "query_id", F.posexplode(routing.query_variants(F.col("query"))).alias("variant_no", "query")
    )


def default_embedder(model: str = DEFAULT_MODEL, **options) -> Embedder:
    return lambda queries: embed(queries, "query", model, **options)


def project_hits(joined: DataFrame) -> DataFrame:
    """Hits in their public layout; missing metadata gets defaults, the score is 1 - distance."""
    return joined.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        section_id(F.col("embedding_index")).alias("id"),
        F.coalesce("section_number", F.lit("")).alias("section_number"),
        F.coalesce("section_path", F.lit("")).alias("section_path"),
        F.col("document").alias("content"),
        "distance",
        (F.lit(1.0) - F.col("distance")).alias("relevance_score"),
        F.coalesce("content_length", F.length("document")).cast("int").alias("content_length"),
    )


METADATA = ("document", "section_number", "section_path", "content_length")


def _encoded(asked: DataFrame, embedder: Embedder | None) -> DataFrame:
    """Queries with vectors. Several passes read them (measure, search, join), so a query is
    encoded once and kept in the shared checkpoint folder."""
    if "embedding" not in asked.columns:
        asked = cut_lineage((embedder or default_embedder())(asked))
    return asked


def retrieve(
    queries: DataFrame,
    collection: DataFrame,
    embedder: Embedder | None = None,
    router: Router | None = route,
    n_results: int = DEFAULT_RESULTS,
    boost: bool = False,
    store: nn.ExactStore | None = None,
    unique: bool = False,
    max_hits: int = nn.MAX_BROADCAST_HITS,
) -> DataFrame:
    """Routed retrieval: hits per query, boosted after the cut where the route asks for it.

    More than ``max_hits`` winners are not broadcast; ``unique`` states that the collection holds each
    index once, as one written by ``writers.write_bucketed`` does.

    ``queries``: ``query_id, query`` and, unless ``embedder`` adds it, ``embedding``. With
    ``router=None`` the arguments ``n_results`` and ``boost`` apply to all queries.
    """
    asked, nearest, bound = routed_nearest(queries, collection, embedder, router, n_results, boost, store)
    joined = nn.fetch_hits(nearest, collection, *METADATA, max_hits=bound if bound <= max_hits else None, unique=unique)
    hits = project_hits(joined).join(asked.select("query_id", "_boost"), "query_id")
    return boost_definitions(hits, F.col("_boost")).drop("_boost")


def routed_nearest(
    queries: DataFrame,
    collection: DataFrame,
    embedder: Embedder | None = None,
    router: Router | None = route,
    n_results: int = DEFAULT_RESULTS,
    boost: bool = False,
    store: nn.ExactStore | None = None,
) -> tuple[DataFrame, DataFrame, int]:
    """The encoded queries with ``_k`` and ``_boost``, their nearest vectors without any text, and a bound of these rows."""
    if router is not None:
        asked = router(queries).select(
            *queries.columns,
            F.col("strategy.n_results").alias("_k"),
            F.col("strategy.boost_definitions").alias("_boost"),
        )
    else:
        asked = queries.withColumn("_k", F.lit(n_results)).withColumn("_boost", F.lit(boost))
    asked = _encoded(asked, embedder)
    nearest = (store or nn.ExactStore(collection)).query(asked, "_k")
    return asked, nearest, nn.hit_rows(asked, "_k")


class FileStore(nn.ExactStore):
    """The store's contract over a ``vector_files`` collection; its count reads the list only."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "sqeuclidean", **options):
        super().__init__(vector_files.open_vectors(spark, path), metric, **options)
        self.path = path

    def count(self) -> int:
        return vector_files.count_vectors(self.path)


def over_fetch(n: Column, expansion: bool) -> Column:
    return n * OVER_FETCH if expansion else n


def _over_fetching(
    queries: DataFrame, embedder: Embedder | None, n_results: int, use_expansion: bool
) -> DataFrame:
    asked = queries.withColumn("_k", over_fetch(F.lit(n_results), use_expansion)).withColumn(
        "_boost", routing.has_definition_intent(F.col("query")) & F.lit(use_expansion)
    )
    return _encoded(asked, embedder)


def _boost_and_cut(joined: DataFrame, asked: DataFrame, n_results: int) -> DataFrame:
    hits = project_hits(joined).join(asked.select("query_id", "_boost"), "query_id")
    boosted = boost_definitions(hits, F.col("_boost"), topic_penalties=True).drop("_boost")
    return cut(boosted, n_results)


def search(
    queries: DataFrame,
    collection: DataFrame,
    embedder: Embedder | None = None,
    n_results: int = DEFAULT_RESULTS,
    use_expansion: bool = True,
    store: nn.ExactStore | None = None,
) -> DataFrame:
    """Over-fetching retrieval: definition queries are boosted before the cut."""
    asked = _over_fetching(queries, embedder, n_results, use_expansion)
    nearest = (store or nn.ExactStore(collection)).query(asked, "_k")
    bound = nn.hit_rows(asked, "_k")
    joined = nn.fetch_hits(nearest, collection, *METADATA, max_hits=bound)
    return _boost_and_cut(joined, asked, n_results)


def search_flat(
    queries: DataFrame,
    index: DataFrame,
    mapping: DataFrame,
    sections: DataFrame,
    embedder: Embedder | None = None,
    n_results: int = DEFAULT_RESULTS,
    use_expansion: bool = True,
) -> DataFrame:
    """Search a bare vector index and look the winners up by position.

    ``index``: ``position, embedding``; ``mapping``: ``position, embedding_index``; positions
    without a mapping are skipped *after* the search, so such queries return fewer hits.
    """
    asked = _over_fetching(queries, embedder, n_results, use_expansion)
    vectors = index.select(F.col("position").alias("embedding_index"), "embedding")
    nearest = nn.knn(vectors, asked, "_k").withColumnRenamed("embedding_index", "position")
    bound = nn.hit_rows(asked, "_k")
    small = F.broadcast(nearest) if bound <= nn.MAX_BROADCAST_HITS else nearest
    mapped = mapping.select("position", "embedding_index").join(small, "position").drop("position")
    content = sections.withColumnRenamed("content", "document")
    joined = nn.fetch_hits(mapped, content, *METADATA, max_hits=bound)
    return _boost_and_cut(joined, asked, n_results)

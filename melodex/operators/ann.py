"""Approximate search by stored cells and product codes, and compression by principal components."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melodex.functions.vectors import unit

from .cell_index import BITS, PARTS, CellIndex, NoVectors, temporary
from .features import require_one_dimension
from .search import topk

# From how many vectors the index is approximate; bound of components; rows for PCA.
APPROXIMATE_FROM, MOST_COMPONENTS, PCA_FROM = 1000, 256, 200


def adaptive_components(n: int, dim: int) -> int:
    return max(2, min(MOST_COMPONENTS, n // 3, dim))


def ivf_topk(queries: DataFrame, catalogue: DataFrame, k: int, cells: int | None = None, probes: int | None = None, seed: int = 1, whole: bool = False) -> DataFrame:
    """query_id, rank, song_id, score: exact scores within each query's nearest cells only, by an index made for this call;
    ``CellIndex`` keeps one. With ``whole``, also within all other cells that may hold one of the K best: nothing is missed.

    Without ``probes`` an audit says how many cells hold the neighbours. Nulls, ties, repeats and empty sides as in
    ``topk``; results may be fewer than K where the probed cells hold fewer.
    """
    try:
        index = temporary(catalogue, cells=cells, probes=probes, codes=False, seed=seed)
    except NoVectors:
        return topk(queries, catalogue, k)
    return index.search(queries, k, whole=whole)


def pq_topk(queries: DataFrame, catalogue: DataFrame, k: int, parts: int = PARTS, bits: int = BITS, pool: int | None = None, seed: int = 1, cells: int | None = None, probes: int | None = None, whole: bool = False) -> DataFrame:
    """query_id, rank, song_id, score: candidates by product codes within the probed cells, then their exact scores, by an
    index made for this call; ``CellIndex`` keeps one. With ``whole``, candidates are all that codes can't rule out, of all
    cells: nothing is missed.

    ``parts`` is halved until it divides the length. Candidates are ``pool`` times K songs a query; where it isn't given,
    all whose rough scores lie within the audited margin of the K-th best. Nulls, ties, repeats and empty sides as in ``topk``.
    """
    try:
        index = temporary(catalogue, cells=cells, probes=probes, parts=parts, bits=bits, seed=seed, audited=not whole)
    except NoVectors:
        return topk(queries, catalogue, k)
    return index.search_codes(queries, k, pool, whole=whole)


def indexed_topk(queries: DataFrame, catalogue: DataFrame, k: int, approximate: bool | None = None, index: CellIndex | None = None, whole: bool = False) -> DataFrame:
    """Exact below APPROXIMATE_FROM vectors, by cells from there on (those of ``index``, if there is one), or as told; with
    ``whole``, cells miss nothing either."""
    if approximate is None:
        approximate = catalogue.count() >= APPROXIMATE_FROM
    if approximate and index:
        return index.search(queries, k, whole=whole)
    return ivf_topk(queries, catalogue, k, whole=whole) if approximate else topk(queries, catalogue, k)


def pca_fit(df: DataFrame, components: int | None = None):
    """(scaler, pca, sum of explained variance) over the vectors; refuses fewer than ten rows or mixed lengths."""
    n, dim = require_one_dimension(df)
    v = df.where("vec is not null").withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    scaler = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(v)
    pca = PCA(k=components or adaptive_components(n, dim), inputCol="centred", outputCol="projected").fit(scaler.transform(v))
    return scaler, pca, float(sum(pca.explainedVariance))


def pca_project(df: DataFrame, scaler, pca) -> DataFrame:
    """The vectors through a fitted model (never fitted again), to length one."""
    v = df.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    out = pca.transform(scaler.transform(v)).withColumn("vec", unit(vector_to_array("projected")))
    return out.drop("features", "centred", "projected")


def save_projection(scaler, pca, path: str) -> None:
    """Keep a fitted model under a path that all executors share."""
    PipelineModel([scaler, pca]).write().overwrite().save(path)


def load_projection(path: str):
    """(scaler, pca) as ``save_projection`` kept them, for ``pca_project``."""
    return tuple(PipelineModel.load(path).stages)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results that were found."""
    hit = exact.join(found.select("query_id", "song_id").hint("merge"), ["query_id", "song_id"], "left_semi").count()
    return hit / max(1, exact.count())

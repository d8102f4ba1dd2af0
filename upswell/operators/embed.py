"""Corpus embedding (N3, N10, X19) and topic clustering.

Default encoder: a Spark ML pipeline (token regex -> hashed term counts ->
IDF -> L2 normaliser), all JVM-side. Any Python encoder (for example a
sentence-embedding model) plugs in through ``embed_with``: ``mapInPandas``
feeds it Arrow batches, split into encoder batches, one model per Python
worker. Clustering is Spark ML KMeans on the unit vectors (cosine); rows far
from their centre become the outlier topic -1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from upswell.functions.vectors import dot
from upswell.operators.semantic import semantic_text
from upswell.session import ensure_checkpoint_dir

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
DEFAULT_DIM = 384
ENCODER_BATCH = 64


@dataclass
class TextEncoder:
    """The fitted default encoder: token regex -> hashed counts -> IDF -> L2."""

    dim: int
    idf: IDFModel

    def _tf(self, df: DataFrame, text: str) -> DataFrame:
        tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False,
                             toLowercase=True)
        return HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=self.dim).transform(tok.transform(df))

    def vectors(self, tfs: DataFrame, keep: list[str]) -> DataFrame:
        out = Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0).transform(self.idf.transform(tfs))
        return out.select(*keep, vector_to_array("_vec", "float32").alias("embedding"))

    def encode(self, df: DataFrame, text: str, keep: list[str]) -> DataFrame:
        return self.vectors(self._tf(df, text).select(*keep, "_tf"), keep)


def fit_corpus(df: DataFrame, dim: int = DEFAULT_DIM, key: str = "complaint_id",
               date: str = "date_received") -> tuple[DataFrame, TextEncoder]:
    """Embed every complaint's semantic text and return the fitted encoder too
    (for query texts, N10)."""
    st = semantic_text(df, date=date)
    cols = [key] + ([date] if date in df.columns else []) + ["has_narrative"]
    # The texts are read once: term vectors (far smaller than the texts) are
    # checkpointed to the cluster's checkpoint folder, then IDF is fitted on
    # them and applied to them. This also cuts the lineage back to the texts.
    ensure_checkpoint_dir(df.sparkSession)
    enc = TextEncoder(dim, None)  # type: ignore[arg-type]
    tfs = enc._tf(st, "semantic_text").select(*cols, "_tf").checkpoint(eager=True)
    enc.idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(tfs)  # document frequencies: dim numbers
    return enc.vectors(tfs, cols), enc


def embed_corpus(df: DataFrame, dim: int = DEFAULT_DIM, key: str = "complaint_id",
                 date: str = "date_received") -> DataFrame:
    """One unit vector per complaint from its semantic text (Spark ML)."""
    return fit_corpus(df, dim, key, date)[0]


def embed_query_texts(queries: DataFrame, encoder: TextEncoder, text: str = "query_text") -> DataFrame:
    """Query vectors in the corpus space (N10): (query_id, embedding)."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"),
                       F.btrim(F.coalesce(F.col(text), F.lit(""))).alias("_q"))
    return encoder.encode(q, "_q", ["query_id"])


def embed_with(df: DataFrame, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]], dim: int,
               key: str = "complaint_id", text: str = "semantic_text",
               batch_size: int = ENCODER_BATCH) -> DataFrame:
    """Embed ``text`` with any Python encoder, normalised to unit length.

    ``load_encoder()`` runs once per Python worker and returns
    ``encode(list[str]) -> (n, dim) array``.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoder()
        for pdf in it:
            texts = pdf[text].fillna("").astype(str).tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                v = np.asarray(encode(texts[i:i + batch_size]), dtype=np.float64).reshape(-1, dim)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                vecs.append(np.divide(v, n, out=np.zeros_like(v), where=n > 0))
            mat = np.vstack(vecs) if vecs else np.zeros((0, dim))
            yield pd.DataFrame({key: pdf[key].to_numpy(), "embedding": list(mat.astype(np.float32))})

    return df.select(key, text).mapInPandas(run, f"{key} long, embedding array<float>")


def embed_queries(queries: DataFrame, load_encoder, dim: int, text: str = "query_text") -> DataFrame:
    """Query vectors with the same encoder (N10); rows keep their query_id."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"),
                       F.btrim(F.col(text)).alias("semantic_text"))
    return embed_with(q, load_encoder, dim, key="query_id")


def assign_topics(emb: DataFrame, k: int = 10, min_similarity: float = 0.2, seed: int = 42,
                  key: str = "complaint_id", max_iter: int = 20) -> DataFrame:
    """KMeans topics on unit vectors; similarity below ``min_similarity`` -> -1.

    The fit is iterative, so its input is persisted (memory, spilling to disk)
    for the duration of the fit and released after.
    """
    def vectors():
        return emb.select(key, "embedding").filter(F.size("embedding") > 0) \
            .withColumn("_v", array_to_vector("embedding"))

    data = vectors().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", distanceMeasure="cosine",
                       maxIter=max_iter).fit(data)
    finally:
        data.unpersist()
    centres = []
    for i, c in enumerate(model.clusterCenters()):  # k vectors: bounded by k
        n = float(np.linalg.norm(c))
        centres.append((i, [float(x) / n if n > 0 else 0.0 for x in c]))
    cdf = emb.sparkSession.createDataFrame(centres, "topic_id int, centre array<double>")
    return assign_to_centres(emb, cdf, min_similarity, key)


def assign_to_centres(emb: DataFrame, centres: DataFrame, min_similarity: float = 0.2, key: str = "complaint_id") -> DataFrame:
    """Nearest centre by cosine of unit vectors (ties: the lower topic); below ``min_similarity`` -> -1.

    ``centres`` (topic_id, centre) are k rows: they go to every row as one array.
    """
    listed = F.sort_array(F.collect_list(F.struct("topic_id", F.transform("centre", lambda x: x.cast("double")).alias("centre"))))
    rows = emb.select(key, "embedding").filter(F.size("embedding") > 0).withColumn("_cs", centres.agg(listed).scalar())
    each = F.transform("_cs", lambda c: F.struct(dot(F.col("embedding"), c["centre"]).alias("s"), (-c["topic_id"]).alias("t")))
    best = rows.select(key, F.array_max(each).alias("_b"))
    sim = F.col("_b.s")
    return best.select(key, F.when(sim >= F.lit(min_similarity), -F.col("_b.t")).otherwise(F.lit(-1)).cast("int").alias("topic_id"),
                       F.bround(sim, 6).alias("similarity"))

"""The dimension table of known models, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model_id string, family string, n_layers int, n_heads int, n_kv_heads int, head_dim int, layer_lo int, layer_hi int"
#: Published shapes of the models, and the layers that are read (from, to).
MODELS = (
    ("meta-llama/Llama-3.1-8B-Instruct", "llama", 32, 32, 8, 128, 8, 31),
    ("meta-llama/Llama-3.1-8B", "llama", 32, 32, 8, 128, 8, 31),
    ("microsoft/Phi-3-mini-128k-instruct", "phi", 32, 32, 32, 96, 8, 31),
    ("google/gemma-2-2b-it", "gemma", 26, 8, 4, 256, 6, 25),
    ("Qwen/Qwen2.5-7B-Instruct", "qwen", 28, 28, 4, 128, 7, 27),
    ("mistralai/Mistral-7B-Instruct-v0.3", "mistral", 32, 32, 8, 128, 8, 31),
    ("google/gemma-4-26b-a4b-it", "gemma", 30, 32, 8, 256, 8, 29),
)


def registry(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """Known models; those of `more` replace known ones of the same id."""
    known = spark.createDataFrame(MODELS, SCHEMA)
    return known if more is None else known.join(more.select("model_id"), "model_id", "left_anti").select(*known.columns).unionByName(more)


def read_layers(n_layers: Column) -> Column:
    """Layers that are read of a model that isn't listed: all but the first quarter, at least one."""
    return F.sequence(F.greatest(F.lit(1), F.floor(n_layers / 4).cast("int")), n_layers - 1)


def vector_dims(head_dim: Column, n_kv_heads: Column, n_frequencies: int = 2) -> Column:
    """Length of a frequency fingerprint that keeps the heads."""
    return head_dim * n_kv_heads * n_frequencies


def fits(n_kv_heads: Column, head_dim: Column, spec_heads: Column, spec_dim: Column) -> Column:
    """If a tensor's shape is that of the model."""
    return (n_kv_heads == spec_heads) & (head_dim == spec_dim)

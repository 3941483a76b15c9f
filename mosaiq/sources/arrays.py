"""Coordinate and label arrays in .npy / .npz files, one file per section."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _frames(batches: Iterator[pd.DataFrame], rows) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            yield rows(path, np.load(io.BytesIO(content), allow_pickle=False))


def read_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """(section, cell_id, x, y) from files ``<section>_XY.npy``; cell_id is the row number in the file.

    Raises FileNotFoundError if there is none. Each file is read by one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_XY.npy").load(folder)
    if files.isEmpty():
        raise FileNotFoundError(f"no *_XY.npy in {folder}")

    def rows(path: str, a: np.ndarray) -> pd.DataFrame:
        name = path.rsplit("/", 1)[-1].removesuffix("_XY.npy")
        return pd.DataFrame({"section": name, "cell_id": np.arange(len(a)), "x": a[:, 0].astype(float), "y": a[:, 1].astype(float)})

    return files.select("path", "content").mapInPandas(lambda it: _frames(it, rows), "section string, cell_id long, x double, y double")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(config_id, section, cell_id, label) from files ``<config folders>/<section>.npy`` below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").rsplit("/", 1)[-1]

    def rows(path: str, a: np.ndarray) -> pd.DataFrame:
        rel = path.rsplit(f"/{base}/", 1)[-1].removesuffix(".npy")
        config, _, section = rel.rpartition("/")
        return pd.DataFrame({"config_id": config, "section": section, "cell_id": np.arange(len(a)), "label": a.astype(np.int32)})

    return files.select("path", "content").mapInPandas(lambda it: _frames(it, rows), "config_id string, section string, cell_id long, label int")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst[, k]) from .npy edge lists of two or three columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)

    def rows(_: str, a: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"src": a[:, 0].astype(np.int64), "dst": a[:, 1].astype(np.int64), "k": a[:, 2].astype(np.int32) if a.shape[1] > 2 else np.zeros(len(a), np.int32)})

    return files.select("path", "content").mapInPandas(lambda it: _frames(it, rows), "src long, dst long, k int")


def write_labels(labels: DataFrame, out: str) -> None:
    """Labels partitioned by configuration and section, so that one of either can be read alone."""
    labels.repartition("config_id", "section").write.partitionBy("config_id", "section").parquet(out)


def labels_of(spark: SparkSession, path: str, config_id: str, sections: list[str] | None = None) -> DataFrame:
    """Labels of one configuration, for given sections; sections that are missing are skipped."""
    d = spark.read.parquet(path).where(F.col("config_id") == config_id)
    return d.where(F.col("section").isin(sections)) if sections else d

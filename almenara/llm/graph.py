"""Connected components of a table of links, and streams of sorted groups, for operators on pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almenara.session import pin


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links (u, v)``: the smallest node that can be reached.

    Smallest labels spread along links and labels of labels are followed, so chains shorten by half or more in a
    round. Every round ends in the shared checkpoint folder. A node with very many links is summed on the map side,
    and the links meet the labels as plain tables, which Spark may split where a key is hot.
    """
    both = links.filter("u <> v").select("u", "v")
    both = pin(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = pin(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        told = both.join(labels, both["v"] == labels["node"]).select(F.col("u").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        near = told.union(labels.select("node", "label", F.col("label").alias("own"))).groupBy("node").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        above = near.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        far = pin(near.join(above, near["label"] == above["_node"]).select("node", F.col("_label").alias("label"), "own"))
        labels = far.select("node", "label")
        if far.filter("label < own").isEmpty():
            return labels


def groups(batches: Iterable[pa.RecordBatch], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by their first column: a table, and where its groups begin (and its end).

    Groups come in tables of about ``rows`` rows; one group is never cut.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if last:
            yield table.slice(0, last).combine_chunks(), bounds(key[:last])
        held = table.slice(last).combine_chunks().to_batches()
        n = len(table) - last
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table.column(0).to_numpy())


def bounds(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def smallest_reached(near: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For boolean ``near`` (groups, m, m) and names (groups, m): the smallest name each member can reach."""
    label = name.copy()
    top = np.iinfo(name.dtype).max
    while True:
        new = np.minimum(label, np.where(near, label[:, None, :], top).min(axis=2))
        if (new == label).all():
            return label
        label = new

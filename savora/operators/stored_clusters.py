"""Clusters that survive a later load.

A load's clusters are stored as centres, the mean vector of their names with number and label. Names of a later load
that the business already has keep their cluster. Of the others, each goes to the nearest stored centre if that
is within reach; what is left is clustered by itself, k being the same percentage of the names left, under numbers above all
the business has. Stored centres do not move, so numbers and labels of earlier mentions stay as they are.

Names meet centres by business and by the first parts of a signature of their vectors, more parts the more centres the
business has, so that a name is compared with a few dozen whatever their number. A centre across a border of the signature
is not found; the name then opens a cluster of its own. The names and centres of a cell are dealt to tiles of a few
thousand of each, and tiles that are smaller go together, so that no call is made for a handful of names.

All of this is done once a name, not once a mention: a load's mentions are counted by name first and meet their clusters last.
The vector of a name is made once a load.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.operators.clustering import PARTS, cluster_names, mention_text, signed_texts, signed_vectors, unpacked, whole_groups
from savora.operators.grouped import modal_value
from savora.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cosine from which a name belongs to a stored centre, and centres of a business that share a cell, about.
REACH = 0.8
CELL = 64
UNIT = ["business_name", "meal_name"]
KEY = ["name_hash__", "business_key__", "meal_key__"]
# Names, and centres, of a tile, about.
TILE = 4096
# What products of doubles may differ from the sums of ``_dots``, with room to spare.
SLACK = 1e-4


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the names as keys (KEY) that are never null, a hash first: what is grouped by them joins as it lies."""
    texts = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in UNIT]
    return rows.withColumns(dict(zip(KEY, [F.xxhash64(*UNIT), *texts], strict=True)))


def counted_names(mentions: DataFrame) -> DataFrame:
    """Distinct names by key, how often they occur and their mean sentiment."""
    mean = F.avg(F.coalesce("sentiment", F.lit(0.5)).cast("decimal(18,6)")).cast("double")
    return keyed(mentions).groupBy(*KEY).agg(F.count("*").alias("weight"), mean.alias("sentiment"))


def _named() -> list[Column]:
    return [F.expr(f"substring(nullif({key}, ''), 2)").alias(name) for key, name in zip(KEY[1:], UNIT, strict=True)]


def named_vectors(names: DataFrame, size: int = 64, with_sentiment: bool = True) -> DataFrame:
    """Counted names with their packed ``vector`` and its ``signature``; the mean sentiment has done its work."""
    name = F.coalesce("meal_name", F.lit(""))
    text = mention_text(name, F.col("sentiment")) if with_sentiment else F.lower(name)
    return signed_texts(names, text, size).drop("sentiment")


def _means(keys: list[str]):
    """Names sorted by cluster to the weighted means of their vectors; a task holds one cluster and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, keys):
            weights, vectors = rows["weight"].to_numpy(), unpacked(rows["vector"]).astype(np.float64)
            sums = np.add.reduceat(vectors * weights[:, None], starts, axis=0)
            means = (sums / np.add.reduceat(weights, starts)[:, None]).astype(np.float32)
            at = pa.array(np.arange(len(starts) + 1) * means.shape[1], pa.int32())
            own = [rows[c].take(pa.array(starts)) for c in keys]
            yield pa.record_batch([*own, pa.ListArray.from_arrays(at, pa.array(means.ravel()))], names=[*keys, "centre"])

    return run


def centres_of(names: DataFrame, keys: Sequence[str] = ("business_name", "cluster")) -> DataFrame:
    """``keys`` and ``centre`` of every cluster of names with ``weight`` and packed ``vector``."""
    hashed = names.select(F.xxhash64(*keys).alias("hash__"), *keys, "weight", "vector")
    ordered = hashed.repartition("hash__", *keys).sortWithinPartitions("hash__", *keys)
    schema = ", ".join(f"{c} {names.schema[c].dataType.simpleString()}" for c in keys)
    return ordered.mapInArrow(_means([*keys]), f"{schema}, centre array<float>")


def _same(left: list[str], right: list[str]) -> Column:
    """Equal, or null on both sides. The hash comes first, so that sorts need not compare texts that begin alike."""
    test = F.xxhash64(*left) == F.xxhash64(*right)
    for a, b in zip(left, right, strict=True):
        test = test & F.col(a).eqNullSafe(F.col(b))
    return test


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows with rows beside them; added place by place, so that they do not depend on the tile."""
    found = np.zeros(len(a))
    for i in range(a.shape[1]):
        found += a[:, i] * b[:, i]
    return found


def _near(told: np.ndarray, held: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile that may be within reach."""
    a, b = told.astype(np.float64), held.astype(np.float64)
    lengths = np.sqrt((a**2).sum(axis=1)), np.sqrt((b**2).sum(axis=1))
    found = []
    for at in range(0, len(a), 256):
        with np.errstate(divide="ignore", invalid="ignore"):
            cosines = a[at : at + 256] @ b.T / (lengths[0][at : at + 256, None] * lengths[1])
        name, centre = np.nonzero(cosines >= reach - SLACK)
        found.append((name + at, centre))
    return found[0] if len(found) == 1 else tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _met(reach: float):
    """The names and the centres of some tiles to the pairs within reach, with their cosine."""

    def run(names: pa.Table, centres: pa.Table) -> pa.Table:
        pairs, told, held = [], None, None
        if len(names) and len(centres):
            tiles = pa.chunked_array(names["tile__"].chunks + centres["tile__"].chunks).combine_chunks().dictionary_encode().indices.to_numpy()
            orders, codes = [], []
            for some in (tiles[: len(names)], tiles[len(names) :]):
                orders.append(some.argsort(kind="stable"))
                codes.append(some[orders[-1]])
            names, centres = (t.take(pa.array(o)).combine_chunks() for t, o in zip((names, centres), orders, strict=True))
            told, held = (unpacked(t["vector"].chunk(0)) for t in (names, centres))
            tile, first = np.unique(codes[0], return_index=True)
            last = np.append(first[1:], len(names))
            low, high = (np.searchsorted(codes[1], tile, side=side) for side in ("left", "right"))
            for a, b, c, d in zip(*(x.tolist() for x in (first, last, low, high)), strict=True):
                if c < d:
                    name, centre = _near(told[a:b], held[c:d], reach)
                    pairs.append((name + a, centre + c))
        found = []
        if pairs:
            name, centre = (np.concatenate(x) for x in zip(*pairs, strict=True))
            lengths = [np.sqrt(_dots(v, v)) for v in (told, held)]
            for at in range(0, len(name), 1 << 16):
                n, c = name[at : at + (1 << 16)], centre[at : at + (1 << 16)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosines = _dots(told[n], held[c]) / (lengths[0][n] * lengths[1][c])
                near = cosines >= reach
                found.append((n[near], c[near], cosines[near]))
        name, centre, cosine = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        name, centre = pa.array(name, pa.int64()), pa.array(centre, pa.int64())
        of = [names[c].take(name) for c in UNIT] + [pa.array(cosine, pa.float64())] + [centres[c].take(centre) for c in ("cluster", "cluster_label")]
        return pa.table(of, names=[*UNIT, "cosine", "cluster", "cluster_label"])

    return run


def nearest_centres(names: DataFrame, centres: DataFrame, reach: float = REACH) -> DataFrame:
    """Of names with vectors, those within reach of a stored centre, with its ``cluster`` and ``cluster_label``.

    Vectors come as arrays (``embedding``), or packed with their signatures; such names are read twice and should be stored.
    """
    counts = centres.groupBy(F.col("business_name").alias("b__")).agg(F.count("*").alias("n__"))
    parts = F.least(F.lit(PARTS), F.greatest(F.lit(0), F.ceil(F.log(F.col("n__") / CELL) / F.log(F.lit(8.0)))).cast("int"))
    # Written, so that the joins can split a business with very many names.
    depths = stored(counts.select("b__", parts.alias("depth")), "centre-depths")
    key = F.coalesce(F.concat(F.lit("="), "business_name"), F.lit(""))
    place = ["key__", "cell__"]

    def celled(rows: DataFrame) -> DataFrame:
        """With the key of their business and cell; vectors of other lengths share none."""
        size = (F.octet_length("vector") / 4).cast("int")
        cell = F.concat(size.cast("string"), F.lit(":"), F.substring("signature", F.lit(1), F.col("depth")))
        return rows.join(depths, _same(["business_name"], ["b__"])).withColumns({"key__": key, "cell__": cell, "size__": size}).drop("depth", "b__", "signature")

    if "vector" not in names.columns:
        names = stored(signed_vectors(names.select(*UNIT, "embedding").where(F.col("embedding").isNotNull()), "embedding").drop("embedding"), "named-vectors")
    held = centres.toDF("business_name", "cluster", "cluster_label", "centre").where(F.col("centre").isNotNull())
    held = stored(signed_vectors(held.withColumn("cluster", F.col("cluster").cast("int")), "centre").withColumn("hash__", F.xxhash64("cluster", "centre")).drop("centre"), "centre-vectors")
    told, held = celled(names.select(*UNIT, "vector", "signature")), celled(held)
    tiles = [
        rows.groupBy(*place).agg(F.count("*").alias(f"{name}_rows")).withColumn(name, F.ceil(F.col(f"{name}_rows") / TILE))
        for rows, name in ((told, "names__"), (held, "centres__"))
    ]
    tiles = stored(tiles[0].join(tiles[1], place), "tiles")
    every = F.sum(F.col("names___rows") * F.col("centres__") + F.col("centres___rows") * F.col("names__"))
    groups = max(1, -(-(tiles.agg(every).first()[0] or 0) // (2 * TILE)))
    tiles = tiles.drop("names___rows", "centres___rows")

    def others(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    told = told.join(tiles, place).withColumn("name__", F.pmod(F.xxhash64("meal_name"), "names__")).withColumn("centre__", others("centres__"))
    held = held.join(tiles, place).withColumn("centre__", F.pmod("hash__", "centres__")).withColumn("name__", others("names__"))
    # The key of a business is last, as it may hold anything; one group has vectors of one length.
    tile = F.concat_ws(":", F.col("name__").cast("string"), F.col("centre__").cast("string"), "cell__", "key__")
    group = [F.pmod(F.xxhash64("tile__"), F.lit(groups)).alias("group__"), "size__"]
    told = told.withColumn("tile__", tile).select(*group, "tile__", *UNIT, "vector").groupBy("group__", "size__")
    held = held.withColumn("tile__", tile).select(*group, "tile__", "cluster", "cluster_label", "vector").groupBy("group__", "size__")
    met = told.cogroup(held).applyInArrow(_met(reach), "business_name string, meal_name string, cosine double, cluster int, cluster_label string")
    best = F.max(F.struct("cosine", (-F.col("cluster")).alias("order"), "cluster", "cluster_label"))
    return met.groupBy(*UNIT).agg(best.alias("best")).select(*UNIT, "best.cluster", "best.cluster_label")


def assigned_names(
    mentions: DataFrame, earlier: DataFrame, centres: DataFrame, percent: int = 50, reach: float = REACH, with_sentiment: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The distinct names of a later load with ``cluster`` and ``cluster_label``, and the centres of the clusters it opens.

    Names of ``earlier`` mentions keep theirs. Names that were never clustered get no other name's number; ``earlier``
    may be any stored mentions. Where the cluster of a kept name has no centre, it is opened by the load's names.
    """
    unit = ["b__", "m__"]
    # Distinct first: a smallest text is found by sorting, and that need not be all mentions.
    known = earlier.where("cluster is not null").select(*UNIT, "cluster", "cluster_label").distinct()
    known = keyed(known).groupBy(*KEY).agg(F.min("cluster").alias("cluster"), F.min("cluster_label").alias("cluster_label"))
    names = counted_names(mentions).join(known, KEY, "left")
    names = stored(names.select(*_named(), "weight", "sentiment", "cluster", "cluster_label"), "load-names")
    kept, fresh = names.where("cluster is not null"), names.where("cluster is null").drop("cluster", "cluster_label")
    fresh = stored(named_vectors(fresh, with_sentiment=with_sentiment), "fresh-names")
    near = stored(nearest_centres(fresh, centres, reach), "near-names")
    left = fresh if near.isEmpty() else stored(fresh.join(near.select(*UNIT).toDF(*unit), _same(UNIT, unit), "left_anti"), "left-names")
    own = stored(cluster_names(left, percent), "left-clusters")

    key = ["business_name", "cluster"]
    hashed = own.withColumn("hash__", F.xxhash64(*key))
    labels = modal_value(hashed, ["hash__", *key], "meal_name", "l__", "weight").drop("hash__")
    # A cluster of no more than the mentions without a meal has no label.
    nameless = own.where(F.col("meal_name").isNull()).select(*key).join(labels.select(*key).toDF("lb__", "lc__"), _same(key, ["lb__", "lc__"]), "left_anti")
    labels = labels.union(nameless.withColumn("l__", F.lit(None).cast("string")))
    top = centres.groupBy(F.col("business_name").alias("tb__")).agg(F.max("cluster").alias("top__"))
    number = (F.col("cluster") + F.coalesce(F.col("top__") + 1, F.lit(0))).cast("int")
    numbers = labels.join(top, _same(["business_name"], ["tb__"]), "left").select(
        F.col("business_name").alias("b__"), F.col("cluster").alias("c__"), number.alias("number"), F.col("l__").alias("cluster_label")
    )
    numbers = stored(numbers, "numbers")
    same = _same(key, ["b__", "c__"])
    placed = own.select(*UNIT, "cluster").join(numbers, same).select(*UNIT, F.col("number").alias("cluster"), "cluster_label")
    of = [*UNIT, "cluster", "cluster_label"]

    opened = centres_of(own.where(F.col("meal_name").isNotNull())).join(numbers, same).select("business_name", F.col("number").alias("cluster"), "cluster_label", "centre")
    # Rows without a meal are not stored, and open no cluster.
    bare = kept.where(F.col("meal_name").isNotNull()).join(centres.select(F.col("business_name").alias("b__"), F.col("cluster").alias("c__")), same, "left_anti")
    bare = stored(bare, "bare-names")
    if not bare.isEmpty():
        means = centres_of(named_vectors(bare, with_sentiment=with_sentiment), ["business_name", "cluster", "cluster_label"])
        opened = opened.union(means)
    return kept.select(*of).union(near.select(*of)).union(placed), opened


def assigned(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """``mentions`` of a later load with ``cluster`` and ``cluster_label`` of their names, as ``assigned_names`` has them."""
    unit = ["b__", "m__"]
    return mentions.join(names.toDF(*unit, "cluster", "cluster_label"), _same(UNIT, unit)).select(*mentions.columns, "cluster", "cluster_label")

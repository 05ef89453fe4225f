"""Pedigree operators over (idx, sire, dam), parents null where unknown."""

from __future__ import annotations

import heapq
import pickle
import uuid
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.tables import open_fs, shared_root, written


def generations(ped: DataFrame, limit: int = 200) -> DataFrame:
    """(idx, generation): 0 for founders, else one more than the larger of the parents'. Needs no order of rows.

    Level by level: the children of a level are in the next one, and an animal's last level counts.
    """
    parents = ped.select("idx", F.explode(F.array("sire", "dam")).alias("parent")).where("parent is not null")
    parents = written(parents, "ped-parents")
    front = written(ped.where("sire is null and dam is null").select("idx"), "ped-level")
    levels = [front.withColumn("generation", F.lit(0))]
    for g in range(1, limit):
        front = written(parents.join(front.toDF("parent").hint("merge"), "parent").select("idx").distinct(), "ped-level")
        if front.isEmpty():
            every = reduce(DataFrame.union, levels)
            return every.groupBy("idx").agg(F.max("generation").alias("generation"))
        levels.append(front.withColumn("generation", F.lit(g)))
    raise ValueError(f"a loop, or more than {limit} generations")


def ancestor_paths(ped: DataFrame, limit: int = 100, of: DataFrame | None = None) -> DataFrame:
    """(idx, ancestor, weight): sum over all paths of 0.5 to the number of steps; itself with weight 1.

    Of all animals, or of the rows (idx) of ``of`` only. Steps are merge joins: a broadcast in each of them would send the
    driver a table a generation.
    """
    parents = ped.select("idx", F.explode(F.array("sire", "dam")).alias("parent")).where("parent is not null")
    front = (ped if of is None else of).select("idx", F.col("idx").alias("ancestor"), F.lit(1.0).alias("weight"))
    out = front
    step = parents.select(F.col("idx").alias("ancestor"), "parent")
    for _ in range(limit):
        longer = front.join(step.hint("merge"), "ancestor").groupBy("idx", "parent").agg(F.sum(F.col("weight") * 0.5).alias("weight"))
        front = written(longer.select("idx", F.col("parent").alias("ancestor"), "weight"), "ped-paths")
        if front.isEmpty():
            return out.groupBy("idx", "ancestor").agg(F.sum("weight").alias("weight"))
        out = out.union(front)
    raise ValueError(f"paths of more than {limit} steps")


#: Animals whose pedigree may be held as arrays (some 40 bytes each) by the driver and by tasks; families for a Spark job.
ARRAY_CAP, FAMILIES = 50_000_000, 20_000


@dataclass
class Arrays:
    """A pedigree by animal: parents (-1 unknown), generation, Mendelian variance; kept as one file in the shared folder."""

    sire: np.ndarray
    dam: np.ndarray
    generation: np.ndarray
    d: np.ndarray

    @classmethod
    def of(cls, ped: DataFrame, d: DataFrame | None = None) -> Arrays:
        rows = ped.select("idx", "sire", "dam").join(generations(ped), "idx")
        if d is not None:
            rows = rows.join(d.select("idx", "d"), "idx")
        n = int(ped.agg(F.max("idx")).first()[0] or 0) + 1
        if n > ARRAY_CAP:
            raise ValueError(f"{n} animals are beyond the cap of {ARRAY_CAP}")
        got = rows.toArrow()
        at = got["idx"].to_numpy()
        out = cls(*(np.full(n, -1, np.int64) for _ in range(2)), np.zeros(n, np.int32), np.ones(n))
        for name in ("sire", "dam", "generation"):
            getattr(out, name)[at] = pc.fill_null(got[name], -1).to_numpy()
        if d is not None:
            out.d[at] = got["d"].to_numpy()
        return out

    def save(self, spark) -> str:
        path = f"{shared_root(spark)}/pedigree-{uuid.uuid4().hex}"
        fs, inner = open_fs(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(pickle.dumps((self.sire, self.dam, self.generation, self.d), protocol=5))
        return path

    def levels(self) -> list[np.ndarray]:
        """Animals of each generation."""
        order = np.argsort(self.generation, kind="stable")
        return np.split(order, np.cumsum(np.bincount(self.generation))[:-1])

    def columns(self, animals: np.ndarray) -> np.ndarray:
        """(animal, column): A's columns of some animals, by one sweep up the pedigree and one down."""
        x = np.zeros((len(self.sire), len(animals)))
        x[animals, np.arange(len(animals))] = 1.0
        levels = self.levels()
        for own in reversed(levels):
            for parent in (self.sire, self.dam):
                known = own[parent[own] >= 0]
                np.add.at(x, parent[known], 0.5 * x[known])
        x *= self.d[:, None]
        for own in levels:
            for parent in (self.sire, self.dam):
                known = own[parent[own] >= 0]
                x[known] += 0.5 * x[parent[known]]
        return x

    def children(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, child): an animal's children are those from its first on to the next animal's first."""
        parent = np.concatenate((self.sire, self.dam))
        known = np.flatnonzero(parent >= 0)
        order = known[np.argsort(parent[known], kind="stable")]
        return np.searchsorted(parent[order], np.arange(len(self.sire) + 1)), order % len(self.sire)

    def sparse_columns(self, animals: np.ndarray, children: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(animal, place of the column, value): the same columns' entries, by sweeps over relatives only."""
        k, (first, child) = len(animals), children
        top = int(self.generation.max(initial=0)) + 1
        waiting: list[list] = [[] for _ in range(top)]

        def send(keys: np.ndarray, values: np.ndarray) -> None:
            g = self.generation[keys // k]
            for level in np.unique(g):
                waiting[level].append((keys[g == level], values[g == level]))

        def arrived(level: int) -> tuple[np.ndarray, np.ndarray]:
            parts, waiting[level] = waiting[level], []
            if not parts:
                return np.empty(0, np.int64), np.empty(0)
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys))

        send(animals * k + np.arange(k), np.ones(k))
        up = []
        for level in reversed(range(top)):
            keys, values = arrived(level)
            up.append((keys, values * self.d[keys // k]))
            for parent in (self.sire, self.dam):
                p = parent[keys // k]
                send(p[p >= 0] * k + keys[p >= 0] % k, 0.5 * values[p >= 0])
        for keys, values in up:
            send(keys, values)
        out = []
        for level in range(top):
            keys, values = arrived(level)
            out.append((keys, values))
            n = first[keys // k + 1] - first[keys // k]
            at = np.repeat(first[keys // k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            send(child[at] * k + np.repeat(keys % k, n), 0.5 * np.repeat(values, n))
        keys, values = (np.concatenate(x) for x in zip(*out, strict=True))
        return keys // k, keys % k, values

    def excess(self, sire: int, dam: int) -> float:
        """Sum of L^2 d over the ancestors of a child of two animals: from the youngest on, each is met once."""
        share, heap, total = {sire: 0.5}, [(-int(self.generation[sire]), sire)], 0.0
        if dam in share:
            share[dam] = 1.0
        else:
            share[dam] = 0.5
            heapq.heappush(heap, (-int(self.generation[dam]), dam))
        while heap:
            _, a = heapq.heappop(heap)
            own = share.pop(a)
            total += own * own * self.d[a]
            for p in (int(self.sire[a]), int(self.dam[a])):
                if p < 0:
                    continue
                if p in share:
                    share[p] += 0.5 * own
                else:
                    share[p] = 0.5 * own
                    heapq.heappush(heap, (-int(self.generation[p]), p))
        return total


@lru_cache(maxsize=1)
def _loaded(path: str) -> Arrays:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as file:
        return Arrays(*pickle.loads(file.read()))


@lru_cache(maxsize=1)
def _children(path: str) -> tuple[np.ndarray, np.ndarray]:
    return _loaded(path).children()


def inbreeding(ped: DataFrame) -> DataFrame:
    """(idx, f, d): inbreeding coefficient and Mendelian variance.

    Generation by generation: an animal's d is known once its parents' F are, and its F is the sum of L^2 d over its
    ancestors, itself included, less 1. Full sibs are worked out once; many families are dealt to tasks that read the
    pedigree's arrays from the shared folder, so no table of all pairs of animals and ancestors is ever made.
    """
    spark, a = ped.sparkSession, Arrays.of(ped)
    f = np.zeros(len(a.sire))
    for own in a.levels()[1:]:
        sire, dam = a.sire[own], a.dam[own]
        for parent in (sire, dam):
            a.d[own] -= np.where(parent >= 0, 0.25 * (1 + f[parent]), 0.0)
        both = (sire >= 0) & (dam >= 0)
        families, member = np.unique(np.stack([sire[both], dam[both]], 1), axis=0, return_inverse=True)
        if len(families) <= FAMILIES:
            sums = np.array([a.excess(int(s), int(m)) for s, m in families])
        else:
            sums = _excess(spark, a, families)
        f[own[both]] = np.maximum(0, sums[member.ravel()] + a.d[own[both]] - 1 if len(families) else 0)
    rows = ped.select("idx").toPandas()["idx"].to_numpy(np.int64)
    return spark.createDataFrame(pd.DataFrame({"idx": rows, "f": f[rows], "d": a.d[rows]}), "idx long, f double, d double")


def _excess(spark, a: Arrays, families: np.ndarray) -> np.ndarray:
    path = a.save(spark)

    def run(batches):
        for batch in batches:
            known = _loaded(path)
            sums = [known.excess(s, m) for s, m in zip(batch.column("sire").to_pylist(), batch.column("dam").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(sums, pa.float64())], ["at", "sum"])

    rows = spark.createDataFrame(pd.DataFrame({"at": np.arange(len(families)), "sire": families[:, 0], "dam": families[:, 1]}))
    parts = max(1, len(families) // 5000)
    pdf = rows.repartition(parts).mapInArrow(run, "at long, sum double").toPandas()
    out = np.zeros(len(families))
    out[pdf["at"].to_numpy()] = pdf["sum"].to_numpy()
    return out


def a_inverse(ped: DataFrame, d: DataFrame) -> DataFrame:
    """Inverse relationship matrix (i, j, v) from (idx, d): each animal adds at most nine entries, then one sum."""
    rows = ped.join(d.select("idx", "d"), "idx").select(
        F.col("idx"), (1 / F.col("d")).alias("w"), F.filter(F.array(F.struct(F.col("idx").alias("k"), F.lit(1.0).alias("c")), F.struct(F.col("sire").alias("k"), F.lit(-0.5).alias("c")), F.struct(F.col("dam").alias("k"), F.lit(-0.5).alias("c"))), lambda x: x["k"].isNotNull()).alias("t")
    )
    cells = rows.select("w", F.explode("t").alias("a"), "t").select("w", "a", F.explode("t").alias("b"))
    out = cells.select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), (F.col("w") * F.col("a.c") * F.col("b.c")).alias("v"))
    return out.groupBy("i", "j").agg(F.sum("v").alias("v")).where(F.abs("v") > 1e-12)


def relationship(ped: DataFrame, d: DataFrame, of: DataFrame | None = None, cells: int = 4_000_000) -> DataFrame:
    """A's entries (i, j, v) other than 0; the block of the animals (idx) of ``of`` only, if given.

    Columns of A are worked out by sweeps over an animal's relatives in the pedigree's arrays, which tasks read from the
    shared folder; a task takes as many columns at a time as have some ``cells`` entries. Nothing is joined on ancestors.
    """
    a = Arrays.of(ped, d)
    n, path = len(a.sire), a.save(ped.sparkSession)
    animals = (ped if of is None else of).select("idx").distinct()
    wanted = None if of is None else np.sort(animals.toPandas()["idx"].to_numpy(np.int64))
    few = max(1, cells // n)

    def run(batches):
        step = few
        for batch in batches:
            known, children, at = _loaded(path), _children(path), 0
            every = batch.column("idx").to_numpy()
            while at < len(every):
                own = every[at : at + step]
                i, j, v = known.sparse_columns(own, children)
                at += len(own)
                # as many columns as the last ones' entries allow, if all were full at least ``few``
                step = max(few, min(4 * step, cells * len(own) // max(1, len(i))))
                keep = np.abs(v) > 1e-14
                if wanted is not None:
                    keep &= wanted[np.minimum(np.searchsorted(wanted, i), len(wanted) - 1)] == i
                yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(own[j[keep]]), pa.array(v[keep])], ["i", "j", "v"])

    parts = max(1, min(10_000, int(animals.count()) // 4096))
    return animals.select(F.col("idx").cast("long")).repartition(parts).mapInArrow(run, "i long, j long, v double")


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """The rows with numbers from 0 in that order, without gathering them in one task: they are range-partitioned and
    sorted, written with their places, and each partition's first number follows from the partitions' sizes."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{name}__at", F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    part = F.shiftright(f"{name}__at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    first, offsets = 0, []
    for r in sizes:  # one row a partition
        offsets.append((r["part"], first))
        first += r["n"]
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"{name}__part long, {name}__first long"))
    place = F.col(f"{name}__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(before, part == F.col(f"{name}__part")).withColumn(name, F.col(f"{name}__first") + place)
    return out.drop(f"{name}__at", f"{name}__part", f"{name}__first")


def first_appearance(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, level): levels numbered from 0 in order of first appearance."""
    firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("at"))
    return numbered(firsts, "at", key, name="level").select(key, "level")


def to_dams(records: DataFrame, ped: DataFrame, id: str = "id", name: str = "dam_id") -> DataFrame:
    """The records with their animal's dam; null where it is unknown, so that the record bears no maternal effect."""
    dams = ped.select(F.col("idx").alias(id), F.col("dam").alias(name))
    return records.join(dams, id, "left")

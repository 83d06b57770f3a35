"""What the operators share: tables in the cluster's shared folder, bounded text batches, distributed union-find."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The labelled rows whose crc32(doc_id) mod 3 is this one are held out of every fit.
HELD_OUT = 1
#: Characters that one step of a text operator holds as Python objects.
STEP_CHARS = 2_000_000
#: Links that one task joins at a time, in arrays of 8 bytes a node.
MOST_LINKS = 1_000_000


def held_out(doc_id) -> F.Column:
    """True on the rows that no model is fitted on; a null id hashes as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == HELD_OUT


class Scratch:
    """Tables that cut lineage. They lie in the folder that spark.checkpoint.dir names, which every executor sees.

    As a context manager it deletes its tables at the end, but for the one that keep() names, and all of them after a
    failure. A kept table is what a lazy result still reads; it stays until the folder is cleared. Where the setting
    is missing, a local master gets a temporary folder, since driver and executors are one process; others raise.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = _local_folder()
        self.folder = f"{folder.rstrip('/')}/memoryloom-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.kept: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        for path in [x for x in self.paths.values() if kind or x not in self.kept]:
            self._delete(path)

    def save(self, df: DataFrame, *drop: DataFrame | None, small: bool = False) -> DataFrame:
        """df written and reread; the tables in drop, which only df needed, are deleted.

        small: the rows are a small share of the input, so they are dealt to an eighth of the shuffle partitions, 8 at
        least, which write files. Only the rows are dealt; what makes them runs in as many tasks as before.
        """
        path = f"{self.folder}/{uuid.uuid4().hex}"
        if small:
            df = df.repartition(max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self  # keeps the ids in paths unique while the frame lives
        for x in drop:
            self.drop(x)
        return out

    def keep(self, df: DataFrame, small: bool = True) -> DataFrame:
        """df written as the table that outlives the others."""
        out = self.save(df, small=small)
        self.kept.add(self.paths[id(out)])
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and (path := self.paths.pop(id(df), None)):
            self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with its columns named c0, c1, ... by place, and those of doc_id and text: no other name clashes or needs quotes."""
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), f"c{names.index('doc_id')}", f"c{names.index('text')}"


_LOCAL: list[str] = []


def _local_folder() -> str:
    """A temporary folder for local masters, where driver and executors are one process."""
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="memoryloom-"))
    return _LOCAL[0]


def steps(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches and their texts (null: empty), each slice of about STEP_CHARS bytes or one row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = texts.nbytes
        rows = max(1, min(batch.num_rows, int(batch.num_rows * STEP_CHARS / max(sizes, 1))))
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, [x or "" for x in part.column(part.schema.get_field_index(column)).to_pylist()]


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links a, b and the least node of its component: hooks onto the least neighbour, then pointer jumps."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return nodes, nodes[parent]
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b: each node of a run of about MOST_LINKS links and its root there, in place of the links."""

    def out() -> pa.RecordBatch:
        node, root = _roots(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        return pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > MOST_LINKS:
            yield out()
            held = []
    if held:
        yield out()


def _names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links at once: node and root of every node."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, root = _roots(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(scratch: Scratch, links: DataFrame, forests: bool = False, alone: int = MOST_LINKS) -> DataFrame:
    """Connected components of links (a, b: long): one row (node, root) per node that has a link; none for no links.

    Distributed union-find: each partition first reduces its links to a forest (unless they are forests already);
    then, round by round, every node hooks onto the neighbour of least hash, links are renamed to the hooked nodes and
    the ones inside a node go. Hashes change with the round, so chains shrink by a constant factor. As soon as no more
    than alone links are left, whatever the input was, one task joins them. The least neighbour is an aggregate with
    map-side combining; the joins that rename a node with very many links, as the root of a large tree is, have a
    written table on either side, so Spark can split them. Only the number of links of a round reaches the driver.
    Links, hooks and names are written every round, so no plan grows with the rounds.
    """
    links = links.select("a", "b").where("a <> b")
    edges = scratch.save((links if forests else links.mapInArrow(forest, "a long, b long")).distinct(), small=True)
    names, turn = None, 0
    while n := edges.count():
        turn += 1
        if n <= alone:
            hooks = scratch.save(edges.coalesce(1).mapInArrow(_names, "node long, root long"))
        else:
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
            least = edges.select("a", "b").union(edges.select("b", "a")).groupBy("a").agg(F.min(rank("b")).alias("m"))
            hooks = scratch.save(least.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("root")), small=True)
        to = hooks.toDF("n2", "r2")
        old, names = names, hooks
        if old is not None:
            names = scratch.save(old.join(to, old.root == to.n2, "left").select("node", F.coalesce("r2", "root").alias("root")), old, small=True)
        if n <= alone:
            return names
        renamed = edges.join(hooks, edges.a == hooks.node).select(F.col("root").alias("a"), "b")
        renamed = renamed.join(to, renamed.b == to.n2).select("a", F.col("r2").alias("b")).where("a <> b")
        edges = scratch.save(renamed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), edges, small=True)
    return names if names is not None else edges.toDF("node", "root")

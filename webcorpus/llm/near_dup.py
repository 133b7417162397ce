"""Near-duplicate documents by MinHash: universal hash minima, banding, signature check, exact check, components.

Copies with the same shingle set are one node from the start. A bucket of a band
never pairs all its nodes. First each node is checked against the smallest node
of the bucket that it shares most bands with, and components are formed. Then
only buckets that still hold several components are searched, together if they
have the same largest component: tasks compare signatures in blocks of bounded size and give back which nodes have an agreeing
partner in which other component. These nodes meet on full sets, again in blocks
inside tasks, which give back one confirmed link for a node and a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import pick, stage, tuned
from webcorpus.llm.components import connected_components
from webcorpus.llm.wordhash import mix, shingle_sets, slices

#: Minima of a signature, rows of a band. At similarity 0.8 a pair shares no band once in 8 * 10^6.
HASHES = 200
BAND_ROWS = 5
#: Standard errors by which the signatures may fall short of the threshold.
SLACK = 5.0
#: Nodes of one side of a block of comparisons.
BLOCK = 256
#: Node ids that are broadcast to a scan of the documents; more are joined by a shuffle.
BROADCAST_NODES = 500_000
_SEED = 20240229


@cache
def _universal() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of the multiply-add-shift hashes, a strongly universal family."""
    draw = np.random.Generator(np.random.PCG64(_SEED)).integers(0, 1 << 64, (2, HASHES, 1), np.uint64)
    return draw[0], draw[1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """32-bit minima of all hashes over a set."""
    a, b = _universal()
    x = shingles >> np.uint64(32)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(least, (a * x[i : i + 512] + b).min(axis=1), out=least)
    return least >> np.uint64(32)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of a signature."""
    h = np.arange(HASHES // BAND_ROWS, dtype=np.uint64) + np.uint64(1)
    for column in minima.reshape(-1, BAND_ROWS).T:
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + column)
    return h.view(np.int64)


def least_agreement(threshold: float) -> int:
    """Equal minima that a pair at the threshold has, but for ``SLACK`` standard errors."""
    return int(HASHES * threshold - SLACK * (HASHES * threshold * (1 - threshold)) ** 0.5)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, n_shingles, f1, f2, sig, buckets).

    Set size, 128-bit fingerprint of the set, the low bytes of the minima and the
    buckets of the bands; the last two are null for an empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for s in shingle_sets(batch.column(1), shingle):
                    f1 = int(s.sum(dtype=np.uint64).view(np.int64))
                    f2 = int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))
                    minima = signature(s) if len(s) else None
                    rows.append((len(s), f1, f2, *((minima.astype(np.uint8).tobytes(), band_keys(minima)) if len(s) else (None, None))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]],
                    ["doc_id", "n_shingles", "f1", "f2", "sig", "buckets"],
                )

    tuned(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary, buckets array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, shingles) of the documents whose doc_id is in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [s.tobytes() for s in shingle_sets(batch.column(1), shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    ids = nodes.select(F.col("node").alias("doc_id")).distinct()
    few = ids.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    wanted = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return wanted.select("doc_id", "text").mapInArrow(run, "node long, shingles binary")


def _agreeing(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough."""
    least = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    sigs = nodes.select("node", "sig")
    return (
        pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
        .select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")
    )


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents with 100 * |A and B| >= percent * |A or B| on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stage(pairs)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = stage(_sets(docs, nodes, shingle))
    return (
        pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        .select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")
    )


def _leader_links(shared: DataFrame) -> DataFrame:
    """For each node the leader that it shares most buckets with, the smallest of those."""
    counted = shared.where("node != leader").groupBy("node", "leader").count()
    best = F.max_by("leader", F.struct("count", -F.col("leader")))
    return counted.groupBy("node").agg(best.alias("b")).select(F.col("node").alias("a"), "b")


def _blocks(rows: DataFrame) -> DataFrame:
    """Both sides of every group in blocks (i, j); ``few`` and ``all`` hold the sizes of the sides.

    Rows with ``few_side`` are spread over the i and copied to every j, the others
    the other way round, so that each pair of rows meets in one block.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    spread = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    rest = [c for c in rows.columns if c not in ("few", "all")]
    wide = rows.where("NOT few_side").select(*rest, each("few").alias("i"), spread("all").alias("j"))
    few = rows.where("few_side").select(*rest, spread("few").alias("i"), each("all").alias("j"))
    return wide.union(few)


def _in_blocks(rows: DataFrame, keys: list[str], compare: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``compare`` to every group of (keys, i, j); a task holds one group and one batch at a time."""
    by = [*keys, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in by], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                mark = marks[start].tolist()
                if held and mark != last:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
                last = mark
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _hopeful(shared: DataFrame, nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Rows (hub, node, few_side): nodes with an agreeing partner in another component that they share a bucket with.

    Buckets of which the same component is the largest are searched together, so
    that nodes which share many bands are compared once. Of two agreeing
    components the one with the smaller id is the hub; its nodes are the wide
    side, those of the other the few side.
    """
    labelled = shared.select("bucket", "node").join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("major")
    ).where("parts > 1")
    met = stage(labelled.join(mixed.drop("parts"), "bucket").select("major", "node", "component").distinct())
    sizes = met.groupBy("major").agg(F.count_if(F.col("component") != F.col("major")).alias("few"), F.count(F.lit(1)).alias("all"))
    rows = met.join(sizes, "major").join(nodes.select("node", "sig"), "node")
    outside = rows.where("component != major").withColumn("few_side", F.lit(True))
    rows = rows.withColumn("few_side", F.lit(False)).union(outside)
    least = least_agreement(threshold)

    def compare(block: pa.Table) -> pa.RecordBatch:
        node, part = (block.column(c).to_numpy() for c in ("node", "component"))
        side = block.column("few_side").to_numpy()
        sigs = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        wide = np.flatnonzero(~side)
        found = set()
        for i in np.flatnonzero(side):
            others = wide[part[wide] != part[i]]
            for y in others[(sigs[others] == sigs[i]).sum(axis=1) >= least].tolist():
                low, high = (i, y) if part[i] < part[y] else (y, i)
                found.add((part[low], node[low], False))
                found.add((part[low], node[high], True))
        hub, who, few = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(hub, pa.int64()), pa.array(who, pa.int64()), pa.array(few, pa.bool_())], ["hub", "node", "few_side"]
        )

    return _in_blocks(_blocks(rows), ["major"], compare, "hub long, node long, few_side boolean").distinct()


def _meeting(docs: DataFrame, hopeful: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) on full sets between the sides of every hub: one for each node of the few side that has any."""
    hopeful = stage(hopeful)
    sizes = hopeful.groupBy("hub").agg(
        F.count_if("few_side").alias("few"), F.count_if(~F.col("few_side")).alias("all")
    )
    sets = stage(_sets(docs, hopeful, shingle))
    rows = _blocks(hopeful.join(sizes, "hub")).join(sets, "node")

    def compare(block: pa.Table) -> pa.RecordBatch:
        node, side = block.column("node").to_numpy(), block.column("few_side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
        few, wide = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = [], []
        if len(few) and len(wide):
            order = np.concatenate([wide, few])
            known, at = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
            size = np.array([len(sets[i]) for i in order])
            starts = np.concatenate([[0], np.cumsum(size)])
            wide_at, wide_starts, wide_size = at[: starts[len(wide)]], starts[: len(wide)], size[: len(wide)]
            for k, i in enumerate(few, len(wide)):
                mark = np.zeros(len(known), bool)
                mark[at[starts[k] : starts[k + 1]]] = True
                common = np.add.reduceat(mark[wide_at], wide_starts, dtype=np.int64)
                hits = np.flatnonzero(100 * common >= percent * (wide_size + size[k] - common))
                if len(hits):
                    a.append(node[i])
                    b.append(node[wide[hits[0]]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _in_blocks(rows, ["hub"], compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by shingle sets of similarity ``percent`` / 100 or more.

    Returns per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id
    reachable over links), kept (doc_id = component_id). Words are runs without
    ASCII white space, A-Z as a-z; a text of fewer than ``shingle`` words is one
    shingle. Null, empty and blank texts have no shingle and are linked with
    nothing. Rows of one doc_id count as one document. A null doc_id is linked
    with nothing: component_id null, kept true. No rows give no rows; other
    columns are ignored.
    """
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    all_docs = stage(sketches(docs, shingle))
    sets = ["n_shingles", "f1", "f2"]
    nodes = stage(
        all_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*sets).agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("buckets").alias("buckets"))
    )
    bands = nodes.select("node", F.explode("buckets").alias("bucket"))
    leaders = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(bands.join(leaders.drop("n"), "bucket"))
    links = stage(confirmed(docs, _agreeing(_leader_links(shared), nodes, percent / 100), shingle, percent))
    labels = connected_components(links)
    more = _meeting(docs, _hopeful(shared, nodes, labels, percent / 100), shingle, percent)
    labels = connected_components(links.union(more))
    found = nodes.select(*sets, "node").join(labels, "node", "left").select(*sets, F.coalesce("component", "node").alias("component"))
    joined = all_docs.drop("sig", "buckets").join(found, sets, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", own.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"),
    )

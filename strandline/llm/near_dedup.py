"""Near-duplicate groups: one-permutation MinHash with optimal densification, bands, star edges, exact links.

1. One pass over the texts gives each row its set of word shingles (64-bit hashes), a digest of that
   set, its band keys and a row number. The signature is a one-permutation hash: every shingle falls in
   one of K bins and a bin keeps its smallest value. An empty bin copies a filled one, chosen by hashing
   (bin, attempt) until it meets one: each bin on its own, so that bins stay nearly independent even
   for very short texts.
2. Rows of equal sets form a class, whatever its size; only its first row goes on. Rows, not ids, are
   what is linked, so texts that share an id are judged each.
3. Equal band keys form buckets. A bucket of m members yields m - 1 candidate edges, from one centre
   to the others (a star), never all pairs. Edges are confirmed on the full sets.
4. A star alone can miss a link between two of its points. So in buckets whose other members are in
   more than one component the centre, which is settled, makes way for the next one, for some rounds of
   stars. What is still open then is mostly many texts just below the threshold. Members that provably
   can't link to another component go (``_reachable``). The others are gathered in clusters of buckets
   that share members, and a cluster's members are compared with each other in blocks: every pair of
   blocks is one bounded group, in which a matrix product counts what the sets share, and only links
   between different components leave it. After that every pair that shares a bucket is in one component
   or refuted on full sets, so no link is lost to the stars, and no pairs are emitted.
5. Components: tasks contract their own edges to stars; up to a million edges that are left are finished
   by one task, more by rounds of large-star and small-star on tables. Nothing is collected.

One key may hold a third of all rows. Buckets are read from ranges of (key, row), which cut hot keys
(``_starred``); joins on centres, hubs, shingles and clusters go by the known size of the key: heavy ones
are broadcast or dealt out in parts (``join_sized``, ``_confirmed``).
A pair at the threshold shares no bucket with a probability of about 1e-8 (``bands_for``).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import textkernel as tk
from strandline.llm.common import HEAVY, join_sized, keep_only, only, trimmed
from strandline.session import forget, materialize

MISS = 1e-8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(threshold: float, miss: float = MISS, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): as many bands of so many bins that a pair at the threshold is missed with miss at most."""
    return ceil(log(miss) / log(1 - threshold**rows)), rows


def signatures(row: np.ndarray, value: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins one-permutation signatures, densified. Rows without a shingle hold _EMPTY only."""
    sig = np.full(n * bins, _EMPTY)
    bin_of = ((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(sig, row * bins + bin_of.astype(np.int64), tk.mix(value))
    sig = sig.reshape(n, bins)
    full = sig != _EMPTY
    r, c = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(r):
        donor = (tk.mix(c.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        has = full[r, donor]
        sig[r[has], c[has]] = sig[r[has], donor[has]]
        r, c = r[~has], c[~has]
        attempt += 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(sig), 0)
    for j in range(rows):
        key = tk.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j : bands * rows : rows])
    return key.view(np.int64)


def _sets(texts: tk.Texts, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    row, value = tk.shingles(texts, k)
    ends = np.searchsorted(row, np.arange(texts.n), "right")
    return ends, [np.unique(v) for v in np.split(value, ends[:-1])]


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in tk.slices(batch):
                _, sets = _sets(texts, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = band_keys(signatures(np.repeat(np.arange(texts.n), sizes), np.concatenate(sets), texts.n, bands * rows), bands, rows)
                digests = [_digest(s) for s in sets]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, texts.n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sizes), pa.array(digests, pa.string()), flat, own.column(2)], names=["doc_id", "n_shingles", "set_digest", "bands", "text_hash"])

    return run


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in tk.slices(batch):
                _, sets = _sets(texts, k)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.string()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_digest", "shingles"])

    return run


def _digest(shingles: np.ndarray) -> str | None:
    return blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None


def _confirm(percent: int):
    """Rows (a, part, side, b, shingles), the centre's own (side 0) before its members' -> the edges (a, b) that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            ends: tuple[list[int], list[int]] = [], []
            for a, side, b, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                values = np.frombuffer(own.as_buffer(), np.uint64)
                if not side:
                    centre = values.copy()
                    continue
                at = np.searchsorted(centre, values)
                shared = int((centre[np.minimum(at, len(centre) - 1)] == values).sum())
                if 100 * shared >= percent * (len(centre) + len(values) - shared):
                    ends[0].append(a)
                    ends[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    return run


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v) that aren't the smallest of their component, and its smallest: hooks and jumps over arrays."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        lo, hi = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        a, b = lo[lo != hi], hi[lo != hi]  # roots alone: every path was jumped to its end
        if not len(a):
            return nodes[parent != np.arange(len(nodes))], nodes[parent[parent != np.arange(len(nodes))]]
        np.minimum.at(parent, b, a)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def _forest(most: int, names: tuple[str, str] = ("u", "v")):
    """Edges (u, v) -> stars (node, smallest it reaches) over at least most edges of a task at a time, or all it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*np.concatenate(held, 1))], names=list(names))

        for batch in batches:
            held.append(np.stack([np.asarray(c, np.int64) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= most:
                yield stars()
                held = []
        if held:
            yield stars()

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, most: int = 1 << 20, chunk: int = 1 << 20) -> DataFrame:
    """node, component (its smallest reachable node) of every node that reaches a smaller one.

    Each task first replaces its edges, chunk at a time, by the stars of their components. Up to most
    edges that are left then are finished by one task (some 16 bytes each). More go through rounds of
    large-star and small-star on tables, each of which halves the paths at least, until they are stars or
    few: a round is many jobs and broadcasts, whose plans and relations the driver holds for a while.
    Beyond max_rounds, which only a path of 2 ** max_rounds nodes could need, it raises. Hubs are split.
    """

    def contracted(u: DataFrame) -> DataFrame:
        return materialize(u.where("u <> v").mapInArrow(trimmed(_forest(chunk)), "u long, v long").distinct(), "edges")

    now = contracted(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    rounds = 0
    while True:
        if now.count() <= most:
            return now.coalesce(1).mapInArrow(trimmed(_forest(most + 1, ("node", "component"))), "node long, component long")
        unfinished, edges_now = _shape(now)
        if not unfinished:
            break
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"components are open after {max_rounds} rounds")
        both = now.union(now.select("v", "u"))
        total = 2 * edges_now
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size"))
        large = join_sized(both, low, "u", "size", total, "v", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))
        small = join_sized(large, down, "u", "size", total, "v", "inner")
        before, now = now, contracted(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))))
        forget(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """If edges (u, v) aren't stars yet (each u has one v, and no v has an edge of its own), and how many there are."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    row = nodes.agg(F.max((F.expr("out > 1 or out > 0 and in > 0")).cast("int")).alias("open"), F.sum("out").alias("edges")).first()
    return bool(row["open"]), row["edges"] or 0


def _confirmed(edges: DataFrame, shingles: DataFrame, percent: int, part: int = 250) -> DataFrame:
    """The edges (a, b) that hold on full sets, of distinct edges from centres a.

    A centre's edges are dealt out in parts of about part edges (of a 1 / HEAVY share, if that is more),
    and its set goes once to each part, before the members' sets.
    """
    edges = materialize(edges, "candidates")
    limit = max(part, edges.count() // HEAVY)
    degrees = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / limit).cast("long").alias("parts"))
    split = F.broadcast(degrees.where("parts > 1").select("a", "parts"))  # at most HEAVY centres
    dealt = edges.join(split, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    members = dealt.join(shingles, F.col("b") == F.col("row")).select("a", "part", F.lit(1).alias("side"), "b", "shingles")
    centres = degrees.join(shingles, F.col("a") == F.col("row")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = members.union(centres).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return rows.mapInArrow(trimmed(_confirm(percent)), "a long, b long")


_MEMBER = "key long, row long, n_shingles long, label long"
_STARRED = f"{_MEMBER}, centre long, n_centre long, centre_label long, border boolean"


def _starred(members: DataFrame, turn: int = 0) -> DataFrame:
    """members (key, row, n_shingles, label) of buckets with two labels or more, each with its star's centre.

    Members are dealt out by ranges of (key, row), so a hot key is spread over as many tasks as its share
    of the rows asks for, and a task reads a key's members one after the other. A key that may go on in
    the next task (border) has a star in each: of its members all are kept, or, if they have one label,
    the centre alone. Where a key isn't cut, its first member is the centre; where it is, turn chooses.
    """
    dealt = members.select("key", "row", "n_shingles", "label").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    return dealt.mapInArrow(trimmed(_runs(turn)), _STARRED)


def _runs(turn: int, most: int = 1 << 20):
    names = [c.split()[0] for c in _STARRED.split(", ")]

    def stars(rows: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        """rows (4 x n) of whole runs of keys; the first and the last may go on outside."""
        key, row, size, label = rows
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(start, len(key)))
        border = np.zeros(len(start), bool)
        border[0], border[-1] = first, border[-1] | last if len(start) > 1 else first | last
        many = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
        centre = start + np.where(border, np.minimum(turn, count - 1), 0)
        own = np.repeat(centre, count)
        keep = np.repeat(many, count) | np.repeat(border, count) & (own == np.arange(len(key)))
        columns = [*rows, row[own], size[own], label[own], np.repeat(border, count)]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, first = np.zeros((4, 0), np.int64), True
        for batch in batches:
            rows = np.concatenate([rest, np.stack([np.asarray(c, np.int64) for c in batch.columns])], 1)
            if not rows.shape[1]:
                continue
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on
            whole = cut == 0 and rows.shape[1] >= most
            done, rest = (rows, rows[:, :0]) if whole else (rows[:, :cut], rows[:, cut:])
            if done.shape[1]:
                yield stars(done, first, whole)
                first = whole
        if rest.shape[1]:
            yield stars(rest, first, True)

    return run


def _tops(starred: DataFrame) -> DataFrame:
    """The centres of cut keys, with the first of them as their own centre; a task has two of them at most."""
    tops = starred.where("border and row = centre").select("key", "row", "n_shingles", "label")
    first = tops.groupBy("key").agg(F.min("row").alias("centre"), F.min_by("n_shingles", "row").alias("n_centre"), F.min_by("label", "row").alias("centre_label"))
    return tops.join(first, "key")


def _edges(starred: DataFrame, percent: int) -> DataFrame:
    """The candidate edges a, b of the stars, and of the centres of cut keys among each other."""
    both = starred.select("row", "n_shingles", "label", "centre", "n_centre", "centre_label").union(_tops(starred).select("row", "n_shingles", "label", "centre", "n_centre", "centre_label"))
    return both.where("label <> centre_label").where(_sizes("n_shingles", "n_centre", percent)).select(F.col("centre").alias("a"), F.col("row").alias("b")).distinct()


def _open(starred: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """The stars of what is still open: a centre is settled with all others of its bucket, unless that was cut."""
    rest = starred.where("border or row <> centre").select("key", "row", "n_shingles")
    named = rest.join(labels, F.col("row") == F.col("node"), "left").select("key", "row", "n_shingles", F.coalesce("component", "row").alias("label"))
    return materialize(_starred(named, turn), "open")


def _reachable(still: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """still without the members that can have no link to another component, whoever the partner is.

    A link to a partner in another component can only share shingles that some other component has
    too. Counting those bounds what a member can share; the partner has at least the size that the
    threshold asks for. In a group of copies that differ from one
    original by words of their own, this settles every member that is too far from the original.
    """
    own = shingles.join(still.select("row", "label").distinct(), "row")
    each = materialize(own.select("row", "label", "shingles").mapInArrow(trimmed(_exploded), "row long, label long, shingle long"), "open_shingles")
    shared = each.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("shingle", "rows")
    reach = join_sized(each, shared, "shingle", "rows", each.count(), "row", "inner").groupBy("row").agg(F.count(F.lit(1)).alias("reach"))
    able = still.join(reach, "row").where(F.col("reach") * (100 + percent) >= percent * (F.col("n_shingles") + F.expr(f"(n_shingles * {percent} + 99) div 100")))
    return materialize(_starred(able), "able")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """What each set of left shares with each of right, as a matrix product over width shingles at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    row_a, row_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    all_a, all_b = np.concatenate(left), np.concatenate(right)
    at_a, at_b = np.searchsorted(both, all_a), np.searchsorted(both, all_b)
    in_a, in_b = (np.flatnonzero((at < len(both)) & (both[np.minimum(at, len(both) - 1)] == x)) if len(both) else np.zeros(0, int) for at, x in ((at_a, all_a), (at_b, all_b)))
    for start in range(0, len(both), width):
        size = min(width, len(both) - start)
        m = []
        for n, row, at, inside in ((len(left), row_a, at_a, in_a), (len(right), row_b, at_b, in_b)):
            own = inside[(at[inside] >= start) & (at[inside] < start + size)]
            x = np.zeros((n, size), np.float32)
            x[row[own], at[own] - start] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _block_links(percent: int):
    """Links between different components of a pair of blocks; a link that adds nothing to those found stays out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        rows, labels, side = pdf["row"].to_numpy(), pdf["label"].to_numpy(), pdf["side"].to_numpy()
        if len(np.unique(labels)) > 1:
            sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
            sizes = np.array([len(s) for s in sets])
            one = np.flatnonzero(side <= 1)  # side 0: both blocks are the same one
            two = np.flatnonzero(side != 1)
            if len(one) and len(two):
                shared = shared_counts([sets[i] for i in one], [sets[i] for i in two]).astype(np.int64)
                linked = (100 * shared >= percent * (sizes[one][:, None] + sizes[two][None, :] - shared)) & (labels[one][:, None] != labels[two][None, :])
                parent = {x: x for x in labels.tolist()}

                def find(x: int) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for i, j in zip(*np.nonzero(linked), strict=True):
                    x, y = find(int(labels[one[i]])), find(int(labels[two[j]]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        found.append((int(rows[one[i]]), int(rows[two[j]])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _compared(still: DataFrame, shingles: DataFrame, percent: int, block_docs: int = 500, block_shingles: int = 300_000) -> DataFrame:
    """Links between components among the members of open buckets, by pairs of blocks of each cluster.

    A block holds about block_docs rows and block_shingles shingles, so a group has a bounded size;
    a cluster of n blocks sends each member to n groups.
    """
    pairs = still.select("row", "centre").union(_tops(still).select("row", "centre"))
    cluster = components(pairs.where("row <> centre").select(F.col("row").alias("a"), F.col("centre").alias("b")))
    members = still.select("row", "n_shingles", "label").distinct()
    placed = materialize(members.join(cluster, F.col("row") == F.col("node"), "left").select("row", "n_shingles", "label", F.coalesce("component", "row").alias("cluster")), "placed")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n_shingles") / block_shingles)).cast("long")
    counts = placed.groupBy("cluster").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("members"))
    dealt = join_sized(placed, counts, "cluster", "members", placed.count(), "row").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = dealt.select("row", "label", "cluster", "block", other.alias("other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    groups = paired.select("row", "label", "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), side.alias("side"))
    with_sets = groups.join(shingles, "row").select("cluster", "lo", "hi", "row", "label", "side", "shingles")
    return with_sets.groupBy("cluster", "lo", "hi").applyInPandas(_block_links(percent), "a long, b long")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            own = batch.slice(at, 512)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in own.column(2)]
            sizes = [len(s) for s in sets]
            rows, labels = (np.repeat(np.asarray(own.column(j)), sizes) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(labels), pa.array(np.concatenate(sets))], names=["row", "label", "shingle"])


def _links(starred: DataFrame, shingles: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    """node, component of every row with a link, from the first stars and the rows' sets."""
    links = materialize(_confirmed(_edges(starred, percent), shingles, percent), "links")
    labels = materialize(components(links), "labels")
    for turn in range(1, star_rounds + 1):
        starred = _open(starred, labels, turn)
        if turn == star_rounds or starred.isEmpty():
            break
        more = materialize(_confirmed(_edges(starred, percent), shingles, percent), "more")
        if not more.isEmpty():
            links = links.union(more)
            labels = materialize(components(links), "labels")
    if not starred.isEmpty():
        starred = _reachable(starred, shingles, percent)
    if not starred.isEmpty():
        labels = materialize(components(links.union(materialize(_compared(starred, shingles, percent), "more"))), "labels")
    return labels


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, star_rounds: int) -> DataFrame:
    """doc_id, n_shingles, text_hash, component_id, kept of each row of docs."""
    bands, rows = bands_for(percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_hash(F.col(text_col)).alias("text_hash"))
    signed = texts.mapInArrow(trimmed(_signed(k, bands, rows)), "doc_id long, n_shingles long, set_digest string, bands array<long>, text_hash long")
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    facts = signed.select("row", "doc_id", "n_shingles", "set_digest", "text_hash")
    total = facts.count()
    sets = facts.where("set_digest is not null").groupBy("set_digest").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size"))
    named = join_sized(facts, materialize(sets.where("size > 1"), "sets"), "set_digest", "size", total, "row")
    alone = F.col("size").isNull()
    named = named.select("row", "doc_id", "n_shingles", "set_digest", "text_hash", F.coalesce("rep", "row").alias("node"), F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("least_id"), F.coalesce("size", F.lit(1)).alias("size"))
    named = materialize(named, "named")

    reps = keep_only(signed.where("set_digest is not null"), {"row": F.col("row")}, named.where("row <> node").select("row"))
    exploded = reps.select("row", "n_shingles", F.explode("bands").alias("key"))
    starred = materialize(_starred(exploded.withColumn("label", F.col("row"))), "buckets")

    involved = materialize(named.join(starred.select(F.col("row").alias("__row")).distinct(), F.col("row") == F.col("__row"), "left_semi").select("row", "doc_id", "set_digest"), "involved")
    no_id = F.lit(-(1 << 63)).cast("long")
    own_text = only(texts, {"id": F.coalesce("doc_id", no_id)}, involved.select(F.coalesce("doc_id", no_id).alias("id")).distinct())
    sets_of = own_text.select(F.lit(0), "text").mapInArrow(trimmed(_shingled(k)), "set_digest string, shingles binary")
    shingles = materialize(sets_of.join(involved.select("row", F.col("set_digest").alias("__digest")), F.col("set_digest") == F.col("__digest")).dropDuplicates(["set_digest"]).select("row", "shingles"), "shingles")
    labels = _links(starred, shingles, percent, star_rounds)

    facts_of = named.where("row = node").select(F.col("row").alias("__row"), "least_id", "size")
    labels = labels.union(labels.select("component", "component").distinct())  # the smallest node has no row of its own
    by_node = materialize(labels.join(facts_of, F.col("node") == F.col("__row")).select("node", "component", "least_id", "size"), "nodes")
    least = by_node.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    found = join_sized(by_node.select("node", "component", "size"), least, "component", "nodes", by_node.count(), "node").select("node", "component_id", "size")
    out = join_sized(named.drop("size"), found, "node", "size", total, "row")
    component = F.when(F.col("size").isNull(), F.col("least_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "text_hash", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct windows of k words (A-Z lower-cased); a text of fewer words has its
    whole sequence as the one element. Texts without words, and nulls, have no element, link with
    nothing and are their own component. Two texts are linked if 100 * shared >= percent * united;
    component_id is the smallest doc_id reachable. Rows that repeat an id and its text are one document
    and share its verdict; another text under the same id is another document. Null ids take part, and
    are kept only in groups without an id, whose component_id is null. Other columns are not read.
    """
    return _grouped(docs, k, percent, id_col, text_col, star_rounds).drop("text_hash")


def _sizes(a: str, b: str, percent: int):
    """Sets of such sizes can reach the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_groups doesn't keep; all their columns.

    A verdict is that of an id and its text, told by a 64-bit hash, so another text under the id has its
    own. Rows with a null id stay.
    """
    gone = _grouped(docs, k, percent, id_col, text_col, 2).where("not kept and doc_id is not null").select("doc_id", "text_hash")
    return keep_only(docs, {"doc_id": docs[id_col].cast("long"), "text_hash": _text_hash(docs[text_col])}, materialize(gone.distinct(), "near"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))

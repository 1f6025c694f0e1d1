"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles. The sketch throws the set's elements into
``COORDS`` bins, round after round with fresh hashes, until every bin is filled: a bin keeps the
least value of its first round. The last ``COORDS`` rounds each aim at one bin, so that every
coordinate fills whatever the set's size; agreement of two sketches concentrates around the
Jaccard similarity. Bands of ``ROWS`` coordinates give bucket keys: 32 bands of 5 miss a pair at
similarity 0.85 with a probability below 1e-8, one at 0.8 with about 3e-6.

Documents with the same set are one node (their least doc_id). Within a bucket, members are
held against the bucket's most central member; then, as links are transitive, only members of
buckets that still span several components matter. Of these, a node can link to another component
only if ``percent`` of its shingles occur in other components too; nodes that fail this are peeled off,
round after round, which is exact and needs no pairs. What is left meets by a prefix join: a link
needs so many common shingles that two linked sets share one of their rarest few. A pair is made only where
bit signatures of the two sets, which bound what they differ in, allow the similarity. Every
comparison counts full sets. So no link between candidates is lost for the components, while
groups of copies cost one comparison a member. Components come from rounds of
large-star and small-star over the verified links, in tables in the shared folder.

Defined results: null and blank texts have empty sets (n_shingles 0, their own component, kept);
texts under five words have one shingle, the whole sequence; very long texts are taken whole; a null doc_id takes no part in links
(component_id null, kept); rows that repeat a doc_id belong to one document; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import CHUNK_BYTES, buffer_of, chunks, materialise, mix64, table

WORDS = 5
#: Similarity of a link, in percent, where the caller gives none.
PERCENT = 85
BANDS, ROWS = 32, 5
COORDS = BANDS * ROWS
#: Words of 64 bits in a set's signature.
SIGNATURE = 64

SEEDS = mix64(np.arange(1, 2 * COORDS + 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: One random odd-based value a byte; A-Z count as a-z.
BYTES = mix64(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
BYTES[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
FULL = np.uint64(2**64 - 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to ``n``; only a chunk's worth is kept."""
    return _powers(n) if n > CHUNK_BYTES else tuple(x[: n + 1] for x in _chunk_powers())


@lru_cache(maxsize=1)
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the texts in one byte buffer."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[ends[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * down[:n], out=sums[1:])
    h = mix64((sums[last] - sums[first]) * up[first] + (last - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return h, np.searchsorted(ends, first, side="right") - 1


def shingles_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row in turn, offsets of the rows)."""
    rows = len(ends) - 1
    w, row = words_of(data, ends)
    n_words = np.bincount(row, minlength=rows)
    firsts = np.concatenate([[0], np.cumsum(n_words)])
    m = len(w)
    if m >= WORDS:
        acc = w[: m - WORDS + 1] * SEEDS[-1]
        for k in range(1, WORDS):
            acc = mix64(acc) + w[k : m - WORDS + 1 + k] * SEEDS[-1 - k]
        full = row[: m - WORDS + 1] == row[WORDS - 1 :]
        acc, acc_row = mix64(acc[full]), row[: m - WORDS + 1][full]
    else:
        acc, acc_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if short.size:
        few = []
        for r in short.tolist():
            h = 0
            for x in w[firsts[r] : firsts[r + 1]].tolist():
                h = (h * BASE + x) % 2**64
            few.append((h + int(n_words[r])) % 2**64)
        acc = np.concatenate([acc, mix64(np.array(few, np.uint64))])
        acc_row = np.concatenate([acc_row, short])
        order = np.argsort(acc_row, kind="stable")
        acc, acc_row = acc[order], acc_row[order]
    cuts = np.searchsorted(acc_row, np.arange(rows + 1))
    acc = np.ascontiguousarray(acc)
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if z - a > 1:
            acc[a:z].sort()
    keep = np.ones(len(acc), bool)
    if len(acc):
        keep[1:] = (acc[1:] != acc[:-1]) | (acc_row[1:] != acc_row[:-1])
    acc_row = acc_row[keep]
    return acc[keep], np.searchsorted(acc_row, np.arange(rows + 1))


def sketches(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """rows x COORDS; rows with an empty set keep FULL everywhere."""
    rows, t = len(cuts) - 1, np.uint64(COORDS)
    out = np.full((rows, COORDS), FULL)
    sizes = np.diff(cuts)
    row = np.repeat(np.arange(rows), sizes)
    elem = sets
    half = np.uint64(32)
    for i in range(COORDS):
        if not elem.size:
            return out
        h = mix64(elem ^ SEEDS[i])
        place = row * COORDS + ((h >> half) * t >> half).astype(np.int64)
        if i == 0:
            np.minimum.at(out.reshape(-1), place, h)
        else:
            free = out.reshape(-1)[place] == FULL
            at, val = place[free], h[free]
            slot, back = np.unique(at, return_inverse=True)
            best = np.full(len(slot), FULL)
            np.minimum.at(best, back, val)
            out.reshape(-1)[slot] = best
        open_ = (out == FULL).any(axis=1)
        on = open_[row]
        elem, row = elem[on], row[on]
    for j in range(COORDS):
        left = np.flatnonzero((out[:, j] == FULL) & (sizes > 0))
        for r in left.tolist():
            out[r, j] = mix64(sets[cuts[r] : cuts[r + 1]] ^ SEEDS[COORDS + j]).min()
    return out


def bands_of(sketch: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sketch), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix64(out + sketch[:, r::ROWS] * SEEDS[2 * COORDS + r])
    return mix64(out + SEEDS[2 * COORDS + 20 : 2 * COORDS + 20 + BANDS]).view(np.int64)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets, cuts = shingles_of(*buffer_of(batch.column(1)))
        n = np.diff(cuts)
        sums = []
        for s in (SEEDS[-11], SEEDS[-12]):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(sets ^ s))])
            sums.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
        bands = bands_of(sketches(sets, cuts))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n_shingles", "h1", "h2", "bands"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets, cuts = shingles_of(*buffer_of(batch.column(1)))
        data = [sets[a:z].tobytes() for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["node", "elements"])


def linked(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b, a's set, b's set -> the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                if both and 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            cut = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield cut

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (a, b)."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        edges = materialise(small.where("a <> b").distinct(), "edges")
        now = state(edges)
        if now == seen:
            break
        seen = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ea", "eb").mapInArrow(linked(percent), "a long, b long").distinct()


def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, c, set -> a row for each element."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            data = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(3)]
            at = pa.array(np.repeat(np.arange(len(data)), [len(x) for x in data]))
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(3)), pa.array(np.concatenate(data))], ["node", "n", "c", "e"])


def peeled(rest: DataFrame, sets: DataFrame, percent: int = PERCENT, rounds: int = 2) -> DataFrame:
    """Elements (node, n, c, e, least) of the nodes of ``rest`` (k, node, n, c) that may link to another component.

    ``least`` is the smallest size of a set that the node may link to.
    """
    nodes = rest.groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c"))
    flat = nodes.join(sets, "node").select("node", "n", "c", "elements").mapInArrow(exploded, "node long, n long, c long, e long")
    flat = materialise(flat, "elements")
    alive = None
    for _ in range(rounds):
        own = flat if alive is None else flat.join(alive.select("node"), "node", "left_semi")
        live = own.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("e")
        kept = own.join(live, "e", "left_semi").groupBy("node").agg(F.count("*").alias("m"), F.first("n").alias("n"))
        alive = materialise(kept.where(F.col("m") * 100 >= F.col("n") * percent).select("node", "m"), "alive")
    rest = rest.join(alive, "node")
    for _ in range(2):
        spans = rest.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo < hi").select("k", "least")
        rest = rest.drop("least").join(spans, "k").where(sharing(F.col("m"), F.col("n") + F.col("least"), percent))
    nodes = materialise(rest.groupBy("node").agg(F.min("least").alias("least")), "open")
    return flat.join(nodes, "node")


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, set -> node, sig: a bit set for each element, by its hash."""
    for batch in batches:
        out = np.zeros((batch.num_rows, SIGNATURE), np.uint64)
        for i, x in enumerate(batch.column(1)):
            e = np.frombuffer(x.as_buffer(), np.uint64)
            np.bitwise_or.at(out[i], (e >> np.uint64(6)) % np.uint64(SIGNATURE), np.uint64(1) << (e & np.uint64(63)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SIGNATURE), pa.array(out.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "sig"])


def differing(a: str, b: str) -> Column:
    """How many elements two sets differ in, at least: a bit that only one signature has is an element that only one set has."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def prefix_pairs(elements: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of different components that may be links, from rows (node, n, c, e, least) and signatures (node, sig).

    Of a node's m elements that occur in other components, a link to a set of at least ``least``
    elements needs ``need`` in common; so two linked nodes meet in their m - need + 1 rarest. Where they meet, a pair is
    only made if their signatures allow the similarity: so sets just under it make no rows.
    """
    live = elements.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("e", "df")
    rows = elements.join(live, "e")
    own = Window.partitionBy("node")
    rows = rows.withColumn("m", F.count("*").over(own)).withColumn("i", F.row_number().over(own.orderBy("df", "e")))
    need = F.expr(f"((n + least) * {percent} + {99 + percent}) div {100 + percent}")  # rounded up
    rows = rows.where(F.col("i") <= F.col("m") - need + 1).select("e", "node", "n", "c", "m")
    rows = materialise(rows.join(sigs, "node"), "prefixes")
    side = lambda x: rows.select("e", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "m", "c", "sig")])
    sizes = F.col("n_a") + F.col("n_b")
    able = sharing(F.least("m_a", "m_b"), sizes, percent) & (differing("sig_a", "sig_b") * (100 + percent) <= sizes * (100 - percent))
    one, two = side("a").alias("x"), side("b").alias("y")
    met = one.join(two, (F.col("x.e") == F.col("y.e")) & (F.col("c_a") < F.col("c_b")) & able)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def sharing(both: Column, sizes: Column, percent: int) -> Column:
    """Whether ``both`` common elements of sets with ``sizes`` elements together are similar enough."""
    return both * (100 + percent) >= sizes * percent


def near_enough(n: str, m: str, percent: int) -> Column:
    """Sizes that allow the similarity at all."""
    return (F.least(n, m) * 100) >= (F.greatest(n, m) * percent)


def groups(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``; sets at least ``percent`` similar are linked."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = materialise(docs.mapInArrow(sketched, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "sketch")
    key = ["h1", "h2", "n_shingles"]
    nodes = sk.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    banded = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("k"))
    many = banded.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(banded.join(many, "k"), "members")
    links = None
    if not members.isEmpty():
        links = links_of(docs, members, percent)
    reps = sk.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"))
    own = F.col("doc_id")
    if links is None:
        comp = reps.select(*key, F.col("node").alias("component"))
    else:
        comp = reps.join(components(links), "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    out = sk.select("doc_id", *key).join(comp, key, "left")
    found = F.when(own.isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", own))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def links_of(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that give the components of all candidates' links."""
    nodes = members.select("node").distinct()
    text = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi")
    sets = materialise(text.mapInArrow(full_sets, "node long, elements binary"), "sets")
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = members.join(central, "node").groupBy("k").agg(F.max(F.struct("weight", (-F.col("node")).alias("least"), "n")).alias("hub")).select("k", (-F.col("hub.least")).alias("b"), F.col("hub.n").alias("m"))
    spokes = members.join(hubs, "k").where(F.col("node") != F.col("b")).where(near_enough("n", "m", percent)).select(F.col("node").alias("a"), "b").distinct()
    links = materialise(verified(spokes, sets, percent), "links")
    comp = components(links)
    labelled = members.join(comp, "node", "left").select("k", "node", "n", F.coalesce("component", "node").alias("c"))
    open_ = labelled.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
    rest = materialise(labelled.join(open_, "k"), "open")
    if rest.isEmpty():
        return links
    open_elements = peeled(rest, sets, percent)
    sigs = sets.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(signatures, "node long, sig array<long>")
    across = prefix_pairs(open_elements, sigs, percent)
    tried = spokes.select("a", "b").union(spokes.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = materialise(verified(across.join(tried, ["a", "b"], "left_anti"), sets, percent), "links")
    return links.union(more)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), percent=85)

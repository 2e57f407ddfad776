"""SimHash near-duplicates: exact comparison of fingerprints in tiles, with numpy exclusive-or and bit counts.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes (XXH64, seed 42) of the text's word
shingles, repeats included. Two fingerprints are linked if at most `radius` bits differ, and linked texts, directly or
through others, are one component.

Comparison is exact and complete without comparing all with all. The 64 bits are cut into `parts` runs; two
fingerprints with at most `radius` differing bits agree in at least parts - radius of them, so they meet in the bucket
of some choice of that many runs. More parts make longer bucket keys: their number follows from the number of different
fingerprints, so that buckets stay small as the input grows. Buckets of one are dropped. A bucket is compared as one
tile; one with more than TILE fingerprints is split into tiles by bit count and hash, and only those pairs of tiles are
made whose bit counts lie in the same band, as wide as the radius, or in neighbouring ones. From each pair of tiles come not all links but a spanning set: every
fingerprint is linked to the smallest of its component within the pair, which keeps every component whole.

`keep_one_of_each` keeps one document of each group of texts with a Jaccard likeness of `similarity` or more over k-word
shingles. At 0.8 fingerprints may differ in 20 of 64 bits and more, too many for buckets of equal bits; so there the buckets
are bands of min-hashes (a pair at 0.8 misses all 24 once in 300,000 times), fingerprints of 256 bits are compared in the
same tiles with a wide radius, and the groups that this gives are then split by exact likenesses of their shingle sets.

Cases: equal fingerprints are grouped before anything is compared, so thousands of copies are one entry; a null text
counts as empty; texts without words have fingerprint zero and are linked like others; fewer words than a shingle make
one shingle; rows that repeat an id are kept by `near_duplicates`; there rows with a null id are fingerprinted and belong to their component, whose
id is the smallest that isn't null; an empty table gives an empty result. Texts are processed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.common import cut, join_counted, release, slices
from labelwright.llm.components import connected_components
from labelwright.session import spread, table

SEED = 42
TILE = 4096
#: Fingerprints a bucket should have at most on average; more parts are taken until that holds.
MEAN_BUCKET = 16


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def gram_hashes(text: str | None, k: int) -> np.ndarray:
    """Hashes of a text's k-word shingles in order, repeats included; of all its words if they are fewer; none without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only blanks, tabs and line ends part words
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def simhash(text: str | None, k: int) -> int:
    """The fingerprint of a text, unsigned."""
    return _majority(gram_hashes(text, k))


def fingerprints(docs: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """Columns `key` and `fp`, the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.fromiter((simhash(t, k) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def parts_for(n: int, radius: int) -> int:
    """The fewest parts, above the radius, with at most MEAN_BUCKET of n random fingerprints in a bucket."""
    parts = radius + 1
    while parts < 12 and n / 2.0 ** (64 // parts * (parts - radius)) > MEAN_BUCKET:
        parts += 1
    return parts


def _bucket_keys(fp: Column, radius: int, parts: int) -> Column:
    """One key for each choice of parts - radius runs of bits."""
    width, runs, at = 64 // parts, [], 0
    for i in range(parts):
        w = width + (i < 64 - width * parts)
        runs.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1)))
        at += w
    return F.array(*[F.xxhash64(F.lit(n), *[runs[i] for i in chosen]) for n, chosen in enumerate(combinations(range(parts), parts - radius))])


def spanning_links(fps: np.ndarray, nodes: np.ndarray, radius: int, tile: int = 256) -> list[tuple[int, int]]:
    """Links (larger, smaller) that join every node to the smallest of its component. `fps`: unsigned, a row of words for each node.

    Components are grown one after another: a tile of the component's newest fingerprints is compared with all that no
    component has yet and whose bit counts are within the radius of the tile's. So a fingerprint is compared no more once
    it is linked, and a thousand near copies cost about as many comparisons, not their square.
    """
    if len(fps) == 2:
        return [(int(max(nodes)), int(min(nodes)))] if int(np.bitwise_count(fps[0] ^ fps[1]).sum()) <= radius else []
    pops = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(pops, kind="stable")
    fps, nodes, pops = fps[order], nodes[order], pops[order]
    links: list[tuple[int, int]] = []
    while len(fps):
        newest, newest_pops, members = fps[:1], pops[:1], [nodes[:1]]
        fps, nodes, pops = fps[1:], nodes[1:], pops[1:]
        while len(newest) and len(fps):
            block, newest = newest[:tile], newest[tile:]
            block_pops, newest_pops = newest_pops[:tile], newest_pops[tile:]
            lo, hi = np.searchsorted(pops, block_pops.min() - radius), np.searchsorted(pops, block_pops.max() + radius, "right")
            near = np.zeros(hi - lo, bool)
            for one in range(lo, hi, 8 * tile):
                part = fps[one : min(hi, one + 8 * tile)]
                apart = sum(np.bitwise_count(block[:, None, w] ^ part[None, :, w]).astype(np.int16) for w in range(fps.shape[1]))
                near[one - lo : one - lo + len(part)] = (apart <= radius).any(axis=0)
            if near.any():
                hit = np.concatenate((np.zeros(lo, bool), near, np.zeros(len(fps) - hi, bool)))
                newest, newest_pops = np.concatenate((newest, fps[hit])), np.concatenate((newest_pops, pops[hit]))
                members.append(nodes[hit])
                fps, nodes, pops = fps[~hit], nodes[~hit], pops[~hit]
        if len(members) > 1:
            found = np.concatenate(members)
            least = int(found.min())
            links += [(x, least) for x in found.tolist() if x != least]
    return links


def groups_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of rows with equal integers in `by`, of batches whose rows come group by group."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = np.stack([rows.column(c).to_numpy() for c in by], axis=1)
        edges = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        start = 0
        for end in edges.tolist():
            if end - start > 1:
                yield rows.slice(start, end - start)
            start = end
        held = rows.slice(start)
    if held is not None and held.num_rows > 1:
        yield held


def tile_pairs(rows: DataFrame, cuts: Column, by: Column, reach: int) -> DataFrame:
    """`rows` with `lo` and `hi`, the pairs of tiles that each is in. With one cut there is one tile, paired with itself. Else
    a tile is a value of `by` and one of `cuts` shares by the hash of `node`, paired with all whose value is within `reach`."""
    share = F.pmod(F.xxhash64("node", F.lit(1)), cuts).cast("int")
    here = lambda value, s: value * F.lit(1 << 20) + s
    others = F.flatten(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.transform(F.sequence(F.lit(0), cuts - 1), lambda s: here(by + d, s))))
    pairs = F.transform(others, lambda o: F.struct(F.least(here(by, share), o).alias("lo"), F.greatest(here(by, share), o).alias("hi")))
    pairs = F.when(cuts == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(pairs)
    return rows.withColumn("_pair", F.explode(pairs)).withColumns({"lo": F.col("_pair.lo"), "hi": F.col("_pair.hi")}).drop("_pair")


def links(keyed: DataFrame, radius: int, total: int | None = None, tile: int = TILE) -> DataFrame:
    """`keyed`: columns key (a bucket) and node, bigint, and fp, an array of as many bigints for all; `total` rows at most, counted if not given. Gives links a, b that join exactly the nodes of each component within each bucket."""
    total = keyed.count() if total is None else total
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    pop = F.aggregate("fp", F.lit(0), lambda acc, w: acc + F.bit_count(w).cast("int"))
    met = join_counted(keyed, counts, "key", total).where("n > 1").select("key", "node", "fp", F.ceil(F.col("n") / tile).cast("int").alias("cuts"), F.floor(pop / radius).cast("int").alias("band"))
    dealt = tile_pairs(met, F.col("cuts"), F.col("band"), 1).select("key", "lo", "hi", "node", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in groups_of(batches, ["key", "lo", "hi"]):
            fps = group.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(group.num_rows, -1)
            found += spanning_links(fps, group.column("node").to_numpy(), radius)
            if len(found) > 50_000:
                yield _as_batch(found)
                found = []
        yield _as_batch(found)

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(compare, "a bigint, b bigint").distinct()


def _as_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of `docs`: `id`, `fp` (signed bigint) and `component`, the smallest id of its component."""
    marked = cut(fingerprints(docs, text, key, k))
    groups = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    n = groups.count()
    parts = parts_for(n, radius)
    keyed = groups.select(F.explode(_bucket_keys(F.col("fp"), radius, parts)).alias("key"), F.col("fp").alias("node"), F.array("fp").alias("fp"))
    roots = connected_components(links(keyed, radius, n * math.comb(parts, radius)))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return marked.join(named, "fp", "left").select("id", "fp", "component")


BANDS, BAND_ROWS = 24, 4
#: A wide fingerprint has four words. At a likeness of 0.8 it differs in 39 bits of 256 on average, with a standard
#: deviation of 5.7; at 0.4 in 79.
WIDE_WORDS = 4
WIDE_RADIUS = 62
#: Texts that a task remembers to have sketched.
KNOWN = 100_000
#: Texts in a tile when shingle sets are compared.
TEXT_TILE = 512
_FACTORS = np.random.default_rng(12).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    return np.unique(gram_hashes(text, k))


def wide_simhash(grams: np.ndarray) -> list[int]:
    """A fingerprint of WIDE_WORDS words, signed, from different hashes of shingles: WIDE_RADIUS holds for sets, and a passage that one text repeats moves no bit. Each word takes the hashes mixed another way."""
    words = [_majority(grams if w == 0 else (grams ^ (grams >> np.uint64(29))) * _FACTORS[0, w] ^ _FACTORS[1, w]) for w in range(WIDE_WORDS)]
    return np.array(words, np.uint64).view(np.int64).tolist()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes, signed; texts with equal sets have equal keys."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[at : at + 2048, None] ^ _FACTORS[1]) * _FACTORS[0]).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def alike_links(sets: dict[int, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join exactly the components of nodes whose sets have at least this likeness. A node is compared no more once it is linked."""
    rest = sorted(sets)
    found: list[tuple[int, int]] = []
    while rest:
        least, rest = rest[0], rest[1:]
        newest = [least]
        while newest and rest:
            one = sets[newest.pop()]
            near = {x for x in rest if min(len(one), len(sets[x])) >= similarity * max(len(one), len(sets[x])) and _likeness(one, sets[x]) >= similarity}
            found += [(x, least) for x in near]
            newest += sorted(near)
            rest = [x for x in rest if x not in near]
    return found


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of `docs`: of its smallest id, and of one text (the smallest digest) where several have that id. A null
    id comes after all others, so such a row stays only where its group has no id. Of rows that repeat an id and a text one stays. Columns are kept whatever their names."""
    node = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    least = cut(docs.groupBy(node.alias("node")).agg(F.min(F.col(key).cast("bigint")).alias("least")))
    firsts = docs.select(F.col(key).cast("bigint").alias("_id"), node.alias("node"), F.col(text).alias("_text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in slices(batches):
            # A node that this task has given out before is a copy of the same text.
            if len(known) > KNOWN:
                known.clear()
            nodes = batch.column("node").to_pylist()
            new = [i for i, node in enumerate(nodes) if not (node in known or known.add(node))]
            batch = batch.take(pa.array(new, pa.int64()))
            sets = [shingle_hashes(t, k) for t in batch.column("_text").to_pylist()]
            fps = pa.array([wide_simhash(g) for g in sets], pa.list_(pa.int64()))
            bands = [pa.array(band_keys(g)) for g in sets]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.concat_arrays([pa.array([], pa.int64()), *bands]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), fps, keys], ["node", "fp", "keys"])

    marked = firsts.mapInArrow(sketch, "node bigint, fp array<bigint>, keys array<bigint>")
    texts = cut(marked.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")))
    total = texts.count()
    groups = connected_components(links(texts.select(F.explode("keys").alias("key"), "node", "fp"), WIDE_RADIUS, total * BANDS))
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    wanted = cut(join_counted(groups, sizes, "root", total).join(least, "node").select("node", "root", "least", F.ceil(F.col("n") / TEXT_TILE).cast("int").alias("cuts")))
    near = firsts.join(wanted.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("least")))
    dealt = tile_pairs(near.select("root", "node", "cuts", "_text"), F.col("cuts"), F.lit(0), 0).select("root", "lo", "hi", "node", "_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["root", "lo", "hi"]):
            sets = {n: shingle_hashes(t, k) for n, t in zip(group.column("node").to_pylist(), group.column("_text").to_pylist())}
            yield _as_batch(alike_links(sets, similarity))
        release()

    verified = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(compare, "a bigint, b bigint").distinct()
    roots = connected_components(verified)
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.struct(F.col("least").isNull().alias("_no_id"), F.coalesce("least", F.lit(0)).alias("_id"), F.col("node").alias("_node"))
    kept = rooted.groupBy("root").agg(F.min(first).alias("first")).select("first.*")
    own = F.col(key).cast("bigint")
    rows = docs.select(F.struct("*").alias("_row"), own.isNull().alias("_no_id"), F.coalesce(own, F.lit(0)).alias("_id"), node.alias("_node"))
    return rows.join(kept, ["_no_id", "_id", "_node"], "left_semi").dropDuplicates(["_no_id", "_id", "_node"]).select("_row.*")


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )

"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard.

Two permutations of the 32-bit numbers make all coordinates of a signature: the first scatters a
document's shingles, the second is shifted circularly by another amount for each coordinate, and
the least value is the coordinate. Both are computed bijections, so nothing is stored.

``BANDS`` bands of ``ROWS`` coordinates: a pair at the threshold 0.8 shares a bucket with a
probability of 1 - (1 - 0.8**4)**32 = 1 - 5e-8.

Documents of equal shingle sets are one class and only classes are compared. Inside a bucket, the
class with the smallest number is compared with all others. Confirmed pairs merge to components.
Where a bucket still holds several, a few rounds compare other members of its largest component
with all classes outside it, each round with another member. Classes that are still outside are
then held against the whole of that component, and against the other classes outside, on full
sets and in blocks of at most about ``BLOCK`` classes a side: a task looks up the shingles of one
block in the other and returns one link for a class, never pairs. So no candidate pair of different
components is left out, and a large group of near copies costs rows in proportion to its classes.
Candidate pairs of the stars must pass the size ratio that the threshold implies, and are
confirmed on the full sets of both texts.

Edge cases: a null or blank text has the empty set and links with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat an id are separate rows; a null id takes part, and
its component is the smallest known id in it, null if there is none; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import components, free_name, slices, stored
from ripplecast.llm.words import mix, shingle_sets

BANDS, ROWS = 32, 4
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19  # classes and shingles of one side of a comparison
_SHIFT = 0x61C88647  # places by which the second permutation turns from one coordinate to the next


def _first(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _second(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, in place; ``spare`` holds intermediate values."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """A row of coordinates for each set; all sets must have members."""
    joined = _first((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32))
    starts = np.cumsum([0, *[len(one) for one in sets[:-1]]])
    found = np.empty((len(sets), coordinates), dtype=np.uint32)
    turned, spare = np.empty_like(joined), np.empty_like(joined)
    for k in range(coordinates):
        np.add(joined, np.uint32(k * _SHIFT & 0xFFFFFFFF), out=turned)
        found[:, k] = np.minimum.reduceat(_second(turned, spare), starts)
    return found


def _bucket_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for every set and band."""
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(found), 1))
    for row in range(rows):
        keys = mix(keys + found.reshape(-1, bands, rows)[:, :, row])
    return keys.view(np.int64)


def _class_of(members: np.ndarray) -> int:
    """A number for the set: equal for equal sets."""
    if not len(members):
        return 0
    place = np.arange(1, len(members) + 1, dtype=np.uint64)
    return int(mix(np.array([(members * mix(place)).sum()], dtype=np.uint64)).view(np.int64)[0])


def sketches(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n_shingles, class, buckets): narrow rows that stand for the documents."""
    texts = _keyed(docs, id_col, text_col)
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets([t.encode() for t in batch.column(2).to_pylist()], width)
            sizes = np.array([len(one) for one in sets], dtype=np.int64)
            keys = iter(())
            if sizes.any():
                found = signatures([one for one in sets if len(one)], bands * rows)
                keys = iter(_bucket_keys(found, bands, rows).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes),
                    pa.array([_class_of(one) for one in sets], pa.int64()),
                    pa.array([next(keys) if n else [] for n in sizes], pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n_shingles", "class", "buckets"],
            )

    return texts.mapInArrow(
        run, f"doc_id {kind}, key long, n_shingles long, class long, buckets array<long>"
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return texts.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b", 1 << 20):
            left, right = (
                [text.encode() for text in batch.column(i).to_pylist()] for i in (2, 3)
            )
            known = dict(zip(dict.fromkeys(left), shingle_sets(list(dict.fromkeys(left)), width)))
            good = []
            for text, other in zip(left, shingle_sets(right, width)):
                one = known[text]
                both = len(np.intersect1d(one, other, assume_unique=True))
                good.append(100 * both >= per_cent * (len(one) + len(other) - both))
            keep = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], ["a", "b"])

    one = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    held = pairs.select("a", "b").join(one, "b").join(two, "a")
    return held.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def link(
    docs: DataFrame,
    width: int = 5,
    per_cent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    rounds: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, group, kept), one row per document.

    ``key`` is a hash of id and text, ``group`` a number of the component, null without words. The texts are read twice, once for the sketches and once for
    the texts of classes that share a bucket with another one.
    """
    made = stored(sketches(docs, width, bands, rows, id_col, text_col), "sketches")
    classes = (
        made.where("n_shingles > 0")
        .groupBy("class")
        .agg(F.min(F.struct("key", "n_shingles", "buckets")).alias("one"))
        .select("class", "one.key", "one.n_shingles", "one.buckets")
    )
    entries = classes.select("class", "n_shingles", F.posexplode("buckets").alias("band", "bucket"))
    least = F.min(F.struct("class", "n_shingles")).alias("least")
    shared = entries.groupBy("bucket").agg(least, F.max("class").alias("last"))
    shared = shared.where("least.class < last").drop("last")
    # Only buckets of several classes; from here on all is in proportion to near copies.
    entries = stored(entries.join(shared, "bucket"), "buckets")
    ratio = lambda a, b: (F.least(a, b) * 100 >= F.greatest(a, b) * per_cent)
    star = (
        entries.where(F.col("class") > F.col("least.class"))
        .where(ratio(F.col("n_shingles"), F.col("least.n_shingles")))
        .select(F.col("least.class").alias("a"), F.col("class").alias("b"))
        .distinct()
    )
    star = stored(star, "star")
    wanted = classes.select("class", "key").join(entries.select("class").distinct(), "class")
    texts = stored(
        _keyed(docs, id_col, text_col)
        .select("key", "text")
        .join(wanted, "key")
        .select("class", "text")
        .dropDuplicates(["class"]),
        "texts",
    )
    links, tested = _merged(stored(confirmed(star, texts, width, per_cent), "edges")), star
    named = _named(entries, links)
    for turn in range(rounds):
        pairs = stored(_star_pairs(named, turn, ratio).join(tested, ["a", "b"], "left_anti"), "star")
        more = stored(confirmed(pairs, texts, width, per_cent), "edges")
        if more.isEmpty():
            break
        links, tested = _merged(links.unionByName(more)), tested.unionByName(pairs)
        named = _named(entries, links)
    sets = stored(_sets(texts.join(_sought(named, links), "class"), width), "sets")
    for compare in (_with_component, _among_outside):
        more = stored(compare(named, links, sets, per_cent), "edges")
        if not more.isEmpty():
            links = _merged(links.unionByName(more))
    return _labelled(made, links.toDF("node", "component"))


def _merged(edges: DataFrame) -> DataFrame:
    """(a, b): every linked class and its component; what these links say in the shortest form."""
    return stored(components(edges).toDF("a", "b"), "components")


def _sought(named: DataFrame, links: DataFrame) -> DataFrame:
    """(class): classes of mixed buckets, and all of the components that are their largest."""
    tops = named.select(F.col("top").alias("b")).distinct()
    held = links.join(tops, "b", "left_semi").select(F.col("a").alias("class"))
    return named.select("class").unionByName(held).distinct()


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(class, n, members): the sorted shingle hashes of every class, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()], width)
            sizes = pa.array([len(one) for one in sets], pa.int64())
            coded = pa.array([one.tobytes() for one in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, coded], ["class", "n", "members"])

    return texts.select("class", "text").mapInArrow(run, "class long, n long, members binary")


class _Index:
    """The sets of a block by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(one) for one in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.values = flat[order]
        self.holder = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def near(self, one: np.ndarray, per_cent: int) -> np.ndarray:
        """Places of the sets with the similarity."""
        low, high = (np.searchsorted(self.values, one, side) for side in ("left", "right"))
        count = high - low
        begins = np.cumsum(count) - count
        found = np.arange(count.sum()) + np.repeat(low - begins, count)
        both = np.bincount(self.holder[found], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= per_cent * (len(one) + self.sizes - both))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of equal keys; they arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        columns = [table.column(name).to_numpy() for name in keys]
        fresh = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        cuts = [0, *fresh.tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _members(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(one, dtype=np.uint64) for one in table.column("members").to_pylist()]


def _blocks() -> Column:
    """How many blocks a side needs, from the rows' ``n``."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _blocked(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
    """Add block numbers for both sides of a comparison: a row has one of ``own`` and all of ``other``."""
    mine = F.pmod(F.xxhash64("class", by), F.col(own)).cast("int")
    return rows.withColumn("mine", mine).withColumn(
        "theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    )


def _with_component(named: DataFrame, links: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): a link from a class outside a bucket's largest component to one of its classes, if there is one."""
    size = sets.select("class", "n")
    seekers = named.where("component <> top").select("class", "top").distinct().join(size, "class")
    asked = seekers.groupBy("top").agg(_blocks().alias("q"))
    held = links.select(F.col("a").alias("class"), F.col("b").alias("top"))
    alone = named.where("class = top").select("class", "top")  # a component of one has no links
    held = held.unionByName(alone).distinct().join(asked.select("top"), "top", "left_semi").join(size, "class")
    sizes = asked.join(held.groupBy("top").agg(_blocks().alias("h")), "top")
    sides = []
    for side, (rows, own, other) in enumerate(((seekers, "q", "h"), (held, "h", "q"))):
        spread = _blocked(rows.join(sizes, "top"), "top", own, other)
        pair = ("mine", "theirs") if side == 0 else ("theirs", "mine")
        sides.append(spread.select("class", "top", *[F.col(c).alias(n) for c, n in zip(pair, "ij")], F.lit(side).alias("side")))
    both = sides[0].unionByName(sides[1]).join(sets.select("class", "members"), "class")
    keys = ["top", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            side, classes = table.column("side").to_numpy(), table.column("class").to_numpy()
            one = _members(table)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found = []
            if len(left) and len(right):
                index = _Index([one[at] for at in right])
                for at in left:
                    near = index.near(one[at], per_cent)
                    if len(near):
                        found.append((classes[at], classes[right[near[0]]]))
            yield _edges(found)

    dealt = both.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "side", "class", "members").mapInArrow(run, "a long, b long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _among_outside(named: DataFrame, links: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): links between classes outside the largest component of a bucket that are not joined yet."""
    joined = links.select(F.col("a").alias("class"), F.col("b").alias("_c"))
    outside = named.where("component <> top").select("bucket", "class").join(joined, "class", "left")
    outside = outside.select("bucket", "class", F.coalesce("_c", "class").alias("component"))
    outside = outside.join(sets.select("class", "n"), "class")
    sizes = outside.groupBy("bucket").agg(
        _blocks().alias("blocks"),
        F.min("component").alias("_low"), F.max("component").alias("_high"),
    ).where("_low < _high").select("bucket", "blocks")
    spread = _blocked(outside.join(sizes, "bucket"), "bucket", "blocks", "blocks")
    ordered = [F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j")]
    keys = ["bucket", "i", "j"]
    dealt = spread.select("bucket", *ordered, "mine", "class", "component")
    dealt = dealt.join(sets.select("class", "members"), "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            parts, mine = table.column("component").to_numpy(), table.column("mine").to_numpy()
            found: list[tuple[int, int]] = []
            if len(np.unique(parts)) > 1:
                classes, one = table.column("class").to_numpy(), _members(table)
                i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
                right = np.flatnonzero(mine == j)
                index = _Index([one[at] for at in right]) if len(right) else None
                root = parts.copy()
                for at in np.flatnonzero(mine == i) if index else ():
                    near = right[index.near(one[at], per_cent)]
                    for other in near[root[near] != root[at]]:
                        if root[other] != root[at]:  # one link for two components
                            found.append((classes[at], classes[other]))
                            root[root == root[other]] = root[at]
            yield _edges(found)

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "mine", "component", "class", "members").mapInArrow(run, "a long, b long")


def _named(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Entries of buckets that hold several components, with theirs and ``top``, the largest."""
    merged = links.select(F.col("a").alias("class"), F.col("b").alias("component"))
    named = entries.join(merged, "class", "left").select(
        "bucket", "band", "class", "n_shingles", F.coalesce("component", "class").alias("component")
    )
    parts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")
    )
    mixed = largest.where("parts > 1").select("bucket", F.col("top.component").alias("top"))
    return stored(named.join(mixed, "bucket"), "mixed")


def _ordered(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _star_pairs(named: DataFrame, turn: int, ratio) -> DataFrame:
    """One member of each bucket's largest component, another in every turn, with all outside it."""
    draw = F.struct(F.xxhash64(F.lit(turn), "class").alias("draw"), F.col("class").alias("c"), "n_shingles")
    leader = named.where("component = top").groupBy("bucket").agg(F.min(draw).alias("leader"))
    leader = leader.select("bucket", F.col("leader.c").alias("c1"), F.col("leader.n_shingles").alias("n1"))
    outside = named.where("component <> top").select("bucket", "class", "n_shingles")
    pairs = outside.join(leader, "bucket").where(ratio(F.col("n1"), F.col("n_shingles")))
    return pairs.select(*_ordered("c1", "class")).distinct()


def _labelled(made: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the smallest id of their component."""
    least = made.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    named = least.join(found.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "first", F.coalesce("component", "class").alias("component")
    )
    first = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(first, "component").select("class", "component_id", F.col("component").alias("group"))
    rows = made.select("doc_id", "key", "n_shingles", "class")
    alone = F.col("n_shingles") == 0
    with_id = rows.where(~alone).join(ids, "class").drop("class")
    without = rows.where(alone).select(
        "doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group")
    )
    both = with_id.select("doc_id", "key", "n_shingles", "component_id", "group").unionByName(without)
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, one of each group, all columns as they were.

    That is a row with the component's id; of several such rows with different texts, the one with
    the smallest key. Where all ids of a group are null, the smallest key stays too. Documents
    without words and rows that repeat a kept row's id and text stay.
    """
    found = link(docs, id_col=id_col, text_col=text_col, **how).where("n_shingles > 0")
    row, key = found.select("key", "group", "kept").distinct(), free_name(docs, "_key")
    first = row.where("kept").groupBy("group").agg(F.min("key").alias("stays"))
    gone = row.join(first, "group").where("key <> stays").select(F.col("key").alias(key)).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(key, F.xxhash64(id_col, text)).join(gone, key, "left_anti").select(*docs.columns)

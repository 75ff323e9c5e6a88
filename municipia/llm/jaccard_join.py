"""N-gram Jaccard join by signature trees: which documents share so many word shingles that they are near duplicates.

1. Documents of one shingle set are one class, told by a 128-bit digest; only one member of a class goes on.
2. Two sets that link share one of the first ``size - ceil(t * size) + 1`` shingles of each in any common order, so members
   are dealt to a block for each such shingle. The order puts shingles that many documents share last (the most frequent
   ``HOT_SHINGLES`` of the whole table, counted first), which keeps passages that recur everywhere from gathering documents.
   Blocks of the same members, told by their number and 128 bits of hashes, collapse to one; a block larger than ``BLOCK`` is split by a hash into chunks and each pair
   of chunks becomes a block, so no task holds more than two chunks.
3. In a block, a signature tree over bitmaps and size ranges is traversed against itself (``signature_tree``). The first
   traversal, over each class's largest blocks, reports the likeliest partner of each member; exact overlaps of those give
   components. The second reports every possible pair of members that are still in different components, each in one of the
   blocks that hold both: that of the least shingle. All reported pairs are checked on whole shingle sets, so the links
   between components are exact, and no link that would change a component is lost.
4. Shingle sets are made anew, and shuffled, for the documents of reported pairs alone; a bitmap of their hashed ids, of
   bounded size, keeps most other texts from the shuffle that finds them.

Shingle hashes have 64 bits; two shingles of a pair of sets share a hash by chance about once in 10^14 pairs.

Defined results: a null or empty text has no shingles and is its own component; rows of one id are documents of their own
that carry the same id; a row without an id gets its number of shingles and no component, and links nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from municipia.llm import signature_tree
from municipia.llm.components import components
from municipia.llm.shared import Scratch, among, blocks, written
from municipia.llm.words import hashes, mix, shingles

WORDS = 5
#: The threshold, intersection / union >= NUM / DEN.
NUM, DEN = 4, 5
HOT_SHINGLES = 1 << 18
SPAN = 4_000_000
BLOCK = 4096
#: Blocks of each class in the first traversal.
HEAD_START = 4


def digest(sh: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    return np.array([np.bitwise_xor.reduce(mix(sh, 1)), np.sum(mix(sh, 2), dtype=np.uint64)], np.uint64).tobytes()


def hot_shingles(docs: DataFrame, words: int = WORDS, most: int = HOT_SHINGLES) -> np.ndarray:
    """The shingles in most documents, sorted: a shingle counts where three texts or more of a task's span hold it, a span
    being ``SPAN`` shingles. The result orders shingles and drops none, so what it misses costs time and no link."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= 3
        return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, held = set(), [], 0
        for block in blocks(batches):
            for h in hashes(block.column("text")):
                s = shingles(h, words)
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    sets.append(s)
                    held += len(s)
            if held >= SPAN:
                yield counted(sets)
                seen, sets, held = set(), [], 0
        if sets:
            yield counted(sets)

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().astype(np.int64).view(np.uint64))


def profiles(docs: DataFrame, hot: np.ndarray, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, cls (digest), prefix (the shingles to be dealt by), bits (bitmap of the set); the last two
    are null on a row without an id, and on a class that the task has met before on a row with one."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        for block in blocks(batches):
            n, cls, prefix, bits = [], [], [], []
            for h, named in zip(hashes(block.column("text")), block.column("doc_id").is_valid().to_pylist(), strict=True):
                s = shingles(h, words)
                n.append(len(s))
                cls.append(digest(s))
                if not named or cls[-1] in seen:  # links nothing, or this task has dealt the class already
                    prefix.append(None)
                    bits.append(None)
                    continue
                seen.add(cls[-1])
                if len(often) and len(s):
                    at = np.searchsorted(often, s)
                    rare = often[np.minimum(at, len(often) - 1)] != s
                    first = np.concatenate([s[rare], s[~rare]])
                else:
                    first = s
                prefix.append(first[: len(s) - -(-num * len(s) // den) + 1].view(np.int64) if len(s) else first.view(np.int64))
                bits.append(signature_tree.bitmap(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "cls", "prefix", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, cls binary, prefix array<long>, bits binary")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """cls, shingles (sorted) of these documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = {digest(s): s for s in (shingles(h, words) for h in hashes(block.column("text"))) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64()))], names=["cls", "shingles"])

    return docs.select("text").mapInArrow(run, "cls binary, shingles array<long>")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of keys, which stand together, as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _tree(rows: pa.Table, mine: np.ndarray, sizes: np.ndarray, groups: np.ndarray, words: int) -> signature_tree.Tree:
    held = rows.column("bits").combine_chunks()
    bits = np.stack([signature_tree.fold(np.frombuffer(held[int(i)].as_buffer(), np.uint64), words) for i in mine])
    return signature_tree.Tree(bits, sizes[mine], groups[mine])


def block_pairs(rows: pa.Table, num: int, den: int, best_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in rows of the possible pairs of one block: members of the band with each other and with the band below."""
    sizes, own, chunk = (rows.column(c).to_numpy() for c in ("n", "own", "chunk"))
    _, groups = np.unique(np.array(rows.column("component").to_pylist(), object), return_inverse=True)
    words = pc.min(pc.binary_length(rows.column("bits"))).as_py() // 8
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    sides = [(True, low, True, high), (True, low, False, high)] + ([(False, low, True, high)] if low != high else [])
    trees: dict[tuple, tuple[np.ndarray, signature_tree.Tree]] = {}
    found = []
    for own_a, chunk_a, own_b, chunk_b in sides:
        for key in ((own_a, chunk_a), (own_b, chunk_b)):
            if key not in trees:
                mine = np.flatnonzero((own == key[0]) & (chunk == key[1]))
                trees[key] = (mine, _tree(rows, mine, sizes, groups, words) if len(mine) else None)
        (at_a, a), (at_b, b) = trees[own_a, chunk_a], trees[own_b, chunk_b]
        if a and b:
            i, j = signature_tree.traverse(a, b, num, den, best_only)
            found.append((at_a[i], at_b[j]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def tree_pairs(members: DataFrame, classes: DataFrame, best_only: bool, num: int, den: int, block: int) -> DataFrame:
    """a, b: classes that the trees leave as possible links, once each. members: token, band, own, cls, n, m (of its block)."""
    if not best_only:  # a pair is reported where no lower block of its band holds both
        lists = members.groupBy("cls", "band", "own").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        members = members.join(lists, ["cls", "band", "own"])
    else:
        members = members.withColumn("tokens", F.lit(None).cast("array<long>"))
    k = F.ceil(F.col("m") / block).cast("int")
    dealt = (
        members.withColumn("k", k)
        .withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    )
    keys = ["token", "band", "low", "high"]
    placed = dealt.join(classes, "cls").select(*keys, "own", "chunk", "cls", "n", "bits", "component", "tokens").repartition(*keys).sortWithinPartitions(*keys, "n", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in runs(batches, keys):
            i, j = block_pairs(rows, num, den, best_only)
            if len(i) and not best_only:
                here = rows.column("token")[0].as_py()
                lower = {k: {t for t in rows.column("tokens")[k].as_py() if t < here} for k in np.union1d(i, j).tolist()}
                first = [lower[x].isdisjoint(lower[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                i, j = i[first], j[first]
            if len(i):
                names = rows.column("cls").combine_chunks()
                a.append(names.take(pa.array(i)))
                b.append(names.take(pa.array(j)))
            if len(a) >= 1000 or sum(map(len, a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(a), pa.concat_arrays(b)], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(a), pa.concat_arrays(b)], names=["a", "b"])

    pairs = placed.mapInArrow(run, "a binary, b binary")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.distinct() if best_only else pairs


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of a written table whose whole shingle sets link."""
    named = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    ids = scratch.written(classes.join(named, "cls", "left_semi").select("doc_id").distinct())
    # both joins below read the one shuffle of the sets by class
    sets = shingle_sets(among(docs.select("doc_id", "text"), "doc_id", ids), words).join(named.hint("merge"), "cls", "left_semi").dropDuplicates(["cls"])
    with_a = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return scratch.written(with_b.where((num + den) * common >= num * (F.size("sa") + F.size("sb"))).select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    held = written(profiles(docs, hot_shingles(docs, words), words, num, den))
    named = held.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = F.xxhash64("cls")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int")
    sides = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))
    # one shuffle of the postings by shingle serves all that follows up to the choice of blocks
    postings = named.select(F.explode("prefix").alias("token"), key.alias("key"), F.col("n_shingles").alias("n")).where("token is not null").repartition("token").distinct()
    sided = postings.select("token", "key", "n", F.inline(sides))
    met = F.count("*").alias("m"), F.count_if("own").alias("owners"), F.bit_xor(F.xxhash64("key", "own")).alias("who"), F.bit_xor(F.xxhash64("own", "key")).alias("which")
    sets = sided.groupBy("token", "band").agg(*met).where("m > 1 and owners > 0")
    chosen = sets.groupBy("band", "m", "owners", "who", "which").agg(F.min("token").alias("token"))
    by_token = chosen.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", "m"))).alias("sizes"))
    dealt = scratch.written(sided.join(by_token.hint("merge"), "token").withColumn("m", F.col("sizes")[F.col("band")]).where("m is not null").drop("sizes"))
    keys = scratch.written(dealt.select("key").distinct())
    classes = scratch.written(
        among(named.where("bits is not null").select("cls", key.alias("key"), "doc_id", F.col("n_shingles").alias("n"), "bits"), "key", keys).dropDuplicates(["cls"])
    )
    members = scratch.written(dealt.join(classes.select("cls", "key"), "key").drop("key"))

    # a head start only: each class in its largest blocks, which it shares with most others; the second traversal is complete
    place = F.row_number().over(Window.partitionBy("cls", "own").orderBy(F.desc("m"), "token"))
    largest = members.withColumn("place", place).where(F.col("place") <= HEAD_START).drop("place")
    first = scratch.written(tree_pairs(largest, classes.select("cls", "bits", F.col("cls").alias("component")), True, num, den, block))
    links = linked(first, docs, classes, words, num, den, scratch)
    roots = scratch.written(components(links, scratch))
    told = classes.select("cls", "bits").join(roots.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named_members = members.join(told.select("cls", "component"), "cls")
    open_blocks = named_members.groupBy("token", "band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token", "band")
    second = scratch.written(tree_pairs(members.join(open_blocks, ["token", "band"], "left_semi"), told, False, num, den, block).join(first, ["a", "b"], "left_anti"))
    more = linked(second, docs, classes, words, num, den, scratch)
    roots = components(links.union(more), scratch)

    label = F.coalesce("component", "cls")
    least = named.groupBy("cls").agg(F.min("doc_id").alias("least")).join(roots.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "least", label.alias("label"))
    least = scratch.written(least)
    final = written(least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("cls", "component_id"))
    scratch.clear()
    unlinked = held.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return held.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select("doc_id", "n_shingles", "cls").join(final, "cls").select("doc_id", "n_shingles", "component_id").union(unlinked)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that stand for their group: of the rows that carry the group's least doc_id the one
    with the least text, and rows without doc_id."""
    first = near_duplicates(docs.select("doc_id", "text"), **options).where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    held = docs.select(F.struct("*").alias("doc"))
    kept = held.join(written(first), F.col("doc.doc_id") == F.col("first"), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc.doc_id").orderBy(F.asc_nulls_first("doc.text")))
    return kept.withColumn("place", place).where("place = 1").union(held.where("doc.doc_id is null").withColumn("place", F.lit(1))).select("doc.*")

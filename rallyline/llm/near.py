"""Operator 6: n-gram Jaccard join by MinHash banding.

Texts with the same word n-grams form one class, compared once. Classes that share a band hash meet in a
bucket; a bucket is dealt out in blocks, so that none grows with a group's size. A pair is compared only in
the first band that it shares, on its full n-gram sets, and a bucket's task sends on each class's links as
a count and one edge to the least class that it is linked to there, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyline.llm import bloom
from rallyline.llm.common import join_counted, map_arrow, map_blocks, text_rows, unused
from rallyline.llm.components import components
from rallyline.llm.text import Block, mix, slices
from rallyline.session import settle

BLOCK_CLASSES = 256
_SECOND = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Banding:
    """How many bands of how many rows find a pair at the threshold with the target recall."""

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    most_hashes: int = 128

    @property
    def shape(self) -> tuple[int, int]:
        """(bands, rows): the most rows, hence the fewest false meetings, that the hashes allow."""
        best = (1, 1)
        for rows in range(1, self.most_hashes + 1):
            bands = math.ceil(math.log(1 - self.recall) / math.log1p(-min(self.threshold**rows, 1 - 1e-12)))
            if bands * rows <= self.most_hashes:
                best = (bands, rows)
        return best

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        seeds = mix(np.arange(1, 2 * math.prod(self.shape) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return seeds[::2] | np.uint64(1), seeds[1::2]


def _shingles(block: Block, words: int, halves: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all word n-grams, once from each of the first halves of the word hashes, and their texts in order; a
    text of fewer words has one, of all its words."""
    few = np.flatnonzero((block.n_words > 0) & (block.n_words < words))
    at = np.searchsorted(block.doc, few)
    out, hashed = [], block.word_hashes()
    owner = place = None
    for hashes in hashed.T[:halves]:
        hashes = np.ascontiguousarray(hashes)
        grams, first = block.windows(words, hashes)
        if owner is None:
            owner = block.doc[first]
            place = np.searchsorted(owner, few)
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for i in range(words - 1):
                has = block.n_words[few] > i
                short[has] = mix(short[has] * _SECOND + hashes[at[has] + i])
            grams = np.insert(grams, place, short)
        out.append(grams)
    return out, np.insert(owner, place, few)


def _keys(grams: list[np.ndarray], owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits a text that depend on its n-grams and how often each occurs, not on their order: 64 from each of two
    independent hashes of an n-gram."""
    ends = np.searchsorted(owner, np.arange(n + 1))
    halves = []
    for hashed in grams:
        total = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(mix(hashed + _SECOND), out=total[1:])
        halves.append(mix(total[ends[1:]] - total[ends[:-1]]))
    return halves[0], halves[1]


def _packed(first: np.ndarray, second: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.stack([first, second], 1)], pa.binary())


def signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """doc_id, key (of the n-gram class), head (64 bits of key), bands (band hashes; null if without words)."""
    bands, rows = banding.shape
    scale, shift = banding.coefficients()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = Block(batch.column("text"))
        both, owner = _shingles(block, banding.words, 2)
        first, second = _keys(both, owner, block.n)
        grams = both[0]
        have = np.flatnonzero(block.n_words > 0)
        out = np.zeros((len(have), bands), np.uint64)
        if len(have):
            starts, scratch = np.searchsorted(owner, have), np.empty_like(grams)
            for i in range(bands * rows):
                np.multiply(grams, scale[i], out=scratch)
                scratch += shift[i]
                np.right_shift(scratch, np.uint64(32), out=scratch)
                low = np.minimum.reduceat(scratch, starts)
                band = i // rows
                out[:, band] = mix(out[:, band] * _SECOND + low + np.uint64(band + 1))
        ends = np.zeros(block.n + 1, np.int32)
        np.cumsum(np.where(block.n_words > 0, bands, 0), out=ends[1:])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.view(np.int64).ravel()))
        return pa.record_batch([batch.column("doc_id"), _packed(first, second), pa.array(first.view(np.int64)), lists], ["doc_id", "key", "head", "bands"])

    return map_blocks(text_rows(docs), work, "doc_id long, key binary, head long, bands array<long>")


def _gram_sets(docs: DataFrame, banding: Banding, active) -> DataFrame:
    """key, grams (sorted distinct n-gram hashes) of texts whose class may be active; one row a class and block."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = Block(batch.column("text"))
        both, owner = _shingles(block, banding.words, 2)
        first, second = _keys(both, owner, block.n)
        grams = both[0]
        wanted = np.flatnonzero(bloom.holds(first.view(np.int64), active.value) & (block.n_words > 0))
        _, once = np.unique(np.stack([first, second], 1)[wanted], axis=0, return_index=True)
        wanted = wanted[np.sort(once)]
        ends = np.searchsorted(owner, np.arange(block.n + 1))
        sets = [np.unique(grams[ends[i] : ends[i + 1]]).tobytes() for i in wanted]
        return pa.record_batch([_packed(first[wanted], second[wanted]), pa.array(sets, pa.binary())], ["key", "grams"])

    return map_blocks(text_rows(docs), work, "key binary, grams binary")


def _grouped(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Column lists of each run of rows with the same key, from batches sorted by it."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        keys, start = list(zip(*(columns[k] for k in key), strict=True)), 0
        for end in range(1, len(keys) + 1):
            if end < len(keys) and keys[end] == keys[start]:
                continue
            part = {name: values[start:end] for name, values in columns.items()}
            if held and now == keys[start]:
                for name, values in part.items():
                    held[name].extend(values)
            else:
                if held:
                    yield held
                held, now = part, keys[start]
            start = end
    if held:
        yield held


def _new_pairs(bands: np.ndarray, sides: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of a bucket's block meet here for the first time: those that share no earlier band."""
    n = len(bands)
    fresh = np.triu(np.ones((n, n), bool), 1)
    if sides.any():  # two blocks of one bucket: only pairs across them
        fresh &= sides[:, None] != sides[None, :]
    for earlier in range(band):
        fresh &= bands[:, earlier][:, None] != bands[:, earlier][None, :]
    return fresh


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams every two sets share, from an incidence matrix dealt with in column blocks."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float64)
    width = 4096
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((n, width), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        shared += block @ block.T
    return np.rint(shared).astype(np.int64)


def links(docs: DataFrame, sets_of: DataFrame, banding: Banding) -> DataFrame:
    """key, links, doc_links, root: what each bucket block found for a class. docs gives the n-gram sets."""
    bands, _ = banding.shape
    classes = sets_of.where(F.size("bands") > 0)
    ranges = bloom.build_ranges(classes, "bands", classes.count() * bands, least=2)

    # Band hashes that only one class has are dropped before anything is shuffled.
    def meet(part: bloom.Range) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("bands")
                flat = lists.flatten().to_numpy()
                may = np.flatnonzero(part.holds(flat) & part.owns(flat))
                at = pa.array(may // bands)
                columns = [batch.column(c).take(at) for c in ("key", "head", "size", "bands")]
                yield pa.record_batch([*columns, pa.array((may % bands).astype(np.int32)), pa.array(flat[may])], ["key", "head", "size", "bands", "band", "bucket"])

        return map_arrow(classes.select("key", "head", "size", "bands"), run, "key binary, head long, size long, bands array<long>, band int, bucket long")

    met = bloom.over_ranges(ranges, meet)
    counts = settle(met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    met = join_counted(met, counts, "bucket", "n").withColumn("parts", F.ceil(F.col("n") / BLOCK_CLASSES).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    # Block pair (low, high) of a bucket holds its parts low and high: all pairs meet in exactly one of them.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = met.select("*", other).withColumn("side", (F.col("part") > F.col("other")).cast("int"))
    where = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    blocks = met.select(where.alias("block"), "key", "head", "size", "bands", "band", "side")

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every block, the classes that have a pair to compare there."""
        out: dict[str, list] = {"block": [], "key": [], "head": [], "size": [], "bands": [], "band": [], "side": []}

        def flush() -> pa.RecordBatch:
            types = {"block": pa.int64(), "key": pa.binary(), "head": pa.int64(), "size": pa.int64(), "bands": pa.list_(pa.int64()), "band": pa.int32(), "side": pa.int32()}
            batch = pa.record_batch([pa.array(out[c], types[c]) for c in out], list(out))
            for values in out.values():
                values.clear()
            return batch

        for group in _grouped(batches, ("block", "band")):
            if len(group["key"]) > 1:
                pairs = _new_pairs(np.array(group["bands"]), np.array(group["side"]), group["band"][0])
                for i in np.flatnonzero(pairs.any(0) | pairs.any(1)).tolist():
                    for name, values in out.items():
                        values.append(group[name][i])
            if len(out["key"]) > 4096:
                yield flush()
        if out["key"]:
            yield flush()

    schema = "block long, key binary, head long, size long, bands array<long>, band int, side int"
    todo = settle(map_arrow(blocks.repartition("block").sortWithinPartitions("block", "band"), fresh, schema))
    sets = _gram_sets(docs, banding, bloom.build(todo, "head", todo.count(), least=1))
    sets = sets.groupBy("key").agg(F.first("grams").alias("grams"))
    with_sets = todo.drop("head").join(sets, "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            out.clear()
            return pa.record_batch(columns, ["key", "links", "doc_links", "root"])

        for group in _grouped(batches, ("block", "band")):
            sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
            if len(sets) < 2:
                continue
            lengths, shared = np.array([len(s) for s in sets]), _overlaps(sets)
            alike = shared >= banding.threshold * (lengths[:, None] + lengths[None, :] - shared) - 1e-9
            alike &= _new_pairs(np.array(group["bands"]), np.array(group["side"]), group["band"][0])
            alike |= alike.T
            sizes = np.array(group["size"])
            n, documents, roots = alike.sum(1), alike @ sizes, _roots(alike)
            for i in np.flatnonzero(n).tolist():
                out.append((group["key"][i], int(n[i]), int(documents[i]), group["key"][roots[i]]))
            if len(out) > 4096:
                yield flush()
        if out:
            yield flush()

    ordered = with_sets.repartition("block").sortWithinPartitions("block", "band")
    return map_arrow(ordered, compare, "key binary, links long, doc_links long, root binary")


def _roots(alike: np.ndarray) -> np.ndarray:
    """The first member of each member's connected part."""
    root = np.arange(len(alike))
    for i in range(len(alike)):
        for j in np.flatnonzero(alike[i, :i]).tolist():
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        root[i] = root[root[i]]
    return root


def classes_of(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """key, size, first_doc, links, doc_links, group (key of the group's root), group_doc, of classes in a group.

    Only classes with copies or links are there; every other document is alone.
    """
    signed = settle(signatures(docs, banding))
    return _classes(docs, signed, banding)


def _classes(docs: DataFrame, signed: DataFrame, banding: Banding) -> DataFrame:
    per_class = settle(signed.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_doc"), F.first("head").alias("head"), F.first("bands").alias("bands")))
    found = settle(links(docs, per_class, banding))
    counted = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    rooted = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    in_group = (
        per_class.drop("bands").join(counted, "key", "left").where("size > 1 or links is not null")
        .join(rooted.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "head", "size", "first_doc", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("doc_links", F.lit(0)).alias("doc_links"), F.coalesce("root", "key").alias("group"))
    )
    in_group = settle(in_group)
    heads = in_group.groupBy("group").agg(F.min(F.struct(F.coalesce("first_doc", F.lit((1 << 63) - 1)), F.col("key"), F.col("first_doc"))).alias("h"), F.sum("size").alias("group_size"))
    heads = heads.select("group", F.col("h.first_doc").alias("group_doc"), F.col("h.key").alias("group_key"), "group_size")
    members = in_group.groupBy("group").agg(F.count("*").alias("members"))
    return settle(join_counted(in_group, heads.join(members, "group"), "group", "members").drop("members"))


def join(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copies_id, copies, n_links, n_class_links, group_size.

    copies_id is the smallest doc_id among rows with the same word n-grams and copies their number; links are
    to other such classes at the threshold of Jaccard similarity or more: n_class_links counts classes, n_links
    the rows in them. class_id is the smallest doc_id among all rows joined by links, directly or through
    others, and group_size their number. Texts without words, null ones too, form one class of copies without
    links; a text of fewer words than an n-gram has its whole word sequence as its one n-gram. A row alone has
    its own doc_id, one copy and no links. Null ids count last. Repeated rows count each.
    """
    signed = settle(signatures(docs, banding))
    groups = _classes(docs, signed, banding)
    rows = signed.select("doc_id", "key")
    own = F.coalesce(F.col("size"), F.lit(1))
    return join_counted(rows, groups.drop("head", "group", "group_key"), "key", "size", how="left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("group_doc")).alias("class_id"),
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first_doc")).alias("copies_id"),
        own.cast("long").alias("copies"),
        F.coalesce("doc_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_class_links"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def keep_one(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """The rows of docs that stay when one row of each group of join() does: the one with the smallest doc_id.

    Rows in no group go straight to the output; of a group's rows only those of its first class are shuffled,
    at most one a batch and class. Texts without words, null ones too, are one group, of which one row stays; a null
    id counts last; of rows with equal ids any one stays; no rows give none; all columns stay as they are.
    """
    groups = classes_of(docs, banding)
    filled = bloom.build(groups, "head", groups.count(), least=1)
    key, flag, leads, place = unused(docs, "__key", "__maybe", "__leads", "__place")
    extra = T.StructType([*docs.schema, T.StructField(key, T.BinaryType()), T.StructField(flag, T.BooleanType())])
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole.rename_columns([f"c{i}" for i in range(whole.num_columns)]), f"c{text_at}"):
                block = Block(batch.column(text_at))
                first, second = _keys(*_shingles(block, banding.words, 2), block.n)
                maybe = bloom.holds(first.view(np.int64), filled.value)
                ids, best = batch.column(id_at).to_pylist(), {}
                for i in np.flatnonzero(maybe).tolist():
                    held = best.setdefault((first[i], second[i]), i)
                    if (ids[i] is None, ids[i] or 0) < (ids[held] is None, ids[held] or 0):
                        best[first[i], second[i]] = i
                stay = np.sort(np.concatenate([np.flatnonzero(~maybe), np.fromiter(best.values(), np.int64, len(best))])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(stay)).columns, _packed(first[stay], second[stay]), pa.array(maybe[stay])], extra.names)

    left = map_arrow(docs, run, extra)
    verdict = groups.select(F.col("key").alias(key), (F.col("key") == F.col("group_key")).alias(leads))
    several = left.where(flag).join(verdict, key, "left").where(F.coalesce(leads, F.lit(True)))
    order = Window.partitionBy(key).orderBy(F.col("doc_id").asc_nulls_last())
    several = several.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return left.where(~F.col(flag)).select(docs.columns).unionByName(several.select(docs.columns))

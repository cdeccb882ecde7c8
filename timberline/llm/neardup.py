"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds the 64-bit hashes of its distinct word shingles. Its signature has 32 symbols of b = 16 bits, each
from the least value of the set under one permutation. Signatures are cut into 8 chunks of 4 symbols. If two differ in at
most 15 symbols, some chunk differs in at most one (pigeonhole); the allowed errors of a chunk are enumerated by leaving
out each symbol in turn, so both meet under at least one of 32 keys. A pair of Jaccard similarity 0.75 has 8 differing
symbols on average; all eight chunks fail it with a probability of 2e-5, and less above. Links are confirmed on whole sets.

Equal sets are one class. In each key's group every class is compared with the least one, then in a few rounds with the
nearest one that is still in another component; last, all classes that are in one group and in different components are
compared. So no link between components is lost, and neither the pairs of a large group nor the links in it are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import bit_map, byte_class, components, gram_hashes, map_batches, mark, materialise, mix, odd_numbers, read, slices, word_hashes

WORD = byte_class([0x20, *range(0x09, 0x0E)])
SYMBOLS, CHUNKS = 32, 8
PER = SYMBOLS // CHUNKS
#: Signatures that differ in more symbols (over five standard deviations at similarity 0.75) aren't tried in the first round; the last one tries them.
FAR = 20
#: Members of one key's group that are compared in one block.
BLOCK = 1024
#: Bits of a set's outline.
OUTLINE_BITS = 2048
#: Rounds in which every class tries its nearest signature in another component, before all that is left is tried.
NEAREST_ROUNDS = 4
_A, _B = odd_numbers(SYMBOLS, 31), odd_numbers(SYMBOLS, 32)


def shingle_sets(data: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words is one shingle, one without words has none."""
    words, _, _, first = word_hashes(data, rows, WORD)
    grams = gram_hashes(words, size, 41)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a, 41))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of symbols for each set that isn't empty."""
    flat, cut = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(flat * _A[k] + _B[k], cut)
            out[:, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _signed(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """row, id, name of the text, number of shingles, 128 bits that name the set, signature, set."""
    kind = docs.schema[id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, to, data, rows in slices(batch.column(2)):
            sets = shingle_sets(data, rows, size)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            names = np.zeros((len(sets), 2), np.int64)
            signs: list[bytes | None] = [None] * len(sets)
            if len(full):
                held = [sets[k] for k in full]
                flat, cut = np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
                for c in range(2):
                    names[full, c] = np.add.reduceat(mix(flat ^ _A[c]), cut).view(np.int64)
                for k, s in zip(full, signatures(held), strict=True):
                    signs[k] = s.tobytes()
            own = batch.slice(at, to - at)
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), own.column(3), pa.array(n), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(signs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["row", "id", "name", "n", "f1", "f2", "sig", "set"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("name"))
    return map_batches(rows, step, f"row long, id {kind}, name long, n long, f1 long, f2 long, sig binary, set binary")


def _keys(classes: DataFrame) -> DataFrame:
    """key, place of the key (chunk and left-out symbol), class, for all 32 keys of each class."""
    made = []
    for chunk in range(CHUNKS):
        for out in range(PER):
            at = 2 * PER * chunk
            parts = [F.substring("sig", at + 1, 2 * out), F.substring("sig", at + 2 * out + 3, 2 * (PER - 1 - out))]
            made.append(F.xxhash64(F.lit(chunk * PER + out), *parts))
    return classes.select("c", F.posexplode(F.array(*made)).alias("place", "key"))


def _near(distance_of: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, with n and signature of both) that can be similar: by size, then by distance of signatures."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not len(batch):
            return None
        both = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (2, 3)]
        return batch.select([0, 1]).filter(pa.array((both[0] != both[1]).sum(1) <= FAR))

    sized = distance_of.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    return map_batches(sized.select("a", "b", "sa", "sb"), step, "a long, b long")


def _confirm(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Pairs of classes whose whole sets are similar: u, v."""
    top, under = int(round(similarity * 100)), 100
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row"))
    sets = mark(signed.select("row", "set"), bit_map(wanted, "row"), "row").where("_marked").select("row", "set")
    joined = pairs.join(sets.select(F.col("row").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("row").alias("a"), F.col("set").alias("sa")), "a")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok, held = np.zeros(len(batch), bool), (None, None)
        for k in range(len(batch)):
            left, right = batch.column(2)[k].as_buffer(), batch.column(3)[k].as_buffer()
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")  # merges two sorted runs
            common = int((both[1:] == both[:-1]).sum())
            ok[k] = under * common >= top * (len(x) + len(y) - common)
        return batch.select([0, 1]).filter(pa.array(ok))

    return map_batches(joined.select(F.col("a").alias("u"), F.col("b").alias("v"), "sa", "sb"), step, "u long, v long")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of a stream that is sorted by its first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in cols)
        change[0] = last is not None and now != last
        last = tuple(c[-1] for c in cols)
        at = 0
        for cut in np.flatnonzero(change):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _open_rows(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of groups (key, place, c) that lie in more than one component, with comp, and the blocks that each goes to.

    Members of a group's largest component needn't meet each other: they have blocks of their own (0 to mains - 1), and
    only the others go to all blocks. So a group of one large component and a few strays is copied a few times at most."""
    labelled = keyed.join(found, keyed.c == found.id, "left").select("key", "place", "c", F.coalesce("component_id", "c").alias("comp"))
    each = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    spread = each.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m"), F.count("*").alias("comps")).where("comps > 1")
    blocks = spread.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("m") - F.col("top.n")) / BLOCK).cast("int").alias("others"))
    return materialise(labelled.join(blocks, "key").select("key", "place", "c", "comp", (F.col("comp") == F.col("main")).alias("main"), "mains", "others"))


def _outlines(open_: DataFrame, classes: DataFrame, signed: DataFrame) -> DataFrame:
    """n, signature and a bit map of the set for each class of the open rows."""
    wanted = open_.select("c").distinct()
    sets = mark(signed.select("row", "set"), bit_map(wanted, "c"), "row").where("_marked").select("row", "set")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        maps = []
        for k in range(len(batch)):
            flags = np.zeros(OUTLINE_BITS, np.uint8)
            flags[(np.frombuffer(batch.column(1)[k].as_buffer(), np.uint64) & np.uint64(OUTLINE_BITS - 1)).astype(np.int64)] = 1
            maps.append(np.packbits(flags).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["c", "outline"])

    drawn = map_batches(sets, step, "c long, outline binary")
    return materialise(drawn.join(wanted, "c", "left_semi").join(classes.select("c", "n", "sig"), "c"))


def _across(open_: DataFrame, outlines: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs of classes under one key in different components that can be similar; with ``nearest``, for each class and block only the one of the nearest signature.

    Each element that one outline has and the other lacks is missing from the other set, so the outlines bound the common
    part from above: no similar pair is left out by them."""
    number = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    last = F.col("mains") + F.col("others") - 1
    meets = F.when(F.col("main"), F.sequence("mains", last)).otherwise(F.sequence(F.lit(0), last))
    dealt = open_.join(outlines, "c").withColumn("mine", F.when(F.col("main"), number("mains")).otherwise(F.col("mains") + number("others"))).withColumn("other", F.explode(meets))
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "place", "c", "comp", "n", "sig", "outline")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    share = similarity / (1 + similarity) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        size = 0
        for group in _grouped(batches, 3):
            x, y, mine, place, c, comp, n = (np.asarray(group.column(k)) for k in range(1, 8))
            sig = np.frombuffer(b"".join(group.column(8).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            outline = np.frombuffer(b"".join(group.column(9).to_pylist()), np.uint64).reshape(len(c), -1)
            one = x[0] == y[0]
            left, right = (np.arange(len(c)),) * 2 if one else (np.flatnonzero(mine == x[0]), np.flatnonzero(mine == y[0]))
            for k in left:
                to = right if nearest or not one else right[right > k]
                to = to[(comp[to] != comp[k]) & (np.minimum(n[to], n[k]) >= similarity * np.maximum(n[to], n[k]))]
                if not len(to):
                    continue
                same = sig[to] == sig[k]
                lacks, extra = np.bitwise_count(outline[k] & ~outline[to]).sum(1, dtype=np.int64), np.bitwise_count(outline[to] & ~outline[k]).sum(1, dtype=np.int64)
                can = np.minimum(n[k] - lacks, n[to] - extra) >= share * (n[k] + n[to])
                to, same = to[can], same[can]
                if not len(to):
                    continue
                if nearest:
                    to = to[[int(same.sum(1).argmax())]]
                else:
                    agree = same.reshape(-1, CHUNKS, PER)
                    alone = (agree.sum(2)[:, :, None] - agree) == PER - 1  # keys that the two share
                    to = to[alone.reshape(-1, SYMBOLS).argmax(1) == place[0]]  # each pair only under its first key
                if len(to):
                    pairs.append(np.stack((np.minimum(c[k], c[to]), np.maximum(c[k], c[to]))))
                    size += len(to)
                if size >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(p) for p in np.concatenate(pairs, 1)], ["a", "b"])
                    pairs, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in np.concatenate(pairs, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.75) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept, row (a number for it), root (one for its component), name (hash of the text).

    Rows with equal sets are linked; so are those whose sets have at least ``similarity`` of their union in common.
    component_id is the smallest id in reach, kept whether the row's id is that. A text without words has an empty set
    and stays alone. Rows repeated under one id are one document; a row without an id belongs to its component, whose
    least id stands, and isn't kept (alone, its component_id is null). Other columns are not read."""
    signed = materialise(_signed(docs, id, text, size))
    classes = materialise(signed.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("row").alias("c"), F.min("id").alias("least"), F.min("sig").alias("sig")))
    keyed = _keys(classes)
    groups = keyed.groupBy("key").agg(F.min("c").alias("hub"), F.count("*").alias("m")).where("m > 1")
    stars = keyed.join(groups, "key").where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"), "key")
    side = lambda s: classes.select(F.col("c").alias(s), F.col("n").alias("n" + s), F.col("sig").alias("s" + s))
    shared = materialise(keyed.join(groups.select("key"), "key", "left_semi"))
    pairs = materialise(_near(stars.select("a", "b").distinct().join(side("b"), "b").join(side("a"), "a"), similarity))
    links = materialise(_confirm(pairs, signed, similarity))
    found = components(links)
    open_ = _open_rows(shared, found)
    outlines = _outlines(open_, classes, signed)
    for _ in range(NEAREST_ROUNDS):
        more = materialise(_across(open_, outlines, similarity, True).distinct())
        again = materialise(_confirm(more, signed, similarity))
        pairs = pairs.unionByName(more)
        if again.isEmpty():
            break
        links = links.unionByName(again)
        found = components(links)
        open_ = _open_rows(open_.select("key", "place", "c"), found)
    rest = materialise(_across(open_, outlines, similarity, False).distinct().join(pairs, ["a", "b"], "left_anti"))
    again = materialise(_confirm(rest, signed, similarity))
    if not again.isEmpty():
        found = components(links.unionByName(again))
    placed = classes.join(found, classes.c == found.id, "left").select("f1", "f2", classes.n, "least", F.coalesce("component_id", "c").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(roots, "root").select("f1", "f2", "n", "component_id", "root")
    rows = signed.select("row", "id", "name", "n", "f1", "f2").join(of, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    kept = F.coalesce(F.col("id") == component, F.lit(False))
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "row", F.coalesce("root", "row").alias("root"), "name")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.75) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that of the least id (a null id comes last), one of repeated rows.

    Only rows that may have to go are shuffled; the others are told from them by a map of bits."""
    found = near_duplicates(docs, id, text, size, similarity).select(F.col(id).alias("_id"), F.col("name").alias("_name"), "row", "root")
    found = materialise(found)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "row")).alias("of")).select(F.col("of.row").alias("row"), F.lit(True).alias("stays"))
    judged = found.join(first, "row", "left").groupBy("_id", "_name").agg(F.coalesce(F.max("stays"), F.lit(False)).alias("_stays"), F.count("*").alias("times"))
    doubtful = materialise(judged.where("not _stays or times > 1").select("_id", "_name", "_stays"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id}`").alias("_own"), F.xxhash64(f"`{text}`").alias("_text"))
    marked = mark(named, bit_map(doubtful, "_id", "_name"), "_own", "_text")
    checked = marked.where("_marked").join(doubtful, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_name")), "left")
    clear = marked.where("not _marked").select("_doc").unionByName(checked.where("_stays is null").select("_doc"))
    return clear.unionByName(checked.where("_stays").dropDuplicates(["_own", "_text"]).select("_doc")).select("_doc.*")


def op9(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")

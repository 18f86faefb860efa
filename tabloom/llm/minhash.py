"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's signature has 32 symbols of 16 bits, the b-bit values of 32 min-hashes of its set of
word shingles; a pair of Jaccard similarity s disagrees in each symbol with probability 1 - s.  The
signature is cut into 8 chunks of 4 symbols.  Two signatures that differ in 15 symbols or fewer have,
by the pigeonhole principle, a chunk with one error at most, so both are found under the key of that
chunk without the symbol in error: every document is indexed under 8 x 4 such keys.  (A pair of
similarity 0.8 has no common key with probability 1e-6.)  Candidates are then confirmed on full sets.

A bucket of n documents is not expanded into pairs of rows.  Documents with equal sets are one class.
All members of a bucket also share its pivot, the class of the smallest id, so classes are grouped by pivot. The
Hamming distance of signatures comes first: a pair that differs in more than MOST_DISTANCE symbols is no candidate
(at similarity 0.8 that has probability 3e-8), and only members of candidate pairs have their sets read. Each group
compares its members with the pivot; only in groups that the links so far leave in several components, members
outside the pivot's component are compared with those inside and with each other, first by signature, then by set: in
blocks of a bounded size, by a matrix product of the block's incidence of shingles, of which only links between
different components leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.bytekit import LOWER, NOT_SPACE, mix, sequence_hash, word_hash, words
from tabloom.llm.common import components, cut, hot_keys, join_hot, partitions
from tabloom.llm.docmap import add_columns

CHUNKS, SYMBOLS = 8, 4
#: Members of a block, about, and their shingles.
BLOCK, BLOCK_SHINGLES = 384, 2_000_000
#: Symbols in which the signatures of a candidate pair differ, at most.
MOST_DISTANCE = 20

_seeds = np.random.default_rng(7919).integers(1, 2**63, (2, CHUNKS * SYMBOLS), dtype=np.uint64) | np.uint64(1)
#: A signature's chunks, each a number of four symbols of 16 bits.
CHUNK = [f"c{k}" for k in range(CHUNKS)]


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int, twice: bool = False) -> tuple[np.ndarray, ...]:
    """Sorted distinct shingle hashes of each document, joined, and the offsets of documents in them; with `twice` also a
    second, independent hash of each of these shingles."""
    data = LOWER[data]
    starts, ends, at = words(data, off, NOT_SPACE)
    count = np.diff(at)
    hashes = [word_hash(data, starts, ends, second) for second in (False, True)[: 1 + twice]]
    several = [sequence_hash(h, n) for h in hashes]
    sets: list[tuple[np.ndarray, ...]] = []
    for k in range(len(count)):
        if count[k] >= n:
            own = [s[at[k] : at[k + 1] - n + 1] for s in several]
        else:
            own = [sequence_hash(h[at[k] : at[k + 1]], int(count[k]))[: int(count[k] > 0)] for h in hashes]
        distinct, first = np.unique(own[0], return_index=True)
        sets.append((distinct, *(s[first] for s in own[1:])))
    joined = [np.concatenate([np.zeros(0, np.uint64), *(s[j] for s in sets)]) for j in range(len(hashes))]
    return joined[0], np.concatenate(([0], np.cumsum([len(s[0]) for s in sets]))).astype(np.int64), *joined[1:]


def signatures(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """An (n, 32) array of 16-bit symbols; rows of empty sets are 0."""
    out = np.zeros((len(off) - 1, CHUNKS * SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        for k in range(CHUNKS * SYMBOLS):
            x = (hashes ^ _seeds[0, k]) * _seeds[1, k]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
            out[some, k] = (mix(np.minimum.reduceat(x, off[some])) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


SKETCH = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("digest1", T.LongType()),
    T.StructField("digest2", T.LongType()),
    *(T.StructField(c, T.LongType()) for c in CHUNK),
]


def _sketch(n: int):
    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        hashes, at, second = shingle_sets(data, off, n, twice=True)
        symbols = signatures(hashes, at)
        # Digests of the whole set that don't depend on its order, of independent hashes of its shingles.
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h)))) for h in (hashes, second)]
        one, two = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
        return [pa.array(np.diff(at), pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), *(pa.array(np.ascontiguousarray(symbols).view(np.int64)[:, c]) for c in range(CHUNKS))]

    return kernel


def _full_set(n: int):
    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        hashes, at = shingle_sets(data, off, n)
        return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64), pa.int64()))]

    return kernel


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, id): each class under its keys, a chunk with one symbol left out each, and their number."""
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    keys = []
    for k, c in enumerate(CHUNK):
        x = F.col(c)
        for left_out in range(SYMBOLS):
            # The symbols above the one left out move down by one.
            above = F.shiftleft(F.shiftrightunsigned(x, 16 * (left_out + 1)), 16 * left_out) if left_out < SYMBOLS - 1 else F.lit(0).cast("long")
            rest = above.bitwiseOR(low(x, 16 * left_out)) if left_out else above
            keys.append(rest.bitwiseOR(F.lit((k * SYMBOLS + left_out) << 48)))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "id")


def symbols_apart(a: str, b: str) -> Column:
    """In how many symbols the signatures of columns a_c0, ... and b_c0, ... differ."""
    total = F.lit(0)
    for c in CHUNK:
        x = F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))
        for shift in (8, 4, 2, 1):  # the lowest bit of each symbol says whether any of its bits differs
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


LINK = "a long, b long"
#: Shingles that a matrix product takes at once.
_WIDTH = 8_192


def _common(shingles: np.ndarray, owner: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each of the sets `first` with each of `second`."""
    n = int(owner.max(initial=-1)) + 1
    _, number, count = np.unique(shingles, return_inverse=True, return_counts=True)
    several = count > 1
    renumber = np.cumsum(several) - 1
    keep = several[number]
    number, owner = renumber[number[keep]], owner[keep]
    by = np.argsort(number, kind="stable")
    number, owner = number[by], owner[by]
    out = np.zeros((len(first), len(second)), np.float32)
    for low in range(0, int(several.sum()), _WIDTH):
        at, end = np.searchsorted(number, (low, low + _WIDTH))
        incidence = np.zeros((n, min(_WIDTH, number[end - 1] - low + 1)), np.float32)
        incidence[owner[at:end], number[at:end] - low] = 1
        out += incidence[first] @ incidence[second].T
    return out.astype(np.int64)


def _compare(percent: int):
    """Links of a block: between its rows of side 0 and of side 1, or, without the former, among all. Of
    the links between two components one is enough."""

    def block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, ids, component = (table.column(c).to_numpy() for c in ("side", "id", "component"))
        lists = pa.concat_arrays(table.column("shingles").chunks)
        size = lists.value_lengths().to_numpy()
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        first = first if len(first) else second
        common = _common(lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), size), first, second)
        linked = 100 * common >= percent * (size[first][:, None] + size[second] - common)
        x, y = np.nonzero(linked & (component[first][:, None] != component[second]))
        x, y = first[x], second[y]
        pairs = np.stack([np.minimum(component[x], component[y]), np.maximum(component[x], component[y])])
        _, one = np.unique(pairs, axis=1, return_index=True)
        return pa.table([pa.array(ids[x[one]], pa.int64()), pa.array(ids[y[one]], pa.int64())], names=["a", "b"])

    return block


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the blocks (pivot, i, j) of members, which have side, id and component."""
    dealt = members.join(sets, "id").select("pivot", "i", "j", "side", "id", "component", "shingles")
    return dealt.groupBy("pivot", "i", "j").applyInArrow(_compare(percent), LINK)


def _near(table: pa.Table) -> pa.Table:
    """Of a block, the members with a candidate partner in another component: between sides 0 and 1, or among all."""
    side, ids, component = (table.column(c).to_numpy() for c in ("side", "id", "component"))
    symbols = np.ascontiguousarray(np.stack([table.column(c).to_numpy() for c in CHUNK], axis=1)).view(np.uint16)
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    first = first if len(first) else second
    apart = np.zeros((len(first), len(second)), np.int16)
    for s in range(symbols.shape[1]):
        apart += symbols[first, s][:, None] != symbols[second, s]
    near = (apart <= MOST_DISTANCE) & (component[first][:, None] != component[second])
    found = np.unique(np.concatenate((ids[first[near.any(axis=1)]], ids[second[near.any(axis=0)]])))
    return pa.table([pa.array(np.full(len(found), table.column("pivot")[0].as_py()), pa.int64()), pa.array(found, pa.int64())], names=["pivot", "id"])


def _parts(count: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(count / F.lit(BLOCK), shingles / F.lit(BLOCK_SHINGLES))).cast("long")


def star_blocks(groups: DataFrame, hot: list) -> DataFrame:
    """Of (pivot, id, n_shingles), blocks of members (side 1) with their pivot (side 0)."""
    parts = groups.groupBy("pivot").agg(_parts(F.count("*"), F.sum("n_shingles")).alias("parts"))
    members = join_hot(groups.select("pivot", "id"), parts, "pivot", hot).select("pivot", F.pmod(F.xxhash64("id"), F.col("parts")).alias("i"), F.lit(1).alias("side"), "id")
    pivots = parts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.lit(0).alias("side"), F.col("pivot").alias("id"))
    return members.union(pivots).select("pivot", "i", F.lit(0).alias("j"), "side", "id", F.col("id").alias("component"))


def in_components(pairs: DataFrame, found: DataFrame, hot: list) -> DataFrame:
    """Of pairs (pivot, id, with n_shingles and signatures of both) all members and pivots of each group, with their component
    and inside, whether it is the pivot's."""
    of = found.select("id", "component")
    pivots = pairs.select("pivot", F.col("pivot").alias("id"), F.col("pn").alias("n_shingles"), *(F.col(f"p{c}").alias(c) for c in CHUNK)).distinct()
    both = pairs.select("pivot", "id", "n_shingles", *CHUNK).union(pivots).join(of, "id", "left")
    both = join_hot(both, of.select(F.col("id").alias("pivot"), F.col("component").alias("home")), "pivot", hot, "left")
    component = F.coalesce("component", "id")
    return cut(both.select("pivot", "id", "n_shingles", *CHUNK, component.alias("component"), (component == F.coalesce("home", "pivot")).alias("inside")))


def crossing_blocks(both: DataFrame, hot: list, by_size: bool) -> DataFrame:
    """Of in_components, the pairs of blocks that show every pair of members of which one at least is outside the
    pivot's component.  Blocks of the pivot's component are 0, 1, ..., those of others -1, -2, ...; a pair of blocks is
    dealt to every member of both. With by_size blocks are bounded in shingles too."""
    inside = F.col("inside")
    weight = F.col("n_shingles") if by_size else F.lit(0)
    parts = [_parts(F.count_if(x), F.coalesce(F.sum(F.when(x, weight)), F.lit(0))).alias(n) for x, n in ((inside, "ins"), (~inside, "outs"))]
    counts = both.groupBy("pivot").agg(*parts, F.count("*").alias("n")).where("outs > 0 and n > 1").drop("n")
    rows = join_hot(both, counts, "pivot", hot)
    mine = F.when(inside, F.pmod(F.xxhash64("id"), F.col("ins"))).otherwise(-1 - F.pmod(F.xxhash64("id"), F.col("outs")))
    rows = rows.withColumn("mine", mine)
    outer = F.sequence(-F.col("outs"), F.lit(-1).cast("long"))
    within = F.when(F.col("ins") > 0, F.sequence(F.lit(0).cast("long"), F.col("ins") - 1)).otherwise(F.array().cast("array<long>"))
    others = F.when(inside, outer).otherwise(F.concat(outer, within))
    rows = rows.select("pivot", "id", "component", *CHUNK, "mine", F.explode(others).alias("other"))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when((F.col("mine") == i), 1).otherwise(0)  # a block with itself has side 1 only
    return rows.select("pivot", i.alias("i"), j.alias("j"), side.alias("side"), "id", "component", *CHUNK)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Words are the runs of characters other than ASCII white space, with A-Z lower-cased; a document's
    set is its distinct runs of n words, or the whole sequence if it has fewer. Documents whose sets
    have intersection / union >= percent / 100 are linked; component_id is the smallest doc_id
    reachable over links, and kept tells whether it is the row's own. Null and empty texts and texts
    without words have no shingles and are linked with nothing. A row without doc_id has the component
    of the documents with the very same set, or null (kept true) if there is none with an id, and makes no links. Rows that
    share a doc_id are one document, with all links of both. An empty table gives no rows; other
    columns aren't read.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = cut(add_columns(texts, _sketch(n), SKETCH, drop=("text",)))
    same = ["n_shingles", "digest1", "digest2"]
    known = rows.where("n_shingles > 0 and id is not null")
    classes = cut(known.groupBy(*same).agg(F.min("id").alias("id"), *(F.min(c).alias(c) for c in CHUNK)))  # equal sets, equal signatures

    keys = index_keys(classes)
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("n")).where("pivot < last")
    shared = cut(shared.select("key", "pivot", "n"))
    crowded = hot_keys(shared, "key", "n", shared.agg(F.sum("n")).first()[0] or 0)
    groups = cut(join_hot(keys, shared.select("key", "pivot"), "key", crowded).where("pivot < id").select("pivot", "id").distinct())
    sizes = groups.groupBy("pivot").count()
    hot = hot_keys(sizes, "pivot", "count", groups.count())
    # Members with their own signature, and with that of their pivot.
    signed = classes.select("id", "n_shingles", *CHUNK)
    heads = signed.select(F.col("id").alias("pivot"), F.col("n_shingles").alias("pn"), *(F.col(c).alias(f"p{c}") for c in CHUNK))
    pairs = cut(join_hot(groups.join(signed, "id"), heads, "pivot", hot))
    near = pairs.where(symbols_apart("", "p") <= MOST_DISTANCE).groupBy("pivot", "id").agg(F.max("n_shingles").alias("n_shingles"))
    star = star_blocks(cut(near), hot)

    field = T.StructField("shingles", T.ArrayType(T.LongType()))

    def sets_of(ids: DataFrame) -> DataFrame:
        return cut(add_columns(texts.join(ids.distinct(), "id", "left_semi"), _full_set(n), [field], "text", drop=("text",)).where("size(shingles) > 0"))

    links = cut(_links(star, sets_of(star.select("id")), percent))
    found = components(links)
    both = in_components(pairs, found, hot)
    blocks = crossing_blocks(both, hot, by_size=False)
    # A block is few bytes and much work: one task for each shuffle partition, not for so many megabytes.
    blocks = blocks.repartition(partitions(blocks.sparkSession), "pivot", "i", "j")
    near = cut(blocks.groupBy("pivot", "i", "j").applyInArrow(_near, "pivot long, id long").distinct())
    if not near.isEmpty():
        # Only members with a candidate partner go on to the comparison of sets.
        left = crossing_blocks(both.join(near, ["pivot", "id"], "left_semi"), hot, by_size=True)
        more = cut(_links(left, sets_of(near.select("id")), percent))
        if not more.isEmpty():
            found = components(links.union(more))

    named = classes.join(found, "id", "left").select(*same, F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", *same).join(named, same, "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs, with their columns, without the documents that another one of their component stands for. Rows without doc_id
    and rows without words stay; rows that share a doc_id stay or go together, and an empty table gives none."""
    gone = near_duplicates(docs, n, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

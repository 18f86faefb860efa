"""Made rows for the smaller classes, each between a row and one of the nearest rows of its class.

Neighbours are looked for along PROJECTIONS random directions: the rows of a class are put in order along each, and each
row is measured against the SIDE rows before and after it, wherever the order is cut for the tasks. So the work grows with the rows, not with their square. In a
class of SIDE + 1 rows or fewer every row meets every other, and the nearest are exact; in larger classes they are the
nearest of those met."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import shuffle_key
from tabloom.operators.ranges import running, with_range
from tabloom.operators.split import SEED, position

NEAREST = 5
PROJECTIONS, SIDE = 4, 64
#: Rows of a stretch of the order, and rows that are measured at once: so few that their distances stay in a core's cache.
TASK_ROWS, ROWS = 20_000, 1_000


def directions(features: int) -> np.ndarray:
    """(PROJECTIONS, features); one is enough for a single feature."""
    return np.ones((1, 1)) if features == 1 else np.random.default_rng(SEED).normal(size=(PROJECTIONS, features))


def _first(near: np.ndarray, who: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Columns of the k smallest of each row of near, ties to the smaller who(rows, columns): of a few that are partitioned off, of all columns
    where a tie may go beyond these."""
    rows, few = np.arange(len(near))[:, None], min(2 * k + 6, near.shape[1])
    some = np.argpartition(near, few - 1, axis=1)[:, :few]
    by = near[rows, some]
    best = np.take_along_axis(some, np.lexsort((who(rows, some), by), axis=1)[:, :k], axis=1)
    last = near[rows[:, 0], best[:, -1]]
    tied = np.flatnonzero((last == by.max(axis=1)) & np.isfinite(last))
    best[tied] = np.lexsort((who(tied[:, None], np.arange(near.shape[1])[None, :]), near[tied]), axis=1)[:, :k]
    return best


def _met(group: np.ndarray, x: np.ndarray, pos: np.ndarray, old: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many each row has, others' pos, squared distances) of the k nearest that each row meets within SIDE places, where one of
    the two is not among the first `old` rows, which have met."""
    n = len(x)
    near = np.full((n, 2 * SIDE), np.inf)
    for o in range(1, min(SIDE, n - 1) + 1):
        at = max(0, old - o)
        apart = ((x[at : n - o] - x[at + o :]) ** 2).sum(axis=1)
        apart[group[at : n - o] != group[at + o :]] = np.inf
        near[at : n - o, o - 1] = near[at + o :, SIDE + o - 1] = apart
    away = np.concatenate((np.arange(1, SIDE + 1), -np.arange(1, SIDE + 1)))
    who = lambda rows, columns: pos[np.clip(rows + away[columns], 0, n - 1)]
    best = _first(near, who, k)
    rows = np.arange(n)[:, None]
    real = np.isfinite(near[rows, best])
    return real.sum(axis=1), who(rows, best)[real], near[rows, best][real]


def _neighbours(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last SIDE rows
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                fresh = whole.slice(at, ROWS)
                table = pa.Table.from_batches([*held, fresh]).combine_chunks()
                group = table.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
                x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
                sizes, other, apart = _met(group, x, table.column("pos").to_numpy(), table.num_rows - fresh.num_rows, k)
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                found = table.select(["class", "pos"]).take(row).append_column("other", pa.array(other, pa.int64())).append_column("apart", pa.array(apart))
                yield from found.combine_chunks().to_batches()
                held = table.slice(max(0, table.num_rows - SIDE)).to_batches()

    return run


def nearest(rows: DataFrame, features: list[str], k: int = NEAREST) -> DataFrame:
    """(class, pos, others): of each row (class, pos, features), pos being unique in a class, the pos of its k nearest of
    its class, nearest first, ties to the smaller pos. Features are known and finite numbers."""
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in features))
    along = [sum((F.col("x")[i] * float(w) for i, w in enumerate(d)), F.lit(0.0)) for d in directions(len(features))]
    placed = rows.select("class", "pos", x.alias("x")).select("class", "pos", "x", F.posexplode(F.array(*along)).alias("direction", "at"))
    # The place of each row in the order of its direction and class, by ranges of the projection; equal ones by pos, in buckets.
    placed = with_range(placed, "at", "_b").withColumn("_pb", F.floor(F.col("pos") / TASK_ROWS))
    cells = placed.groupBy("direction", "class", "_b", "at", "_pb").agg(F.count("*").alias("n"))
    before = running(cells, ["at", "_pb"], ["n"], ["direction", "class"]).select("direction", "class", "at", "_pb", (F.col("upto_n") - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("direction", "class", "at", "_pb").orderBy("pos"))
    ordered = placed.withColumn("inside", inside).join(before, ["direction", "class", "at", "_pb"]).withColumn("place", F.col("before") + F.col("inside") - 1)
    # Stretches of TASK_ROWS places, each with the SIDE places before and behind it, so every row meets the same rows in any of them.
    stretch, within = F.floor(F.col("place") / TASK_ROWS), F.col("place") % TASK_ROWS
    each = F.array(stretch, F.when((within < SIDE) & (stretch > 0), stretch - 1), F.when(within >= TASK_ROWS - SIDE, stretch + 1))
    dealt = ordered.withColumn("stretch", F.explode(F.array_compact(each)))
    key = ["direction", "class", "stretch"]
    sorted_ = dealt.repartition(*key).sortWithinPartitions(*key, "place").select(F.concat_ws("|", *key).alias("group"), "class", "pos", "x")
    kind = T.StructType([rows.schema["class"], T.StructField("pos", T.LongType()), T.StructField("other", T.LongType()), T.StructField("apart", T.DoubleType())])
    found = sorted_.mapInArrow(_neighbours(k), kind).groupBy("class", "pos").agg(F.array_sort(F.collect_set(F.struct("apart", "other"))).alias("met"))
    return found.select("class", "pos", F.slice(F.col("met.other"), 1, k).alias("others"))


def smote(df: DataFrame, y: str, key: str, features: list[str], k: int = NEAREST) -> DataFrame:
    """df, and made rows that bring each class to the size of the largest; of those only y and the features are known, and
    the column _made is true. Rows of a class serve as bases in turns; the neighbour and how far to go towards it come from a
    digest of the key, which tells rows apart. Of whole-numbered features the fraction goes.

    Where a class has a single row, or a feature is no number, null or not finite, nothing is made. Rows without class stay
    and count for nothing."""
    kinds = {f.name: f.dataType for f in df.schema}
    plain = df.withColumn("_made", F.lit(False))
    known = df.where(F.col(f"`{y}`").isNotNull())
    sizes = known.groupBy(F.col(f"`{y}`").alias("class")).agg(F.count("*").alias("size"))
    facts = sizes.agg(F.min("size"), F.max("size"), F.sum("size")).first()
    if not features or not all(isinstance(kinds[c], (T.NumericType, T.BooleanType)) for c in features) or not facts[0] or facts[0] <= 1:
        return plain
    value = lambda c: F.col(f"`{c}`").cast("double")
    odd = [value(c).isNull() | F.isnan(value(c)) | (F.abs(value(c)) == float("inf")) for c in features]
    if known.where(F.exists(F.array(*odd), lambda x: x)).limit(1).count():
        return plain
    k = max(1, min(k, facts[0] - 1))
    taken = known.select(F.col(f"`{y}`").alias("class"), F.col(f"`{key}`").alias("key"), *(value(c).alias(f"_{i}") for i, c in enumerate(features)))
    names = [f"_{i}" for i in range(len(features))]
    rows = position(taken, "key", ["class"]).where(F.col("n") < facts[1]).select("class", F.col("pos").cast("long").alias("pos"), "n", "key", *names)
    near = nearest(rows, names, k)
    more = F.lit(facts[1]) - F.col("n")
    copies = (F.floor(more / F.col("n")) + (F.col("pos") <= more % F.col("n")).cast("long")).cast("long")
    bases = rows.join(near, ["class", "pos"]).where(copies > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("turn"))
    digest = shuffle_key(F.concat(F.col("key").cast("string"), F.lit("|"), F.col("turn").cast("string")), SEED)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    bases = bases.withColumns({"other": F.col("others")[(part(1) % F.size("others")).cast("int")], "step": part(9) / F.lit(float(2**32))})
    ends = rows.select("class", F.col("pos").alias("other"), *(F.col(n).alias(f"to{n}") for n in names))
    between = {c: F.col(n) + F.col("step") * (F.col(f"to{n}") - F.col(n)) for c, n in zip(features, names, strict=True)}
    made = bases.join(ends, ["class", "other"])
    columns = {c: between[c].cast(kinds[c]) for c in features} | {y: F.col("class")}
    return plain.unionByName(made.select(*(columns.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns), F.lit(True).alias("_made")))

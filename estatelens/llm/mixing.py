"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in an order by hash, form blocks of ``block`` documents. With weight w its i-th block (from 0) is
released at slot floor(i / w) and due at slot ceil((i + 1) / w). At every slot, of the released blocks the one with the
earliest deadline goes next; so, in every prefix, each source is less than one block from its share. Weights are the exact
fractions that floats are; nothing is rounded. Every document is placed once: when a source runs out, the others go on at
their weights' ratio, in a new phase.

So that no machine works out the whole schedule, a phase is cut into epochs of ``EPOCH`` slots, or of the longest window if
that is more, so that no window holds two cuts. How many blocks of each source go before a cut follows from the weights alone
(``boundary``): all that are due, and of those whose window holds the cut as many as there are slots, chosen so that the
windows on both sides can still be met. Each epoch is then scheduled by itself, earliest deadline first, on the executors.
The driver works out only where a phase ends: from the epoch on in which some source's last block is released. It holds two
numbers for each source and phase.

Rows get their numbers within a source from counts in hash buckets and places within a bucket, so a source with a third of
all rows is spread over all tasks, and a document's place is the same however rows are partitioned. Whole rows are shuffled
once, by bucket; the bucket's part of the schedule joins them there. Buckets are cut by rows and by bytes, so that tasks get
equal shares, of long texts as well. Nothing is broadcast but the sources' names and weights.

Edge cases: a null source is a source of its own. A source without a weight, or with one that isn't positive, goes last, in
phases of its own at equal weights. Rows that repeat are placed each; rows of a null or repeated id are ordered by their
other columns. Texts aren't looked into, however long. An empty table gives an empty result. Result columns replace columns
of the same name. The number of sources has no limit.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BLOCK, EPOCH = 16, 4096
#: Epochs of a task, about: some hundred thousand slots.
TASK_EPOCHS = 64
#: Rows of a bucket and their bytes, at most on average, in every source; buckets are named by the first hexadecimal digits of the
#: rows' hashes. A task sorts and writes whole buckets, and there are few of them if they are large.
BUCKET_ROWS, BUCKET_BYTES = 512, 1 << 20
#: Without weights given, a source's is so many times the root of its count, as a whole number.
SCALE = 1_000_000
RESULTS = ("block_no", "phase", "released", "due", "slot", "position")
PLAN = "__mix_source string, block_no long, phase int, released long, due long, slot long, position long"


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """The positive weights, as the fractions that floats are, as whole numbers in the same ratio."""
    parts = {k: Fraction(w) for k, w in weights.items() if w > 0}
    common = math.lcm(*(x.denominator for x in parts.values()))
    return {k: int(x * common) for k, x in parts.items()}


def window(i: int, share: int, total: int) -> tuple[int, int]:
    """The slots at which the i-th block of a source is released and due."""
    return i * total // share, -(-(i + 1) * total // share)


def boundary(shares: list[int], total: int, t: int) -> list[int]:
    """How many blocks of each source go before slot ``t``, in sum ``t``.

    Blocks due by then do. Those whose window holds the cut are owed a part of a block each; going through them as they were
    released, the one due first goes whenever the parts so far make another whole. Then for every earlier slot no more were
    left over, and for every later one no more were preferred, than there are slots for.
    """
    done, torn = [], []
    for j, n in enumerate(shares):
        i, part = divmod(n * t, total)
        done.append(i)
        if part:
            torn.append((*window(i, n, total), j, part))
    owed = taken = 0
    open_: list[tuple[int, int]] = []
    for _, due, j, part in sorted(torn, key=lambda x: (x[0], x[2])):
        owed += part
        heapq.heappush(open_, (due, j))
        if owed // total > taken:
            done[heapq.heappop(open_)[1]] += 1
            taken += 1
    return done


def turns(shares: list[int], total: int, begin: list[int], end: list[int] | None, start: int, stop: int | None) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, released, due) of the slots from ``start`` on, earliest deadline first, then by source.

    ``begin`` blocks have gone before. With ``end``, the blocks up to it have the slots before ``stop``; without, there is no end.
    """
    waiting: list[tuple] = []
    ready: list[tuple] = []

    def add(j: int, i: int) -> None:
        if end is None or i < end[j]:
            released, due = window(i, shares[j], total)
            heapq.heappush(waiting, (max(released, start), due if stop is None else min(due, stop), due, j, i, released))

    for j, i in enumerate(begin):
        add(j, i)
    for slot in count(start) if stop is None else range(start, stop):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, due, j, i, released = heapq.heappop(ready)
        yield j, i, released, due
        add(j, i + 1)


def epoch_size(shares: list[int], total: int, least: int = EPOCH) -> int:
    """Slots of an epoch: no window is longer."""
    return max(least, -(-total // min(shares)) + 1)


def epoch_turns(shares: list[int], total: int, epoch: int, epochs: int, length: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """``turns`` of one epoch of a phase of ``length`` slots; the last, from ``epochs`` on, goes on to the phase's end."""
    start = epoch * size
    begin = boundary(shares, total, start)
    if epoch < epochs:
        return turns(shares, total, begin, boundary(shares, total, start + size), start, start + size)
    return islice(turns(shares, total, begin, None, start, None), length - start)


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], least: int = EPOCH) -> Iterator[tuple[list[str], list[int], list[int], int, int, str]]:
    """(sources, shares, blocks gone before, whole epochs, slots, the source that ends) of each phase; one ends with the slot in which a source's last block goes."""
    whole = exact({k: w for k, w in weights.items() if k in blocks})
    gone = {k: 0 for k, n in sorted(blocks.items()) if n}
    while gone:
        names = [k for k in gone if k in whole] or list(gone)
        shares = [whole.get(k, 1) for k in names]
        total, left = sum(shares), [blocks[k] - gone[k] for k in names]
        size = epoch_size(shares, total, least)
        epochs = min((m - 1) * total // n for m, n in zip(left, shares)) // size
        done = boundary(shares, total, epochs * size)
        slot = epochs * size
        for j, i, _, _ in turns(shares, total, done[:], None, slot, None):
            slot += 1
            done[j] = i + 1
            if i + 1 == left[j]:
                break
        yield names, shares, [gone[k] for k in names], epochs, slot, names[j]
        gone |= {k: gone[k] + n for k, n in zip(names, done)}
        gone = {k: n for k, n in gone.items() if n < blocks[k]}


def plan(spark: SparkSession, counts: Mapping[str, int], weights: Mapping[str, float], block: int) -> DataFrame:
    """A row a block: its source and number, phase, released and due (slots in the phase), slot, and the position of its first document."""
    names = sorted(counts)
    at = {k: i for i, k in enumerate(names)}
    whole = exact({k: w for k, w in weights.items() if k in counts})
    shared = spark.sparkContext.broadcast((names, whole))
    rows, start, position = [], 0, 0
    for phase, (active, _, before, epochs, length, ended) in enumerate(phases({k: -(-n // block) for k, n in counts.items()}, weights)):
        rows.append((phase, start, position, epochs, length, pa.array([at[k] for k in active], pa.int32()), pa.array(before, pa.int64())))
        start += length
        # only the block that ends a source, in the phase's last slot, can be short
        position += length * block - -counts[ended] % block
    fields = [("phase", pa.int32()), ("start", pa.int64()), ("position", pa.int64()), ("epochs", pa.int64()), ("length", pa.int64()), ("sources", pa.list_(pa.int32())), ("before", pa.list_(pa.int64()))]
    table_ = pa.table([pa.array([r[i] for r in rows], t) if i < 5 else pa.array([r[i].to_pylist() for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_names, own_whole = shared.value
        for b in batches:
            for r in b.to_pylist():
                active = [own_names[i] for i in r["sources"]]
                shares = [own_whole.get(k, 1) for k in active]
                size = epoch_size(shares, sum(shares))
                slot = r["epoch"] * size
                found = epoch_turns(shares, sum(shares), r["epoch"], r["epochs"], r["length"], size)
                while part := list(islice(found, EPOCH)):
                    js, blocks_, released, due = zip(*part)
                    here = range(slot, slot + len(part))
                    slot += len(part)
                    columns = ([active[j] for j in js], [r["before"][j] + i for j, i in zip(js, blocks_)], [r["phase"]] * len(part), released, [min(x, (1 << 63) - 1) for x in due], [r["start"] + t for t in here], [r["position"] + t * block for t in here])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4))], names=[x.split()[0] for x in PLAN.split(", ")])

    tasks = spark.createDataFrame(table_).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "epochs")))
    n_epochs = sum(r[3] + 1 for r in rows)
    # by number, as rows this small would otherwise be put together in one task, however long they take
    n = max(1, min(n_epochs, max(spark.sparkContext.defaultParallelism, n_epochs // TASK_EPOCHS)))
    return tasks.repartition(n, "phase", "epoch").mapInArrow(work, PLAN)


def bucket_digits(sources: Iterable[tuple[int, int]]) -> int:
    """The least number of digits, one at least, that cuts sources of so many (rows, bytes) as finely as ``BUCKET_ROWS`` and ``BUCKET_BYTES`` say."""
    digits = 1
    for n, size in sources:
        while min(n, max(-(-n // BUCKET_ROWS), -(-size // BUCKET_BYTES))) > 16**digits:
            digits += 1
    return digits


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", power: float = 0.5) -> DataFrame:
    """``docs`` with each row's block_no in its source, phase, released and due (slots in the phase), slot and position (0, 1, ...) in the mixture.

    ``weights`` are relative. Without them they are ``SCALE`` times the sources' counts to the ``power``, rounded down, which lifts small sources.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS and c not in (id_col, source_col)])
    kinds = dict(docs.dtypes)
    # a null source gets a name that no other has
    rows = docs.withColumn("__mix_source", F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null")))
    # the order in a source is that of the rows' digests, whose first digits name the bucket: buckets in order hold the rows in order
    others = [c for c in docs.columns if c not in (id_col, source_col) and kinds[c] in ("string", "bigint", "int", "double", "boolean")]
    own = F.md5(F.concat_ws("\n", *(F.col(f"`{c}`").cast("string") for c in (id_col, source_col, *others))))
    wide = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c in docs.columns if kinds[c] in ("string", "binary")]
    by_source = rows.groupBy("__mix_source").agg(F.count("*").alias("n"), F.sum(sum(wide, F.lit(0).cast("long"))).alias("size")).collect()  # a row a source
    counts = {r["__mix_source"]: r["n"] for r in by_source}
    digits = bucket_digits((r["n"], r["size"]) for r in by_source)
    rows = rows.withColumn("__mix_hash", own).withColumn("__mix_bucket", F.substring("__mix_hash", 1, digits))
    if weights is None:
        named = {k: max(1, int(SCALE * (math.sqrt(n) if power == 0.5 else n**power))) for k, n in counts.items()}
    else:
        named = {("null" if k is None else f"s:{k}"): w for k, w in weights.items()}
    sizes = rows.groupBy("__mix_source", "__mix_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__mix_source").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.withColumn("__mix_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the schedule of the blocks that a bucket's rows are in, in order
    touched = spans.withColumn("block_no", F.explode(F.expr(f"sequence(__mix_offset div {block}, (__mix_offset + n - 1) div {block})")))
    fields = ("block_no", "phase", "released", "due", "slot", "position")
    steps = touched.join(plan(docs.sparkSession, counts, named, block), ["__mix_source", "block_no"])
    steps = cut(steps.groupBy("__mix_source", "__mix_bucket").agg(F.min("__mix_offset").alias("__mix_offset"), F.sort_array(F.collect_list(F.struct(*fields))).alias("__mix_steps")))
    within = Window.partitionBy("__mix_source", "__mix_bucket").orderBy("__mix_hash", id_col, *others)
    placed = rows.withColumn("__mix_n", F.row_number().over(within) - 1).join(steps, ["__mix_source", "__mix_bucket"]).withColumn("__mix_k", F.col("__mix_offset") + F.col("__mix_n"))
    placed = placed.withColumn("__mix_step", F.expr(f"get(__mix_steps, CAST(__mix_k div {block} - __mix_offset div {block} AS INT))"))
    out = placed.withColumns({k: F.col(f"__mix_step.{k}") for k in RESULTS} | {"position": F.col("__mix_step.position") + F.col("__mix_k") % block})
    return out.select(*docs.columns, *RESULTS)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def oracle_op1() -> str:
    """SQL of the query: the schedule slot by slot, on lists that hold a value for each source, in order of name. It cuts no phase, so it holds up to ``EPOCH`` blocks a phase."""
    b = BLOCK
    active = "list_filter(range(1, len(lf) + 1), lambda j: lf[j] > 0)"
    total = "list_sum(list_transform(" + active + ", lambda j: w[j]))"
    pick = f"list_sort(list_transform(list_filter({active}, lambda j: done[j] * tt // w[j] <= slot - start), lambda j: {{'d': ((done[j] + 1) * tt + w[j] - 1) // w[j], 'j': j}}))[1]"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY md5(concat_ws(chr(10), CAST(doc_id AS VARCHAR), source)), doc_id) - 1 AS k
  FROM (SELECT doc_id, source, coalesce('s:' || source, 'null') AS s FROM documents)
), src AS (SELECT s, (count(*) + {b - 1}) // {b} AS b, greatest(1, CAST(floor({SCALE} * sqrt(count(*))) AS BIGINT)) AS w FROM d GROUP BY s),
init AS (SELECT list(s ORDER BY s) AS names, list(b ORDER BY s) AS lf, list(w ORDER BY s) AS w FROM src),
sim AS (
  SELECT CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS start, names, lf AS b, w, lf, CAST(list_transform(lf, lambda x: 0) AS BIGINT[]) AS done, CAST({total} AS BIGINT) AS tt,
    CAST(NULL AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS block_no, CAST(NULL AS BIGINT) AS released, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS ph FROM init WHERE len(lf) > 0
  UNION ALL
  SELECT slot + 1, CASE WHEN ended THEN phase + 1 ELSE phase END, CASE WHEN ended THEN slot + 1 ELSE start END, names, b, w, lf2, CASE WHEN ended THEN list_transform(done2, lambda x: CAST(0 AS BIGINT)) ELSE done2 END,
    CAST({total.replace("lf", "lf2")} AS BIGINT), names[p.j], b[p.j] - lf[p.j], done[p.j] * tt // w[p.j], p.d, slot, phase
  FROM (SELECT *, lf[p.j] = 1 AS ended, list_transform(range(1, len(lf) + 1), lambda j: lf[j] - CAST(j = p.j AS BIGINT)) AS lf2, list_transform(range(1, len(lf) + 1), lambda j: done[j] + CAST(j = p.j AS BIGINT)) AS done2
    FROM (SELECT slot, phase, start, names, b, w, lf, done, tt, {pick} AS p FROM sim WHERE list_sum(lf) > 0))
)
SELECT doc_id, source, d.k // {b} AS block_no, CAST(ph AS INT) AS phase, released, sim.due, turn AS slot, row_number() OVER (ORDER BY turn, k) - 1 AS position
FROM d JOIN sim ON d.s = sim.s AND d.k // {b} = sim.block_no
"""

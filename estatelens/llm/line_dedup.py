"""Line dedup: a sharded minimal perfect hash over repeated line keys, probed by the documents.

A line's key is the line without surrounding ASCII white space and with A-Z lower-cased. Keys of at least ``min_chars``
code points found in at least ``min_docs`` documents lose all their lines except in the document with the largest id.

1. One Arrow pass gives each document's distinct eligible keys as 128-bit hashes. A grouped count with map-side combine
   gives each hash its document count and largest id; a line that a third of all documents hold is combined before the shuffle.
2. Hashes of lines in two documents or more (no other line can go) are dealt to shards by their bits. Each shard builds a
   minimal perfect hash of its own (buckets by one half of the hash, a displacement for each bucket, placed largest first) and
   lays fingerprint, count and largest id out in arrays that the hash indexes. Of keys that share that half all but one are
   listed beside the arrays.
3. The arrays, in blocks of a checked size, go to the executors, and the documents probe them in a narrow pass, which applies
   ``min_docs`` to the counts: no line is joined. Only an index of more than ``MOST_BLOCKS`` blocks stays where it is, and the probes go to its shards.

Edge cases: null or empty text is one empty line. Texts are split whole, however long. A null id counts as a document and as the smallest id. Rows that repeat
a doc_id count as documents each; those with the largest id all keep their lines. An empty table gives an empty result.
Other columns pass through, except that result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, arrow_limits, blocks, byte_texts, cut, table

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard on average.
SHARD_KEYS = 20_000
#: Blocks of the index that are sent to the tasks at most, and probes of a group beyond that.
MOST_BLOCKS, PROBES = 8, 1_000_000
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def eligible(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def key_hash(key: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves: the first places the key, the second is its fingerprint."""
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (h1, h2, n_docs, last_id) of the keys in at least ``min_docs`` documents."""
    arrow_limits(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h1, h2 = [], [], []
            for i, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                if not t:
                    continue
                i = NO_ID if i is None else i
                for key in {line_key(x) for x in t.split(b"\n")}:
                    if eligible(key, min_chars):
                        x, y = key_hash(key)
                        ids.append(i)
                        h1.append(x)
                        h2.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h1, h2, ids)], names=["h1", "h2", "id"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(keys, "h1 long, h2 long, id long")
    return found.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id")).where(F.col("n_docs") >= min_docs)


def spread(x: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mix of the unsigned hashes with a seed (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def build_mph(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of the distinct unsigned hashes ``h``: slot = spread(h, 1 + d[bucket]) mod n."""
    n = len(h)
    n_buckets = max(1, n // 4)
    bucket = (spread(h, 0) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    taken = np.zeros(n, bool)
    d = np.zeros(n_buckets, np.uint32)
    for k in np.argsort(-sizes, kind="stable"):
        if not sizes[k]:
            break
        mine = h[order[ends[k] - sizes[k] : ends[k]]]
        seed = 0
        while True:  # the seeds in runs of 64 at a time
            tries = (spread(mine[None, :], 1 + np.arange(seed, seed + 64, dtype=np.uint64)[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[tries].any(1)
            for j in np.flatnonzero(free):
                if len(set(tries[j].tolist())) == len(mine):
                    d[k] = seed + j
                    taken[tries[j]] = True
                    break
            else:
                seed += 64
                continue
            break
    return d


def mph_slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    bucket = (spread(h, 0) % np.uint64(len(d))).astype(np.int64)
    return (spread(h, 1 + d[bucket].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


INDEX = "shard int, n_keys int, displacements binary, fingerprints binary, counts binary, last_ids binary, others binary"
PARTS = ("shard", "n_keys", "displacements", "fingerprints", "counts", "last_ids", "others")


def build_index(counts: DataFrame) -> tuple[DataFrame, int]:
    """The shards of the index over ``line_counts`` rows (one row each), written to the shared folder, and their number."""
    counts = cut(counts)
    n_shards = max(1, -(-counts.count() // SHARD_KEYS))

    def build(batch: pa.Table) -> pa.Table:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2", "n_docs", "last_id")])
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        first = np.r_[True, rows[0, 1:] != rows[0, :-1]]
        others, rows = rows[:, ~first], rows[:, first]
        h = np.ascontiguousarray(rows[0]).view(np.uint64)
        d = build_mph(h)
        at = np.empty(len(h), np.int64)
        at[mph_slot(h, d, len(h))] = np.arange(len(h))
        parts = [d, *(rows[k][at] for k in (1, 2, 3)), others]
        return pa.table([pa.array([int(batch.column("shard")[0].as_py())], pa.int32()), pa.array([len(h)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=list(PARTS))

    sharded = counts.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    return cut(sharded.groupBy("shard").applyInArrow(build, INDEX)), n_shards


class LineIndex:
    """Some shards of the index, for probing many hashes at once."""

    def __init__(self, rows: list[tuple], n_shards: int, min_docs: int):
        self.n_shards, self.min_docs = n_shards, min_docs
        self.shards = {r[0]: (r[1], np.frombuffer(r[2], np.uint32), *(np.frombuffer(x, np.int64) for x in r[3:6])) for r in rows}
        self.others = {(a, b): (n, i) for r in rows for a, b, n, i in np.frombuffer(r[6], np.int64).reshape(4, -1).T.tolist()}

    def last_ids(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash, whether it is a line of enough documents, and the largest id that holds it."""
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        shard = h1 % self.n_shards  # like pmod: the sign of the divisor
        for s, (n, d, prints, counts, ids) in self.shards.items():
            at = np.flatnonzero(shard == s)
            if len(at):
                slot = mph_slot(h1[at].view(np.uint64), d, n)
                hit = (prints[slot] == h2[at]) & (counts[slot] >= self.min_docs)
                found[at[hit]], last[at[hit]] = True, ids[slot[hit]]
        for k, key in enumerate(zip(h1.tolist(), h2.tolist())) if self.others else ():
            n, i = self.others.get(key, (0, 0))
            if n >= self.min_docs:
                found[k], last[k] = True, i
        return found, last


def probes_of(lines: list[list[bytes]], min_chars: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Of the texts' lines the eligible ones: (text, line) and both halves of their keys' hashes."""
    row, line, h1, h2 = [], [], [], []
    for r, own in enumerate(lines):
        for k, x in enumerate(own):
            key = line_key(x)
            if eligible(key, min_chars):
                a, b = key_hash(key)
                row.append(r)
                line.append(k)
                h1.append(a)
                h2.append(b)
    return row, line, np.array(h1, np.int64), np.array(h2, np.int64)


def lines_of(texts: pa.Array) -> list[list[bytes]]:
    return [(t or b"").split(b"\n") for t in byte_texts(texts)]


def results_of(lines: list[list[bytes]], drops: list) -> list[pa.Array]:
    """The result columns, from the lines and the numbers of those that go."""
    kept = []
    for own, gone in zip(lines, drops):
        gone = set(gone or ())
        kept.append(b"\n".join([x for k, x in enumerate(own) if k not in gone] if gone else own))
    return [pa.array(list(map(len, lines)), pa.int64()), pa.array([len(x or ()) for x in drops], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]


def routed_drops(docs: DataFrame, index: DataFrame, n_shards: int, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(__lines_id, __lines_text_hash, __lines_dead_lines), for an index too large to send to every task: probes go to the shards' arrays instead.

    A shard's probes are dealt over as many salts, each with a copy of the arrays, as keep a group near ``PROBES`` rows,
    so a line that a third of all documents hold is in no single group. Rows of equal id and text share their result.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, line, h1, h2 = probes_of(lines_of(b.column(2)), min_chars)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(line, pa.int32()), pa.array(h1), pa.array(h2)], names=["id", "th", "line", "h1", "h2"])

    probes = own.mapInArrow(probe, "id long, th long, line int, h1 long, h2 long").withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    most = probes.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = -(-most // PROBES) or 1
    left = probes.withColumn("salt", F.pmod(F.xxhash64("th", "line"), F.lit(salts)).cast("int"))
    right = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))))

    def answer(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["id", "th", "line"]
        if a.num_rows and b.num_rows:
            part = LineIndex([tuple(b.column(c)[0].as_py() for c in PARTS)], n_shards, min_docs)
            found, last = part.last_ids(a.column("h1").to_numpy(), a.column("h2").to_numpy())
            dead = found & (last != a.column("id").to_numpy())
            return a.filter(pa.array(dead)).select(names)
        return a.slice(0, 0).select(names)

    dead = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(answer, "id long, th long, line int")
    return dead.distinct().groupBy(F.col("id").alias("__lines_id"), F.col("th").alias("__lines_text_hash")).agg(F.collect_list("line").alias("__lines_dead_lines"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept_text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with n_lines, n_dropped and ``out_col``, the text without the lines that repeat in other documents.

    Up to ``MOST_BLOCKS`` blocks of the index are sent to the tasks, and the documents pass once for each; one block is the
    rule. Beyond that, the probes are sent to the index (``routed_drops``).
    """
    sc = docs.sparkSession.sparkContext
    index, n_shards = build_index(line_counts(docs, min_chars, min(2, min_docs), id_col, text_col))
    size = " + ".join(f"length({c})" for c in PARTS[2:])
    n_blocks, parts = blocks(index.select(*PARTS), size)
    dead = "__lines_dead_lines"
    results = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField(out_col, T.StringType())]
    if n_blocks > MOST_BLOCKS:
        drops = routed_drops(docs, index, n_shards, min_chars, min_docs, id_col, text_col)
        keyed = docs.withColumns({"__lines_i": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__lines_h": F.xxhash64(text_col)})
        joined = keyed.join(drops, (F.col("__lines_i") == F.col("__lines_id")) & (F.col("__lines_h") == F.col("__lines_text_hash")), "left")

        def finish():
            def work(texts: pa.Array, gone: pa.Array) -> list[pa.Array]:
                return results_of(lines_of(texts), gone.to_pylist())

            return work

        return annotate(joined.drop("__lines_i", "__lines_h", "__lines_id", "__lines_text_hash"), [text_col, dead], finish, results, drop=(dead, *drop))
    out = docs
    for n, block in enumerate(parts):
        sent, first, last = sc.broadcast([tuple(r) for r in block]), n == 0, n == n_blocks - 1

        def make(sent=sent, first=first, last=last):
            index = LineIndex(sent.value, n_shards, min_docs)

            def work(ids: pa.Array, texts: pa.Array, *before: pa.Array) -> list[pa.Array]:
                ids = [NO_ID if i is None else i for i in ids.cast(pa.int64()).to_pylist()]
                drops = [[] for _ in ids] if first else before[0].to_pylist()
                lines = lines_of(texts)
                row, line, h1, h2 = probes_of(lines, min_chars)
                if row:
                    found, last_id = index.last_ids(h1, h2)
                    for j in np.flatnonzero(found).tolist():
                        if ids[row[j]] != last_id[j]:
                            drops[row[j]].append(line[j])
                return results_of(lines, drops) if last else [pa.array(drops, pa.list_(pa.int32()))]

            return work

        fields = results if last else [T.StructField(dead, T.ArrayType(T.IntegerType()))]
        out = annotate(out, [id_col, text_col, *([] if first else [dead])], make, fields, drop=(dead, *drop) if last else ())
    return out


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, out_col="text").select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


ORACLE_OP6 = r"""
WITH lines AS (
  SELECT rowid_ AS r, doc_id, u.i AS i, u.line AS line,
         lower_ascii AS k
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(range(len(ls))) AS i, unnest(ls) AS line) u,
       LATERAL (SELECT translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii) z
), rep AS (
  SELECT k, max(doc_id) AS last_id FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3
), marked AS (
  SELECT l.r, l.doc_id, l.i, l.line, rep.k IS NOT NULL AND l.doc_id IS DISTINCT FROM rep.last_id AS dead
  FROM lines l LEFT JOIN rep ON l.k = rep.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dead) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dead), '')) AS kept_sha256
FROM marked GROUP BY r
"""

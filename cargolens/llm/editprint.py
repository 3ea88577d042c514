"""Document fingerprints by randomised edit embedding.

A text is cut into blocks where its own characters say so. Each block is embedded by a walk over its
characters: at step j the current character is written, and a random bit that step j and that
character share in all texts tells whether the walk moves on. Blocks a few edits apart fall back into
step, so their edit distance becomes a Hamming distance of the embeddings. Bands of sampled steps
of each embedding are hashed; a fingerprint keeps, for each of ``SLOTS`` shared hash functions, the
low bits of the smallest hashed band. Two fingerprints agree in a slot about as often as the texts
share bands, so likeness is the share of equal slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm import text as tx
from cargolens.llm.components import components
from cargolens.plans.staging import stage

SLOTS = 64
#: Hexadecimal digits of a slot.
DIGITS = 4
#: A block ends where a hash of the last eight characters has this many zero bits, or at MOST.
CUT_BITS, MOST = 6, 256
#: Bands of a block, and sampled steps that a band hashes.
BANDS, SAMPLED = 4, 6
#: Members of a side of a block in which fingerprints are compared (128 bytes each).
BLOCK = 4096
#: Bytes of text that are embedded at a time.
STEP_BYTES = 2 << 20

_U32, _U64 = np.uint32, np.uint64
_GEAR = (tx.mix(np.arange(1, 4097, dtype=_U64)) >> _U64(32)).astype(_U32)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins."""
    buf, offsets = tx.utf8(texts)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, tx.char_positions(buf)[offsets]


def blocks(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all blocks; blocks never reach over two texts."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled, reach = _GEAR[points & _U32(4095)], 1
    while reach < 8:
        wider = rolled.copy()
        wider[reach:] += rolled[:-reach] << _U32(reach)
        rolled, reach = wider, 2 * reach
    rolled ^= rolled >> _U32(15)
    ends = np.flatnonzero((rolled & _U32((1 << CUT_BITS) - 1)) == 0) + 1
    begin = offsets[np.searchsorted(offsets, ends - 1, "right") - 1]
    ends = ends[ends - begin >= 8]  # the hash must not see the text before
    ends = np.union1d(ends, offsets[1:][np.diff(offsets) > 0])
    starts = np.concatenate([[0], ends[:-1]])
    extra = (ends - starts - 1) // MOST  # long blocks are cut every MOST characters
    each = np.repeat(np.arange(len(starts)), extra + 1)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(extra + 1) - (extra + 1), extra + 1)
    cut = starts[each] + nth * MOST
    return cut, np.minimum(cut + MOST, ends[each])


def _sampled_steps(seed: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, shortest embedding it is for, steps): bands for lengths by powers of two.

    A band of the first kind samples steps below 24, the next below 48 and so on: blocks sample over
    all their steps, and blocks of near lengths have bands in common.
    """
    rng = np.random.default_rng(seed)
    out, reach = [], 24
    while reach <= 4 * MOST:
        for b in range(BANDS):
            out.append((b, reach, np.sort(rng.choice(reach, SAMPLED, replace=False))))
        reach *= 2
    return out


_BANDS = _sampled_steps(20_11)


def embedded_bands(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands of each block, and the blocks' numbers.

    All blocks walk side by side, longest first; an embedding has three steps a character, and a walk
    that is at its end writes 0.
    """
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, last, size = starts[order].copy(), ends[order], size[order]
    # bands that a block of this size has: the widest reach within its steps, and the next
    reach = 24 * 2 ** np.floor(np.log2(np.maximum(3 * size, 24) / 24)).astype(np.int64)
    keys = {}
    wanted: dict[int, list[int]] = {}
    for k, (_, r, steps) in enumerate(_BANDS):
        uses = int(np.searchsorted(-reach, -(r // 2), "right"))  # blocks with reach >= r / 2
        first = int(np.searchsorted(-reach, -2 * r, "right"))  # but below 2 * r
        if uses > first:
            keys[k] = (first, uses, np.full(uses - first, (k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), _U64))
            for s in steps:
                wanted.setdefault(int(s), []).append(k)
    total = max(wanted, default=-1) + 1
    walking = len(at)
    for j in range(total):
        here = at[:walking]
        done = here >= last[:walking]
        written = np.where(done, _U32(0), points[np.minimum(here, len(points) - 1)] + _U32(1))
        for k in wanted.get(j, ()):
            first, uses, key = keys[k]
            value = np.zeros(uses - first, _U64)
            upto = min(uses, walking)
            if upto > first:
                value[: upto - first] = written[first:upto]
            key[:] = (key ^ value) * _U64(0xBF58476D1CE4E5B9)
            key ^= key >> _U64(29)
        turn = (written * _U32(0x9E3779B1)) ^ _U32((j + 1) * 0x85EBCA6B & 0xFFFFFFFF)
        turn ^= turn >> _U32(15)
        turn *= _U32(0x2C1B3C6D)
        at[:walking] = here + (((turn >> _U32(16)) & _U32(1)) & ~done)
        if j % 32 == 31:  # blocks whose steps are over leave at the end
            walking = int(np.searchsorted(-np.maximum(2 * reach, 24), -(j + 1), "left"))
    found = [(tx.mix(key), order[first:uses]) for first, uses, key in keys.values()]
    if not found:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def fingerprint_array(texts: pa.Array) -> list[str]:
    """The fingerprint of each text; an empty text has a fixed one that no other text has."""
    points, offsets = code_points(texts)
    n = len(offsets) - 1
    starts, ends = blocks(points, offsets)
    bands, block = embedded_bands(points, starts, ends)
    owner = (np.searchsorted(offsets, starts, "right") - 1)[block]
    order = np.argsort(owner, kind="stable")
    bands, owner = bands[order], owner[order]
    slots = np.zeros((n, SLOTS), np.uint16)
    full, first = np.unique(owner, return_index=True)
    low = (bands >> _U64(32)).astype(_U32)
    if len(full):
        for k in range(SLOTS):
            seed = int(tx.mix(np.array([k + 101], _U64))[0])
            turned = (low ^ _U32(seed >> 32)) * _U32(seed & 0xFFFFFFFF | 1)
            turned ^= turned >> _U32(15)
            least = np.minimum.reduceat(turned, first)
            slots[full, k] = ((least * _U32(0x9E3779B1)) >> _U32(16)).astype(np.uint16)
    width = SLOTS * DIGITS
    text = slots.astype(">u2").tobytes().hex()
    empty = "-" * width
    filled = np.zeros(n, bool)
    filled[full] = True
    return [text[i * width : (i + 1) * width] if filled[i] else empty for i in range(n)]


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots of two fingerprints."""
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    equal = F.filter(
        slots,
        lambda k: F.substring(a, k * DIGITS + 1, F.lit(DIGITS)) == F.substring(b, k * DIGITS + 1, F.lit(DIGITS)),
    )
    return F.size(equal) / SLOTS


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text", STEP_BYTES):
            prints = pa.array(fingerprint_array(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], names=["doc_id", "fingerprint"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, fingerprint string")


def band_pairs(least: float) -> list[tuple[int, int]]:
    """Pairs of slots; fingerprints with a share of ``least`` equal slots agree in both slots of one.

    The slots are cut into one group fewer than so many equal slots, so that two of these share a
    group; all pairs inside groups are taken. At 0.5 these are 35 pairs.
    """
    need = math.ceil(SLOTS * least)
    if not 2 <= need <= SLOTS:
        raise ValueError(f"least must be above 1 / {SLOTS} and at most 1")
    groups = np.array_split(np.arange(SLOTS), need - 1)
    return [(int(a), int(b)) for g in groups for a, b in combinations(g, 2)]


def similar(prints: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows (doc_id, fingerprint) linked to a row with another id: doc_id, other, near.

    The links join the same documents, directly or over others, as all pairs of at least ``least``
    equal slots do; no such pair is lost, as ``band_pairs`` proves. Fingerprints are the only
    measure, texts are not compared. Equal fingerprints are one: their rows are linked to the
    smallest id. In a band's bucket each fingerprint meets the one with the smallest id; those
    that this head refuses are compared with all members of the bucket, in blocks of ``BLOCK`` by
    ``BLOCK``, and of these links only such as join two components come out. That step grows with
    the square of a bucket that its head refuses. Null ids are linked with nothing.
    """
    prints = prints.filter("doc_id IS NOT NULL").select("doc_id", "fingerprint")
    reps = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    reps = stage(reps.filter(~F.col("fingerprint").startswith("-")), "prints")
    slot = lambda k: F.substring("fingerprint", k * DIGITS + 1, DIGITS)
    bands = F.array(*(F.xxhash64(F.lit(k), slot(a), slot(b)) for k, (a, b) in enumerate(band_pairs(least))))
    keys = reps.select("doc_id", "fingerprint", F.explode(bands).alias("bucket"))
    heads = keys.groupBy("bucket").agg(
        F.min(F.struct("doc_id", "fingerprint")).alias("h"),
        F.count("*").alias("n"),
        F.sum(F.xxhash64("fingerprint").cast("decimal(38,0)")).alias("all"),
    )
    # buckets of the same members show the same links: one of them is enough
    heads = heads.filter("n > 1").groupBy("h", "n", "all").agg(F.min("bucket").alias("bucket"))
    heads = stage(heads.select("bucket", "n", F.col("h.doc_id").alias("other"), F.col("h.fingerprint").alias("theirs")), "heads")
    met = keys.join(heads, "bucket").filter("fingerprint <> theirs")
    met = met.withColumn("near", likeness(F.col("fingerprint"), F.col("theirs")))
    met = stage(met.withColumn("linked", F.col("near") >= least).drop("theirs"), "met")
    links = met.filter("linked AND doc_id <> other").select("doc_id", "other", "near").distinct()
    same = prints.join(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("other")), "fingerprint")
    same = same.filter("doc_id <> other").select("doc_id", "other", F.lit(1.0).alias("near")).distinct()
    links = links.unionByName(same)
    return links.unionByName(_between_refused(met, links, least))


def _between_refused(met: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Links of refused members to members of their bucket in another component."""
    label = components(links.select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    counts = met.groupBy("bucket").agg(
        F.ceil(F.count("*") / BLOCK).alias("blocks"),
        F.ceil(F.count_if(~F.col("linked")) / BLOCK).alias("refused_blocks"),
    )
    members = met.join(counts.filter("refused_blocks > 0"), "bucket")
    members = members.join(label, F.col("doc_id") == F.col("id"), "left").select(
        "bucket", "doc_id", "linked", F.unhex("fingerprint").alias("slots"), "blocks", "refused_blocks",
        F.coalesce("component", "doc_id").alias("component"),
    )
    mine = lambda n: F.pmod(F.xxhash64("slots"), F.col(n)).alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(n)
    columns = ["bucket", "doc_id", "component", "slots"]
    left = members.filter("NOT linked").select(*columns, F.lit(0).alias("side"), mine("refused_blocks"), every("blocks"))
    right = members.select(*columns, F.lit(1).alias("side"), every("refused_blocks"), mine("blocks"))

    def run(rows: pa.Table) -> pa.Table:
        side, ids, label = (rows.column(c).to_numpy() for c in ("side", "doc_id", "component"))
        slots = np.frombuffer(b"".join(rows.column("slots").to_pylist()), np.uint16).reshape(-1, SLOTS)
        right = np.flatnonzero(side == 1)
        label, out = label.copy(), []
        for r in np.flatnonzero(side == 0):
            other = right[label[right] != label[r]]
            near = (slots[other] == slots[r]).mean(1)
            for m in np.flatnonzero(near >= least):
                a, b = r, other[m]
                if label[a] != label[b]:
                    out.append((max(ids[a], ids[b]), min(ids[a], ids[b]), near[m]))
                    label[label == label[b]] = label[a]
        columns = list(zip(*out)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "other", "near"])

    keys = ["bucket", "refused_blocks", "blocks"]
    blocks = left.unionByName(right).repartition(*keys).groupBy(*keys)
    return stage(blocks.applyInArrow(run, "doc_id long, other long, near double").distinct(), "links")


#: Bytes of text that a range of ids holds on average; small inputs have a few ranges a core.
RANGE_BYTES, LEAST_BYTES = 128 << 20, 4 << 20
_NULL = -(1 << 63)


def _in_order(docs: DataFrame) -> DataFrame:
    """(range, tail, doc_id, text): partitions of whole ranges of ids, sorted by (doc_id, text).

    Ids are cut into ranges at quantiles. Behind the last row of a range stands, with tail 1, a copy
    of the first row of the next range (of the first range, behind the last). Texts move once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(_NULL)))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    cores = 3 * spark.sparkContext.defaultParallelism
    ranges = int(max(1, size // RANGE_BYTES, min(cores, size // LEAST_BYTES)))
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    cuts = docs.agg(F.percentile_approx("id", shares, 20 * ranges).alias("q")).first()["q"]
    bounds = np.array(sorted(set(cuts or [])) if ranges > 1 else [], np.int64)
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(), "right").astype(np.int32))

    firsts = docs.select("id").groupBy(range_of("id").alias("range")).agg(F.min("id").alias("id"))
    heads = sorted(tuple(r) for r in firsts.select("id", "range").collect())  # one row a range
    first = spark.sparkContext.broadcast(
        (np.array([h[0] for h in heads], np.int64), np.array([heads[k - 1][1] for k in range(len(heads))]))
    )

    @F.pandas_udf("int")
    def tail_of(ids: pd.Series) -> pd.Series:
        known, before = first.value
        ids = ids.to_numpy()
        at = np.searchsorted(known, ids)
        hit = known[np.minimum(at, len(known) - 1)] == ids
        return pd.Series(np.where(hit, before[np.minimum(at, len(known) - 1)], -1).astype(np.int32))

    places = F.array(
        F.struct(F.col("range"), F.lit(0).alias("tail")),
        F.struct(F.col("before").alias("range"), F.lit(1).alias("tail")),
    )
    rows = docs.withColumn("range", range_of("id")).withColumn("before", tail_of("id"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("before") >= 0, places).otherwise(F.slice(places, 1, 1))))
    rows = rows.select("place.range", "place.tail", "doc_id", "text")
    return rows.repartitionById(ranges, "range").sortWithinPartitions("range", "tail", "doc_id", "text")


def _successors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Ids, texts and next texts of the rows of ``_in_order``, some ``STEP_BYTES`` at a time."""
    ids, texts, nexts, size, held = [], [], [], 0, None
    for batch in tx.slices(batches, "text", STEP_BYTES):
        columns = (batch.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text"))
        for span, tail, doc, text in zip(*columns):
            if held is not None and held[0] == span:
                ids.append(held[1])
                texts.append(held[2])
                nexts.append(text)
                size += len(held[2])
            held = None if tail else (span, doc, text)
            if size > STEP_BYTES:
                yield ids, texts, nexts
                ids, texts, nexts, size = [], [], [], 0
    if ids:
        yield ids, texts, nexts


def edited_prints(docs: DataFrame) -> DataFrame:
    """Every text beside an edited one: its last quarter replaced by the beginning of the next text.

    doc_id, n_chars, edited (the text), and the fingerprints of the text, the edited and the next
    text: fingerprint, edited_fingerprint, next_fingerprint. The next row is that in order of doc_id
    (null first), then text; after the last comes the first. Null texts are empty; every row has a
    result, also where rows repeat; an empty table gives none.
    """
    kind = (
        "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
        "next_fingerprint string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, nexts in _successors(batches):
            edited = []
            for text, after in zip(texts, nexts):
                quarter = len(text) // 4
                edited.append(text[: len(text) - quarter] + after[:quarter])
            # a row's next text mostly is the following row's; only the others are embedded anew
            lone = [i for i in range(len(texts)) if i + 1 == len(texts) or nexts[i] is not texts[i + 1]]
            prints = fingerprint_array(pa.array(texts + [nexts[i] for i in lone], pa.string()))
            after = prints[1 : len(texts)] + [""]
            for i, p in zip(lone, prints[len(texts) :]):
                after[i] = p
            columns = (
                (ids, pa.int64()),
                ([len(t) for t in texts], pa.int64()),
                (edited, pa.string()),
                (prints[: len(texts)], pa.string()),
                (fingerprint_array(pa.array(edited, pa.string())), pa.string()),
                (after, pa.string()),
            )
            names = [c.split()[0] for c in kind.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)

    return _in_order(docs).mapInArrow(run, kind)


def edited_digest(docs: DataFrame) -> DataFrame:
    """The digest columns: likeness of each fingerprint to those of the edited and the next text."""
    prints = F.col("fingerprint")
    return edited_prints(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(prints, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(prints, F.col("next_fingerprint")).alias("near_next"),
    )

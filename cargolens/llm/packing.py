"""Best-two-fit packing of token sequences into rows of a fixed length.

A bin is filled greedily with the longest pieces that fit; then its smallest piece is exchanged for
the two unpacked pieces that use the gap so gained best. The choice depends on lengths alone, and
there are at most ``capacity`` of them, so it runs over the histogram of lengths: equal bins are
decided once and counted. What the driver holds has a fixed bound (``capacity`` counts, and bin
patterns of which each uses up a length), however many pieces there are. Pieces then find their bin
through their number among the pieces of their length, which is counted in salted groups.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm.text import slices
from cargolens.plans.staging import stage

CAPACITY = 2048
#: Pieces of one length that are numbered in one group.
GROUP_ROWS = 20_000
#: Code points that both libraries split alike; texts with others take the reference encoder.
_COMMON = re.compile("[^\x00-ɏ]")
#: Blanks in a row that ``tiktoken`` does not get: its pattern gives up at about a million.
LONG_RUN = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _has_long_run(text: str) -> bool:
    """Are there ``LONG_RUN`` blanks in a row?"""
    # one of the places that are LONG_RUN apart lies in such a run
    for at in range(LONG_RUN - 1, len(text), LONG_RUN):
        if text[at].isspace():
            before = text[at - LONG_RUN + 1 : at + 1]
            after = text[at + 1 : at + LONG_RUN]
            if len(before) - len(before.rstrip()) + len(after) - len(after.lstrip()) >= LONG_RUN:
                return True
    return False


def _encoder(json_path: str, ranks_path: str | None):
    """A function from texts to lists of ids, as ``tokenizers`` gives them for ``json_path``.

    With ``ranks_path`` (the same vocabulary as ranks) texts of common code points go through
    ``tiktoken``, which gives the same ids several times faster; texts with a run of ``LONG_RUN``
    blanks, and others that it fails at, do not.
    """
    import base64

    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.no_truncation()
    exact.no_padding()
    fast = None
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {
            t.content: i for i, t in exact.get_added_tokens_decoder().items() if t.special
        }
        fast = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens=special,
        )

    def encode(text: str) -> list[int]:
        if fast is not None and not _COMMON.search(text) and not _has_long_run(text):
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:  # its pattern ran out of stack
                pass
        return exact.encode(text, add_special_tokens=False).ids

    return encode


_encoders: dict[tuple, object] = {}


def tokenize(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    capacity: int = CAPACITY,
    separator: int = 0,
) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``capacity`` tokens; ids are unsigned 32-bit.

    Each text ends with ``separator``; a null text is empty and gives that one id. Only documents
    over ``capacity`` are cut, and all their pieces but the first are full. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (json_path, ranks_path)
        if key not in _encoders:
            _encoders[key] = _encoder(*key)
        encode = _encoders[key]
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "")
                ids.append(separator)
                data = np.asarray(ids, dtype="<u4").tobytes()
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [
                    (doc, k, a, b - a, data[4 * a : 4 * b])
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
                ]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def bin_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit over a histogram: (number of equal bins, [(length, pieces of it in a bin)])."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out = []

    def fill(gap: int, used: dict[int, int]) -> int:
        """Take the longest piece that fits, again and again; returns the gap that stays."""
        top = bisect.bisect_right(lengths, gap)
        while top and gap >= lengths[0]:
            n = lengths[top - 1]
            take = min(left[n] - used.get(n, 0), gap // n)
            if take > 0:
                used[n] = used.get(n, 0) + take
                gap -= take * n
            top = min(top - 1, bisect.bisect_right(lengths, gap))
        return gap

    def best_two(room: int, used: dict[int, int], above: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum over ``above`` and at most ``room``."""
        best, pair = above, None
        i, j = 0, bisect.bisect_right(lengths, room) - 1
        spare = lambda n: left[n] - used.get(n, 0)
        while i <= j and best < room:
            a, b = lengths[i], lengths[j]
            if spare(a) < 1:
                i += 1
            elif spare(b) < 1 or a + b > room or (i == j and spare(a) < 2):
                j -= 1
            else:
                if a + b > best:
                    best, pair = a + b, (a, b)
                i += 1
        return pair

    while lengths:
        used: dict[int, int] = {}
        gap = fill(capacity, used)
        if gap and sum(used.values()) > 1:
            small = min(used)
            pair = best_two(gap + small, used, small)
            if pair:
                used[small] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= times * c
        lengths = [n for n in lengths if left[n]]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def _slots(patterns: list, capacity: int) -> dict[int, np.ndarray]:
    """For each length: first piece number, pieces a bin, first sequence id, first offset, by rows."""
    slots: dict[int, list] = {}
    placed: dict[int, int] = {}
    sequence = 0
    for times, items in patterns:
        offset = 0
        for n, c in items:
            slots.setdefault(n, []).append((placed.get(n, 0), c, sequence, offset))
            placed[n] = placed.get(n, 0) + times * c
            offset += n * c
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in slots.items()}


def pack(
    pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, length: Column | str = "length"
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` of the row each is packed into.

    ``keys`` order the pieces of one length; which of several equal pieces goes where makes no
    difference to the packing. Lengths are 1 to ``capacity``; others and nulls raise an error.
    Columns stay as they are; an empty input gives an empty result.
    """
    spark = pieces.sparkSession
    bad = ~F.coalesce(F.col("length").between(1, capacity), F.lit(False))
    checked = F.when(bad, F.raise_error(F.lit(f"a piece's length must be 1 to {capacity}")))
    staged = stage(
        pieces.withColumn("length", F.coalesce(checked.cast("long"), F.col("length"))), "pieces"
    )
    groups = max(1, -(-staged.count() // GROUP_ROWS))
    salt = F.pmod(F.xxhash64(*keys), F.lit(groups))
    counts = staged.groupBy("length", salt.alias("_salt")).agg(F.count("*").alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(
            W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    counts = stage(counts.select("length", "_salt", "_n", before.alias("_before")), "lengths")
    totals = {
        r["length"]: r["n"]
        for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    }
    slots = spark.sparkContext.broadcast(_slots(bin_patterns(totals, capacity), capacity))
    numbered = (
        staged.withColumn("_salt", salt)
        .join(counts.drop("_n"), ["length", "_salt"])
        .withColumn(
            "_number",
            F.col("_before")
            + F.row_number().over(W.partitionBy("length", "_salt").orderBy(*keys))
            - 1,
        )
        .drop("_before", "_salt")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            n = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            cuts = np.flatnonzero(np.diff(n[order])) + 1
            for rows in np.split(order, cuts) if len(n) else []:
                mine = table[int(n[rows[0]])]
                at = mine[np.searchsorted(mine[:, 0], number[rows], "right") - 1]
                nth = number[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + nth // at[:, 1]
                offset[rows] = at[:, 3] + nth % at[:, 1] * n[rows]
            names = [c for c in batch.schema.names if c != "_number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = numbered.drop("_number").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed rows themselves: sequence_id, ids (little-endian 32-bit), and where documents begin.

    ``packed`` has ``ids``; a group is one sequence, of at most the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("_parts"))
        .select(
            "sequence_id",
            F.aggregate(
                F.transform("_parts", lambda p: p["ids"]),
                F.lit(b""),
                lambda a, b: F.concat(a, b),
            ).alias("ids"),
            F.transform("_parts", lambda p: p["doc_id"]).alias("doc_ids"),
            F.transform("_parts", lambda p: p["offset"]).alias("offsets"),
        )
    )


def packed_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of packing ``docs`` (doc_id, text) with the public byte-level vocabulary."""
    import public_tokenizers as P

    pieces = tokenize(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    narrow = pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(narrow, ["doc_id", "piece", "start", "ids_crc32"])

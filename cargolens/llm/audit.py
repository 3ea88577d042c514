"""What each of several text filters removes, in every order of them, with exact copies found by radix tries.

One pass over the documents checks each different text of a task once and writes it with the rows that
have it; after that a text is known by the number of its written row. Full texts are then dealt to ranges by
prefixes that grow where many bytes share a beginning. Each range puts its texts into a compressed trie
whose terminals hold the smallest doc_id, and a walk over the trie gives every written row that id.
A text that a third of all rows repeat is written once by each task (or ``HELD_BYTES`` of different
texts), so no range sees its rows one by one. Five failure bits of each document are summed to counts of the 32 masks,
from which the figures of all 120 orders follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.text import slices
from cargolens.plans.staging import stage

FILTERS = "ABCDE"
#: Bytes of different texts that a task holds before it writes them.
HELD_BYTES = 16 << 20
#: Bytes of text in a range, at most about so many.
RANGE_BYTES = 32 << 20
#: Prefixes begin with so many characters and grow by this factor.
FIRST_PREFIX, GROWTH = 8, 4

_CAPITALS = bytes(range(0x41, 0x5B))
_INNER_BYTES = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def failed_filters(data: bytes) -> int:
    """Bits of the filters A to D (bit 0 to 3) that a text fails.

    A: under 100 words; B: different words under 80 % of the words; C: letters A-Z over 10 % of the
    code points; D: one of ``#$%&*|``. Words are separated by white space of ASCII, which is where ``bytes.split`` splits.
    """
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _INNER_BYTES))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * capitals > 10 * points) << 2
        | (len(data.translate(None, _MARKS)) < len(data)) << 3
    )


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different texts with their failure bits and rows, written whenever ``HELD_BYTES`` are together."""
    first = TaskContext.get().partitionId() << 33
    texts: dict[bytes, list[tuple]] = {}
    held = written = 0

    def batch() -> pa.RecordBatch:
        rows = [row for group in texts.values() for row in group]
        ends = [0]
        for group in texts.values():
            ends.append(ends[-1] + len(group))
        members = pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "part"]
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(first + written, first + written + len(texts)), pa.int64()),
                pa.array(texts.keys(), pa.binary()).cast(pa.string()),
                pa.array(map(failed_filters, texts), pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members),
            ],
            names=["number", "text", "failed", "members"],
        )

    for part in slices(batches, "text"):
        data = part.column("text").cast(pa.binary()).to_pylist()
        for text, *row in zip(data, part.column("doc_id").to_pylist(), part.column("part").to_pylist()):
            group = texts.setdefault(text or b"", [])
            held += 24 if group else 100 + len(text or b"")
            group.append(row)
        if held >= HELD_BYTES:
            yield batch()
            written += len(texts)
            texts, held = {}, 0
    if texts:
        yield batch()


class RadixTrie:
    """A compressed trie over byte strings; a terminal holds the least id and what was put there."""

    def __init__(self):
        self.root = self._node(b"")

    @staticmethod
    def _node(edge: bytes) -> list:
        return [edge, {}, None, []]  # edge, children by first byte, least id, numbers

    def insert(self, data: bytes, least: int | None, number: int) -> None:
        node, at = self.root, 0
        while at < len(data):
            child = node[1].get(data[at])
            if child is None:
                child = node[1][data[at]] = self._node(data[at:])
            elif not data.startswith(child[0], at):
                child = self._split(node, child, data, at)
            at += len(child[0])
            node = child
        if least is not None and (node[2] is None or least < node[2]):
            node[2] = least
        node[3].append(number)

    def _split(self, parent: list, child: list, data: bytes, at: int) -> list:
        """Cut a child's edge where ``data`` leaves it; the upper part is the result."""
        edge, same, most = child[0], 1, min(len(child[0]), len(data) - at)
        while same < most:  # edge[:same] is equal, edge[:most + 1] is not
            half = (same + most + 1) // 2
            if edge[same:half] == data[at + same : at + half]:
                same = half
            else:
                most = half - 1
        upper = self._node(edge[:same])
        child[0] = edge[same:]
        upper[1][child[0][0]] = child
        parent[1][data[at]] = upper
        return upper

    def terminals(self) -> Iterator[tuple[int | None, list[int]]]:
        """The least id and the numbers of each string that was put in."""
        stack = [self.root]
        while stack:
            _, children, least, numbers = stack.pop()
            if numbers:
                yield least, numbers
            stack.extend(children.values())


def _least_by_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = RadixTrie()
    for batch in batches:
        data = batch.column("text").cast(pa.binary()).to_pylist()
        for row in zip(data, batch.column("least").to_pylist(), batch.column("number").to_pylist()):
            trie.insert(*row)
    numbers, leasts = [], []
    for least, group in trie.terminals():
        numbers += group
        leasts += [least] * len(group)
        if len(numbers) >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(leasts, pa.int64())], names=["number", "first_id"])
            numbers, leasts = [], []
    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(leasts, pa.int64())], names=["number", "first_id"])


def range_key(texts: DataFrame, share: float) -> Column:
    """The prefix of ``text`` by which ranges are cut: longer where over ``share`` bytes begin alike.

    A prefix shared by different texts with more bytes than that is lengthened, again and again; there are
    at most (all bytes / share) of them at a length. The key rises with the text, and equal texts have equal keys.
    """
    length, rest, choices = FIRST_PREFIX, texts, []
    while True:
        prefix = F.substring("text", 1, length)
        groups = rest.groupBy(prefix.alias("prefix")).agg(
            F.sum(F.octet_length("text")).alias("bytes"),
            F.min(F.xxhash64("text")).alias("low"),
            F.max(F.xxhash64("text")).alias("high"),
        )
        heavy = groups.filter((F.col("bytes") > share) & (F.col("low") != F.col("high")))
        heavy = [r["prefix"] for r in heavy.select("prefix").collect()]
        choices.append((prefix, heavy))
        if not heavy:
            break
        rest, length = rest.filter(prefix.isin(heavy)), length * GROWTH
    key = choices[-1][0]
    for prefix, heavy in reversed(choices[:-1]):
        key = F.when(prefix.isin(heavy), key).otherwise(prefix)
    return key


def failure_masks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang) as doc_id, part (``lang``, empty for null) and mask.

    Bits 0 to 3 of ``mask`` are the filters of ``failed_filters``; bit 4 says that a smaller doc_id anywhere
    in the table has the same text. A null text is empty, so null and empty texts are copies of
    each other; rows that repeat the smallest doc_id of a text all pass bit 4, rows with a null doc_id pass it and are nobody's
    original. Rows stay as many as they are; other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    )
    kind = "number long, text string, failed int, members array<struct<doc_id: long, part: string>>"
    held = stage(rows.mapInArrow(_held, kind), "held-texts")
    texts = held.select("number", "text", F.array_min("members.doc_id").alias("least"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    key = range_key(held.select("text"), max(1, total / ranges))
    least = texts.repartitionByRange(ranges, key).mapInArrow(_least_by_trie, "number long, first_id long")
    marked = held.select("number", "failed", "members").join(least, "number")
    marked = marked.select("failed", "first_id", F.explode("members").alias("m"))
    copy = F.coalesce(F.col("m.doc_id") > F.col("first_id"), F.lit(False))
    return marked.select(
        "m.doc_id", "m.part", F.col("failed").bitwiseOR(F.when(copy, 16).otherwise(0)).cast("int").alias("mask")
    )


def order_table(masks: DataFrame) -> DataFrame:
    """Counts (part, mask, n, good, toxic) as one row per part, order of the filters and step.

    All counts of an order follow from how many documents pass a set of filters, for the 32 sets.
    """
    def passing(count: str, bits: int) -> Column:
        return F.sum(F.when(F.col("mask").bitwiseAND(bits) == 0, F.col(count)).otherwise(0))

    sets = range(1 << len(FILTERS))
    lone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(FILTERS))]
    # of the orders, one in as many as a document's failures removes it by a given one of them
    orders = [list(o) for o in permutations(FILTERS)]
    share = F.col("n") * (F.lit(len(orders)) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    shapley = [
        F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, share).otherwise(0)) for i in range(len(FILTERS))
    ]
    parts = masks.groupBy("part").agg(
        *(F.array(*(passing(c, s) for s in sets)).alias(f"{c}s") for c in ("n", "good", "toxic")),
        F.array(*lone).alias("lone"),
        F.array(*shapley).alias("shapley"),
    )
    steps = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit("".join(order)).alias("filter_order"),
                    F.lit(k + 1).alias("step"),
                    F.lit(FILTERS.index(order[k])).alias("filter"),
                    F.lit(sum(1 << FILTERS.index(f) for f in order[:k])).alias("before"),
                )
                for order in orders
                for k in range(len(FILTERS))
            )
        )
    )
    rows = parts.select("*", steps.alias("s")).select("*", "s.*")
    after = F.col("before") + F.expr("shiftleft(1, filter)")

    def lost(count: str) -> Column:
        counts = F.col(f"{count}s")
        return F.get(counts, F.col("before")) - F.get(counts, after)

    failing = F.get("ns", F.lit(0)) - F.get("ns", F.expr("shiftleft(1, filter)"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("ns", after).alias("kept"),
        lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"),
        F.get("lone", F.col("filter")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The table of ``order_table`` for ``docs``, with labels (doc_id, quality, toxic).

    A document is good or toxic where any label row of its doc_id has a 1 there; without a label, or with a
    null doc_id, it is neither. A part without documents has no rows.
    """
    rows = failure_masks(docs).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    rows = rows.join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        *(
            F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(name)
            for c, name in (("quality", "good"), ("toxic", "toxic"))
        ),
    )
    return order_table(counts)

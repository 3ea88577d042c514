"""Near-duplicate documents by MinHash with tensored banding, confirmed on the full shingle sets.

Two small collections of band keys are computed per distinct shingle set. A table of the search is
a pair (i, j): its key joins key i of the first collection and key j of the second. SIDE * SIDE
tables so need only 2 * SIDE * ROWS minhashes: the square root of what as many separate bands take.
A pair of sets of similarity s meets in some table with probability (1 - (1 - s^ROWS)^SIDE)^2; at
0.8 the 22 keys of four rows lose less than 2 pairs in 100,000, and fewer above that.

Equal sets collapse to one representative first, and keys that only one representative has are
dropped before the product is formed. In each bucket members meet one centre, the member with most
company, not each other; the sets confirm or refuse each pair. Members of a bucket that its centre refuses may
still be linked to other members. Sets of similarity t share one of the first (1 - t) * n + 1 shingles of
each in any common order, so members that share none of these with another member are left out first.
The differences of two sets from their common centre give their similarity without the texts, so the
others are compared in blocks of bounded size, and only links that join two components come out. No
link that a bucket shows is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import text as tx
from cargolens.llm.common import give_back_memory, in_slots
from cargolens.llm.components import components
from cargolens.plans.staging import stage

SIDE, ROWS = 22, 4
#: Members that one comparing group of a centre holds.
GROUP = 256
#: Members of a side of a block in which members are compared, and their differences in all.
BLOCK, BLOCK_DIFFERENCES = 4096, 1 << 20
#: Differences that more members of a block share are compared as bits, the others by lists.
FREQUENT = 64
#: Differences that a task passes on at a time, and members whose bits it compares at a time.
HELD_DIFFERENCES, COMPARED = 1 << 18, 512

_SIGNATURE = "doc_id long, n long, s1 long, s2 long, a array<long>, b array<long>"


def shingle_sets(batch_text: pa.Array, width: int):
    """Distinct shingles of each text, as sorted 64-bit hashes: flat values and text offsets.

    A-Z are lower-cased; words are runs of anything but space and \\t \\n \\v \\f \\r. A text of
    fewer words than ``width`` has its whole word sequence as its one shingle; without words, none.
    """
    buf, offsets = tx.utf8(batch_text)
    buf = tx.LOWER[buf] if len(buf) else buf
    starts, ends, doc = tx.runs(buf, offsets, tx.NOT_SPACE)
    hashes = tx.word_hashes(buf, starts, ends)
    n_docs = len(offsets) - 1
    words = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(words)])
    shingles = tx.window_hashes(hashes, width)
    owner = doc[: len(shingles)]
    whole = doc[width - 1 :] == owner
    shingles, owner = shingles[whole], owner[whole]
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        some = tx.span_sums(hashes, first[short], first[short + 1])
        shingles, owner = np.concatenate([shingles, some]), np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[fresh], owner[fresh]
    return shingles, np.searchsorted(owner, np.arange(n_docs + 1))


def _band_keys(shingles: np.ndarray, begins: np.ndarray, side: int, rows: int) -> np.ndarray:
    """Keys of both collections for each (non-empty) set: shape (2 * side, sets)."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((2 * side, len(begins)), np.uint64)
    seeds = tx.mix(np.arange(1, 2 * side * rows + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    for k in range(2 * side):
        key = np.full(len(begins), k + 1, np.uint64)
        for r in range(rows):
            seed = seeds[k * rows + r]
            turned = (low ^ np.uint32(seed >> np.uint64(32))) * np.uint32((int(seed) & 0xFFFFFFFF) | 1)
            turned ^= turned >> np.uint32(15)
            key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(turned, begins))
        keys[k] = key
    return keys


def signatures(docs: DataFrame, width: int, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """For each row (doc_id, text): set size, two hashes of the set, both collections of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in tx.slices(batches, "text"):
            shingles, offsets = shingle_sets(batch.column("text"), width)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            s1, s2 = np.zeros((2, len(sizes)), np.uint64)
            keys = np.zeros((2 * side, 0), np.uint64)
            if len(full):
                begins = offsets[full]
                s1[full] = np.add.reduceat(tx.mix(shingles), begins)
                s2[full] = np.add.reduceat(tx.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)
                keys = _band_keys(shingles, begins, side, rows)
            lists = np.concatenate([[0], np.cumsum(np.where(sizes > 0, side, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(tx.signed(s1)),
                    pa.array(tx.signed(s2)),
                    tx.list_column(tx.signed(keys[:side].T.ravel()), lists, pa.int64()),
                    tx.list_column(tx.signed(keys[side:].T.ravel()), lists, pa.int64()),
                ],
                names=["doc_id", "n", "s1", "s2", "a", "b"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SIGNATURE)


def _buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id, company) of representatives that share a key of either collection."""
    keys = reps.select(
        "id",
        F.explode(
            F.concat(
                F.transform("a", lambda k: F.struct(F.lit(0).alias("side"), k.alias("key"))),
                F.transform("b", lambda k: F.struct(F.lit(1).alias("side"), k.alias("key"))),
            )
        ).alias("k"),
    ).select("id", "k.side", "k.key")
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    # a staged key table leaves the join with plain shuffles on both sides, which Spark can split
    mine = keys.join(stage(shared, "shared"), "key").groupBy("id").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("key"))).alias("a"),
        F.collect_list(F.when(F.col("side") == 1, F.col("key"))).alias("b"),
        F.sum("members").alias("company"),
    )
    pairs = mine.select("id", "company", F.explode("a").alias("x"), "b")
    pairs = pairs.select("id", "company", "x", F.explode("b").alias("y"))
    return pairs.select(F.xxhash64("x", "y").alias("bucket"), "id", "company")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``pairs`` (id, centre) with ``linked``: is 100 * intersection >= percent * union of the sets;
    ``size`` of the set of id; ``differences``: shingles that one of both sets has; ``against``: a hash
    of the centre's set; and ``first``: what the set of id has beside it, in order, as far as one of
    these must be in any set linked to id (``short`` tells that there are too few to say so).

    A centre's text meets its members in groups of about ``GROUP``; a group is read as a stream that
    keeps the centre's set alone (its sets, where rows repeat its doc_id with other texts).
    """
    ids = pairs.select(F.col("id").alias("doc_id")).unionByName(pairs.select(F.col("centre").alias("doc_id")))
    texts = in_slots(docs, F.col("doc_id"), ids.distinct())
    groups = pairs.groupBy("centre").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(groups, "centre").select(
        "id", "centre", F.pmod(F.xxhash64("id"), F.col("groups")).alias("part")
    )
    members = dealt.join(texts, F.col("id") == F.col("doc_id")).select(
        "centre", "part", F.lit(1).alias("kind"), "id", "text"
    )
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))
    heads = groups.join(texts, F.col("centre") == F.col("doc_id")).select(
        "centre", parts.alias("part"), F.lit(0).alias("kind"), F.col("centre").alias("id"), "text"
    )
    rows = members.unionByName(heads).repartition("centre", "part")
    rows = rows.sortWithinPartitions("centre", "part", "kind", "id")

    def compared(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 8
        out.clear()
        lists = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), lists, pa.int64(), lists, pa.bool_())
        names = ["id", "centre", "linked", "size", "differences", "against", "first", "short"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        held, centre_sets = None, []
        for batch in tx.slices(batches, "text"):
            values, offsets = shingle_sets(batch.column("text"), width)
            centre, part, kind, ids = (
                batch.column(c).to_pylist() for c in ("centre", "part", "kind", "id")
            )
            out: list[tuple] = []
            passed = 0
            for r in range(batch.num_rows):
                mine = values[offsets[r] : offsets[r + 1]]
                if held != (centre[r], part[r]):
                    held, centre_sets = (centre[r], part[r]), []
                if kind[r] == 0:
                    mark = np.bitwise_xor.reduce(tx.mix(mine), initial=np.uint64(len(mine)))
                    centre_sets.append((int(tx.signed(np.array([mark], np.uint64))[0]), mine.copy()))
                    continue
                for against, theirs in centre_sets:
                    apart = np.setxor1d(mine, theirs, assume_unique=True)
                    common = (len(mine) + len(theirs) - len(apart)) // 2
                    linked = len(mine) > 0 and 100 * common >= percent * (common + len(apart))
                    extra = apart[np.isin(apart, mine, assume_unique=True)]
                    most = len(mine) - -(-percent * len(mine) // 100) + 1
                    first, short = tx.signed(extra[:most]), len(extra) < most
                    out.append((ids[r], centre[r], linked, len(mine), tx.signed(apart), against, first, short))
                    passed += len(apart) + len(first)
                    if passed >= HELD_DIFFERENCES:  # short members of a long centre differ in all of its set
                        yield compared(out)
                        passed = 0
            if out:
                yield compared(out)

    kind = (
        "id long, centre long, linked boolean, size long, differences array<long>, against long, "
        "first array<long>, short boolean"
    )
    return stage(rows.mapInArrow(run, kind), "confirmed")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, side: int = SIDE, rows: int = ROWS
) -> DataFrame:
    """Documents (doc_id, text) as doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    distinct shingles of ``width`` words. ``component_id`` is the smallest doc_id that links reach,
    ``kept`` tells whether that is the document itself. Documents without words or text are linked
    with nothing. Rows that repeat a doc_id are one document with several texts: each row stays, and
    all get the class that any of the texts reaches. A null doc_id is linked with nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(signatures(docs, width, side, rows), "signatures")
    one = signed.filter("n > 0 AND doc_id IS NOT NULL")
    reps = (
        one.groupBy("s1", "s2", "n")
        .agg(F.min("doc_id").alias("id"), F.first("a").alias("a"), F.first("b").alias("b"))
        .select("id", "s1", "s2", "n", "a", "b")
    )
    reps = stage(reps, "representatives")
    buckets = stage(_buckets(reps), "buckets")
    centre = F.max(F.struct("company", (-F.col("id")).alias("low")))
    centres = buckets.groupBy("bucket").agg(centre.alias("c"), F.count("*").alias("size"))
    centres = stage(
        centres.filter("size > 1").select("bucket", (-F.col("c.low")).alias("centre")), "centres"
    )
    met = buckets.join(centres, "bucket").filter("id <> centre").select("id", "centre")
    tried = _confirmed(stage(met.distinct(), "pairs"), docs, width, percent)
    links = tried.filter("linked").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    links = links.unionByName(_between_members(tried, links, percent))
    copies = one.join(reps.select("s1", "s2", "n", "id"), ["s1", "s2", "n"])
    same = copies.filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    classes = components(links.unionByName(same).distinct())
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"))
        .join(classes, F.col("doc_id") == F.col("id"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def _may_be_linked(tried: DataFrame) -> DataFrame:
    """``tried`` without members that can be linked to no other member of their centre, by proof.

    The shingles of a centre's members are ordered: those that the centre's set lacks first. A set of
    n shingles and one linked to it share one of the first (100 - percent) * n / 100 + 1 of both.
    Members whose ``first`` are fewer (``short``) also stay where there are two of them.
    """
    group = ["centre", "against"]
    parts = tried.select(*group, "id", "linked", F.explode("first").alias("shingle"))
    shared = parts.groupBy(*group, "shingle").agg(
        F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("refused")
    )
    shared = stage(shared.filter("n > 1 AND refused > 0").drop("n", "refused"), "shared")
    meet = parts.join(shared, [*group, "shingle"]).select(*group, "id")
    shorts = tried.filter("short").groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("refused")
    )
    shorts = shorts.filter("n > 1 AND refused > 0").select(*group)
    meet = meet.unionByName(tried.filter("short").join(shorts, group).select(*group, "id"))
    return tried.join(stage(meet.distinct(), "may-be-linked"), [*group, "id"])


def _between_members(tried: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between members of one centre that it left in different components.

    Pairs of which the centre refused one are compared in blocks of about ``BLOCK`` by ``BLOCK``
    members, fewer where these have many differences.
    """
    if tried.filter("NOT linked").isEmpty():
        return links.limit(0)
    label = components(links)
    group = ["centre", "against"]
    tried = stage(_may_be_linked(tried).drop("first", "short"), "tried")

    def labelled(df: DataFrame, key: str, name: str) -> DataFrame:
        known = label.select(F.col("id").alias(key), F.col("component").alias(name))
        return df.join(known, key, "left").withColumn(name, F.coalesce(name, key))

    refused = tried.filter("NOT linked").select("id", *group)
    apart = labelled(labelled(refused, "id", "x"), "centre", "y").filter("x <> y")
    far = F.size("differences")
    blocks = lambda n, d: F.greatest(F.ceil(n / BLOCK), F.ceil(d / BLOCK_DIFFERENCES))
    counts = tried.groupBy(*group).agg(
        blocks(F.count("*"), F.sum(far)).alias("blocks"),
        blocks(F.count_if(~F.col("linked")), F.sum(F.when(~F.col("linked"), far))).alias("refused_blocks"),
    )
    counts = counts.join(apart.select(*group).distinct(), group, "left_semi")
    members = labelled(tried.join(counts, group), "id", "component")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(n)
    columns = [*group, "id", "size", "component", "differences"]
    left = members.filter("NOT linked").select(*columns, F.lit(0).alias("side"), mine("refused_blocks"), every("blocks"))
    right = members.select(*columns, F.lit(1).alias("side"), every("refused_blocks"), mine("blocks"))

    def run(rows: pa.Table) -> pa.Table:
        give_back_memory()
        side, ids, size, label = (
            rows.column(c).to_numpy() for c in ("side", "id", "size", "component")
        )
        lists = rows.column("differences").combine_chunks()
        far = lists.value_lengths().to_numpy().astype(np.int64)
        found = _CommonDifferences(lists.flatten().to_numpy(), far)
        right = np.flatnonzero(side == 1)
        label, out = label.copy(), []
        for r in np.flatnonzero(side == 0):
            other = right[label[right] != label[r]]
            apart = far[other] + far[r] - 2 * found.common(r, other)
            both = (size[other] + size[r] - apart) // 2
            for m in other[(100 * both >= percent * (both + apart)) & (ids[other] != ids[r])]:
                if label[m] != label[r]:
                    out.append((ids[r], ids[m]))
                    label[label == label[m]] = label[r]
        columns = list(zip(*out)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    # dealt by block, else all blocks of a centre would stay in one task
    keys = [*group, "refused_blocks", "blocks"]
    blocks_of = left.unionByName(right).repartition(*keys).groupBy(*keys)
    return stage(blocks_of.applyInArrow(run, "a long, b long"), "links")


class _CommonDifferences:
    """How many values two lists have in common, for lists without repeats.

    Values in over ``FREQUENT`` lists are bits: rows x values / ``FREQUENT`` / 8 bytes at most. For the
    others the lists that hold a value are listed.
    """

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        n = len(lengths)
        order = np.argsort(values, kind="stable").astype(np.int32)
        fresh = np.ones(len(values), bool)
        fresh[1:] = np.diff(values[order]) != 0
        feature = np.empty(len(values), np.int32)
        feature[order] = np.cumsum(fresh, dtype=np.int32) - 1
        del order, fresh
        owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
        uses = np.bincount(feature)
        often = uses > FREQUENT
        number = np.cumsum(often) - 1
        self._bits = np.zeros((n, max(1, -(-int(often.sum()) // 64))), np.uint64)
        mine = often[feature]
        at = number[feature[mine]]
        np.bitwise_or.at(self._bits, (owner[mine], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        mine = ~mine & (uses[feature] > 1)
        owner, feature = owner[mine], feature[mine]
        order = np.argsort(feature, kind="stable")
        self._holders = owner[order]
        self._starts = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=len(uses)))])
        self._features = feature
        self._begins = np.searchsorted(owner, np.arange(n + 1))

    def common(self, row: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), np.int64)
        for at in range(0, len(others), COMPARED):
            some = self._bits[others[at : at + COMPARED]] & self._bits[row]
            out[at : at + COMPARED] = np.bitwise_count(some).sum(1, dtype=np.int64)
        mine = self._features[self._begins[row] : self._begins[row + 1]]
        if len(mine):
            begin, size = self._starts[mine], self._starts[mine + 1] - self._starts[mine]
            steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            held = self._holders[np.repeat(begin, size) + steps]
            out += np.bincount(held, minlength=len(self._bits))[others]
        return out

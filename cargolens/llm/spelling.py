"""Spelling variants: words one edit apart, by a bit-sliced position index over blocks of the vocabulary.

A block holds words that agree outside a window of places: those before the window as counted from the
front, those behind it as counted from the end. Its words have one length or that and one more. Each
length has two windows, its halves, so two words one edit apart meet in the block whose window has
their first difference, and in no other. A block that is too large is dealt to the halves of its window,
and so on; a window of one place leaves no more words than letters allow, so all blocks end up small whatever
the vocabulary is. No pair of words is shuffled.

Within a task some hundred words, of one or many blocks, form an index: a bitset per place and letter. All
shorter words look themselves up at once and carry three bitsets along the window: the words that
agree so far, those with one letter replaced, and those with one letter more, which are read from the
bitsets of the next place. A step is a handful of operations on words of 64 bits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.text import slices
from cargolens.plans.staging import stage

#: Runs of these characters are words.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of fewer code points, or fewer occurrences, are left out.
SHORTEST, LEAST_COUNT = 5, 3
#: A run whose hash this divides loses a letter.
DAMAGE = 97
#: Words that a task counts before it passes the counts on.
HELD_WORDS = 300_000
#: A larger block is dealt to the halves of its window; an index holds about so many words.
BLOCK = 512
#: Letters of all words of an index, at most about so many.
INDEX_LETTERS = 1 << 20

_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def word_counts(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """The words of all texts as (word, n), lower-cased in A-Z only.

    A run whose unsigned crc32 of ``<doc_id>:<run>`` (UTF-8) is divisible by ``damage`` loses the code point at
    that number modulo its length. A null text has no words; a null doc_id counts as an empty one.
    Words are counted in each task before the shuffle, so that a frequent word is a few rows of each.
    """
    runs = re.compile(RUN)

    def counted(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if len(w) >= SHORTEST]
        counts.clear()
        columns = [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall((text or "").translate(_LOWER))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield counted(counts)
        yield counted(counts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= LEAST_COUNT)


#: What tells a block: length of its shorter words, begin and end of the window, hash of the letters outside it.
_BLOCK = ["short", "low", "high", "outside"]


def _in_windows(rows: DataFrame, windows: Column) -> DataFrame:
    """Rows (word, n, short) in the blocks of ``windows``, an array of (low, high)."""
    rows = rows.select("word", "n", "short", F.explode(windows).alias("w")).select("word", "n", "short", "w.*")
    head = F.substring("word", F.lit(1), F.col("low"))
    behind = F.col("short") - F.col("high")
    tail = F.substring("word", F.char_length("word") - behind + 1, behind)
    return rows.withColumn("outside", F.xxhash64("short", "low", head, F.lit("|"), tail))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    bounds = ((low, middle), (middle, high))
    return F.array(*(F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")) for a, b in bounds))


def _blocks(words: DataFrame, most: int) -> DataFrame:
    """Members of all blocks; blocks of over ``most`` words are dealt to narrower windows while that is possible."""
    length = F.char_length("word")
    # a word is among the shorter ones of its own length and among the longer ones of the length below
    shorts = F.when(length > SHORTEST, F.array(length, length - 1)).otherwise(F.array(length))
    rows = words.select("word", "n", F.explode(shorts).alias("short"))
    members = _in_windows(rows, _halves(F.lit(0), F.col("short")))
    whole = []
    while True:
        sizes = members.groupBy(_BLOCK).agg(F.count("*").alias("size"))
        large = sizes.filter((F.col("size") > most) & (F.col("high") - F.col("low") > 1)).select(_BLOCK)
        large = stage(large, "large-blocks")
        if large.isEmpty():
            break
        whole.append(members.join(large, _BLOCK, "left_anti"))
        wide = members.join(large, _BLOCK, "left_semi")
        members = stage(_in_windows(wide, _halves(F.col("low"), F.col("high"))), "narrower-blocks")
    for part in whole:
        members = members.unionByName(part)
    return members


def near_pairs(words: list[str], shorts: list[int], lows: list[int], highs: list[int], blocks: list[int]):
    """Pairs (row, row) of words one edit apart with their first difference in the window of their block.

    Rows of a block are words of length ``short`` or one more that agree outside the window. Pairs of
    two words of the same length come both ways, others with the shorter word first.
    """
    size = len(words)
    width = -(-size // 64)
    short, low, high, block = (np.array(x) for x in (shorts, lows, highs, blocks))
    longer = np.array([len(w) for w in words]) > short
    window = high - low
    steps = int(window.max())
    text = np.zeros((size, steps + 2), np.int32)  # 0: no letter
    for row, (w, a) in enumerate(zip(words, lows)):
        inside = w[a : a + steps + 1]
        text[row, : len(inside)] = np.frombuffer(inside.encode("utf-32-le"), np.int32)
    letters, numbers = np.unique(text, return_inverse=True)
    numbers = numbers.reshape(text.shape)
    rows = np.arange(size)
    bit = np.uint64(1) << (rows % 64).astype(np.uint64)

    def bitsets(kinds: np.ndarray, n: int) -> np.ndarray:
        """For each kind the set of the rows that have it."""
        out = np.zeros((n, width), np.uint64)
        np.bitwise_or.at(out, (kinds, rows // 64), bit)
        return out

    queries = np.flatnonzero(~longer)
    mates = bitsets(block, int(block.max()) + 1)[block[queries]]
    additional = bitsets(longer.astype(np.int64), 2)[1]
    numbers_q, window, last = numbers[queries], window[queries], (high == short)[queries]
    agree = mates  # the words of the block, as nothing is read yet
    replaced, more = np.zeros_like(agree), np.zeros_like(agree)
    found = np.zeros_like(agree)
    here = bitsets(numbers[:, 0], len(letters))
    for p in range(steps + 1):
        ends = np.flatnonzero(window == p)
        if len(ends):
            # a word with a letter more that agrees up to here differs later, unless the window is the last
            behind = np.where(last[ends, None], more[ends] | agree[ends], more[ends] & ~agree[ends])
            found[ends] = (replaced[ends] & ~additional) | (behind & additional)
        if p == steps:
            break
        ahead = bitsets(numbers[:, p + 1], len(letters))
        now, following = here[numbers_q[:, p]], ahead[numbers_q[:, p]]
        replaced = (replaced & now) | (agree & ~now)
        more = (more | agree) & following
        agree = agree & now
        here = ahead
    # bits back to rows
    flags = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, :size]
    left, right = np.nonzero(flags)
    return queries[left], right


def _best(words: list[str], ns: list[int], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """For each row of ``left``: how many pairs it has, and of its partners the most frequent one (ties: the smallest)."""
    n = np.array(ns, np.int64)
    place = np.zeros(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[right], -n[right], left))
    left, right = left[order], right[order]
    rows, first, count = np.unique(left, return_index=True, return_counts=True)
    best = right[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[k] for k in rows], pa.string()),
            pa.array(count, pa.int64()),
            pa.array(n[best]),
            pa.array([words[k] for k in best], pa.string()),
        ],
        names=["word", "n_near", "near_n", "near"],
    )


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members sorted by block; what ``_best`` says of the words of each index."""
    index: tuple[list, ...] = ([], [], [], [], [], [])  # word, n, short, low, high, block
    held = 0

    def results() -> Iterator[pa.RecordBatch]:
        words, ns, *places = index
        if words:
            left, right = near_pairs(words, *places)
            mixed = np.array([len(w) for w in words])
            up = mixed[left] != mixed[right]  # the longer word's side of a pair
            if len(left):
                yield _best(words, ns, np.concatenate([left, right[up]]), np.concatenate([right, left[up]]))
        for column in index:
            column.clear()

    def add(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Put the blocks of one hash into the index, which starts anew when it is full."""
        nonlocal held
        exact = defaultdict(list)
        for row in group:
            word, _, short, low, high = row
            exact[word[:low], word[len(word) - (short - high) :]].append(row)
        for rows in exact.values():
            _, _, short, low, high = rows[0]
            if len(rows) < 2 or all(len(r[0]) > short for r in rows):
                continue
            letters = len(rows) * (high - low)
            if index[0] and (len(index[0]) + len(rows) > BLOCK or held + letters > INDEX_LETTERS):
                yield from results()
                held = 0
            number = index[5][-1] + 1 if index[5] else 0
            for row in rows:
                for column, value in zip(index, (*row, number)):
                    column.append(value)
            held += letters

    group, last = [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("word", "n", "short", "low", "high", "outside")]
        for *row, outside in zip(*columns):
            key = (row[2], row[3], row[4], outside)
            if key != last:
                yield from add(group)
                group, last = [], key
            group.append(tuple(row))
    yield from add(group)
    yield from results()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: the forms' forms, followed to the last, twice as far in each round."""
    links = stage(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = links.join(beyond, "root", "left")
        step = step.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        step = stage(step, "roots")
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def variants(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """Different words (word, n) as word, n, n_near, form, form_n and root.

    Words are near if one inserted, deleted or replaced code point makes them equal; ``n_near`` counts them. A word's form is its
    near word of largest n (of equal ones the smallest by code points) if that is at least twice its own, else
    null; ``root`` follows the forms to the last and is the word itself where there is none. Forms rise
    in n, so there are no rings. Words of fewer than ``SHORTEST`` code points and null words go; repeated
    words are one, their n added up; an empty table gives an empty result.
    """
    long_enough = F.char_length("word") >= SHORTEST
    words = stage(words.filter(long_enough).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    members = _blocks(words, most).repartition(*(F.col(c) for c in _BLOCK))
    # windows of one size stand together, so that an index takes few steps in vain
    members = members.sortWithinPartitions(F.col("high") - F.col("low"), *_BLOCK)
    members = members.select("word", "n", "short", "low", "high", "outside")
    near = members.mapInArrow(_look_up, "word string, n_near long, near_n long, near string")
    near = near.withColumn("n", F.lit(None).cast("long"))
    alone = words.select(
        "word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"),
        F.lit(None).cast("string").alias("near"), "n",
    )
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("below"), F.col("near"))))
    joined = alone.unionByName(near).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")
    )
    twice = -F.col("best.below") >= 2 * F.col("n")
    forms = stage(
        joined.select(
            "word",
            "n",
            "n_near",
            F.when(twice, F.col("best.near")).alias("form"),
            F.when(twice, -F.col("best.below")).alias("form_n"),
        ),
        "variants",
    )
    return forms.join(_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of the words of ``docs`` (doc_id, text) with at least three occurrences.

    Rows that repeat a doc_id or a text all count; other columns, whatever their names, are not read.
    """
    return variants(word_counts(docs))

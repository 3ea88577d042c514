"""Repeated passages by sparse suffix arrays.

Of the suffixes of a text only those at minimiser positions are kept: the first smallest hash of
``SEED`` words within each window of ``min_words`` words. Equal windows choose equal positions, so
every passage of ``min_words`` words that occurs twice has both occurrences under one seed. A kept
suffix reaches left and right over all windows that chose it.

Suffixes are ordered by (seed, reach): neighbours with the same reach match as far as they can be
extended, so all but the first occurrence repeat as a whole. Neighbours with the same seed and
different reaches match in a part of it; one suffix of each reach is then extended window by window
to the left and right of the seed. Both comparisons are aggregates on the order keys, not walks
through a sorted run: each keeps the smallest occurrence, so a passage that stands in a third of all
texts shrinks before the shuffle, and suffixes that have no neighbour under their seed go first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import text as tx
from cargolens.llm.common import in_slots
from cargolens.llm.labelled import fresh_name
from cargolens.plans.staging import stage

MIN_WORDS = 50
#: Words that a seed hashes.
SEED = 10

_SUFFIX = "doc_id long, version int, seed long, reach long, first_word int, more int, begin int, end int"


def _words(batch_text: pa.Array):
    buf, offsets = tx.utf8(batch_text)
    starts, ends, doc = tx.runs(buf, offsets, tx.NOT_SPACE)
    chars = tx.char_positions(buf)
    base = chars[offsets[:-1]][doc] if len(doc) else doc
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return tx.word_hashes(buf, starts, ends), doc, first, chars[starts] - base, chars[ends] - base


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The kept suffixes of (doc_id, version, text).

    ``first_word`` and the ``more`` words after it start windows that chose the suffix; ``begin``
    and ``end`` are the code points that these windows span, ``reach`` hashes their words.
    """
    width = min_words - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            words, doc, first, begin, end = _words(batch.column("text"))
            seeds = tx.window_hashes(words, seed)
            order = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
            chosen = (tx.sliding_min(order, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            starts = np.flatnonzero(doc[: len(chosen)] == doc[min_words - 1 :][: len(chosen)])
            chosen = chosen[starts]
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (chosen[1:] != chosen[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
            a = starts[fresh]
            last = np.ones(len(starts), bool)
            last[:-1] = fresh[1:]
            b = starts[last]
            owner = doc[a]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)),
                    batch.column("version").take(pa.array(owner)),
                    pa.array(tx.signed(seeds[chosen[fresh]])),
                    pa.array(tx.signed(tx.span_sums(words, a, b + min_words))),
                    pa.array((a - first[owner]).astype(np.int32)),
                    pa.array((b - a).astype(np.int32)),
                    pa.array(begin[a].astype(np.int32)),
                    pa.array(end[b + min_words - 1].astype(np.int32)),
                ],
                names=[c.split()[0] for c in _SUFFIX.split(", ")],
            )

    return docs.mapInArrow(run, _SUFFIX)


def _windows(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """Each window of the ``wanted`` suffixes: seed, window hash, place and code points."""
    lists = wanted.groupBy("doc_id", "version").agg(
        F.collect_list("seed").alias("seeds"),
        F.collect_list("first_word").alias("firsts"),
        F.collect_list("more").alias("mores"),
    )
    texts = in_slots(docs, F.col("doc_id"), wanted.select("doc_id").distinct())
    rows = texts.join(lists, ["doc_id", "version"]).select(
        "doc_id", "version", "text", "seeds", "firsts", "mores"
    )
    kind = "doc_id long, version int, seed long, window long, first_word int, begin int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            words, _, first, begin, end = _words(batch.column("text"))
            lists = batch.column("firsts")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = lists.flatten().to_numpy()
            more = batch.column("mores").flatten().to_numpy()
            seeds = batch.column("seeds").flatten().to_numpy()
            each = np.repeat(np.arange(len(at)), more + 1)
            within = np.arange(len(each)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
            start = first[owner[each]] + at[each] + within
            window = tx.span_sums(words, start, start + min_words)
            rows = pa.array(owner[each])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("version").take(rows),
                    pa.array(seeds[each]),
                    pa.array(tx.signed(window)),
                    pa.array((at[each] + within).astype(np.int32)),
                    pa.array(begin[start].astype(np.int32)),
                    pa.array(end[start + min_words - 1].astype(np.int32)),
                ],
                names=[c.split()[0] for c in kind.split(", ")],
            )

    return rows.mapInArrow(run, kind)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Spans of (doc_id, text) that occur earlier: doc_id, version, start, end, source_doc_ids.

    A word is in a span when it lies in a run of ``min_words`` words that occurs at an earlier place,
    in order of doc_id, version (a hash of the text) and position; the first occurrence of a run is
    in no span. Words are separated by space and \\t \\n \\v \\f \\r and compared as they are. start
    and end are code points (end exclusive); overlapping spans are one. ``source_doc_ids`` are documents in
    which the span's runs stand earlier, one at least for each run. Shorter texts, nulls and null doc_ids give nothing.
    Equal rows count once; rows that repeat a doc_id with another text are told apart by version.
    """
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("version"), "text"
    )
    kept = stage(suffixes(docs, min_words, seed), "suffixes")
    # staged keys leave the joins with plain shuffles on both sides, which Spark can split where a
    # seed is hot
    seeds = kept.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    kept = stage(kept.join(stage(seeds, "seeds"), "seed", "left_semi"), "neighbours")
    place = F.struct("doc_id", "version", "first_word")
    reaches = stage(
        kept.groupBy("seed", "reach").agg(
            F.min(F.struct("doc_id", "version", "first_word", "more")).alias("first"),
            F.count("*").alias("n"),
        ),
        "reaches",
    )
    heads = reaches.filter("n > 1").select("seed", "reach", "first")
    whole = kept.join(heads, ["seed", "reach"]).filter(
        place != F.struct("first.doc_id", "first.version", "first.first_word")
    )
    whole = whole.select("doc_id", "version", "begin", "end", F.col("first.doc_id").alias("source"))
    mixed = reaches.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    wanted = reaches.join(stage(mixed, "mixed-seeds"), "seed", "left_semi").select("seed", "first.*")
    windows = stage(_windows(docs, stage(wanted, "mixed"), min_words), "windows")
    firsts = windows.groupBy("seed", "window").agg(
        F.min(place).alias("first"), F.count("*").alias("n")
    )
    firsts = stage(firsts.filter("n > 1").select("seed", "window", "first"), "firsts")
    part = windows.join(firsts, ["seed", "window"]).filter(place != F.col("first"))
    part = part.select("doc_id", "version", "begin", "end", F.col("first.doc_id").alias("source"))
    found = whole.unionByName(part).groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("begin", "end", "source"))).alias("found")
    )
    none = F.array().cast("array<struct<begin:int,end:int,sources:array<bigint>>>")

    def grow(spans, x):
        last = F.element_at(spans, -1)
        joined = F.struct(
            last["begin"].alias("begin"),
            F.greatest(last["end"], x["end"]).alias("end"),
            F.array_union(last["sources"], F.array(x["source"])).alias("sources"),
        )
        fresh = F.struct(
            x["begin"].alias("begin"), x["end"].alias("end"), F.array(x["source"]).alias("sources")
        )
        return F.when(
            (F.size(spans) > 0) & (x["begin"] <= last["end"]),
            F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(joined)),
        ).otherwise(F.concat(spans, F.array(fresh)))

    spans = found.select(
        "doc_id", "version", F.explode(F.aggregate("found", none, grow)).alias("s")
    )
    return spans.select(
        "doc_id",
        "version",
        F.col("s.begin").alias("start"),
        F.col("s.end").alias("end"),
        F.array_sort("s.sources").alias("source_doc_ids"),
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every span of ``repeated_passages`` cut out of ``text``; other columns stay.

    Texts without a span stay as they are. A text of which nothing but white space is left goes.
    """
    names = docs.columns
    found, doc, version = (fresh_name(docs, n) for n in ("_spans", "_doc", "_version"))
    spans = repeated_passages(docs, min_words).groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias(found)
    )
    spans = spans.select(F.col("doc_id").alias(doc), F.col("version").alias(version), found)
    whole = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def cut(state, s):
        return F.struct(
            s["end"].alias("at"),
            F.concat(
                state["kept"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
            ).alias("kept"),
        )

    rest = F.aggregate(
        F.col(found),
        whole,
        cut,
        lambda state: F.concat(
            state["kept"], F.substring(F.col("text"), state["at"] + 1, F.length("text"))
        ),
    )
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.hash("text") == F.col(version))
    joined = docs.join(spans, same, "left")
    joined = joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(rest))
    gone = F.col(found).isNotNull() & (F.regexp_replace("text", r"\s+", "") == "")
    return joined.filter(~gone).select(*names)

"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over bytes cuts each text at places that depend on the bytes around them alone, so
passages that documents share fall into equal chunks wherever they stand. A chunk's core (between
its first and last separator) is encoded once and its result kept for all later documents of the
task; the words around a cut are encoded as a join. A join is accepted only when its encoding
together with a whole word on either side agrees with the three encodings one after the other;
otherwise it takes in the cores beside it and is encoded anew, up to the whole text.

Where a vocabulary drops white space, the words of a new chunk are reused in the same manner.
What a task keeps has a fixed bound in bytes; nothing is shuffled and nothing goes to the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.text import mix, slices, utf8

#: A cut is where the low bits of the rolling hash are zero: one place in 2^9 = 512 on average.
CUT_BITS = 9
#: Bytes that the rolling hash sees.
WINDOW = 16
#: Bytes of chunk text (in two generations) and words that a task remembers.
KEEP_BYTES = 16 << 20
KEEP_WORDS = 500_000
LINE_WORDS = 200
#: Characters that normalisation may join, split or move, and special tokens.
_RARE = re.compile("[^\x00-\u024f]|\u0130|<\\|")

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_places(buf: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Byte places where a chunk may end: functions of the ``WINDOW`` bytes before them."""
    rolled, reach = _GEAR[buf], 1
    while reach < WINDOW:
        wider = rolled.copy()
        wider[reach:] += rolled[:-reach] << np.uint32(reach)
        rolled, reach = wider, 2 * reach
    rolled ^= rolled >> np.uint32(15)
    return np.flatnonzero((rolled & np.uint32((1 << bits) - 1)) == 0) + 1


class _Pieces:
    """Byte strings by number, written one after the other without a loop over them."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings) or b" ", np.uint8)

    def joined(self, numbers: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """For each row of ``numbers`` its strings joined by one space."""
        sizes = self.sizes[numbers] + 1
        filled = offsets[1:][np.diff(offsets) > 0]
        sizes[filled - 1] -= 1  # no space behind a row's last string
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(ends[-1], 0x20, np.uint8)
        at, source, left = ends[:-1], self.begins[numbers], self.sizes[numbers]
        while len(at):
            some = left > 0
            at, source, left = at[some], source[some], left[some]
            out[at] = self.data[source]
            at, source, left = at + 1, source + 1, left - 1
        places = pa.py_buffer(ends[offsets].astype(np.int32))
        return pa.StringArray.from_buffers(len(offsets) - 1, places, pa.py_buffer(out))


class ChunkEncoder:
    """Encodes texts through remembered chunks; one lives in each Python worker."""

    def __init__(self, path: str, bits: int = CUT_BITS, keep: int = KEEP_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits, self.keep = bits, keep
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.numbers = _Pieces([str(i).encode() for i in range(size)])
        self.strings = _Pieces([(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)])
        self.joins_tokens = self.tokenizer.decoder is None
        drops = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in (" ", "\n", "\t")]
        self.by_words = not any(drops)
        # pieces with their ids as bytes, four to an id
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self._forget_words()
        self.held = 0
        self.encoded_bytes = 0
        self.widened = 0

    def _forget_words(self) -> None:
        self.words: dict[bytes, int] = {}
        self.word_ids = np.zeros(0, np.uint32)
        self.word_ends = np.zeros(1, np.int64)

    def _encode(self, pieces: set[bytes]) -> None:
        """Encode the pieces that are not remembered, in one call."""
        missing = []
        for piece in pieces:
            if piece not in self.young:
                known = self.old.get(piece)
                if known is None:
                    missing.append(piece)
                else:
                    self._remember(piece, known)
        if not missing:
            return
        for piece, value in zip(missing, self._new(missing)):
            self._remember(piece, value)
            self.encoded_bytes += len(piece)

    def _plain(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, straight from the tokenizer."""
        texts = [p.decode("utf-8") for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in some order, how many ids each has, and all ids.

        Words of common characters go to the tokenizer some ``LINE_WORDS`` at a time; white space
        between them is dropped, and the place of each id tells its word.
        """
        texts = [w.decode("utf-8") for w in words]
        rare = [_RARE.search(t) is not None for t in texts]
        common = [t for t, r in zip(texts, rare) if not r]
        lines = [common[i : i + LINE_WORDS] for i in range(0, len(common), LINE_WORDS)]
        sizes, ids = [], []
        encoded = self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)
        for line, e in zip(lines, encoded):
            begins = np.cumsum([0] + [len(t) + 1 for t in line])
            places = np.fromiter((p[0] for p in e.offsets), np.int64)
            sizes.append(np.diff(np.searchsorted(places, begins)))
            ids.append(np.array(e.ids, np.uint32))
        odd = [w for w, r in zip(words, rare) if r]
        for found in self._plain(odd):
            sizes.append(np.array([len(found)]))
            ids.append(np.array(found, np.uint32))
        order = [w for w, r in zip(words, rare) if not r] + odd
        return order, np.concatenate(sizes), np.concatenate(ids)

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [np.array(ids, np.uint32).tobytes() for ids in self._plain(pieces)]
        if len(self.words) > KEEP_WORDS:
            self._forget_words()
        split = [p.split() for p in pieces]
        flat = list(chain.from_iterable(split))
        missing = list(set(flat).difference(self.words))
        if missing:
            words, sizes, ids = self._word_ids(missing)
            self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
            self.word_ends = np.concatenate([self.word_ends, self.word_ends[-1] + np.cumsum(sizes)])
            self.word_ids = np.concatenate([self.word_ids, ids])
        number = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        begins, sizes = self.word_ends[number], self.word_ends[number + 1] - self.word_ends[number]
        ends = np.cumsum(sizes)
        ids = self.word_ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(sizes.sum())]
        cuts = 4 * np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in split])])]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def _remember(self, piece: bytes, value: bytes) -> None:
        self.young[piece] = value
        self.held += len(piece) + 64

    def _turn_over(self) -> None:
        if self.held > self.keep // 2:
            self.old, self.young, self.held = self.young, {}, 0

    def _plan(self, buf: np.ndarray, offsets: np.ndarray) -> list[list[tuple[bytes, bool]]]:
        """Each text as pieces (bytes, is it a join): joins stand around cuts, cores between them."""
        data = buf.tobytes()
        cuts = cut_places(buf, self.bits)
        separators = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
        owner = np.searchsorted(offsets, cuts - 1, "right") - 1
        begin, end = offsets[owner], offsets[owner + 1]
        cuts, begin, end = (x[cuts < end] for x in (cuts, begin, end))
        owner = np.searchsorted(offsets, cuts, "right") - 1
        places = np.concatenate([[-1], separators, [len(buf)]])
        at = np.searchsorted(separators, cuts)
        left = np.maximum(places[at], begin)
        right = np.minimum(places[at + 1], end)
        plans: list[list[tuple[bytes, bool]]] = []
        first = np.searchsorted(owner, np.arange(len(offsets)))
        for doc in range(len(offsets) - 1):
            start, stop = int(offsets[doc]), int(offsets[doc + 1])
            plan, done = [], start
            span: list[int] | None = None
            for k in range(first[doc], first[doc + 1]):
                a, b = int(left[k]), int(right[k])
                if span and a <= span[1]:
                    span[1] = max(span[1], b)
                    continue
                if span:
                    plan.append((data[done : span[0]], False))
                    plan.append((data[span[0] : span[1]], True))
                    done = span[1]
                span = [a, b]
            if span:
                plan.append((data[done : span[0]], False))
                plan.append((data[span[0] : span[1]], True))
                done = span[1]
            plan.append((data[done:stop], False))
            plans.append(plan)
        return plans

    @staticmethod
    def _last_word(core: bytes) -> bytes:
        return core[max(core.rfind(b" "), core.rfind(b"\n"), 0) :]

    @staticmethod
    def _first_word(core: bytes) -> bytes:
        ends = [x for x in (core.find(b" ", 1), core.find(b"\n", 1)) if x > 0]
        return core[: min(ends, default=len(core))]

    def _agreed(self, plan: list[tuple[bytes, bool]]) -> list[bytes]:
        """The pieces of a text, joins widened until they agree with what stands beside them."""
        pieces = [p for p, _ in plan]
        k = 1
        while k < len(pieces) - 1:
            a, b = self._last_word(pieces[k - 1]), self._first_word(pieces[k + 1])
            self._encode({a, pieces[k], b, a + pieces[k] + b})
            known = self.young
            if known[a] + known[pieces[k]] + known[b] == known[a + pieces[k] + b]:
                k += 2
            else:
                self.widened += 1
                pieces[k - 1 : k + 2] = [pieces[k - 1] + pieces[k] + pieces[k + 1]]
                k = max(1, k - 2)
        return pieces

    def run(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """For each text: how many ids, the ids in decimal joined by spaces, the decoded text."""
        buf, offsets = utf8(texts)
        plans = self._plan(buf, offsets)
        wanted = set()
        for plan in plans:
            for k, (piece, join) in enumerate(plan):
                wanted.add(piece)
                if join:
                    a, b = self._last_word(plan[k - 1][0]), self._first_word(plan[k + 1][0])
                    wanted.update((a, b, a + piece + b))
        self._encode(wanted)
        rows = []
        for plan in plans:
            pieces = self._agreed(plan) if len(plan) > 1 else [plan[0][0]]
            self._encode(set(pieces))
            rows.append(b"".join(map(self.young.__getitem__, pieces)))
        self._turn_over()
        counts = np.array([len(r) // 4 for r in rows], np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.frombuffer(b"".join(rows), np.uint32).astype(np.int64)
        if self.joins_tokens:
            decoded = self.strings.joined(ids, ends)
        else:
            lists = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
            decoded = pa.array([self.tokenizer.decode(x, skip_special_tokens=False) for x in lists])
        return pa.array(counts), self.numbers.joined(ids, ends), decoded


_encoders: dict[tuple, ChunkEncoder] = {}


def encode(docs: DataFrame, path: str, bits: int = CUT_BITS) -> DataFrame:
    """Documents (doc_id, text) as doc_id, n_tokens, ids (decimal, joined by one space), decoded.

    Exactly what ``tokenizers`` gives for the vocabulary file ``path`` without truncation, padding
    or added special tokens, and what its ``decode`` makes of the ids, special ones included. A null
    text is empty and has no ids; repeated rows stay; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, bits) not in _encoders:
            _encoders[path, bits] = ChunkEncoder(path, bits)
        encoder = _encoders[path, bits]
        for batch in slices(batches, "text", 2 << 20):
            numbers, ids, decoded = encoder.run(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), numbers, ids, decoded],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids string, decoded string"
    )


def id_arrays(encoded: DataFrame) -> DataFrame:
    """The same rows with ``ids`` as an array of int."""
    none = F.array().cast("array<int>")
    ids = F.when(F.col("n_tokens") == 0, none).otherwise(F.split("ids", " ").cast("array<int>"))
    return encoded.withColumn("ids", ids)


def encoded_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of encoding ``docs`` with the public vocabulary with word ends."""
    import public_tokenizers as P

    return encode(docs, P.path("word_bpe_49k.json")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

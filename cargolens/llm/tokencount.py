"""Token counts by a finite-state machine compiled from a byte-level BPE vocabulary.

The machine reads bytes and keeps, for each place where a later token may still begin, the node of
the vocabulary's trie that the bytes since then have reached, the last token of the encoding that ends
there, and how many tokens that encoding has, counted from the present place. One more byte
decides the last token of the longer prefix: the longest one that ends here and stands beside the
last token at its begin without a merge across their border. Each transition carries by how much
the count of the prefix changes, so the sum over a text is its number of tokens. States and
transitions are compiled when a text first reaches them and live as long as the Python worker; above
``MOST_STATES`` the table starts anew, so its memory is bounded.

The pattern that splits a text before BPE is a machine whose state is the last three characters and the next two:
its marks are found for all characters at once, and at each mark the BPE machine starts over.

A batch of texts is cut into chunks of equal size, which all step through the machine side by side.
A chunk with a mark maps every entry state to one exit state; a prefix scan over those maps gives each
chunk's entry. What stands before a chunk's first mark runs from there. Chunks without a mark (within
one long word) are maps by entry state, kept for equal chunks, and are composed one after the other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.text import mix, slices, utf8

#: Most states of a worker's table, 1 KB each.
MOST_STATES = 1 << 17
#: Bytes of a chunk, and of the texts that step through the machine together.
CHUNK = 64
BATCH_BYTES = 4 << 20
#: Parallel rounds before chunks inside one long piece are composed one after the other.
ROUNDS = 4
#: Chunk maps by entry state that are kept for equal chunks.
MOST_MAPS = 4096

# classes of characters in the pattern
_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE, _EDGE = range(6)
# machine states: nothing known yet, begin of a piece
_UNKNOWN, _START = 0, 1


def _ragged(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


#: Letters behind an apostrophe that make a piece of their own (fixed by the pattern).
_SHORT = "stmd"
_LONG = ("re", "ve", "ll")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """The class of each code point, by the regular expressions of the library itself."""
    from tokenizers import Regex, normalizers

    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    text = "".join(map(chr, points))
    codes = np.array(points)
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind, mark in ((r"\p{L}", _LETTER, "0"), (r"\p{N}", _NUMBER, "a"), (r"\s", _BLANK, "a")):
        marked = normalizers.Replace(Regex(pattern), mark).normalize_str(text)
        there = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
        out[codes[there != codes]] = kind
    out[0x20] = _SPACE
    return out


class LongTable:
    """Non-negative longs with a number each: an open hash table that many lookups read at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self._mask = np.int64((1 << (4 * len(keys) + 8).bit_length()) - 1)
        self._keys = np.full(int(self._mask) + 1, -1, np.int64)
        self._values = np.full(int(self._mask) + 1, -1, np.int32)
        place = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self._keys[place] < 0)
            self._keys[place[free]] = keys[free]  # of several for one place the last stays
            mine = self._keys[place] == keys
            self._values[place[mine]] = values[mine]
            keys, values, place = keys[~mine], values[~mine], (place[~mine] + 1) & self._mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(8)).astype(np.int64) & self._mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        place = self._place(keys)
        seen, out = self._keys[place], self._values[place]
        again = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(again):
            place[again] = (place[again] + 1) & self._mask
            seen = self._keys[place[again]]
            out[again] = self._values[place[again]]
            out[again[seen < 0]] = -1
            again = again[(seen != keys[again]) & (seen >= 0)]
        return out


class Vocabulary:
    """A byte-level BPE vocabulary: its trie, and which tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True)
        if not plain or split.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is no byte-level BPE vocabulary with the usual pattern")
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        letters, number = byte_alphabet(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        parts = np.array([(number[a], number[b], number[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self._rank = LongTable(parts[:, 0] << 32 | parts[:, 1], np.arange(len(parts)))
        size = max(number.values()) + 1
        self._made = np.full(size, -1, np.int64)  # the merge that makes a token, and its parts
        self._left, self._right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self._made[parts[:, 2]] = np.arange(len(parts))
        self._left[parts[:, 2]], self._right[parts[:, 2]] = parts[:, 0], parts[:, 1]
        child: dict[int, int] = {}  # node * 256 + byte: node
        token = [-1]
        for text, t in number.items():
            if self._made[t] < 0 and len(text) > 1:
                continue  # a string that no merge makes
            node = 0
            for c in text:
                key = node << 8 | letters[c]
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(token)
                    token.append(-1)
            token[node] = t
        keys = np.fromiter(child, np.int64, len(child))
        self.child = LongTable(keys, np.fromiter(child.values(), np.int64, len(child)))
        self.token = np.array(token)
        self.inner = np.zeros(len(token), bool)
        self.inner[keys >> 8] = True

    def beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of tokens: does the encoding of both strings joined consist of these two?

        Going back in time, the younger side falls into its parts. While two parts face each other,
        a merge of them must not come before the merge that used one of them up; of equal merges the
        left one comes first.
        """
        good = np.ones(len(left), bool)
        at, until = np.arange(len(left)), np.full(len(left), 1 << 40)
        while len(at):
            merge = self._rank.get(left << 32 | right)
            bad = (merge >= 0) & (2 * merge < until)
            good[at[bad]] = False
            a, b = self._made[left], self._made[right]
            on = ~bad & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            undo = a > b
            until = np.where(undo, 2 * a, 2 * b + 1)
            left, right = np.where(undo, self._right[left], left), np.where(undo, right, self._left[right])
        return good


class CountingMachine:
    """The machine with its table of transitions; one lives in each Python worker."""

    def __init__(self, path: str, chunk: int = CHUNK, most_states: int = MOST_STATES):
        self.vocabulary = Vocabulary(path)
        self.classes = character_classes()
        self.chunk, self.most_states = chunk, most_states
        self.special = re.compile(b"|".join(re.escape(s) for s in sorted(self.vocabulary.specials, key=len)[::-1]))
        self.forgotten = 0
        self._begin()

    def _begin(self) -> None:
        self.numbers: dict[bytes, int] = {}
        # entries (node, last token, count) of all states, one state after the other
        self.entries = np.zeros((4096, 3), np.int32)
        self.ends = np.zeros(1024, np.int64)
        self.size = 0
        # next state * 256 + change of the count + 128, or -1 where not compiled yet
        self.table = np.full((1024, 256), -1, np.int32)
        self.maps: dict[tuple[int, bytes], tuple[int, np.ndarray]] = {}
        self._intern(np.array([[0, -2, 0], [0, -1, 0]], np.int32), np.array([0, 1, 2]))
        self.table[_UNKNOWN] = _UNKNOWN << 8 | 128

    def _intern(self, entries: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The numbers of states given by their entries; new ones are added."""
        data, width = entries.tobytes(), entries.itemsize * 3
        places = (cuts * width).tolist()
        out, fresh = [], []
        for k, (a, b) in enumerate(zip(places, places[1:])):
            n = self.numbers.get(data[a:b])
            if n is None:
                n = self.numbers[data[a:b]] = self.size + len(fresh)
                fresh.append(k)
            out.append(n)
        if fresh:
            chosen = np.array(fresh)
            lengths = cuts[chosen + 1] - cuts[chosen]
            had = int(self.ends[self.size - 1]) if self.size else 0
            ends = had + np.cumsum(lengths)
            while ends[-1] > len(self.entries):
                self.entries = np.concatenate([self.entries, np.zeros_like(self.entries)])
            while self.size + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.entries[had : ends[-1]] = entries[_ragged(cuts[chosen], lengths)]
            self.ends[self.size : self.size + len(fresh)] = ends
            self.size += len(fresh)
        return np.array(out, np.int64)

    def _entries_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of states, and how many each has."""
        begins = np.where(numbers > 0, self.ends[numbers - 1], 0)
        lengths = self.ends[numbers] - begins
        return self.entries[_ragged(begins, lengths)], lengths

    def _compile(self, numbers: np.ndarray, bytes_: np.ndarray) -> None:
        """Fill in transitions (state, byte), all at once."""
        voc, n = self.vocabulary, len(numbers)
        entries, lengths = self._entries_of(numbers)
        owner = np.repeat(np.arange(n), lengths)
        there = voc.child.get(entries[:, 0].astype(np.int64) << 8 | bytes_[owner])
        on = there >= 0
        there, owner, entries = there[on], owner[on], entries[on]
        # a state's entries stand by their begin, so its first possible token is the longest
        token, last = voc.token[there], entries[:, 1].astype(np.int64)
        fits = np.flatnonzero(token >= 0)
        paired = last[fits] >= 0
        paired[paired] = ~voc.beside(last[fits][paired], token[fits][paired])
        fits = fits[~paired]
        first = fits[np.searchsorted(owner[fits], np.arange(n))]
        change = entries[first, 2] + 1
        # places where a longer token may begin stay, the end joins them
        stay = np.flatnonzero(voc.inner[there])
        sizes = np.bincount(owner[stay], minlength=n) + 1
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        ahead = np.zeros((cuts[-1], 3), np.int32)
        places = np.arange(len(stay)) + owner[stay]
        ahead[places, 0], ahead[places, 1] = there[stay], entries[stay, 1]
        ahead[places, 2] = entries[stay, 2] - change[owner[stay]]
        ahead[cuts[1:] - 1, 1] = token[first]
        states = self._intern(ahead, cuts)
        self.table[numbers, bytes_] = states << 8 | change + 128

    def _room(self, live: list[np.ndarray]) -> bool:
        """Start a new table when the present one is full; states in ``live`` get their new numbers."""
        if self.size < self.most_states:
            return False
        found = [np.unique(numbers, return_inverse=True) for numbers in live]
        kept = [self._entries_of(distinct) for distinct, _ in found]
        self.forgotten += 1
        self._begin()
        for numbers, (_, where), (entries, lengths) in zip(live, found, kept):
            numbers[:] = self._intern(entries, np.concatenate([[0], np.cumsum(lengths)]))[where]
        return True

    def _step(self, at: np.ndarray, bytes_: np.ndarray, live: list[np.ndarray]) -> np.ndarray:
        """The transitions of many states at once; missing ones are compiled first."""
        values = self.table[at, bytes_]
        missing = np.flatnonzero(values < 0)
        if len(missing):
            if self._room([at, *live]):
                missing = np.arange(len(at))
            pairs = np.unique(at[missing] << 8 | bytes_[missing])
            numbers, those = pairs >> 8, pairs & 255
            new = self.table[numbers, those] < 0
            self._compile(numbers[new], those[new])
            values = self.table[at, bytes_]
        return values

    def marks(self, buf: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Where a piece of the pattern begins, for segments that begin at ``borders``."""
        out = np.zeros(len(buf), bool)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        lead = buf[at].astype(np.int32)
        points = lead.copy()
        for size, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            low = (0, 0, 0xC0, 0xE0, 0xF0)[size]
            those = np.flatnonzero((lead >= low) & (lead < (0, 0, 0xE0, 0xF0, 0x100)[size]))
            value = lead[those] & mask
            for k in range(1, size):
                value = value << 6 | (buf[at[those] + k] & 0x3F)
            points[those] = value
        kind = self.classes[points]
        first = np.zeros(len(at) + 1, bool)
        first[np.searchsorted(at, borders[borders < len(buf)])] = True
        first[-1] = True
        before = np.concatenate([[_EDGE], kind[:-1]])
        before[first[:-1]] = _EDGE
        after = np.concatenate([kind[1:], [_EDGE]])
        after[first[1:]] = _EDGE
        blank, blank_before = kind >= _BLANK, (before == _BLANK) | (before == _SPACE)
        # of a run of white space the last character stands alone or goes with what follows
        inside = blank & blank_before & ((after == _EDGE) | (after >= _BLANK))
        begins = np.where(blank, ~inside, (kind != before) & (before != _SPACE))
        begins |= before == _EDGE
        # an apostrophe that begins a piece may take one or two letters
        quote = (points == 0x27) & ((before == _EDGE) | (before == _LETTER) | (before == _NUMBER) | (before == _BLANK))
        for quotes, size in self._contractions(points, first, np.flatnonzero(quote)):
            begins[quotes + 1] = False
            ends = quotes + size
            begins[ends[ends < len(begins)]] = True
        out[at[begins]] = True
        return out

    @staticmethod
    def _contractions(points: np.ndarray, first: np.ndarray, quotes: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Apostrophes (numbers of characters) with one letter behind, and with two."""
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[quotes + 1], padded[quotes + 2]
        ends = np.concatenate([first, [True]])
        near, far = ends[quotes + 1], ends[quotes + 2]
        short = ~near & np.isin(one, [ord(c) for c in _SHORT])
        long = np.zeros(len(quotes), bool)
        for pair in _LONG:
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        return [(quotes[short], 2), (quotes[long & ~near & ~far], 3)]

    def changes(self, buf: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """By how much each byte changes the number of tokens."""
        size, n = self.chunk, -(-len(buf) // self.chunk)
        data = np.zeros((n, size), np.uint8)
        data.ravel()[: len(buf)] = buf
        starts = np.zeros((n, size), bool)
        starts.ravel()[: len(buf)] = marks
        length = np.full(n, size)
        length[-1] = len(buf) - size * (n - 1)
        marked = starts.any(1)
        head = np.where(marked, starts.argmax(1), length)
        out = np.zeros((n, size), np.int16)

        # from each chunk's first mark on the map is constant; a chunk without one starts by a guess
        exits = np.where(marked, _UNKNOWN, _START)
        columns, rows = np.ascontiguousarray(data.T), np.ascontiguousarray(starts.T)
        weights = np.zeros((size, n), np.int16)
        for t in range(size):
            exits[rows[t]] = _START
            values = self._step(exits, columns[t], [])
            exits = (values >> 8).astype(np.int64)
            weights[t] = (values & 255) - 128
        out += weights.T

        # what stands before a chunk's first mark enters with the exit of the chunk before; where the
        # exit of a chunk without marks turns out to be another one, its successor runs again
        heads = np.flatnonzero(head > 0)
        entered = np.full(n, _UNKNOWN)
        for _ in range(ROUNDS):
            again = heads[entered[heads] != exits[heads - 1]]
            if not len(again):
                break
            entered[again] = exits[again - 1]
            again = again[np.argsort(-head[again], kind="stable")]
            left, now = head[again], entered[again]
            for t in range(int(left[0])):
                active = int(np.searchsorted(-left, -t, "left"))
                states = now[:active].copy()
                values = self._step(states, data[again[:active], t], [now, exits, entered])
                now[:active] = values >> 8
                out[again[:active], t] = (values & 255) - 128
            whole = ~marked[again]
            exits[again[whole]] = now[whole]
        # the rest, in order, by the chunk's map at its entry
        for k in heads.tolist():
            if entered[k] != exits[k - 1]:
                self._compose(k, data, head, marked, exits, entered, out)
        return out.ravel()[: len(buf)]

    def _compose(self, k, data, head, marked, exits, entered, out) -> None:
        """Run chunk ``k`` up to its first mark from the exit of the chunk before."""
        entered[k] = exits[k - 1]
        state, changes = self._mapped(int(exits[k - 1]), data[k, : head[k]].tobytes(), [exits, entered])
        out[k, : head[k]] = changes
        if not marked[k]:
            exits[k] = state

    def _mapped(self, state: int, data: bytes, live: list[np.ndarray]) -> tuple[int, np.ndarray]:
        """The map of a chunk without a mark at one entry state: exit state and changes."""
        known = self.maps.get((state, data))
        if known is not None:
            return known
        begin, full, changes = state, self.forgotten, []
        for byte in data:
            value = int(self.table[state, byte])
            if value < 0:
                value = int(self._step(np.array([state]), np.array([byte]), live)[0])
            changes.append((value & 255) - 128)
            state = value >> 8
        found = state, np.array(changes, np.int16)
        if full == self.forgotten:
            if len(self.maps) >= MOST_MAPS:
                self.maps.clear()
            self.maps[begin, data] = found
        return found

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; null counts as empty."""
        buf, offsets = utf8(texts)
        if not len(buf):
            return np.zeros(len(offsets) - 1, np.int64)
        specials = self._specials(buf, offsets)
        borders = np.unique(np.concatenate([offsets[:-1], specials.ravel()]))
        changes = self.changes(buf, self.marks(buf, borders)).astype(np.int64)
        for begin, end in specials.tolist():
            changes[begin:end] = 0
            changes[begin] = 1
        total = np.concatenate([[0], np.cumsum(changes)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def _specials(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Begin and end of each special string inside a text, leftmost first."""
        data, found = buf.tobytes(), []
        if self.special.pattern:
            at = self.special.search(data)
            while at:
                text = np.searchsorted(offsets, at.start(), "right")
                whole = at.end() <= offsets[text]  # else it begins in one text and ends in the next
                if whole:
                    found.append(at.span())
                at = self.special.search(data, at.end() if whole else at.start() + 1)
        return np.array(found, np.int64).reshape(-1, 2)


_machines: dict[str, CountingMachine] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Documents (doc_id, text) as doc_id, n_bytes (UTF-8) and n_tokens.

    ``n_tokens`` is the length of what ``tokenizers`` gives for the byte-level BPE vocabulary file
    ``path`` without added special tokens, truncation or padding; special strings inside a text are one token
    each. A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids stay; other columns, whatever
    their names, are not read; an empty table gives an empty result. Rows are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _machines:
            _machines[path] = CountingMachine(path)
        machine = _machines[path]
        for batch in slices(batches, "text", BATCH_BYTES):
            counts = machine.count(batch.column("text"))
            sizes = np.diff(utf8(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )


def token_counts(docs: DataFrame, limit: int = 512) -> DataFrame:
    """The counts of ``docs`` with the public byte-level vocabulary, and whether they exceed ``limit``."""
    import public_tokenizers as P

    counts = count_tokens(docs, P.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cargolens.llm import tokencount as T

PATH = P.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return T.CountingMachine(PATH)


def odd_texts(n):
    rng = random.Random(13)
    pieces = [chr(x) for x in range(1, 0x250)]
    pieces += [" ", "\n", "\t", "\xa0", "́", "　", "'s", "'re", "'", "''", SPECIAL, "  ", "a", "é", "😀", "中文", "²", "1"] * 40
    short = ["'", "s", "t", "re", "ve", "ll", "r", "a", " ", "1", "!", "\n", SPECIAL, SPECIAL[:5]]
    anything = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(n)]
    texts += ["".join(rng.choices(short, k=rng.randrange(30))) for _ in range(n)]
    texts += ["".join(map(chr, rng.choices(anything, k=30))) for _ in range(n)]
    texts += ["".join(rng.choices("abcdehilnorst", k=rng.randrange(900))) for _ in range(n // 10)]
    texts += [c * k for c in ("x", " ", "\n", "ab", "é", "-", "中", "A ") for k in (1, 5000)]
    return [*texts, "", None, SPECIAL[:6], SPECIAL[6:], SPECIAL * 3, f" {SPECIAL} \n", f"  {SPECIAL}'s"]


def expected(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_agrees_with_the_library(library, machine):
    texts = odd_texts(800)
    assert machine.count(pa.array(texts, pa.string())).tolist() == expected(library, texts)


@pytest.mark.parametrize(("chunk", "states"), [(1, 1 << 17), (7, 300), (64, 300), (1000, 1 << 17)])
def test_chunks_and_forgotten_states_change_nothing(library, chunk, states):
    machine = T.CountingMachine(PATH, chunk, states)
    texts = odd_texts(60)
    for _ in range(2):
        assert machine.count(pa.array(texts, pa.string())).tolist() == expected(library, texts)
    assert (machine.forgotten > 0) == (states == 300)
    assert machine.size < states + 5000


def test_neighbours_by_the_library(library):
    """Two tokens stand side by side where the library leaves them so."""
    voc, rng = T.Vocabulary(PATH), np.random.default_rng(3)
    made = np.flatnonzero(voc._made >= 0)
    left, right = rng.choice(made, 3000), rng.choice(made, 3000)
    names = {v: k for k, v in library.get_vocab().items()}
    letters = T.byte_alphabet()
    for a, b, fits in zip(left.tolist(), right.tolist(), voc.beside(left, right).tolist()):
        text = bytes(letters[c] for c in names[a] + names[b]).decode("utf-8", "replace")
        if text.isalpha() and text.isascii():
            assert fits == (library.encode(text).ids == [a, b])


def test_long_words_without_a_mark(library, machine):
    rng = random.Random(5)
    texts = ["x" * 300_001, "".join(rng.choices("abcdefgh", k=50_000)), "".join(rng.choices("的一是不了人我在有他", k=20_000))]
    assert machine.count(pa.array(texts)).tolist() == expected(library, texts)


def test_query_over_the_whole_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd_texts(100))], "doc_id long, text string")
    docs = docs.unionByName(odd)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = T.token_counts(docs).collect()
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_rows_and_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b", 5), (1, "a b", 5), (1, "c", 0), (None, None, 6), (2, "", 1)], "doc_id int, text string, n_tokens int"
    )
    rows = T.token_counts(docs).collect()
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows)
    assert found == [(-1, 0, 0), (1, 1, 1), (1, 3, 2), (1, 3, 2), (2, 0, 0)]
    assert T.token_counts(docs.limit(0)).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        T.Vocabulary(P.path("word_bpe_49k.json"))

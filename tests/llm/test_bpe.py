import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cargolens.llm import bpe

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def odd_texts(n):
    rng = random.Random(8)
    letters = [chr(x) for x in range(1, 0x250)]
    letters += [" ", "\n", "\t", "\xa0", "́", "　", "Σ", "İ", "'s", "<|endoftext|>", "  ", "a", "é", "😀", "中文", "한"] * 40
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", None, "x" * 50_000]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("bits", (1, 3, 9))
def test_agrees_with_the_library(name, bits):
    exact, encoder = Tokenizer.from_file(P.path(name)), bpe.ChunkEncoder(P.path(name), bits)
    texts = odd_texts(1500)
    numbers, ids, decoded = (x.to_pylist() for x in encoder.run(pa.array(texts, pa.string())))
    for text, n, found, back in zip(texts, numbers, ids, decoded):
        expected = exact.encode(text or "", add_special_tokens=False).ids
        assert found == " ".join(map(str, expected)) and n == len(expected)
        assert back == exact.decode(expected, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    passage = " ".join(words)
    texts = [f"{' '.join(rng.choices(words, k=5))} {passage}" for _ in range(20)]
    encoder = bpe.ChunkEncoder(P.path(NAMES[0]))
    encoder.run(pa.array(texts))
    assert encoder.encoded_bytes < 2.5 * len(passage)
    # what is remembered stays within its bound
    small = bpe.ChunkEncoder(P.path(NAMES[0]), keep=20_000)
    for text in texts:
        small.run(pa.array([text + str(rng.random())]))
    assert small.held < 40_000 + len(passage)


def test_joins_widen_until_they_agree():
    encoder = bpe.ChunkEncoder(P.path(NAMES[1]), 1)
    texts = ["a \n b\n\n c  d   e" * 50, " \n \n" * 200]
    _, ids, _ = encoder.run(pa.array(texts))
    exact = Tokenizer.from_file(P.path(NAMES[1]))
    assert ids.to_pylist() == [" ".join(map(str, exact.encode(t).ids)) for t in texts]
    assert encoder.widened > 0


def test_query_over_the_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd_texts(200))], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    exact = Tokenizer.from_file(P.path(NAMES[0]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = bpe.encoded_digest(docs).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = exact.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        back = exact.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 6)], "doc_id long, text string, ids int")
    rows = bpe.id_arrays(bpe.encode(docs, P.path(NAMES[0]))).orderBy("doc_id").collect()
    assert [(r["doc_id"], len(r["ids"])) for r in rows] == [(None, 0), (1, 2), (1, 2)]
    assert bpe.encode(docs.limit(0), P.path(NAMES[0])).count() == 0

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from cargolens.llm import editprint


def share(a, b):
    d = editprint.DIGITS
    return sum(a[i : i + d] == b[i : i + d] for i in range(0, len(a), d)) / editprint.SLOTS


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_likeness_falls_with_edits():
    rng = random.Random(6)
    for n in (60, 400, 4000):
        text = words(rng, n)
        likes = []
        for part in (0, 0.005, 0.05, 0.3):
            letters = list(text)
            for _ in range(int(part * len(text))):
                i = rng.randrange(len(letters))
                letters[i] = rng.choice(["", "Z", letters[i] + "Q"])
            likes.append(share(*editprint.fingerprint_array(pa.array([text, "".join(letters)]))))
        assert likes[0] == 1 and likes[0] >= likes[1] >= likes[2] >= likes[3] and likes[1] > 0.3
        assert share(*editprint.fingerprint_array(pa.array([text, words(rng, n)]))) < 0.15


def test_insertions_do_not_shift_the_rest():
    text = words(random.Random(1), 2000)
    assert share(*editprint.fingerprint_array(pa.array([text, "new " + text[:5000] + " xyz " + text[5000:]]))) > 0.85


def test_equal_texts_wherever_they_stand():
    rng = random.Random(2)
    texts = [words(rng, rng.randint(0, 300)) for _ in range(40)] + ["", "a", "é中😀" * 50, " " * 5000]
    alone = [editprint.fingerprint_array(pa.array([t]))[0] for t in texts]
    assert editprint.fingerprint_array(pa.array(texts[::-1]))[::-1] == alone
    assert editprint.fingerprint_array(pa.array([None, ""], pa.string())) == ["-" * 256] * 2


def test_query_over_the_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(5)
    rows = editprint.edited_digest(docs).orderBy("doc_id").collect()
    check(rows, sorted((r["doc_id"], r["text"] or "") for r in docs.collect()))
    near = [r["near_edited"] for r in rows if r["n_chars"] > 200]
    apart = [r["near_next"] for r in rows if r["n_chars"] > 200]
    assert sum(near) / len(near) > 0.45 and sorted(apart)[len(apart) * 9 // 10] < 0.1


def check(rows, texts):
    assert len(rows) == len(texts)
    prints = editprint.fingerprint_array(pa.array([t for _, t in texts]))
    for k, (r, (doc, text)) in enumerate(zip(rows, texts)):
        after = texts[(k + 1) % len(texts)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert (r["doc_id"], r["n_chars"]) == (doc, len(text))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == prints[k]
        assert r["edited_fingerprint"] == editprint.fingerprint_array(pa.array([edited]))[0]
        assert r["near_edited"] == share(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == share(r["fingerprint"], prints[(k + 1) % len(texts)])


def test_many_ranges_give_the_same_order(spark, monkeypatch):
    monkeypatch.setattr(editprint, "RANGE_BYTES", 2000)
    monkeypatch.setattr(editprint, "LEAST_BYTES", 500)
    rng = random.Random(3)
    texts = sorted((rng.randrange(10**12) - 10**11, words(rng, rng.randint(0, 40))) for _ in range(300))
    docs = spark.createDataFrame([(d, t or None, 1, 1) for d, t in texts], "doc_id long, text string, range int, tail int")
    check(editprint.edited_digest(docs.repartition(7)).orderBy("doc_id").collect(), texts)


def test_single_null_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert editprint.edited_digest(spark.createDataFrame([], kind)).count() == 0
    only = editprint.edited_digest(spark.createDataFrame([(5, "abcdefgh")], kind)).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and only["near_next"] == 1
    rows = [(None, "n" * 8), (3, "a" * 8), (3, "a" * 8), (3, "b" * 8), (4, None)]
    out = editprint.edited_digest(spark.createDataFrame(rows, kind)).collect()
    edited = sorted(["n" * 6 + "aa", "a" * 8, "a" * 6 + "bb", "b" * 6, ""])
    assert sorted(r["edited_sha256"] for r in out) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edited)


def test_similar_pairs(spark):
    rng = random.Random(9)
    base = words(rng, 500)
    texts = [(1, base), (2, base), (3, base + " and a tail"), (4, words(rng, 500))]
    prints = editprint.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"))
    pairs = {(r["doc_id"], r["other"]): r["near"] for r in editprint.similar(prints).collect()}
    assert set(pairs) == {(2, 1), (3, 1)} and pairs[(2, 1)] == 1 and pairs[(3, 1)] > 0.8
    assert prints.select(F.length("fingerprint")).distinct().collect()[0][0] == 256


def joined(ids, pairs):
    label = {d: d for d in ids}
    for a, b in pairs:
        old, new = sorted((label[a], label[b]))[::-1]
        label = {d: new if c == old else c for d, c in label.items()}
    return label


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    """Pairs right at the threshold, also in a bucket whose head refuses all, in several blocks."""
    monkeypatch.setattr(editprint, "BLOCK", 16)
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.randrange(65536):04x}" for _ in range(n)]
    passage, rows = fresh(24), {}
    for k in range(120):
        base = (passage + fresh(40)) if k % 2 else fresh(64)
        rows[2 * k] = base
        kept = set(range(24)) if k % 2 else set()  # 31 or 32 equal slots
        kept |= set(rng.sample(sorted(set(range(64)) - kept), 31 + (k // 2) % 2 - len(kept)))
        rows[2 * k + 1] = [b if i in kept else f for i, (b, f) in enumerate(zip(base, fresh(64)))]
    ids = sorted(rows)
    equal = lambda a, b: sum(x == y for x, y in zip(rows[a], rows[b]))
    pairs = [(a, b) for a in ids for b in ids if b < a and equal(a, b) >= 32]
    assert 20 < len(pairs) < 120
    prints = spark.createDataFrame([(d, "".join(s)) for d, s in rows.items()], "doc_id long, fingerprint string")
    links = editprint.similar(prints).collect()
    assert all(r["near"] == equal(r["doc_id"], r["other"]) / 64 >= 0.5 for r in links)
    assert joined(ids, [(r["doc_id"], r["other"]) for r in links]) == joined(ids, pairs)


def test_pairs_of_slots_lose_no_fingerprint_at_the_threshold():
    rng = random.Random(5)
    for least in (0.1, 0.25, 0.5, 0.56, 0.63, 0.9, 1.0):
        bands = editprint.band_pairs(least)
        for _ in range(300):
            equal = set(rng.sample(range(64), -int(-64 * least // 1)))
            assert any(a in equal and b in equal for a, b in bands)
    assert len(editprint.band_pairs(0.5)) == 35

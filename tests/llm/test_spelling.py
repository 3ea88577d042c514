import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cargolens.llm import spelling as S

KIND = "doc_id long, text string, word string, n int"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    partners = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if near(a, b):
                partners[a].append(b)
                partners[b].append(a)
    form = {}
    for w in words:
        best = min(partners[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(partners[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def found(df):
    rows = [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sample_rows(n, seed=12):
    rng = random.Random(seed)
    stems = ["receive", "colour", "anna", "naïveté", "aaaaa", "Straße", "Ünder", "abcdefghijkl", "×÷×÷×"]
    words = list(stems)
    for _ in range(400):
        w = rng.choice(words[-60:] + stems).lower()
        at = rng.randrange(len(w) + 1)
        words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeéx") + w[at:], w[:at] + rng.choice("aeéx") + w[at + 1 :]]))
    weights = [rng.paretovariate(1.5) for _ in words]
    rows = [(i, rng.choice([" ", "-", "1", "\n"]).join(rng.choices(words, weights, k=rng.randrange(40))), "w", 1) for i in range(n)]
    return [*rows, *rows[:20], (None, rows[0][1], None, 0), (7, None, None, 0), (8, "", None, 0), (9, "q" * 5000 + " ", "", 0)]


@pytest.mark.parametrize("held", [40, 300_000])
def test_counts_agree_with_plain_ones(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD_WORDS", held)
    rows = sample_rows(400)
    assert {r["word"]: r["n"] for r in S.word_counts(spark.createDataFrame(rows, KIND)).collect()} == plain_counts(rows)


@pytest.mark.parametrize("most", [4, 512])
def test_variants_agree_with_all_pairs(spark, most):
    counts = plain_counts(sample_rows(400))
    assert len(counts) > 150
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(S.variants(words, most)) == plain_variants(counts)


def test_whole_operator(spark):
    rows = sample_rows(150, seed=3)
    assert found(S.spelling_variants(spark.createDataFrame(rows, KIND))) == plain_variants(plain_counts(rows))


def test_a_block_of_alike_words_is_dealt_out(spark):
    """All words share their first half; ties in n, chains of forms and long words."""
    rng = random.Random(4)
    counts = {"prefix" + "".join(rng.choices("ab", k=7)): rng.choice([3, 3, 5, 12, 40, 100]) for _ in range(260)}
    counts |= {"z" * 300 + t: n for t, n in (("", 3), ("a", 8), ("ab", 20), ("b", 8), ("abb", 20), ("c" + "z" * 50, 4))}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    members = S._blocks(words, 16)
    sizes = members.groupBy(S._BLOCK).count()
    assert sizes.filter("high - low > 1").agg({"count": "max"}).first()[0] <= 16
    assert found(S.variants(words, 16)) == plain_variants(counts)


def test_near_pairs_of_blocks_side_by_side():
    rng = random.Random(9)
    words, shorts, lows, highs, blocks, expected = [], [], [], [], [], set()
    for block in range(60):
        s = rng.randrange(5, 9)
        low = rng.randrange(s)
        high = rng.randrange(low + 1, s + 1)
        head, tail = "".join(rng.choices("ab", k=low)), "".join(rng.choices("ab", k=s - high))
        group = {head + "".join(rng.choices("abc", k=high - low + rng.randrange(2))) + tail for _ in range(9)}
        for a in group:
            for b in group:
                if a != b and len(a) == s and near(a, b):
                    first = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
                    if low <= min(first, s - 1) < high:
                        expected.add((block, a, b))
        for w in group:
            for column, value in zip((words, shorts, lows, highs, blocks), (w, s, low, high, block)):
                column.append(value)
    left, right = S.near_pairs(words, shorts, lows, highs, blocks)
    pairs = [(blocks[i], words[i], words[j]) for i, j in zip(left, right)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_odd_vocabularies(spark):
    words = spark.createDataFrame([("alpha", 2), ("alpha", 3), ("alphas", 10), ("abc", 9), (None, 4)], "word string, n long")
    assert found(S.variants(words)) == {("alpha", 5, 1, "alphas", 10, "alphas"), ("alphas", 10, 1, None, None, "alphas")}
    assert S.spelling_variants(spark.createDataFrame([], KIND)).count() == 0
    assert S.variants(words.limit(0)).count() == 0

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from cargolens.llm import audit

KIND = "doc_id long, text string, lang string, mask int, m string"


def sample_docs(n):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)] + ["ABC", "Été", "x#", "a\x85b", "中文"]
    base = ["", None, " \n", "A", "é" * 9 + "A", "shared " * 120]
    base += [" ".join(rng.choices(words, k=rng.choice((3, 99, 100, 130, 300)))) for _ in range(n // 3)]
    base += ["same beginning " * 40 + str(i % 7) for i in range(n // 10)]
    rows = [(i, rng.choice(base), rng.choice(["de", "en", "", None]), i, "m") for i in range(n)]
    hot = "a hot text of one third " * 9
    rows += [(n + i, hot, "en", 0, None) for i in range(n // 2)]
    return rows + [(5, "repeated id", "en", 0, ""), (5, rows[5][1], "de", 0, ""), (None, hot, None, 0, ""), (None, None, "en", 0, "")]


def plain_masks(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = ""
        failed += "A" if len(words) < 100 else ""
        failed += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else ""
        failed += "D" if re.search("[#$%&*|]", t) else ""
        failed += "E" if doc_id is not None and doc_id > first[t] else ""
        out.append((doc_id, lang or "", failed))
    return out


def plain_audit(rows, labels):
    """One document after the other through each order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    figures = Counter()
    masks = plain_masks(rows)
    for doc_id, part, failed in masks:
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, order, step)
                figures[key, "redundant"] += gone and f in failed
                figures[key, "unique_fails"] += failed == f
                if not gone and f in failed:
                    gone = True
                    figures[key, "removed"] += 1
                    figures[key, "good_lost"] += doc_id in good
                    figures[key, "toxic_lost"] += doc_id in toxic
                    figures[part, f] += 1
                figures[key, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {
        (part, order, step): (*(figures[(part, order, step), x] for x in names), figures[part, order[step - 1]])
        for part in {p for _, p, _ in masks}
        for order in map("".join, permutations("ABCDE"))
        for step in range(1, 6)
    }


@pytest.mark.parametrize("held", [2000, 16 << 20])
def test_masks_agree_with_plain_ones(spark, monkeypatch, held):
    monkeypatch.setattr(audit, "HELD_BYTES", held)
    monkeypatch.setattr(audit, "RANGE_BYTES", 4000)
    rows = sample_docs(600)
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    found = Counter(tuple(r) for r in audit.failure_masks(docs).collect())
    expected = Counter((d, p, sum(1 << "ABCDE".index(f) for f in failed)) for d, p, failed in plain_masks(rows))
    assert found == expected


def test_audit_agrees_with_a_walk_through_all_orders(spark):
    rows = sample_docs(300)
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 450, 2)]
    labels = [(d, int(q), int(x)) for d, q, x in labels] + [(None, 1, 1), (4, None, 1), (4, 1, 0), (9999, 1, 1)]
    found = audit.filter_audit(
        spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in found} == plain_audit(rows, labels)
    assert len(found) == 600 * len({r["part"] for r in found})


def test_trie_against_a_dictionary():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"ab\xff", k=rng.randrange(12))) for _ in range(3000)] + [b"", b"a" * 50_000, b"a" * 49_999]
    trie, least, numbers = audit.RadixTrie(), {}, {}
    for number, t in enumerate(texts):
        doc_id = rng.choice([None, rng.randrange(1000)])
        trie.insert(t, doc_id, number)
        numbers.setdefault(t, []).append(number)
        if doc_id is not None:
            least[t] = min(least.get(t, doc_id), doc_id)
    found = list(trie.terminals())
    assert sorted(map(tuple, numbers.values())) == sorted(tuple(n) for _, n in found)
    assert all(low == least.get(texts[group[0]]) for low, group in found)


def test_keys_rise_with_texts_and_part_shared_beginnings(spark):
    texts = [f"{'the same beginning ' * 3}{i:04}" for i in range(300)] + [f"{i:04} other" for i in range(100)] + ["one text" * 9] * 200
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    keyed = rows.select("text", audit.range_key(rows, 1000).alias("key")).collect()
    pairs = sorted((r["text"], r["key"]) for r in keyed)
    assert [k for _, k in pairs] == sorted(k for _, k in pairs)
    assert all(t.startswith(k) for t, k in pairs)
    weight = Counter()
    for t, k in pairs:
        weight[k] += len(t)
    assert max(n for k, n in weight.items() if not "one text".startswith(k[:8])) <= 1000


def test_empty_tables(spark):
    docs = spark.createDataFrame([], KIND)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, 0, "")], KIND)
    rows = audit.filter_audit(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and sum(r["removed"] for r in rows) == 120

import random
import re

from cargolens.llm.suffixes import repeated_passages, without_repeats


def brute(texts: dict[int, str], size: int) -> dict[int, list[tuple[int, int, tuple]]]:
    """Spans by remembering every window of every text."""
    seen: dict[tuple, int] = {}
    out: dict[int, list] = {}
    for doc in sorted(texts):
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^ \t\n\v\f\r]+", texts[doc] or "")]
        for i in range(len(words) - size + 1):
            window = tuple(w for w, _, _ in words[i : i + size])
            if window not in seen:
                seen[window] = doc
                continue
            begin, end = words[i][1], words[i + size - 1][2]
            spans = out.setdefault(doc, [])
            if spans and begin <= spans[-1][1]:
                old = spans.pop()
                begin, source = old[0], {*old[2], seen[window]}
            else:
                source = {seen[window]}
            spans.append((begin, end, tuple(sorted(source))))
    return out


def found(spark, texts, size, seed):
    docs = spark.createDataFrame(
        [(d, t, "x") for d, t in texts.items()], "doc_id long, text string, version string"
    ).repartition(3)
    out: dict[int, list] = {}
    for r in repeated_passages(docs, size, seed).collect():
        out.setdefault(r["doc_id"], []).append((r["start"], r["end"], tuple(r["source_doc_ids"])))
    return {d: sorted(s) for d, s in out.items()}


def test_like_every_window(spark):
    rng = random.Random(5)
    shared = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)] for _ in range(4)]
    texts = {}
    for d in range(120):
        words = []
        while rng.random() < 0.8:
            part = rng.choice(shared)
            i = rng.randrange(25)
            words += part[i : i + rng.randint(1, 30)]
            words += [rng.choice(["é", "ab", "zz", "中文"]) for _ in range(rng.randint(0, 6))]
        texts[d] = rng.choice([" ", "\n", "  "]).join(words)
    texts[200], texts[201], texts[202] = "", None, " \t\n"
    texts[203] = texts[204] = " ".join(str(i) for i in range(3000))
    expected = brute(texts, 9)
    assert len(expected) > 40
    spans = {d: [s[:2] for s in x] for d, x in expected.items()}
    for seed in (3, 9):
        ours = found(spark, texts, 9, seed)
        assert {d: [s[:2] for s in x] for d, x in ours.items()} == spans
        for doc, rows in ours.items():
            for begin, end, sources in rows:
                assert max(sources) <= doc
                words = texts[doc][begin:end].split()
                runs = [tuple(words[i : i + 9]) for i in range(len(words) - 8)]
                for s in sources:
                    theirs = texts[s].split()
                    assert set(runs) & {tuple(theirs[i : i + 9]) for i in range(len(theirs) - 8)}


def test_inner_repeat_and_cut(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = {1: "head " + passage, 2: "other " + passage + " tail", 3: passage + "\n" + passage, 4: "own text"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in without_repeats(docs).collect()}
    assert kept == {1: texts[1], 2: "other  tail", 4: "own text"}


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(None, "a " * 99), (1, None), (2, "")], "doc_id long, text string")
    assert repeated_passages(docs).count() == 0
    assert without_repeats(docs).count() == 3
    assert without_repeats(docs.limit(0)).count() == 0


def test_rows_that_repeat_a_doc_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(70)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b + " c")], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in without_repeats(docs).collect())
    assert kept == [(1, a), (1, a), (1, b), (2, " c")]

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cargolens.llm import minhash, pii
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_suffixes import brute as brute_spans


def shingles(text, width):
    words = (text or "").lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def classes(texts, width, percent):
    """doc_id -> smallest doc_id that links reach, from all pairs."""
    sets = {d: shingles(t, width) for d, t in texts.items()}
    label = {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: root(d) for d in texts}


def words(rng, n):
    return [rng.choice("bcdfghjkl") + rng.choice("aeiou") + rng.choice("mnprst") * rng.randint(1, 2) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    texts, good = {}, {}
    passage = " ".join(words(rng, 70))
    for d in range(160):
        own = words(rng, rng.randint(120, 200))
        texts[d], good[d] = " ".join(own) + ".", 1
        if d % 8 == 1:
            texts[d] = " ".join(w.upper() + "!!" for w in own)
            good[d] = 0
        elif d % 8 == 2 and d > 8:
            texts[d] = texts[d - 8 * rng.randint(1, d // 8)] if d % 16 == 2 else texts[2] + " tail words here"
        elif d % 8 == 3:
            texts[d] = " ".join(own[:60]) + " " + passage + " " + " ".join(own[60:])
        elif d % 8 == 4:
            texts[d] += f" write to a{d}@b.org or +1 (212) 555-{1000 + d}"
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(d, t, "en", f"src{d % 3}", len(t)) for d, t in texts.items()]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
    marks = [(d, good[d], 0) for d in texts]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts, good


def test_each_stage_against_a_plain_version(spark, corpus):
    folder, texts, good = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            rows = {r["doc_id"]: r for r in out.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
            docs = spark.createDataFrame(list(rows.values()), docs.schema)
            seen.append({d: r["text"] for d, r in rows.items()})
        else:
            packed = out
    left = {d: t for d, t in texts.items() if good[d]}
    assert seen[0] == left
    label = classes(left, 5, 80)
    left = {d: t for d, t in left.items() if label[d] == d}
    assert seen[1] == left
    for d, spans in brute_spans(left, 50).items():
        for begin, end, _ in reversed(spans):
            left[d] = left[d][:begin] + left[d][end:]
    left = {d: t for d, t in left.items() if t.strip()}
    assert seen[2] == left
    for d, text in left.items():
        for kind, begin, end in sorted(brute_pii(text), key=lambda s: -s[1]):
            left[d] = left[d][:begin] + f"[{kind.upper()}]" + left[d][end:]
    assert seen[3] == left
    assert {r["doc_id"] for r in packed.collect()} == set(left)


def test_run_is_the_stages(spark, corpus):
    folder, _, _ = corpus
    rows = corpus_pipeline.run(spark, folder)
    full = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n > 2048 OR n <> end").count() == 0
    assert rows.select("doc_id").distinct().count() > 80


def test_near_copies_of_near_copies(spark):
    """Chains, groups whose centre refuses members, copies, short and empty texts, repeated rows."""
    rng = random.Random(4)
    texts = {}
    base = words(rng, 150)
    for d in range(150):
        edited = list(base)
        for _ in range(rng.randint(0, 7)):
            edited[rng.randrange(150)] = words(rng, 1)[0] + "q"
        texts[d] = " ".join(edited)
    for d in range(150, 220):
        parent = texts[rng.randrange(d)].split()
        parent[rng.randrange(len(parent))] = f"new{d}"
        texts[d] = " ".join(parent)
    texts |= {300: "", 301: None, 302: "a", 303: "A", 304: "a b", 305: "b a", 306: texts[7].upper(), 307: "x " * 30_000}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, n long")
    for width in (4, 5):
        expected = classes(texts, width, 80)
        assert len(set(expected.values())) > 20
        rows = minhash.near_duplicates(docs.unionByName(docs.filter("doc_id < 9")), width).collect()
        assert len(rows) == len(texts) + 9
        assert {r["doc_id"]: r["component_id"] for r in rows} == expected
        assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]], width)) for r in rows)
    none = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], docs.select("doc_id", "text").schema)
    assert [r["kept"] for r in minhash.near_duplicates(none).collect()] == [True, True]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_spans_of_kinds_are_known():
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_columns_with_the_names_of_helpers_stay(spark):
    from cargolens.llm import suffixes
    import corpus_pipeline as P

    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage + " one", "a", 1, 2, 3, "x"), (2, "two " + passage, "b", 1, 2, 3, "y"), (3, passage + " one", "c", 1, 2, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _spans int, _doc int, _version int, _found string")
    kept = P.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and {r["_gone"] for r in kept.collect()} == {"a"}
    cut = suffixes.without_repeats(docs).collect()
    assert {(r["doc_id"], r["text"].strip(), r["_version"]) for r in cut} == {(1, passage + " one", 3), (2, "two", 3)}

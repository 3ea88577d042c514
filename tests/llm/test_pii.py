import hashlib
import random
import re

from pyspark.sql import functions as F

from cargolens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> list[tuple[str, int, int]]:
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]


def check(spark, texts: dict):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in pii.personal_digest(docs).collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        base = brute(text)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = rows[doc]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), (doc, text, written, r)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))
    return rows


def test_whole_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    check(spark, {r["doc_id"]: r["text"] for r in rows})


def test_against_plain_patterns(spark):
    rng = random.Random(3)
    parts = [
        "a.b@c.de", "@", "x@y", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000012.1.2.255", "+1 (212) 555-0123",
        "+49 30 1234567", "+", "++1 2 3 4 5 6 7 8 9", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "5", " ", "-",
        ".", "é", "中😀", "\n", "mail: ", "12345678901234567890", "0 0 0 0 0 0 0 0 0 0 0 0 0 0", "%", "_", "\t",
    ]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for i in range(1500)}
    texts |= {5000: None, 5001: "", 5002: "7" * 30_000, 5003: "a" * 30_000 + "@", 5004: "1 " * 20_000, 5005: "+" + "1" * 20_000}
    texts |= {5006: "x" * 50_000 + "@a.b", 5007: "1." * 20_000, 5008: "a@" * 5000 + "b.c"}
    check(spark, texts)


def test_added_spans_and_redaction(spark):
    lines = [f"call (310) 555-{1000 + i} now" for i in range(60)] + [f"plain words {i}" for i in range(60)]
    lines += [f"mail a{i}@b.com or phone +1 (212) 555-{2000 + i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(lines)], "doc_id long, text string, _found string")
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_digest(docs).collect()}
    assert spans[0] == "phone:5:19" and spans[60] == ""
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] == "call [PHONE] now" and texts[60] == lines[60]
    assert texts[120] == "mail [EMAIL] or phone [PHONE]"
    assert pii.redacted(docs.limit(0)).count() == 0 and pii.personal_digest(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string")
    plan = docs.select(pii.candidates(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_estimation_finds_the_bad_labeler():
    rng = random.Random(1)
    votes = []
    for _ in range(4000):
        truth = rng.random() < 0.5
        votes.append("".join("+" if (rng.random() < p) == truth else "-" for p in (0.95, 0.9, 0.9, 0.6, 0.9)))
    right, reliability = pii.estimate(sorted(set(votes)), [votes.count(v) for v in sorted(set(votes))])
    assert reliability[3] < 0.7 < min(reliability[[0, 1, 2, 4]])
    assert right[sorted(set(votes)).index("+++++")] > 0.99


def test_classifier_weighs_patterns_by_their_share():
    votes, counts = ["+++++", "--0-+", "-+0+-", "-+-+-", "+-0++"], [50, 900, 30, 4, 16]
    right, _ = pii.estimate(votes, counts)
    few = pii._classifier(votes, counts, right)
    many = pii._classifier(votes, [c * 10**5 for c in counts], right)
    assert max(abs(few - many)) < 1e-6

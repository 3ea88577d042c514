"""Personal data by weak supervision, in Spark's own functions throughout.

Loose patterns propose spans of four kinds; labelers vote on each: the strict pattern with its check,
a gazetteer of words that announce the kind, a gazetteer of endings or prefixes, the characters
around it, and its shape. Votes are counted by pattern (a table whose size the labelers bound, not
the data). Expectation-maximisation estimates from these counts how reliable each labeler is, and a
logistic classifier is fitted to the posteriors; compiled into a column expression it decides on all
spans that the strict patterns do not hold already.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.labelled import fresh_name
from cargolens.plans.staging import stage

KINDS = ("email", "ip", "card", "phone")

# Strict patterns: fixed values. Runs are possessive and start where a run starts (or a match ended),
# which finds the same leftmost matches without going through a run again and again.
_NEW_RUN = r"(?:\G|(?<![0-9]))"
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _NEW_RUN + r"[0-9]++(?:\.[0-9]++){3}",
    "card": _NEW_RUN + r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be looked for; cheap tests that lose no match.
_NEEDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda text: F.contains(text, F.lit("+")),
}
# Looser patterns for spans beside the strict ones: fixed values.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}(?: ?[\[(] ?at ?[\])] ?)[a-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[a-z0-9-]{1,63}){1,4}",
    "ip": r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-f:])",
    "card": r"(?<![0-9.-])[0-9]{4}(?:([.·/ -])[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9.-])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
_LOOSE_NEEDS = {
    "email": lambda text: text.rlike(r"(?i)[\[(] ?at ?[\])]"),
    "ip": lambda text: text.rlike(r"(?i)[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]"),
    "card": lambda text: text.rlike(r"[0-9]{4}[.·/ -][0-9]{4}[.·/ -][0-9]{4}"),
    "phone": lambda text: text.rlike(r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"),
}
# Words that announce a kind, in the languages of the corpus, and endings and prefixes: fixed values.
ANNOUNCE = {
    "email": ("email", "e-mail", "mail", "courriel", "correo", "contact", "write to"),
    "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor", "from"),
    "card": ("card", "visa", "mastercard", "amex", "carte", "karte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "appel", "llame"),
}
SHAPES = {
    "email": r"(?i)[.) ](?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|example)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+|\()?[1-9]",
}
#: Code points before a span that the gazetteer sees.
REACH = 24
#: What the counts of a kind's vote patterns add up to in the fit.
WEIGHT = 10_000
LABELERS = ("strict", "announced", "shape", "apart", "length")

_SPAN = "struct<start:int,end:int,text:string>"
_SPANS = f"array<{_SPAN}>"


def _matches(text: Column, pattern: str, needs: Column, keep) -> Column:
    """Leftmost non-overlapping matches that ``keep`` accepts, as spans in code points."""
    cover = f"(?s)(.*?)(?:({pattern})|\\z)" if "(?i)" not in pattern else (
        f"(?si)(.*?)(?:({pattern.replace('(?i)', '')})|\\z)"
    )
    cover = cover.replace(r"\1", r"\3")  # a pattern's own first group comes third here
    gaps = F.regexp_extract_all(text, F.lit(cover), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(cover), F.lit(2))
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), _SPANS).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("text"))
        taken = (F.length(pair["found"]) > 0) & keep(pair["found"])
        return F.struct(
            end.alias("at"),
            F.when(taken, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("found"))
    spans = F.aggregate(pairs, start, step, lambda state: state["spans"])
    return F.when(needs, spans).otherwise(F.from_json(F.lit("[]"), _SPANS))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Do the digits of ``text`` pass the check?"""
    digits = F.reverse(_digits(text))
    values = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
    ))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: str):
    """The check that a strict match has to pass."""
    if kind == "email":
        return lambda text: F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return lambda text: F.forall(
            F.split(text, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255)
        )
    if kind == "card":
        return lambda text: F.when(F.length(_digits(text)).between(13, 19), luhn(text)).otherwise(F.lit(False))
    return lambda text: F.length(_digits(text)).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    """Spans (start, end, text) of the strict pattern of ``kind`` that pass its check."""
    return _matches(text, STRICT[kind], _NEEDS[kind](text), _valid(kind))


def _votes(text: Column, kind: str, span: Column, strict: Column) -> Column:
    """One character a labeler: + for, - against, 0 no vote."""
    before = F.lower(F.substring(text, F.greatest(span["start"] - REACH + 1, F.lit(1)), F.least(span["start"], F.lit(REACH))))
    named = before.rlike(r"(?:^|[^a-z])(?:" + "|".join(ANNOUNCE[kind]) + r")[^a-z]{0,4}$")
    left = F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(F.lit(" "))
    right = F.substring(text, span["end"] + 1, F.lit(1))
    glued = left.rlike(r"[\p{L}\p{N}_/=#]") | right.rlike(r"[\p{L}\p{N}_/=]")
    size = F.length(_digits(span["text"])) if kind in ("card", "phone") else F.length(span["text"])
    low, high = {"email": (6, 64), "ip": (7, 39), "card": (15, 16), "phone": (10, 13)}[kind]
    sign = lambda c, yes="+", no="-": F.when(c, yes).otherwise(no)
    return F.concat(
        strict,
        sign(named, no="0"),
        sign(span["text"].rlike(SHAPES[kind])),
        sign(~glued),
        sign(size.between(low, high)),
    )


def candidates(text: Column) -> Column:
    """All proposed spans: array of (kind, start, end, votes, base)."""
    out = []
    for number, kind in enumerate(KINDS):
        valid = _valid(kind)
        strict = _matches(text, STRICT[kind], _NEEDS[kind](text), valid)
        loose = _matches(text, LOOSE[kind], _LOOSE_NEEDS[kind](text), lambda t: F.lit(True))

        def described(spans: Column, base: bool, number=number, kind=kind) -> Column:
            vote = F.lit("+" if base else "-")
            return F.transform(
                spans,
                lambda s: F.struct(
                    F.lit(number).alias("kind"),
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    _votes(text, kind, s, vote).alias("votes"),
                    F.lit(base).alias("base"),
                ),
            )

        out += [described(strict, True), described(loose, False)]
    return F.concat(*out)


@dataclass(frozen=True)
class SpanModel:
    """Logistic weights by kind and labeler; ``reliability`` is what the estimation found."""

    weights: np.ndarray  # kinds x (1 + 2 * labelers): intercept, then for and against
    reliability: np.ndarray  # kinds x labelers: share of right votes

    def probability(self, kind: Column, votes: Column) -> Column:
        out = F.lit(None).cast("double")
        for k in range(len(KINDS)):
            total = F.lit(float(self.weights[k, 0]))
            for j in range(len(LABELERS)):
                vote = F.substring(votes, F.lit(j + 1), F.lit(1))
                up, down = (float(w) for w in self.weights[k, 1 + 2 * j : 3 + 2 * j])
                total = total + F.when(vote == "+", up).when(vote == "-", down).otherwise(0.0)
            out = F.when(kind == k, 1 / (1 + F.exp(-total))).otherwise(out)
        return out


def _signs(votes: list[str]) -> np.ndarray:
    return np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in v] for v in votes], np.int8).reshape(-1, len(LABELERS))


def estimate(votes: list[str], counts: list[int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of vote patterns and the labelers' reliabilities, by expectation-maximisation.

    Labelers are taken to err independently, with the same share for and against. It starts at the
    majority of votes, where the strict labeler counts twice; reliabilities stay between 0.55 and
    0.99, so that no labeler is turned against its meaning.
    """
    signs, n = _signs(votes), np.asarray(counts, float)
    lead = signs.sum(1) + signs[:, 0]
    right = 1 / (1 + np.exp(-2.0 * lead))
    reliability = np.full(len(LABELERS), 0.7)
    for _ in range(rounds):
        share = np.clip((n * right).sum() / max(n.sum(), 1), 0.02, 0.98)
        agree = np.where(signs > 0, right[:, None], 1 - right[:, None]) * (signs != 0) * n[:, None]
        cast = ((signs != 0) * n[:, None]).sum(0)
        reliability = np.clip((agree.sum(0) + 1.4) / (cast + 2), 0.55, 0.99)
        odds = np.log(share / (1 - share)) + signs @ np.log(reliability / (1 - reliability))
        fresh = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(fresh - right).max(initial=0) < 1e-9:
            break
        right = fresh
    return right, reliability


def _classifier(votes: list[str], counts: list[int], right: np.ndarray) -> np.ndarray:
    """Logistic weights that reproduce the posteriors: Newton steps over the vote patterns."""
    signs = _signs(votes)
    x = np.ones((len(signs), 1 + 2 * len(LABELERS)))
    x[:, 1::2], x[:, 2::2] = signs > 0, signs < 0
    n = np.asarray(counts, float)
    n = n * (WEIGHT / n.sum())  # shares: the fit is the same at any size of the input
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (right - p)) - 1e-2 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(found: DataFrame) -> SpanModel:
    """The span model from proposed spans (kind, votes); at most kinds x 3^labelers counts come here."""
    counts = found.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    weights = np.zeros((len(KINDS), 1 + 2 * len(LABELERS)))
    weights[:, 0] = -2.0  # a kind that nothing proposes
    reliability = np.full((len(KINDS), len(LABELERS)), 0.7)
    for k in range(len(KINDS)):
        rows = [(r["votes"], r["n"]) for r in counts if r["kind"] == k]
        if rows:
            votes, n = [r[0] for r in rows], [r[1] for r in rows]
            right, reliability[k] = estimate(votes, n)
            weights[k] = _classifier(votes, n, right)
    return SpanModel(weights, reliability)


def _accepted(found: Column, model: SpanModel, least: float = 0.5) -> Column:
    """Base spans, and proposed spans that the model accepts and that overlap no base span."""
    base = F.filter(found, lambda s: s["base"])
    added = F.filter(
        found,
        lambda s: ~s["base"]
        & (model.probability(s["kind"], s["votes"]) >= least)
        & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return F.array_sort(F.array_distinct(F.concat(plain(base), plain(added))))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row of ``docs`` (doc_id, text).

    ``base`` and ``spans`` are arrays of (kind, start, end), kind being a place in KINDS, in order of
    kind and start; code points, end exclusive. A null text is empty. Repeated rows stay.
    """
    found = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
            "doc_id", candidates(F.col("text")).alias("found")
        ),
        "proposed",
    )
    model = fit(found.select(F.explode("found").alias("s")).select("s.kind", "s.votes"))
    base = F.filter("found", lambda s: s["base"])
    base = F.array_sort(F.transform(base, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return found.select("doc_id", base.alias("base"), _accepted(F.col("found"), model).alias("spans"))


def personal_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of ``personal_data``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return personal_data(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; other columns stay.

    Overlapping spans are replaced from the start of the first to the end of the last, by the first
    one's kind. Texts without spans, nulls among them, stay as they are.
    """
    names, name = docs.columns, fresh_name(docs, "_found")
    text = F.coalesce("text", F.lit(""))
    proposed = stage(docs.select(candidates(text).alias("found")), "proposed")
    model = fit(proposed.select(F.explode("found").alias("s")).select("s.kind", "s.votes"))
    spans = _accepted(candidates(text), model)
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        inside = s["start"] < state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(inside, state["kept"])
            .otherwise(F.concat(state["kept"], gap, F.element_at(marks, s["kind"] + 1)))
            .alias("kept"),
        )

    whole = F.aggregate(
        F.col(name),
        start,
        step,
        lambda state: F.concat(state["kept"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    rows = docs.withColumn(name, by_start)
    changed = F.when(F.size(name) > 0, whole).otherwise(F.col("text"))
    return rows.withColumn("text", changed).select(*names)

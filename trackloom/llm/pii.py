"""Operator 3: personal data by weak supervision.

Base spans come from fixed patterns and always stay. Besides, looser patterns give candidates, and
five labelers vote on every span (personal, not, or no vote): a check of the strict pattern, its
format, gazetteers, the words before it, and its neighbouring characters. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is; the posteriors are the
training labels of a logistic span classifier, which decides on the candidates.

Texts are read once and stay where they are. What is gathered is a count for each vote pattern and
feature code: 972 patterns and 1,728 codes at most, whatever the corpus.

Defined cases: a null or empty text has no spans; an empty corpus trains nothing and adds nothing; a text of any
length is read whole; of overlapping candidates the first pattern's and then the leftmost counts; a probability
right at the threshold is taken; repeated rows get equal spans; other columns may have any names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.store import stored

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these always begins at the first digit of a run, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Candidates that the base patterns don't take.
_LOOSE = [
    (EMAIL, re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{2,63}){1,4}")),
    (PHONE, re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
    (CARD, re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    (CARD, re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")),
]
_AT = re.compile(r"[\[(] ?(?:at|AT) ?[\])]")
# The gazetteers.
_TOP_LEVEL = frozenset("com net org edu gov int io co info de fr es it uk us ca eu ch at nl be se no dk pl pt ru jp cn in br mx au nz".split())
_COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
_ISSUERS = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
_BEFORE = ["mail contact write address", "ip host server address login", "card visa credit payment pay mastercard amex ssn account", "phone call tel mobile fax cell contact whatsapp"]
_NOT_BEFORE = "order invoice version isbn issn part model article build item price total page id number no".split()
_WORD = re.compile(r"[a-z]+")
_MAY = re.compile(r"[@0-9(\[]")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and without overlap for each kind, failing matches dropped; sorted."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append((s, EMAIL, done))
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            found.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span and no earlier candidate."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in base:  # in order; spans of two kinds may overlap
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    found = []
    for kind, pattern in _LOOSE if _AT.search(text) else _LOOSE[1:]:
        for m in pattern.finditer(text):
            at = bisect.bisect_left(starts, m.end())
            if not at or ends[at - 1] <= m.start():
                starts.insert(at, m.start())
                ends.insert(at, m.end())
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def votes(text: str, s: int, kind: int, e: int, strict: bool) -> tuple[int, ...]:
    """A vote of each labeler: 1 personal, 2 not, 0 none."""
    span = text[s:e]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = _WORD.findall(text[max(0, s - 40) : s].lower())[-4:]
    left, right = text[s - 1 : s] if s else " ", text[e : e + 1] or " "
    check = 1 if strict else 2 if kind in (IP, CARD) else 0
    if kind == EMAIL:
        end = re.split(r"[^A-Za-z]+", span)[-1].lower()
        form, known = 1 if 2 <= len(end) <= 6 else 2, 1 if end in _TOP_LEVEL else 2
    elif kind == IP:
        parts = span.split(".")
        form = 2 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        known = 2 if parts[0] in ("0", "127", "255") else 0
    elif kind == CARD:
        form = 1 if len(digits) in (9, 15, 16) else 2
        known = 1 if digits.startswith(_ISSUERS) and len(digits) >= 13 else 0
    else:
        form = 1 if 10 <= len(digits) <= 13 else 2
        known = 1 if span[0] == "+" and digits.startswith(_COUNTRY_CODES) else 0
    context = 1 if any(w in _BEFORE[kind].split() for w in before) else 2 if any(w in _NOT_BEFORE for w in before) else 0
    edge = 2 if left.isalnum() or right.isalnum() or left in "./_" or right in "/_" else 1
    return check, form, known, context, edge


def features(text: str, s: int, kind: int, e: int, v: tuple[int, ...]) -> int:
    """A code below 1,728: kind, digits, separators, context and edge of a span, and whether a gazetteer knows it."""
    span = text[s:e]
    n = sum("0" <= c <= "9" for c in span)
    sep = 2 if "(" in span or "[" in span else 1 if any(c in " -" for c in span) else 0
    known = v[2]
    return ((((kind * 8 + min(n // 2, 7)) * 3 + sep) * 3 + v[3]) * 2 + (v[4] == 2)) * 3 + known


def code_columns(code: int) -> list[int]:
    """Places of a code's active features for the classifier."""
    code, known = divmod(code, 3)
    code, edge = divmod(code, 2)
    code, context = divmod(code, 3)
    code, sep = divmod(code, 3)
    kind, n = divmod(code, 8)
    return [kind * 8 + n, 32 + kind * 3 + sep, 44 + kind * 3 + context, 56 + kind * 2 + edge, 64 + kind * 3 + known]


WIDTH = 77


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans (s, k, e) and all voted spans (s, k, e, strict, votes, code) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("s", pa.int64()), ("k", pa.int64()), ("e", pa.int64()), ("strict", pa.bool_()), ("votes", pa.int64()), ("code", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                rows = []
                for text in b.column(1).to_pylist():
                    own = []
                    if text and _MAY.search(text):
                        base = base_spans(text)
                        for s, k, e in base + loose_spans(text, base):
                            strict = len(own) < len(base)
                            v = votes(text, s, k, e, strict)
                            own.append({"s": s, "k": k, "e": e, "strict": strict, "votes": sum(x * 3**i for i, x in enumerate(v)), "code": features(text, s, k, e, v)})
                    rows.append(own)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<s:long,k:long,e:long,strict:boolean,votes:long,code:long>>")


def reliabilities(kind: np.ndarray, pattern: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: posterior of being personal for each, and p(vote | class, labeler)."""
    v = (pattern[:, None] // 3 ** np.arange(LABELERS)) % 3
    posterior = np.clip(0.5 + ((v == 1).sum(axis=1) - (v == 2).sum(axis=1)) / (2 * LABELERS), 0.05, 0.95)
    table = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        prior = np.array([(posterior * n)[kind == k].sum() + 1 for k in range(4)]) / np.array([n[kind == k].sum() + 2 for k in range(4)])
        for c, weight in ((1, posterior * n), (0, (1 - posterior) * n)):
            for i in range(LABELERS):
                table[c, i] = (np.bincount(v[:, i], weight, 3) + 0.5) / (weight.sum() + 1.5)
        log = [np.log(table[c, np.arange(LABELERS), v]).sum(axis=1) for c in (0, 1)]
        odds = log[1] - log[0] + np.log(prior[kind] / (1 - prior[kind]))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, table


def train(code: np.ndarray, target: np.ndarray, n: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights (last the constant) of the span classifier by gradient steps on all codes at once."""
    x = np.zeros((len(code), WIDTH + 1))
    for i, c in enumerate(code):
        x[i, code_columns(int(c))] = 1
    x[:, -1] = 1
    w, weight = np.zeros(WIDTH + 1), n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ (weight * (p - target)) + 1e-4 * w)
    return w


def fitted(rows: DataFrame) -> dict[int, float]:
    """Probability of each feature code that occurs."""
    counts = rows.select(F.explode("spans").alias("x")).groupBy("x.k", "x.votes", "x.code").agg(F.count("*").alias("n")).toPandas()
    if counts.empty:
        return {}
    by = counts.groupby(["k", "votes"], as_index=False)["n"].sum()
    posterior, _ = reliabilities(by["k"].to_numpy(), by["votes"].to_numpy(), by["n"].to_numpy(float))
    both = counts.merge(by.assign(p=posterior)[["k", "votes", "p"]], on=["k", "votes"])
    w = train(both["code"].to_numpy(), both["p"].to_numpy(), both["n"].to_numpy(float))
    return {int(c): float(1 / (1 + np.exp(-w[[*code_columns(int(c)), -1]].sum()))) for c in pd.unique(both["code"])}


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, (x["k"] + 1).cast("int")), x["s"], x["e"])), ",")


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and found (kind, start, end, base) as an array."""
    rows = stored(scan(docs), "pii-spans")
    chosen = sorted(c for c, p in fitted(rows).items() if p >= threshold)
    of_code = (lambda x: x["strict"] | F.array_contains(F.array(*map(F.lit, chosen)).cast("array<bigint>"), x["code"])) if chosen else (lambda x: x["strict"])
    base = F.array_sort(F.filter("spans", lambda x: x["strict"]))
    every = F.array_sort(F.filter("spans", of_code))
    names = F.array(*map(F.lit, KINDS))

    def counted(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["strict"] & (x["k"] == kind))).cast("long")

    return rows.select(
        "doc_id", *[counted(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"),
        F.transform(every, lambda x: F.struct(F.element_at(names, (x["k"] + 1).cast("int")).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["strict"].alias("base"))).alias("found"),
    )

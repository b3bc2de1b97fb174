"""Personal data by weak supervision.

Exact patterns give the base spans. Looser patterns give further candidates: e-mail addresses with
written-out signs, IPv6 addresses, card numbers that fail the check digit, telephone numbers without a
plus. Labelers vote on every candidate, for, against or not at all: patterns, gazetteers (top-level
domains, card issuers, calling codes, special networks) and context words around it. Expectation
maximisation over the counts of all vote patterns of the whole corpus estimates each labeler's
reliability and the chance that a candidate is personal data; with those chances as soft labels a
logistic span classifier over votes and shape is trained. It decides on the candidates that aren't
base spans; base spans always stay. Added spans overlap neither base spans nor one another.

A text is read in time in proportion to its length. Offsets are code points, the end exclusive. Null texts are empty. Rows stand as they are, whatever
their doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

KINDS = ("email", "ip", "card", "phone")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that fails from the first digit of a run fails from its other digits too, so only runs' starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]+)+", re.I)
_IP6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
_DIAL = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-])")

# Gazetteers and context words of the labelers.
TOP_LEVEL = frozenset("com org net edu gov io info biz de fr es it uk eu us ca au ch at nl be se no dk pl ru cn jp br mx in example test local".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "7", "81", "82", "86", "90", "91")
SPECIAL_NETS = ("0.", "127.", "224.", "255.")
CUES = {
    "email": re.compile(r"mail|contact|write to|schreib|correo|courriel|@", re.I),
    "ip": re.compile(r"\bip\b|address|server|host|login|adresse|client", re.I),
    "card": re.compile(r"card|visa|master|payment|karte|tarjeta|carte|credit", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|anruf|llam|appel", re.I),
}
AGAINST = re.compile(r"isbn|order|version|\bref\b|invoice|serial|\bno\.|section|figure|page|\bv\Z", re.I)

LABELERS = 5  # base pattern, check, gazetteer, context, shape
_REACH = 32


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact patterns' spans, by kind and start."""
    out = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _loose_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if "at)" in low or "at ]" in low or "at]" in low or "at )" in low:
        out += [("email", m.start(), m.end()) for m in _SPELT.finditer(text)]
    if ":" in text:
        out += [("ip", m.start(), m.end()) for m in _IP6.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and not (len(d) >= 16 and _luhn(d)):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _DIAL.finditer(text)]
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """1, -1 or 0 of each labeler."""
    span, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - _REACH) : start], text[end : end + 2]
    cue = CUES[kind].search(before)
    context = 1 if cue else -1 if AGAINST.search(before) else 0
    edges = -1 if (before[-1:].isalnum() or after[:1].isalnum()) else 0
    if kind == "email":
        last = re.split(r"[. )\]]", span.rstrip(".) ]"))[-1].lower()
        check, known, shape = (1 if last.isalpha() and len(last) > 1 else -1), (1 if last in TOP_LEVEL else 0), edges
    elif kind == "ip":
        check = 1 if base or ":" in span else -1
        known, shape = (-1 if span.startswith(SPECIAL_NETS) else 1), edges
    elif kind == "card":
        check = 1 if _luhn(digits) else -1
        known = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if re.fullmatch(r"(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{16}", span) else -1 if edges or " " in span else 0
    else:
        check = 1 if 8 <= len(digits) <= 15 else -1
        known = 1 if span.startswith("+") and digits.startswith(CALLING) else 0
        shape = 1 if re.search(r"[ ().-]", span) else edges
    return (1 if base else -1, check, known, context, shape)


def _size(kind: str, span: str) -> int:
    n = len(_digits(span)) if kind != "email" else len(span)
    return min(4, n // 4 if kind != "email" else n // 10)


def candidates(text: str) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, base, code) of all candidates; the code holds the votes and a size class."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    reach = [b for _, b in taken]  # the furthest end of the base spans up to each
    for i in range(1, len(reach)):
        reach[i] = max(reach[i], reach[i - 1])
    starts = [a for a, _ in taken]
    out = [(k, a, b, True) for k, a, b in base]
    last = 0
    for k, a, b in sorted(_loose_spans(text), key=lambda s: (s[1], -s[2])):
        before = bisect_left(starts, b)  # base spans that start before this one's end
        if a >= last and (not before or reach[before - 1] <= a):
            out.append((k, a, b, False))
            last = b
    coded = []
    for k, a, b, exact in out:
        code = 0
        for v in votes(text, k, a, b, exact):
            code = code * 3 + v + 1
        coded.append((k, a, b, exact, (code * 5 + _size(k, text[a:b])) * len(KINDS) + KINDS.index(k)))
    return coded


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, size class, kind) of codes."""
    kind, rest = codes % len(KINDS), codes // len(KINDS)
    size, rest = rest % 5, rest // 5
    out = np.zeros((len(codes), LABELERS), np.int64)
    for i in range(LABELERS - 1, -1, -1):
        out[:, i], rest = rest % 3 - 1, rest // 3
    return out, size, kind


def reliabilities(vote: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(chance of each pattern to be positive, labelers' vote rates by class [class, labeler, vote], prior) by EM.

    The start takes labelers to be right more often than not, which fixes what the classes mean;
    pseudo-counts keep a labeler that never speaks from deciding anything.
    """
    rates = np.zeros((2, LABELERS, 3))
    rates[1], rates[0] = (0.1, 0.3, 0.6), (0.6, 0.3, 0.1)
    prior, chance = 0.5, np.zeros(len(vote))
    start = rates.copy()
    for _ in range(rounds):
        log = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(rates[:, i, vote[:, i] + 1]) for i in range(LABELERS))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - chance).max(initial=0) < 1e-10:
            break
        chance = new
        for c, own in enumerate((count * (1 - chance), count * chance)):
            for i in range(LABELERS):
                seen = np.bincount(vote[:, i] + 1, weights=own, minlength=3) + 2 * start[c, i]
                rates[c, i] = seen / seen.sum()
        prior = float(np.clip((count @ chance + 1) / (count.sum() + 2), 1e-6, 1 - 1e-6))
    return chance, rates, prior


def _traits(codes: np.ndarray) -> np.ndarray:
    vote, size, kind = _unpack(codes)
    eye_k, eye_s = np.eye(len(KINDS))[kind], np.eye(5)[size]
    speak = np.concatenate([vote == 1, vote == -1], axis=1).astype(float)
    return np.concatenate([np.ones((len(codes), 1)), speak, eye_s, eye_k], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    rates: dict[str, np.ndarray]

    def chance(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_traits(codes) @ self.weights, -500, 500)))


def _train(codes: np.ndarray, count: np.ndarray, soft: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x, n = _traits(codes), count / max(1.0, count.mean())
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - soft)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _code_counts(batches):
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(c[4] for c in candidates(text))
    yield words.plain(["code", "n"], [np.array(list(seen), np.int64), np.array(list(seen.values()), np.int64)])


def fit(table: DataFrame) -> Model:
    """Reliabilities and classifier from the vote patterns of all texts; there are few patterns, whatever the corpus."""
    found = table.select(F.col("text").cast("string").alias("text")).mapInArrow(_code_counts, "code long, n long")
    found = found.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()  # at most 5 * 4 * 3**LABELERS rows
    codes, count = found["code"].to_numpy(np.int64), found["n"].to_numpy(float)
    if not len(codes):
        return Model(np.zeros(_traits(np.zeros(1, np.int64)).shape[1]) - 1, {})
    vote, _, kind = _unpack(codes)
    soft, rates = np.zeros(len(codes)), {}
    for k, name in enumerate(KINDS):
        own = kind == k
        if own.any():
            soft[own], rates[name], _ = reliabilities(vote[own], count[own])
    return Model(_train(codes, count, soft), rates)


def spans_of(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind and start."""
    found = candidates(text or "")
    loose = [c for c in found if not c[3]]
    added = []
    if loose:
        chance = model.chance(np.array([c[4] for c in loose], np.int64))
        added = [c[:3] for c, p in zip(loose, chance.tolist(), strict=True) if p >= 0.5]
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted((c[:3] for c in found if c[3]), key=lambda s: (order[s[0]], s[1]))
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1]))


def _written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(table: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, number of base spans of each kind, base and all spans as kind:start:end,... of every row."""
    model = model or fit(table)

    def run(batches):
        for batch in batches:
            found = [spans_of(t, model) for t in batch.column(1).to_pylist()]
            count = [[sum(k == s[0] for s in base) for base, _ in found] for k in KINDS]
            yield words.plain(
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
                [batch.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array([_written(b) for b, _ in found], pa.string()), pa.array([_written(s) for _, s in found], pa.string())],
            )

    docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(table: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and the text with each span replaced by its kind in angle brackets."""
    model = model or fit(table)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                parts, end = [], 0
                for kind, a, b in sorted(spans_of(text, model)[1], key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        parts += [text[end:a], f"<{kind}>"]
                        end = b
                out.append(None if text is None else "".join(parts) + text[end:])
            yield words.plain(["doc_id", "text"], [batch.column(0), pa.array(out, pa.string())])

    docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, text string")

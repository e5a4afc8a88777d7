"""Personal data by weak supervision.

Rules propose candidate spans of four kinds: email, ip, card and phone. Rules that are exact by definition give base
spans, which always stay. Wider rules give candidates that may be false: written-out addresses, IPv6, cards of 13 to 15
digits, national phone numbers. Five labelers vote on every candidate (for, against, or nothing): its form, a checksum,
gazetteers, the words around it, and the characters that touch it. Spark counts the distinct ballots over the whole
corpus; expectation-maximisation on these counts estimates how reliable each labeler is, without labels; its posteriors
train the span classifier, which then decides on the wider candidates from votes and shape together.

What reaches the driver is one row per distinct ballot, of which there are a fixed number at most, however large the corpus.

Defined results: null and empty texts have no spans; spans of one kind never overlap, and a wider candidate never
overlaps a base span; offsets are code points, the end exclusive; repeated rows are each scanned; extra columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrain.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
AROUND = 40  # characters of context on either side
# The base rules. A look-behind only spares starts inside a run of digits, where no match can begin.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The wider rules.
WRITTEN_AT = re.compile(r"\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?")
WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?)[A-Za-z0-9-]+)+")
IP6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])00[1-9][0-9 ]{7,14}[0-9](?![0-9])")
# Gazetteers and context words; fixed values.
TOP_LEVEL = frozenset("com org net edu gov info biz io co me app dev de fr es it uk us eu ch at nl be pt pl ru cn jp in br".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "36", "60", "65")
CUES = {
    "email": re.compile(r"\b(e-?mails?|mail|contact|write|correo|courriel)\b|@", re.I), "ip": re.compile(r"\b(ip|address|host|server|ping|v[46]|adresse|direcci[oó]n)\b", re.I),
    "card": re.compile(r"\b(card|visa|master|amex|credit|debit|pay|karte|tarjeta|carte)\w*", re.I), "phone": re.compile(r"\b(phone|tel|call|mobile|cell|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\w*", re.I),
}
AGAINST = re.compile(r"\b(version|release|isbn|issn|doi|order|invoice|section|chapter|figure|license|licen[cs]ed|build|serial|part)\b", re.I)
VOTES = ("form", "checksum", "gazetteer", "context", "edges")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        rest = DOMAIN.match(text, at + 1) if start < at else None
        if rest:
            done = rest.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact rules, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = only_digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return out


def _wide(text: str) -> Iterator[tuple[str, int, int]]:
    for m in WRITTEN_AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        rest = WRITTEN_DOMAIN.match(text, m.end())
        if start < m.start() and rest:
            yield "email", start, rest.end()
    if ":" in text:
        yield from (("ip", *m.span()) for m in IP6.finditer(text))
    for m in CARD.finditer(text):
        if 13 <= len(only_digits(m.group())) <= 15:
            yield "card", *m.span()
    yield from (("phone", *m.span()) for m in NATIONAL.finditer(text))


def ballot(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Votes of the labelers: 1 for, -1 against, 0 nothing to say."""
    span = text[start:end]
    digits = only_digits(span)
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    if kind == "email":
        check = 1 if ".." not in span and span[0] not in ".-" else -1
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", span.lower())[-1] in TOP_LEVEL else -1
    elif kind == "ip":
        parts = span.split(".")
        check = 0 if ":" in span else 1 if all(p == "0" or not p.startswith("0") for p in parts) else -1
        gazetteer = -1 if span.startswith(("0.", "255.")) else 0
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    else:
        check = 1 if 10 <= len(digits) <= 13 else 0 if base else -1
        gazetteer = 1 if span.startswith(("+", "00")) else 0
    context = 1 if CUES[kind].search(before) else -1 if AGAINST.search(before) else 0
    touching = (before[-1:].isalnum() or after[:1].isalnum()) or (before[-1:] in "-/_=#" and before != "") or (after[:1] in "-/_=" and after != "")
    return (1 if base else 0, check, gazetteer, context, -1 if touching else 1)


def shape(kind: str, start: int, end: int) -> int:
    """Length in four steps; with the kind and the votes it is what the classifier sees."""
    return min(3, (end - start) // 8)


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and wider ones that overlap neither them nor each other."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    extra: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(_wide(text), key=lambda s: (s[1], -s[2])):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            extra.append((kind, a, b))
    return base, extra


@dataclass
class Reliability:
    """Per kind the share of true candidates; per labeler how often it votes -1, 0, 1 on false and on true ones."""

    prior: dict[str, float]
    table: np.ndarray  # (labelers, 2, 3)


@dataclass
class Classifier:
    weights: dict[str, float] = field(default_factory=dict)

    def probability(self, kind: str, votes: tuple[int, ...], size: int) -> float:
        z = sum(self.weights.get(f, 0.0) for f in features(kind, votes, size))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def features(kind: str, votes: tuple[int, ...], size: int) -> list[str]:
    return ["bias", f"kind={kind}", f"size={kind}{size}", *(f"{n}={v}" for n, v in zip(VOTES, votes, strict=True)), *(f"{kind}:{n}={v}" for n, v in zip(VOTES, votes, strict=True))]


def estimate(ballots: Counter, rounds: int = 100) -> tuple[Reliability, dict[tuple, float]]:
    """Expectation-maximisation over distinct ballots ``(kind, votes, size)`` with their counts."""
    keys = sorted(ballots)
    counts = np.array([ballots[k] for k in keys], float)
    votes = np.array([k[1] for k in keys], int).reshape(len(keys), len(VOTES)) + 1
    kinds = np.array([KINDS.index(k[0]) for k in keys])
    start = np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])  # labelers are better than chance
    table = np.repeat(start[None], len(VOTES), 0)
    prior = np.full(len(KINDS), 0.5)
    posterior = np.full(len(keys), 0.5)
    for _ in range(rounds if keys else 0):
        likely = np.log(table)[np.arange(len(VOTES))[None, :], :, votes].sum(axis=1)  # (ballots, 2)
        odds = likely[:, 1] - likely[:, 0] + np.log(prior / (1 - prior))[kinds]
        fresh = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(fresh - posterior).max() < 1e-9
        posterior = fresh
        weight = np.stack([counts * (1 - posterior), counts * posterior], axis=1)
        for i in range(len(VOTES)):
            for v in range(3):
                table[i, :, v] = weight[votes[:, i] == v].sum(axis=0) + 20 * start[:, v]  # smoothed towards the start
        table /= table.sum(axis=2, keepdims=True)
        for k in range(len(KINDS)):
            one = kinds == k
            prior[k] = (weight[one, 1].sum() + 1) / (counts[one].sum() + 2)
        if done:
            break
    return Reliability(dict(zip(KINDS, map(float, prior), strict=True)), table), {k: float(p) for k, p in zip(keys, posterior, strict=True)}


def train(ballots: Counter, posterior: dict[tuple, float], ridge: float = 0.05, steps: int = 50) -> Classifier:
    """Logistic regression on the posteriors as soft labels; every ballot weighs the logarithm of its count."""
    keys = sorted(ballots)
    names = sorted({f for k in keys for f in features(*k)})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for row, k in enumerate(keys):
        x[row, [at[f] for f in features(*k)]] = 1
    y = np.array([posterior[k] for k in keys])
    share = np.log1p(np.array([ballots[k] for k in keys], float))
    w = np.zeros(len(names))
    for _ in range(steps if keys else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names)), x.T @ (share * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(dict(zip(names, map(float, w), strict=True)))


def count_ballots(docs: DataFrame, text: str = "text") -> Counter:
    """Distinct ballots of the whole corpus with their counts; at most kinds x sizes x 3**labelers rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                for value in batch.column(0).slice(start, 512).to_pylist():
                    if value:
                        for base, spans in zip((True, False), candidates(value), strict=True):
                            seen.update((k, ballot(value, k, a, b, base), shape(k, a, b)) for k, a, b in spans)
        rows = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([list(r[1]) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int32()), pa.array([seen[r] for r in rows], pa.int64())],
            names=["kind", "votes", "size", "n"],
        )

    counted = docs.select(text).mapInArrow(run, "kind string, votes array<int>, size int, n long").groupBy("kind", "votes", "size").agg(F.sum("n").alias("n"))
    return Counter({(r["kind"], tuple(r["votes"]), r["size"]): r["n"] for r in counted.collect()})


def learn(docs: DataFrame, text: str = "text") -> Classifier:
    ballots = count_ballots(docs, text)
    return train(ballots, estimate(ballots)[1])


def spans_of(text: str, classifier: Classifier, threshold: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and accepted wider spans of one text."""
    base, extra = candidates(text)
    return base, [s for s in extra if classifier.probability(s[0], ballot(text, *s, False), shape(*s)) >= threshold]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``base`` and ``spans`` (as ``kind:start:end``, comma-joined) and counts per kind of base span."""

    def work(texts: list, batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {**{f"n_{k}": [] for k in KINDS}, "base": [], "spans": []}
        for t in texts:
            base, extra = spans_of(t or "", classifier)
            per_kind = Counter(k for k, _, _ in base)
            for k in KINDS:
                made[f"n_{k}"].append(per_kind[k])
            made["base"].append(written(base))
            made["spans"].append(written(base + extra))
        return {k: pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in made.items()}

    return map_texts(docs, work, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string", text)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one mask, named for the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with every span masked; texts without spans, null ones too, stay as they are."""

    def work(texts: list, batch: pa.RecordBatch) -> dict:
        made = []
        for t in texts:
            base, extra = spans_of(t or "", classifier)
            made.append(masked(t, base + extra) if base or extra else t)
        return {"_masked": pa.array(made, pa.string())}

    out = map_texts(docs, work, "_masked string", text)
    return out.select(*[F.col("_masked").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])

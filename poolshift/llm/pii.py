"""Personal data by weak supervision.

Base spans come from four fixed patterns (email, ip, card, phone; see
``base_spans``) and always stay. Further candidates (phone numbers without a
plus, numbers in groups, addresses written out as "name at host dot org",
id numbers, names after a title or a contact word, long keys with digits
after a colon or an equals sign) are put to labelers: format rules, gazetteers of hosts,
given names and words for secrets, and context words around the candidate. Each labeler votes for, against or not
at all. Expectation-maximisation over the counts of vote patterns of the
whole corpus estimates how reliable each labeler is; the posterior
probabilities then train a logistic span classifier on votes and shape, and
candidates it accepts are added where they overlap no base span.

What reaches the driver are counts of distinct vote and shape patterns, at
most ``3 ** len(LABELERS) * len(KINDS) * 2 ** len(SHAPES)``, whatever the input.

Defined cases: null and empty texts hold no spans; a corpus without
candidates adds none; repeated rows are searched each; offsets are code
points, ends exclusive; extra columns are kept where texts are redacted.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = ("address", "iban", "name", "number", "secret", "ssn")
ACCEPT = 0.9
EM_ROUNDS = 60
PRIOR = 0.3
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The lookbehinds only skip starts that a greedy match from the start of the run has covered already.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]")

# Words that announce or follow personal data, and common given names.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "senor", "senora")
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph "
                  "jessica thomas sarah charles karen anna peter maria paul laura hans klaus jean pierre marie juan carmen".split())
CONTACTS = ("contact", "name", "call", "mail", "reach", "born", "signed")
SECRETS = re.compile(r"(?i)(?:token|secret|passwd|password|key|auth|credential|bearer)\W*$")
ANNOUNCE = re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|contact|mail|reach|ssn|social security|iban|account|name|born|passport|id)\b")
AGAINST = re.compile(r"(?i)\b(?:version|isbn|issn|page|chapter|figure|table|section|order|item|price|total|year|copyright|license)\b")
HOSTS = re.compile(r"(?i)\b(?:com|org|net|edu|gov|io|de|fr|es|uk)$")

_NAME = "[A-Z][a-z]{1,30}"
# A pattern with groups gives the group's span, the rest is context.
_CANDIDATES = {
    "address": re.compile(r"(?i)\b[a-z0-9][a-z0-9._-]{0,63}\s?(?:\(at\)|\[at\]|\bat\b)\s?[a-z0-9-]{1,63}\s?(?:\(dot\)|\[dot\]|\bdot\b)\s?[a-z]{2,6}\b"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "name": re.compile(rf"\b(?:(?i:{'|'.join(CONTACTS)}):? ({_NAME} {_NAME})|(?i:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME})?)\b"),
    "number": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "secret": re.compile(r"[:=]\s?[\"']?((?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9][A-Za-z0-9+/_=-]{15,}+)"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
_NEEDS = {"address": ("at", "dot"), "iban": (), "name": (), "number": (), "secret": (), "ssn": ("-",)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from left to right, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed and then by start; leftmost, not overlapping within a kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) < 19 and int(x) <= 255 or int(x[-18:]) <= 255 and not x[:-18].strip("0") for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NON_DIGIT.sub("", m[0])) <= 15]
    return out


# Labelers: 1 for personal data, -1 against, 0 no vote. ``before`` and ``after`` are up to CONTEXT characters beside the candidate.
def _by_format(kind, span, before, after):
    digits = _NON_DIGIT.sub("", span)
    if kind == "iban":
        return 1 if _iban_holds(span) else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    if kind == "number":
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    if kind == "secret":
        return 1 if any(map(str.isalpha, span)) and len(set(span)) >= 8 else -1
    return 1 if kind == "address" and ("(" in span or "[" in span) else 0


def _by_gazetteer(kind, span, before, after):
    if kind == "address":
        return 1 if HOSTS.search(span) else -1
    if kind == "name":
        words = [w.lower().rstrip(".") for w in span.split()]
        return 1 if GIVEN.intersection(words) else 0 if words[0] in TITLES else -1
    if kind == "secret":
        return 1 if SECRETS.search(before) else 0
    return 0


def _by_announcement(kind, span, before, after):
    return 1 if ANNOUNCE.search(before) else 0


def _by_counter_words(kind, span, before, after):
    return -1 if AGAINST.search(before) else 0


def _by_surroundings(kind, span, before, after):
    """Many digits around speak for a table of figures; plain words on both sides speak for a mention."""
    if kind == "secret":
        return 0
    near = before[-15:] + after[:15]
    return -1 if sum(map(str.isdigit, near)) > 8 else 1 if near and sum(map(str.isalpha, near)) > 0.7 * len(near) else 0


LABELERS = (_by_format, _by_gazetteer, _by_announcement, _by_counter_words, _by_surroundings)
SHAPES = ("long", "spaced", "upper")


def _iban_holds(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _shape(span: str) -> tuple[int, ...]:
    return int(len(span) > 16), int(" " in span), int(span[:1].isupper())


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, pattern) of spans beyond the base ones; pattern holds the kind's number, the votes and the shape."""
    low, out = None, []
    for n, kind in enumerate(KINDS):
        if _NEEDS[kind]:
            low = text.lower() if low is None else low
            if not all(x in low for x in _NEEDS[kind]):
                continue
        for m in _CANDIDATES[kind].finditer(text):
            a, b = m.span(m.lastindex or 0)
            span, before, after = text[a:b], text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
            out.append((kind, a, b, (n, *(f(kind, span, before, after) for f in LABELERS), *_shape(span))))
    return out


def count_patterns(docs: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each vote and shape pattern occurs in the whole corpus (a bounded number of patterns)."""
    def count(batches):
        for batch in batches:
            tally = Counter(p for t in as_text(batch.column(0)) for *_, p in candidates(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, tally)), pa.list_(pa.int32())),
                                              pa.array(list(tally.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select("text").mapInArrow(count, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return {tuple(r["pattern"]): r["n"] for r in sorted(rows, key=lambda r: tuple(r["pattern"]))}


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS, prior: float = PRIOR):
    """Expectation-maximisation over vote patterns.

    Returns the posterior of each pattern and, for each labeler, the rate of
    right votes on personal data and on other text (smoothed).
    """
    yes, no = np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.8)
    posterior = np.full(len(votes), prior)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (np.where(votes == 1, np.log(yes / (1 - no)), 0)
                                              + np.where(votes == -1, np.log((1 - yes) / no), 0)).sum(axis=1)
        posterior = 1 / (1 + np.exp(-odds))
        a, b = (n * posterior)[:, None], (n * (1 - posterior))[:, None]
        yes = ((a * (votes == 1)).sum(0) + 8) / ((a * (votes != 0)).sum(0) + 10)
        no = ((b * (votes == -1)).sum(0) + 8) / ((b * (votes != 0)).sum(0) + 10)
        prior = min(0.95, max(0.05, ((n * posterior).sum() + 1) / (n.sum() + 2)))
    return posterior, yes, no


def train(docs: DataFrame) -> dict[tuple[int, ...], bool]:
    """Which patterns the final classifier accepts, learned from the whole corpus."""
    counts = count_patterns(docs)
    if not counts:
        return {}
    patterns, n = np.array(list(counts)), np.array(list(counts.values()), float)
    posterior, _, _ = reliabilities(patterns[:, 1:1 + len(LABELERS)], n)
    x = _design(patterns)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(100):  # logistic regression on soft labels, Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)),
                               x.T @ (weight * (posterior - p)) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    accepted = 1 / (1 + np.exp(-(x @ w))) >= ACCEPT
    # at least one labeler must speak for the span
    accepted &= (patterns[:, 1:1 + len(LABELERS)] == 1).any(axis=1)
    return dict(zip(counts, accepted.tolist(), strict=True))


def _design(patterns: np.ndarray) -> np.ndarray:
    votes, shapes = patterns[:, 1:1 + len(LABELERS)], patterns[:, 1 + len(LABELERS):]
    return np.hstack([patterns[:, :1] == np.arange(len(KINDS)), votes == 1, votes == -1, shapes]).astype(float)


def all_spans(text: str, accepted: dict) -> tuple[list, list]:
    """Base spans, and base plus accepted spans: base kinds as listed, then the added kinds by name, each by start."""
    base = base_spans(text)
    wanted = [c for c in candidates(text) if accepted.get(c[3])]
    taken, added = _Taken(base), []
    for kind, a, b, _ in wanted:
        if taken.take(a, b):
            added.append((kind, a, b))
    return base, base + added


class _Taken:
    """Parts of a text that are taken: ascending, none overlapping another."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Takes a to b if no part of it is taken."""
        i = bisect_right(self.starts, a)
        if i and self.ends[i - 1] > a or i < len(self.starts) and self.starts[i] < b:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans of every row."""
    accepted = train(docs)

    def run(batches):
        for batch in batches:
            rows = [all_spans(t.as_py(), accepted) for t in as_text(batch.column(1))]
            counts = [Counter(k for k, _, _ in base) for base, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in BASE_KINDS),
                 pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                 pa.array([_joined(every) for _, every in rows], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, accepted: dict) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    spans = sorted(all_spans(text, accepted)[1], key=lambda s: (s[1], -s[2]))
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if spans else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; null texts stay null, other columns stay."""
    accepted, at = train(docs), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, accepted) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)

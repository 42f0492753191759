"""Personal data by weak supervision (operator 8).

Base patterns find certain spans. Wider patterns propose more; regex, checksum, gazetteer and context labelers vote on
every candidate. How often each combination of votes and features occurs is counted over the whole corpus (a table as
small as the number of combinations), expectation-maximisation estimates each labeler's reliability from it, and a
logistic classifier trained on the estimated labels decides which candidates become spans.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, on_workers, trimmed

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name")

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where a run of digits does, as a run that it doesn't begin with can't begin one further on; so runs are read once.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
#: Candidates: addresses written out, phone numbers without a plus, values given to a name, titled or known names.
_spelled = re.compile(r"[\[( ](?:at|AT|arobase)[\]) ]")
_spelled_left = re.compile(r"[A-Za-z0-9._%+-]+ ?\Z")
_spelled_right = re.compile(r" ?[A-Za-z0-9-]+(?: ?[\[(]?(?:dot|DOT|punkt|point|punto|\.)[\])]? ?[A-Za-z0-9-]+)+")
_local_phone = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_value = re.compile(r"[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{16,})")
_upper = "".join(c for c in map(chr, range(0x10000)) if c.isupper())
_lower = "".join(c for c in map(chr, range(0x10000)) if c.islower() or "\u0300" <= c <= "\u036f")
_name = rf"[{_upper}](?:[{_lower}]{{1,20}}|['\u2019](?=[{_upper}]))(?:['\u2019-]?[{_upper}][{_lower}]{{1,20}}){{0,2}}"
#: Matches overlap: each word that may start a name, the word after it and the one after that.
_two_names = re.compile(rf"(?={_name} )(?=({_name}) ({_name})(?: ({_name}))?)")
_titled = re.compile(rf"(?<!\w)(?:Mrs?|Ms|Dr|Prof|Herrn?|Frau|Señor(?:a|ita)?|Sra?|Madame|Mme|Monsieur)\.? ({_name}(?: {_name})?)")

#: Fixed values of the gazetteers and context labelers.
GIVEN_NAMES = frozenset("""
Alexander Alice Andrea Andreas Andrew Anna Anne Antonio Barbara Carlos Carmen Catherine Charles Christian Christine Claire Claudia
Daniel David Elena Elizabeth Emily Emma Francisco Friedrich George Hans Isabel James Jean Jennifer Jessica Johann John Jorge Jose
Joseph Juan Julia Karl Karen Katharina Klaus Laura Linda Louis Lucia Luis Manuel Marco Margaret Maria Marie Mark Martin Mary Matthew
Michael Michel Miguel Monika Nathalie Nicolas Pablo Patricia Paul Pedro Peter Philippe Pierre Richard Robert Sabine Sarah Sofia
Sophie Stefan Susan Thomas Ursula Wolfgang William
""".split())
TOP_DOMAINS = frozenset("com org net edu gov info biz io de fr es uk it nl ch at be us ca eu".split())
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
#: Words that stand before a name and don't start one.
BEFORE_NAMES = frozenset("dear contact herr herrn frau mr mrs ms dr prof señor señora señorita sr sra madame mme monsieur by from regards hello hi call write".split())
CUES = {
    "email": frozenset("mail email e-mail contact write courriel correo adresse".split()),
    "ip": frozenset("ip host server address addr from client adresse".split()),
    "card": frozenset("card visa mastercard amex credit karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon teléfono téléphone appelez llame".split()),
    "secret": frozenset("token secret password passwd pwd key apikey api_key bearer auth".split()),
    "name": frozenset("mr mrs ms dr prof sr sra mme contact name named herr herrn frau señor señora madame monsieur regards dear by".split()),
}
COUNTER_CUES = frozenset("version license section chapter isbn issue figure table page order invoice id no step sha commit hash md5 build".split())
_word = re.compile(r"[\w-]+")
#: Labelers by place in a candidate's votes; each says 1 (personal), -1 (not) or 0 (abstains).
LABELERS = ("shape", "checksum", "gazetteer", "cue", "counter", "isolation")
EM_ROUNDS = 50
THRESHOLD = 0.5
#: What the context labelers look at: the last words before a candidate. And the longest name before the @ of an address by its standard.
CUE_WORDS, CUE_CHARS = 4, 40
LOCAL_CHARS = 64
#: Columns that ``find_spans`` adds.
FOUND = (*(f"n_{k}" for k in BASE_KINDS), "n_spans", "base_sha256", "spans")

Span = tuple[int, int, int]  # kind, start, end


def given(word: str) -> bool:
    """Whether ``word`` is a given name of the gazetteer, with accents or without."""
    return word in GIVEN_NAMES or not word.isascii() and "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)) in GIVEN_NAMES


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[Span]:
    """Certain spans: leftmost matches of each kind that don't overlap, without those that fail its test."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # a match has one @, so its start is the run of name characters before it
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _digit.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _ip.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _phone.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _votes(text: str, kind: int, start: int, end: int, shape: int) -> tuple[int, ...]:
    body = text[start:end]
    before = [w.lower() for w in _word.findall(text[max(0, start - CUE_CHARS):start])[-CUE_WORDS:]]
    digits = "".join(c for c in body if c.isdigit())
    checksum = gazetteer = 0
    name = KINDS[kind]
    if name == "card":
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else -1
    elif name == "email":
        gazetteer = 1 if body.rpartition(".")[2].rpartition(" ")[2].lower() in TOP_DOMAINS else -1
    elif name == "name":
        gazetteer = 1 if given(body.split(" ")[0]) else -1 if " " in body else 0
    elif name == "secret":
        mixed = bool(digits) and any(c.isalpha() for c in body)
        checksum = 1 if mixed and len(set(body.lower())) >= 8 else -1
    cue = 1 if any(w in CUES[name] for w in before) else 0
    counter = -1 if any(w in COUNTER_CUES for w in before) else 0
    left, right = text[start - 1:start], text[end:end + 1]
    isolation = -1 if left.isalnum() or right.isalnum() else 1
    return shape, checksum, gazetteer, cue, counter, isolation


def candidates(text: str, taken: list[Span]) -> list[tuple[Span, int]]:
    """Spans that wider patterns propose, and the code of each one's kind, votes and features. None overlaps a base span or an earlier candidate."""
    found: list[tuple[Span, int]] = []
    starts: list[int] = []  # of stretches that are taken, in order, and their ends
    ends: list[int] = []
    for _, s, e in sorted(taken, key=lambda x: x[1:]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def propose(kind: int, start: int, end: int, shape: int) -> None:
        k = bisect_left(starts, end)  # stretches before k start before ``end``
        if k and ends[k - 1] > start:
            return
        starts.insert(k, start)
        ends.insert(k, end)
        votes = _votes(text, kind, start, end, shape)
        code = kind
        for v in votes:
            code = code * 3 + v + 1
        found.append(((kind, start, end), code * 4 + min(3, (end - start) // 12)))

    if "=" in text or ":" in text:
        for m in _value.finditer(text):
            propose(4, m.start(1), m.end(1), 1 if m.end(1) - m.start(1) >= 24 else 0)
    if _digit.search(text):
        for m in _card.finditer(text):
            if 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                propose(2, m.start(), m.end(), 1 if len(m[0]) in (15, 16, 18, 19) else 0)
        for m in _local_phone.finditer(text):
            propose(3, m.start(), m.end(), 1 if m[0][0] == "(" else 0)
    if " at" in text or "[at" in text or "(at" in text or "AT" in text or "arobase" in text:
        for m in _spelled.finditer(text):
            left, right = _spelled_left.search(text, max(0, m.start() - LOCAL_CHARS - 1), m.start()),_spelled_right.match(text, m.end())
            if left and right and (m[0].strip("[]() ") != m[0].strip() or "dot" in right[0].lower()):
                propose(0, left.start(), right.end(), 1 if m[0][0] in "[(" else 0)
    for m in _titled.finditer(text):
        propose(5, m.start(1), m.end(1), 1)
    pairs = [m for m in _two_names.finditer(text) if m[1].lower() not in BEFORE_NAMES]
    for known in (True, False):  # of pairs that overlap, the one that a given name starts
        for m in pairs:
            if given(m[1]) == known:
                propose(5, m.start(1), m.end(3) if m[3] and known and given(m[2]) else m.end(2), 0)
    return found


def decode(code: int) -> tuple[int, tuple[int, ...], int]:
    """Kind, votes and length class of a code."""
    code, length = divmod(code, 4)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, tuple(reversed(votes)), length


class SpanModel:
    """Which candidate codes are personal data; fitted from the counts of codes."""

    def __init__(self, counts: dict[int, int]):
        self.codes = sorted(counts)
        self.reliability: dict[tuple[int, str], tuple[float, float]] = {}
        if not self.codes:
            self.accepted: frozenset[int] = frozenset()
            return
        rows = [decode(c) for c in self.codes]
        kinds = np.array([r[0] for r in rows])
        votes = np.array([r[1] for r in rows])
        length = np.array([r[2] for r in rows])
        n = np.array([counts[c] for c in self.codes], float)
        self.posterior = self._em(kinds, votes, n)
        x = np.concatenate([np.eye(len(KINDS))[kinds], votes == 1, votes == -1, np.eye(4)[length]], axis=1).astype(float)
        self.weights = self._logistic(x, self.posterior, n)
        p = 1 / (1 + np.exp(-x @ self.weights))
        self.accepted = frozenset(c for c, ok in zip(self.codes, (p >= THRESHOLD).tolist(), strict=True) if ok)

    def _em(self, kinds: np.ndarray, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Posteriors of the label given the votes; labelers are independent given kind and label, with a prior for each kind."""
        p = 1 / (1 + np.exp(-1.5 * (votes.sum(axis=1) - 0.5)))
        for _ in range(EM_ROUNDS):
            log = np.zeros((len(p), 2))
            for kind in np.unique(kinds):
                at = kinds == kind
                w = np.stack([(1 - p[at]) * n[at], p[at] * n[at]])
                log[at] += np.log((w.sum(axis=1) + 1) / (w.sum() + 2))
                for j, name in enumerate(LABELERS):
                    table = np.stack([[w[y][votes[at, j] == v].sum() for v in (-1, 0, 1)] for y in (0, 1)]) + np.array([[1.0, 1, 0.5], [0.5, 1, 1.0]])
                    table /= table.sum(axis=1, keepdims=True)
                    log[at] += np.log(table[:, votes[at, j] + 1]).T
                    self.reliability[int(kind), name] = float(table[0, 0]), float(table[1, 2])
            new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        return p

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights by Newton's method on soft labels, with a ridge."""
        w = np.zeros(x.shape[1])
        n = n / n.mean()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.05 * np.eye(len(w))
            step = np.linalg.solve(hessian, x.T @ (n * (y - p)) - 0.05 * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        return w


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Counts candidate codes over all rows and whole texts and fits the model. What reaches the driver has a row a distinct code: 6 x 3^6 x 4 at most."""
    on_workers(docs.sparkSession)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    for _, code in candidates(t, base_spans(t)):
                        seen[code] = seen.get(code, 0) + 1
        yield pa.record_batch({"code": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = docs.select(text).mapInArrow(trimmed(codes), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return SpanModel({r["code"]: r["n"] for r in counted.collect()})


def spans_of(text: str, accepted: frozenset[int]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind and start."""
    base = sorted(base_spans(text))
    more = [span for span, code in candidates(text, base) if code in accepted]
    return base, sorted([*base, *more])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (of overlapping ones the whole stretch) replaced by its kind in angle brackets."""
    merged: list[list[int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    out, at = [], 0
    for k, s, e in merged:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` without its texts, with n_email, n_ip, n_card, n_phone (base spans), n_spans (all), base_sha256 and spans; nothing is shuffled.

    A null or empty text has no span. One row a row of ``docs``, repeated ones too; columns of these names that it has already are replaced.
    """
    on_workers(docs.sparkSession)
    accepted = docs.sparkSession.sparkContext.broadcast(model.accepted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, written, sizes = [], [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                base, every = spans_of(t or "", accepted.value)
                counts.append([sum(1 for s in base if s[0] == k) for k in range(len(BASE_KINDS))])
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(every))
                sizes.append(len(every))
            out =dict(zip(batch.schema.names[:-1], batch.columns[:-1], strict=True))
            out |= {f"n_{kind}": pa.array([c[k] for c in counts], pa.int64()) for k, kind in enumerate(BASE_KINDS)}
            yield pa.record_batch(out | {"n_spans": pa.array(sizes, pa.int64()), "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(written, pa.string())})

    rest = [c for c in docs.columns if c != text and c not in FOUND]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in FOUND)])
    return docs.select(*(f"`{c}`" for c in rest), text).mapInArrow(trimmed(run), fields)


def mask(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with all spans in ``text`` replaced; other columns and null texts stay."""
    on_workers(docs.sparkSession)
    accepted = docs.sparkSession.sparkContext.broadcast(model.accepted)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t, spans_of(t, accepted.value)[1]) if t else t for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, run(F.col(text)))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its spans."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return find_spans(docs, fit(docs))

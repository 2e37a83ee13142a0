"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

The field labels whitespace words with O or a kind of personal data. Its features are properties of a word's
shape (letters, digits and punctuation classes, never the letters themselves), the shapes of both
neighbours, and whether words that announce a telephone number or another kind of number stand before digits. It is trained from a small labelled table: windows
of a bounded sample of documents around pattern matches, and windows into which numbers were set whose label their form and context
decide. Decoding runs Viterbi over all words of a batch of documents at once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]")

#: Bytes to shape classes: a-z and other scripts x, A-Z X, digits d, the rest as it is.
SHAPE = bytes(ord("d") if 48 <= b < 58 else ord("X") if 65 <= b < 91 else ord("x") if 97 <= b < 123 or b >= 128 else b for b in range(256))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m.groups()))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(out)


#: Words that announce a telephone number, and words that announce numbers of other kinds. Fixed values.
PHONE_CUES = frozenset("call calls cell fax mobile phone phones ring sms tel telephone whatsapp appelez portable tél téléphone anruf anrufen handy telefon telefonnummer llamar llame móvil teléfono".encode().split())
NUMBER_CUES = frozenset("account article chapter code count id invoice isbn item lines no number order page pages part ref reference row rows section serial sum table total values version year years commande facture numéro référence bestellung nr nummer rechnung seite factura número pedido página".encode().split())
#: What stands for a word that announces a telephone number, or another one.
PHONE_CUE, NUMBER_CUE = b"\x01", b"\x02"
OUTER = b".,;:!?\"'()[]{}<>|*#$&%"


def shapes(text: str) -> list[bytes]:
    """A shape a word; the word before digits is a cue if it or the word before it announces a number and it has no digit itself."""
    raw = text.encode("utf-8", "surrogatepass")
    out = raw.translate(SHAPE).split()
    at = [i for i in range(1, len(out)) if b"d" in out[i] and b"d" not in out[i - 1]]
    if at:
        words = raw.split()
        for i in at:
            for j in (i - 1, i - 2):
                word = words[j].strip(OUTER).lower() if j >= 0 else b""
                if word in PHONE_CUES or word in NUMBER_CUES:
                    out[i - 1] = PHONE_CUE if word in PHONE_CUES else NUMBER_CUE
                    break
    return out


#: Properties of a shape, each a yes or no; the first is always yes.
N_FEATURES = 26


def features(shape: bytes) -> np.ndarray:
    bare = shape.strip(OUTER)
    d, parts = bare.count(b"d"), re.split(rb"[ .-]", bare)
    counts = [d == 0, d == 1, d == 2, d == 3, d == 4, 5 <= d <= 8, 9 <= d <= 11, 12 <= d <= 15, d == 16, d > 16]
    forms = [b"@" in bare, b"@" in bare and b"." in bare.partition(b"@")[2], bare.startswith(b"+") or shape.startswith(b"+"), shape.startswith(b"(") and d > 0]
    groups = [len(parts) == 4 and all(p and set(p) == {100} and len(p) <= 3 for p in parts), len(parts) > 1 and d == len(bare) - len(parts) + 1, d > 0 and d == len(bare), d > 0 and b"-" in bare]
    letters = [d == 0 and bare.islower(), d == 0 and bare[:1] == b"X", d > 0 and (b"x" in bare or b"X" in bare), not bare, shape != bare]
    return np.array([True, *counts, *forms, *groups, *letters, shape == PHONE_CUE, shape == NUMBER_CUE], np.float32)


@dataclass
class Field:
    """own, before, after: [N_FEATURES, labels] weights of a word's, its left and right neighbour's features; step: [labels, labels]; start: [labels]."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray
    start: np.ndarray
    known: dict[bytes, int] = field(default_factory=dict)
    rows: np.ndarray | None = None
    most: int = 200_000

    def forget(self) -> None:
        """Drops the known shapes where they are more than ``most``; row numbers given before are void then."""
        if len(self.known) > self.most:
            self.known.clear()
            self.rows = None

    def ids(self, words: list[bytes]) -> np.ndarray:
        """A row number for each shape; new shapes get their scores computed once."""
        get = self.known.get
        found = [get(w, -1) for w in words]
        if -1 in found:
            new = list(dict.fromkeys(w for w in words if w not in self.known))
            x = np.stack([features(w) for w in new])
            scores = np.stack([x @ self.own, x @ self.before, x @ self.after])
            base = len(self.known)
            if self.rows is None or self.rows.shape[1] < base + len(new):  # room for twice as many
                room = np.zeros((3, 2 * (base + len(new)), scores.shape[2]), scores.dtype)
                room[:, :base] = 0.0 if self.rows is None else self.rows[:, :base]
                self.rows = room
            self.rows[:, base : base + len(new)] = scores
            self.known.update((w, base + i) for i, w in enumerate(new))
            found = [self.known[w] for w in words]
        return np.array(found, np.int32)


def decode(model: Field, docs: list[np.ndarray]) -> list[np.ndarray]:
    """The best label of every word of several documents (arrays of row numbers), by Viterbi.

    Documents are sorted by length, so that at each step the active ones are the first k.
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lengths = np.array([len(docs[i]) for i in order])
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(docs)
    n_docs = int((lengths > 0).sum())
    if not n_docs:
        return out
    first = np.r_[0, np.cumsum(lengths)][:n_docs]
    ids = np.concatenate([docs[i] for i in order])
    own, before, after = model.rows
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    back = np.zeros((len(ids), len(LABELS)), np.int8)
    ends = np.zeros(n_docs, np.int64)
    step = model.step.T[None]
    best = np.zeros((n_docs, len(LABELS)), np.float32)
    for t in range(lengths[0]):
        k = active[t]
        at = first[:k] + t
        emit = own[ids[at]]
        more = active[t + 1] if t + 1 < lengths[0] else 0
        if more:
            emit[:more] += after[ids[at[:more] + 1]]
        if t == 0:
            best[:k] = emit + model.start
        else:
            emit += before[ids[at - 1]]
            paths = best[:k, None, :] + step
            back[at] = came = paths.argmax(axis=2)
            best[:k] = np.take_along_axis(paths, came[:, :, None], 2)[:, :, 0] + emit
        if more < k:
            ends[more:k] = best[more:k].argmax(axis=1)
    labels = np.zeros(len(ids), np.int8)
    now = ends.copy()
    for t in range(lengths[0] - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = now[:k]
        now[:k] = back[at, now[:k]]
    for j, i in enumerate(order[:n_docs]):
        out[i] = labels[first[j] : first[j] + lengths[j]]
    return out


def word_labels(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """A label number for each word: the kind of the first span that it touches, else 0."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out = np.zeros(len(words), np.int8)
    starts = np.array([a for a, _ in words])
    for a, kind, b in reversed(spans):
        i = max(0, int(np.searchsorted(starts, a, side="right")) - 1)
        while i < len(words) and words[i][0] < b:
            if words[i][1] > a:
                out[i] = kind + 1
            i += 1
    return out


#: Telephone numbers by their form alone, as shapes of words.
PLAIN_PHONES = ((b"(ddd)", b"ddd-dddd"), (b"ddd-ddd-dddd",), (b"ddd.ddd.dddd",), (b"(ddd)", b"ddd", b"dddd"), (b"ddd", b"ddd-dddd"))
#: Numbers that are telephone numbers behind a word that says so, and other numbers without it.
OPEN_FORMS = ((b"dddddddddd",), (b"dddd", b"dddddd"), (b"dd", b"dd", b"dd", b"dd"), (b"dddddd-ddddd",), (b"ddd", b"ddd", b"ddd"), (b"dddddddd",), (b"ddd", b"ddd", b"dddd"), (b"ddd-dddd",), (b"ddddd", b"dddd"))
#: Numbers that are never telephone numbers: years, dates, amounts, book numbers, rows of figures.
OTHER_FORMS = ((b"dddd",), (b"dddd", b"dddd", b"dddd"), (b"dd.dd.dddd",), (b"dddd-dd-dd",), (b"d,ddd,ddd",), (b"ddd-d-dd-dddddd-d",), (b"ddddddddddddd",), (b"ddd",), (b"dd",), (b"d.dd",), (b"dd", b"ddd", b"dd", b"d"))
#: Places that may be a telephone number without a plus sign: no window of a text with one is taken, as nobody knows its label.
UNSURE = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])")


def with_number(words: list[bytes], labels: np.ndarray, at: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The window with numbers of several forms set in before word ``at``: one by form alone, one behind each kind of cue or none, one that is none.

    The window's own length and words pick the forms.
    """
    pick = zlib.crc32(b" ".join(words))
    phone = LABELS.index("phone")
    take = lambda forms, by: forms[(pick >> by) % len(forms)]
    lone, open_, other = take(PLAIN_PHONES, 0), take(OPEN_FORMS, 7), take(OTHER_FORMS, 14)
    cases = [((), lone, phone), ((PHONE_CUE,), take(PLAIN_PHONES, 3), phone), ((PHONE_CUE,), open_, phone), ((PHONE_CUE,), take(OPEN_FORMS, 11), phone)]
    cases += [((NUMBER_CUE,), take(OPEN_FORMS, 9), 0), ((), open_, 0), ((), other, 0), ((NUMBER_CUE,), take(OTHER_FORMS, 17), 0)]
    for cue, form, label in cases:
        yield [*words[:at], *cue, *form, *words[at:]], np.r_[labels[:at], np.zeros(len(cue)), np.full(len(form), label), labels[at:]].astype(np.int8)


def labelled_table(docs: DataFrame, *, max_docs: int = 4000, max_windows: int = 1500, around: int = 6) -> pd.DataFrame:
    """The training table (shapes, labels), one window a row, from at most about max_docs documents.

    Documents are chosen by a hash of the text. Each gives windows around its base spans, at most eight, and one from its middle, this also with
    numbers set in (``with_number``); rows beyond max_windows, in the order of a hash, are left out. Texts with a number of unsure kind
    give none. Null texts don't count, an empty table gives none.
    """
    texts = docs.where(F.col("text").isNotNull()).select("text")
    share = max_docs / max(1, texts.count())
    if share < 1:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                spans = base_spans(text)
                if any(not any(a < m.end() and m.start() < b for a, _, b in spans) for m in UNSURE.finditer(text)):
                    continue
                words, labels = shapes(text), word_labels(text, spans)
                hits = np.flatnonzero(labels)
                middle = len(words) // 2
                for c in (middle, *hits[:16:2]):
                    a, b = max(0, c - around), c + around + 1
                    if words[a:b]:
                        rows.append((b" ".join(words[a:b]), labels[a:b].tobytes()))
                a, b = max(0, middle - around), middle + around + 1
                if words[a:b] and not labels[a:b].any():
                    rows += [(b" ".join(w), marks.tobytes()) for w, marks in with_number(words[a:b], labels[a:b], middle - a)]
            yield pd.DataFrame(rows, columns=["shapes", "labels"])

    made = texts.mapInPandas(cut, "shapes binary, labels binary").distinct().orderBy(F.xxhash64("shapes", "labels")).limit(max_windows)
    return made.toPandas()


def train(table: pd.DataFrame, *, rounds: int = 100, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam over all windows at once; the same for the same table."""
    n_labels = len(LABELS)
    zero = lambda *s: np.zeros(s, np.float64)
    p = [zero(N_FEATURES, n_labels), zero(N_FEATURES, n_labels), zero(N_FEATURES, n_labels), zero(n_labels, n_labels), zero(n_labels)]
    p[0][0, 0] = 1.0
    if len(table):
        words = [bytes(x).split(b" ") for x in table["shapes"]]
        longest = max(map(len, words))
        x, y, on = zero(len(words), longest + 2, N_FEATURES), np.zeros((len(words), longest), np.int64), np.zeros((len(words), longest), bool)
        for i, (ws, ls) in enumerate(zip(words, table["labels"], strict=True)):
            x[i, 1 : len(ws) + 1] = [features(w) for w in ws]
            y[i, : len(ws)], on[i, : len(ws)] = np.frombuffer(bytes(ls), np.int8), True
        lengths, every = on.sum(axis=1), np.arange(len(words))
        parts = [x[:, 1:-1], x[:, :-2], x[:, 2:]]
        gold = np.eye(n_labels)[y] * on[:, :, None]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for r in range(1, rounds + 1):
            emit = sum(a @ w for a, w in zip(parts, p[:3], strict=True))
            emit[:, 0] += p[4]
            f, b = np.zeros_like(emit), np.zeros_like(emit)
            f[:, 0] = emit[:, 0]
            for t in range(1, longest):
                new = np.logaddexp.reduce(f[:, t - 1, :, None] + p[3], axis=1) + emit[:, t]
                f[:, t] = np.where(on[:, t, None], new, f[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = np.logaddexp.reduce(p[3] + (emit[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
                b[:, t] = np.where(on[:, t + 1, None], new, 0.0)
            z = np.logaddexp.reduce(f[every, lengths - 1], axis=1)
            gap = (np.exp(f + b - z[:, None, None]) * on[:, :, None]) - gold
            pair = np.exp(f[:, :-1, :, None] + p[3] + (emit + b)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
            seen = gold[:, :-1, :, None] * gold[:, 1:, None, :]
            grads = [np.einsum("ntf,ntl->fl", a, gap) for a in parts] + [(pair - seen).sum(axis=(0, 1)), gap[:, 0].sum(axis=0)]
            for i, g in enumerate(grads):
                g = g / len(words) + decay * p[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.999**r)) + 1e-8)
    return Field(*[a.astype(np.float32) for a in p])


def _plausible(text: str, kind: int, a: int, b: int) -> bool:
    """Whether a labelled stretch can be of its kind: an @ with a domain, four bytes, a Luhn number, 7 to 15 digits with nothing but signs of telephone numbers between them."""
    part = text[a:b]
    digits = "".join(DIGITS.findall(part))
    if kind == 0:
        return bool(DOMAIN.search(part)) and not part.startswith("@")
    if kind == 1:
        m = IP.fullmatch(part)
        return bool(m) and all(map(_small, m.groups()))
    return 12 <= len(digits) <= 19 and bool(CARD.fullmatch(part)) and _luhn(digits) if kind == 2 else 7 <= len(digits) <= 15 and not part.strip("+0123456789 ().-/")


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of one label as spans, without outer punctuation and where they overlap no base span.

    A run must be plausible for its kind; one that is not is tried word by word.
    """
    hits = np.flatnonzero(labels)
    if not len(hits):
        return []
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out: list[tuple[int, int, int]] = []

    def add(i: int, j: int) -> None:
        (a, _), (_, b) = words[i], words[j]
        while a < b and text[a] in ".,;:!?\"'[]{}<>|*#$&%":
            a += 1
        while a < b and text[b - 1] in ".,;:!?\"'([{<|*#$&%":
            b -= 1
        kind = int(labels[i]) - 1
        if _plausible(text, kind, a, b):
            if not any(s < b and a < e for s, _, e in base):
                out.append((a, kind, b))
        elif i < j:
            for k in range(i, j + 1):
                add(k, k)

    for run in np.split(hits, np.flatnonzero((np.diff(hits) > 1) | (np.diff(labels[hits]) != 0)) + 1):
        add(int(run[0]), int(run[-1]))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def report(docs: DataFrame, model: Field | None = None, *, batch_words: int = 4_000_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text is an empty one. Long texts are read whole, spans that begin at one place are ordered by kind, repeated rows
    are read one by one; an empty table trains nothing and gives no rows; other columns are ignored.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_table(docs)) if model is None else model)

    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            texts = [t or "" for t in part]
            labels: list[np.ndarray] = []
            held: list[np.ndarray] = []
            n = 0
            for i, t in enumerate(texts):
                held.append(m.ids(shapes(t)))
                n += len(held[-1])
                if n >= batch_words or len(m.known) > m.most or i == len(texts) - 1:
                    labels += decode(m, held)
                    held, n = [], 0
                    m.forget()
            rows = []
            for t, found in zip(texts, labels, strict=True):
                base = base_spans(t)
                count = [sum(k == x for _, x, _ in base) for k in range(len(KINDS))]
                rows.append((*count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added_spans(t, found, base))))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    found = F.pandas_udf(scan, kind)(F.col("text"))
    return docs.select("doc_id", found.alias("x")).select("doc_id", "x.*")


def redact(text: str, spans: str) -> str:
    """A text with its spans (as listed) replaced by their kinds in brackets."""
    at, out = 0, []
    for x in filter(None, spans.split(",")):
        kind, a, b = x.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind}]"]
            at = int(b)
    return "".join([*out, text[at:]])

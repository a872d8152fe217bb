"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find emails, IP addresses, cards and phone numbers in whole texts; what they find
always stays. The field labels tokens (B-, I- of the four kinds, or O) from word shapes, digit
counts and neighbouring key words. It is trained on the driver from a small labelled table (a
parameter; the default is made by `training_table`, a few hundred rows), by gradient ascent on
the exact conditional likelihood, and decoded by Viterbi in numpy for all token sequences of a
batch that have one length. A sequence is a word with a digit or an at-sign and the two words on
either side, joined where they overlap: elsewhere there is no feature that speaks for a kind. A
span of the field counts if it is plausible for its kind, beats the labelling without it by
`margin`, and touches no span of the patterns.

One narrow pass, texts whole; the model's few thousand weights travel with the task. Nothing else
depends on other rows, so hot groups, ties and repeated rows change nothing.

Defined results: a null or empty text has no spans (a null text stays null when masked); spans
are offsets in code points, ends exclusive, ordered by start, then kind as in KINDS; other
columns pass through unless their name is `spans`.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import Words, chunks, small_batches, utf8, with_field

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, each kind leftmost and without overlap, sorted.
    Emails start from their at-signs and addresses from their runs of digits and dots: linear time on any text."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((begin, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(map(_small, m.group().split("."))):
                    found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


# -- features ---------------------------------------------------------------------------------

_KEYS = frozenset("call tel phone telephone mobile cell fax contact whatsapp email mail e-mail write card visa mastercard amex credit ip address host server ping from on at dial ring version page pages chapter isbn order invoice room no year since until in section".split())
_EDGE = "()[]{}<>,;:!?\"'.|"


def shape(token: str) -> str:
    """Letter runs as x, digit runs as their length or a range of lengths, marks as they are."""
    out, i, n = [], 0, len(token)
    while i < n and len(out) < 12:
        c, j = token[i], i
        if "0" <= c <= "9":
            while j < n and "0" <= token[j] <= "9":
                j += 1
            k = j - i
            out.append(str(k) if k < 5 else "5" if k < 9 else "9" if k < 13 else "13" if k < 20 else "20")
        elif c.isalpha():
            while j < n and token[j].isalpha():
                j += 1
            out.append("x")
        else:
            j += 1
            out.append(c)
        i = j
    return " ".join(out)


def token_features(tokens: list[str], k: int, shapes: list[str]) -> list[str]:
    t, s = tokens[k], shapes[k]
    d = sum("0" <= c <= "9" for c in t)
    word = t.strip(_EDGE).lower()
    before = tokens[k - 1].strip(_EDGE).lower() if k else "<"
    found = ["bias", f"s={s}", f"d={d if d < 6 else 6 + (d > 8) + (d > 10) + (d > 12) + (d > 15) + (d > 19)}", f"p={shapes[k - 1] if k else '<'}", f"n={shapes[k + 1] if k + 1 < len(tokens) else '>'}"]
    if word in _KEYS:
        found.append(f"w={word}")
    if before in _KEYS:
        found.append(f"b={before}")
    if k > 1 and (b2 := tokens[k - 2].strip(_EDGE).lower()) in _KEYS:
        found.append(f"bb={b2}")
    if "@" in t:
        found.append("at")
    if word in ("at", "dot") and t[:1] in "[({":
        found.append(f"m={word}")
    if t[:1] == "+":
        found.append("plus")
    if (dots := t.strip(_EDGE).count(".")) == 3 and d:
        found.append("quad")
    elif dots:
        found.append("dots")
    if t.count(":") >= 2 and all(c in "0123456789abcdefABCDEF:" for c in t.strip("()[]{}<>,;!?\"'.|")):
        found.append("hexcolon")
    return found


# -- the labelled table -----------------------------------------------------------------------


def training_table(rows: int = 500, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Tokens and labels of sentences made from formats of the four kinds and of numbers that are none of them."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("an be cor del er fi go hu in jo ka lu mi no or pa ri sa te un vi".split()) for _ in range(r.randint(1, 4)))
    host = lambda: f"{name()}{r.choice(['', '-', '7', ''])}.{r.choice('com org net example.com example.net de fr'.split())}"

    def card() -> str:
        body = r.choice("3456") + digits(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice([full, " ".join(full[k : k + 4] for k in range(0, 16, 4)), "-".join(full[k : k + 4] for k in range(0, 16, 4))])

    made = {
        "email": [lambda: f"{name()}.{digits(2)}@{host()}", lambda: f"{name()}@{host()}", lambda: f"{name()}_{name()}+{name()}@{host()}", lambda: f"{name()} [at] {name()} [dot] com", lambda: f"{name()}.{name()} (at) {host()}", lambda: f"{name()} (at) {name()} (dot) org"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: "2001:db8:" + ":".join(f"{r.randrange(65536):x}" for _ in range(6)), lambda: f"fe80::{r.randrange(65536):x}:{r.randrange(65536):x}:{r.randrange(65536):x}"],
        "card": [card],
        "phone": [lambda: f"+{r.choice('1 44 49 33'.split())} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{r.choice('44 49 34'.split())} {digits(2)} {digits(4)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+1-{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(11)}"],
    }
    none = [
        lambda: f"{r.randint(1900, 2030)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}",
        lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"{r.randint(0, 23)}:{digits(2)}:{digits(2)}", lambda: f"${r.randint(1, 999)}.{digits(2)}", lambda: f"{r.randint(1, 9)},{digits(3)}.{digits(2)}", lambda: f"{r.randint(0, 9)}.{digits(r.randint(1, 6))}", lambda: f"{r.randint(0, 9)}.0.", lambda: f"version {r.randint(1, 9)}.",
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"#{digits(r.randint(2, 7))}", lambda: digits(r.randint(1, 8)), lambda: digits(r.choice([9, 10, 11, 12, 16, 20])), lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{digits(2)}-{digits(2)}",
        lambda: f"{name()}{digits(2)}", lambda: f"@{name()}", lambda: f"{digits(2)}%", lambda: f"{digits(3)} {digits(3)}", lambda: f"{digits(3)} - {digits(3)}", lambda: f"({digits(4)})", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"{digits(2)} {digits(2)} {digits(2)}", lambda: f"|{digits(3)}|", lambda: f"chapter {digits(1)}.{digits(1)}.{digits(1)}.",
    ]
    lead = {"email": ["email", "mail", "write to", "contact:"], "ip": ["ip", "host", "server", "from"], "card": ["card", "visa", "credit card"], "phone": ["call", "tel", "phone:", "fax", "mobile"]}
    table = []
    for k in range(rows):
        tokens, labels = [], []

        def put(text: str, kind: str | None) -> None:
            for j, t in enumerate(text.split()):
                tokens.append(t)
                labels.append("O" if kind is None else f"{'BI'[j > 0]}-{kind}")

        for _ in range(r.randint(0, 2)):
            put(name() + r.choice(["", "", ",", "."]), None)
        for _ in range(r.choice([1, 1, 2])):
            if k % 5 < 2:
                kind = KINDS[r.randrange(4)]
                if r.random() < 0.4:
                    put(r.choice(lead[kind]), None)
                put(r.choice(made[kind])() + r.choice(["", "", ".", ","]), kind)
            else:
                if r.random() < 0.15:
                    put(r.choice("page year order since on in from no".split()), None)
                put(r.choice(none)() + r.choice(["", "", ".", ","]), None)
            for _ in range(r.randint(0, 2)):
                put(name() + r.choice(["", "", ",", "."]), None)
        table.append((tokens, labels))
    return table


# -- the field --------------------------------------------------------------------------------


@dataclass
class Field:
    features: dict[str, int]
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x label
    begins: np.ndarray

    def emissions(self, sequences: list[list[str]]) -> list[np.ndarray]:
        ids, sizes = [], []
        for tokens in sequences:
            shapes = [shape(t) for t in tokens]
            for k in range(len(tokens)):
                own = [i for f in token_features(tokens, k, shapes) if (i := self.features.get(f)) is not None]
                ids += own
                sizes.append(len(own))
        at = np.cumsum(sizes) - sizes
        flat = np.add.reduceat(self.weights[ids], at, axis=0)  # every token has a bias
        return np.split(flat, np.cumsum([len(s) for s in sequences])[:-1])

    def decode(self, sequences: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Best labels and emissions of each sequence; sequences of one length go together."""
        emissions = self.emissions(sequences) if sequences else []
        lengths = np.array([len(s) for s in sequences])
        out: list = [None] * len(sequences)
        for n in np.unique(lengths):
            where = np.flatnonzero(lengths == n)
            e = np.stack([emissions[i] for i in where])
            best, back = self.begins + e[:, 0], []
            for t in range(1, n):
                step = best[:, :, None] + self.moves
                back.append(step.argmax(1))
                best = step.max(1) + e[:, t]
            path = np.empty((len(where), n), np.int64)
            path[:, -1] = best.argmax(1)
            rows = np.arange(len(where))
            for t in range(n - 1, 0, -1):
                path[:, t - 1] = back[t - 1][rows, path[:, t]]
            for i, p, x in zip(where, path, e):
                out[i] = (p, x)
        return out

    def path_score(self, labels: np.ndarray, e: np.ndarray) -> float:
        return float(self.begins[labels[0]] + e[np.arange(len(labels)), labels].sum() + self.moves[labels[:-1], labels[1:]].sum())


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], steps: int = 100, rate: float = 0.1, ridge: float = 0.002) -> Field:
    """Maximises the penalised conditional log-likelihood with Adam; forward and backward sums run over all sequences at once."""
    features: dict[str, int] = {}
    rows, at, number = [], [], {label: k for k, label in enumerate(LABELS)}
    longest, n, m = max(len(t) for t, _ in table), len(table), len(LABELS)
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (tokens, labels) in enumerate(table):
        shapes = [shape(t) for t in tokens]
        gold[i, : len(tokens)], mask[i, : len(tokens)] = [number[x] for x in labels], True
        for k in range(len(tokens)):
            for f in token_features(tokens, k, shapes):
                rows.append(features.setdefault(f, len(features)))
                at.append(i * longest + k)
    rows, at = np.array(rows), np.array(at)
    tokens_at, token_first = np.unique(at, return_index=True)  # ascending as they were made
    by_feature = np.argsort(rows, kind="stable")
    feature_first = np.searchsorted(rows[by_feature], np.arange(len(features)))
    last = mask.sum(1) - 1
    allowed = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
    starts = np.array([not x.startswith("I-") for x in LABELS])
    params = [np.zeros((len(features), m)), np.zeros((m, m)), np.zeros(m)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = [np.zeros_like(p) for p in params]
    np.add.at(truth[0], (rows, gold.reshape(-1)[at]), 1)
    both = mask[:, 1:]
    np.add.at(truth[1], (gold[:, :-1][both], gold[:, 1:][both]), 1)
    np.add.at(truth[2], gold[:, 0], 1)
    for step in range(1, steps + 1):
        w, moves, begins = params
        moves, begins = np.where(allowed, moves, -1e4), np.where(starts, begins, -1e4)
        e = np.zeros((n * longest, m))
        e[tokens_at] = np.add.reduceat(w[rows], token_first, axis=0)
        e = e.reshape(n, longest, m)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = begins + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + moves, 1) + e[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = _log_sum(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t < last)[:, None], ahead, 0.0)
        z = _log_sum(alpha[np.arange(n), last], 1)
        node = np.where(mask[:, :, None], np.exp(np.minimum(alpha + beta - z[:, None, None], 0)), 0.0)
        expected = [np.add.reduceat(node.reshape(-1, m)[at[by_feature]], feature_first, axis=0), np.zeros((m, m)), np.zeros(m)]
        for t in range(longest - 1):
            pair = alpha[:, t, :, None] + moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - z[:, None, None]
            expected[1] += np.exp(np.minimum(pair, 0))[both[:, t]].sum(0)
        expected[2] += node[:, 0].sum(0)
        for k, p in enumerate(params):
            g = (truth[k] - expected[k]) / n - ridge * p
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(features, params[0], np.where(allowed, params[1], -1e4), np.where(starts, params[2], -1e4))


# -- finding ----------------------------------------------------------------------------------


def _plausible(kind: int, text: str) -> bool:
    d = _digits(text)
    if kind == 0:
        marks = re.search(r"@|[\[({]at[\])}]", text)
        return bool(marks and re.search(r"\.[A-Za-z]{2,}|[\[({]dot[\])}]", text[marks.end() :]) and marks.start() > 0)
    if kind == 1:
        return (text.count(".") == 3 and all(p.isdecimal() and p.isascii() and _small(p) for p in text.split("."))) or (text.count(":") >= 3 and re.fullmatch(r"[0-9a-fA-F:]+", text) is not None and len(d) >= 4)
    if kind == 2:
        return re.fullmatch(r"[0-9 -]+", text) is not None and 13 <= len(d) <= 19 and luhn(d)
    return re.fullmatch(r"\+?[ ().0-9-]+", text) is not None and 10 <= len(d) <= 15 and len(re.findall(r"[0-9]+", text)) >= 2


_TRIGGER = np.zeros(256, bool)
_TRIGGER[48:58] = _TRIGGER[64] = True


class Finder:
    def __init__(self, field: Field, around: int = 2, margin: float = 2.0):
        self.field, self.around, self.margin = field, around, margin

    def __call__(self, column) -> list[list[tuple[int, int, int, bool]]]:
        """(start, kind number, end, whether a pattern found it) for each text, sorted."""
        data, at = utf8(column)
        out: list = [[] for _ in range(len(at) - 1)]
        marked = np.concatenate([[0], np.cumsum(_TRIGGER[data])])
        marks = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b"[({", np.uint8)))])
        some = np.flatnonzero((np.diff(marked[at]) > 0) | (np.diff(marks[at]) > 0))
        if not len(some):
            return out
        texts = column.take(pa.array(some)).to_pylist()
        for i, text in zip(some, texts):
            out[i] = [(s, k, e, True) for s, k, e in patterns(text)]
        sequences, places = self._sequences(column.take(pa.array(some)), texts)
        for (doc, spots), tokens, (labels, e) in zip(places, sequences, self.field.decode(sequences)):
            i, text = some[doc], texts[doc]
            for a, b, kind in _runs(labels):
                start, end = spots[a][0], spots[b - 1][1]
                while start < end and text[start] in ("[{<,;:!?\"'.|" if kind == 3 else _EDGE):
                    start += 1
                while end > start and text[end - 1] in ("]}>,;:!?\"'.|" if kind == 0 else _EDGE):
                    end -= 1
                without = labels.copy()
                without[a:b] = 0
                if _plausible(kind, text[start:end]) and not any(s < end and start < f for s, _, f, _ in out[i]) and self.field.path_score(labels, e) - self.field.path_score(without, e) >= self.margin:
                    out[i].append((start, kind, end, False))
            out[i].sort()
        return out

    def _sequences(self, column, texts: list[str]):
        """Token sequences around triggers, each with its text's number and its tokens' code point spans."""
        w = Words(column, hashed=False)
        marked = np.concatenate([[0], np.cumsum(_TRIGGER[w.raw])])
        hit = marked[w.end] > marked[w.start]
        bracket = np.isin(w.raw[w.start], np.frombuffer(b"[({", np.uint8))
        for k in np.flatnonzero(bracket & (w.end - w.start <= 6)):
            hit[k] |= bytes(w.raw[w.start[k] : w.end[k]]).strip(b"[](){},.").lower() in (b"at", b"dot")
        where = np.flatnonzero(hit)
        doc = w.doc[where]
        low, high = np.maximum(where - self.around, w.first[doc]), np.minimum(where + self.around + 1, w.first[doc + 1])
        points = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
        begin, end = points[w.start], points[w.end]
        zero = points[w.at]
        joined: list[list[int]] = []
        for d, a, b in zip(doc.tolist(), low.tolist(), high.tolist()):
            if joined and joined[-1][0] == d and a <= joined[-1][2]:
                joined[-1][2] = b
            else:
                joined.append([d, a, b])
        sequences, places = [], []
        for d, a, b in joined:
            spots = [(int(x), int(y)) for x, y in zip(begin[a:b] - zero[d], end[a:b] - zero[d])]
            sequences.append([texts[d][x:y] for x, y in spots])
            places.append((d, spots))
        return sequences, places


def _runs(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, end, kind number) of each labelled span."""
    out, k = [], 0
    while k < len(labels):
        if labels[k]:
            kind, b = (labels[k] - 1) // 2, k + 1
            while b < len(labels) and labels[b] and labels[b] % 2 == 0 and (labels[b] - 1) // 2 == kind:
                b += 1
            out.append((k, b, int(kind)))
            k = b
        else:
            k += 1
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(training_table())


def find(docs: DataFrame, text_col: str = "text", field: Field | None = None, keep_text: bool = True, mask: bool = False) -> DataFrame:
    """`docs` with `spans`; with `mask`, each span in the text is replaced by its kind in angle brackets."""
    small_batches(docs.sparkSession)
    finder = Finder(field or default_field())
    docs = docs.drop("spans")
    kept = [c for c in docs.columns if keep_text or c != text_col]
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in chunks(batches, text_col):
            found = finder(batch.column(text_col))
            spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in f] for f in found], kind_type)
            arrays = [pa.array(_masked(batch.column(c).to_pylist(), found), pa.string()) if mask and c == text_col else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, spans], names=[*kept, "spans"])

    return docs.mapInArrow(run, with_field(docs.select(kept).schema, ("spans", SPANS)))


def _masked(texts: list[str | None], found: list) -> list[str | None]:
    out = []
    for text, spans in zip(texts, found):
        done, parts = 0, []
        for s, k, e, _ in spans:
            if s >= done:
                parts += [text[done:s], f"<{KINDS[k].upper()}>"]
            done = max(done, e)
        out.append("".join([*parts, text[done:]]) if spans else text)
    return out


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))

"""Personal data by patterns and a skip-chain conditional random field.

The base finds e-mail and IP addresses, cards and phone numbers by pattern. The field labels
the tokens that hold a digit, an @ or a +; all other tokens are fixed to "none", so leaving
them out of the graph changes nothing. Its potentials are
 - of a token: how often tokens of its shape carry each label,
 - of neighbours: how often labels stand side by side, against chance,
 - of skip edges: how often distant tokens that are equal but for punctuation and case share
   a label, against chance; each token is tied to the next one alike in the document.
They are logarithms of counts over the base's labels on at most `FIT_DOCS` documents (piecewise
training), the only bounded sample. Loopy sum-product messages then run over the graphs of a
whole Arrow batch at once; tokens in base spans are held to their label. Runs of tokens that
end up with a label and touch no base span are spans that the method adds.

Offsets are code points of the whole text, ends exclusive. A null text is empty. Rows are
independent of each other, so ties and repeats are no matter. Columns of the output's names
are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import text_or_empty

KINDS = ["email", "ip", "card", "phone"]
FIT_DOCS = 8_192
ROUNDS, DAMPING = 12, 0.3
SMOOTHING = 0.5
# Log-odds that hold a base span's token to its label, and the least probability to add one.
HELD = 12.0
ADDED = 0.5

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@+]\S*")
_EDGES = ".,;:!?()[]{}<>\"'|*#$%&"
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # The leftmost match with this @ starts with the run of permitted characters before it.
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            out.append((start, 0, done))
        at = text.find("@", match.end() if match else at + 1)
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match.group().split(".")):
            out.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((match.start(), 2, match.end()))
    for match in _PHONE.finditer(text):
        if 10 <= len(_digits(match.group())) <= 15:
            out.append((match.start(), 3, match.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Runs of letters and digits as a letter or digit with the digits' number, up to 20, and
    whether the digits of a card's number of them pass its check."""
    out = re.sub(r"[^\W\d_]+", "a", token[:200])
    out = re.sub(r"[0-9]+", lambda m: f"9{min(20, len(m.group()))}", out)[:40]
    digits = _digits(token)
    return out + ("+" if luhn(digits) else "-") if 14 <= len(digits) <= 19 else out


class Document:
    """The graph of one text: tokens, base labels and edges."""

    def __init__(self, text: str):
        self.base = base_spans(text)
        self.tokens: list[tuple[int, int]] = []
        end = 0
        for match in _TRIGGER.finditer(text):
            start = match.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            first, last, end = start, match.end(), match.end()
            while first < last and text[first] in _EDGES:
                first += 1
            while last > first and text[last - 1] in _EDGES:
                last -= 1
            if first < last:
                self.tokens.append((first, last))
        words = [text[a:b] for a, b in self.tokens]
        self.shapes = [shape(w) for w in words]
        self.labels = [0] * len(words)
        i = 0
        for start, kind, stop in self.base:
            while i < len(words) and self.tokens[i][1] <= start:
                i += 1
            j = i
            while j < len(words) and self.tokens[j][0] < stop:
                self.labels[j] = kind + 1
                j += 1
        self.chain = [
            (i, i + 1) for i in range(len(words) - 1) if not text[self.tokens[i][1] : self.tokens[i + 1][0]].strip(" ()")
        ]
        seen: dict[str, int] = {}
        self.skips: list[tuple[int, int]] = []
        for i, word in enumerate(words):
            alike = "".join(filter(str.isalnum, word)).lower()
            if len(alike) >= 4:
                if alike in seen and seen[alike] < i - 1:
                    self.skips.append((seen[alike], i))
                seen[alike] = i


Potentials = tuple[dict[str, list[float]], list[float], np.ndarray, np.ndarray]


def counts_of(texts: Iterable[str]) -> Counter:
    """What the potentials are estimated from: ("shape", s, label), ("chain", a, b), ("skip", a, b)."""
    out: Counter = Counter()
    for text in texts:
        doc = Document(text)
        out.update(("shape", s, str(y)) for s, y in zip(doc.shapes, doc.labels, strict=True))
        for kind, edges in (("chain", doc.chain), ("skip", doc.skips)):
            out.update((kind, str(doc.labels[i]), str(doc.labels[j])) for i, j in edges)
    return out


def potentials(counts: dict[tuple[str, str, str], int]) -> Potentials:
    n = len(KINDS) + 1
    shapes: dict[str, np.ndarray] = {}
    edges = {"chain": np.full((n, n), SMOOTHING), "skip": np.full((n, n), SMOOTHING)}
    overall = np.full(n, SMOOTHING)
    for (kind, a, b), count in counts.items():
        if kind == "shape":
            shapes.setdefault(a, np.zeros(n))[int(b)] += count
            overall[int(b)] += count
        else:
            edges[kind][int(a), int(b)] += count
    prior = overall / overall.sum()
    unary = {s: np.log((c + prior) / (c.sum() + 1)).tolist() for s, c in shapes.items()}

    def against_chance(table: np.ndarray) -> np.ndarray:
        joint = table + table.T
        joint = joint / joint.sum()
        own = joint.sum(1)
        return np.log(joint / np.outer(own, own))

    return unary, np.log(prior).tolist(), against_chance(edges["chain"]), against_chance(edges["skip"])


def beliefs(unary: np.ndarray, pairs: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Label probabilities of nodes by loopy sum-product over edges (i, j), each with a table
    of log potentials [label of i, label of j]; messages are damped."""
    n, k = unary.shape
    start, end = np.concatenate((pairs, pairs[:, ::-1])).T
    table = np.concatenate((tables, tables.transpose(0, 2, 1)))
    back = np.roll(np.arange(len(start)), len(pairs))
    messages = np.zeros((len(start), k))
    for _ in range(ROUNDS if len(pairs) else 0):
        total = unary.copy()
        np.add.at(total, end, messages)
        incoming = total[start] - messages[back]
        fresh = np.logaddexp.reduce(incoming[:, :, None] + table, axis=1)
        fresh -= fresh.max(1, keepdims=True)
        messages = DAMPING * messages + (1 - DAMPING) * fresh
    total = unary.copy()
    np.add.at(total, end, messages)
    total -= total.max(1, keepdims=True)
    out = np.exp(total)
    return out / out.sum(1, keepdims=True)


def find_spans(texts: list[str], model: Potentials) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    unary_of, unknown, chain, skip = model
    docs = [Document(t) for t in texts]
    # Graphs whose tokens are all in base spans have nothing to decide.
    open_ = [d for d in docs if 0 in d.labels]
    starts = np.cumsum([0] + [len(d.tokens) for d in open_])
    unary = np.array([unary_of.get(s, unknown) for d in open_ for s in d.shapes]).reshape(-1, len(KINDS) + 1)
    labels = np.array([y for d in open_ for y in d.labels], np.int64)
    held = np.flatnonzero(labels)
    unary[held, labels[held]] += HELD
    edges = [(a + i, a + j) for d, a in zip(open_, starts, strict=False) for i, j in d.chain]
    links = [(a + i, a + j) for d, a in zip(open_, starts, strict=False) for i, j in d.skips]
    pairs = np.array(edges + links, np.int64).reshape(-1, 2)
    tables = np.concatenate([np.broadcast_to(t, (n, *t.shape)) for t, n in ((chain, len(edges)), (skip, len(links)))])
    found = beliefs(unary, pairs, tables)
    added: dict[int, list[Span]] = {}
    for d, a in zip(open_, starts.tolist(), strict=False):
        own = found[a : a + len(d.tokens)]
        added[id(d)] = _runs(d, own[:, 1:].argmax(1) + 1, own[:, 1:].max(1) > ADDED)
    return [(d.base, sorted(d.base + added.get(id(d), []))) for d in docs]


def _runs(doc: Document, labels: np.ndarray, chosen: np.ndarray) -> list[Span]:
    joined = {j for _, j in doc.chain}
    out: list[Span] = []
    before = -1
    for i in np.flatnonzero(chosen).tolist():
        start, end = doc.tokens[i]
        if doc.labels[i] or any(s < end and start < e for s, _, e in doc.base):
            before = -1
            continue
        kind = int(labels[i]) - 1
        if out and before == i - 1 and i in joined and out[-1][1] == kind:
            out[-1] = (out[-1][0], kind, end)
        else:
            out.append((start, kind, end))
        before = i
    return out


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Potentials:
    """Potentials from at most `fit_docs` rows, those with the least hash of their id."""
    # Only ids are ordered; the bound on them allows the broadcast.
    chosen = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(text_or_empty().alias("text"))

    def count(parts):
        for part in parts:
            own = counts_of(part["text"].to_pylist())
            keys = list(own)
            columns = [[k[i] for k in keys] for i in range(3)] + [[own[k] for k in keys]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if i == 3 else pa.string()) for i, c in enumerate(columns)], ["kind", "a", "b", "n"]
            )

    counted = rows.mapInArrow(count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return potentials({(r["kind"], r["a"], r["b"]): r["n"] for r in counted.filter("kind <> 'shape' OR n >= 2").collect()})


def _finder(docs: DataFrame, model: Potentials, result: str, make):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(result)
    def find(texts: pa.Array) -> pa.Array:
        values = [t or "" for t in texts.to_pylist()]
        return make(values, find_spans(values, shared.value))

    return find


def detect(docs: DataFrame, model: Potentials, text: str = "text", output: str = "found") -> DataFrame:
    """All rows with `output`: arrays `base` and `spans` of (start, kind, end)."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])

    def make(_, found):
        listed = lambda spans: [dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans]
        return pa.StructArray.from_arrays(
            [pa.array([listed(x[i]) for x in found], pa.list_(span)) for i in (0, 1)], ["base", "spans"]
        )

    kind = "array<struct<start: int, kind: int, end: int>>"
    find = _finder(docs, model, f"base {kind}, spans {kind}", make)
    return docs.withColumn(output, find(F.col(text).cast("string")))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first one's kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Potentials, text: str = "text") -> DataFrame:
    """All rows with the personal data in `text` replaced by the names of their kinds; a null
    text stays null."""
    make = lambda texts, found: pa.array([masked(t, f[1]) for t, f in zip(texts, found, strict=True)], pa.string())
    find = _finder(docs, model, "string", make)
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), find(F.col(text).cast("string"))))

"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and telephone numbers (the base spans).  The field then
labels the tokens of a document that hold a digit or ``@`` (all other tokens are outside by definition) as outside or
one of the four kinds.  Its log potentials are a token's shape, the labels of neighbours at most ``NEAR`` code points
apart (chain), and the labels of distant tokens that repeat it or have the same digits (skip links, which tie each
token to the one before with the same key, and to a token in a base span with that key: the last before it, else the first
after it; so they are at most twice as many as the tokens).  Tokens in base spans are held at
their kind; loopy message passing carries the evidence through the document, so a number that the patterns know in
one place is found where it stands without its usual marks, however many repeats lie between.  Messages are passed until
they stand still; only the ones that still change are computed again.  As loops may swing for ever, there is a bound on
the rounds, which grows with the longest chain of links.  Spans that the field adds never overlap base spans.

The weights maximise the pseudo-likelihood of labels from the base spans, on the documents with the ``max_training``
least hashes of their ids (those of them with at most ``MOST_TOKENS`` tokens).  A token outside all base spans that repeats one
inside is neither an example nor evidence there: it is what the field is to find.  Weights of skip links start from, and are
drawn to, ``AGREEMENT`` for equal labels.  All else covers all documents.

Defined cases: a null text counts as empty (no spans); repeated rows are rows of their own; rows with a null id are
labelled and can train; without any token to train on the field adds nothing; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
NEAR = 2
MAX_TRAINING = 4000
MOST_TOKENS = 256
#: Rounds for each link of the longest chain, and for how many links at least.
ROUNDS = 20
LEAST_LINKS = 50
STILL = 1e-5
CONFIDENCE = 0.8
AGREEMENT = 3.0
KEY_DIGITS = 5

# Patterns of the base spans.  Where a pattern can only fail again from inside a run it is tried at the run's start alone.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        # The local part goes back over its characters, but not into what is matched already.
        start = at
        while start > free and not _LOCAL_END.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start, of each kind leftmost and without overlaps."""
    found = [(0, *span) for span in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += ((3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15)
    return found


# A token that holds a digit or @, tried at token starts alone.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGES = "\"'()[]{}<>,;:.!?"
_LEVELS = (0, 1, 4, 7, 10, 13, 16, 20)
FEATURES = 34


def shape(token: str) -> list[int]:
    """The numbers of the features that a token has."""
    core = token.strip(_EDGES)
    digits = sum(c.isdigit() for c in core)
    letters = any(c.isalpha() for c in core)
    dots, others = core.count("."), [c for c in core if not (c.isalnum() or c in ".-+@")]
    at = core.find("@")
    return [0, 1 + sum(digits >= n for n in _LEVELS[1:]), 9 + min(dots, 4), 14 + min(core.count("-"), 3), 18 + letters,
            20 + (at >= 0) + (at >= 0 and "." in core[at:]), 23 + core.startswith("+"), 25 + token.startswith("("), 27 + bool(others),
            29 + min(len(core) // 8, 4)]


def key(token: str) -> str | None:
    """What a token is linked by: its digits if they are many, else its text if it is an address."""
    core = token.strip(_EDGES)
    digits = _NOT_DIGIT.sub("", core)
    return core.lower() if "@" in core else digits if len(digits) >= KEY_DIGITS else None


@dataclass
class Graph:
    """Tokens of one or more documents and the links between them (first and second token, 0: chain or 1: skip)."""

    spans: list[tuple[int, int]]
    shapes: list[list[int]]
    labels: list[int]
    links: list[tuple[int, int, int]]

    @classmethod
    def of(cls, text: str, base: list[tuple[int, int, int]]) -> Graph:
        graph, last_of, held_of, early = cls([], [], [], []), {}, {}, {}
        ordered, next_base = sorted((s, e, k) for k, s, e in base), 0
        for m in _TOKEN.finditer(text):
            i, (start, end) = len(graph.spans), m.span()
            while next_base < len(ordered) and ordered[next_base][1] <= start:
                next_base += 1
            inside = next_base < len(ordered) and ordered[next_base][0] < end
            graph.labels.append(1 + ordered[next_base][2] if inside else 0)
            graph.shapes.append(shape(m[0]))
            if i and start - graph.spans[-1][1] <= NEAR:
                graph.links.append((i - 1, i, 0))
            graph.spans.append((start, end))
            if (k := key(m[0])) is not None:
                if k in last_of:
                    graph.links.append((last_of[k], i, 1))
                if inside:
                    graph.links += ((j, i, 1) for j in early.pop(k, []) if j != last_of[k])
                    held_of[k] = i
                elif k not in held_of:
                    early.setdefault(k, []).append(i)
                elif held_of[k] != last_of[k]:
                    graph.links.append((held_of[k], i, 1))
                last_of[k] = i
        return graph

    def longest_chain(self) -> int:
        """The most links in a row, in the order of the text, between tokens without a label."""
        longest = [0] * len(self.spans)
        for a, b, _ in sorted(self.links, key=lambda link: link[1]):
            if not self.labels[a] and not self.labels[b]:
                longest[b] = max(longest[b], longest[a] + 1)
        return max(longest, default=0)

    def add(self, other: Graph) -> None:
        n = len(self.spans)
        self.spans += other.spans
        self.shapes += other.shapes
        self.labels += other.labels
        self.links += ((a + n, b + n, t) for a, b, t in other.links)


@dataclass(frozen=True)
class Field:
    """Log potentials: of shapes (FEATURES, LABELS), and of linked labels (2, LABELS, LABELS)."""

    shapes: np.ndarray
    links: np.ndarray

    def marginals(self, graph: Graph) -> np.ndarray:
        """The belief in each label of each token, by loopy message passing; tokens with a label are held at it."""
        own = self.shapes[np.asarray(graph.shapes)].sum(axis=1)
        held = np.asarray(graph.labels)
        own[held > 0] = -50.0
        own[held > 0, held[held > 0]] = 50.0
        if graph.links:
            a, b, kind = np.asarray(graph.links).T
            source, target, kind = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([kind, kind])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            message, belief = np.zeros((len(source), LABELS)), own.copy()
            # Held tokens need no messages.
            wanted = held[target] == 0
            due = np.flatnonzero(wanted)
            for _ in range(ROUNDS * max(LEAST_LINKS, graph.longest_chain())):
                sent = (belief[source[due]] - message[back[due]])[:, :, None] + self.links[kind[due]]
                top = sent.max(axis=1)
                new = top + np.log(np.exp(sent - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                # Half a step each round keeps loops from swinging.
                step = (new - message[due]) / 2
                message[due] += step
                np.add.at(belief, target[due], step)
                moved = np.abs(step).max(axis=1) >= STILL
                if not moved.any():
                    break
                again, fresh = np.zeros(len(source), bool), np.zeros(len(own), bool)
                again[due[moved]] = True
                fresh[target[due[moved]]] = True
                due = np.flatnonzero(wanted & (again | fresh[source]))
            np.add.at(own, target, message)
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fitted(graph: Graph, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Weights that maximise the pseudo-likelihood of the labels: of each token, given those of its neighbours."""
    n = len(graph.labels)
    if not n:
        outside = np.zeros((FEATURES, LABELS))
        outside[0, 0] = 10.0
        return Field(outside, np.zeros((2, LABELS, LABELS)))
    x = np.zeros((n, FEATURES + 2 * LABELS))
    np.put_along_axis(x, np.asarray(graph.shapes), 1.0, axis=1)
    labels = np.asarray(graph.labels)
    a, b, kind = np.asarray(graph.links or np.empty((0, 3)), dtype=np.int64).T
    # Tokens that repeat a labelled one, directly or by others, without a label of their own.
    known, repeats = labels > 0, kind == 1
    while True:
        reached = known.copy()
        reached[a[repeats & known[b]]] = True
        reached[b[repeats & known[a]]] = True
        if (reached == known).all():
            break
        known = reached
    example = (labels > 0) | ~known
    for here, there in ((a, b), (b, a)):
        seen = example[there]
        np.add.at(x, (here[seen], FEATURES + kind[seen] * LABELS + labels[there[seen]]), 1.0)
    x, y = x[example], np.eye(LABELS)[labels[example]]
    prior = np.zeros((x.shape[1], LABELS))
    prior[FEATURES + LABELS:] = AGREEMENT * np.eye(LABELS)
    w, pace = prior.copy(), np.full(prior.shape, 1e-8)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        slope = x.T @ (p / p.sum(axis=1, keepdims=True) - y) / len(x) + decay * (w - prior)
        pace += slope ** 2
        w -= rate * slope / np.sqrt(pace)
    links = w[FEATURES:].reshape(2, LABELS, LABELS)
    return Field(w[:FEATURES], (links + links.transpose(0, 2, 1)) / 2)


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [Graph.of(t, base_spans(t)) for t in batch.column("text").to_pylist()]
        rows = [g for g in rows if 0 < len(g.spans) <= MOST_TOKENS]
        kinds = {"shapes": pa.list_(pa.list_(pa.int64())), "labels": pa.list_(pa.int64()), "links": pa.list_(pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays([pa.array([getattr(g, c) for g in rows], k) for c, k in kinds.items()], names=list(kinds))


def trained(docs: DataFrame, max_training: int = MAX_TRAINING) -> Field:
    """The field of a bounded sample: the documents with the least hashes of id and text; equal rows count once."""
    rows = docs.where("text IS NOT NULL").select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(max_training).agg(F.max("h")).first()[0]
    sample = rows.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).repartition("h").sortWithinPartitions("h").select("text")
    graph = Graph([], [], [], [])
    for row in sample.mapInArrow(_graphs, "shapes array<array<long>>, labels array<long>, links array<array<long>>").collect():
        graph.add(Graph([(0, 0)] * len(row.labels), row.shapes, row.labels, [tuple(x) for x in row.links]))
    return fitted(graph)


def _added(text: str, base: list, spans: list, belief: np.ndarray) -> list[tuple[int, int, int]]:
    """The tokens that the field takes for personal data, without the marks around them; neighbours of a kind are one span."""
    found: list[tuple[int, int, int]] = []
    taken = sorted((s, e) for _, s, e in base)
    at = 0
    for (start, end), p in zip(spans, belief):
        kind = int(p.argmax()) - 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if kind < 0 or p[kind + 1] < CONFIDENCE or at < len(taken) and taken[at][0] < end:
            continue
        token = text[start:end]
        start, end = end - len(token.lstrip(_EDGES)), start + len(token.rstrip(_EDGES))
        if found and found[-1][0] == kind and 0 <= start - found[-1][2] <= NEAR and not any(s < start and e > found[-1][2] for s, e in taken):
            found[-1] = (kind, found[-1][1], end)
        elif start < end:
            found.append((kind, start, end))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def found(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (base spans), spans (all spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base, whole, ends = [base_spans(t) for t in texts], Graph([], [], [], []), [0]
            for text, spans in zip(texts, base):
                whole.add(Graph.of(text, spans))
                ends.append(len(whole.spans))
            belief = shared.value.marginals(whole) if whole.spans else None
            all_spans = [b + _added(t, b, whole.spans[i:j], belief[i:j]) if j > i else b for t, b, i, j in zip(texts, base, ends, ends[1:])]
            counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]),
                 pa.array([written(s) for s in all_spans])],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)

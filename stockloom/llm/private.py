"""Personal data in whole texts: fixed patterns, and a skip-chain random field that adds to them.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers.  They miss what
their form excludes: numbers that run into each other, a phone number without its country code,
a second mention in another form.  A skip-chain conditional random field labels the tokens:

* a token's own potential comes from its form (digits and letters by kind, valid checksum,
  valid octets), its make-up (letters, ``@``) and the word before it;
* neighbouring tokens share a chain potential;
* tokens of one document that are equal or alike (the same last digits, the same address) share a
  skip potential through a node for their key, so a key with m mentions costs m edges, not pairs.

Tokens inside a pattern's span are observed.  Loopy message passing runs over all documents of a
batch at once; their graphs are disjoint, so neither the batch nor its neighbours change a result.

The potentials are learnt piecewise from the patterns' spans in all documents: smoothed log
counts in tables of fixed size (forms and words are hashed).  Nothing is labelled by hand.
Only tokens with a digit or ``@`` are nodes; texts without one hold no personal data here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

#: Kinds in the order of ties; label 0 of the field is "none".
KINDS = ("email", "ip", "card", "phone")
_LABELS = len(KINDS) + 1
#: Rows of the hashed tables, rounds of message passing, the least posterior of an added token.
BUCKETS, MESSAGE_ROUNDS, SURE = 1 << 14, 12, 0.9
#: Weight of the prior in smoothed counts, agreeing pairs counted beforehand, the largest potential in size.
SMOOTH, AGREE, LARGEST = 2.0, 10.0, 7.0
#: Nodes that pass messages together; a longer document is taken alone.
GRAPH = 50_000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$")
_RUNS = (re.compile(r"[a-z]+"), re.compile(r"[A-Z]+"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from each ``@`` outwards so that long words cost their length once."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", found.end() if found else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order; ends are exclusive code points."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := octet.lstrip("0")) <= 3 and int(p or "0") <= 255 for octet in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _form(core: str) -> str:
    """A token's form: runs of letters by case, digits by number, and whether number checks hold."""
    digits = _NOT_DIGIT.sub("", core)
    shape = core
    for mark, run in zip("aA", _RUNS, strict=True):
        shape = run.sub(mark, shape)
    if len(shape) > 40:
        shape = shape[:20] + "~" + shape[-20:]
    octets = core.split(".")
    if len(octets) == 4 and all(o.isascii() and o.isdigit() for o in octets):
        valid = all(len(o.lstrip("0")) <= 3 and int(o.lstrip("0") or 0) <= 255 for o in octets)
        return f"octets {valid}"
    shape = re.sub("[0-9]", "0", shape)
    if 14 <= len(digits) <= 19:
        return f"{shape} {luhn(digits)}"
    return shape


def _bucket(text: str) -> int:
    return _hash_text(text) % BUCKETS


def _hash_text(text: str) -> int:
    h = 0x811C9DC5
    for b in text.encode("utf-8", "surrogatepass")[:64]:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h ^ (h >> 15)


#: Digits of a card and of a phone number at most; addresses are single tokens.
_MOST_DIGITS = {2: 19, 3: 15}


class Graph:
    """Tokens of one text that may be personal data, with their potentials' inputs."""

    __slots__ = ("base", "chain", "digits", "form", "made", "keys", "label", "spans", "word")

    def __init__(self, text: str):
        self.base = base_spans(text)
        self.spans, self.label, self.form, self.word, self.chain, self.keys, self.digits, self.made = [], [], [], [], [], [], [], []
        names: dict[str, int] = {}
        at, before, position = 0, "", 0
        last = -2  # the place of the node before among all words
        for m in _WORD.finditer(text):
            position += 1
            word = m[0]
            if any(c in "0123456789@" for c in word):
                core = _EDGE.sub("", word) or word
                start = m.start() + word.find(core)
                end = start + len(core)
                while at < len(self.base) and self.base[at][2] <= start:
                    at += 1
                label, i = 0, at
                while i < len(self.base) and self.base[i][0] < end:
                    if self.base[i][2] > start:
                        label = label or self.base[i][1] + 1
                    i += 1
                node = len(self.spans)
                self.spans.append((start, end))
                self.label.append(label)
                self.digits.append(sum(c.isdigit() for c in core))
                self.form.append(_bucket(_form(core)))
                self.made.append(2 * any(c.isalpha() for c in core) + ("@" in core))
                self.word.append(_bucket("<" + before))
                if last == position - 1:
                    self.chain.append(node - 1)
                last = position
                key = _key(core)
                self.keys.append(names.setdefault(key, len(names)) if key else -1)
            before = word.lower()


def _key(core: str) -> str:
    """What makes two tokens alike: the whole address, the last seven digits, or nothing."""
    if "@" in core:
        return core.lower()
    digits = _NOT_DIGIT.sub("", core)
    if core.count(".") == 3 and len(digits) >= 4:
        return "." + core
    return digits[-7:] if len(digits) >= 7 else ""


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, str]]:
    """(row, text) of the texts with a digit or ``@``; the others have neither spans nor nodes."""
    array = column(batch, name)
    for i in np.flatnonzero(pc.match_substring_regex(array, "[0-9@]").to_numpy(zero_copy_only=False)):
        yield int(i), array[int(i)].as_py()


class Field:
    """Log potentials: own (forms, make-up, words), chain and skip."""

    def __init__(self, counts: dict[str, np.ndarray]):
        every = counts["form"].sum(0) + 1.0
        prior = every / every.sum()

        def lift(rows: np.ndarray) -> np.ndarray:
            """Smoothed log ratio of each row's label shares to the prior."""
            share = (rows + SMOOTH * prior) / (rows.sum(-1, keepdims=True) + SMOOTH)
            return np.clip(np.log(share / prior), -LARGEST, LARGEST)

        self.prior = np.log(prior)
        self.form, self.made, self.word = (lift(counts[k]) for k in ("form", "made", "word"))
        self.skip = lift(counts["skip"] + np.diag(AGREE * prior))
        # Neighbours only support each other's kind: two kinds that never met may still stand side by side.
        own = np.diag(lift(counts["chain"])).clip(0.0)
        self.chain = np.diag(np.where(np.arange(_LABELS) > 0, own, 0.0))


#: Rows of each table of label counts.
_SIZES = {"form": BUCKETS, "made": 4, "word": BUCKETS, "chain": _LABELS, "skip": _LABELS}


def _tally(docs: DataFrame, text: str) -> DataFrame:

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros((n, _LABELS), np.int64) for k, n in _SIZES.items()}
        for batch in batches:
            for _, whole in _texts(batch, text):
                g = Graph(whole)
                for form, made, word, label in zip(g.form, g.made, g.word, g.label, strict=True):
                    tables["form"][form, label] += 1
                    tables["made"][made, label] += 1
                    tables["word"][word, label] += 1
                for i in g.chain:
                    tables["chain"][g.label[i], g.label[i + 1]] += 1
                seen: dict[int, int] = {}
                for key, label in zip(g.keys, g.label, strict=True):
                    if key in seen and key >= 0:  # each mention with the one before it, both ways
                        tables["skip"][seen[key], label] += 1
                        tables["skip"][label, seen[key]] += 1
                    seen[key] = label
        for name, t in tables.items():
            at = np.flatnonzero(t.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(t.ravel()[at])], ["name", "at", "n"])

    return docs.select(text).mapInArrow(count, "name string, at long, n long").groupBy("name", "at").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> Field:
    """The field learnt from the patterns' spans in all of ``docs``; an empty table leaves only the prior."""
    counts = {k: np.zeros((n, _LABELS)) for k, n in _SIZES.items()}
    for r in _tally(docs, text).collect():  # at most 10 * BUCKETS + 70 rows, whatever the input
        counts[r["name"]].ravel()[r["at"]] = r["n"]
    return Field(counts)


def _normal(logs: np.ndarray) -> np.ndarray:
    """Log shares of each row, scaled to sum to one."""
    top = logs.max(1, keepdims=True)
    return logs - top - np.log(np.exp(logs - top).sum(1, keepdims=True))


def _through(logs: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Messages over edges: log sum over the sender's labels of exp(belief + potential[sender, receiver])."""
    x = logs[:, :, None] + potential[None]
    top = x.max(1)
    return _normal(top + np.log(np.exp(x - top[:, None]).sum(1)))


def posteriors(field: Field, graphs: list[Graph], rounds: int = MESSAGE_ROUNDS) -> np.ndarray:
    """Label shares of all nodes of ``graphs``, one after the other, by loopy sum-product messages."""
    sizes = np.array([len(g.spans) for g in graphs])
    first = np.concatenate(([0], np.cumsum(sizes)))
    n = int(first[-1])
    own = (field.prior + field.form[[x for g in graphs for x in g.form]] + 0.5 * field.made[[x for g in graphs for x in g.made]]
           + 0.5 * field.word[[x for g in graphs for x in g.word]])
    label = np.array([x for g in graphs for x in g.label], np.int64)
    observed = np.full((n, _LABELS), -1e3)
    observed[np.arange(n), label] = 0.0
    own = _normal(np.where((label > 0)[:, None], observed, own))
    chain = np.array([first[k] + i for k, g in enumerate(graphs) for i in g.chain], np.int64)
    # Each key with two mentions or more is a node of its own, after the tokens.
    keys = np.array([(k << 32) | x if x >= 0 else -1 for k, g in enumerate(graphs) for x in g.keys], np.int64)
    names, hub, often = np.unique(keys, return_inverse=True, return_counts=True)
    members = np.flatnonzero((keys >= 0) & (often[hub] > 1))
    hubs = n + hub[members]
    total = n + len(names)
    base = np.concatenate((own, np.full((len(names), _LABELS), -np.log(_LABELS))))
    # Edges in both directions: the reverse of edge e is e +- half.
    send = np.concatenate((chain, members, chain + 1, hubs))
    take = np.concatenate((chain + 1, hubs, chain, members))
    half = len(chain) + len(members)
    kinds = np.concatenate((np.zeros(len(chain), bool), np.ones(len(members), bool)))
    back = np.concatenate((np.arange(half) + half, np.arange(half)))
    message = np.full((2 * half, _LABELS), -np.log(_LABELS))

    def belief() -> np.ndarray:
        return base + np.stack([np.bincount(take, message[:, c], minlength=total) for c in range(_LABELS)], 1)

    for _ in range(rounds if half else 0):
        out = _normal(belief()[send] - message[back])
        new = np.empty_like(message)
        forth, skip = np.flatnonzero(~kinds), np.flatnonzero(kinds)
        new[forth] = _through(out[forth], field.chain)
        new[forth + half] = _through(out[forth + half], field.chain.T)
        new[skip] = _through(out[skip], field.skip)
        new[skip + half] = _through(out[skip + half], field.skip.T)
        message = np.log(0.5 * np.exp(message) + 0.5 * np.exp(new))  # damped, so that loops settle
    return np.exp(_normal(belief()[:n]))


def _added(g: Graph, share: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of unobserved tokens with one sure label; neighbours join while their digits fit one number."""
    best = share.argmax(1)
    linked = {i + 1 for i in g.chain}
    out: list[tuple[int, int, int]] = []
    digits = 0  # of the span that may still grow
    for i, (start, end) in enumerate(g.spans):
        kind = int(best[i]) - 1
        if g.label[i] or kind < 0 or share[i, best[i]] < SURE:
            digits = 0
        elif digits and i in linked and out[-1][1] == kind and digits + g.digits[i] <= _MOST_DIGITS.get(kind, 0):
            out[-1] = (out[-1][0], kind, end)
            digits += g.digits[i]
        else:
            out.append((start, kind, end))
            digits = g.digits[i]
    return out


def find(docs: DataFrame, field: Field, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (start, end, kind) in code points, in order.

    Null is read as the empty text, which holds nothing.  Every row is found on its own, whole,
    so repeated rows agree.  An empty table gives no rows.  Columns named base or added are replaced.
    """
    docs = docs.drop("base", "added")
    kept = [c for c in docs.columns if keep_text or c != text]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def rows(spans: list) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in s] for s in spans], span)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list] = [[] for _ in range(batch.num_rows)]
            added: list[list] = [[] for _ in range(batch.num_rows)]
            waiting: list[tuple[int, Graph]] = []
            nodes = 0

            def settle() -> None:
                nonlocal nodes
                if waiting:
                    share, at = posteriors(field, [g for _, g in waiting]), 0
                    for i, g in waiting:
                        added[i] = _added(g, share[at : at + len(g.spans)])
                        at += len(g.spans)
                waiting.clear()
                nodes = 0

            for i, whole in _texts(batch, text):
                g = Graph(whole)
                base[i] = g.base
                if g.spans:
                    waiting.append((i, g))
                    nodes += len(g.spans)
                if nodes >= GRAPH:
                    settle()
            settle()
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), rows(base), rows(added)], [*kept, "base", "added"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    spans = "array<struct<start:long,end:long,kind:string>>"
    return docs.mapInArrow(label, f"{kinds + ', ' if kinds else ''}base {spans}, added {spans}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    rank = F.array(*map(F.lit, KINDS))
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"),
                                                  s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Personal data: base patterns, and further spans that boosted trees select.

Base spans are those of fixed patterns with their checks and always stay. Generators of high
recall propose overlapping further spans: runs of digit groups in every plausible cut, mail
addresses that are spelled out or lack a domain's dot. Boosted trees judge each by its format and
context; they learn from a bounded sample of documents in which base spans, also rewritten into
looser formats, are positive and all other proposals negative. A threshold per kind, calibrated
on all documents that were not trained on, lets at most MOST_FALSE of the negatives pass;
of passing proposals that overlap, the likeliest stays, and none overlaps a base span.

Null texts are empty. Offsets are code points, ends exclusive. Rows with repeated or null ids
are reported each. Without base spans in the sample nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import boosting

#: Distinct texts that may be collected to learn from.
SAMPLE = 4_000
#: Logits of negatives are counted in bins of 1 / BINS between -LIMIT and LIMIT.
BINS, LIMIT = 64, 40
#: Share of calibration negatives that may pass, and the fewest negatives a threshold needs.
MOST_FALSE, LEAST_NEGATIVES = 0.002, 50
#: Logit asked of kinds with fewer negatives.
STRICT = 4.0
CONTEXT = 40

#: The kinds and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the mail pattern, found from each at-sign (no search from every character)."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns that pass their checks, by start and kind."""
    out: list[Span] = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        digits = m.end() - m.start()
        if digits >= 12:
            own = _digits(m[0])
            if 12 <= len(own) <= 19 and luhn(own):
                out.append((m.start(), 2, m.end()))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# -- proposals --------------------------------------------------------------------------------

_CHAIN = re.compile(r"[0-9][0-9 ()./-]{5,}[0-9]")
_GROUP = re.compile(r"[0-9]+")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}"
    r"(?:(?: ?[\[({](?:dot|DOT)[\])}] ?|\.)[A-Za-z0-9-]{1,63}){1,6}"
)
_DOTLESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?@ ?[A-Za-z0-9-]{2,63}(?:\.[A-Za-z]{2,24})*")


def proposals(text: str) -> list[Span]:
    """Overlapping spans that could be personal data, base spans included where found alike."""
    out: set[Span] = set()
    for chain in _CHAIN.finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, chain.start(), chain.end())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, min(i + 8, len(groups))):
                digits += groups[j][1] - groups[j][0]
                end = groups[j][1]
                if digits > 19 or end - start > 48:
                    break
                if j - i == 3 and "." in text[start:end]:
                    out.add((start, 1, end))
                if 12 <= digits:
                    out.add((start, 2, end))
                if 7 <= digits <= 15:
                    lead = start - 1 if start and text[start - 1] in "(+" else start
                    out.add((lead, 3, end))
    if "@" in text:
        out |= {(m.start(), 0, m.end()) for m in _DOTLESS.finditer(text)}
    if "at" in text or "AT" in text:
        out |= {(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)}
    return sorted(out)


_HINTS = [
    re.compile(p, re.I)
    for p in (
        r"mail|contact|write|address",
        r"phone|tel|call|fax|mobile|whatsapp",
        r"card|visa|iban|account|payment|credit",
        r"\bip\b|server|host|login|network",
        r"version|\bv\.?$|release|isbn|issn|doi|page|chapter|figure",
        r"[=/#:$€£%]\s*$",
    )
]


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?)" else 5


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span; not whether a base pattern matched it."""
    start, kind, end = span
    own, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = _GROUP.findall(own)
    sizes = [len(g) for g in groups] or [0]
    digits = sum(sizes)
    around = before + after
    return [
        *(float(kind == k) for k in range(4)),
        len(own),
        digits,
        len(groups),
        max(sizes),
        min(sizes),
        float(len(set(sizes)) == 1),
        sum(c.isalpha() for c in own),
        own.count("."),
        own.count("-"),
        own.count(" "),
        own.count("/"),
        float("(" in own),
        float(own.startswith("+") or before.endswith("+")),
        float("@" in own),
        float(bool(groups) and luhn("".join(groups))),
        float(len(groups) == 4 and all(map(_small, groups))),
        float(own.startswith("0")),
        _class(before[-1:]),
        _class(after[:1]),
        sum("0" <= c <= "9" for c in around),
        sum(c.isalpha() for c in around),
        *(float(bool(p.search(before[-24:]))) for p in _HINTS),
    ]


def looser(text: str, span: Span) -> list[tuple[str, Span]]:
    """Rewritings of a base span, in its context, into formats that the base patterns miss."""
    start, kind, end = span
    own, head, tail = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    if kind == 0:
        name, _, domain = own.rpartition("@")
        forms = [f"{name} [at] {domain.replace('.', ' [dot] ')}", f"{name}(at){domain}"]
    elif kind == 2:
        d = _digits(own)
        forms = [".".join(d[i : i + 4] for i in range(0, len(d), 4))]
    elif kind == 3:
        forms = [own.lstrip("+"), re.sub(r"[ ()]+", ".", own).strip(".")]
    else:
        forms = [own.replace(".", " . ")]
    return [(head + f + tail, (len(head), kind, len(head) + len(f))) for f in forms]


@dataclass
class Model:
    trees: boosting.Trees | None
    thresholds: np.ndarray


def negatives(text: str, base: list[Span]) -> list[Span]:
    """Proposals that neither are base spans nor overlap one."""
    known = set(base)
    return [p for p in proposals(text) if p not in known and not any(s < p[2] and p[0] < e for s, _, e in base)]


def learn(texts: list[str], seed: int = 3, folds: list[int] | None = None) -> Model:
    """Trees and thresholds from a sample of texts; fold 0 is not trained on."""
    folds = [n % 4 for n in range(len(texts))] if folds is None else folds
    x, y, fold, kinds, natural = [], [], [], [], []
    for n, text in enumerate(texts):
        base = base_spans(text)
        for span in base:
            for own, at in [(text, span), *looser(text, span)]:
                x.append(features(own, at))
                y.append(1.0)
                fold.append(folds[n])
                kinds.append(span[1])
                natural.append(own is text)
        for span in negatives(text, base):
            x.append(features(text, span))
            y.append(0.0)
            fold.append(folds[n])
            kinds.append(span[1])
            natural.append(True)
    thresholds = np.full(len(KINDS), STRICT)
    if not any(y):
        return Model(None, thresholds)
    x, y, fold, kinds = np.array(x, float), np.array(y), np.array(fold), np.array(kinds)
    rng = np.random.default_rng(seed)
    on = rng.permutation(np.flatnonzero(fold != 0))
    if not y[on].any() or y[on].all():
        return Model(None, thresholds)
    balance = np.where(y[on] > 0, 0.5 / y[on].sum(), 0.5 / (1 - y[on]).sum()) * len(on)
    trees = boosting.fit(x[on], y[on], balance)
    raw = trees.logits(x)
    for k in range(len(KINDS)):
        wrong = np.sort(raw[(fold == 0) & (kinds == k) & (y == 0)])
        if len(wrong) >= LEAST_NEGATIVES:
            allowed = int(MOST_FALSE * len(wrong))
            thresholds[k] = max(float(wrong[len(wrong) - 1 - allowed]) + 1e-9, 0.0)
    return Model(trees, thresholds)


def selected(text: str, base: list[Span], model: Model) -> list[Span]:
    """Proposals that pass, without overlaps among them or with base spans."""
    if model.trees is None:
        return []
    held = _Held()
    for start, _, end in base:
        held.add(start, end)
    open_spans = [p for p in proposals(text) if held.free(p[0], p[2])]
    if not open_spans:
        return []
    raw = model.trees.logits(np.array([features(text, p) for p in open_spans], float))
    passing = sorted((-r, p) for r, p in zip(raw.tolist(), open_spans) if r >= model.thresholds[p[1]])
    kept: list[Span] = []
    for _, p in passing:
        if held.free(p[0], p[2]):
            kept.append(p)
            held.add(p[0], p[2])
    return kept


class _Held:
    """Places of a text that are taken, as disjoint intervals in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


def counted(docs: DataFrame, model: Model) -> DataFrame:
    """kind, bin, n of the negatives' logits in all rows of ``docs`` (text), summed by task before
    the shuffle; at most one row per kind and bin."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = 2 * LIMIT * BINS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(KINDS), size), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if spans := negatives(text, base_spans(text)):
                    raw = shared.value.trees.logits(np.array([features(text, p) for p in spans], float))
                    bins = np.clip(np.floor((raw + LIMIT) * BINS), 0, size - 1).astype(np.int64)
                    np.add.at(sums, ([k for _, k, _ in spans], bins), 1)
        kinds, bins = np.nonzero(sums)
        columns = [pa.array(kinds, pa.int32()), pa.array(bins, pa.int32()), pa.array(sums[kinds, bins], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "bin", "n"])

    return docs.select("text").mapInArrow(count, "kind int, bin int, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n"))


def calibrate(model: Model, counts: DataFrame) -> None:
    """Set the thresholds of kinds with enough negatives to the least upper edges of bins, 0 at
    least, that at most MOST_FALSE of them reach."""
    both = np.zeros((len(KINDS), 2 * LIMIT * BINS + 2), np.int64)
    for r in counts.collect():
        both[r["kind"], r["bin"]] = r["n"]
    for k, own in enumerate(both):
        if own.sum() >= LEAST_NEGATIVES:
            reach = own[::-1].cumsum()[::-1]
            edge = int(np.argmax(reach <= MOST_FALSE * own.sum()))
            model.thresholds[k] = max(edge / BINS - LIMIT, 0.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` distinct texts with digits or at-signs, chosen by hash, and
    thresholds from all rows whose texts were not trained on."""
    text = F.col("text").cast("string")
    able = docs.select(text.alias("text")).where(text.rlike("[0-9@]"))
    n, scale = able.select(F.xxhash64("text").alias("hash")).distinct().count(), 1 << 20
    dealt = F.pmod(F.xxhash64("text"), F.lit(scale))
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(4))
    bound = int(scale * min(1.0, sample / max(1, n)))
    chosen = able.where(dealt < bound).distinct().select("text", fold.cast("int").alias("fold")).toArrow().sort_by("text")
    model = learn(chosen.column("text").to_pylist(), folds=chosen.column("fold").to_pylist())
    if model.trees is not None:
        model.thresholds[:] = STRICT
        calibrate(model, counted(able.where((dealt >= bound) | (fold == 0)), model))
    return model


def find(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base and all spans as arrays of (start, kind, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, every = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                first.append(base)
                every.append(sorted([*base, *selected(text, base, shared.value)]))
            columns = [pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in row] for row in c], pa.list_(kind)) for c in (first, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    spans = "array<struct<start:int,kind:string,end:int>>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        read, f"doc_id bigint, base {spans}, spans {spans}"
    )


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping ones the first."""
    if text is None:
        return None
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
            at = end
    return "".join(out) + text[at:]

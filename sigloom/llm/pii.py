"""Personal data: rules, and a character-level BiLSTM-CRF that adds what the rules miss.

The rules are those of KINDS, each applied leftmost and non-overlapping; a match that fails its check is dropped without
a retry, so the rules lose, for one, two card numbers in a row. The tagger is trained from spans that the rules label in
a sample; windows are also rebuilt from them with entities side by side, and with entities written as no rule has them
(other separators, spelt-out or bracketed signs). Its spans are kept where the path's mean posterior over the span is
LEAST or more, the content is of the kind (Luhn, four numbers up to 255, as many digits as a phone number has, a name, an
at and a dot) and no span of the rules is touched. The layout is the tagger's to judge.

Every kind holds a digit, an @ or a bracketed at, so windows are laid over every stretch of text around such places; a
stretch without them has no span of any kind. Windows overlap by half; their scores are summed with weights that fall
towards a window's edges, and each stretch gets one best path over all its windows (global reconciliation). All steps
are linear in the text's length.

Training reads at most SAMPLE documents (smallest hashes of doc_id) and PER_DOCUMENT windows of each.

Null or empty text: no spans. Null doc_id: scored like any other row. Repeated rows keep their own rows. A sample
without a span trains no tagger: the rules stand alone. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .tagger import Tagger, classes_of

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the rules.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: IP's matches without trying it at every digit of a run.
WHOLE_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
PATTERNS = {"email": EMAIL, "ip": WHOLE_IP, "card": CARD, "phone": PHONE}
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

SAMPLE, PER_DOCUMENT = 12_000, 4
WINDOW, STRIDE, REACH, STEPS = 64, 32, 24, 260
LEAST = 0.9
PLACES = 1 << 40  # of a hash, for a sample's threshold
TRIGGER = re.compile(r"[0-9@]|[\[({] ?[Aa][Tt] ?[\])}]")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """EMAIL's matches without trying it at every letter: a match starts where its run of local letters does."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (m := EMAIL.match(text, lo)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def rules(text: str) -> list[Span]:
    """Spans by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if TRIGGER.search(text):
        for k in (1, 2, 3):
            if k == 1 and "." not in text or k == 3 and "+" not in text:
                continue
            out += [(k, m.start(), m.end()) for m in PATTERNS[KINDS[k]].finditer(text) if passes(KINDS[k], m.group())]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Around every digit and @, as far as REACH; what overlaps is one stretch."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def labels(spans: list[Span], lo: int, n: int) -> np.ndarray:
    """0 outside, 1 + 2 * kind at a span's first character, 2 + 2 * kind in the rest of it."""
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        if lo <= a and b <= lo + n:
            y[a - lo : b - lo] = 2 + 2 * kind
            y[a - lo] = 1 + 2 * kind
    return y


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled windows of a sample: text, tags as digits."""
    for batch in batches:
        texts, tags = [], []
        for text in batch.column("text").to_pylist():
            found = rules(text) if text else []
            for lo, hi in stretches(text)[:PER_DOCUMENT] if text else ():
                lo = max(0, (lo + hi - WINDOW) // 2)
                part = text[lo : lo + WINDOW]
                texts.append(part)
                tags.append("".join(map(str, labels(found, lo, len(part)))))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(tags, pa.string())], names=["text", "tags"])


AT = re.compile(r"@|\b[Aa][Tt]\b")
DOT = re.compile(r"\.|\b[Dd][Oo][Tt]\b")


def plausible(kind: str, s: str) -> bool:
    """Whether a tagged span's content is of the kind, however it is written."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "ip":
        numbers = re.findall("[0-9]+", s)
        return len(numbers) == 4 and passes("ip", ".".join(numbers))
    at = AT.search(s)
    return bool(at and at.start() and DOT.search(s, at.end()) and re.search(r"[A-Za-z]", s[: at.start()]))


def tightened(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """The span without what can't be at its ends."""
    first = "+(" if KINDS[kind] == "phone" else ""
    fits = (lambda c: c in LOCAL) if kind == 0 else (lambda c: "0" <= c <= "9")
    while a < b and not (fits(text[a]) or text[a] in first):
        a += 1
    while a < b and not (fits(text[b - 1]) and text[b - 1] not in "._%+-"):
        b -= 1
    return a, b


def varied(kind: int, s: str, rng: np.random.Generator) -> str:
    """An entity as no rule has it; some entities stay as they are."""
    pick = lambda *x: x[rng.integers(len(x))]
    if KINDS[kind] == "email":
        at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."), ("(at)", "."))
        name, _, host = s.partition("@")
        return name + at + host.replace(".", dot)
    if KINDS[kind] == "ip":
        return s.replace(".", pick("[.]", " . ", "(.)", "[dot]", ". "))
    digits = "".join(c for c in s if "0" <= c <= "9")
    gap = pick(".", "/", "_", "  ", " - ") if KINDS[kind] == "card" else pick("/", " / ", "  ", "_")
    if KINDS[kind] == "card":
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    cut = len(digits) - 7
    lead = pick("+", "00", "(+", "+ ")
    return f"{lead}{digits[: max(1, cut - 3)]}{')' if lead == '(+' else ''}{gap}{digits[max(1, cut - 3) : cut]}{gap}{digits[cut : cut + 3]}{gap}{digits[cut + 3 :]}"


def rebuilt(rows: list[tuple[str, str]], n: int, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Windows with entities of the sample, as they are or varied, set side by side in pieces of its plain text; and, not
    labelled, numbers of a card's length that fail its check."""
    rng = np.random.default_rng(seed)
    entities: list[list[str]] = [[] for _ in KINDS]
    plain: list[str] = []
    for text, tags in rows:
        for m in re.finditer(r"[1357][2468]*", tags):
            entities[(int(m.group()[0]) - 1) // 2].append(text[m.start() : m.end()])
        plain += [text[m.start() : m.end()] for m in re.finditer(r"0+", tags) if not TRIGGER.search(text[m.start() : m.end()])]
    kinds = [k for k, e in enumerate(entities) if e]
    out = []
    for _ in range(n if kinds and plain else 0):
        text, tags = "", []
        for part in range(rng.integers(2, 5)):
            if part:
                gap = (" ", " ", ", ", "\n", " | ")[rng.integers(5)]
                text, tags = text + gap, tags + [0] * len(gap)
            if part and rng.random() < 0.75:
                k = kinds[rng.integers(len(kinds))]
                s = entities[k][rng.integers(len(entities[k]))]
                s = varied(k, s, rng) if rng.random() < 0.5 else s
                tags += [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1)
            elif part and rng.random() < 0.4:
                s = ("".join(map(str, rng.integers(0, 10, rng.integers(4, 12)))), f"{rng.integers(1, 13)}.{rng.integers(0, 10)}.", f"v{rng.integers(1, 30)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}", f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}")[rng.integers(4)]
                tags += [0] * len(s)
            else:
                s = plain[rng.integers(len(plain))][-rng.integers(4, 30) :].rstrip()
                tags += [0] * len(s)
            text += s
        lo = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        tags = tags[lo : lo + WINDOW]
        if not (tags and tags[0] and tags[0] % 2 == 0) and not (lo + WINDOW < len(text) and tags[-1]):  # no cut entity
            out.append((text[lo : lo + WINDOW], tags))
    return out


def sampled(documents: DataFrame, sample: int) -> DataFrame:
    """Texts with a digit or an @, of some `sample` rows. Rows are drawn by id and text, and repeated ones count once, so
    neither null ids nor repeats make the sample larger."""
    n = documents.count()
    drawn = documents.select("text", F.xxhash64("doc_id", "text").alias("h"))
    place = F.pmod("h", F.lit(PLACES)) / float(PLACES)
    return drawn.where((place < min(1.0, sample / max(1, n))) & F.col("text").rlike("[0-9@]")).dropDuplicates(["h"]).select("text")


def train(documents: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    B.small_batches(documents.sparkSession)
    some = sampled(documents, sample)
    rows = sorted(tuple(r) for r in some.mapInArrow(examples, "text string, tags string").collect())  # SAMPLE x PER_DOCUMENT windows at most
    if not any(set(tags) - {"0"} for _, tags in rows):
        return None
    ready = [(t, [int(c) for c in g]) for t, g in rows] + rebuilt(rows, max(2000, 2 * min(len(rows), 3000)))
    x, y = np.zeros((len(ready), WINDOW), np.int16), np.zeros((len(ready), WINDOW), np.int64)
    for i, (t, g) in enumerate(ready):
        x[i, : len(t)], y[i, : len(g)] = classes_of(t), g
    model = Tagger(1 + 2 * len(KINDS))
    model.fit(x, y, STEPS)
    return model


def added(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans on the best path of each text that are certain enough, as tagged."""
    work = [(i, lo, hi) for i, t in enumerate(texts) for lo, hi in stretches(t)]
    out: list[list[Span]] = [[] for _ in texts]
    weight = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)[:, None]
    for start in range(0, len(work), 256):
        part = work[start : start + 256]
        places = [(k, at) for k, (_, lo, hi) in enumerate(part) for at in range(lo, max(lo + 1, hi - STRIDE), STRIDE)]
        sums = [np.zeros((hi - lo, model.tags), np.float32) for _, lo, hi in part]
        mass = [np.zeros((hi - lo, 1), np.float32) for _, lo, hi in part]
        for s in range(0, len(places), 512):
            some = places[s : s + 512]
            x = np.zeros((len(some), WINDOW), np.int16)
            for r, (k, at) in enumerate(some):
                c = classes_of(texts[part[k][0]][at : at + WINDOW])
                x[r, : len(c)] = c
            scores, _ = model.forward(x)
            for r, (k, at) in enumerate(some):
                lo = at - part[k][1]
                m = min(WINDOW, len(sums[k]) - lo)
                sums[k][lo : lo + m] += (scores[r] * weight)[:m]
                mass[k][lo : lo + m] += weight[:m]
        by_length: dict[int, list[int]] = {}
        for k, z in enumerate(sums):
            by_length.setdefault(len(z), []).append(k)
        for same in by_length.values():
            # long stretches a few at a time: posteriors take a number a character and tag
            step = max(1, 65_536 // len(sums[same[0]]))
            for few in (same[s : s + step] for s in range(0, len(same), step)):
                scores = np.stack([sums[k] / mass[k] for k in few])
                for k, path, sure in zip(few, *model.certain(scores), strict=True):
                    i, lo, _ = part[k]
                    tags = "".join(map(str, path))
                    out[i] += [((int(m.group()[0]) - 1) // 2, lo + m.start(), lo + m.end()) for m in re.finditer(r"12*|34*|56*|78*", tags) if sure[m.start() : m.end()].mean() >= LEAST]
    return out


def merged(text: str, base: list[Span], more: list[Span]) -> list[Span]:
    """The rules' spans, and tagged spans whose content is of the kind and that touch none of the others."""
    out, ends, top = list(base), [], -1
    for a, b in sorted((a, b) for _, a, b in base):  # of spans that overlap, one stretch: starts and ends both ascend
        if a < top:
            top = ends[-1][1] = max(top, b)
        else:
            ends.append([a, b])
            top = b
    for kind, a, b in more:
        a, b = tightened(kind, text, a, b)
        k = bisect_left(ends, [a, a])
        free = (k == 0 or ends[k - 1][1] <= a) and (k == len(ends) or ends[k][0] >= b)
        if a < b and free and plausible(KINDS[kind], text[a:b]):
            out.append((kind, a, b))
            insort(ends, [a, b])
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def all_spans(model: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(rules' spans, all spans) of each text."""
    base = [rules(t) for t in texts]
    some = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
    more = dict(zip(some, added(model, [texts[i] for i in some]), strict=True)) if model and some else {}
    return [(b, merged(t, b, more.get(i, []))) for i, (t, b) in enumerate(zip(texts, base, strict=True))]


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    B.serving("pii")
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def find(documents: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, the rules' counts by kind, base_sha256 and all spans, one row per row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # some 10 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found = all_spans(sent.value, [t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            shas = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, shas, pa.array([written(s) for _, s in found])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets; spans that overlap are replaced as one, under the first's kind."""
    out, at = [], 0
    end, kind = -1, 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(f"[{KINDS[kind].upper()}]")
            at = end
        out.append(text[at:a])
        kind, end = k, b
    if end >= 0:
        out.append(f"[{KINDS[kind].upper()}]")
        at = end
    return "".join(out) + text[at:]


def mask(documents: DataFrame, model: Tagger | None) -> DataFrame:
    """The same columns; text without its spans, n_chars of it where that column is there."""
    sent, names = documents.sparkSession.sparkContext.broadcast(model), documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            raw = batch.column("text").to_pylist()
            texts = [t or "" for t in raw]
            clean = [redacted(t, spans) if spans else t for t, (_, spans) in zip(texts, all_spans(sent.value, texts), strict=True)]
            new = {"text": pa.array([None if r is None else c for r, c in zip(raw, clean, strict=True)], pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([n if r is None or r == c else len(c) for r, c, n in zip(raw, clean, batch.column("n_chars").to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return documents.mapInArrow(run, documents.schema)

"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary, from the pieces of labelled training texts. A word's
probability is the sum over all ways to cut it into pieces, by a forward pass over its characters; a text's is the
product over its words. The prediction is the language with the highest posterior under equal priors.

Words are runs of ASCII letters (lower-cased) and non-ASCII characters, whole however long they are: the sums are scaled
as they go. Words of up to SHORT characters are summed side by side, a longer one (a text without spaces) by itself, in
time and memory linear in its length. A character that no piece covers costs the same in all languages. Each distinct
short word is summed once per worker and then looked up.

Training uses at most PER_LANGUAGE labelled texts a language, those with the smallest hash of doc_id.

Null text, or a text without a letter: `und` with score 0. Null lang: not learned from. Null doc_id: predicted, never
learned from, and not held out. No labelled rows: every prediction is `und`. Repeated rows keep their own rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

PER_LANGUAGE = 3000
SHORT, STRETCH = 40, 4096  # characters of words that are remembered; of a longer word worked on at once
PLACES = 1 << 40  # of a hash, for a sample's threshold
ADDED, UNKNOWN = 0.1, 1e-7
KEPT_VALUES = 1_600_000  # log probabilities that a worker remembers
MARK = "\u2581"  # stands before a word in the vocabulary
GAP = np.ones(256, bool)
GAP[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")

def vocabulary(path: str):
    """The sentencepiece processor, and piece -> number for pieces that can occur inside a word."""

    def load() -> tuple:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return sp, {sp.id_to_piece(i): i for i in plain}

    return B.remembered("language", "vocabulary", path, load)


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def is_training() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))


def piece_counts(labelled: DataFrame, path: str) -> DataFrame:
    """(lang, text) -> (lang, piece, n): pieces of the vocabulary's own segmentation of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = vocabulary(path)
        for block in B.blocks(batches, owner="language"):
            seen: dict[str, Counter] = {}
            for lang, text in zip(block.batch.column("lang").to_pylist(), block.texts(), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            for lang, counted in seen.items():
                total = np.zeros(sp.get_piece_size(), np.int64)
                for word, n in counted.items():
                    np.add.at(total, sp.encode(word.decode("utf-8", "replace")), n)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(total[some])], names=["lang", "piece", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """names: languages; table[piece] has each language's probability, the last row is for characters without a piece."""

    def __init__(self, path: str, rows: list[tuple[str, int, int]]):
        self.path = path
        sp, _ = vocabulary(path)
        self.names = sorted({r[0] for r in rows})
        n = np.full((sp.get_piece_size() + 1, len(self.names)), ADDED)
        column = {x: k for k, x in enumerate(self.names)}
        for lang, piece, count in rows:
            n[piece, column[lang]] += count
        self.table = n / n.sum(0) if rows else n
        self.table[-1] = UNKNOWN
        self.key = hash((path, tuple(self.names), self.table.tobytes()))


class Scorer:
    """Sums over segmentations; remembers words."""

    def __init__(self, model: Model):
        self.table, (_, self.pieces) = model.table, vocabulary(model.path)
        self.longest = max(map(len, self.pieces), default=1)
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((0, model.table.shape[1]))
        self.most = max(50_000, KEPT_VALUES // max(1, model.table.shape[1]))

    def forward(self, words: list[str]) -> np.ndarray:
        """log sum over segmentations, of words of one length (the mark in front counts)."""
        n, length, none = len(words), len(words[0]), len(self.table) - 1
        alpha = np.zeros((n, length + 1, self.table.shape[1]))
        alpha[:, 0] = 1.0
        scale = np.zeros((n, alpha.shape[2]))  # a language's own: one that falls far behind another is not lost
        get = self.pieces.get
        for end in range(1, length + 1):
            for size in range(1, min(self.longest, end) + 1):
                ids = np.fromiter((get(s[end - size : end], -1) for s in words), np.int64, n)
                if size == 1:
                    ids[ids < 0] = none
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    alpha[at, end] += alpha[at, end - size] * self.table[ids[at]]
            if end % 16 == 0:  # keeps numbers in range
                top = alpha[:, max(0, end - self.longest) : end + 1].max(1)
                alpha[:, max(0, end - self.longest) : end + 1] /= top[:, None, :]
                scale += np.log(top)
        return np.log(alpha[:, length]) + scale

    def forward_long(self, word: str) -> np.ndarray:
        """The same of one word: the last sums alone are kept, the pieces that end at each place of a stretch are found first."""
        most, none, get = self.longest, len(self.table) - 1, self.pieces.get
        alpha = np.zeros((most, self.table.shape[1]))  # [k]: of what ends k characters before this place
        alpha[0], scale = 1.0, np.zeros(alpha.shape[1])
        for lo in range(0, len(word), STRETCH):
            n = min(STRETCH, len(word) - lo)
            p = np.zeros((n, most, self.table.shape[1]))
            for size in range(1, most + 1):
                ends = range(max(lo + 1, size), lo + n + 1)
                ids = np.fromiter((get(word[e - size : e], -1) for e in ends), np.int64, len(ends))
                if size == 1:
                    ids[ids < 0] = none
                at = np.flatnonzero(ids >= 0)
                p[at + (n - len(ends)), size - 1] = self.table[ids[at]]
            for k in range(n):
                now = (alpha * p[k]).sum(0)
                alpha[1:] = alpha[:-1].copy()
                alpha[0] = now
                if k % 16 == 15:
                    top = alpha.max(0)
                    alpha /= top
                    scale += np.log(top)
        return np.log(alpha[0]) + scale

    def learn(self, new: set[bytes]) -> None:
        if len(self.known) + len(new) > self.most:
            self.known, self.values = {}, self.values[:0]
        new_words = [w for w in new if w not in self.known]
        if not new_words:
            return
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, w in enumerate(new_words):
            s = MARK + w.decode("utf-8", "replace")
            by_length.setdefault(len(s), []).append((i, s))
        out = np.zeros((len(new_words), self.values.shape[1]))
        for parts in by_length.values():
            for lo in range(0, len(parts), 8192):
                some = parts[lo : lo + 8192]
                out[[i for i, _ in some]] = self.forward([p for _, p in some])
        base = len(self.values)
        self.known.update((w, base + i) for i, w in enumerate(new_words))
        self.values = np.concatenate((self.values, out))

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log probability of each text under each language."""
        long = [[w for w in t if len(w) > SHORT and len(w.decode("utf-8", "replace")) > SHORT] for t in texts]
        apart = {w for t in long for w in t}
        self.learn({w for t in texts for w in t if w not in apart})
        out = np.zeros((len(texts), self.values.shape[1]))
        for i, (t, more) in enumerate(zip(texts, long, strict=True)):
            for w in more:
                out[i] += self.forward_long(MARK + w.decode("utf-8", "replace"))
            t = [w for w in t if w not in apart] if more else t
            if t:
                out[i] += self.values[np.fromiter(map(self.known.__getitem__, t), np.int64, len(t))].sum(0)
        return out


def scorer(model: Model) -> Scorer:
    return B.remembered("language", "words", model.key, lambda: Scorer(model))


def has_letter(text: bytes) -> bool:
    return any(0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in text[:64]) or bool(LETTER.search(text.decode("utf-8", "replace")))


def train(documents: DataFrame, path: str, per_language: int = PER_LANGUAGE) -> Model:
    B.small_batches(documents.sparkSession)
    labelled = documents.where(is_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("all"))
    # a hash threshold by language: no sort, no window over a language's rows
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("all"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)) / float(PLACES)
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").where(place < share)  # a row a language
    return Model(path, [tuple(r) for r in piece_counts(sample, path).collect()])  # languages x vocabulary rows at most


def predict(documents: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns, lang_pred and score, one row per row. Only `text` is looked at."""
    names, sent = model.names, documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(sent.value)
        for block in B.blocks(batches, owner="language"):
            texts = block.texts()
            letters = np.array([has_letter(t) for t in texts], bool) if names else np.zeros(len(texts), bool)
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if names:
                logs = s.score([words(t) if ok else [] for t, ok in zip(texts, letters, strict=True)])
                logs -= logs.max(1, keepdims=True)
                p = np.exp(logs)
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                score = np.where(letters, p[np.arange(len(p)), best], 0.0)
                lang = [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(block.batch.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    return documents.select(*dict.fromkeys((*columns, "text"))).mapInArrow(run, schema)


def identify(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = predict(documents, train(documents, path))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents in a learned language by a posterior of at least `least`, all their columns. Without a learned
    language nothing can be told: all stay."""
    if not model.names:
        return documents
    sent = documents.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(sent.value)
        for block in B.blocks(batches, owner="language"):
            texts = block.texts()
            letters = np.array([has_letter(t) for t in texts], bool)
            logs = s.score([words(t) if ok else [] for t, ok in zip(texts, letters, strict=True)])
            best = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            yield block.batch.filter(pa.array(letters & (best >= least)))

    return documents.mapInArrow(run, documents.schema)

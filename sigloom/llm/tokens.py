"""Token ids and counts by a public tokenizer file, each distinct pre-token being handled once per worker.

A tokenizer file is normalizer, pre-tokenizer and merges. Merges never cross a pre-token, so a text's ids are those of
its pre-tokens one after another. Those of ASCII words are plain to see: numpy cuts them for a block of texts, Arrow tells
the distinct ones, and those that are new are merged in one call. Words of letters of Latin-1 between punctuation are
plain as well; every other word goes through the file's own normalizer, pre-tokenizer and added tokens.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Collection
from itertools import islice

import numpy as np
import pyarrow as pa

from . import blocks as B

WORDS, CORES = 150_000, 20_000  # entries that a worker remembers, and as many again that it looked up before
MERGED = 4096  # pre-tokens that are merged in one call


def byte_letters() -> dict[int, str]:
    """Byte -> the visible letter that byte-level vocabularies write for it: itself where printable, else 256 onwards."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = byte_letters()
SHOWN = "".join(LETTERS[b] for b in range(256))


def written(s: str) -> str:
    return s if s.isascii() and s.isprintable() and " " not in s else s.encode().decode("latin-1").translate(LETTERS)


#: letters of Latin-1, whose lower case and composed form are the same by any library, between ASCII punctuation
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


#: The pre-tokens of lower-cased ASCII, as the file cuts them: endings after an apostrophe, letters, digits, other signs.
ASCII = re.compile(rb"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\sa-z0-9]+")
GAP, LETTER, DIGIT, SIGN = range(4)
KIND = np.full(256, SIGN, np.uint8)  # other bytes than those of a letter of Latin-1 make a word one that is taken whole
KIND[[0x20, *range(0x09, 0x0E)]] = GAP
KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = LETTER
KIND[0x80:] = LETTER
KIND[[*b"0123456789"]] = DIGIT
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What the texts' ids are put together from, and the first of each text: the pre-tokens, lower-cased, of words of ASCII
    and letters of Latin-1, and other words as they are. Words that may hold an added token count as others."""
    kind, low, other = KIND[data], LOWER[data], data >= 0x80
    if other.any():
        second = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00FF, of which two are signs
        second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
        low[second] += np.where(low[second] < 0x9F, 0x20, 0).astype(np.uint8)
        other[second] = other[second - 1] = False
    other[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))  # added tokens are written <|...|>
    solid = kind != GAP
    edge = np.zeros(len(data) + 1, bool)  # where a text starts
    edge[offsets] = True
    before = np.full(len(data), GAP, np.uint8)
    before[1:] = kind[:-1]
    before[edge[:-1]] = GAP
    start = solid & ((kind != before) | (kind == DIGIT))

    mark = np.flatnonzero(start & (data == ord("'")))  # the first of a run of signs
    if len(mark):
        one, two = (np.append(low, [0, 0])[mark + k] for k in (1, 2))
        one[edge[mark + 1]] = 0
        two[edge[mark + 1] | edge[np.minimum(mark + 2, len(data))]] = 0
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | long] + 1] = False
        rest = np.concatenate([mark[short] + 2, mark[long] + 3])
        rest = rest[rest < len(data)]
        start[rest] |= solid[rest]

    if other.any():
        first = solid & (before == GAP)
        word = np.cumsum(first, dtype=np.int32) - 1
        whole = np.zeros(int(word[-1]) + 1, bool)
        whole[word[other]] = True
        inside = solid & whole[word]
        start, low = np.where(inside, first, start), np.where(inside, data, low)

    place = np.flatnonzero(start)
    ends = np.append(np.cumsum(solid, dtype=np.int32)[place] - 1, np.count_nonzero(solid)).astype(np.int64)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(low[solid])]
    return pa.Array.from_buffers(pa.large_binary(), len(place), buffers), np.searchsorted(place, offsets)


class LowerWordTokenizer:
    """For a vocabulary that lower-cases and drops white space: word or pre-token (bytes without ASCII white space) -> ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.bare = Tokenizer(self.model)  # takes pre-tokens as they are
        self.last = np.zeros(self.full.get_vocab_size(), bool)  # ids that end a pre-token
        suffix = self.model.end_of_word_suffix
        if suffix:
            self.last[[i for t, i in self.bare.get_vocab().items() if t.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.older_words: dict[bytes, bytes] = {}
        self.older_cores: dict[bytes, bytes] = {}

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens."""
        out: list[bytes] = []
        for lo in range(0, len(parts), MERGED):
            some = [codecs.charmap_decode(p, "strict", SHOWN)[0] for p in parts[lo : lo + MERGED]]
            ids = np.array(self.bare.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:  # a vocabulary that doesn't mark the ends
                out += [np.array([t.id for t in self.model.tokenize(s)], "<u4").tobytes() for s in some]
        return out

    def parts(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """Pre-token of a word -> ids, for each of these."""
        cores, older = self.cores, self.older_cores
        had = {p: cores[p] for p in wanted if p in cores}
        new = {p: older[p] for p in wanted if p in older and p not in cores}
        missing = [p for p in wanted if p not in had and p not in new]
        new.update(zip(missing, self.merged(missing), strict=True))
        if len(cores) + len(new) > CORES:  # what is in use comes over from the older ones, the rest is forgotten
            self.older_cores, self.cores = cores, {}
        self.cores.update(islice(new.items(), CORES))
        return new | had

    def learn(self, words: Collection[bytes]) -> dict[bytes, bytes]:
        """After this, the returned table has each of these words, which differ."""
        if len(self.words) > WORDS:
            self.older_words, self.words = self.words, {}
        known, older = self.words, self.older_words
        letters: list[bytes] = []
        cut: dict[bytes, list[bytes]] = {}
        for w in [w for w in words if w not in known]:
            if w in older:
                known[w] = older[w]
            elif w.isalpha() and w.islower():
                letters.append(w)
            else:
                s = w.decode("utf-8", "replace")
                m = None if "<|" in s else PLAIN.fullmatch(s)
                if m:
                    before, middle, after = m.groups()
                    found = [p.encode() for p in (before, middle.lower(), after) if p]
                    if found == [w]:
                        letters.append(w)
                    else:
                        cut[w] = found
                elif w.isascii() and "<|" not in s:
                    cut[w] = ASCII.findall(w.lower())
                else:
                    known[w] = np.array(self.full.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        known.update(zip(letters, self.merged(letters), strict=True))
        ids = self.parts({p for found in cut.values() for p in found})
        known.update((w, b"".join([ids[p] for p in found])) for w, found in cut.items())
        return known

    def ids(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts, and where each text starts and ends in them."""
        cut, first = pretokens(block.data, block.offsets)
        found = cut.dictionary_encode()
        words, index = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        known = list(map(self.learn(words).__getitem__, words))
        table = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        n = sizes[index]
        upto = np.append(0, np.cumsum(n))
        return table[np.repeat((np.cumsum(sizes) - sizes)[index] - upto[:-1], n) + np.arange(upto[-1])], upto[first]


def lower_words(path: str) -> LowerWordTokenizer:
    return B.remembered("packing", "words", path, lambda: LowerWordTokenizer(path))

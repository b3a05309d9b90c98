"""BPE encoding and decoding with a public vocabulary file, in batched numpy.

The words of a batch that were not seen before go into one flat array of
symbol ids. Each round finds, for every word at once, its lowest-ranked pair
of neighbours - a pair's rank comes by binary search over the sorted pair
keys - and merges all its occurrences; a word leaves when no pair is left.
The vocabulary's normaliser (NFC, lower case), its splitting pattern and its
special tokens are followed; decoding joins the tokens' strings.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import prepare, row_udf

# Fixed value: the splitting pattern of the vocabulary file, white space by its
# Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
NO_RANK = np.iinfo(np.int64).max
CACHE_WORDS = 400_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@cache
def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where it is printable
    Latin-1, otherwise the next unused sign from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    signs, more = [], 256
    for b in range(256):
        signs.append(chr(b if b in plain else more))
        more += b not in plain
    return signs


class Bpe:
    """A vocabulary whose last symbol of a word carries the end-of-word suffix."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *special.values()])
        self.tokens = np.full(self.size, "", object)
        for t, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = t
        self.special = special
        self.inner = np.array([vocab[c] for c in byte_signs()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_signs()], np.int64)
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        keep = np.concatenate(([True], np.diff(pairs[order]) > 0))  # first rank of a pair
        self.keys, self.ranks = pairs[order][keep], order[keep]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.words = regex.compile(SPLIT)
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, all words merged together round by round."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(lens)
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), lens)
        out: list = [None] * len(raw)
        while len(sym):
            ranks = np.full(len(sym), NO_RANK)  # of the pair that starts here
            same = np.flatnonzero(word[1:] == word[:-1])
            ranks[same] = self.pair_ranks(sym[same], sym[same + 1])
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(ranks, first)
            size = np.diff(first, append=len(sym))
            done = low == NO_RANK
            for k in np.flatnonzero(done):
                out[word[first[k]]] = sym[first[k]:first[k] + size[k]].astype("<u4")
            live = np.repeat(~done, size)
            hit = live & (ranks == np.repeat(low, size))
            # Of overlapping occurrences (a a a) every second one merges.
            at = np.flatnonzero(hit)
            if len(at):
                run = np.concatenate(([True], (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])))
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
                sym = sym.copy()
                sym[at] = self.merged[ranks[at]]
                live[at + 1] = False
            sym, word = sym[live], word[live]
        return out

    def normal(self, text: str) -> str:
        # Lower case sign by sign: the final sigma has no form of its own.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        # In ASCII the same pattern needs no Unicode properties.
        return (self.ascii_words if text.isascii() else self.words).findall(text)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special tokens' strings become their ids."""
        pieces = []
        for t in texts:
            parts = self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t]
            mine: list = []
            for p in parts:
                mine += [p] if p in self.special else self.split(self.normal(p))
            pieces.append(mine)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for s, i in self.special.items():
            known[s] = np.array([i], "<u4").tobytes()
        new = list(set().union(*[set(mine).difference(known) for mine in pieces]))
        for a in range(0, len(new), 50_000):
            part = new[a:a + 50_000]
            for w, ids in zip(part, self.encode_words(part)):
                known[w] = ids.tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, mine)), "<u4") for mine in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by spaces, special tokens among them."""
        return " ".join(self.tokens[ids].tolist())


@cache
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def _digests(path: str, texts: list[str]) -> dict:
    from hashlib import sha256
    bpe = _loaded(path)
    ids = bpe.encode_batch(texts)
    return {"n_tokens": [len(x) for x in ids],
            "ids_sha256": [sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest()
                               for x in ids]}


def _ids(path: str, texts: list[str]) -> dict:
    return {"ids": [x.astype(np.int64) for x in _loaded(path).encode_batch(texts)]}


def encode(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text",
           path: str | None = None) -> DataFrame:
    """(key, ids) for every row. ``path``: the vocabulary file, on every executor.

    Defined results: a NULL, empty or white-space text has no ids; repeated
    rows get equal ids; an empty table stays empty; other columns are not read.
    """
    prepare(spark)
    udf = row_udf(spark, "ids array<bigint>", path or vocabulary_path(), _ids)
    return docs.select(key, udf(F.col(text)).alias("e")).select(key, "e.ids")


def decode(spark: SparkSession, encoded: DataFrame, *, ids: str = "ids",
           path: str | None = None) -> DataFrame:
    """``encoded`` with a column ``text``: the decoded ids (NULL ids: '')."""
    prepare(spark)
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        bpe = _loaded(path)
        return s.map(lambda x: "" if x is None else bpe.decode(np.asarray(x, np.int64)))

    return encoded.withColumn("text", run(F.col(ids)))


def bpe_digests(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs``."""
    prepare(spark)
    udf = row_udf(spark, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                  path or vocabulary_path(), _digests)
    return docs.select("doc_id", udf(F.col("text")).alias("e")).select("doc_id", "e.*")

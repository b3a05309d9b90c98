"""Token files: ids of whole documents, range-coded, in ascending key order.

Format. A file set is a Parquet folder (so that Spark's committer makes a
lost executor's files whole again); its rows are *chunks* of consecutive whole
documents:

=========  ==========================================================
shard      range of the key order that the chunk is in
chunk      number of the chunk inside its shard, from 0
n_ids      ids in the chunk
docs       number of documents
index      int64 keys (with a NULL bitmap byte each) and int64 lengths
blocks     per block: uint32 ids, uint32 payload bytes, uint32 CRC-32 of the ids
payload    the blocks' payloads, one after the other (see ``range_coder``)
=========  ==========================================================

Every block is reset and checksummed on its own; a chunk is read without any
other. A document longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

import uuid
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.bpe import byte_signs
from eventide.llm.common import prepare
from eventide.llm.range_coder import BLOCK, decode_blocks, encode_blocks
from eventide.session import ensure_checkpoint_dir

END_ID = 2
CHUNK_IDS = BLOCK  # ids coded together: one block, unless a document is longer
SCHEMA = ("shard int, chunk int, n_ids long, docs int, index binary, blocks binary, payload binary")


OTHER, LETTER, NUMBER, SPACE, END = range(5)  # classes of code points; END follows each text
END_SIGN = "\U0010ffff"


@cache
def _classes() -> np.ndarray:
    """The class of every code point, by the classes of the regex package."""
    import regex
    out = np.full(0x110000, OTHER, np.uint8)
    signs = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, signs):
            out[ord(m.group()[0]):ord(m.group()[-1]) + 1] = kind
    out[ord(END_SIGN)] = END
    return out


def pretoken_starts(u: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokens of texts start; ``u``: code points, each text
    with END_SIGN behind it, which is a piece of its own.

    What ``public_tokenizers.PATTERN`` finds from left to right: runs of a class, with
    one space before them; white space but for its last sign; the contractions.
    """
    kind = _classes()[u]
    space = kind == SPACE
    start = np.ones(len(u), bool)
    start[1:] = kind[1:] != kind[:-1]
    blank = u == 32
    start[1:] &= ~(blank[:-1] & ~space[1:] & (kind[1:] != END))  # joined with the space before
    # The last sign of white space that a text goes on after stands apart.
    start[:-1] |= space[:-1] & ~space[1:] & (kind[1:] != END)
    start |= kind == END
    at = (u[:-1] == 39).nonzero()[0]
    if len(at):
        # An apostrophe that starts a piece, and the letters of a contraction behind it.
        at = at[start[at]]
        one = u[at + 1]
        two = u[np.minimum(at + 2, len(u) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        size = np.where(short, 2, np.where(long, 3, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[at + size] = True
    return start.nonzero()[0]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` values."""
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))


class _Store:
    """Arrays of different lengths, one behind the other, by number."""

    def __init__(self, dtype):
        self.flat, self.used, self.n = np.zeros(0, dtype), 0, 0
        self.start, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        a, b, first, end = self.n, self.n + len(lens), self.used, self.used + len(flat)
        self.flat, self.start, self.lens = _room(self.flat, end), _room(self.start, b), _room(self.lens, b)
        self.flat[first:end], self.start[a:b], self.lens[a:b] = flat, first + np.cumsum(lens) - lens, lens
        self.n, self.used = b, end

    def get(self, k: np.ndarray) -> np.ndarray:
        """The arrays numbered ``k``, one behind the other."""
        return self.flat[_spans(self.start[k], self.lens[k])]


def _spans(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span."""
    end = np.cumsum(lens)
    return np.repeat(start - end + lens, lens) + np.arange(end[-1] if len(end) else 0)


class Vocabulary:
    """Encoding by the tokenizers library, each different pre-token once.

    The texts of a batch are cut into pre-tokens in numpy. Words are looked up by a hash
    in a table that holds one word a slot and compared sign by sign with the word kept.
    """

    CACHE_WORDS, SLOT_BITS, JOINED = 1_000_000, 22, 128
    PRIME, PRIME_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        # Words are cut here, so the library's model is called without its pre-tokenizer;
        # a pre-token alone is encoded as within its text.
        self.model = Tokenizer(self.lib.model)
        self.signs = dict(enumerate(byte_signs()))
        ids = self.lib.get_vocab(with_added_tokens=False)
        alone = set(self.signs.values()).difference(*[set(t) for t in ids if len(t) > 1])
        self.between = next(b for b in (0xFF, 0xFE, 0xF5, 0xC1, 0xC0) if self.signs[b] in alone & set(ids))
        self.between_id = ids[self.signs[self.between]]
        # Texts with these go to the library as they are.
        self.apart = [*(t.content for t in self.lib.get_added_tokens_decoder().values()), END_SIGN]
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        """Empty the cache; word 0 is the end of a text, without ids."""
        self.slots = np.zeros(1 << self.SLOT_BITS, np.int32)
        self.words, self.ids = _Store(np.uint32), _Store("<u4")
        self.words.add(np.array([ord(END_SIGN)], np.uint32), np.ones(1, np.int64))
        self.ids.add(np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def add(self, u: np.ndarray, start: np.ndarray, lens: np.ndarray) -> None:
        """Number and encode the words at ``start``."""
        at = _spans(start, lens + 1)
        ends = np.cumsum(lens + 1) - 1
        at[ends] = 0
        signs = u[at]
        signs[ends] = ord(END_SIGN)
        words = signs.astype("<u4").tobytes().decode("utf-32-le").encode().split(END_SIGN.encode())[:-1]
        self.words.add(np.delete(signs, ends), lens)
        self.ids.add(*self.encode_words(words))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words and how many each has. The library gets JOINED words at
        a time, with a byte between them that no UTF-8 text holds and no merge takes."""
        between = bytes([self.between])
        parts = [between.join([*words[i:i + self.JOINED], b""]).decode("latin-1").translate(self.signs)
                 for i in range(0, len(words), self.JOINED)]
        ids = np.concatenate([np.array(e.ids, "<u4")
                              for e in self.model.encode_batch_fast(parts, add_special_tokens=False)])
        end = ids == self.between_id
        return ids[~end], np.diff(end.nonzero()[0], prepend=-1) - 1

    def hashes(self, u: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
        if len(self.power) < len(u):
            power = np.full(len(u), self.PRIME, np.uint64), np.full(len(u), self.PRIME_INV, np.uint64)
            power[0][0] = power[1][0] = 1
            self.power, self.inverse = map(np.cumprod, power)
        h = np.add.reduceat(u * self.power[:len(u)], start) * self.inverse[start]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9) + lens.view(np.uint64)

    def numbers(self, u: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The numbers of the words of ``u``, those not met before added."""
        h = self.hashes(u, start, lens)
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).view(np.int64)
        k = self.slots[slot].astype(np.int64)
        k[u[start] == ord(END_SIGN)] = 0
        new = self.differ(u, lens, k)
        if len(new):
            _, first, same = np.unique(h[new], return_index=True, return_inverse=True)
            k[new] = self.words.n + same
            first = new[first]
            self.slots[slot[first]] = self.words.n + np.arange(len(first))
            self.add(u, start[first], lens[first])
            new = new[self.differ(u[_spans(start[new], lens[new])], lens[new], k[new])]
            if len(new):  # other words of the same hash
                k[new] = self.words.n + np.arange(len(new))
                self.add(u, start[new], lens[new])
        return k

    def differ(self, signs: np.ndarray, lens: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which of the words, one behind the other in ``signs``, are not those numbered ``k``."""
        end = np.cumsum(lens)
        at = np.repeat(self.words.start[k] - end + lens, lens) + np.arange(len(signs))
        other = self.words.lens[k] != lens
        unlike = (self.words.flat.take(at, mode="clip") != signs).nonzero()[0]
        other[np.searchsorted(end, unlike, "right")] = True
        return other.nonzero()[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        from eventide.llm.nptext import text_blocks
        apart = [any(s in t for s in self.apart) for t in texts]
        out = []
        for a, b in text_blocks(texts):
            out += self._encode(["" if z else t for t, z in zip(texts[a:b], apart[a:b])])
        for i, z in enumerate(apart):
            if z:
                out[i] = np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.words.n > self.CACHE_WORDS:
            self.forget()
        u = np.frombuffer((END_SIGN.join(texts) + END_SIGN).encode("utf-32-le"), "<u4")
        start = pretoken_starts(u)
        k = self.numbers(u, start, np.diff(start, append=len(u)))
        ids = self.ids.get(k)
        end = (u[start] == ord(END_SIGN)).nonzero()[0]
        cut = np.concatenate(([0], np.cumsum(self.ids.lens[k])[end])).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pack_chunk(shard: int, chunk: int, keys: list, docs: list[np.ndarray]) -> dict:
    ids = np.concatenate(docs).astype(np.int64)
    payloads = encode_blocks(ids)
    heads = np.array([(min(BLOCK, len(ids) - i), len(p), zlib.crc32(ids[i:i + BLOCK].astype("<u4").tobytes()))
                      for i, p in zip(range(0, len(ids), BLOCK), payloads)], "<u4")
    null = np.array([k is None for k in keys], np.uint8)
    index = (null.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes()
             + np.array([len(d) for d in docs], "<i8").tobytes())
    return {"shard": shard, "chunk": chunk, "n_ids": len(ids), "docs": len(docs), "index": index,
            "blocks": heads.tobytes(), "payload": b"".join(payloads)}


def unpack_chunks(rows: list[dict]) -> list[tuple[list, list[np.ndarray]]]:
    """(keys, ids of each document) of each chunk; all blocks decoded together.

    Raises ValueError for a block whose checksum does not hold.
    """
    payloads, sizes, sums = [], [], []
    for r in rows:
        heads = np.frombuffer(r["blocks"], "<u4").reshape(-1, 3).astype(np.int64)
        ends = np.cumsum(heads[:, 1])
        payloads += [r["payload"][e - n:e] for e, n in zip(ends.tolist(), heads[:, 1].tolist())]
        sizes.append(heads[:, 0])
        sums.append(heads[:, 2])
    sizes, sums = np.concatenate(sizes), np.concatenate(sums)
    ids = decode_blocks(payloads, sizes).astype("<u4")
    edge = np.concatenate(([0], np.cumsum(sizes)))
    for k, want in enumerate(sums.tolist()):
        if zlib.crc32(ids[edge[k]:edge[k + 1]].tobytes()) != want:
            raise ValueError(f"block {k}: checksum differs")
    out, at = [], 0
    for r in rows:
        n = r["docs"]
        null = np.frombuffer(r["index"], np.uint8, n)
        keys = np.frombuffer(r["index"], "<i8", n, n)
        lens = np.frombuffer(r["index"], "<i8", n, 9 * n)
        cut = at + np.concatenate(([0], np.cumsum(lens)))
        out.append(([None if z else int(k) for z, k in zip(null, keys)],
                    [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]))
        at = int(cut[-1])
    return out


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, *, key: str = "doc_id",
                 text: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every document, append ``end_id`` and write the file set to ``path``.

    Documents stand in ascending order of the key (NULL first), those of equal
    keys by a hash of their texts; a NULL text is empty. ``vocabulary`` is the
    file's path on every executor. An empty table gives an empty file set.
    """
    prepare(spark)
    vocabulary = vocabulary or vocabulary_path()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    ranged = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h")

    def encode(it):
        import pandas as pd
        from pyspark import TaskContext
        shard, chunk = TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], "<u4")
        for pdf in it:
            ks = [None if pd.isna(k) else int(k) for k in pdf["key"].astype(object)]
            for k, x in zip(ks, _vocabulary(vocabulary).encode(pdf["t"].tolist())):
                if keys and size + len(x) >= CHUNK_IDS:
                    yield pd.DataFrame([pack_chunk(shard, chunk, keys, ids)])
                    keys, ids, size, chunk = [], [], 0, chunk + 1
                keys.append(k)
                ids.append(np.concatenate((x, end)))
                size += len(x) + 1
        if keys:
            yield pd.DataFrame([pack_chunk(shard, chunk, keys, ids)])

    ranged.select("key", "t").mapInPandas(encode, SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of every document in the file set at ``path``."""
    return _read(spark, path, key, with_ids=True)


def _read(spark: SparkSession, path: str, key: str, with_ids: bool) -> DataFrame:
    from pyspark.sql import Window
    prepare(spark)
    files = spark.read.parquet(path)
    # One row per shard, of which there are as many as write tasks; the chunks
    # before this one in its shard are summed in the window over the shard.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    own = Window.partitionBy("shard").orderBy("chunk")
    starts = (files.select("shard", "chunk", "n_ids")
              .withColumn("inside", F.sum("n_ids").over(own) - F.col("n_ids"))
              .join(before, "shard").select("shard", "chunk", (F.col("before") + F.col("inside")).alias("first")))

    def decode(it):
        import pandas as pd
        for pdf in it:
            rows = pdf.to_dict("records")
            turn = (pdf["n_ids"].cumsum() // CHUNK_IDS).to_numpy()  # small chunks together
            for k in np.unique(turn):
                part = [rows[i] for i in np.flatnonzero(turn == k)]
                for r, (keys, docs) in zip(part, unpack_chunks(part)):
                    n = np.array([len(d) for d in docs])
                    out = {"shard": r["shard"], "chunk": r["chunk"], "key": pd.array(keys, "Int64"),
                           "inside": np.cumsum(n) - n, "n_tokens": n,
                           "ids_crc32": [zlib.crc32(d.tobytes()) for d in docs]}
                    if with_ids:
                        out["ids"] = [d.astype(np.int64) for d in docs]
                    yield pd.DataFrame(out)

    kind = "shard int, chunk int, key long, inside long, n_tokens long, ids_crc32 long"
    docs = files.mapInPandas(decode, kind + (", ids array<bigint>" if with_ids else ""))
    return docs.join(starts, ["shard", "chunk"]).select(
        F.col("key").alias(key), (F.col("first") + F.col("inside")).alias("start"), "n_tokens",
        "ids_crc32", *(["ids"] if with_ids else []))


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` below the checkpoint folder, which all
    executors share, and return doc_id, start, n_tokens, ids_crc32 read from them."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark, docs, path)
    return _read(spark, path, "doc_id", with_ids=False)

"""Packing along a space-filling curve.

Every text is tokenised once. Its tokens are hashed with a sign into WIDTH counters; that vector, normalised, is
projected to DIMS Gaussian dimensions; the projections, standardised with moments of the whole corpus, give a cell of
a grid and its key along a Hilbert curve. Rows are range-partitioned by (key, hash of the id), so that one key cannot fill
a task, sorted, and their tokens form one stream that is cut every `length` tokens. Only the last sequence has
padding. The token totals of the key ranges, one number per range of about RANGE tokens, give each range its place in
the stream; nothing else comes to the driver.

Edge cases: a null text is empty and a document of one end token; repeated rows are packed each; null ids sort first;
an empty table gives no pieces; only the named columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, DIMS, BITS, SALT, SEED = 1024, 4, 12, 15, 20
RANGE = 2_000_000
PART_CHARS = 500_000
KEPT_WORDS = 200_000
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Texts of which the tokenizer's own splitting is plain: ASCII and Latin letters that composing leaves alone.
_PLAIN = re.compile("[\t\n\r\x0b\x0c\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@[-`{-~]+")
_CHUNKS = re.compile("[^ \t\n\r\x0b\x0c]+")
#: What the splitting above is that of; with any other tokenizer all texts go through its own encoding.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Marks a chunk that the tokenizer has to split itself.
_ODD = "\x00"


def _byte_alphabet() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_ALPHABET = _byte_alphabet()


class Words(dict):
    """Numbers of the pieces that the tokenizer encodes independently, and their token ids in one long array.

    The tokenizer drops white space and splits plain texts as _PIECES does; other chunks between white space are left to it. What
    is new in a batch goes through the merges; beyond `kept` pieces the later half is forgotten.
    """

    kept = KEPT_WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.plain = made["normalizer"] == PLAIN_NORMALIZER and made["pre_tokenizer"] == PLAIN_SPLITTER and made["model"]["type"] == "BPE"
        self.size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.forget()

    def forget(self, but: int = 0) -> None:
        """Keeps the first pieces: words in frequent use were met early."""
        for piece in list(self)[but:]:
            del self[piece]
        self.new: list[str] = []
        self.starts = self.starts[: but + 1] if but else np.zeros(1, dtype=np.int64)
        self.flat = self.flat[: self.starts[-1]].copy() if but else np.zeros(0, dtype="<u4")

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def piece_ids(self, piece: str) -> list[int]:
        if piece[0] == _ODD:
            return self.tokenizer.encode(piece[1:], add_special_tokens=False).ids
        # a plain piece needs no more splitting: straight to the merges, in the byte-level alphabet
        piece = piece if piece.isascii() else "".join(map(_ALPHABET.__getitem__, piece.encode()))
        return [x.id for x in self.tokenizer.model.tokenize(piece)]

    def learn(self) -> None:
        each = list(map(self.piece_ids, self.new))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, each), dtype=np.int64, count=len(each)))])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(each), dtype="<u4")])
        self.new = []

    def pieces(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _PIECES.findall(text.lower())
        out = []
        for chunk in _CHUNKS.findall(text):
            if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                out += _PIECES.findall(chunk.lower())
            else:
                out.append(_ODD + chunk)
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids; texts go through in parts of some MB."""
        if not self.plain:
            return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < PART_CHARS):
                size += len(texts[to] or "")
                to += 1
            out += self.part_ids(texts[at:to])
            at = to
        return out

    def part_ids(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > self.kept:
            self.forget(self.kept // 2)
        found = [self.pieces(t or "") for t in texts]
        ends = np.cumsum([len(x) for x in found])
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=ends[-1])
        if self.new:
            self.learn()
        size = self.starts[number + 1] - self.starts[number]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.starts[number] - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[np.concatenate([[0], ends])]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def _words(path: str) -> Words:
    return Words(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _hashing(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, WIDTH, vocabulary), rng.choice((-1.0, 1.0), vocabulary), rng.standard_normal((WIDTH, DIMS))


def _projected(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    bucket, sign, directions = _hashing(vocabulary)
    v = np.bincount(bucket[ids], weights=sign[ids], minlength=WIDTH)
    v = np.sign(v) * np.sqrt(np.abs(v))
    return v @ directions / max(float(np.sqrt(v @ v)), 1e-9)


def id_type(vocabulary: int, end: int) -> str:
    return "<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4"


def _tokenised(path: str, end: int, kept: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(path)
        words.kept = kept
        last, width = np.array([end], dtype="<u4"), id_type(words.size, end)
        for b in batches:
            ids = [np.concatenate([x, last]) for x in words.ids(list(b["text"]))]
            at = np.array([_projected(x, max(1 << 16, words.size, end + 1)) for x in ids]).reshape(len(ids), DIMS)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(x) for x in ids], **{f"x{i}": at[:, i] for i in range(DIMS)}, "ids": [x.astype(width).tobytes() for x in ids]})

    return run


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Key along the Hilbert curve of integer cells, shape (rows, dimensions), by Skilling's transposition (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _placed(moments: list[tuple[float, float]], bounds: list[int]) -> Column:
    """Key along the curve, ended by bits of the id's hash, and the range it falls into."""
    mean, sd = np.array(moments).T

    @F.pandas_udf("key long, part int")
    def place(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, salt: pd.Series) -> pd.DataFrame:
        z = (np.stack([a, b, c, d], axis=1) - mean) / np.maximum(sd, 1e-12)
        share = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))  # nearly the normal distribution's share below z
        key = (hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS) << SALT) + salt.to_numpy()
        return pd.DataFrame({"key": key, "part": np.searchsorted(np.array(bounds, dtype=np.int64), key, side="right").astype(np.int32)})

    return place(*[F.col(f"x{i}") for i in range(DIMS)], F.shiftrightunsigned(F.xxhash64("doc_id", "n"), 64 - SALT))


def _cut(starts: dict[int, int], length: int, whole: bool, width: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = None, 0
        for b in batches:
            rows = []
            for p, doc, ids in zip(b["part"], b["doc_id"], b["ids"], strict=True):
                if p != part:
                    part, at = p, starts[p]
                ids = np.frombuffer(ids, dtype=width).astype("<u4")
                n = len(ids)
                first = at
                while at < first + n:
                    sequence, offset = divmod(at, length)
                    take = min(length - offset, first + n - at)
                    piece = ids[at - first : at - first + take].tobytes()
                    rows.append((doc, at - first, take, zlib.crc32(piece), n, sequence, offset, piece if whole else None))
                    at += take
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def as_ids(df: DataFrame) -> DataFrame:
    """Ids pass through Python as strings: beside nulls, pandas would turn them into floats."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, length: int = 4096, path: str | None = None, end: int = 2, text: str = "text", doc_id: str = "doc_id", whole: bool = True, kept: int = KEPT_WORDS, rows: int = 250) -> DataFrame:
    """Pieces of documents and their places in sequences of `length` tokens; ids are little-endian 32-bit, null unless `whole`.

    A worker remembers the tokens of `kept` words, at about 200 bytes each, and takes `rows` texts at once."""
    spark = docs.sparkSession
    C.small_batches(spark, rows)
    path = path or tokenizer_path()
    light = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = ", ".join(f"x{i} double" for i in range(DIMS))
    tokens = C.stage(light.mapInPandas(_tokenised(path, end, kept), f"doc_id string, n long, {fields}, ids binary"), "tokens")
    m = tokens.agg(F.sum("n").alias("n"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(DIMS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not m["n"]:
        return as_ids(spark.createDataFrame([], PIECES))
    moments = [(m[f"m{i}"] or 0.0, m[f"s{i}"] or 0.0) for i in range(DIMS)]
    ranges = int(min(max(m["n"] // RANGE, 1), 65_536))
    cuts = []
    if ranges > 1:
        keys = tokens.select(_placed(moments, [])["key"].alias("key"))
        cuts = keys.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("c")).first()["c"]
    keyed = tokens.withColumn("at", _placed(moments, sorted(set(cuts)))).select("at.key", "at.part", "doc_id", "n", "ids")
    starts, total = {}, 0
    for r in sorted(keyed.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts[r["part"]], total = total, total + r["n"]
    ordered = keyed.drop("n").repartition(len(starts), "part").sortWithinPartitions("part", "key", "doc_id", "ids")
    return as_ids(ordered.select("part", "doc_id", "ids").mapInPandas(_cut(starts, length, whole, id_type(_words(path).size, end)), PIECES))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, each of bounded length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.expr("aggregate(transform(p, x -> hex(x.ids)), '', (a, b) -> a || b, a -> unhex(a))").alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
    )


def op1_curve_packing(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"), whole=False, kept=800_000, rows=1000).drop("ids")

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The byte-to-character table turns each byte of a pretoken into a printable character, the library merges by
rank, and offsets are those of the text's characters.  Decoding reverses the table byte by byte and joins
before it decodes UTF-8, so that a character split over several tokens comes out whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from struct import pack

from pyspark.sql import DataFrame

from .common import out_schema, put, release

#: Characters that go to the library at a time; only memory depends on it (a longer text goes alone).
CHUNK = 100_000


@cache
def byte_table() -> tuple[str, ...]:
    """Character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, extra = [], 0
    for b in range(256):
        table.append(chr(b if b in plain else 0x100 + extra))
        extra += b not in plain
    return tuple(table)


class Codec:
    """Encoder and decoder by ``ranks`` (token bytes -> id), each match of ``pattern`` separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        chars = byte_table()
        show = lambda bs: "".join(chars[b] for b in bs)
        vocab = {show(t): r for t, r in ranks.items()}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            # every way to make the token of two others has the token's rank
            merges += [(show(token[:k]), show(token[k:])) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, fuse_unk=False))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.tokenizer.decoder = decoders.ByteLevel()
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for shown, r in vocab.items():
            self.bytes_of[r] = bytes(back[c] for c in shown)

    def encode(self, texts: list[str], offsets: bool = False) -> list:
        run = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        return run(texts, add_special_tokens=False)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}, pattern)


class Pieces(dict):
    """Chunk of text -> (its ids as packed 32-bit integers, or their decimals joined by spaces; the decoded bytes), each chunk encoded once.

    A single space between two characters that aren't white space always starts a match of the pattern, and a
    line feed between two such is always a match of its own; so texts are cut there and chunks repeat.  Only
    patterns that take at most one leading space into a match allow it (others: ``cut=False`` in encode()).
    """

    #: Chunks that are remembered at most; then all are forgotten, which changes no result. A task takes some 0.6 KB for each.
    REMEMBER = 300_000
    _near = re.compile(r"\s\s|^\s|\s$")
    _cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, own: Codec, decimals: bool, remember: int):
        super().__init__()
        self.own, self.decimals, self.remember = own, decimals, remember

    def keys_of(self, text: str) -> list[str]:
        if self._near.search(text):
            first, *rest = self._cut.split(text)
            return [first, *(" " + w for w in rest)]
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, all of them known from now on."""
        if len(self) > self.remember:
            self.clear()
        keys = [self.keys_of(t) if t else [] for t in texts]
        new = list({k for ks in keys for k in ks if k not in self})
        for part in _chunks(new):
            for k, e in zip(part, self.own.encode(part), strict=True):
                ids = e.ids
                self[k] = (" ".join(map(str, ids)) if self.decimals else pack(f"<{len(ids)}i", *ids)), self.own.decode(ids)
        return keys


@contextmanager
def pieces(path: str, pattern: str, decimals: bool = False, remember: int = Pieces.REMEMBER) -> Iterator[Pieces]:
    """Chunks that one task remembers; at its end the worker, which goes on to other tasks, gives their memory back."""
    known = Pieces(codec(path, pattern), decimals, remember)
    try:
        yield known
    finally:
        known.clear()
        release()


def _chunks(texts: list[str], size: int = CHUNK) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > size:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False, cut: bool = True) -> DataFrame:
    """``df`` with ids (array<int>) and, if asked for, offsets (array<struct<start,end>>, in characters).

    ``path``: a file of base64 tokens and ranks on every node.  A null or empty text has no ids; strings of
    special tokens are ordinary text; repeated rows are encoded each; columns named ids, offsets are replaced.
    """
    new = {"ids": "array<int>"} | ({"offsets": "array<struct<start:int,end:int>>"} if offsets else {})

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = codec(path, pattern)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        with pieces(path, pattern) as known:
            for batch in batches:
                ids, spans = [], []
                for part in _chunks([v.as_py() or "" for v in batch.column(text)]):
                    if cut and not offsets:
                        ids += [np.frombuffer(b"".join([known[k][0] for k in keys]), np.int32) for keys in known.learn(part)]
                        continue
                    for e in own.encode(part, offsets):
                        ids.append(e.ids)
                        if offsets:
                            spans.append([{"start": a, "end": b} for a, b in e.offsets])
                cols = {"ids": pa.array(ids, pa.list_(pa.int32()))} | ({"offsets": pa.array(spans, span)} if offsets else {})
                yield put(batch, cols)

    return df.mapInArrow(run, out_schema(df, new))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with decoded (binary: the tokens' bytes joined) and decoded_text (those as UTF-8, bad bytes replaced). Null ids: empty."""
    new = {"decoded": "binary", "decoded_text": "string"}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(path, pattern)
        for batch in batches:
            raw = [own.decode(v.as_py() or []) for v in batch.column(ids)]
            yield put(batch, {"decoded": pa.array(raw, pa.binary()), "decoded_text": pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())})

    return df.mapInArrow(run, out_schema(df, new))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: ``df`` without its text, with n_tokens long, ids_sha256 and decoded_sha256 string.

    ids_sha256: hex of the decimal ids joined by a space; decoded_sha256: hex of the decoded bytes.  The tokens
    themselves never leave the worker.  Nulls, empty texts, repeats and clashing names as in encode().
    """
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sha = lambda b: hashlib.sha256(b).hexdigest()
        with pieces(path, pattern, decimals=True) as known:
            for batch in batches:
                rows = []
                for part in _chunks([v.as_py() or "" for v in batch.column(text)]):
                    for keys in known.learn(part):
                        got = list(map(known.__getitem__, keys))
                        ids = " ".join([g[0] for g in got])
                        rows.append((ids.count(" ") + bool(ids), sha(ids.encode()), sha(b"".join([g[1] for g in got]))))
                rest = batch.select([n for n in batch.schema.names if n != text])
                n, a, b = list(zip(*rows, strict=True)) or [(), (), ()]
                yield put(rest, {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return df.mapInArrow(run, out_schema(df.drop(text), new))


def encode_checked(df: DataFrame, path: str, pattern: str, text: str = "text", remember: int = Pieces.REMEMBER // 3) -> DataFrame:
    """``df`` without its text, with n_tokens long, ids array<int> and decoded_ok boolean (whether the ids decode to the text). ``remember``: chunks that a task remembers; only speed and memory depend on it. Cases as in encode()."""
    new = {"n_tokens": "long", "ids": "array<int>", "decoded_ok": "boolean"}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        with pieces(path, pattern, remember=remember) as known:
            for batch in batches:
                flat, ends, ok = [], [0], []
                for part in _chunks([v.as_py() or "" for v in batch.column(text)]):
                    for t, keys in zip(part, known.learn(part), strict=True):
                        got = list(map(known.__getitem__, keys))
                        flat.append(np.frombuffer(b"".join([g[0] for g in got]), np.int32))
                        ends.append(ends[-1] + len(flat[-1]))
                        ok.append(b"".join([g[1] for g in got]) == t.encode())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flat, np.empty(0, np.int32)])))
                rest = batch.select([n for n in batch.schema.names if n != text])
                yield put(rest, {"n_tokens": pa.array(np.diff(ends)), "ids": ids, "decoded_ok": pa.array(ok, pa.bool_())})

    return df.mapInArrow(run, out_schema(df.drop(text), new))

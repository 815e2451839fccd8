"""Byte-level BPE encoding of whole texts by tree concatenation, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import table

#: Characters of a leaf: longer texts are cut.
LEAF = 1 << 14
#: Threads that encode the halves of a text.
THREADS = 2
#: Characters around a place that decide whether pieces end there: a special token's length at least.
MARGIN = 16
#: Below this code point both encoders were compared, all characters, and agree.
LATIN = "ɐ"


class Bpe:
    """Encodes as the tokenizers library does with the file at ``path``, whatever the length of a text.

    A text that is longer than ``leaf`` is first cut before white space that follows another character: no piece of the
    pre-tokenizer spans such a place and none looks back over it, so the parts' ids simply follow each other. What stays longer,
    unsplit text, is halved again and again; the halves are encoded together as one batch, which the library runs in parallel, and
    joined two by two. To join, a window around the place is encoded anew. It grows until its result agrees with the left half's
    at its start and with the right half's at its end. There are two sorts of agreement:

    - of pieces: the window starts where a piece of the left half starts, MARGIN before the half's end (what decides on pieces up
      to there is all inside the half), and a piece of the window starts where one of the right half does: from a common
      start on pieces depend on the text after it only, so all that follows is the right half's;
    - of tokens, inside one piece that spans both halves: the window's first token is the left half's there, its last the right
      half's. A sequence of tokens is the encoding of a piece iff any two neighbours are that of their own text; as all
      neighbours are in the left half, in the window or in the right half, the concatenation is the encoding.

    A window that grows to the whole is simply the encoding of the whole.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None, leaf: int = LEAF):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.path, self.leaf = path or public_tokenizers.path("byte_bpe_50k.json"), leaf
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(self.path, encoding="utf-8") as spec:
            self.special = {x["content"]: x["id"] for x in json.load(spec)["added_tokens"]}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=self.special)
        if max(map(len, self.special), default=0) > MARGIN:
            raise ValueError("a special token is longer than the margin")

    @cached_property
    def tokenizer(self):
        """Only loaded for texts that need it: it takes more memory than the rest of a worker."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    @cached_property
    def lengths(self) -> np.ndarray:
        """Bytes of every token."""
        return np.array([len(self.plain.decode_single_token_bytes(i)) for i in range(self.plain.n_vocab)], np.int64)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of texts, each in one go. Latin text without special tokens takes the faster encoder of equal results."""
        hard = [i for i, x in enumerate(texts) if not (x.isascii() or max(x) < LATIN) or any(s in x for s in self.special)]
        done = dict(zip(hard, (e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)), strict=True)) if hard else {}
        easy = [x for i, x in enumerate(texts) if i not in done]
        # Several long ones, as the leaves of a tree are, go to threads together.
        many = len(easy) > 1 and sum(map(len, easy)) > self.leaf
        rest = iter(self.plain.encode_ordinary_batch(easy, num_threads=THREADS) if many else map(self.plain.encode_ordinary, easy))
        return [done[i] if i in done else next(rest) for i in range(len(texts))]

    def pieces(self, text: str) -> list[tuple[int, bool]]:
        """Bytes of each piece and whether it is a special token."""
        out: list[tuple[int, bool]] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]:
            if part in self.special:
                out.append((len(part.encode()), True))
            elif part:
                out += [(len(x), False) for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encode_all([text])[0]
        parts = self.parts(text)
        ids = iter(self.encode_all([x for x in parts if len(x) <= self.leaf]))
        return [i for x in parts for i in (next(ids) if len(x) <= self.leaf else self.tree(x))]

    def parts(self, text: str) -> list[str]:
        """``text`` cut before white space after something else, into parts of up to ``leaf`` characters where that can be."""
        cuts, last, at = [0], 0, 0
        for m in re.finditer(r"(?<=[^\s])(?=[ \t\n\r\f\v])", text):
            if m.start() - at > self.leaf and last > at:
                cuts.append(at := last)
            last = m.start()
            if last - at > self.leaf:
                cuts.append(at := last)
        if len(text) - at > self.leaf and last > at:
            cuts.append(last)
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]

    def tree(self, text: str) -> list[int]:
        """Ids of unsplit text: leaves together, then joins of neighbours, level by level."""
        n = len(text)
        count = 1 << max(1, (n - 1) // self.leaf).bit_length()
        ends = [n * i // count for i in range(count + 1)]
        texts = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        nodes = [_Node(self, x, ids) for x, ids in zip(texts, self.encode_all(texts), strict=True)]
        while len(nodes) > 1:
            nodes = [a.join(b) for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
        return nodes[0].ids.tolist()

    def decode_all(self, ids: list[list[int]]) -> list[str]:
        """As the library's decode(ids, skip_special_tokens=False): the tokens' bytes as UTF-8, what isn't valid replaced."""
        return [self.plain.decode_bytes(x).decode("utf-8", "replace") for x in ids]


class _Node:
    """An encoded text: bytes, ids, where tokens and pieces start (in bytes)."""

    def __init__(self, bpe: Bpe, text: str | bytes, ids: Iterable[int], starts: np.ndarray | None = None):
        self.bpe, self.raw = bpe, text.encode() if isinstance(text, str) else text
        self.ids = np.asarray(ids, np.int64)
        self.at = np.concatenate(([0], np.cumsum(bpe.lengths[self.ids])))
        if starts is None:
            own = bpe.pieces(self.raw.decode())
            starts = np.cumsum([0, *(n for n, _ in own)])[:-1]
        self.starts = starts

    def _cut(self, at: int) -> int:
        """The token that starts at byte ``at``."""
        i = int(np.searchsorted(self.at, at))
        if self.at[i] != at:
            raise AssertionError("a piece starts inside a token")
        return i

    def _spliced(self, other: _Node, left: int, inner: np.ndarray, right: int, starts: np.ndarray) -> _Node:
        return _Node(self.bpe, self.raw + other.raw, np.concatenate((self.ids[:left], inner, other.ids[right:])), starts)

    def join(self, other: _Node) -> _Node:
        size = 4 * MARGIN
        while True:
            whole = size >= len(self.raw) and size >= len(other.raw)
            if done := self._by_pieces(other, size) or (None if whole else self._by_tokens(other, size)):
                return done
            if whole:
                text = (self.raw + other.raw).decode()
                return _Node(self.bpe, text, self.bpe.encode_all([text])[0])
            size *= 2

    def _by_pieces(self, other: _Node, size: int) -> _Node | None:
        n = len(self.raw)
        safe = self.starts[(self.starts <= n - 4 * MARGIN) & (self.starts >= n - size)]
        if len(safe):
            left = int(safe[0])
        elif size >= n:
            left = 0
        else:
            return None
        to = min(size, len(other.raw))
        while to < len(other.raw) and other.raw[to] & 0xC0 == 0x80:
            to += 1
        window = (self.raw[left:] + other.raw[:to]).decode()
        starts = left + np.cumsum([0, *(k for k, _ in self.bpe.pieces(window))])[:-1]
        common = np.intersect1d(starts[starts >= n] - n, other.starts)
        if to < len(other.raw):
            common = common[common <= to - 4 * MARGIN]
        if not len(common):
            return None
        right = int(common[0])
        # All of the window, then cut: white space at its end would be one piece.
        inner = np.asarray(self.bpe.encode_all([window])[0], np.int64)
        inner = inner[: int(np.searchsorted(np.cumsum(self.bpe.lengths[inner]), n + right - left, "right"))]
        kept = np.concatenate((self.starts[self.starts < left], starts[starts < n + right], other.starts[other.starts >= right] + n))
        return self._spliced(other, self._cut(left), inner, other._cut(right), kept)

    def _by_tokens(self, other: _Node, size: int) -> _Node | None:
        n, from_, to = len(self.raw), int(self.starts[-1]), int(other.starts[1]) if len(other.starts) > 1 else len(other.raw)
        # Well inside one piece on either side; its first characters are left out, a contraction may end there.
        a, b = max(from_ + 4 * MARGIN, n - size), min(to, size)
        i, j = int(np.searchsorted(self.at, a)), int(np.searchsorted(other.at, b, "right")) - 1
        while i < len(self.ids) and self.raw[self.at[i]] & 0xC0 == 0x80:
            i += 1
        while j > 0 and other.at[j] < len(other.raw) and other.raw[other.at[j]] & 0xC0 == 0x80:
            j -= 1
        if i >= len(self.ids) or j < 1:
            return None
        start = max(from_, int(self.at[i]) - 4 * MARGIN)
        while start < n and self.raw[start] & 0xC0 == 0x80:
            start += 1
        around = self.bpe.pieces((self.raw[start:] + other.raw[: other.at[j]]).decode())
        if len(around) != 1 or around[0][1] or to < len(other.raw) and other.at[j] > to:
            return None
        text = (self.raw[self.at[i] :] + other.raw[: other.at[j]]).decode()
        if len(self.bpe.pieces(text)) != 1:
            return None
        inner = np.asarray(self.bpe.encode_all([text])[0], np.int64)
        if inner[0] != self.ids[i] or inner[-1] != other.ids[j - 1]:
            return None
        return self._spliced(other, i, inner, j, np.concatenate((self.starts, other.starts[1:] + n)))


def _rows(bpe: Bpe, text: str | None, fields: tuple[str, ...]) -> tuple:
    """What is asked for of one text; ids leave as a packed array, as lists of numbers of a whole batch would fill a worker."""
    ids = bpe.encode(text or "")
    decoded = bpe.decode_all([ids])[0] if {"decoded", "intact", "decoded_sha256"} & {*fields} else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    each = {"ids": lambda: np.array(ids, np.int32), "decoded": lambda: decoded, "intact": lambda: decoded == (text or ""), "n_tokens": lambda: len(ids), "ids_sha256": lambda: sha(",".join(map(str, ids))), "decoded_sha256": lambda: sha(decoded)}
    return tuple(each[f]() for f in fields)


KINDS = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "intact": pa.bool_(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
#: Rows whose results are held before they leave the worker.
HELD = 256


def encoded(df: DataFrame, fields: tuple[str, ...] = ("ids",), text: str = "text", tokenizer: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` with ``fields`` of ``text``, whole texts: ids, n_tokens, decoded (the ids' text), intact (whether that is the text), or digests.

    A null is encoded as an empty text, which has no ids. Columns of the fields' names that ``df`` has are replaced; ``text``
    itself stays unless ``keep_text`` is off. ``tokenizer`` is a file's path on every executor; None for the installed
    byte_bpe_50k.json.
    """
    kept = [c for c in df.columns if c not in fields and (keep_text or c != text)]
    schema = StructType([df.schema[c] for c in kept] + [StructField(f, from_arrow_type(KINDS[f])) for f in fields])
    source = df.select(*kept, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(tokenizer)
        for batch in batches:
            for i in range(0, len(batch), HELD):
                part = batch.slice(i, HELD)
                rows = [_rows(bpe, x, fields) for x in part.column(len(kept)).to_pylist()]
                new = [pa.array([row[k] for row in rows], KINDS[f]) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=[*kept, *fields])

    return source.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of every document's ids and of the text that they decode to."""
    fields = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), fields, keep_text=False)

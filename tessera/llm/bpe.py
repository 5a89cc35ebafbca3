"""Byte-level BPE with the tokenizers library over Arrow batches.

The merges come from a file of ranks. Bytes are mapped to printable characters for the library, and decoding reverses
that table; ids travel packed, as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm.common import free_name, short_batches, text_parts

ENCODED = pa.schema([("n_tokens", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary())])
#: Different matches whose ids a worker remembers at most; beyond that it forgets all and starts again.
REMEMBERED = 300_000
#: Characters of texts that are split at once, and matches that the library encodes at once.
TOGETHER, BATCH = 1 << 18, 4096


def byte_to_char() -> list[str]:
    """The character that stands for each byte: itself where it's printable Latin-1, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes token: what is left when all merges of lower rank are done."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], most), i) for i in range(len(parts) - 1))
        if rank >= most:
            raise ValueError(f"no merges lead to {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def tokenizer_json(path: str) -> str:
    """The tokenizer of a file of ranks for single matches of a pattern, as the library's JSON. Its size is that of the vocabulary, which is fixed."""
    ranks, chars = read_ranks(path), byte_to_char()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [tuple(name[half] for half in _halves(token, ranks)) for token in sorted(ranks, key=ranks.get) if len(token) > 1]
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # what it gets is one match
    return tokenizer.to_str()


@lru_cache(maxsize=4)
def _loaded(text: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core, not all of them
    return Tokenizer.from_str(text)


@lru_cache(maxsize=4)
def _bytes_by_id(text: str) -> list[bytes]:
    """The byte table of decoding, by id."""
    back = {c: b for b, c in enumerate(byte_to_char())}
    vocab = _loaded(text).get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token)
    return table


class Words:
    """Ids and inner offsets of matches of the pattern, each encoded once by the library."""

    def __init__(self, text: str, pattern: str, with_offsets: bool):
        self.tokenizer, self.split, self.with_offsets = _loaded(text), regex.compile(pattern).findall, with_offsets
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.counts, self.ids, self.inner = np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros((0, 2), "<u4")

    def know(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > REMEMBERED:
            self._forget()
            new = list(words)
        if not new:
            return
        counts, ids, inner = [self.counts], [self.ids], [self.inner]
        for a in range(0, len(new), BATCH):  # the matches come as words of one input, whose result is a few arrays
            part = new[a : a + BATCH]
            made = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.array(made.word_ids, np.int64), minlength=len(part)))
            ids.append(np.array(made.ids, "<u4"))
            if self.with_offsets:
                inner.append(np.array(made.offsets, "<u4").reshape(-1, 2))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.counts, self.ids, self.inner = np.concatenate(counts), np.concatenate(ids), np.concatenate(inner)

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, bytes | None]]:
        """Number of tokens, packed ids and packed offsets of each text."""
        split = [self.split(t) for t in texts]
        self.know(set().union(*split))
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        counts = self.counts[at]
        starts = np.cumsum(self.counts) - self.counts
        ends = np.cumsum(counts)
        pick = np.repeat(starts[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        ids, spans = self.ids[pick], None
        if self.with_offsets:
            size = np.fromiter(map(len, words), np.int64, len(words))
            upto = np.cumsum(size) - size
            of = np.repeat(np.arange(len(split)), n_words)
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
            spans = (self.inner[pick] + np.repeat(upto - first[of] if len(words) else upto, counts)[:, None]).astype("<u4")
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            out.append((b - a, ids[a:b].tobytes(), None if spans is None else spans[a:b].tobytes()))
        return out


@lru_cache(maxsize=2)
def _words(text: str, pattern: str, with_offsets: bool) -> Words:
    """One for a worker, whose tasks share what it remembers."""
    return Words(text, pattern, with_offsets)


def encode(df: DataFrame, text_col: str, path: str, pattern: str, keep: list[str], with_offsets: bool = True) -> DataFrame:
    """The columns `keep`, and behind them n_tokens long, ids binary (4 bytes each) and offsets binary (start and end of
    each token in code points, 4 bytes each; null without with_offsets; a token inside a character has that character's
    place). Where one of these names is kept, the new column has underscores behind its name.

    Ids are those of the ranks, each match of the pattern by itself, without special tokens. A null text counts as empty:
    no tokens. Whole texts are encoded; every different match goes to the library once. Rows that repeat stay; an empty
    table gives an empty one.
    """
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json(path))
    rows = df.select(*keep, df[text_col].alias(free_name("_text_", *keep)))
    new = [free_name(x, *keep) for x in ENCODED.names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{x} {k}" for x, k in zip(new, ("long", "binary", "binary")))])

    def run(batches):
        words = _words(model.value, pattern, with_offsets)
        for b in batches:
            for part, texts in text_parts(b, b.num_columns - 1, TOGETHER):
                made = zip(*words.encode([t or "" for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, t in zip(made, ENCODED.types))], names=[*part.schema.names[:-1], *new])

    return short_batches(rows).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, and behind them decoded binary: the bytes of the packed ids, joined before anything reads them
    as characters, so that tokens that split a character join again; and text string, null where the bytes aren't UTF-8.
    Where one of these names is kept, the new column has underscores behind its name.

    Null ids give null, no ids an empty text; an id outside the vocabulary is an error. Rows that repeat stay; an empty
    table gives an empty one.
    """
    model = df.sparkSession.sparkContext.broadcast(_bytes_by_id(tokenizer_json(path)))
    held = ids_col in keep  # they travel once
    rows = df.select(*keep) if held else df.select(*keep, df[ids_col].alias(free_name("_ids_", *keep)))
    at = keep.index(ids_col) if held else len(keep)
    decoded = free_name("decoded", *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), f"{decoded} binary"])

    def run(batches):
        table = model.value
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                out = [None if x is None else b"".join(map(table.__getitem__, array("I", x))) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, decoded])

    made = short_batches(rows).mapInArrow(run, schema)
    return made.withColumn(free_name("text", *keep, decoded), F.try_validate_utf8(F.col(decoded).cast("string")))

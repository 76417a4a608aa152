"""Fast, exact encoding of whole texts with a public tokenizer.

The tokenizer of ``word_bpe_49k.json`` drops white space and never merges across
it, so a text's ids are its words' ids one after the other. Words recur far more
often than they are new: a batch's words are numbered with numpy, its distinct
words are looked up among those that the Python worker has encoded before, and
the tokenizers library encodes the others.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .words import split_words

#: Words that a worker keeps; those met later are encoded again when they recur.
CACHE_WORDS = 1_000_000
#: The pieces to which the tokenizer's own rules cut a text, and the line feed that ends each word here.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+|\n")
#: Words of Latin script below U+0250 are cut by _PIECES, all others by the library.
_PLAIN = regex.compile(r"[\x21-\x7E¡-ɏ]+")

_ENCODERS: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    """Path of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, str]:
    """The character that byte-level BPE uses for each byte: itself if visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Encodes texts to ids with the tokenizer of a file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_piece = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_piece[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.characters = _byte_characters() | {10: "\n"}
        self.index: dict[bytes, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text, straight from the library."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and how many each has."""
        texts = [w.decode() for w in words]
        plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        joined = unicodedata.normalize("NFC", "".join(t + "\n" for t, ok in zip(texts, plain, strict=True) if ok)).lower()
        number: dict[str, int] = {"\n": 0}
        pieces = np.array([number.setdefault(p, len(number)) for p in _PIECES.findall(joined)], np.int64)
        mapped = "\n".join(list(number)[1:]).encode().decode("latin-1").translate(self.characters)
        ids = np.asarray(self.merger.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.concatenate([[0, 0], np.flatnonzero(self.ends_piece[ids]) + 1]) if len(ids) else np.zeros(2, np.int64)
        if len(ends) != len(number) + 1:
            raise ValueError("the tokenizer's tokens do not mark where pieces end")
        sizes = np.diff(ends)
        sizes_here = sizes[pieces]
        out_ids = _gather(ids, ends[:-1][pieces], sizes_here)
        totals = np.concatenate([[0], np.cumsum(sizes_here)])[np.flatnonzero(pieces == 0)]
        lengths_plain = np.diff(totals, prepend=0)
        if all(plain):
            return out_ids, lengths_plain
        parts, split = [], iter(np.split(out_ids, totals[:-1]) if len(totals) else [])
        for text, ok in zip(texts, plain, strict=True):
            parts.append(next(split) if ok else self.whole(text))
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null is empty."""
        words = split_words(texts, lower=True)
        codes, first = words.numbered()
        distinct = words.at(first)
        at = np.fromiter((self.index.get(w, -1) for w in distinct), np.int64, len(distinct))
        starts, lengths, ids = self.starts, self.lengths, self.ids
        if (missing := np.flatnonzero(at < 0)).size:
            new = [distinct[i] for i in missing.tolist()]
            new_ids, new_lengths = self._encode_words(new)
            at[missing] = np.arange(len(lengths), len(lengths) + len(new))
            starts = np.concatenate([starts, len(ids) + np.cumsum(new_lengths) - new_lengths])
            lengths = np.concatenate([lengths, new_lengths])
            ids = np.concatenate([ids, new_ids])
            if len(lengths) <= CACHE_WORDS:
                base = len(self.index)
                self.index.update((w, base + k) for k, w in enumerate(new))
                self.starts, self.lengths, self.ids = starts, lengths, ids
        at = at[codes]
        per_word = lengths[at]
        total = np.concatenate([[0], np.cumsum(per_word)])
        return _gather(ids, starts[at], per_word), np.diff(total[words.bounds])


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: int, rows: int = 1_000, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows, and of ``size`` bytes of the texts in a column unless one row has more."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + size, side="right")) - 1))
        yield batch.slice(at, end - at)
        at = min(end, batch.num_rows)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each document's ids."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1

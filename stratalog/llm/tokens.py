"""Token ids of whole texts with a public tokenizer file; the code that runs inside tasks.

The tokenizer's normaliser composes characters and lower-cases, and its splitter cuts at white space and between letters
and punctuation, so the ids of a text are those of its white-space separated words in a row, and those of a word are
those of its stem and of its tail of punctuation. That holds for tokenizers of this kind only (``word_bpe_49k.json``). A
worker then encodes each distinct stem or tail once; Arrow numbers them, and numpy puts their ids in a row.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, with their ids, take about this many bytes at most; those met last stay.
REMEMBERED_BYTES = 16 << 20

#: Control strings of tokenizers begin like this; a text that holds one is encoded whole.
_CONTROL = b"<|"
#: Lead bytes of combining marks, and the capitals that compose with none of them where their small letters do: these
#: must be composed before they are lower-cased, so a text that holds both is encoded whole.
_MARKS, _CAPITALS = (b"\xcc", b"\xcd"), re.compile(rb"[HJTWY][\x80-\xff]")
_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Words of letters, in scripts up to Cyrillic; the one letter that becomes two characters when lower-cased is left out.
_LETTERS = f"^[{''.join(c for c in map(chr, range(0x530)) if c.isalpha() and c != 'İ')}]+$"
#: Pieces that are encoded as one text.
_TOGETHER = 256


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder: later tasks of a worker find what earlier ones learned."""
    return PieceEncoder(path)


def _whole(text: bytes) -> bool:
    return _CONTROL in text or (any(m in text for m in _MARKS) and _CAPITALS.search(text) is not None)


def _in_a_row(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``table`` with these starts and sizes, one after the other: at most as many ids as a batch has bytes."""
    before = np.cumsum(sizes) - sizes
    at = np.repeat((starts - before).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return table[at]


def _stems_and_tails(words: pa.StringArray) -> pa.StringArray:
    """Stem and tail of each word in turn. A tail is ASCII punctuation after a letter or digit, else empty."""
    _, offsets, data = words.buffers()
    borders = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
    start, end = borders[:-1], borders[1:]
    stems = pc.ascii_rtrim(words, _PUNCTUATION)
    stop = start + pc.binary_length(stems).to_numpy()
    tailed = np.flatnonzero((start < stop) & (stop < end))
    last = np.frombuffer(data or b"", np.uint8)[stop[tailed] - 1]
    fit = (last >= ord("a")) & (last <= ord("z")) | (last >= ord("0")) & (last <= ord("9"))
    other = tailed[last >= 0x80]
    fit[last >= 0x80] = pc.match_substring_regex(stems.take(pa.array(other)), _LETTERS).to_numpy(zero_copy_only=False)
    cut = end.copy()
    cut[tailed[fit]] = stop[tailed[fit]]
    both = np.append(np.column_stack([start, cut]).ravel(), borders[-1:]).astype(np.int32)
    return pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(both), data)


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model without the splitter's regular expressions, for words of letters, which are one split each.
        self.of_letters = Tokenizer(self.tokenizer.model)
        self.of_letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), bytewise])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        (self.border,) = self.tokenizer.encode("\0", add_special_tokens=False).ids  # in no piece without this character
        self.pieces = pa.array([], pa.string())
        self.table = np.empty(0, "<u4")
        self.starts, self.sizes, self.met = (np.empty(0, np.int64) for _ in range(3))
        self.batches = 0

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a table, and where those of each piece start and how many they are.

        Pieces are encoded in joint texts: one of letters ends at the next token that ends a word, others at a border."""
        letters = pc.match_substring_regex(pieces, _LETTERS).to_numpy(zero_copy_only=False)
        nul = pc.match_substring(pieces, "\0").to_numpy(zero_copy_only=False)
        none = np.empty(0, "<u4")
        tables, sizes, order = [], [], []
        for chosen, between in ((letters, " "), (~letters & ~nul, " \0 ")):
            at = np.flatnonzero(chosen)
            groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(at), _TOGETHER), len(at)), pa.int32()), pieces.take(pa.array(at)))
            joint = pc.binary_join(groups, between).to_pylist()
            if chosen is letters:
                ids = np.concatenate([none, *self._ids(self.of_letters, joint)])
                n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            else:
                ids = np.concatenate([none, *self._ids(self.tokenizer, [t + between for t in joint])])
                n = np.diff(np.flatnonzero(ids == self.border), prepend=-1) - 1
                ids = ids[ids != self.border]
            if len(n) != len(at):
                raise ValueError("this tokenizer doesn't split texts as the encoder takes it to")
            tables.append(ids)
            sizes.append(n)
            order.append(at)
        rest = self._ids(self.tokenizer, pieces.filter(pa.array(nul)).to_pylist())
        sizes.append(np.array([len(x) for x in rest], np.int64))
        order.append(np.flatnonzero(nul))
        size, start = np.empty((2, len(pieces)), np.int64)
        at, n = np.concatenate(order), np.concatenate(sizes)
        size[at], start[at] = n, np.cumsum(n) - n
        return np.concatenate([*tables, *rest]), start, size

    def _of_pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and where those of each piece start and how many they are. New pieces are learned."""
        known, self.batches = len(self.pieces), self.batches + 1
        numbered = pc.dictionary_encode(pa.concat_arrays([self.pieces, pieces]))
        at = numbered.indices.to_numpy()[known:]
        table, starts, sizes = self._encode(numbered.dictionary.slice(known))
        self.starts = np.concatenate([self.starts, starts + len(self.table)])
        self.table = np.concatenate([self.table, table])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.empty(len(sizes), np.int64)])
        self.met[at] = self.batches
        self.pieces = numbered.dictionary
        out = self.table, self.starts[at], self.sizes[at]
        took = 32 + pc.binary_length(self.pieces).to_numpy() + 4 * self.sizes
        if took.sum() > REMEMBERED_BYTES:
            order = np.argsort(-self.met, kind="stable")
            keep = np.sort(order[np.cumsum(took[order]) <= REMEMBERED_BYTES // 2])
            self.pieces = self.pieces.take(pa.array(keep))
            self.table = _in_a_row(self.table, self.starts[keep], self.sizes[keep])
            self.sizes, self.met = self.sizes[keep], self.met[keep]
            self.starts = np.cumsum(self.sizes) - self.sizes
        return out

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        whole = [t is not None and _whole(t) for t in texts]
        plain = pa.array([b"" if w or t is None else t for w, t in zip(whole, texts, strict=True)], pa.string())
        words = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        numbered = pc.dictionary_encode(words.flatten())
        table, starts, sizes = self._of_pieces(_stems_and_tails(numbered.dictionary))
        table, sizes = _in_a_row(table, starts, sizes), sizes.reshape(-1, 2).sum(axis=1)  # of words
        at = numbered.indices.to_numpy()
        starts, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ids = _in_a_row(table, starts, sizes).tobytes()
        stops = np.concatenate([[0], np.cumsum(4 * sizes)])[words.offsets.to_numpy()].tolist()
        out = [ids[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
        for i in compress(range(len(texts)), whole):
            out[i] = self._ids(self.tokenizer, [texts[i].decode()])[0].tobytes()
        return out

"""Token ids of whole texts, with a bounded cache of words."""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids by a lower-casing tokenizer whose tokens never span a space or line feed.

    Such a tokenizer gives a text's ids as those of its words in order, so the distinct words of
    several texts are looked up once and their ids copied to where the words stand. A word of Latin
    letters and then ASCII marks consists of these two pieces, which are words themselves and are
    cached in its place; new pieces are encoded together, past the normaliser and the splitting that
    cannot change them, and told apart by the end-of-word mark of their last id. Texts for which
    lower case or normal form could depend on the context are encoded word by word.

    The cache has two generations: when the younger is full it replaces the elder, so words
    that keep coming stay and those that came once go.
    """

    CACHED = 120_000  # words of a generation: some 25 MB, which an idle worker goes on holding
    CACHED_LENGTH = 48
    TOGETHER = 1 << 20  # characters of the texts that are looked up together
    AT_ONCE = 1 << 17  # words whose ids are copied at once
    END_MARK = "</w>"
    MARKS = r"!-/:-@\[-`{-~"
    LETTERS = "a-zß-öø-ÿ"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(self.END_MARK)]] = True
        self.simple = re.compile(f"([{self.LETTERS}]+)([{self.MARKS}]*)")
        self.bare = self._bare()
        self.words: dict[str, bytes] = {"": b""}
        self.elder: dict[str, bytes] = {}

    def _bare(self):
        """The model with pieces cut at spaces only, or the whole tokenizer if that gives other ids."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer(self.tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        letters, marks = (re.findall(f"[{x}]", "".join(map(chr, range(256)))) for x in (self.LETTERS, self.MARKS))
        probe = " ".join([*letters, *marks, *map("".join, zip(letters, letters[1:])), "".join(letters), "".join(marks)])
        same = bare.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids
        return bare if same else self.tokenizer

    def _singly(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, dtype=self.dtype).tobytes() for w, e in zip(words, found, strict=True)}

    def _together(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for start in range(0, len(pieces), 4000):
            part = pieces[start : start + 4000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):  # a vocabulary without end-of-word ids
                out |= self._singly(part)
                continue
            raw, size, last = ids.tobytes(), self.dtype.itemsize, 0
            for piece, cut in zip(part, cuts, strict=True):
                out[piece] = raw[last * size : cut * size]
                last = cut
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that the younger generation lacks; keeps the pieces and the words that have none."""
        fullmatch, cached, elder = self.simple.fullmatch, self.words, self.elder
        known, new, other = {}, set(), []
        marked: dict[str, tuple[str, str]] = {}
        for w in words:
            if w in elder:
                known[w] = elder[w]
            elif (m := fullmatch(w)) is None:
                other.append(w)
            elif m[2]:
                marked[w] = m.groups()
            else:
                new.add(w)
        for p in {p for both in marked.values() for p in both}:
            if p in elder:
                known[p] = elder[p]
            elif p not in cached:
                new.add(p)
        known |= self._together(list(new))
        if other:
            known |= self._singly(other)
        of = lambda p: known[p] if p in known else cached[p]
        out = known | {w: of(a) + of(b) for w, (a, b) in marked.items()}
        self._keep(known)
        return out

    def _keep(self, coded: dict[str, bytes]) -> None:
        self.words.update((w, x) for w, x in coded.items() if len(w) <= self.CACHED_LENGTH)
        if len(self.words) > self.CACHED:
            self.elder, self.words = self.words, {"": b""}

    def _context(self, text: str, lower: str) -> bool:
        """Whether a word's ids could depend on its neighbours."""
        normal = unicodedata.is_normalized
        return "Σ" in text or "<|" in text or not (normal("NFC", text) and normal("NFC", lower))

    def _alone(self, text: str) -> np.ndarray:
        """The ids of a text whose words are not to be cached."""
        words = [w for w in text.replace("\n", " ").split(" ") if w]
        coded = self._singly(list(dict.fromkeys(words)))
        return np.frombuffer(b"".join([coded[w] for w in words]), dtype=self.dtype)

    def _coded(self, words: list[str]) -> list[bytes]:
        found = list(map(self.words.get, words))
        missing = [w for w, x in zip(words, found, strict=True) if x is None]
        if missing:
            new = self._learn(missing)
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return found

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts: their distinct words are looked up once and copied to where they stand."""
        alone, lowered = {}, []
        for n, text in enumerate(texts):
            lower = text.lower()
            if self._context(text, lower):
                alone[n], lower = self._alone(text), ""
            lowered.append(lower.replace("\n", " "))
        listed = pc.split_pattern(pa.array(lowered, pa.large_string()), " ")
        words = listed.flatten().dictionary_encode()
        coded = self._coded(words.dictionary.to_numpy(zero_copy_only=False).tolist())  # much faster than to_pylist
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(coded), dtype=self.dtype)
        places = words.indices.to_numpy()
        parts, ends = [flat[:0]], np.zeros(len(places) + 1, dtype=np.int64)
        np.cumsum(sizes[places], out=ends[1:])
        for first in range(0, len(places), self.AT_ONCE):
            place = places[first : first + self.AT_ONCE]
            before = ends[first : first + len(place)]
            shift = np.repeat(starts[place] - before, sizes[place])
            parts.append(flat[shift + np.arange(before[0], before[0] + len(shift))])
        ids, cuts = np.concatenate(parts), ends[listed.offsets.to_numpy()].tolist()
        return [alone[n] if n in alone else ids[a:b] for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= self.TOGETHER:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def ids(self, text: str | None) -> np.ndarray:
        return self._some([text or ""])[0]

    def documents(self, texts: Iterable[str | None], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text and then ``end_id``."""
        end = np.array([end_id], dtype=self.dtype)
        return (np.concatenate((ids, end)) for ids in self.batch(texts))


def shared_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, with what its earlier tasks have cached."""
    held = sys.modules.setdefault("_word_tokenizers", types.ModuleType("_word_tokenizers")).__dict__
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())

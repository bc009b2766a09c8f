"""Token ids of whole texts, as the tokenizers library gives them, by way of their words.

Where a tokenizer folds white space and never joins two words, a text's ids are those of
its words in order (`words_apart` looks at the tokenizer's own description). Each word is
then encoded once while it stays in a bounded cache of the worker. Any other tokenizer
encodes whole texts.
"""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import pyarrow as pa

from treeline.llm.words import buffer, release, spans_hash, words

#: Words that a worker remembers, some 30 bytes each.
CACHE_WORDS = 1_000_000
#: Words that it remembers between tasks, whatever runs there next.
RESTING_WORDS = 200_000
#: Parts of words in one string for the tokenizer.
PARTS = 4096

# Kinds of bytes in plain words: letters, digits, signs, and what no plain word has. Letters are
# those of ASCII and U+00C0 to U+00FF but the two signs among them; the apostrophe is not plain.
_LETTER, _DIGIT, _SIGN, _ODD = 0, 1, 2, 3
_KIND = np.full(256, _ODD, dtype=np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _ODD


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for what is dear to build."""
    name = "treeline_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return vars(sys.modules[name])


def words_apart(path: str) -> bool:
    """Whether a tokenizer file says that white space only separates."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    norm, pre = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [])
    cuts = pre.get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        and cuts[0]["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and told["post_processor"] is None
        and told["model"]["type"] == "BPE" and told["model"]["end_of_word_suffix"] == "</w>"
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]))


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all positions of the ranges in turn, where each range begins among them)."""
    before = np.cumsum(size) - size
    total = int(size.sum())
    return np.repeat(begin - before, size) + np.arange(total), before


class Encoder:
    """Ids of texts by one tokenizer file, without special tokens, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.normalizers import Sequence

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.apart = words_apart(path)
        # Words by ascending hash, and where the ids of each stand.
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        if self.apart:
            self.parts = Tokenizer.from_file(path)
            self.parts.no_truncation()
            self.parts.no_padding()
            self.parts.normalizer = Sequence([])
            self.parts.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split(" ", "removed"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            size = self.whole.get_vocab_size()
            self.ends = np.zeros(size, dtype=bool)
            for token, i in self.whole.get_vocab().items():
                self.ends[i] = token.endswith("</w>")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker."""
        cache = worker_cache()
        if ("encoder", path) not in cache:
            cache["encoder", path] = cls(path)
        return cache["encoder", path]

    def rest(self) -> None:
        """Between tasks only some of the words stay."""
        self._keep(RESTING_WORDS)
        release()

    def _keep(self, most: int) -> None:
        """At most so many words; hashes are as good as random, so the smallest of them stay."""
        if len(self.keys) > most:
            self.keys, size = self.keys[:most], self.size[:most]
            index, self.begin = _ranges(self.begin[:most], size)
            self.size, self.flat = size, self.flat[index]

    def by_library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _parts_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of lower-case parts of plain words."""
        index, before = _ranges(starts, ends - starts)
        past = before + (ends - starts)
        # One space behind every part, and one string for some thousands of them.
        text = np.full(len(index) + len(starts), 0x20, np.uint8)
        text[index - np.repeat(starts - before, ends - starts) + np.repeat(np.arange(len(starts)), ends - starts)] = data[index]
        edge = past + np.arange(1, len(starts) + 1)
        cuts = list(range(0, len(starts), PARTS))
        bounds = [0, *edge[[c - 1 for c in cuts[1:]]].tolist(), len(text)]
        strings = [text[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])]
        found, sizes = [], []
        for c, string, e in zip(cuts, strings, self.parts.encode_batch_fast(strings, add_special_tokens=False)):
            some = string.split()
            ids = np.array(e.ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(some):
                each = self.by_library(some)
                ids = np.concatenate(each)
                last = np.cumsum([len(x) for x in each])
            found.append(ids)
            sizes.append(np.diff(last, prepend=0))
        return np.concatenate(found), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds distinct words that are not known."""
        index, begin = _ranges(starts, ends - starts)
        text, size = data[index], ends - starts
        of = np.repeat(np.arange(len(starts)), size)
        kind = _KIND[text]
        after_c3 = np.zeros(len(text), bool)
        after_c3[1:] = (text[:-1] == 0xC3) & (of[1:] == of[:-1])
        # A byte from 0x80 on stands behind 0xC3, which two signs do as well; "<|" begins a special token.
        odd = (kind == _ODD) | ((text >= 0x80) & (text < 0xC0) & ~after_c3)
        odd |= after_c3 & ((text == 0x97) | (text == 0xB7))
        odd[1:] |= (text[1:] == 0x7C) & (text[:-1] == 0x3C)
        plain = np.ones(len(starts), bool)
        plain[of[odd]] = False

        sizes = np.zeros(len(starts), np.int64)
        found: list[np.ndarray] = []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        mine = plain[of]
        if mine.any():
            low = text[mine]
            upper = ((low >= 0x41) & (low <= 0x5A)) | (after_c3[mine] & (low >= 0x80) & (low <= 0x9E))
            low[upper] += 32
            own, word = kind[mine], of[mine]
            turn = np.ones(len(low), bool)
            turn[1:] = (own[1:] != own[:-1]) | (own[1:] == _DIGIT) | (word[1:] != word[:-1])
            first = np.flatnonzero(turn)
            past = np.append(first[1:], len(low))
            _, one, place = np.unique(spans_hash(low, first, past), return_index=True, return_inverse=True)
            ids, n = self._parts_ids(low, first[one], past[one])
            at, _ = _ranges((np.cumsum(n) - n)[place], n[place])
            found.append(ids[at])
            sizes += np.bincount(word[first], weights=n[place], minlength=len(starts)).astype(np.int64)
        other = np.flatnonzero(~plain)
        for i in range(0, len(other), PARTS):
            some = other[i: i + PARTS]
            each = self.by_library([data[a:b].tobytes().decode() for a, b in zip(starts[some], ends[some])])
            found += each
            sizes[some] = [len(x) for x in each]
        keys = np.concatenate([self.keys, hashes[order]])
        begin = np.cumsum(sizes[order]) - sizes[order] + len(self.flat)
        begin, size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes[order]])
        self.flat = np.concatenate([self.flat, *found]).astype(np.uint32)
        rank = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size = keys[rank], begin[rank], size[rank]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids before each text)."""
        if not self.apart:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
            each = self.by_library(texts)
            return (np.concatenate([*each, np.zeros(0, np.uint32)]).astype(np.uint32),
                    np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64))
        starts, ends, counts = words(data, offsets)
        own, first, place = np.unique(
            spans_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._keep(CACHE_WORDS // 2)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        if not known.all():
            new = first[~known]
            self._learn(own[~known], data, starts[new], ends[new])
            at = np.searchsorted(self.keys, own)
        at = at[place]
        index, before = _ranges(self.begin[at], self.size[at])
        return self.flat[index], np.append(before, len(index))[counts]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(*buffer(texts))

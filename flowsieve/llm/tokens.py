"""Token ids of whole texts from public vocabulary files, inside a task."""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from flowsieve.llm.text import WordHasher, text_bytes

# Distinct words whose ids a task remembers, some 40 MB; beyond it the memory starts anew.
REMEMBERED = 500_000
# Words that are encoded as one text.
TOGETHER = 50

_TRAILING = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
# lower-case letters that every normal form keeps
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NORMALIZERS, _SEPARATE = {"NFC", "Replace", "Lowercase"}, r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_word_tokenizer(path: str) -> None:
    """Raise ValueError unless a `tokenizers` file does what `WordTokenizer` relies on."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    steps = (parts.get("normalizer") or {}).get("normalizers") or [parts.get("normalizer") or {}]
    kinds = {step.get("type") for step in steps}
    spaces = all(step["pattern"].get("Regex") == r"\s+" and step["content"] == " " for step in steps if step.get("type") == "Replace")
    before = parts.get("pre_tokenizer") or {}
    split = (before.get("pretokenizers") or [before])[0]
    separate = (split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
                and split["pattern"].get("Regex", "").endswith(_SEPARATE))
    if "Lowercase" not in kinds or not kinds <= _NORMALIZERS or not spaces or not separate:
        raise ValueError(f"{path} does not lower-case, drop white space and part letters from punctuation: its words cannot be encoded one by one")


def _parts_from(last: str) -> bool:
    """Whether punctuation behind this character is a word of its own: if a letter or digit is left when it is normalised."""
    return last.isalnum() and (last.isascii() or unicodedata.normalize("NFC", last).lower()[-1].isalnum())


class WordTokenizer:
    """Ids of a `tokenizers` file that drops white space, for many texts with few distinct words.

    Such a tokenizer never joins what white space separates, nor letters and digits and the ASCII
    punctuation that follows them, and it lower-cases. So each distinct word is encoded once, with A-Z
    in lower case and without its trailing punctuation, and texts are put together from the ids of
    their words, which are told apart by 64-bit hashes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_word_tokenizer(path)
        self._tokenizer = Tokenizer.from_file(path)
        self._hasher = WordHasher()
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[int, int] = {}
        self._parts: dict[str, bytes] = {"": b""}
        self._ids, self._ends = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    @staticmethod
    def _split(words: list[bytes]) -> list[tuple[str, str]]:
        """Each word without, and with nothing but, the punctuation behind its last letter or digit."""
        listed = b"\n".join(words).decode().split("\n")
        stems = [w.rstrip(_TRAILING) for w in listed]
        return [(s, w[len(s) :]) if len(s) < len(w) and s and _parts_from(s[-1]) else (w, "") for w, s in zip(listed, stems, strict=True)]

    def _encode_parts(self, parts: list[str]) -> None:
        plain = [p for p in parts if p.isalpha() and (p.isascii() or _PLAIN.fullmatch(p))]
        lines = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        # the fast encoder does not say which word an id is from
        for line, found in zip(lines, self._tokenizer.encode_batch([" ".join(line) for line in lines], add_special_tokens=False), strict=True):
            ids, words = np.array(found.ids, dtype="<u4"), np.array(found.word_ids)
            cuts = [0, *(np.flatnonzero(words[1:] != words[:-1]) + 1).tolist(), len(ids)]
            for part, lo, hi in zip(line, cuts[:-1], cuts[1:], strict=True):
                self._parts[part] = ids[lo:hi].tobytes()
        others = [p for p in parts if p not in self._parts]
        for part, found in zip(others, self._tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self._parts[part] = array("I", found.ids).tobytes()

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        split = self._split(words)
        self._encode_parts(list({p for pair in split for p in pair}.difference(self._parts)))
        parts = self._parts
        found = [parts[stem] + parts[rest] for stem, rest in split]
        self._numbers.update(zip(hashes, range(len(self._ends) - 1, len(self._ends) - 1 + len(found)), strict=True))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])
        self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(found), dtype="<u4")])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        data, bounds = text_bytes(pa.array(texts, pa.large_string()))
        starts, hashes = self._hasher.located(data, bounds)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._numbers) > REMEMBERED:
            self._forget()
        keys = distinct.tolist()
        new = [i for i, key in enumerate(keys) if key not in self._numbers]
        if new:
            at = starts[first[new]]
            spaces = np.append(np.flatnonzero(self._hasher.is_space[data]), len(data))
            ends = np.minimum(spaces[np.searchsorted(spaces, at)], bounds[np.searchsorted(bounds, at, side="right")])
            lower = data.tobytes().translate(_LOWER)
            self._learn([keys[i] for i in new], [lower[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)])
        numbers = np.fromiter(map(self._numbers.__getitem__, keys), dtype=np.int64, count=len(keys))[place]
        begins, sizes = self._ends[numbers], self._ends[numbers + 1] - self._ends[numbers]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._ids[np.repeat(begins - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, bounds)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class ByteTokenizer:
    """Ids of a `tiktoken` rank file that covers every byte, so that ids decode to the same text."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(ranks.values()) + 1
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the pattern never joins what stands before a space to the word behind it
        self._border = re.compile(r"(?<=\S)(?= \S)")

    def encode(self, text: str) -> np.ndarray:
        parts, start = [], 0
        while len(text) - start > 1 << 20:  # very long texts in pieces that end between words
            found = self._border.search(text, start + (1 << 19))
            if not found:
                break
            parts.append(self._encoding.encode_ordinary(text[start : found.start()]))
            start = found.start()
        parts.append(self._encoding.encode_ordinary(text[start:]))
        return np.concatenate([np.array(p, dtype=np.uint32) for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        return self._encoding.decode(ids.tolist())

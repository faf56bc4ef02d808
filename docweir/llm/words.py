"""Word-wise encoding with a byte-level BPE vocabulary: every distinct word is encoded once per worker and looked up after that."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, compress, count, repeat
from operator import not_

import numpy as np

#: Distinct words a worker remembers. When there are more, it forgets the rarer half, so memory does not grow with the input.
REMEMBERED = 800_000
#: Characters of words that it remembers, a word on average; words that are forgotten first as they seldom come again.
WIDTH, LONG = 40, 256
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of whole texts. `encode_words` gives the ids of each of a list of words, `encode_text` those of an unusual text.

    A text in which single spaces and line feeds stand between words is cut before each space and around each line feed. There
    the pre-tokenizer of byte-level BPE cuts too, and its other cuts only depend on the characters within such a piece, so
    the ids of a text are those of its pieces in turn. Any other text (runs of white space, other white space, white space at
    an end, or a special token's string) goes to `encode_text` as a whole.

    Words are known by a key, in the order of their numbers: the word itself if a space goes before it, and a line feed with the word if
    none does. The line feed itself is number 0.
    """

    def __init__(self, encode_words: Callable[[list[str]], Sequence[Sequence[int]]],
                 encode_text: Callable[[str], Sequence[int]], special: Sequence[str] = (), remembered: int = REMEMBERED):
        self.encode_words, self.encode_text, self.special, self.remembered = encode_words, encode_text, special, remembered
        self.known: dict[str, int] = {}
        self.chars = 0
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.size, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self._learn(["\n"])

    def _ids(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words on end, and where each word ends after the first 0."""
        size = self.size[of]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.at[of] - ends[:-1], size) + np.arange(ends[-1])], ends

    def _add(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(need, np.uint32)])
        self.pool[self.used : need] = ids
        self.at[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used = need

    def _learn(self, keys: list[str]) -> None:
        """Takes in new keys. A word and the punctuation at its end are looked up apart: the pre-tokenizer cuts between them as well."""
        known = self.known
        bases = [k.rstrip(PUNCTUATION) for k in keys]
        cut = [len(b) < len(k) and b[-1:].isalnum() for k, b in zip(keys, bases, strict=True)]
        tails = ["\n" + k[len(b) :] for k, b, c in zip(keys, bases, cut, strict=True) if c]
        parts = list(compress(bases, cut))
        whole = [k for k in dict.fromkeys([*compress(keys, map(not_, cut)), *parts, *tails]) if k not in known]
        joined = list(compress(keys, cut))
        first = len(known)
        known.update(zip(chain(whole, joined), count(first)))
        self.chars += sum(map(len, chain(whole, joined)))
        if len(known) > len(self.at):
            self.at, self.size, self.hits = (np.concatenate([x, np.zeros(len(known), np.int64)]) for x in (self.at, self.size, self.hits))
        if whole:
            found = self.encode_words(["\n" if k == "\n" else k[1:] if k[0] == "\n" else " " + k for k in whole])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._add(first + np.arange(len(whole)), np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)
        if joined:
            two = np.empty(2 * len(joined), np.int64)
            two[::2] = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
            two[1::2] = np.fromiter(map(known.__getitem__, tails), np.int64, len(tails))
            ids, ends = self._ids(two)
            self._add(first + len(whole) + np.arange(len(joined)), ids, np.diff(ends[::2]))

    def _forget(self) -> None:
        """Keeps the half that was met most often, without very long words, in the order it has."""
        n = len(self.known)
        long = np.fromiter(map(len, self.known), np.int64, n) > LONG
        keep = np.zeros(n, bool)
        half = min(n - 1, self.remembered // 2)
        keep[np.argpartition(np.where(long, 1, -self.hits[:n]), half)[:half]] = True
        keep &= ~long
        keep[0] = True
        order = np.nonzero(keep)[0]
        ids, ends = self._ids(order)
        hits = self.hits[order]
        self.known = dict(zip(compress(self.known, keep.tolist()), count()))
        self.chars = sum(map(len, self.known))
        self.used, self.pool = 0, np.empty(2 * len(ids) + 1, np.uint32)
        self.hits[:] = 0
        self.hits[: len(order)] = hits
        self._add(np.arange(len(order)), ids, np.diff(ends))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, as unsigned 32-bit integers, and how many each text has. Null: no ids."""
        if len(self.known) > self.remembered or self.chars > WIDTH * self.remembered:
            self._forget()
        found: list[np.ndarray] = [np.zeros(0, np.int64)]
        new: list[str] = []
        odd: dict[int, Sequence[int]] = {}
        sizes = np.zeros(len(texts), np.int64)
        get, none = self.known.get, repeat(-1)
        for i, text in enumerate(texts):
            if not text:
                continue
            words, feeds = text.split(), text.count("\n")
            gaps = feeds + text.count(" ")
            if (len(words) != gaps + 1 or len("".join(words)) != len(text) - gaps  # other white space, or runs of it
                    or any(s in text for s in self.special)):
                odd[i] = self.encode_text(text)
                continue
            if feeds:
                at, keys = 0, []
                for line in text.split("\n"):
                    if at:
                        keys.append("\n")
                    end = at + 1 + line.count(" ")
                    words[at] = "\n" + words[at]
                    keys += words[at:end]
                    at = end
                words = keys
            else:
                words[0] = "\n" + words[0]
            # Looked up text by text, while its words are still in the processor's cache.
            numbers = np.fromiter(map(get, words, none), np.int64, len(words))
            unseen = np.flatnonzero(numbers < 0)
            if len(unseen):
                new += map(words.__getitem__, unseen.tolist())
            found.append(numbers)
            sizes[i] = len(words)
        of = np.concatenate(found)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        if new:
            self._learn(list(dict.fromkeys(new)))
            of[of < 0] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.hits[: len(self.known)] += np.bincount(of, minlength=len(self.known))
        ids, ends = self._ids(of)
        lengths = np.diff(ends[upto])
        if odd:
            parts = np.split(ids, ends[upto][1:-1])
            for i, x in odd.items():
                parts[i] = np.array(x, np.uint32)
                lengths[i] = len(x)
            ids = np.concatenate(parts).astype(np.uint32)
        return ids, lengths


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


_ENCODERS: dict[str, WordEncoder] = {}


def library_encoder(path: str) -> WordEncoder:
    """The tokenizers library's encoder for a byte-level BPE file, one per worker process."""
    if path not in _ENCODERS:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        whole = lambda text: tok.encode(text, add_special_tokens=False).ids
        pre = spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))
        special = [x["content"] for x in spec.get("added_tokens", [])]
        letters = {b: c for c, b in byte_letters().items()}
        tokenize, feed = tok.model.tokenize, letters[10]

        def each(words: list[str]) -> list[list[int]]:
            """A word of letters is one piece for the model; any other goes through the library's pre-tokenizer."""
            one = [w.removeprefix(" ").isalpha() for w in words]
            plain = "\n".join(w for w, x in zip(words, one, strict=True) if x).encode().decode("latin-1").translate(letters).split(feed)
            mixed = iter(tok.encode_batch([w for w, x in zip(words, one, strict=True) if not x], add_special_tokens=False))
            pieces = iter(plain)
            return [[t.id for t in tokenize(next(pieces))] if x else next(mixed).ids for x in one]

        # "" is in every text: a tokenizer of another make encodes each text as a whole.
        _ENCODERS[path] = WordEncoder(each, whole, special if plain else [""])
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

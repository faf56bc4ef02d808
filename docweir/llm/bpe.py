"""Byte-level BPE by speculation: greedy longest match, a vectorised check of adjacent pairs, exact merging where it fails."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docweir.session import spread

from .common import pick, text_slices
from .words import WordEncoder, byte_letters, tokenizer_path

#: The cuts of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = np.int64(1) << 40
_PLACE = (1 << 40) - 1


class Bpe:
    """A byte-level BPE vocabulary of the tokenizers library, encoded and decoded without that library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or model.get("dropout") or spec.get("post_processor")):
            raise ValueError("only plain byte-level BPE files are encoded here")
        letters = byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {raw(w): i for w, i in model["vocab"].items() if w not in self.special}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for w, i in self.special.items():
            self.bytes[i] = w.encode()
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest: dict[bytes, int] = {}  # first two bytes -> longest token that starts with them
        for b in self.ids:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self._tables(size)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def _tables(self, size: int) -> None:
        """For each token the chain of tokens at its left and its right edge, bytes first, with the rank that makes each.

        `whole[t]`: exact merging of t's bytes gives t, and ranks rise along both chains, as the check of pairs needs.
        """
        made = {}  # token -> the merge that makes it
        for pair, (rank, token) in self.merges.items():
            if token not in made or rank < made[token][0]:
                made[token] = rank, pair
        chains: dict[int, tuple[list, list]] = {}
        for t in [*self.byte_ids, *(t for t, _ in sorted(made.items(), key=lambda x: x[1][0]))]:
            if t in chains:
                continue
            if t in made and made[t][1][0] in chains and made[t][1][1] in chains:
                rank, (a, b) = made[t]
                chains[t] = [*chains[a][0], (t, rank)], [*chains[b][1], (t, rank)]
            elif t not in made:
                chains[t] = [(t, -1)], [(t, -1)]
        self.whole = np.zeros(size, bool)
        for t, (left, right) in chains.items():
            rising = all(x[i][1] < x[i + 1][1] for x in (left, right) for i in range(len(x) - 1))
            self.whole[t] = rising and self.merge(self.bytes[t]) == [t]
        depth = max(len(x) for c in chains.values() for x in c) + 1
        self.edge = np.full((2, size, depth), -1, np.int64)
        self.born = np.full((2, size, depth), _NEVER)
        for t, c in chains.items():
            for side in (0, 1):
                for i, (token, rank) in enumerate(c[side]):
                    self.edge[side, t, i], self.born[side, t, i] = token, rank
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()])[order]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones.

        Pairs wait in a heap by rank and place; tokens are linked to their neighbours, so a word of n bytes takes n log n steps. An
        entry whose pair has changed since is passed over.
        """
        ids, n, get = [self.byte_ids[b] for b in word], len(word), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [found[0] << 40 | i for i in range(n - 1) if (found := get((ids[i], ids[i + 1])))]
        heapify(waiting)
        while waiting:
            entry = heappop(waiting)
            i = entry & _PLACE
            j = after[i]
            if ids[i] < 0 or j == n:
                continue
            found = get((ids[i], ids[j]))
            if found is None or found[0] != entry >> 40:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if found := get((ids[i], ids[j])):
                    heappush(waiting, found[0] << 40 | i)
            if (h := before[i]) >= 0 and (found := get((ids[h], ids[i]))):
                heappush(waiting, found[0] << 40 | h)
        return [t for t in ids if t >= 0]

    def speculate(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, ids = [], 0, self.ids
        while at < len(word):
            for n in range(min(self.longest.get(word[at : at + 2], 1), len(word) - at), 0, -1):
                t = ids.get(word[at : at + n])
                if t is not None:
                    out.append(t)
                    at += n
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging of the bytes of each pair of tokens gives back that pair.

        Both edges of the seam grow along their chains in order of rank. The pair fails if, before either grows further, a merge
        across the seam has its turn: it is further left than the right edge's next merge, so it goes first on a tie with
        that one, and last on a tie with the left edge's.
        """
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        good, left = self.whole[a] & self.whole[b], np.arange(len(a))
        while len(left):
            la, lb, li, lj = a[left], b[left], i[left], j[left]
            key = self.edge[1, la, li] << 32 | self.edge[0, lb, lj]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = np.where(self.keys[at] == key, self.ranks[at], _NEVER)
            next_a, next_b = self.born[1, la, li + 1], self.born[0, lb, lj + 1]
            good[left] &= ~((across < next_a) & (across <= next_b) & (across < _NEVER))
            grow = next_a <= next_b
            i[left] += grow
            j[left] += ~grow
            left = left[good[left] & ((next_a < _NEVER) | (next_b < _NEVER))]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a word may hold several pieces of the pre-tokenizer, which are encoded apart."""
        pieces, counts = [], []
        for w in words:
            found = self.words.findall(w)
            pieces += [x.encode() for x in found]
            counts.append(len(found))
        guess = [self.speculate(p) for p in pieces]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(pieces)), sizes)
        fails = np.zeros(len(pieces), bool)
        fails[of[~self.whole[flat]]] = True
        seam = np.nonzero(of[1:] == of[:-1])[0]
        pairs, back = np.unique(flat[seam] << 32 | flat[seam + 1], return_inverse=True)
        fails[of[seam[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]]] = True
        for i in np.nonzero(fails)[0]:
            guess[i] = self.merge(pieces[i])
        out, at = [], 0
        for n in counts:
            out.append([t for g in guess[at : at + n] for t in g])
            at += n
        return out

    def encode_text(self, text: str) -> list[int]:
        """Any text; strings of special tokens become those."""
        out: list[int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += [t for ids in self.encode_words(self.words.findall(part)) for t in ids]
        return out

    def decode_bytes(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all documents on end, and where each ends after the first 0."""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])]
        return data.tobytes(), ends[np.concatenate([[0], np.cumsum(lengths)])]

    def decode(self, ids: Sequence[int]) -> str:
        data, _ = self.decode_bytes(np.array(ids, np.int64), np.array([len(ids)]))
        return data.decode("utf-8", "replace")


_BPES: dict[str, tuple[Bpe, WordEncoder]] = {}


def own_encoder(path: str) -> tuple[Bpe, WordEncoder]:
    if path not in _BPES:
        bpe = Bpe(path)
        _BPES[path] = bpe, WordEncoder(bpe.encode_words, bpe.encode_text, list(bpe.special))
    return _BPES[path]


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes its ids: doc_id, n_tokens, ids (array of int), decoded; as SHA-256 digests
    (ids_sha256 of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the text in UTF-8) if so asked.

    A map over the rows, without a shuffle; each worker remembers a bounded number of words. Null text counts as empty, which
    has no ids and decodes to an empty string; null and repeated ids are passed through; an empty table gives no rows; other
    columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests
                          else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = own_encoder(tokenizer)
        for of, texts in text_slices(batches):
            ids, n = encoder.encode(texts)
            data, cuts = bpe.decode_bytes(ids, n)
            ends = np.concatenate([[0], np.cumsum(n)])
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
            if digests:
                raw = memoryview(ids.astype("<u4").tobytes())
                made = [[hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:])],
                        [hashlib.sha256(t.encode()).hexdigest() for t in texts]]
            else:
                made = [pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.view(np.int32))), texts]
            columns = [pa.array(of, pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, f.type) for x, f in zip(made, list(schema)[2:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    types = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = pick(docs, **{id_col: "bigint", text_col: "string"})
    return rows.mapInArrow(run, f"doc_id bigint, n_tokens bigint, {types}")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), tokenizer_path(), digests=True)

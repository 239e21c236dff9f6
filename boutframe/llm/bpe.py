"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every leaf of the tree holds the rank of one adjacent pair of symbols (with its position), every inner node the least of
its children, so the root always names the leftmost pair of the lowest rank. A merge changes at most three leaves and
each change climbs one path: n symbols take O(n log n), also for a single word of a million letters. The vocabulary file
is a parameter (the JSON of the tokenizers library); special tokens' literal strings in a text become their single id,
as that library does by default.

Texts are cut before spaces where no token can go over the cut. The different pieces of about ``GROUP_CHARS`` characters of
texts are told apart by Arrow's dictionary, encoded once, and the texts' ids are gathered from them by number. Pieces of up
to ``KEPT_CHARS`` characters are kept for later texts until they take ``CACHE_BYTES``; then all are forgotten. That changes
no result.

Cases: a null text counts as empty and has no tokens (the digests are those of the empty string); a null doc_id passes
through; repeated rows are encoded each; whole texts are encoded, however long; empty tables and empty partitions give no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.session import ship

CACHE_BYTES = 32 << 20
KEPT_CHARS = 64
GROUP_CHARS = 2_000_000
#: The split that byte-level BPE files of this kind assume; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NO_PAIR = 1 << 62
_NO_LEAF = (1 << 31) - 1
_LATIN_END = "\u0250"  # below it, letters are the same in every version of Unicode in use
_MARK = "\0"  # before a piece that doesn't follow a space; pieces that do come without their space
_CUT = regex.compile(r"(?<=\S) | (?=\S)")  # spaces before which every token ends
_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"{_WHITE} (?:{_WHITE}|$)|\\x{{00}}"  # texts that need more care than a cut before each space
_STOPS = frozenset(".,;:!?")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Vocabulary character -> byte: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token ids, their bytes and the merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, letters = data["model"], byte_alphabet()
        if data.get("normalizer") or data["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        ids = model["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.byte_ids = [0] * 256
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.special = {}
        for token in data.get("added_tokens", []):
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"{path}: unsupported added token {token['content']!r}")
            self.special[token["content"]] = token["id"]
            self.bytes[token["id"]] = token["content"].encode()
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None


def merge_symbols(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge adjacent symbols, leftmost lowest rank first, until no pair can merge."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree, made = [_NO_PAIR] * (2 * size), {}
    for i in range(n - 1):
        if found := pairs.get((ids[i], ids[i + 1])):
            tree[size + i] = found[0] << 32 | i
            made[found[0]] = found[1]
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    symbols, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != _NO_PAIR:
        i = top & 0xFFFFFFFF
        j = after[i]
        k = after[j]
        symbols[i], after[i] = made[top >> 32], k
        right = left = None
        if k < n:
            before[k] = i
            if right := pairs.get((symbols[i], symbols[k])):
                made[right[0]] = right[1]
        h = before[i]
        if h >= 0 and (left := pairs.get((symbols[h], symbols[i]))):
            made[left[0]] = left[1]
        for leaf, value in (
            (j, _NO_PAIR),
            (i, right[0] << 32 | i if right else _NO_PAIR),
            (h, left[0] << 32 | h if left else _NO_PAIR),
        ):
            node = size + leaf
            if leaf < 0 or leaf >= n - 1 or tree[node] == value:
                continue
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class MergeTrees:
    """Segment trees for many words at once, one row each; words of over 62 symbols go to :func:`merge_symbols`."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        keys = np.array([left << 32 | right for left, right in vocabulary.pairs], np.int64)
        ranks, made = (np.array(x, np.int64) for x in zip(*vocabulary.pairs.values(), strict=True))
        if ranks.max() >= _NO_LEAF >> 6:
            raise ValueError("too many merges")
        self._made = np.zeros(int(ranks.max()) + 1, np.int32)
        self._made[ranks] = made
        self._byte_ids = np.array(vocabulary.byte_ids, np.int32)
        # a table by hash, with the pairs that share a place in a sorted list of their own
        self._shift = 64 - max(10, (8 * len(keys)).bit_length())
        slot = self._slots(keys)
        order = np.argsort(slot, kind="stable")
        first = np.append(True, slot[order][1:] != slot[order][:-1])
        own, rest = order[first], order[~first]
        self._keys, self._ranks = np.full(1 << (64 - self._shift), -1, np.int64), np.zeros(1 << (64 - self._shift), np.int32)
        self._keys[slot[own]], self._ranks[slot[own]] = keys[own], ranks[own]
        self._crowded = np.zeros(len(self._keys), bool)
        self._crowded[slot[rest]] = True
        rest = rest[np.argsort(keys[rest])]
        self._rest_keys, self._rest_ranks = keys[rest], ranks[rest].astype(np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self._shift)).view(np.int64)

    def _leaves(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """rank << 6 | position of each pair of ids, or ``_NO_LEAF`` where it doesn't merge or an id is -1."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slots(key)
        found, rank = self._keys[slot] == key, self._ranks[slot]
        late = np.flatnonzero(self._crowded[slot] & ~found)
        if len(late):
            at = np.minimum(np.searchsorted(self._rest_keys, key[late]), len(self._rest_keys) - 1)
            found[late], rank[late] = self._rest_keys[at] == key[late], self._rest_ranks[at]
        return np.where(found & (left >= 0) & (right >= 0), rank << 6 | position, _NO_LEAF).astype(np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the number of ids of each."""
        array = pa.array(words, pa.large_string())
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.frombuffer(array.buffers()[1], np.int64, len(words) + 1)
        data = np.frombuffer(array.buffers()[2], np.uint8, offsets[-1]) if offsets[-1] else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        bits = np.maximum(3, np.frexp(lengths)[1])  # as int.bit_length
        order, parts, counts = [], [], []
        for at in np.flatnonzero(bits > 6).tolist():
            order.append(np.array([at]))
            parts.append(np.array(merge_symbols([self.vocabulary.byte_ids[b] for b in data[offsets[at] : offsets[at + 1]].tolist()], self.vocabulary.pairs), np.uint32))
            counts.append(np.array([len(parts[-1])], np.int64))
        for width in (3, 4, 5, 6):
            members = np.flatnonzero(bits == width)
            for a in range(0, len(members), 20_000):
                at = members[a : a + 20_000]
                ids, n = self._rows(_gather(data, offsets[at], lengths[at]), lengths[at], 1 << width)
                order.append(at)
                parts.append(ids)
                counts.append(n)
        ids, n, order = np.concatenate(parts), np.concatenate(counts), np.concatenate(order)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts = np.cumsum(n) - n
        return _gather(ids, starts[place], n[place]), n[place]

    def _rows(self, data: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of fewer than ``width`` bytes: ``width`` leaves each, so that a leaf past the end always exists."""
        count = len(lengths)
        symbols = np.full((count, width), -1, np.int32)
        alive = np.arange(width) < lengths[:, None]
        symbols[alive] = self._byte_ids[data]
        place = np.arange(width, dtype=np.int32)
        tree = np.full((count, 2 * width), _NO_LEAF, np.int32)
        tree[:, width:-1] = self._leaves(symbols[:, :-1].reshape(-1), symbols[:, 1:].reshape(-1), np.tile(place[:-1], count)).reshape(count, width - 1)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        after, before = np.tile(np.minimum(place + 1, width - 1), (count, 1)), np.tile(np.where(place, place - 1, width - 1).astype(np.int32), (count, 1))
        flat, nodes, after1, before1, alive1 = (x.reshape(-1) for x in (symbols, tree, after, before, alive))
        rows = np.arange(count)
        while True:
            top = nodes[rows * (2 * width) + 1]
            merging = top != _NO_LEAF
            rows, top = rows[merging], top[merging]
            if not len(rows):
                break
            base, root = rows * width, rows * (2 * width)
            i = top & 63
            j = after1[base + i]
            k, h = after1[base + j], before1[base + i]
            made = self._made[top >> 6]
            flat[base + i], flat[base + j] = made, -1
            after1[base + i] = k
            alive1[base + j] = False
            inner = np.flatnonzero(k != width - 1)
            before1[(base + k)[inner]] = i[inner]
            n = len(rows)
            pairs = self._leaves(np.concatenate([made, flat[base + h]]), np.concatenate([flat[base + k], made]), np.concatenate([i, h]))
            three, node = np.concatenate([root, root, root]), np.concatenate([j, i, h]) + width
            nodes[three[:n] + node[:n]] = _NO_LEAF
            nodes[three[n:] + node[n:]] = pairs
            while node[0] > 1:
                node = node >> 1
                down = three + 2 * node
                nodes[three + node] = np.minimum(nodes[down], nodes[down + 1])
        return symbols[alive].astype(np.uint32), alive.sum(1)


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices of ``counts`` values from ``starts``, one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


def _key(word: str) -> str:
    """How a word is written in the table: without its space, or with the mark where it has none."""
    return word[1:] if word[0] == " " and word[1:2] != _MARK else _MARK + word


def _raw(key: str) -> str:
    return key[1:] if key.startswith(_MARK) else " " + key


class Encoder:
    """Texts to ids and back."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._find = regex.compile(PATTERN).findall
        self._trees = MergeTrees(self.vocabulary)
        self._names = [str(i) for i in range(max(self.vocabulary.bytes) + 1)]
        self._special = "|".join(re.escape(s) for s in self.vocabulary.special)
        self.forget()

    def forget(self) -> None:
        """An empty table: piece -> number, and each number's slice of the pool of ids. Tasks call it at their end, as a worker lives on."""
        self._table: dict[str, int] = {}
        self._long: list[str] = []
        self._pool, self._starts, self._counts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._used = self._bytes = self._numbers_used = 0

    def _append(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first, used = self._numbers_used, self._used
        while len(self._pool) < used + len(ids):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while len(self._starts) < first + len(keys):
            self._starts, self._counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self._starts, self._counts))
        self._pool[used : used + len(ids)] = ids
        self._starts[first : first + len(keys)] = used + np.cumsum(counts) - counts
        self._counts[first : first + len(keys)] = counts
        self._table.update(zip(keys, range(first, first + len(keys)), strict=True))
        self._used, self._numbers_used = used + len(ids), first + len(keys)
        self._bytes += 4 * len(ids) + 180 * len(keys)
        self._long += [k for k in keys if len(k) > KEPT_CHARS]

    def _numbers(self, keys: list[str], single: bool = False) -> np.ndarray:
        """Each piece's number; those that the table lacks are encoded. ``single``: each is one word."""
        table = self._table
        lacking = [k for k in keys if k not in table]
        words, several, split = [], [], []
        for key in lacking:
            if single or (key.isalpha() and (key.isascii() or max(key) < _LATIN_END)):
                words.append(key)
            elif key[-1:] in _STOPS and key[:-1].isalpha() and (key.isascii() or max(key) < _LATIN_END):
                several.append(key)
                split.append([key[:-1], _MARK + key[-1]])
            elif key.startswith(_MARK + _MARK) and key[2:] in self.vocabulary.special:
                self._append([key], np.array([self.vocabulary.special[key[2:]]], np.uint32), np.ones(1, np.int64))
            else:
                found = self._find(_raw(key))
                if len(found) == 1:
                    words.append(key)
                else:
                    several.append(key)
                    split.append([_key(w) for w in found])
        if words:
            self._append(words, *self._trees.merge([_raw(k) for k in words]))
        if several:
            parts = [w for ws in split for w in ws]
            distinct = list(dict.fromkeys(parts))
            number = dict(zip(distinct, self._numbers(distinct, True).tolist(), strict=True))
            at = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
            counts = self._counts[at]
            ids, ends = _gather(self._pool, self._starts[at], counts), np.append(0, np.cumsum(counts))
            stops = np.append(0, np.cumsum([len(ws) for ws in split]))
            self._append(several, ids, np.diff(ends[stops]))
        return np.fromiter(map(table.__getitem__, keys), np.int64, len(keys))

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text of any kind."""
        out = []
        for part in self.vocabulary.split_special.split(text) if self._special else [text]:
            if part in self.vocabulary.special:
                out.append(_MARK + _MARK + part)
            elif _MARK in part:
                out.append(_MARK + part)
            else:
                first, *rest = _CUT.split(part)
                out += [_MARK + first, *rest]
        return out

    def groups(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``ids, number of ids of each text`` for about ``GROUP_CHARS`` characters of texts at a time."""
        start = size = 0
        for stop, text in enumerate(texts, 1):
            size += len(text or "")
            if size > GROUP_CHARS or stop == len(texts):
                yield self._group(texts[start:stop])
                start, size = stop, 0

    def _group(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self._bytes + 200 * len(self._long) > CACHE_BYTES:
            self.forget()
        array = pa.array([x or "" for x in texts], pa.large_string())
        odd = pc.match_substring_regex(array, f"{_ODD}|{self._special}" if self._special else _ODD)
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_MARK, pa.large_string()), array.filter(pc.invert(odd)), pa.scalar("", pa.large_string())), " ")
        others = [self._pieces(texts[k]) for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))]
        flat = pa.concat_arrays([lists.flatten(), pa.array([p for ps in others for p in ps], pa.large_string())]).dictionary_encode()
        numbers = self._numbers(flat.dictionary.to_numpy(zero_copy_only=False).tolist())[flat.indices.to_numpy()]
        counts = self._counts[numbers]
        ids = _gather(self._pool, self._starts[numbers], counts)
        pieces = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(ps) for ps in others], np.int64)])
        ends = np.append(0, np.cumsum(counts))
        per_text = np.diff(ends[np.append(0, np.cumsum(pieces))])
        for key in self._long:
            del self._table[key]
        self._long = []
        if not others:
            return ids, per_text
        where = odd.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~where), np.flatnonzero(where)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts = np.cumsum(per_text) - per_text
        return _gather(ids, starts[place], per_text[place]), per_text[place]

    def packed(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        for ids, counts in self.groups(texts):
            data, ends = memoryview(ids.astype("<u4").tobytes()), np.append(0, 4 * np.cumsum(counts)).tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                yield bytes(data[a:b])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.packed([text])), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self._names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    return Encoder(path)


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string``: the ids of each whole text and the text that they decode to."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").tolist() for x in coder.packed(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])
        coder.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, from the same encoder without shipping the ids."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            rows = []
            for data in coder.packed(batch.column(1).to_pylist()):
                ids = np.frombuffer(data, "<u4").tolist()
                rows.append((len(ids), sha(coder.joined(ids).encode()), sha(coder.decode(ids).encode())))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token ids of whole texts by a tokenizer file, with numpy around the library's merges.

Encoding a corpus word for word costs about a second a megabyte. Almost all words have been seen before, so tasks keep the
ids of the units they have met, in a table that numpy looks up for all units of a batch at once. The library encodes only
units that are new. Texts outside Latin-1 and tokenizers with other rules than those below go through the library as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

# The rules of a tokenizer file that allow the way by units.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"

SPACE, LETTER, NUMBER, OTHER = range(4)
KEY_BYTES = 24
SLOT_BITS = 20
CHUNK_CHARS = 1 << 19
APOSTROPHE = ord("'")


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for code in range(256):
        char = chr(code)
        if char in "\t\n\v\f\r \x85\xa0":
            kinds[code] = SPACE
        elif char.isalpha():
            kinds[code] = LETTER
        elif char.isnumeric():
            kinds[code] = NUMBER
    return kinds


KINDS = _kinds()
LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class UnitTable:
    """Offsets and counts of the ids of units of up to ``KEY_BYTES`` bytes, by their bytes: open addressing in numpy."""

    def __init__(self) -> None:
        self.slots = 1 << SLOT_BITS
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((self.slots, 4), np.uint64)  # the bytes, and the length
        self.at = np.zeros(self.slots, np.int64)
        self.n = np.zeros(self.slots, np.int32)
        self.used = 0

    @staticmethod
    def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Keys of units in ``data``, which ends with ``KEY_BYTES`` spare bytes."""
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        keys = np.empty((len(starts), 4), np.uint64)
        for i in range(3):
            keys[:, i] = eight[starts + 8 * i] & MASKS[np.clip(lengths - 8 * i, 0, 8)]
        keys[:, 3] = lengths
        return keys

    def first_slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= keys[:, 2] * np.uint64(0x165667B19E3779F9) ^ keys[:, 3]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not held."""
        found = np.full(len(keys), -1, np.int64)
        todo, slots = np.arange(len(keys)), self.first_slots(keys)
        wanted = keys
        while len(todo):
            held = self.keys[slots]
            same = held[:, 0] == wanted[:, 0]
            for i in (1, 2, 3):
                same &= held[:, i] == wanted[:, i]
            found[todo[same]] = slots[same]
            on = ~same & (held[:, 3] != 0)
            todo, wanted, slots = todo[on], wanted[on], (slots[on] + 1) % self.slots
        return found

    def add(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Hold keys that differ from each other and from those held."""
        todo, slots = np.arange(len(keys)), self.first_slots(keys)
        while len(todo):
            free = self.keys[slots, 3] == 0
            _, first = np.unique(slots[free], return_index=True)
            lucky = np.flatnonzero(free)[first]
            where, which = slots[lucky], todo[lucky]
            self.keys[where], self.at[where], self.n[where] = keys[which], at[which], n[which]
            rest = np.ones(len(todo), bool)
            rest[lucky] = False
            taken = self.keys[slots[rest], 3] != 0
            todo, slots = todo[rest], (slots[rest] + taken) % self.slots
        self.used += len(keys)


class Encoder:
    """Token ids of texts, the same as the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.by_units = self._has_known_rules(rules)
        if not self.by_units:
            return
        self.special = [t["content"].encode() for t in rules["added_tokens"]]
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.table = UnitTable()
        self._forget()

    @staticmethod
    def _has_known_rules(rules: dict) -> bool:
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        model = rules["model"]
        return (
            (rules.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and split[0].get("pattern") == {"Regex": SPLIT}
            and [s["type"] for s in split] == ["Split", "ByteLevel"]
            and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True)
            and (split[1]["add_prefix_space"], split[1]["use_regex"]) == (False, False)
            and model["end_of_word_suffix"] == WORD_END
            and not model["continuing_subword_prefix"]
            and not rules.get("truncation")
        )

    def _forget(self) -> None:
        self.table.clear()
        self.long: dict[bytes, tuple[int, int]] = {}
        self.ids = np.zeros(1 << 16, self.dtype)
        self.filled = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        chunk: list[tuple[int, bytes]] = []
        size = 0
        plain: list[int] = []
        for i, text in enumerate(texts):
            data = self._simple(text)
            if data is None:
                plain.append(i)
                continue
            chunk.append((i, data))
            size += len(data)
            if size >= CHUNK_CHARS:
                self._encode_chunk(chunk, out)
                chunk, size = [], 0
        if chunk:
            self._encode_chunk(chunk, out)
        for i in plain:
            ids = self.library.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids
            out[i] = np.array(ids, self.dtype)
        return out

    def _simple(self, text: str) -> bytes | None:
        if not self.by_units:
            return None
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(s in data for s in self.special) else data

    def _encode_chunk(self, chunk: list[tuple[int, bytes]], out: list) -> None:
        parts = [data for _, data in chunk]
        data = LOWER[np.frombuffer(b"\n".join(parts) + b"\n" + bytes(KEY_BYTES), np.uint8)]
        starts, lengths = units(data[:-KEY_BYTES])
        # A text may have more units than the table has slots; so many at a time always find room.
        step = self.table.slots // 4
        found = [self._ids(data, starts[i : i + step], lengths[i : i + step]) for i in range(0, max(1, len(starts)), step)]
        n, ids = (np.concatenate(x) for x in zip(*found))
        total = np.cumsum(n, dtype=np.int64)
        sizes = np.array([len(p) + 1 for p in parts])
        last_unit = np.searchsorted(starts, np.cumsum(sizes))
        ends = np.concatenate([[0], total])[last_unit]
        begin = 0
        for (i, _), end in zip(chunk, ends.tolist()):
            out[i] = ids[begin:end]
            begin = end

    def _ids(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each unit has, and the ids of all in order."""
        at, n = self._places(data, starts, lengths)
        total = np.cumsum(n, dtype=np.int64)
        return n, self.ids[np.repeat(at - (total - n), n) + np.arange(total[-1] if len(total) else 0)]

    def _places(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
        short = np.flatnonzero(lengths <= KEY_BYTES)
        raw = data.tobytes()
        long = [(i, raw[s : s + k]) for i, s, k in ((i, starts[i], lengths[i]) for i in np.flatnonzero(lengths > KEY_BYTES).tolist())]
        if self.table.used > self.table.slots * 6 // 10 or len(self.long) > 1 << 17:
            self._forget()
        keys = UnitTable.packed(data, starts[short], lengths[short])
        slots = self.table.find(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            where = short[missing]
            self._learn(sorted({raw[s : s + k] for s, k in zip(starts[where].tolist(), lengths[where].tolist())}))
            slots[missing] = self.table.find(keys[missing])
        at[short], n[short] = self.table.at[slots], self.table.n[slots]
        unknown = sorted({unit for _, unit in long if unit not in self.long})
        if unknown:
            self.long.update(zip(unknown, zip(*(x.tolist() for x in self._append(unknown)))))
        for i, unit in long:
            at[i], n[i] = self.long[unit]
        return at, n

    def _learn(self, new: list[bytes]) -> None:
        at, n = self._append(new)
        data = np.frombuffer(b"".join(new) + bytes(KEY_BYTES), np.uint8)
        lengths = np.array([len(u) for u in new])
        self.table.add(UnitTable.packed(data, np.cumsum(lengths) - lengths, lengths), at, n)

    def _append(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode units with the library and append their ids; where each begins, and how many it has."""
        text = b" ".join(new).decode("latin-1")
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the tokenizer has no id for some byte")
        starts = np.concatenate([[0], ends[:-1]])
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        at = starts + self.filled
        self.filled += len(ids)
        return at, (ends - starts).astype(np.int32)


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of what ``SPLIT`` finds in lower-case Latin-1 bytes that end with white space."""
    kinds = KINDS[data]
    start = np.empty(len(data), bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start |= kinds == NUMBER
    start &= kinds != SPACE
    # An apostrophe alone before a letter may begin a contraction.
    lone = np.flatnonzero((data == APOSTROPHE) & start)
    lone = lone[kinds[lone + 1] == LETTER]
    if len(lone):
        one, two = data[lone + 1], data[np.minimum(lone + 2, len(data) - 1)]
        longer = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        for pair in (b"re", b"ve", b"ll"):
            longer[(one == pair[0]) & (two == pair[1])] = 2
        lone, longer = lone[longer > 0], longer[longer > 0]
        start[lone + 1] = False
        after = lone + 1 + longer
        start[after[kinds[after] == LETTER]] = True
    edges = np.flatnonzero(start | (kinds == SPACE))
    begins = np.flatnonzero(start[edges])
    starts = edges[begins]
    return starts, edges[begins + 1] - starts if len(begins) else starts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept as long as the Python worker lives."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batch: pa.RecordBatch, column: str, path: str, end_id: int, piece: int = 256) -> Iterator[np.ndarray]:
    """The ids of each text of a batch, with ``end_id`` behind; a few texts at a time are held."""
    end = np.array([end_id])
    coder = encoder(path)
    texts = batch.column(column)
    for first in range(0, len(texts), piece):
        for ids in coder.encode([t or "" for t in texts.slice(first, piece).to_pylist()]):
            yield np.concatenate([ids, end.astype(coder.dtype)])

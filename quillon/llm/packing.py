"""Hierarchical multi-length packing of tokenised documents into context windows.

One pass over the documents, without a shuffle: a task tokenises its rows and
packs them in units of a bounded number of tokens. Within a unit

1. a document longer than the longest window gives whole windows to the top
   tier; what is left is routed to the shortest tier (context size) it fits in;
2. each tier is packed from the longest down: an item opens a window and the gap
   behind it is filled with the longest items of the shorter tiers that fit,
   then with a piece cut to size, so that a window closes exactly full;
3. when nothing is left to fill the unit's last window, that window is cut into
   power-of-two windows, which need no padding either;
4. the windows are dealt to step groups of equal token counts, heaviest first.

Cases: a null or empty text is the single end id; a text of any length is cut
freely; a special token written out in a text is that token; equal documents are packed each for itself; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Largest window and the tiers below it, in tokens; powers of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens that are packed together; bounds a task's memory, not the data.
UNIT_TOKENS = 2_000_000
#: Windows of the longest tier that one training step takes.
STEP_WINDOWS = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group long"
_PUNCTUATION = frozenset('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')


def _byte_level() -> dict[int, str]:
    """The usual printable stand-ins for bytes: printable Latin-1 stays, the rest moves to U+0100 on."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in stays]
    return {b: chr(b) for b in stays} | {b: chr(256 + i) for i, b in enumerate(moved)}


class WordTokenizer(dict):
    """Token ids of white-space separated words, as little-endian 32-bit bytes.

    The tokeniser drops white space and never merges across it, so a text's ids
    are its words' ids in a row. Words repeat (Zipf), hence the cache: two
    generations of a bounded size, so that frequent words stay. Special tokens
    written out in a text are found first, as the tokeniser does, and have their ids.
    """

    def __init__(self, path: str, entries: int = 250_000):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = {content: i.to_bytes(4, "little") for content, i in special.items()}
        self.special_pattern = re.compile("|".join(re.escape(c) for c in sorted(special, key=len, reverse=True)) or r"(?!)")
        self.tokenizer.encode_special_tokens = True  # words come here lower-cased, and may look like a special token only then
        self.model, self.entries, self.older, self.letters = self.tokenizer.model, entries, {}, _byte_level()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self._encode(word)
        self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        if word.isalpha() and unicodedata.is_normalized("NFC", word):
            text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])
        n = len(word)
        while n and word[n - 1] in _PUNCTUATION:
            n -= 1
        if 0 < n < len(word) and word[:n].isalpha():
            return self[word[:n]] + self[word[n:]]
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def ids(self, text: str) -> bytes:
        at, out = 0, []
        for found in self.special_pattern.finditer(text):
            out += [self._plain(text[at : found.start()]), self.special[found.group()]]
            at = found.end()
        return b"".join(out) + self._plain(text[at:]) if out else self._plain(text)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # a capital sigma at a word's end has a lower-case form of its own in Python, but not in the tokeniser
        text = text.replace("Σ", "σ").lower().replace("\n", " ")
        out = b"".join(map(self.__getitem__, text.split(" ")))
        if len(self) > self.entries:
            self.older = dict(self)
            self.clear()
        return out


class Pool:
    """Items (document, start, length) by length, for best-fit lookups."""

    def __init__(self):
        self.lengths: list[int] = []
        self.items: dict[int, list[tuple[int, int]]] = {}

    def add(self, doc: int, start: int, length: int) -> None:
        if length not in self.items:
            self.items[length] = []
            insort(self.lengths, length)
        self.items[length].append((doc, start))

    def take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.items[length].pop()
        if not self.items[length]:
            del self.items[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return doc, start, length

    def longest(self, limit: int) -> int:
        """The longest length up to ``limit``; 0 if there is none."""
        i = bisect_right(self.lengths, limit)
        return self.lengths[i - 1] if i else 0

    def shortest_over(self, limit: int) -> int:
        i = bisect_right(self.lengths, limit)
        return self.lengths[i] if i < len(self.lengths) else 0


def pack_unit(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows, each a list of pieces (document, start, length), of documents with ``lengths`` tokens."""
    top, windows, pool = tiers[-1], [], Pool()
    for doc, n in enumerate(lengths):
        whole = n - n % top
        windows += [[(doc, start, top)] for start in range(0, whole, top)]
        if n > whole:
            pool.add(doc, whole, n - whole)
    shorter = [0, *tiers[:-1]]
    for tier, below in reversed(list(zip(tiers, shorter, strict=True))):
        while pool.longest(tier) > below:
            window, room = [pool.take(pool.longest(tier))], tier
            room -= window[0][2]
            while room and pool.lengths:
                if n := pool.longest(room):
                    piece = pool.take(n)
                else:
                    doc, start, n = pool.take(pool.shortest_over(room))
                    piece = (doc, start, room)
                    pool.add(doc, start + room, n - room)
                window.append(piece)
                room -= piece[2]
            windows += [window] if not room else _halve(window, tier - room)
    return windows


def _halve(window: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """A unit's last window as windows of powers of two, the longest first."""
    parts, left = [], list(reversed(window))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            doc, start, n = left.pop()
            if n > room:
                left.append((doc, start + room, n - room))
                n = room
            part.append((doc, start, n))
            room -= n
        parts.append(part)
    return parts


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window: the heaviest first, always to the lightest group."""
    count = max(1, -(-sum(sizes) // step_tokens))
    heap, group = [(0, g) for g in range(count)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + sizes[i], g))
        group[i] = g
    return group


_tokenizers: dict[str, WordTokenizer] = {}


def _pack_partition(batches: Iterator, path: str, end_id: int, tiers: tuple[int, ...], unit_tokens: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    tokenizer, end = _tokenizers[path], end_id.to_bytes(4, "little")
    base = TaskContext.get().partitionId() << 40
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int32() if " int" in c else pa.int64() for c in SCHEMA.split(", ")]
    sequences = groups = 0

    def flush(docs: list[int], ids: list[bytes]):
        nonlocal sequences, groups
        windows = pack_unit([len(x) // 4 for x in ids], tiers)
        sizes = [sum(p[2] for p in w) for w in windows]
        steps = step_groups(sizes, STEP_WINDOWS * tiers[-1])
        rows = []
        for i, window in enumerate(windows):
            offset = 0
            for doc, start, n in window:
                crc = zlib.crc32(memoryview(ids[doc])[4 * start : 4 * (start + n)])
                rows.append((docs[doc], start, n, crc, len(ids[doc]) // 4, base + sequences + i, offset, sizes[i], base + groups + steps[i]))
                offset += n
        sequences, groups = sequences + len(windows), groups + max(steps, default=-1) + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    docs, ids, tokens = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs.append(doc)
            ids.append(tokenizer.ids(text.as_py() or "") + end)
            tokens += len(ids[-1]) // 4
            if tokens >= unit_tokens:
                yield flush(docs, ids)
                docs, ids, tokens = [], [], 0
    if docs:
        yield flush(docs, ids)


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """Pieces of the packed documents ``df(doc_id, text)``; see the module.

    A row is a piece: ``start`` counts the document's ids before it,
    ``sequence_id`` is its window, ``offset`` its place there, ``context`` the
    window's length and ``step_group`` the training step that takes the window.
    """
    return df.select("doc_id", "text").mapInArrow(lambda batches: _pack_partition(batches, tokenizer_path, end_id, tiers, unit_tokens), SCHEMA)

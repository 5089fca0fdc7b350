"""BPE encoding by a dynamic program over prefixes, and decoding.

An automaton over the vocabulary gives at each position every token that ends there. For each prefix of a piece exactly
one last token is possible: the one whose predecessor, the last token of the shorter prefix, stays next to it under the
merges. It is stored with the prefix, and following it backwards gives the ids.

The file is a tokenizer of kind BPE with an end-of-word suffix: NFC, white space runs to one space, lower case letter by
letter, words by its pattern, bytes as letters. Its special tokens are found in the raw text first.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; a null id list
decodes to an empty text. A piece of any length is handled in one pass. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import by_bytes, lean


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else extra))
        extra += byte not in plain
    return letters


#: Stands for "no token yet" before a piece; greater than any id.
START = (1 << 17) - 1


class Vocabulary:
    """Tokens as strings over 512 symbols: a byte, or 256 + a byte if it ends the word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        byte_of = {letter: chr(i) for i, letter in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pattern = regex.compile(next(
            p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        ))
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

        def symbols(token: str) -> str:
            ends = token.endswith(self.suffix)
            inner = "".join(byte_of[c] for c in (token[: -len(self.suffix)] if ends else token))
            return inner[:-1] + chr(256 + ord(inner[-1])) if ends else inner

        self.content = {i: token for token, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        ids = {symbols(t): i for t, i in model["vocab"].items() if t not in self.special and t != self.suffix}
        # rank of the merge of two tokens, and the merge that made a token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b = ids[symbols(left)], ids[symbols(right)]
            merged = ids[symbols(left + right)]
            self.rank.setdefault((a, b), rank)
            self.made.setdefault(merged, (rank, a, b))
        self._automaton({s: i for s, i in ids.items() if len(s) == 1 or i in self.made})
        self.width = {t: s for t, s in zip(self.token, self.size, strict=True) if t >= 0}
        # what was found out so far: steps of the automaton, and tokens that may be neighbours
        self.moves: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        self.kept: dict[int, bool] = {}
        self._made_whole: dict[int, bool] = {}

    def _automaton(self, ids: dict[str, int]) -> None:
        """Trie of the tokens with links to the longest proper suffix that is in the trie."""
        step: dict[int, int] = {}
        token, size = [-1], [0]
        for word, i in ids.items():
            node = 0
            for c in word:
                key = node << 9 | ord(c)
                if key not in step:
                    step[key] = len(token)
                    token.append(-1)
                    size.append(size[node] + 1)
                node = step[key]
            token[node] = i
        children: list[list[int]] = [[] for _ in token]
        for key in step:
            children[key >> 9].append(key)
        link, shorter = array("l", [0] * len(token)), array("l", [0] * len(token))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for key in children[node]:
                child, c, back = step[key], key & 511, link[node]
                if node:
                    while back and (back << 9 | c) not in step:
                        back = link[back]
                    link[child] = step.get(back << 9 | c, 0)
                # nearest node on the suffix path that ends a token
                shorter[child] = link[child] if token[link[child]] >= 0 else shorter[link[child]]
                queue.append(child)
        self.step, self.link = step, link
        # steps by a byte within a word, node after node
        inner = sorted(key for key in step if key & 511 < 256)
        self.inner = array("q", inner)
        self.inner_at = np.searchsorted(np.array(inner, np.int64), np.arange(len(token) + 1, dtype=np.int64) << 9)
        self.token, self.size = array("l", token), array("l", size)
        self.ends = array("l", [n if token[n] >= 0 else shorter[n] for n in range(len(token))])
        self.shorter = shorter

    def stays(self, left: int, right: int) -> bool:
        """Whether the two tokens stay side by side when their joined bytes are merged by rank.

        Takes the later of both merges apart again and again, down to the symbols at the seam; at each stage, a merge
        over the seam that comes before the merge just undone would have happened first.
        """
        a, b = left, right
        late = None  # rank of the merge undone last, and whether it was on the left
        while True:
            over = self.rank.get((a, b))
            # among equal ranks the leftmost pair is merged first
            if over is not None and (late is None or over < late[0] or over == late[0] and not late[1]):
                return False
            ra, rb = self.made.get(a), self.made.get(b)
            if ra is None and rb is None:
                return True
            if rb is None or ra is not None and ra[0] > rb[0]:  # of equal ranks, the right one came later
                late, a = (ra[0], True), ra[2]
            else:
                late, b = (rb[0], False), rb[1]

    def _possible(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before``, or stand first; answers are remembered."""
        found = self.whole(token) if before == START else self.stays(before, token)
        if len(self.kept) > 500_000:
            self.kept.clear()
        self.kept[before << 17 | token] = found
        return found

    def move(self, key: int) -> tuple[int, list[tuple[int, int]]]:
        """Where the automaton goes, as the upper part of the next key, and the tokens that end there, the longest
        first, with their sizes."""
        symbol, back = key & 511, key >> 9
        while (found := self.step.get(back << 9 | symbol)) is None and back:
            back = self.link[back]
        out, end = [], self.ends[found or 0]
        while end:
            out.append((self.token[end], self.size[end]))
            end = self.shorter[end]
        if len(self.moves) > 100_000:
            self.moves.clear()
        self.moves[key] = (found or 0) << 9, out
        return self.moves[key]

    def piece(self, symbols: list[int]) -> list[int]:
        """Ids of one piece given as symbols."""
        moves, kept = self.moves, self.kept
        last = [START << 17]  # the last token of each prefix, in the upper part of a key
        add = last.append
        node = at = 0
        for c in symbols:
            at += 1
            try:
                node, endings = moves[node | c]
            except KeyError:
                node, endings = self.move(node | c)
            for token, size in endings:
                before = last[at - size]
                try:
                    fits = kept[before | token]
                except KeyError:
                    fits = self._possible(before >> 17, token)
                if fits:
                    add(token << 17)
                    break
        out, width = [], self.width
        while at:
            token = last[at] >> 17
            out.append(token)
            at -= width[token]
        out.reverse()
        return out

    def whole(self, token: int) -> bool:
        """Whether the merges make exactly this token of its own symbols."""
        parts = self.made.get(token)
        if parts is None:
            return True
        found = self._made_whole.get(token)
        if found is None:
            rank, a, b = parts
            found = self._made_whole[token] = self.whole(a) and self.whole(b) and self._meets(a, b, rank)
        return found

    def _meets(self, left: int, right: int, rank: int) -> bool:
        """Whether two tokens stand side by side until the merge ``rank`` joins them."""
        self.rank.pop((left, right))
        try:
            return self.stays(left, right)
        finally:
            self.rank[(left, right)] = rank


class Moves:
    """The automaton's next node for each node and byte within a word; a node's row is filled when it is first asked for,
    so only the rows of nodes that texts reach take memory."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.rows = np.zeros((len(vocabulary.token), 256), np.int32)
        self.filled = np.zeros(len(vocabulary.token), bool)

    def _fill(self, node: int) -> None:
        v = self.vocabulary
        if node:
            if not self.filled[v.link[node]]:
                self._fill(v.link[node])
            self.rows[node] = self.rows[v.link[node]]
        for key in v.inner[v.inner_at[node] : v.inner_at[node + 1]]:
            self.rows[node, key & 511] = v.step[key]
        self.filled[node] = True

    def __call__(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        new = nodes[~self.filled[nodes]]
        if len(new):
            for node in np.unique(new).tolist():
                if not self.filled[node]:
                    self._fill(node)
        return self.rows[nodes, symbols]


class Pairs:
    """Which tokens may be neighbours, for whole arrays: open addressing with answers added as they are asked for."""

    BITS = 19

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.zeros(1 << self.BITS, bool)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or the empty one where it belongs."""
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)
        wrong = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[slots[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found != -1)]
        return slots

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        missing = self.keys[slots] == -1
        if missing.any():
            if self.used > 1 << (self.BITS - 1):
                self.clear()
                missing[:] = True
            for key in np.unique(keys[missing]).tolist():
                before, token = key >> 17, key & START
                fits = self.vocabulary.whole(token) if before == START else self.vocabulary.stays(before, token)
                slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.BITS)
                while self.keys[slot] != -1:
                    slot = (slot + 1) & ((1 << self.BITS) - 1)
                self.keys[slot], self.values[slot] = key, fits
                self.used += 1
            slots = self._slots(keys)
        return self.values[slots]


class Codec:
    """Encoder of lists of whole texts. What a piece gives is remembered: those of the last lists up to ``most``, and as
    many before them."""

    LONG = 128  # bytes of a piece from which it goes through the program alone

    def __init__(self, path: str, most: int = 100_000):
        self.vocabulary = v = Vocabulary(path)
        self.most = most
        self.known: dict[str, tuple[int, str, str]] = {}
        self.before: dict[str, tuple[int, str, str]] = {}
        self.names = {i: str(i) for i in v.content}
        self.pairs = Pairs(v)
        self.token, self.size, self.ends, self.shorter = (np.array(x, np.int32) for x in (v.token, v.size, v.ends, v.shorter))
        self.width = np.zeros(max(v.content) + 1, np.int64)
        for token, width in v.width.items():
            self.width[token] = width
        self.table = Moves(v)

    def _program(self, words: list[bytes]) -> list[list[int]]:
        """The program of ``Vocabulary.piece`` for many pieces at once, place by place."""
        moves = self.vocabulary.moves
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        lengths = sizes[order]
        width = int(lengths[0])
        symbols = np.zeros((len(words), width), np.int32)
        symbols[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        last = np.full((len(words), width + 1), START, np.int32)
        node = np.zeros(len(words), np.int32)
        until = np.searchsorted(-lengths, -np.arange(width + 2), side="right").tolist()  # pieces of at least that length
        for at in range(1, width + 1):
            n, longer = until[at], until[at + 1]
            here = symbols[:n, at - 1]
            where = self.table(node[:n], here)
            # the pieces that end here: their last symbol is one of its own
            keys = (node[longer:n].astype(np.int64) << 9 | 256 | here[longer:]).tolist()
            where[longer:] = [(moves[k] if k in moves else self.vocabulary.move(k))[0] >> 9 for k in keys]
            node[:n] = where
            rows, end = np.arange(n), self.ends[where]
            while len(rows):
                token = self.token[end]
                fits = self.pairs(last[rows, at - self.size[end]].astype(np.int64) << 17 | token)
                last[rows[fits], at] = token[fits]
                rows, end = rows[~fits], self.shorter[end[~fits]]
        # follow the tokens backwards, all pieces at once
        found, rows, at = [], np.arange(len(words)), lengths.copy()
        while len(rows):
            token = last[rows, at[rows]]
            column = np.full(len(words), -1, np.int32)
            column[rows] = token
            found.append(column)
            at[rows] -= self.width[token]
            rows = rows[at[rows] > 0]
        table = np.stack(found[::-1], axis=1)
        skip = (table < 0).sum(axis=1).tolist()
        out: list[list[int]] = [[]] * len(words)
        for i, row, k in zip(order.tolist(), table.tolist(), skip, strict=True):
            out[i] = row[k:]
        return out

    def _learn(self, pieces: list[str]) -> dict[str, tuple[int, str, str]]:
        words = [p.encode("utf-8") for p in pieces]
        short = [i for i, w in enumerate(words) if len(w) < self.LONG]
        ids: list[list[int]] = [[]] * len(words)
        for start in range(0, len(short), 4_000):
            part = short[start : start + 4_000]
            for i, own in zip(part, self._program([words[i] for i in part]), strict=True):
                ids[i] = own
        for i, word in enumerate(words):
            if len(word) >= self.LONG:
                ids[i] = self.vocabulary.piece([*word[:-1], word[-1] + 256])
        name, content = self.names.__getitem__, self.vocabulary.content.__getitem__
        return {
            piece: (len(own), " ".join(map(name, own)), " ".join(map(content, own)))
            for piece, own in zip(pieces, ids, strict=True)
        }

    def _split(self, text: str) -> list[str]:
        """The pieces of a text; its special tokens stand for themselves."""
        v = self.vocabulary
        if v.splitter and any(s in text for s in v.special):
            return [w for part in v.splitter.split(text) for w in ([part] if part in v.special else self._pieces(part))]
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        low = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        low = "".join(c.lower() for c in low) if "Σ" in low or "İ" in low else low.lower()
        return self.vocabulary.pattern.findall(low)

    def pieces(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, tuple[int, str, str]]]:
        """The pieces of each text; for each piece its number of ids, the ids in decimal, the decoded tokens."""
        split = [self._split(x or "") for x in texts]
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        for special, token in self.vocabulary.special.items():
            known[special] = 1, str(token), special
        new = set().union(*split).difference(known)
        again = new & before.keys()
        known.update({w: before[w] for w in again})
        fresh = self._learn(list(new - again))
        known.update({w: f for w, f in fresh.items() if len(w) <= 64})
        return split, known if all(len(w) <= 64 for w in fresh) else {**known, **fresh}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split, found = self.pieces(texts)
        return [[int(i) for w in words for i in found[w][1].split()] for words in split]

    def decode(self, ids: list[int] | None) -> str:
        return " ".join(self.vocabulary.content[i] for i in ids or ())

    def digests(self, texts: list[str | None], ids: bool = False) -> list[tuple]:
        """Number of ids, digest of the ids in decimal joined by a space, digest of the decoded text; and the ids."""
        split, found = self.pieces(texts)
        out = []
        for words in split:
            own = [found[w] for w in words]
            joined = " ".join([f[1] for f in own])
            decoded = " ".join([f[2] for f in own])
            out.append(
                (
                    sum([f[0] for f in own]),
                    hashlib.sha256(joined.encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                    np.array(joined.split(), np.int32) if ids else None,
                )
            )
        return out


def _kept(docs: DataFrame, keep: list[str], column: str, new: list[str]) -> tuple[DataFrame, list[str], str]:
    keep = [c for c in keep if c not in new]
    rows = docs.select(*keep, F.col(column).alias("__in"))
    return rows, keep, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``ids``, the token ids of the whole text."""
    rows, keep, fields = _kept(docs, keep, text, ["ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path)
        for batch in by_bytes(batches, len(keep), 800_000):
            ids = pa.array(own.encode(batch.column(len(keep)).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), ids], [*keep, "ids"])

    return rows.mapInArrow(lean(run), f"{fields}ids array<int>")


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` with ``decoded``, the text of the ids."""
    rows, keep, fields = _kept(encoded, keep, ids, ["decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path)
        for batch in batches:
            texts = pa.array([own.decode(x) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), texts], [*keep, "decoded"])

    return rows.mapInArrow(lean(run), f"{fields}decoded string")


def digests(
    docs: DataFrame, path: str, keep: list[str], text: str = "text", ids: bool = False, slices: int = 4_000_000,
    most: int = 100_000,
) -> DataFrame:
    """The columns ``keep`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text, and with ``ids``
    if they are asked for. ``slices`` (bytes of text encoded together) and ``most`` (pieces remembered) trade memory
    against time."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * ids]
    rows, keep, fields = _kept(docs, keep, text, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, most)
        for batch in by_bytes(batches, len(keep), slices):
            found = own.digests(batch.column(len(keep)).to_pylist(), ids)
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], [*keep, *new])

    more = ", ids array<int>" * ids
    return rows.mapInArrow(lean(run), f"{fields}n_tokens long, ids_sha256 string, decoded_sha256 string{more}")

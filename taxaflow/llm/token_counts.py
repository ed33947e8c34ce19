"""Token counts by a compiled finite-state tokenizer.

The byte-level BPE and its pre-tokenizer become one deterministic transducer over characters. A state
holds the pre-tokenizer's mode and, for the pre-token read so far, what later merges can still see: the
vocabulary-trie nodes of its open suffixes, each with the last token before it and its token count
relative to the whole. A transition carries the change of the token count, so the count of a text is the
sum along its path. That rests on one fact about BPE: a sequence of tokens is the encoding of its bytes
if and only if every two neighbours encode to themselves, so each prefix has one last token.

States and transitions are compiled when first met, kept in dense tables, and compiled anew when the
tables are full, so memory is bounded whatever the vocabulary of the corpus.

A batch of texts is cut into chunks, and all chunks are run side by side in lanes. A chunk's state map has two
parts. From its first synchronising place on (white space after another character, where the next state
depends on that character alone) it is a constant, known without any other chunk. Up to there it is known at
single states: at the state that its predecessor's constant ends in, or, where that has none, at the one that
a few characters before the chunk lead to. Maps then compose by a scan in which all neighbours meet at once:
where the state that a map is known at is the one its predecessor ends in, the two compose; where not, the map
is run at that state, all such chunks side by side, and they meet again. States forget what is far behind them,
so a run of letters of any length takes a few rounds, not one a chunk. The scan ends when each map is known at
its predecessor's end, so counts are exact however many guesses were wrong.

Very long texts and texts without white space are chunks as others are; an empty table gives no rows, ties are no case.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters in a chunk, and characters before it that lead to the state its map is first run at.
CHUNK, LEAD = 512, 48
#: States and characters in the dense tables, 5 bytes a pair; rarer characters' transitions are in a dict.
STATES, SYMBOLS = 400_000, 64
#: Token pairs and transitions of rarer characters that a worker keeps.
PAIRS = 400_000

#: The pre-tokenizer's contractions and Unicode's White_Space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Modes: what the open pre-token is made of. QUOTE and its prefixes may still become contractions.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, QUOTE = range(6)


class Bpe:
    """Merges of byte strings and which two tokens may stand side by side."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: GPT-2's printable stand-ins for bytes: printable Latin-1 for itself, the rest from U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        stand = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        byte = lambda s: bytes(stand[c] for c in s)
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(byte(a), byte(b)): k for k, (a, b) in enumerate(merges)}
        self.vocabulary = {byte(t) for t in spec["model"]["vocab"] if t not in set(self.specials)}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in self.vocabulary:
            if self.encode(t) == [t]:  # others never appear in an encoding
                at = 0
                for b in t:
                    nxt = self.children[at].get(b)
                    if nxt is None:
                        nxt = self.children[at][b] = len(self.children)
                        self.children.append({})
                        self.token.append(None)
                    at = nxt
                self.token[at] = t
        self.allowed: dict[int, bool] = {}

    def encode(self, data: bytes) -> list[bytes]:
        """Plain merging, for single tokens and pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def pair(self, left: int, right: int) -> bool:
        """Whether two tokens, given by their trie nodes, may be neighbours."""
        found = self.allowed.get(left << 20 | right)
        if found is None:
            if len(self.allowed) >= PAIRS:
                self.allowed.clear()
            a, b = self.token[left], self.token[right]
            found = self.allowed[left << 20 | right] = self.encode(a + b) == [a, b]
        return found


#: A pre-token's part of a state: (trie node, node of the last token before its suffix, relative count) of
#: open suffixes only, the empty suffix last. Relative to the count of all bytes read, which is 0.
EMPTY = ((0, 0, 0),)


def packed(state: tuple) -> bytes:
    """A state in a few bytes."""
    mode, open_, held = state
    return f"{mode}{held}\0".encode() + struct.pack(f"<{len(open_)}Q", *(n << 36 | left << 12 | rel + 2048 for n, left, rel in open_))


def unpacked(code: bytes) -> tuple:
    at = code.index(0) + 1
    open_ = struct.unpack(f"<{(len(code) - at) // 8}Q", code[at:])
    return code[0] - 48, tuple((x >> 36, x >> 12 & 0xFFFFFF, (x & 0xFFF) - 2048) for x in open_), code[1 : at - 1].decode()


class Transducer:
    """The compiled tokenizer; tables grow as texts need them."""

    def __init__(self, path: str) -> None:
        self.bpe = Bpe(path)
        self.classes = {LETTER: regex.compile(r"\p{L}"), NUMBER: regex.compile(r"\p{N}")}
        self.reset()

    def reset(self) -> None:
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.next = np.zeros((STATES, SYMBOLS), dtype=np.int32)  # one more than the state; 0: not compiled
        self.delta = np.zeros((STATES, SYMBOLS), dtype=np.int8)
        self.rare: dict[tuple[int, int], tuple[int, int]] = {}
        self.symbol = np.full(0x110000, -1, dtype=np.int16)
        self.symbols = 0
        self.start = self.intern((START, EMPTY, ""))

    def intern(self, state: tuple) -> int:
        code = packed(state)
        found = self.number.get(code)
        if found is None:
            found = self.number[code] = len(self.states)
            self.states.append(code)
        return found

    def kind(self, char: str) -> int:
        if char in WHITE:
            return SPACE
        return next((k for k, p in self.classes.items() if p.match(char)), OTHER)

    def read(self, open_: tuple, data: bytes) -> tuple[tuple, int]:
        """A pre-token's part after more bytes, and the change of its count."""
        change = 0
        for b in data:
            open_, more = self.read_byte(open_, b)
            change += more
        return open_, change

    def read_byte(self, open_: tuple, byte: int) -> tuple[tuple, int]:
        bpe, moved, last, count = self.bpe, [], 0, 0
        for node, left, rel in open_:
            nxt = bpe.children[node].get(byte)
            if nxt is None:
                continue
            if bpe.token[nxt] is not None and (not left or bpe.pair(left, nxt)):
                last, count = nxt, rel + 1
            moved.append((nxt, left, rel))
        return (*((n, left, rel - count) for n, left, rel in moved if bpe.children[n]), (0, last, 0)), count

    def transition(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The state after one more character, and the change of the token count.

        A pending white space (kept in the state as text) is not counted until it is known whether it
        ends a run, leads a word, or stands alone.
        """
        mode, open_, held = state
        data, kind = char.encode("utf-8", "surrogatepass"), self.kind(char)
        if mode == QUOTE and kind == LETTER:
            grown = held + char
            if grown in CONTRACTIONS:
                return (START, EMPTY, ""), self.read(EMPTY, grown.encode())[1] - self.pending(held)
            if any(c.startswith(grown) for c in CONTRACTIONS):
                return (QUOTE, EMPTY, grown), self.pending(grown) - self.pending(held)
            # No contraction: the quote is a pre-token, what follows it are letters.
            after, n = self.read(EMPTY, grown[1:].encode("utf-8", "surrogatepass"))
            return (IN_LETTERS, after, ""), 1 + n - self.pending(held)
        if mode == QUOTE and kind == OTHER and held == "'":
            after, n = self.read(EMPTY, b"'" + data)
            return (IN_OTHERS, after, ""), n - self.pending(held)
        if kind == SPACE:
            if mode == IN_WHITE:
                after, n = self.read(open_, held.encode())
                return (IN_WHITE, after, char), n
            return (IN_WHITE, EMPTY, char), 0
        new = (IN_LETTERS, IN_NUMBERS, None, IN_OTHERS)[kind]
        if mode == new:
            after, n = self.read(open_, data)
            return (new, after, ""), n
        if mode == IN_WHITE:
            if held == " ":
                after, n = self.read(EMPTY, b" " + data)
                return (new, after, ""), n
            alone = self.read(EMPTY, held.encode())[1]
        else:
            alone = 0
        if char == "'":
            return (QUOTE, EMPTY, "'"), alone + 1
        after, n = self.read(EMPTY, data)
        return (new, after, ""), alone + n

    def pending(self, held: str) -> int:
        """Tokens counted for a quote and the letters after it while they may become a contraction."""
        return 1 + (self.read(EMPTY, held[1:].encode())[1] if len(held) > 1 else 0)

    def ending(self, state: int) -> int:
        """Tokens that the end of the text adds."""
        mode, open_, held = unpacked(self.states[state])
        return self.read(open_, held.encode())[1] if mode == IN_WHITE else 0

    def step(self, state: int, code: int) -> tuple[int, int]:
        """One transition, compiled if need be."""
        sym = self.symbol[code]
        if sym < 0 and self.symbols < SYMBOLS:
            sym = self.symbol[code] = self.symbols
            self.symbols += 1
        if sym >= 0 and state < STATES:
            nxt = self.next[state, sym]
            if nxt:
                return int(nxt) - 1, int(self.delta[state, sym])
        if (found := self.rare.get((state, code))) is not None:
            return found
        after, change = self.transition(unpacked(self.states[state]), chr(code))
        nxt = self.intern(after)
        if sym >= 0 and state < STATES and -128 <= change < 128:
            self.next[state, sym], self.delta[state, sym] = nxt + 1, change
        else:
            self.rare[state, code] = nxt, change
        return nxt, change

    def run(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and count changes of the lanes codes[begin:end], each from its own state."""
        n = len(begin)
        order = np.argsort(begin - end, kind="stable")
        at, left, now = begin[order].copy(), (end - begin)[order], state[order].astype(np.int64)
        total = np.zeros(n, dtype=np.int64)
        alive = int((left > 0).sum())
        done = 0
        while alive:
            if alive < 24:  # few lanes: one after the other
                for k in range(alive):
                    s, c = int(now[k]), 0
                    for code in codes[at[k] : at[k] + left[k] - done].tolist():
                        s, d = self.step(s, code)
                        c += d
                    now[k] = s
                    total[k] += c
                break
            code = codes[at[:alive]]
            sym = self.symbol[code]
            here = now[:alive]
            known = (sym >= 0) & (here < STATES)
            inside = np.where(known, here, 0)
            nxt = self.next[inside, sym] - 1
            change = self.delta[inside, sym]
            missing = np.flatnonzero(~known | (nxt < 0))
            nxt, change = nxt.astype(np.int64), change.astype(np.int64)
            for k in missing.tolist():
                nxt[k], change[k] = self.step(int(here[k]), int(code[k]))
            now[:alive] = nxt
            total[:alive] += change
            at[:alive] += 1
            done += 1
            while alive and left[alive - 1] <= done:
                alive -= 1
        back = np.empty(n, dtype=np.int64)
        back[order] = np.arange(n)
        return now[back], total[back]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.states) > STATES - 50_000 or len(self.rare) > PAIRS:
            self.reset()
        # Special tokens' strings split the text first and count as one each.
        owner, pieces, found = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.bpe.specials:
                parts = [q for p in parts for q in p.split(s)]
            found[i] = len(parts) - 1
            owner += [i] * len(parts)
            pieces += parts
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        if not len(codes):
            return found
        ends = np.cumsum(lengths)
        starts = ends - lengths
        # Chunks: nominal cuts within each piece.
        per = -(-lengths // CHUNK)
        piece_of = np.repeat(np.arange(len(pieces)), per)
        first = np.cumsum(per) - per
        begin = starts[piece_of] + (np.arange(len(piece_of)) - first[piece_of]) * CHUNK
        end = np.minimum(begin + CHUNK, ends[piece_of])
        # Synchronising places: white space after another character, in the same piece.
        white = self.white(codes)
        sync = np.zeros(len(codes), dtype=bool)
        sync[1:] = white[1:] & ~white[:-1]
        sync[starts[lengths > 0]] = False
        places = np.flatnonzero(sync)
        k = np.searchsorted(places, begin)
        place = np.where(k < len(places), places[np.minimum(k, max(len(places) - 1, 0))] if len(places) else len(codes), len(codes))
        head_end = np.minimum(place, end)
        constant = head_end < end
        # The constant parts, all at once.
        exit_, change = np.full(len(begin), -1, dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        own = np.flatnonzero(constant)
        if len(own):
            enter = {c: self.intern((IN_WHITE, EMPTY, chr(c))) for c in np.unique(codes[head_end[own]]).tolist()}
            enter_at = np.array([enter[c] for c in codes[head_end[own]].tolist()], dtype=np.int64)
            exit_[own], change[own] = self.run(codes, head_end[own] + 1, end[own], enter_at)
        # Heads: run at the state before them where it is known, else at the one that a few characters lead to.
        opening = np.arange(len(begin)) == first[piece_of]
        entry = np.where(opening, self.start, np.roll(exit_, 1))
        guess = np.flatnonzero(entry < 0)
        if len(guess):
            lead = np.maximum(begin[guess] - LEAD, starts[piece_of[guess]])
            entry[guess], _ = self.run(codes, lead, begin[guess], np.full(len(guess), self.start))
        heads, todo = np.zeros(len(begin), dtype=np.int64), np.arange(len(begin))
        self.rounds = 0
        while len(todo):
            self.rounds += 1
            last, heads[todo] = self.run(codes, begin[todo], head_end[todo], entry[todo])
            open_ = ~constant[todo]
            exit_[todo[open_]] = last[open_]
            before = np.where(opening, self.start, np.roll(exit_, 1))
            todo = np.flatnonzero(before != entry)
            entry[todo] = before[todo]
        change += heads
        total = np.zeros(len(pieces), dtype=np.int64)
        np.add.at(total, piece_of, change)
        closing = np.flatnonzero(lengths > 0)
        total[closing] += np.array([self.ending(int(s)) for s in exit_[first[closing] + per[closing] - 1]], dtype=np.int64)
        for i, n in zip(owner, total.tolist(), strict=True):
            found[i] += n
        return found

    def white(self, codes: np.ndarray) -> np.ndarray:
        table = self.__dict__.get("_white")
        if table is None:
            table = self._white = np.zeros(0x110000, dtype=bool)
            table[[ord(c) for c in WHITE]] = True
        return table[codes]


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """One for each worker process."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"the tokenizer file {path} must lie on every executor")
    return Transducer(path)


def token_counts(df: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of df (doc_id, text).

    Null text counts as empty. Repeated rows give repeated results, null doc_ids stay null, extra columns
    are ignored. Nothing is shuffled.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                texts = [t or "" for t in some.column(1).to_pylist()]
                n = own.counts(texts)
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col("doc_id"), F.col("text")).mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Byte-level BPE encoding and decoding by finite-state machines that are built as texts need them.

Encoding. The merges of a rank file are compiled into a transducer over bytes. It rests on two facts: a row of tokens is the BPE
encoding of its bytes if and only if each pair of neighbours may stand side by side; and so every prefix of a piece has exactly one
last token. A nondeterministic state is a place where a token may begin, with the bytes read since and the token before; a
deterministic state is the set of those that may still go on, and is made when first met. Each byte moves to the next state and tells
the last token of what has been read. Where the tokens before all places that are still open agree, they are certain and are
emitted, so that a piece of any length is encoded with a bounded lookahead. States are forgotten when there are too many.

Decoding. A machine whose state is the unfinished bytes of a character (three at most) reads tokens, one by one or in blocks, and emits whole
characters, so that ids can be decoded as they arrive, wherever tokens or blocks cut characters.

Defined results: null and empty texts have no ids; ids of no token make bytes and text null, no ids make both empty; bytes that are no
UTF-8 become U+FFFD in the text and stay in the bytes; texts of any length are read piece by piece; rows are independent of one
another, so ties, repeated rows, empty tables and other columns change nothing, and columns named as the results are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_only, remembers, small_batches


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank a line."""
    import base64

    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


#: Bits of a token in a place.
BITS, MASK = 32, (1 << 32) - 1


class State(dict):
    """A deterministic state: the next state by byte, made when first asked for.

    places holds where a token may have begun, each as the node of what has been read since, and below BITS the token before, counted from 1;
    last is the last token of all that has been read.
    """

    __slots__ = ("machine", "places", "last")

    def __init__(self, machine: Transducer, places: tuple[int, ...]) -> None:
        super().__init__()
        self.machine, self.places, self.last = machine, places, places[-1] - 1

    def __missing__(self, byte: int) -> State:
        self[byte] = state = self.machine.after(self, byte)
        return state


class Transducer:
    """Deterministic transducer from the bytes of one piece to token ids."""

    #: Most deterministic states, and most pairs of tokens, that are remembered; bytes read before certain tokens are emitted.
    STATES, PAIRS, LOOKAHEAD = 200_000, 300_000, 1024

    def __init__(self, ranks: dict[bytes, int]) -> None:
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"the vocabulary lacks the single bytes {lacking}")
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        #: The tree of what tokens begin with: child by node and byte; of each node its token or -1, its depth, and whether it has children.
        self.child: dict[int, int] = {}
        self.token, self.depth, self.inner = [-1], [0], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.child.setdefault(node << 8 | byte, len(self.token))
                if below == len(self.token):
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = below
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.states: dict[tuple, State] = {}
        self._forget()

    def _forget(self) -> None:
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.start = self._state((0,))

    def _state(self, places: tuple) -> State:
        found = self.states.get(places)
        if found is None:
            found = self.states[places] = State(self, places)
        return found

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes token, by definition: the leftmost pair of least rank is merged again and again."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, len(self.ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                raise ValueError(f"no merges make the token {token!r}")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) edge of token while it is merged, with the rank of the merge that ends it."""
        found = self.edges[side].get(token)
        if found is None:
            if token not in self.halves:
                self.halves[token] = self._halves(token)
            half = self.halves[token]
            inner = self._edge(half[side], side)[:-1] + [(half[side], self.ranks[token])] if half else []
            found = self.edges[side][token] = [*inner, (token, len(self.ranks))]
        return found

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether token can stand behind before: no merge across their border comes before the merges that build both.

        Merges go by rank, and of equal ones from left to right.
        """
        pair = before << 32 | token
        found = self.pairs.get(pair)
        if found is None:
            left, right, i, j, found = self._edge(self.tokens[before], 1), self._edge(self.tokens[token], 0), 0, 0, True
            while found and (i < len(left) and j < len(right)):
                (a, a_ends), (b, b_ends) = left[i], right[j]
                across = self.ranks.get(a + b, len(self.ranks))
                found = not (across < a_ends and across <= b_ends and across < len(self.ranks))
                i, j = (i + 1, j) if a_ends <= b_ends else (i, j + 1)
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            self.pairs[pair] = found
        return found

    def after(self, state: State, byte: int) -> State:
        """The state after one more byte; where the memory is full all others are forgotten."""
        going, ended, child = [], -1, self.child.get
        for place in state.places:
            node = child(place >> BITS << 8 | byte)
            if node is None:
                continue
            before = place & MASK
            if ended < 0 and (token := self.token[node]) >= 0 and (not before or self._may_follow(before - 1, token)):
                ended = token
            if self.inner[node]:
                going.append(node << BITS | before)
        if ended < 0:
            raise ValueError("the vocabulary holds tokens that its merges do not make")
        going.append(ended + 1)
        if len(self.states) >= self.STATES:
            self._forget()
        return self._state(tuple(going))

    def _back(self, last: list[int], end: int) -> list[int]:
        """Tokens before end."""
        out, length = [], self.length
        while end:
            token = last[end - 1]
            out.append(token)
            end -= length[token]
        return out[::-1]

    def _certain(self, state: State, last: list[int]) -> int:
        """How many bytes' tokens no further byte can change: up to where the ways back from all open places have met."""

        def way(end: int) -> Iterator[int]:
            while end:
                yield end
                end -= self.length[last[end - 1]]

        places = [len(last) - self.depth[place >> BITS] for place in state.places]
        first = {*way(places[0])}
        return min(next((end for end in way(place) if end in first), 0) for place in places)

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of the bytes of one piece, emitted as they become certain."""
        state, last, room = self.start, [], self.LOOKAHEAD
        for byte in data:
            state = state[byte]
            last.append(state.last)
            if len(last) == room:
                sure = self._certain(state, last)
                yield from self._back(last, sure)
                del last[:sure]
                room = len(last) + self.LOOKAHEAD
        yield from self._back(last, len(last))

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece; a short one is read whole before its tokens are told."""
        if len(data) > self.LOOKAHEAD:
            return [*self.stream(data)]
        state, last = self.start, []
        for byte in data:
            state = state[byte]
            last.append(state.last)
        return self._back(last, len(last))


#: All characters of white space but the blank and the end of a line.
OTHER_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


class Encoder:
    """Whole texts: each match of the pattern by itself, a piece that is a token being that token.

    A blank between two characters that are not blank begins a piece with patterns that let a piece begin with a blank but not hold one; with
    such a pattern (apart is true) texts are cut there, and the ids of what lies between are remembered.
    """

    #: Most stretches whose ids are remembered, the most characters of such a stretch, and of a text that is cut at one go.
    KEPT, LONG, WHOLE = 900_000, 48, 1 << 20

    def __init__(self, ranks: dict[bytes, int], pattern: str, apart: bool) -> None:
        import regex

        self.transducer, self.pieces, self.apart, self.known = Transducer(ranks), regex.compile(pattern), apart, {}
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.letters = r"\p{L}+" in pattern  # as in the public files' pattern

    def _pieces(self, text: str) -> bytes:
        ranks, encode, ids = self.transducer.ranks, self.transducer.encode, []
        for match in self.pieces.finditer(text):
            data = match[0].encode()
            whole = ranks.get(data)
            if whole is None:
                ids += encode(data)
            else:
                ids.append(whole)
        return array("i", ids).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        """Ids of a stretch and the blank before it; letters alone are one piece."""
        if stretch.isalpha() and self.letters:
            data = b" " + stretch.encode()
            whole = self.transducer.ranks.get(data)
            return array("i", self.transducer.encode(data) if whole is None else (whole,)).tobytes()
        return self._pieces(" " + stretch)

    def _cut(self, text: str) -> list[str]:
        """text cut at blanks of the kind above; plain splitting does that where no blank has another one at its side."""
        if any(pair in text for pair in ("  ", " \n", "\n ")) or any(c in text for c in OTHER_BLANKS):
            return self.cut.split(text)
        return text.split(" ")

    def _parts(self, text: str) -> Iterator[str]:
        """text cut at blanks of the kind above, long texts bit by bit."""
        at = 0
        for match in self.cut.finditer(text):
            yield text[at : match.start()]
            at = match.end()
        yield text[at:]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit integers in the machine's order.

        What is new in the texts is encoded first, in order, so that one stretch after the other passes through much the same states. Long texts
        are taken bit by bit and never held as a list of stretches.
        """
        cut = [self._cut(t) if t and self.apart and len(t) <= self.WHOLE else None for t in texts]
        new = {s for parts in cut if parts for s in parts[1:]}.difference(self.known)
        if len(self.known) + len(new) > self.KEPT:
            self.known.clear()
            new = {s for parts in cut if parts for s in parts[1:]}
        known = self.known
        for s in sorted(new):
            known[s] = self._stretch(s)
        out = [self._long(t) if parts is None else self._pieces(parts[0]) + b"".join([known[s] for s in parts[1:]]) for t, parts in zip(texts, cut, strict=True)]
        for s in [s for s in new if len(s) > self.LONG]:
            del known[s]
        return out

    def _long(self, text: str | None) -> bytes:
        if not text or not self.apart:
            return self._pieces(text or "")
        parts = self._parts(text)
        first = self._pieces(next(parts))
        return first + b"".join(self.known.get(s) or self._stretch(s) for s in parts)


class Utf8Machine(dict):
    """A state of decoding: (characters that are whole now, next state) by token; the unfinished bytes of a character tell states apart."""

    #: Tokens that decode() puts together at one go.
    BLOCK = 4096

    def __init__(self, tokens: dict[int, bytes], rest: bytes = b"", states: dict[bytes, Utf8Machine] | None = None) -> None:
        super().__init__()
        self.tokens, self.rest, self.states = tokens, rest, {} if states is None else states
        self.states[rest] = self

    def __missing__(self, token: int) -> tuple[str, Utf8Machine]:
        import codecs

        machine = codecs.getincrementaldecoder("utf-8")("replace")
        machine.setstate((self.rest, 0))
        characters = machine.decode(self.tokens[token])
        rest = machine.getstate()[0]
        after = self.states[rest] if rest in self.states else Utf8Machine(self.tokens, rest, self.states)
        self[token] = move = (characters, after)
        return move

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Characters, as soon as they are whole; unfinished bytes at the end are one U+FFFD."""
        state = self
        for token in ids:
            characters, state = state[token]
            yield characters
        if state.rest:
            yield "�"

    def decode(self, ids: list[int]) -> tuple[bytes, str]:
        """Bytes and text of all ids, BLOCK tokens at a time; a character that a block's end cuts waits for the next block."""
        import codecs

        machine, token, data, out = codecs.getincrementaldecoder("utf-8")("replace"), self.tokens.__getitem__, [], []
        for k in range(0, len(ids), self.BLOCK):
            data.append(b"".join(map(token, ids[k : k + self.BLOCK])))
            out.append(machine.decode(data[-1]))
        return b"".join(data), "".join(out) + machine.decode(b"", True)


#: Of this Python worker, by vocabulary file.
_encoders: dict[tuple[str, str], Encoder] = {}
_machines: dict[str, Utf8Machine] = {}
remembers("merges", _encoders.clear)
remembers("characters", _machines.clear)


@cache
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


def _place(vocabulary: str) -> str:
    """A path as it is; a mere name is that of a public vocabulary file on this machine."""
    import public_tokenizers

    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def ids_of(text: Column, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> Column:
    """array<int>: ids of each whole text by a rank file, without special tokens; the pattern is that of the public files.

    It is marked as if it were not deterministic, so that Spark computes it once where the ids are used more than once.
    """

    def encode(texts):
        import numpy as np
        import public_tokenizers
        import pyarrow as pa

        key = (vocabulary, pattern or public_tokenizers.PATTERN)
        if key not in _encoders:
            keep_only("")
            _encoders[key] = Encoder(_ranks(_place(vocabulary)), key[1], apart=pattern is None)
        coder = _encoders[key]
        rows = coder.encode_all(texts.to_pylist())
        offsets = np.cumsum([0, *(len(r) // 4 for r in rows)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "i4"), pa.int32()))

    return F.arrow_udf(encode, "array<int>").asNondeterministic()(text)


def text_of(ids: Column, vocabulary: str = "byte_bpe_50k.tiktoken") -> Column:
    """struct<bytes: binary, text: string> of each array of ids."""

    @F.arrow_udf("bytes binary, text string")
    def decode(rows):
        import pyarrow as pa

        if vocabulary not in _machines:
            _machines[vocabulary] = Utf8Machine({i: t for t, i in _ranks(_place(vocabulary)).items()})
        machine, data, texts = _machines[vocabulary], [], []
        for row in rows:
            ids = row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else None
            try:
                raw, text = (None, None) if ids is None else machine.decode(ids)
            except KeyError:  # an id of no token
                raw, text = None, None
            data.append(raw)
            texts.append(text)
        return pa.StructArray.from_arrays([pa.array(data, pa.binary()), pa.array(texts, pa.string())], names=["bytes", "text"])

    return decode(ids)


def encoded(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """docs with ids."""
    small_batches(docs.sparkSession)
    return docs.withColumn("ids", ids_of(F.col(text), vocabulary, pattern))


def decoded(tokens: DataFrame, ids: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """tokens with bytes and text."""
    small_batches(tokens.sparkSession)
    out = tokens.withColumn("_decoded", text_of(F.col(ids), vocabulary))
    return out.withColumns({"bytes": F.col("_decoded.bytes"), "text": F.col("_decoded.text")}).drop("_decoded")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, and the number of characters that decoding emits."""
    back = decoded(encoded(docs.select("doc_id", "text")).drop("text"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), F.length("text").cast("long").alias("n_chars"))

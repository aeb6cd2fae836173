"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import HELD, trim, tune

#: Pieces longer than this many characters are not memoised; the transducer streams over them.
MEMO_CHARS = 48
#: Bounds of the tables. Pieces met again have a dictionary, whose last generation stays until as many new ones have come;
#: pieces met once, and what is known of pairs, have one slot each by their hash, which the next one of that slot takes over.
MEMO_PIECES = 60_000
RARE_SLOTS = 1 << 18
PAIR_SLOTS = 500_009
MAX_STATES = 60_000
#: Bytes of a piece that the transducer reads before it looks, and looks again, for tokens to give out.
SETTLE = 4096
#: The rank of what is no token.
NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _merges(ranks: dict[bytes, int], text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Plain BPE of a short string, merge by merge: the rank of the next one and the parts before it; at last NONE and the parts that stay."""
    of = ranks.get
    parts = [text[i : i + 1] for i in range(len(text))]
    joins = [of(text[i : i + 2], NONE) for i in range(len(text) - 1)]
    while joins and (rank := min(joins)) != NONE:
        yield rank, parts
        at = joins.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del joins[at]
        if at:
            joins[at - 1] = of(parts[at - 1] + parts[at], NONE)
        if at < len(joins):
            joins[at] = of(parts[at] + parts[at + 1], NONE)
    yield NONE, parts


def merge_by_rank(ranks: dict[bytes, int], text: bytes) -> list[int]:
    """Plain BPE of a short string: join the adjacent pair of lowest rank, leftmost first, until none can be joined."""
    *_, (_, parts) = _merges(ranks, text)
    return [ranks[p] for p in parts]


class _State:
    """The positions from which a token may be under way, as one string: the longest end of what was read that begins a token.

    ends: (size, token) of the tokens of two bytes and more that end here, longest first. byte: the token of the last byte.
    """

    __slots__ = ("byte", "ends", "next", "suffix")

    def __init__(self, suffix: bytes, ends: tuple[tuple[int, int], ...], byte: int | None):
        self.suffix, self.ends, self.byte = suffix, ends, byte
        self.next: dict[int, _State] = {}


class Transducer:
    """Merge ranks compiled into a transducer over bytes, determinised as texts need it.

    A sequence of tokens is the BPE encoding of its bytes exactly if each token and each adjacent pair of
    tokens encodes to itself: merges inside two neighbours run in the same order with or without the rest.
    So each prefix of a text has one last token: of those that end there, the one that stays as it is behind the
    last token of the prefix before it. A state is the set of positions from which a token may be under way, and
    names the tokens that may end; which of them does is read off the pairs, and the last one left needs no look.
    From time to time the tokens are given out that all positions lead back to, so beside the ids memory does not
    grow with a piece's length. When MAX_STATES are held, all are dropped and made anew as they are met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.starts = {token[:n] for token in ranks for n in range(1, len(token))}
        self.pairs = array("q", [-1]) * PAIR_SLOTS  # twice a key, and one more if it is stable
        self.edges: dict[int, tuple[tuple[int, ...], tuple[bytes, ...], tuple[bytes, ...]]] = {}
        self.states: dict[bytes, _State] = {}
        self._reset()

    def _reset(self) -> None:
        for state in self.states.values():  # states lead to each other
            state.next.clear()
        self.states = {}
        self.start = _State(b"", (), None)

    def _edges(self, token: int) -> tuple[tuple[int, ...], tuple[bytes, ...], tuple[bytes, ...]]:
        """Of the merges that make a token: their ranks, and the first and the last part before each."""
        steps = [(rank, parts[0], parts[-1]) for rank, parts in _merges(self.ranks, self.tokens[token])]
        made = self.edges[token] = tuple(zip(*steps, strict=True))
        return made

    def _stable(self, key: int) -> bool:
        """Whether two tokens stay as they are: no merge across their border comes first while both are made; not in self.pairs."""
        left_ranks, _, left = self.edges.get(key >> 32) or self._edges(key >> 32)
        right_ranks, right, _ = self.edges.get(key & 0xFFFFFFFF) or self._edges(key & 0xFFFFFFFF)
        of, i, j = self.ranks.get, 0, 0
        while True:
            across, one, two = of(left[i] + right[j], NONE), left_ranks[i], right_ranks[j]
            known = across >= one or across > two  # of equal ranks the leftmost is merged
            if not known or one == two == NONE:
                break
            if one <= two:
                i += 1
            else:
                j += 1
        self.pairs[key % len(self.pairs)] = key << 1 | known
        return known

    def _step(self, state: _State, byte: int) -> _State:
        """The state after one more byte."""
        suffix, ranks = state.suffix + bytes((byte,)), self.ranks
        while len(suffix) > 1 and suffix not in self.starts and suffix not in ranks:
            suffix = suffix[1:]
        got = self.states.get(suffix)
        if got is None:
            if len(self.states) >= MAX_STATES:
                self._reset()
            parts = [suffix[at:] for at in range(len(suffix) - 1)]
            ends = tuple((len(part), ranks[part]) for part in parts if part in ranks and merge_by_rank(ranks, part) == [ranks[part]])
            got = self.states[suffix] = _State(suffix, ends, ranks[suffix[-1:]])
        state.next[byte] = got
        return got

    def _back(self, last: list[int], end: int) -> list[int]:
        """The tokens that lead to a position."""
        out = []
        while end:
            out.append(last[end])
            end -= self.sizes[last[end]]
        return out[::-1]

    def _settled(self, last: list[int], live: int) -> int:
        """The farthest position that the end and the `live` positions before it all lead back to."""
        ends = set(range(len(last) - 1 - live, len(last)))
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - self.sizes[last[end]])
        return ends.pop()

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece of text."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, last, pairs, slots, at = self.start, [-1], self.pairs, len(self.pairs), 0
        while at < len(data):
            room = max(SETTLE, len(last))
            for byte in data[at : at + room]:
                state = state.next.get(byte) or self._step(state, byte)
                for size, token in state.ends:
                    before = last[-size]
                    if before < 0:  # the piece begins with it
                        break
                    key = before << 32 | token
                    slot = pairs[key % slots]
                    if slot & 1 if slot >> 1 == key else self._stable(key):
                        break
                else:
                    token = state.byte
                last.append(token)
            at += room
            if at < len(data):
                end = self._settled(last, len(state.suffix))
                out += self._back(last, end)
                del last[:end]
        return out + self._back(last, len(last) - 1)


class Encoder:
    """Whole texts to ids: the pattern's matches, each encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern, regex.V0).finditer
        self.all = regex.compile(pattern, regex.V0).findall
        self.memo: dict[str, str] = {}
        self.old_memo: dict[str, str] = {}
        self.rare: list[bytes] = [b""] * RARE_SLOTS  # UTF-8 of a piece, a byte that UTF-8 never has, ids

    def _piece(self, piece: str) -> str:
        ids = self.old_memo.get(piece)
        if ids is None:
            data = piece.encode()
            if len(piece) > MEMO_CHARS:
                return ",".join(map(str, self.transducer.encode(data)))
            at, own = hash(piece) % RARE_SLOTS, data + b"\xff"
            held = self.rare[at]
            if not held.startswith(own):
                ids = ",".join(map(str, self.transducer.encode(data)))
                self.rare[at] = own + ids.encode()
                return ids
            ids = held[len(own) :].decode()
        if len(self.memo) >= MEMO_PIECES:
            self.old_memo, self.memo = self.memo, {}
        self.memo[piece] = ids
        return ids

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by commas."""
        memo, piece = self.memo.get, self._piece  # of the generation at the start of the text
        return ",".join([memo(p) or piece(p) for p in self.all(text)])

    def encode(self, text: str) -> list[int]:
        return list(map(int, joined.split(","))) if (joined := self.encode_joined(text)) else []


class Utf8Stream:
    """Incremental UTF-8: push() gives the text of all characters that are complete; a split one waits for its rest.

    The state is the number of bytes that the last lead byte still asks for. Bytes that cannot be part of
    a character become U+FFFD, as in whole-text decoding with replacement.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many last bytes begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if byte & 0xF0 == 0xE0 else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need <= back:
                return 0
            second = data[-back + 1] if back > 1 else None
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            return back if second is None or low <= second <= high else 0
        return 0

    def push(self, data: bytes) -> str:
        data = self.held + data
        n = self._open(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(tokens: dict, ids: Iterable, chunk: int = 4096) -> Iterator[str]:
    """The text of ids, piece by piece, in bounded memory."""
    stream, rest = Utf8Stream(), map(tokens.__getitem__, ids)
    while part := b"".join(islice(rest, chunk)):
        yield stream.push(part)
    yield stream.close()


def _on_worker(ranks_bytes, pattern: str) -> tuple[Encoder, dict[str, bytes]]:
    """One encoder for a worker, until another operator's task comes."""
    held = HELD.setdefault("bpe", {})
    key = (ranks_bytes.id if hasattr(ranks_bytes, "id") else id(ranks_bytes), pattern)
    if key not in held:
        held.clear()
        trim("bpe")
        gc.set_threshold(200_000, 50, 1000)  # tables of many small objects that last
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks_bytes.value.splitlines())}
        held[key] = Encoder(ranks, pattern), {str(r): t for t, r in ranks.items()}
    return held[key]


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """docs' columns but text, then n_tokens, token_ids (array<int>, unless ids is False), ids_sha256, decoded_sha256.

    path: a rank file, read on the driver and broadcast (its size does not depend on the data). A null text
    counts as empty: no tokens and the digests of nothing. Every text is encoded whole and then decoded from
    its ids by the streaming decoder; rows are independent, so ties, repeated rows and skew have no effect.
    Columns of docs that have the name of a new one are replaced.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    new = ["n_tokens", *["token_ids"] * ids, "ids_sha256", "decoded_sha256"]
    others = [c for c in docs.columns if c != text and c not in new]

    def run(batches):
        import pyarrow as pa

        encoder, tokens = _on_worker(shipped, pattern)
        for batch in batches:
            counts, flat, one, two = [], array("i"), [], []
            for value in batch.column(batch.num_columns - 1):
                joined = encoder.encode_joined(value.as_py() or "")
                parts = joined.split(",") if joined else []
                digest = hashlib.sha256()
                for piece in decode_stream(tokens, parts):
                    digest.update(piece.encode())
                counts.append(len(parts))
                one.append(hashlib.sha256(joined.encode()).hexdigest())
                two.append(digest.hexdigest())
                if ids:
                    flat.extend(map(int, parts))
            made = [pa.array(counts, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            if ids:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                made.insert(1, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[f"c{i}" for i in range(len(others))] + new)

    kinds = ["long", *["array<int>"] * ids, "string", "string"]
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(text).alias("__text"))
    schema = ", ".join([f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(others))] + [f"{n} {k}" for n, k in zip(new, kinds, strict=True)])
    return source.mapInArrow(run, schema).toDF(*others, *new)


def public_ranks() -> tuple[str, str]:
    """The multilingual rank file and the pattern of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) with the public multilingual ranks."""
    return bpe_encode(docs.select("doc_id", "text"), *public_ranks(), ids=False)

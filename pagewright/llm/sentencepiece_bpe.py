"""SentencePiece merge-type encoding by backtracking, and decoding.

The library merges the best-scored adjacent pair again and again.  The same
segmentation is found here from left to right: at each place take the longest
piece (an Aho-Corasick automaton lists the pieces at every place) that is
compatible with the piece before it.  Two adjacent pieces are compatible if
merging their joint text by the rules gives just these two; a sequence whose
neighbours are all compatible is the one the merges make, for the first merge
across a boundary would also happen in the text of the two pieces beside it.
Where no piece fits, the place is marked in a bitfield of failed positions and
the piece before is shortened.

No piece holds the space mark after another character, so no merge crosses the
start of a space run and the chunks between are encoded apart; so are Latin
letters and other signs, if no piece joins them. Frequent chunks are kept in a bounded table.  All of a text is encoded, whatever its length.

Nulls and odd inputs: a null text is an empty one and has no ids; a lone space
mark in the text counts as a space, as in the library; characters without a
piece become byte pieces; an empty table gives no rows; equal texts give equal
rows.  Input columns other than id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Sequence
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

MARK = "▁"
#: Bounds of a worker's tables: chunks kept and their length, pairs kept.
CHUNKS, CHUNK_CHARS, PAIRS = 150_000, 48, 400_000
#: A character without a piece is the symbol LONE + its code point; a pair of symbols is left << SHIFT | right.
LONE, SHIFT = 1 << 21, 22
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


class Model:
    """Pieces of a merge-type model with byte fallback, identity normaliser and space prefix."""

    def __init__(self, proto: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        probe = " a  ①ﬁ\n\té "
        if lib.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models with an identity normaliser and a space prefix are supported")
        n = lib.vocab_size()
        self.byte_id, self.rank, self.id, self.bytes = {}, {}, {}, []
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif lib.is_unknown(i):
                self.bytes.append(" ⁇ ".encode())
            elif lib.is_control(i):
                self.bytes.append(b"")
            else:
                if lib.is_unused(i):
                    raise ValueError("models with unused pieces are not supported")
                self.rank[piece], self.id[piece] = lib.get_score(i), i
                self.bytes.append(piece.replace(MARK, " ").encode())
        #: Control and unknown ids: they end a run of byte pieces without a trace.
        self.apart = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i)}
        self.is_byte = [lib.is_byte(i) for i in range(n)]
        if len(self.byte_id) != 256:
            raise ValueError("byte pieces are missing")
        if max(map(len, self.rank)) > 32 or n > LONE:
            raise ValueError("a piece is too long, or there are too many")
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece crosses the start of a space run")
        # where no piece joins a Latin letter to another sign, the edges between them are boundaries too
        inner = [p.lstrip(MARK) for p in self.rank]
        joined = any(re.search(f"[{LATIN}]", p) and re.search(f"[^{LATIN}]", p) for p in inner)
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if joined else f"{MARK}*[{LATIN}]+|{MARK}*[^{MARK}{LATIN}]+|{MARK}+")
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            self.automaton.add_word(piece, self.id[piece] << 5 | len(piece) - 1)
        self.automaton.make_automaton()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.sizes = list(map(len, self.pieces))
        self.pairs: dict[int, bool] = {}
        self.made: dict[str, tuple[float, str, str] | None] = {}
        self.shorter: dict[int, int] = {}
        self.chunks: dict[str, array] = {}
        self.older: dict[str, array] = {}

    def merge(self, text: str) -> list[str]:
        """The library's rule on a short text: best score first, leftmost among equals."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def last_merge(self, piece: str) -> tuple[float, str, str] | None:
        """When the piece is made, as minus its score, and of what; None if the rules never make it."""
        found = self.made.get(piece, 0)
        if found == 0:
            if len(piece) == 1:
                found = (float("-inf"), "", "")
            else:
                # a piece's own score comes last among those inside it, so its halves are what is left without it
                score = self.rank.pop(piece)
                halves = self.merge(piece)
                self.rank[piece] = score
                found = (-score, halves[0], halves[1]) if len(halves) == 2 else None
            if found and self.merge(piece) != [piece]:
                found = None
            self.made[piece] = found
        return found

    def remerged(self, left: str, right: str) -> bool:
        """Whether the merges of the joint text leave the two pieces apart, by doing them all."""
        return self.merge(left + right) == ([left, right] if left else [right])

    def compatible(self, left: str, right: str) -> bool:
        """remerged(), by replaying only the merges beside the boundary, the latest first.

        While two symbols meet at the boundary, merging them is possible until
        one of them grows; if their joint piece comes before that, they do not
        stay apart.  Pieces of space marks alone tie with one another, so for
        them all merges are done.
        """
        if left[-1:] == MARK:
            return self.remerged(left, right)
        last = self.last_merge
        if last(right) is None or left and last(left) is None:
            return False
        until, from_left, rank = float("inf"), False, self.rank
        while left:
            score = rank.get(left + right)
            if score is not None and (-score < until or -score == until and not from_left):
                return False
            a, b = last(left), last(right)
            if a[0] > b[0]:
                until, from_left, left = a[0], True, a[2]
            elif b[1]:
                until, from_left, right = b[0], False, b[1]
            else:
                return True
        return True

    def name(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol < LONE else chr(symbol - LONE)

    def pair_fits(self, left: int, right: int) -> bool:
        """compatible() of two symbols, kept in a bounded table; left may be -1 for the start."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left << SHIFT | right] = self.compatible(self.name(left) if left >= 0 else "", self.name(right))
        return found

    def shorten(self, symbol: int) -> int:
        """The longest piece that begins this one, else its first character; -1 where nothing is shorter."""
        piece, found = self.name(symbol), -1
        for n in range(len(piece) - 1, 0, -1):
            found = self.id.get(piece[:n], -1)
            if found >= 0:
                break
            if n == 1:
                found = LONE + ord(piece[0])
        self.shorter[symbol] = found
        return found

    def segment(self, text: str) -> list[int]:
        """Symbols (ids, or LONE + a character without a piece) of a text without a boundary inside."""
        n = len(text)
        longest = [-1] * n
        for end, value in self.automaton.iter(text):  # by end, so the longest match of a start comes last
            longest[end - (value & 31)] = value >> 5
        if -1 in longest:
            longest = [LONE + ord(c) if i < 0 else i for i, c in zip(longest, text, strict=True)]
        known, shorter, sizes = self.pairs, self.shorter, self.sizes
        failed, any_failed = bytearray(n // 8 + 1), False
        out: list[int] = []
        at, before, symbol = 0, -1, longest[0] if n else -1
        while at < n:
            while symbol >= 0:
                fits = known.get(before << SHIFT | symbol)
                if fits is None:
                    fits = self.pair_fits(before, symbol)
                if fits:
                    end = at + (sizes[symbol] if symbol < LONE else 1)
                    if not (any_failed and failed[end >> 3] & (1 << (end & 7))):
                        break
                symbol = shorter[symbol] if symbol in shorter else self.shorten(symbol)
            if symbol >= 0:
                out.append(symbol)
                before, at = symbol, end
                if at < n:
                    symbol = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                symbol = out.pop()
                at -= sizes[symbol] if symbol < LONE else 1
                before = out[-1] if out else -1
                symbol = shorter[symbol] if symbol in shorter else self.shorten(symbol)
        return out

    def ids_of(self, chunk: str) -> list[int]:
        ids = self.segment(chunk)
        if ids and max(ids) >= LONE:
            ids = [i for s in ids for i in ([s] if s < LONE else [self.byte_id[b] for b in chr(s - LONE).encode()])]
        return ids

    def split(self, text: str) -> list[str]:
        """Chunks of the marked text; no merge crosses from one to the next."""
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> array:
        """Ids of a whole text."""
        out = array("i")
        if len(self.chunks) >= CHUNKS:  # chunks used since the last change of tables stay
            self.chunks, self.older = {}, self.chunks
        chunks, older = self.chunks, self.older
        for chunk in self.split(text):
            ids = chunks.get(chunk)
            if ids is None:
                ids = older.get(chunk) or array("i", self.ids_of(chunk))
                if len(chunk) <= CHUNK_CHARS and len(chunks) < 2 * CHUNKS:
                    chunks[chunk] = ids
            out += ids
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """As the library: the prefix space goes, byte pieces are read as UTF-8, an invalid byte becomes U+FFFD."""
        table = self.bytes
        try:
            text = b"".join(map(table.__getitem__, ids)).decode() if self.apart.isdisjoint(ids) else self._decode_runs(ids)
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        first = next((i for i in ids if table[i]), 0)
        return text[1:] if self.pieces[first][:1] == MARK else text

    def _decode_runs(self, ids: Sequence[int]) -> str:
        """Byte pieces side by side are read together; any other piece ends their run."""
        out, run = [], bytearray()

        def flush() -> None:
            data, at = bytes(run), 0
            while at < len(data):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(data[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.bytes[i]
            else:
                flush()
                out.append(self.bytes[i].decode())
        flush()
        return "".join(out)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, *, ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, (ids array<int>) of every whole text.

    ids_sha256 is of the ids in decimal joined by commas, decoded_sha256 of what
    the ids decode to, in UTF-8.
    """

    def make():
        own = Model(model)
        digits = [str(i) for i in range(len(own.pieces))]
        gc.disable()  # the tables are large and hold no cycles

        def work(batch):
            rows = [own.encode(t.as_py() or "") for t in batch.column(1)]
            out = {
                doc_id: batch.column(0),
                "n_tokens": [len(r) for r in rows],
                "ids_sha256": [hashlib.sha256(",".join([digits[i] for i in r]).encode()).hexdigest() for r in rows],
                "decoded_sha256": [hashlib.sha256(own.decode(r).encode()).hexdigest() for r in rows],
            }
            if ids:
                ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
                every = array("i")
                for r in rows:
                    every += r
                out["ids"] = pa.ListArray.from_arrays(ends, pa.array(every, pa.int32()))
            return out

        return work

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return by_batch(docs.select(doc_id, F.col(text).cast("string").alias("text")), make, schema)

"""SentencePiece BPE encoding and decoding by a table of last tokens.

In a merge-type (BPE) encoding each prefix of a text has exactly one last token, as any run
of neighbouring tokens is itself the encoding of the characters it covers. So the table is
filled from left to right: an automaton names the pieces that end at a place, and the one
that holds is the one whose pair with the last token of the prefix before it is compatible,
that is, the two together encode to just these two. Ids are then recovered from the end.
Each place costs as many tests as pieces end there; no merges are replayed over a text.
Units (words with the spaces before them) that are not known yet are encoded side by side, a character of each at a time;
long ones, those with a character that the model lacks, and a few alone one by one.

Rows: null and empty texts have no ids and decode to an empty text. Every row gives a row, also
repeated ones. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almoner.llm.common import Remembered, map_batches, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PAIRS_KEPT = 100_000
UNITS_KEPT = 250_000
STATES_KEPT = 100_000
STEPS_KEPT = 200_000
LONGEST_KEPT = 64
# Fresh units below which each is encoded alone, units encoded side by side, and units looked up at once.
FEW, TOGETHER, AT_ONCE = 100, 8192, 50_000
STEP_BITS, PAIR_BITS = 18, 19
SPREAD = 0x9E3779B97F4A7C15
SLICE_CHARS = 1 << 18
# Marks behind a word, that is then looked up without them.
MARKS = ".,;:!?"


class Noted:
    """Whole numbers for keys from 0 on, looked up for an array of keys at once, in a hash table with open places. What is
    missing is worked out key by key; a table that is half full is emptied, so a worker's memory is bounded."""

    def __init__(self, make: Callable[[int], int], bits: int):
        self.make, self.bits = make, bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)
        self.free = 1 << (bits - 1)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(64 - self.bits)).view(np.int64)
        values = self.values[at]
        left, missing = np.flatnonzero(self.keys[at] != keys), []
        while len(left):
            here, wanted = self.keys[at[left]], keys[left]
            met = left[here == wanted]
            values[met] = self.values[at[met]]
            missing += left[here < 0].tolist()
            left = left[(here >= 0) & (here != wanted)]
            at[left] = (at[left] + 1) & len(self.keys) - 1
        for i in missing:
            values[i] = self._note(int(keys[i]))
        return values

    def _note(self, key: int) -> int:
        if not self.free:
            self.keys.fill(-1)
            self.free = len(self.keys) // 2
        at = (key * SPREAD & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[at] != key:
            if self.keys[at] < 0:
                self.values[at] = self.make(key)
                self.keys[at] = key
                self.free -= 1
                break
            at = (at + 1) & len(self.keys) - 1
        return self.values[at]


class Codec:
    """A BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is wanted")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        if any(self.kinds[i] not in (NORMAL, UNKNOWN, CONTROL, BYTE) for i in range(len(self.kinds))):
            raise ValueError("user-defined and unused pieces are not supported")
        # <0xNN>: the id of each byte.
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.lengths = [len(p) for p in self.pieces]
        # The automaton, over pieces as they are in a text: its states are the starts of pieces, its steps are worked out
        # when they are first taken.
        self.in_text = {p.replace(SPACE, " "): i for p, i in self.ids.items() if " " not in p}
        self.starts = {s: i for i, s in enumerate(dict.fromkeys(p[:k] for p in self.in_text for k in range(len(p) + 1)))}
        self.states = Remembered(self._state, STATES_KEPT)
        self.steps = Remembered(self._step, STEPS_KEPT)
        self.size = len(self.pieces)
        self.plain = [p.replace(SPACE, " ") if k == NORMAL else None for p, k in zip(self.pieces, self.kinds)]
        # Places in the order of merges, -1 for what is there before any, and for two neighbours that of their merge.
        places = {score: i for i, score in enumerate(sorted({*self.scores.values()}, reverse=True))}
        self.rank = [places[p.score] if p.type == NORMAL and len(p.piece) > 1 else -1 for p in proto.pieces]
        self.joined = {
            self.ids[piece[:k]] * self.size + self.ids[piece[k:]]: self.rank[i]
            for piece, i in self.ids.items()
            for k in range(1, len(piece))
            if piece[:k] in self.ids and piece[k:] in self.ids
        }
        # Both for many units at once: states are numbers in the order of starts, the first is the empty one; token 0 is
        # none. The longest piece at the end of each state, the next shorter one at the end of each piece.
        self.start_of = list(self.starts)
        self.longest = np.array([self._at_end(s) for s in self.start_of], np.int32)
        self.shorter = np.zeros(self.size, np.int32)
        self.spans = np.zeros(self.size, np.int64)
        for piece, i in self.in_text.items():
            self.shorter[i], self.spans[i] = self._at_end(piece[1:]), len(piece)
        self.next_states = Noted(lambda key: self.starts[self._end_of(self.start_of[key >> 21] + chr(key & 0x1FFFFF))], STEP_BITS)
        self.fitting = Noted(lambda key: not key % self.size or self._compatible(key), PAIR_BITS)
        # Ids as text, behind them those of a unit's last token.
        self.names = [b"%d%b" % (i, end) for end in (b",", b"\n") for i in range(self.size)]
        self.halves = Remembered(self._halves, 2 * self.size + 2)
        self.compatible = Remembered(self._compatible, PAIRS_KEPT)
        self.units = Remembered(self._unit, UNITS_KEPT)
        self.odd = False  # whether a unit was met that does not decode to itself
        # A unit is a run of spaces with the other characters after it; line feeds stand alone.
        # Both cuts need that no piece goes over them. Units keep plain spaces, which takes half the memory of the pieces' sign.
        one_unit = any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.ids)
        self.cut = re.compile("(?s).+" if one_unit else "\n| *[^ \n]+| +")
        # Two characters that stand together in no piece are never merged, so a unit is two there.
        self.touching = {p[i - 1 : i + 1].replace(SPACE, " ") for p in self.ids for i in range(1, len(p))}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The tokens of a piece, and the two parts that were joined last. Best merge first, leftmost among equals."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts, last
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = ["".join(last)]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The tokens that a piece is joined from last (itself twice, if it is one character); None if merges never
        give it."""
        piece = self.pieces[token]
        if len(piece) == 1:
            return token, token
        parts, last = self.merged(piece)
        return tuple(self.ids.get(p, -1) for p in last) if parts == [piece] else None

    def _compatible(self, key: int) -> bool:
        """``key`` is last token * size + next token; a last token of 0 is none or an unknown
        character, with which nothing merges.

        The merges that gave the two tokens are undone from the latest on, along the right edge of the one and the left edge
        of the other; they hold unless at some step the two parts that touch would have been joined earlier."""
        before, token = divmod(key, self.size)
        halves, rank, joined, size = self.halves, self.rank, self.joined, self.size
        if halves[token] is None or not before:
            return halves[token] is not None
        if halves[before] is None:
            return False
        limit = self.size
        while True:
            if before < 0 or token < 0:  # a character that is no piece: nothing knows its merges but replaying them
                pair = [self.pieces[i] for i in divmod(key, size)]
                return self.merged("".join(pair))[0] == pair
            found = joined.get(before * size + token)
            if found is not None and found < limit:
                return False
            if rank[before] > rank[token]:
                limit = rank[before]
                before = halves[before][1]
            elif rank[token] >= 0:
                limit = rank[token] + 1
                token = halves[token][0]
            else:
                return True

    def _state(self, start: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The start of a piece, and the pieces that end with it as token and length, longest first."""
        ends = (start[k:] for k in range(len(start)))
        return start, tuple((self.in_text[e], len(e)) for e in ends if e in self.in_text)

    def _at_end(self, text: str) -> int:
        """The longest piece that a text ends with, 0 for none."""
        return next((self.in_text[text[k:]] for k in range(len(text)) if text[k:] in self.in_text), 0)

    def _end_of(self, read: str) -> str:
        """The longest end of a text that starts a piece."""
        return next(read[k:] for k in range(len(read) + 1) if read[k:] in self.starts)

    def _step(self, read: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The state after a state and one more character: the longest end of both that starts a piece."""
        return self.states[self._end_of(read)]

    def encode_unit(self, text: str) -> list[int]:
        last = [0] * (len(text) + 1)
        size, compatible, steps = self.size, self.compatible, self.steps
        state, end = "", 0
        for char in text:
            state, ending = steps[state + char]
            end += 1
            for token, length in ending:
                if compatible[last[end - length] * size + token]:
                    last[end] = token
                    break
        ids, end = [], len(text)
        while end:
            token = last[end]
            if token:
                ids.append(token)
                end -= self.lengths[token]
            else:  # the only place without a piece: a character that the model lacks
                end -= 1
                ids += [self.byte_ids[b] for b in reversed(text[end].encode())]
        ids.reverse()
        return ids

    def encode_together(self, units: list[str]) -> dict[str, bytes]:
        """The ids as text of units in the order of their lengths. Units with a character that the model lacks are left out,
        and all, if one does not decode to itself."""
        n, size = len(units), self.size
        lengths = np.fromiter(map(len, units), np.int64, n)
        width = int(lengths[-1])
        chars = np.ascontiguousarray(np.array(units, f"<U{width}").view(np.uint32).reshape(n, width).T)
        last = np.zeros((width + 1, n), np.int32)
        table, rows, state, reached = last.reshape(-1), np.arange(n), np.zeros(n, np.int64), 0
        for end, begin in enumerate(np.searchsorted(lengths, np.arange(width), side="right").tolist(), 1):
            state, reached = state[begin - reached :], begin
            state = self.next_states[state << 21 | chars[end - 1, begin:]].astype(np.int64)
            row, token = rows[begin:], self.longest[state]
            while len(row):
                before = table[(end - self.spans[token]) * n + row].astype(np.int64)
                fits = self.fitting[before * size + token] != 0
                last[end, row[fits]] = token[fits]
                row, token = row[~fits], self.shorter[token[~fits]]
        lacking = ((last[1:] == 0) & (np.arange(width)[:, None] < lengths)).any(axis=0)
        row = rows[~lacking]
        end = lengths[row]
        ends = np.zeros((n, width + 1), bool)
        while len(row):
            ends[row, end] = True
            end = end - self.spans[table[end * n + row]]
            row, end = row[end > 0], end[end > 0]
        ids, counts = last.T[ends], ends.sum(axis=1)[~lacking]
        whole = [u for u, without in zip(units, lacking.tolist()) if not without]
        closing = np.cumsum(counts) - 1
        covered = np.diff(np.cumsum(self.spans[ids])[closing], prepend=0)
        if (covered != lengths[~lacking]).any() or "".join(map(self.plain.__getitem__, ids.tolist())) != "".join(whole):
            return {}
        ids[closing] += size
        return dict(zip(whole, b"".join(map(self.names.__getitem__, ids.tolist())).split(b"\n")))

    def decode_pieces(self, ids) -> str:
        """The text of ids with its first space still there."""
        plain = [self.plain[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out, raw = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if self.kinds[i] == NORMAL:
                out.append(self.plain[i])
            elif self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def decode(self, ids) -> str:
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self.decode_pieces(ids)
        spaced = first is not None and self.kinds[first] == NORMAL and text.startswith(" ")
        return text[1:] if self.dummy_prefix and spaced else text

    def _unit(self, unit: str) -> bytes | tuple[bytes, str]:
        """The ids as text; with the decoded text, if that is not the unit."""
        if unit[-1] in MARKS and 1 < len(unit) <= LONGEST_KEPT and unit[-2:] not in self.touching:
            word, mark = self.units[unit[:-1]], self.units[unit[-1]]
            if type(word) is bytes and type(mark) is bytes:
                return word + b"," + mark
        ids = self.encode_unit(unit)
        text, decoded = ",".join(map(str, ids)).encode(), self.decode_pieces(ids)
        if decoded == unit:
            return text
        self.odd = True
        return text, decoded

    def _learn(self, units: set[str]) -> None:
        """Puts units that are not known yet into the table, if they are many enough to be encoded side by side."""
        known, fresh = self.units, []
        for unit in units:
            value = known.older.get(unit)
            if value is not None:
                known[unit] = value
            elif len(unit) <= LONGEST_KEPT:
                fresh.append(unit)
        if len(fresh) < FEW:
            return
        if len(known) + len(fresh) > known.half:
            known.turn()
        fresh.sort(key=len)
        for at in range(0, len(fresh), TOGETHER):
            known.update(self.encode_together(fresh[at : at + TOGETHER]))

    def _looked_up(self, units: list[str]) -> list[bytes | tuple[bytes, str]]:
        known, fresh = self.units, self._unit
        found = list(map(known.get, units))
        missing = [i for i, value in enumerate(found) if value is None]
        self._learn({units[i] for i in missing})
        for i in missing:
            unit = units[i]
            found[i] = known[unit] if len(unit) <= LONGEST_KEPT else fresh(unit)
        return found

    def wholes(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids, as decimal numbers with commas, and the text decoded from them."""
        texts = [(" " if self.dummy_prefix and text else "") + text.replace(SPACE, " ") for text in texts]
        cut, ends = [], [0]
        for text in texts:
            cut += self.cut.findall(text)
            ends.append(len(cut))
        units = []
        for at in range(0, len(cut), AT_ONCE):
            units += self._looked_up(cut[at : at + AT_ONCE])
        for i, text in enumerate(texts):
            own = units[ends[i] : ends[i + 1]]
            if self.odd:
                text = "".join(u[1] if type(u) is tuple else c for u, c in zip(own, cut[ends[i] : ends[i + 1]]))
                own = [u[0] if type(u) is tuple else u for u in own]
            yield b",".join(own), text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def whole(self, text: str) -> tuple[bytes, str]:
        """The same for one text."""
        return next(self.wholes([text]))

    def encode(self, text: str | None) -> list[int]:
        return _numbers(self.whole(text or "")[0]).tolist()


def _numbers(ids: bytes) -> np.ndarray:
    return np.array(ids.split(b","), np.int32) if ids else np.zeros(0, np.int32)


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that does not fit becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One codec for each worker process, so that its tables last over batches and tasks."""
    return Codec(model)


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, model: bytes, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as counts and digests;
    ``with_ids`` adds ``token_ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            for part in slices(batch, chars=SLICE_CHARS):
                texts = [text or "" for text in part.column(1).to_pylist()]
                rows = [], [], []
                found, ends = [], [0]
                for ids, decoded in tool.wholes(texts):
                    n = ids.count(b",") + 1 if ids else 0
                    rows[0].append(n)
                    rows[1].append(hashlib.sha256(ids).hexdigest())
                    rows[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        found.append(_numbers(ids))
                        ends.append(ends[-1] + n)
                columns = [part.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ENCODED + (", token_ids array<int>" if with_ids else "")
    return map_batches(documents.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text"), run, schema)


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """``doc_id`` and the ``text`` of ``token_ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [tool.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.selectExpr("CAST(doc_id AS BIGINT) doc_id", "token_ids"), run, "doc_id bigint, text string")

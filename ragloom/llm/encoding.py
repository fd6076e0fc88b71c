"""Token ids of whole texts with a public tokenizer file, several times faster than
encoding each text alone: ids of pieces between spaces are looked up when seen before.

A text is divided only where the tokenizer divides it anyway, so the ids are exactly those
of the library for the whole text. Three kinds of tokenizer file allow that; any other file
encodes whole texts:

* byte-level with the usual pattern and no normalizer: a single space or line feed between
  two characters that are no white space always begins a new pre-token;
* white space is dropped by the pre-tokenizer: each space or line feed ends a pre-token;
* a piece model by merges, without normalization, none of whose pieces has a line feed, or a space
  mark after another character: no merge reaches over a line feed, or a space that follows a character.

All texts of a slice are one byte string, divided at once; its distinct pieces (an Arrow
dictionary) are looked up, and the ids of all texts are one gather from the pieces' ids.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CACHED = 64 << 20  # bytes, about, of pieces and their ids that a worker keeps for a tokenizer
ENTRY = 200  # bytes of a kept piece besides its own
MAX_ENCODERS = 2  # tokenizers a worker keeps; the one used longest ago goes
SLICE = 4_000_000  # bytes of text handled at once, or one text
AT_ONCE = 2_000  # texts in one call of the library
# letters that every normalizer allowed below at most lower-cases, and marks: one or two pre-tokens
_PLAIN = re.compile(r"([ \n]?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
# the characters that byte-level models have for bytes: printable ones for themselves, the others in order from 256
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - _PRINTED))}
BYTES = "".join(_OTHERS.get(b, chr(b)) for b in range(256))
_ENCODERS: dict = {}


def encoder(spec: str, plain: bool = False) -> "Encoder":
    """The worker's encoder for the tokenizer given by its JSON text (kept between tasks)."""
    return _kept(("json", hash(spec), plain), lambda: Encoder(spec, plain))


def piece_encoder(model: bytes) -> "PieceEncoder":
    """The worker's encoder for a sentencepiece model (kept between tasks)."""
    return _kept(("pieces", hash(model)), lambda: PieceEncoder(model))


def _kept(key, make):
    found = _ENCODERS.pop(key, None) or make()
    _ENCODERS[key] = found  # the last is the one used last
    while len(_ENCODERS) > MAX_ENCODERS:
        del _ENCODERS[next(iter(_ENCODERS))]
    return found


def kind_of(spec: dict) -> str:
    """How texts may be divided: 'spaced' (pieces keep their space), 'dropped' or 'whole'."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ())):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "spaced"
    parts = pre.get("pretokenizers", ())
    drops = parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
    # these normalizers look at one character, or at one between two starters, at a time
    simple = all(n["type"] in ("NFC", "Replace", "Lowercase") for n in (norm or {}).get("normalizers", ()))
    if drops and simple and r"\s" in parts[0]["pattern"].get("Regex", ""):
        return "dropped"
    return "whole"


def spaces_between(data: np.ndarray) -> np.ndarray:
    """Places of the spaces and line feeds of a UTF-8 byte array that stand between two characters of which
    neither is white space or a control character; a few more characters count as white space too."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[(data[at - 1] > 0x20) & (data[at + 1] > 0x20)]
    # white space beyond ASCII: C2 85, C2 A0, E1 9A 80, E2 80 xx, E2 81 9F, E3 80 80; the space mark of pieces: E2 96 81
    b, c, d = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    before = ((c == 0xC2) & ((b == 0x85) | (b == 0xA0))) | (_three(d, c) & (b >= 0x80))
    last = len(data) - 1
    b, c = data[at + 1], data[np.minimum(at + 2, last)]
    after = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | _three(b, c)
    return at[~before & ~after]


def _three(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first == 0xE1) & (second == 0x9A)) | ((first == 0xE2) & ((second == 0x80) | (second == 0x81) | (second == 0x96))) | (
        (first == 0xE3) & (second == 0x80))


class _Pieces:
    """Pieces seen lately, and their ids in one flat array."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self):
        self.slot: dict[bytes, int] = {}
        self.size = self.start = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int32)  # slices that had the piece
        self.flat = np.zeros(0, self.dtype)
        self.held = 0

    def add(self, pieces: list[bytes], ids: list) -> None:
        n, sizes = len(self.slot), np.fromiter(map(len, ids), np.int64, len(ids))
        flat = list(chain.from_iterable(ids))
        self.slot.update(zip(pieces, range(n, n + len(pieces))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int32)])
        self.flat = np.concatenate([self.flat, np.array(flat, self.dtype)])
        self.held += sum(map(len, pieces)) + ENTRY * len(pieces) + self.dtype.itemsize * len(flat)

    def shrink(self) -> None:
        """Keep the half of the pieces that most slices had, none that only one had."""
        least = max(2, int(np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]) + 1)
        old, kept = list(self.slot), np.flatnonzero(self.used >= least)
        pieces, used = [old[i] for i in kept.tolist()], self.used[kept]
        flat = self.flat.tolist()
        ids = [flat[a:a + n] for a, n in zip(self.start[kept].tolist(), self.size[kept].tolist())]
        self.clear()
        self.add(pieces, ids)
        self.used = used


class _Encoder:
    kind, dtype = "whole", np.dtype("<u4")

    def _start(self, dtype):
        self.dtype, self.known = dtype, _Pieces(dtype)

    def _new(self, pieces: list[bytes]) -> list:
        """Ids of each of the distinct pieces."""
        raise NotImplementedError

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the end of the last."""
        mark = np.zeros(len(data) + 1, bool)
        mark[offsets] = True
        if self.kind == "spaced":
            mark[spaces_between(data)] = True
        elif self.kind == "dropped":
            mark[:-1] |= (data == 0x20) | (data == 0x0A)  # a piece may begin with one of them
        return np.flatnonzero(mark)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (``dtype``) of all texts, one after the other, and each text's bounds in them. ``data``
        has the texts' bytes, text i from ``offsets[i]`` to ``offsets[i + 1]``; the first is 0."""
        if self.kind == "whole":
            self.known.clear()
        elif self.known.held > MAX_CACHED:
            self.known.shrink()
        known, cuts = self.known, self._cuts(data, offsets)
        if len(cuts) < 2:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1,
                                       [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if lacking := [p for p in distinct if p not in known.slot]:
            known.add(lacking, self._new(lacking))
        slots = np.fromiter(map(known.slot.__getitem__, distinct), np.int64, len(distinct))
        known.used[slots] += 1
        slots = slots[pieces.indices.to_numpy()]
        sizes = known.size[slots]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(known.start[slots] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
        return known.flat[at], bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids (``dtype``) of each text of a list."""
        out: list[bytes] = []
        for ids, bounds in self.slices(pa.array(texts, pa.large_string())):
            data, size = ids.tobytes(), self.dtype.itemsize
            out += [data[a * size:b * size] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out

    def slices(self, column: pa.Array):
        """(ids, bounds) of some texts of an Arrow column after the other; null counts as empty."""
        for data, offsets in text_slices(column):
            yield self.ids(data, offsets)


def text_slices(column: pa.Array, size: int = SLICE):
    """The texts of an Arrow column as byte arrays of some ``size`` bytes, or one text, with their bounds."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, side="right")) - 1)
        yield np.ascontiguousarray(data[bounds[a]:bounds[b]]), bounds[a:b + 1] - bounds[a]
        a = b


class Encoder(_Encoder):
    """A file of the tokenizers library. ``plain``: special tokens' strings in texts are plain text."""

    def __init__(self, spec: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = plain
        loaded = json.loads(spec)
        self.kind = kind_of(loaded)
        self.vocab = self.tokenizer.get_vocab()
        self._start(np.dtype("<u2" if max(self.vocab.values()) < 1 << 16 else "<u4"))
        words = any(_PLAIN.fullmatch(t["content"]) for t in loaded.get("added_tokens", ()))
        # ids of marks after a word; None if words must go through the whole tokenizer
        self.marks: dict | None = None if self.kind == "whole" or words else {}

    def _call(self, texts: list[str]) -> list[list[int]]:
        out = []
        for a in range(0, len(texts), AT_ONCE):  # the library holds much for each text
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[a:a + AT_ONCE], add_special_tokens=False)]
        return out

    def _new(self, pieces: list[bytes]) -> list:
        """Plain words go to the merges of the model at once, all others through the whole tokenizer."""
        out: list = [()] * len(pieces)
        alone, merges, marks = [], self.tokenizer.model.tokenize, self.marks
        for i, p in enumerate(pieces):
            p = p.decode()
            if marks is None or not (m := _PLAIN.fullmatch(p)):
                alone.append((i, p))
                continue
            lead, word, tail = m.groups()
            first = ()
            if self.kind == "dropped":
                word = word.lower()
            elif lead == "\n":
                first = marks.get(lead) or self._mark(lead)
            else:
                word = lead + word
            ids = [*first, *[t.id for t in merges(charmap_decode(word.encode(), "strict", BYTES)[0])]]
            out[i] = ids + (marks.get(tail) or self._mark(tail)) if tail else ids
        for (i, _), ids in zip(alone, self._call([p for _, p in alone])):
            out[i] = ids
        return out

    def _mark(self, tail: str) -> list[int]:
        ids = self._call([tail])[0]
        if len(self.marks) < 1000:
            self.marks[tail] = ids
        return ids


class PieceEncoder(_Encoder):
    """A sentencepiece model, for texts that begin with the space which the model adds."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm, mark = spec.normalizer_spec, "▁"
        own = norm.add_dummy_prefix and not spec.trainer_spec.treat_whitespace_as_suffix
        same = norm.name == "identity" and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        merges = spec.trainer_spec.model_type == 2  # pieces by merges
        if not own:
            raise ValueError("the model must put a space before a text")
        crosses = any(mark in p.piece.lstrip(mark) or "\n" in p.piece or p.type == 4 for p in spec.pieces)  # 4: given by a user, matched first
        self.kind = "spaced" if same and merges and not crosses else "whole"
        self._start(np.dtype("<u2" if len(spec.pieces) <= 1 << 16 else "<u4"))

    def _new(self, pieces: list[bytes]) -> list:
        # the model puts a space before each: in the place of a piece's own, or alone before a line feed
        found = self.model.encode([(p[1:] if p[0] == 0x20 else p).decode() for p in pieces], num_threads=1)
        return [ids if p[0] == 0x20 else ids[1:] for p, ids in zip(pieces, found)]


def grouped(texts, chars: int = 500_000):
    """Slices (start, end) of the list ``texts`` holding some ``chars`` each, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_column(enc: Encoder, column: pa.Array):
    """Ids of each text of the Arrow column in turn; null counts as empty."""
    for ids, bounds in enc.slices(column):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b]


def load_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()

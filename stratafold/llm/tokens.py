"""Encoding of whole texts with a public tokenizer, one encoding per different word.

The byte-level tokenizer cuts a text before every run of white space and around every line end that stands alone, and each cut piece
is encoded on its own. So a text's ids are its pieces' ids in a row. Pieces are cut and numbered for many texts at once, and each worker
process needs the library only for pieces that it has not met yet. A piece of letters alone is not cut any further, so the library's model
gets it without the search for cuts.
"""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np
import pyarrow as pa

from stratafold.llm.common import give_back

#: Pieces after which a worker process begins a new memory; it keeps the one before, and takes from that what comes again.
REMEMBERED = 200_000
#: New pieces that are encoded in one text.
LINES = 400
#: Texts that the library is given at once, and characters whose pieces are held at once.
TEXTS, CHARACTERS = 16, 1 << 21
_ODD = "\x1c\x1d\x1e\x1f"  # white space for Python only
_RARE = "\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))  # all other white space but " " and line ends
_ENDS = ".,;:!?"
_SIGNS = _ENDS.encode()
_SIGN, _SIMPLE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (_SIGNS, (string.ascii_letters + string.digits).encode()))
_RUN = re.compile(r"\s[ \n]|\n\s")  # a line end may be one token with any white space behind it
_PIECE = re.compile(r"\s*\S+|\s+")
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _byte_letters() -> str:
    """The character by which a byte-level vocabulary writes each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(others)) for b in range(256))


class Encoder:
    """``encode`` gives, per text, the ids as bytes of little-endian numbers of type ``kind``.

    A special token's name in a text is that token, as the library has it, or with ``plain_specials`` ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would keep memory of their own
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        self.direct = [*_ODD, *(t.content for t in self.library.get_added_tokens_decoder().values() if not (plain_specials and t.special))]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids[0]
        self.signs = dict(zip(_SIGNS, self._library(list(_ENDS)), strict=True))
        self.memory: list[dict[bytes, bytes]] = [{}, {}]  # the one in use and the one before
        letters, vocabulary = _byte_letters(), self.library.get_vocab()
        self.written = {b: c for b, c in enumerate(letters) if b != 10}  # line ends stay, for the cuts between pieces
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        cuts = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else {}
        self.model = None
        if self.library.normalizer is None and all(c in vocabulary for c in letters) and (cuts.get("type"), cuts.get("use_regex"), cuts.get("add_prefix_space")) == ("ByteLevel", True, False):
            self.model = Tokenizer(self.library.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without line ends that end, and but for one space begin, in no white space, a few hundred lines at once."""
        texts = ["\n".join(pieces[at:at + LINES]) for at in range(0, len(pieces), LINES)]
        out, width = [], self.kind.itemsize
        for made in (e for at in range(0, len(texts), TEXTS) for e in self.library.encode_batch_fast(texts[at:at + TEXTS], add_special_tokens=False)):
            ids = np.array(made.ids, self.kind)
            ends = np.flatnonzero(ids == self.line_end)
            data = ids.tobytes()
            starts = [0, *((ends + 1) * width).tolist()]
            out += [data[a:b] for a, b in zip(starts, [*(ends * width).tolist(), len(data)], strict=True)]
        return out

    def _lettered(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of letters, but for one space before; the bytes that ids stand for tell where a piece ends."""
        out, width = [], self.kind.itemsize
        for at in range(0, len(pieces), LINES * TEXTS):
            some = pieces[at:at + LINES * TEXTS]
            texts = [b"\n".join(some[i:i + LINES]).decode("latin-1") for i in range(0, len(some), LINES)]
            texts = [t.replace(" ", self.written[32]) if t.isascii() else t.translate(self.written) for t in texts]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum(list(map(len, some)))
            limits = [0, *((np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * width).tolist()]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(limits, limits[1:], strict=False)]
        return out

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces: from the memory in use, the one before, else the library."""
        if len(self.memory[0]) > REMEMBERED:
            self.memory = [{}, self.memory[0]]
        now, earlier = self.memory
        found = list(map(now.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            again = {p: ids for p in map(pieces.__getitem__, new) if (ids := earlier.get(p)) is not None}
            now.update(again)
            self._learn(now, [p for p in map(pieces.__getitem__, new) if p not in again])
            for i in new:
                found[i] = now[pieces[i]]
        return found

    def _learn(self, now: dict[bytes, bytes], pieces: list[bytes]) -> None:
        lettered, lines, other, ended = [], [], [], []

        def sort(p: bytes) -> None:
            text = p.decode()
            core = text[1:] if text[0] == " " else text
            if self.model and core.isalpha() and max(core) < "\u0250":
                lettered.append(p)
            elif core and "\n" not in core and core == core.strip():
                lines.append(p)
            else:
                other.append(p)

        for p in pieces:
            if self.model and (p[1:] if p[0] == 32 else p).isalpha():  # of bytes: ASCII letters
                lettered.append(p)
            elif len(p) > 1 and p[-1] in _SIGNS and (c := p[-5:].decode(errors="ignore")[-2:-1]) and c < "\u0250" and c.isalnum():  # a sign behind a letter or digit is a piece of its own
                ended.append(p)
                sort(p[:-1])
            else:
                sort(p)
        for part, encode in ((lettered, self._lettered), (lines, lambda x: self._joined([p.decode() for p in x])), (other, lambda x: self._library([p.decode() for p in x]))):
            now.update(zip(part, encode(part) if part else [], strict=True))
        now.update((p, now[p[:-1]] + self.signs[p[-1]]) for p in ended)

    def _alone(self, text: str) -> bool:
        """Whether no white space of the text touches other white space in a way that can share a token."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return False
        rare = _RARE[:4] if text.isascii() else _RARE
        return not (any(c in text for c in rare) and _RUN.search(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, part, size = [], [], 0
        for text in texts:
            part.append(text or "")
            size += len(text or "")
            if size >= CHARACTERS:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Texts whose spaces and line ends stand alone are cut at these; others at every run of white space; added tokens need the whole."""
        simple, generic, direct = [], [], []
        for i, text in enumerate(texts):
            (direct if any(name in text for name in self.direct) else simple if self._alone(text) else generic).append(i)
        out = dict(zip(direct, self._library([texts[i] for i in direct]), strict=True)) if direct else {}
        if simple:
            whole = [texts[i].encode() for i in simple]
            data = np.frombuffer(b"".join(whole), np.uint8)
            limits = np.concatenate([[0], np.cumsum([len(t) for t in whole])])
            begins = np.zeros(len(data) + 1, bool)
            line_ends = data == 10
            begins[:-1] = line_ends | (data == 32)
            begins[1:] |= line_ends
            begins[limits] = True
            begins[1:-1] |= _SIGN[data[1:]] & _SIMPLE[data[:-1]] & begins[2:]  # a sign that ends a word is a piece of its own
            starts = np.flatnonzero(begins)
            pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
            out |= zip(simple, self._gathered(pieces, np.searchsorted(starts, limits)), strict=True)
        if generic:
            cut = [_PIECE.findall(texts[i]) for i in generic]
            pieces = pa.array([p.encode() for own in cut for p in own], pa.binary())
            out |= zip(generic, self._gathered(pieces, np.concatenate([[0], np.cumsum([len(own) for own in cut])])), strict=True)
        return [out[i] for i in range(len(texts))]

    def _gathered(self, pieces: pa.Array, limits: np.ndarray) -> list[bytes]:
        """The ids of pieces in a row, between each two of the limits."""
        numbered = pieces.dictionary_encode()
        known = self._known(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(known), self.kind)
        size = np.array(list(map(len, known)), np.int64) // self.kind.itemsize
        number = numbered.indices.to_numpy()
        each = size[number]
        after = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat((np.cumsum(size) - size)[number] - after[:-1], each)
        place += np.arange(after[-1])
        data = ids[place].tobytes()
        cuts = (after[limits] * self.kind.itemsize).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """The worker process's encoder for the file."""
    key = path, plain_specials
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, plain_specials)
    return _ENCODERS[key]


def forget() -> None:
    """Lets go of the worker process's encoders with all that they remember, for work that encodes nothing: the process lives on."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

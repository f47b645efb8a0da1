"""Token ids of many texts by the tokenizers library, each distinct word encoded once.

Pre-tokenisation cuts a text before BPE starts, so the ids of a text are those of its pieces
wherever the cuts between pieces are cuts of the pre-tokeniser. Two kinds are known here:

* byte level (an optional space joins the word after it): a space before a non-blank begins a piece;
* word end (blanks are dropped): every blank separates pieces.

A run of ASCII punctuation after letters is a piece of its own in both. Texts in which other blanks,
runs of blanks or special tokens occur are encoded whole, as are all texts under other tokenizers.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_TAIL = ".,!?;:*#&%$|()[]{}\"/=+<>~^_@-"
#: Bytes of words, of letters at a line's begin, and of other pieces that a worker remembers, Python's own included,
#: twice: what was not met again since the last time they were full is forgotten. Longer pieces are worked out each time.
_MOST_WORDS, _MOST_PIECES = 56 << 20, 4 << 20
_LONGEST = 64


def _unusual(text: str) -> bool:
    """Blanks other than single spaces and line breaks between words, or characters that may be such."""
    flat = text.replace("\n", " ")
    return "  " in flat or flat[0] == " " or flat[-1] == " " or not flat.isprintable()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts) gives the same ids as Tokenizer.encode(text, add_special_tokens=False) for each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.kind = self._kind(path)
        self.wide = self.plain.get_vocab_size(with_added_tokens=True) > 65536
        self.code = "I" if self.wide else "H"
        self.mark = self._packed(self.plain.encode("\n", add_special_tokens=False).ids)
        self.word = _Known(self._word_after_space if self.kind == "byte_level" else self._word_in_lower_case, _MOST_WORDS)
        self.letters, self.other = _Known(self._letters, _MOST_PIECES), _Known(self._other, _MOST_PIECES)
        if self.kind != "whole":  # the model's own word has to agree with the whole tokenizer
            for word in ("the", " reading", "\u00e9tudes", " Stra\u00dfe"):
                if self.kind == "byte_level" or word[0] != " ":
                    got = self._letters(word[1:], _SPACE) if word[0] == " " else self._letters(word.lower() if self.kind == "word_end" else word)
                    if got != self._packed(self.plain.encode(word, add_special_tokens=False).ids):
                        self.kind = "whole"

    @staticmethod
    def _kind(path: str) -> str:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
        steps = pre.get("pretokenizers", [pre])
        if model.get("type") != "BPE" or model.get("dropout") or steps[-1].get("type") != "ByteLevel":
            return "whole"
        if len(steps) == 1 and norm is None and not steps[0].get("add_prefix_space") and steps[0].get("use_regex", True):
            return "byte_level"
        cut = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        names = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        return "word_end" if cut and names == ["NFC", "Replace", "Lowercase"] and r"\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in json.dumps(steps[0], ensure_ascii=False).replace("\\\\", "\\") else "whole"

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _letters(self, piece: str, lead: str = "") -> bytes:
        """Latin letters, with or without a space before them, are one word for the model."""
        if not piece.isascii():
            piece = piece.encode("utf-8").decode("latin-1").translate(_VISIBLE)
        return self._packed([t.id for t in self.plain.model.tokenize(lead + piece)])

    def _whole(self, text: str) -> bytes:
        """A text with special tokens' strings in it, which count as such tokens."""
        self.plain.encode_special_tokens = False
        try:
            return self._other(text)
        finally:
            self.plain.encode_special_tokens = True

    def _other(self, piece: str) -> bytes:
        return self._packed(self.plain.encode(piece, add_special_tokens=False).ids)

    def _word_after_space(self, key: str) -> bytes:
        if key[:1] == "\n":
            return self.mark + self._first_in_line(key[1:]) if len(key) > 1 else self.mark
        core = key.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or _latin(core)):
            return self.word[core] + self.other[key[len(core) :]] if len(core) < len(key) else self._letters(core, _SPACE)
        return self.other[" " + key]

    def _word_in_lower_case(self, key: bytes) -> bytes:
        word = key.decode("utf-8")
        word = word if word.isascii() else word.lower() if _latin(word) else word
        core = word.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or _latin(core)):
            return self.word[core.encode("utf-8")] + self.other[word[len(core) :]] if len(core) < len(word) else self._letters(core)
        return self.other[word]

    def _first_in_line(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or _latin(core)):
            return self.letters[core] + self.other[word[len(core) :]] if len(core) < len(word) else self.letters[core]
        return self.other[word]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        byte_level, find, out = self.kind == "byte_level", self.word.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.kind == "whole" or any(s in text for s in self.special):
                out.append(self._whole(text))
            elif not byte_level:
                out.append(b"".join(map(find, text.encode("utf-8").lower().split())))
            elif _unusual(text):
                out.append(self._other(text))
            else:  # less the line break put before the text
                out.append(b"".join(map(find, f"\n{text}".replace("\n", " \n").split(" ")[1:]))[len(self.mark) :])
        size = array(self.code).itemsize
        return np.frombuffer(b"".join(out), self.code), np.fromiter(map(len, out), np.int64, len(out)) // size


class _Known(dict):
    """A mapping that works out what it does not have yet, in ``most`` bytes and as many for what it had before."""

    def __init__(self, find, most: int):
        self.find, self.most, self.held, self.before = find, most, 0, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= _LONGEST:
            cost = len(key) + len(value) + _ENTRY
            self.held += cost
            if self.held > self.most:
                self.before = dict(self)
                self.clear()
                self.held = cost
            self[key] = value
        return value


#: What Python needs for an entry beside its letters and ids: two objects and a place in the mapping.
_ENTRY = 49 + 33 + 56
_SPACE = "\u0120"


#: Byte-level vocabularies spell a byte as itself where that is visible, and as the next free character above 255 otherwise.
_VISIBLE = {}
for _b in range(256):
    if not (0x21 <= _b <= 0x7E or 0xA1 <= _b <= 0xAC or 0xAE <= _b <= 0xFF):
        _VISIBLE[_b] = 256 + len(_VISIBLE)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_held: dict[str, Encoder] = {}


def forget() -> None:
    """Leave all encoders, with what they remember, to a worker's next task that needs one."""
    _held.clear()


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def encoded(batches, path: str, end_id: int | None):
    """Of batches with doc_id and text: doc_id column, ids and counts, ``end_id`` after each text."""
    e = encoder(path)
    for batch in batches:
        ids = batch.column("doc_id")
        step = 400
        for lo in range(0, batch.num_rows, step):
            texts = [t or "" for t in batch.column("text").slice(lo, step).to_pylist()]
            flat, sizes = e.encode(texts)
            if end_id is not None:
                ends = np.cumsum(sizes)
                flat = flat if end_id <= np.iinfo(flat.dtype).max else flat.astype(np.uint32)
                flat, sizes = np.insert(flat, ends, end_id), sizes + 1
            yield ids.slice(lo, step), flat, sizes

"""Exact token ids of whole texts with a vocabulary file, in Python workers.

A text is cut where no token can span: for the word vocabulary at ASCII white space, which it drops; for the byte
vocabulary before white space that follows a character that is none (its pattern never matches across such a place).
The ids of the pieces are kept per worker in two generations, so a piece of text that comes again is not encoded
again. A piece that is a word of Latin letters with marks behind it goes straight to the vocabulary's model, after the
byte mapping that its file asks for; all others take the whole way through the tokenizer. A text that holds the
string of an added token takes the whole way uncut, and so do all texts where the file asks for another way of
splitting than these two.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from array import array

#: Pieces whose ids a worker keeps in a generation; there are two.
KEPT_PIECES = 500_000

_PIECES = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
_SPACE_TWICE = re.compile(rb"[\x20\x09-\x0D][\x20\n]")
#: White space beyond ASCII, in UTF-8: with it in a text the places to cut are not certain.
_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

#: How the two vocabularies' files split text, and the printable bytes that stand for themselves.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
#: The character of each byte.
_BYTES = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))

#: A run of letters up to U+024F, without U+0130, on whose lower case libraries differ; a line end before it and marks behind it are parts of their own.
_SIMPLE = re.compile("(\n?)( ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@[-`{-~]*)")

_encoders: dict[str, Encoder] = {}


def _kind(file: dict) -> str:
    """How texts of a vocabulary file may be cut: byte, word, or not at all."""
    normalizer, splitter, model = (file.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    if model.get("type") != "BPE" or model.get("dropout") or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in file.get("added_tokens") or []):
        return "whole"
    plain_bytes = lambda s, pattern: s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and s.get("use_regex", True) == pattern
    if not normalizer and plain_bytes(splitter, True):
        return "byte"
    steps = splitter.get("pretokenizers") or []
    if normalizer.get("normalizers") == _WORD_NORMALIZERS and len(steps) == 2 and plain_bytes(steps[1], False):
        if steps[0] == {"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}:
            return "word"
    return "whole"


class Encoder:
    """ids(text) as little-endian unsigned 32-bit integers in bytes, as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.kind = _kind(file)
        added = [re.escape(t["content"].encode()) for t in file.get("added_tokens") or []]
        self.added = re.compile(b"|".join(added) if added else rb"(?!)", re.I)  # pieces are in lower case
        self.model = self.tokenizer.model
        self.kept = _Kept(self._encode if self.kind == "word" else self._encode_key)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode(self, piece: bytes) -> bytes:
        text = piece.decode()
        simple = _SIMPLE.fullmatch(text)
        if not simple:
            return self._whole(text)
        line, word, marks = simple.groups()
        if self.kind == "word":
            if not (text.isascii() or unicodedata.is_normalized("NFC", text)):
                return self._whole(text)
            word = word.lower()
        ids = [t.id for t in self.model.tokenize(codecs.charmap_decode(word.encode(), "strict", _BYTES)[0])]
        if marks:
            ids += [t.id for t in self.model.tokenize(marks)]
        if line:
            ids = [t.id for t in self.model.tokenize(_BYTES[10])] + ids
        return array("I", ids).tobytes()

    def _encode_key(self, key: bytes) -> bytes:
        """A key stands for a piece after a space; one that begins with a line end for itself, with a space for what follows that."""
        return self._encode(key[1:] if key[:1] == b" " else key if key[:1] == b"\n" else b" " + key)

    def _keys(self, text: bytes) -> list[bytes]:
        if self.kind == "word":
            return text.lower().split()  # lower-cases A-Z only, as the vocabulary does anyway
        if _SPACE_TWICE.search(text):
            return [b" " + p for p in _PIECES.findall(text)]
        keys = text.replace(b"\n", b" \n").split(b" ")
        if keys[0]:
            keys[0] = b" " + keys[0]
            return keys
        return keys[1:]

    def ids(self, text: bytes) -> bytes:
        if self.kind == "whole" or self.added.search(text) or self.kind == "byte" and _OTHER_SPACE.search(text):
            return self._whole(text.decode())
        if len(self.kept) > KEPT_PIECES:
            self.kept = self.kept.successor()
        return b"".join(map(self.kept.__getitem__, self._keys(text)))


class _Kept(dict):
    """Ids by piece, looked up in the generation before or encoded when they are missing."""

    def __init__(self, encode, before: dict | None = None):
        super().__init__()
        self.encode, self.before = encode, {} if before is None else before

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        self[piece] = ids = self.encode(piece) if ids is None else ids
        return ids

    def successor(self) -> _Kept:
        self.before = {}
        return _Kept(self.encode, self)


def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary, so that tasks share what it has kept."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

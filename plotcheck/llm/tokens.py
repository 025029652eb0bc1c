"""Token ids of whole texts, with bounded caches of words and of the tokenizer's pieces."""

from __future__ import annotations

import json
import os
import re
import struct

import regex

#: Words kept with their ids in a worker, and pieces of the tokenizer's own splitting for each of them; others are encoded each time.
CACHED, PIECES_EACH = 300_000, 8 / 3
#: Longer stretches without white space are not kept.
LONGEST = 64
#: How a byte-level pre-tokenizer without a pattern of its own splits (fixed value, public).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[tuple[str, str, int], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces, as little-endian uint32 bytes."""

    def __init__(self, tokenize, cached: int) -> None:  # noqa: ANN001
        super().__init__()
        self.tokenize, self.letters, self.cached = tokenize, _byte_letters(), cached

    def __missing__(self, piece: str) -> bytes:
        tokens = self.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        out = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(self) < self.cached and len(piece) <= LONGEST:
            self[piece] = out
        return out


class Encoder(dict):
    """ids(text): the ids of a byte-level BPE tokenizer as little-endian uint32 bytes; strings of special tokens are ordinary text.

    ``split`` names where the tokenizer itself always splits, so that parts can be encoded one by one and kept:
    "space": before a single space or line feed between other characters (white space is kept in the ids);
    "word": at spaces and line feeds, which leave no ids (text is composed and lower-cased before);
    "none": nowhere, each text goes through the tokenizer whole. Tests hold all against whole encoding.
    ``cached`` words are kept: about 700 bytes each with their pieces. It changes time and memory only.
    """

    def __init__(self, path: str, split: str, cached: int = CACHED) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split, self.cached = split, cached
        self.normalize = self.tokenizer.normalizer and self.tokenizer.normalizer.normalize_str
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        own = [s["pattern"]["Regex"] for s in (steps or {}).get("pretokenizers", [steps or {}]) if "pattern" in s]
        self.findall = regex.compile(own[0] if own else BYTE_LEVEL).findall
        self.pieces = _Pieces(self.tokenizer.model.tokenize, int(cached * PIECES_EACH))
        self.odd = re.compile(r"\s\s|\s\Z|[\x00\x1c-\x1f]").search
        self.control = re.compile(r"[\x1c-\x1f]").search
        self.cuts = re.compile(r"(?<=\S)(?=[ \n]\S)")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        pieces, text = self.pieces, part
        if self.split == "word" and part:
            # Below U+0250 every letter is composed and lower-cases by itself.
            text = part.lower() if max(part) < "ɐ" else self.normalize(part)
        core = text[1:] if self.split == "space" and text[:1] == " " else text
        if core.isalpha():
            out = pieces[text]
        elif core[-1:] in (".", ",") and core[:-1].isalpha():
            out = pieces[text[:-1]] + pieces[core[-1]]
        elif self.control(text):
            out = self.whole(part)
        else:
            out = b"".join([pieces[p] for p in self.findall(text)])
        if len(self) < self.cached and len(part) <= LONGEST:
            self[part] = out
        return out

    def ids(self, text: str) -> bytes:
        if self.split == "none":
            return self.whole(text)
        if self.split == "word":
            parts = text.replace("\n", " ").split(" ")
        elif self.odd(text):
            parts = self.cuts.split(text)
        else:
            parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(self.__getitem__, parts))


def encoder(path: str, split: str, cached: int = CACHED) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, split, cached) not in _ENCODERS:
        _ENCODERS[path, split, cached] = Encoder(path, split, cached)
    return _ENCODERS[path, split, cached]

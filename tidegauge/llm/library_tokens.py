"""Ids of the tokenizers library for whole texts, through the cache of chunks."""

from __future__ import annotations

import os
from array import array

import regex

from tidegauge.llm.chunks import ChunkCache, TwoAges
from tidegauge.llm.common import kept

#: The splitting pattern that word_bpe_49k.json states.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks that a worker keeps; a full cache takes some 400 MB.
ENTRIES = 1_200_000
_PLAIN = regex.compile(r"[\x00-ɏ]*")
_ENDS = frozenset(".,!?;:")
_LOWER = bytes(ord(chr(b).lower()) for b in range(256))
#: Letters that stay letters in lower case; that of U+0130 ends with a mark, which runs on into a sign behind it.
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha())


def _visible() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character; the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _simpler(text: str) -> str:
    """A text with the same ids under the word vocabulary, which lower-cases and drops white space, but with fewer distinct
    chunks: Latin-1 text in lower case, lines parted by spaces, and a sign between a letter and a space set apart."""
    try:
        text = text.encode("latin-1").translate(_LOWER).decode("latin-1")
    except UnicodeEncodeError:
        pass  # the chunks of other texts are lower-cased one by one
    if "\n" in text:
        text = text.replace("\n\n", " ").replace("\n", " ")
    for sign in _ENDS:
        if len(parts := text.split(sign + " ")) > 1:
            apart = f" {sign} "
            if all([p[-1:] in _LETTERS for p in parts[:-1]]):
                text = apart.join(parts)
            else:
                text = "".join([p + (apart if p[-1:] in _LETTERS else sign + " ") for p in parts[:-1]]) + parts[-1]
    return text


class LibraryEncoder:
    """encode(texts) -> per text the little-endian unsigned 32-bit ids as bytes, as the library's
    encode(text, add_special_tokens=False) gives them.

    kind: "byte" for a byte-level vocabulary, "word" for the lower-casing one with word ends. A chunk
    of characters below U+0250 is split here and its pieces go to the library's BPE model; any other
    chunk goes through the library's whole path, whose tables for rarer characters then decide. The library
    takes the strings of added tokens (such as <|endoftext|>) out of a text before anything else; a text that
    holds one is cut there, and what lies between is encoded as texts of their own.
    """

    def __init__(self, path: str, kind: str, pattern: str, entries: int = ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder()
        if plain := [t.content for t in added.values() if t.single_word or t.lstrip or t.rstrip or t.normalized and kind == "word"]:
            raise ValueError(f"added tokens whose match depends on what stands around them: {plain}")
        self.added = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        self.cuts = regex.compile("|".join(regex.escape(c) for c in sorted(self.added, key=lambda c: (-len(c), c)))) if added else None
        self.model, self.lower = self.whole.model, kind == "word"
        self.find, self.table = regex.compile(WORD_PATTERN if self.lower else pattern).findall, _visible()
        self.pieces = TwoAges(entries // 8)
        self.cache = ChunkCache(self._many, entries)

    def _model(self, piece: str) -> bytes:
        """Ids of one match of the pattern."""
        shown = piece.replace(" ", "Ġ") if piece.isascii() and piece.strip(" ").isprintable() else piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self.pieces.get(piece) or self.pieces.put(piece, self._model(piece))

    def _word(self, chunk: str) -> bytes:
        """A chunk of letters, which may be known without the sign that followed it."""
        known = chunk[1:] if chunk[0] == " " else chunk if self.lower else None
        return (known and self.cache.inner.get(known)) or self._model(chunk)

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(chunk, add_special_tokens=False).ids])
        if self.lower:
            chunk = chunk.lower().lstrip(" ")
        bare = chunk[1:] if chunk[:1] == " " else chunk
        if bare.isalpha():
            return self._model(chunk)
        if bare[-1:] in _ENDS and bare[:-1].isalpha():
            return self._word(chunk[:-1]) + self._piece(chunk[-1])
        return b"".join(map(self._piece, self.find(chunk)))

    def _many(self, chunks: list[str]) -> list[bytes]:
        return list(map(self._chunk, chunks))

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [b"".join(v) for v in self.cache.encode(list(map(_simpler, texts)) if self.lower else texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = [k for k, t in enumerate(texts) if any(c in t for c in self.added)]
        if not marked:
            return self._plain(texts)
        plain = list(texts)
        for k in marked:
            plain[k] = ""
        out = self._plain(plain)
        for k in marked:
            parts, found = self.cuts.split(texts[k]), self.cuts.findall(texts[k])
            ids = self._plain(parts)
            out[k] = b"".join(x for a, m in zip(ids, [*found, ""], strict=True) for x in (a, self.added.get(m, b"")))
        return out


def encoder(path: str, kind: str, pattern: str, entries: int = ENTRIES) -> LibraryEncoder:
    """One for each worker process, as long as tasks with this vocabulary follow one another."""
    return kept(encoder_key(path), lambda: LibraryEncoder(path, kind, pattern, entries))


def encoder_key(path: str) -> tuple[str, str]:
    return "library", path

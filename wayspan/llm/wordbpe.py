"""Token ids of whole texts by a word-level BPE file, with memory of words seen.

The vocabulary drops white space and never joins across it, so a text's ids are those of its white-space separated
chunks in turn. Chunks and the words in them are looked up in bounded tables; only new words reach the BPE model, and
anything unusual in a chunk (control characters, marks, scripts beyond extended Latin, special tokens) is left to the
tokenizer as a whole. Results equal ``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import re

CACHE = 400_000
#: The seven contractions that the vocabulary splits off, then letters, single digits, and runs of anything else.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_ODD = re.compile(r"[^\x21-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]|<\|")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """Chunk to its ids as little-endian 16-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.words, self.alphabet = self.tokenizer.model, {}, _byte_letters()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(2, "little") for i in ids)

    def _word(self, w: str) -> bytes:
        found = self.words.get(w)
        if found is None:
            found = self._bytes([t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.alphabet))])
            if len(self.words) < CACHE:
                self.words[w] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        if _ODD.search(chunk):
            found = self._bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        else:
            found = b"".join(map(self._word, _WORD.findall(chunk.lower())))
        if len(self) < CACHE and len(chunk) < 40:
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]

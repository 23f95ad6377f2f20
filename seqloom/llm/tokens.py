"""Token ids of whole texts, by the public tokenizers' files.

Their pre-tokenizer never crosses white space, so a text's ids are those of its words in order.
A worker keeps the ids of words it has met, within a fixed number of words.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from seqloom.llm.shared import word_blocks

#: Words a worker remembers (about 200 bytes each) before it starts anew.
REMEMBERED = 500_000
DEFAULT = "word_bpe_49k.json"
#: Bytes of text worked on at a time.
BLOCK = 1 << 22

# Latin letters (composed, with a lower case of one character), and what may follow them in a
# word: signs, without the apostrophe of contractions.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_WORD = re.compile(rf"([a-z{_LATIN}]+)([!-&(-/:-@\[-`{{-~]*)")
_LONGEST = 1000
_loaded: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """Latin letters as the byte-level vocabulary spells them: one printable letter per byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    spelled = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
    latin = [c for c in range(0xC0, 0x250) if _WORD.fullmatch(chr(c))]
    return {c: "".join(spelled[b] for b in chr(c).lower().encode()) for c in latin}


class WordIds:
    """Little-endian 32-bit ids per word of ``path``'s tokenizer (split at ASCII white space).

    It ignores case, so ASCII letters are lower-cased first, except where a special token could
    appear. A run of Latin letters is one unit for its pre-tokenizer and goes straight to the model;
    the signs after it are another unit, of which there are few.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.remembered = REMEMBERED
        self.signs: dict[str, bytes] = {"": b""}
        self.spelling = _byte_letters()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, dtype="<u4").tobytes() for f in found]

    def learn(self, words: set[bytes]) -> None:
        known, signs, packed, other = self.known, self.signs, self.packed, []
        tokenize, split, spelling = self.model.tokenize, _WORD.fullmatch, self.spelling
        for word in words:
            text = word.decode("utf-8", "replace")
            if len(word) < _LONGEST and (parts := split(text)):
                letters, tail = parts.groups()
                if tail not in signs:
                    if len(signs) > 10_000:
                        signs.clear()
                        signs[""] = b""
                    signs[tail] = self._encoded([tail])[0]
                if len(text) != len(word):
                    letters = letters.translate(spelling)
                ids = [packed[token.id] for token in tokenize(letters)]
                known[word] = b"".join(ids) + signs[tail]
            else:
                other.append(word)
        texts = [word.decode("utf-8", "replace") for word in other]
        known.update(zip(other, self._encoded(texts), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; very long ones block by block, so that memory stays bounded."""
        blocks, owners = [], []
        for owner, text in enumerate(texts):
            data = (text or "").encode("utf-8", "replace")
            for block in word_blocks(data if b"<|" in data else data.lower()):
                blocks.append(block)
                owners.append(owner)
        parts: list[list[bytes]] = [[] for _ in texts]
        begin = 0
        while begin < len(blocks):  # about one block's worth of text at a time
            end, size = begin, 0
            while end < len(blocks) and (end == begin or size + len(blocks[end]) <= BLOCK):
                size += len(blocks[end])
                end += 1
            for owner, ids in zip(owners[begin:end], self._ids(blocks[begin:end]), strict=True):
                parts[owner].append(ids)
            begin = end
        return [b"".join(part) for part in parts]

    def forget(self) -> None:
        """Drop the words met so far; for stages whose worker goes on to other work."""
        self.known = {}

    def _ids(self, blocks: list[bytes]) -> list[bytes]:
        split = [block.split() for block in blocks]
        words = set().union(*split)
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.remembered:  # these words stay, the frequent ones among them
            self.known = {word: self.known[word] for word in words.difference(new)}
        self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def word_ids(name: str = DEFAULT, remembered: int = REMEMBERED) -> WordIds:
    """The worker's own encoder; ``name`` is a public tokenizer's file or any path."""
    if name not in _loaded:
        path = name if "/" in name else public_tokenizers.path(name)
        _loaded[name] = WordIds(path)
    _loaded[name].remembered = remembered
    return _loaded[name]

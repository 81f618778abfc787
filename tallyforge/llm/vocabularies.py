"""Public tokenizer files as broadcast objects: read on the driver, built once per Python worker.

A vocabulary is a file of fixed size, so its broadcast is bounded. ``ids``
returns what the file's own library returns for a whole text.
"""

from __future__ import annotations

import json
import re

import numpy as np


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Lazy:
    """Pickles without what it builds."""

    def __init__(self, content: str):
        self.content = content
        self.built = None

    def __getstate__(self):
        return {"content": self.content, "built": None}

    @classmethod
    def read(cls, path: str) -> Lazy:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())


class ByteLevelBpe(Lazy):
    """A byte-level BPE file of the tokenizers library, run by tiktoken's merge loop over the file's own vocabulary.

    Texts that hold the string of an added token go through the tokenizers library itself.
    """

    #: Fixed value: the pattern of byte-level pre-tokenizing.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def build(self):
        import tiktoken
        from tokenizers import Tokenizer

        data = json.loads(self.content)
        letters = byte_letters()
        added = {t["content"] for t in data["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in added}
        self.built = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}), sorted(added), Tokenizer.from_str(self.content)

    def ids(self, text: str) -> np.ndarray:
        if self.built is None:
            self.build()
        fast, added, library = self.built
        if any(a in text for a in added):
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


#: Letters up to U+024F and what they become in lower case, as a class of a pattern: such a class is matched faster than one of categories.
LETTERS = "".join(sorted({x for c in range(0x250) for x in chr(c) + chr(c).lower() if x.isalpha()}))


class WordBpe(Lazy):
    """A lower-casing BPE file with word ends, of the tokenizers library.

    The file drops white space and encodes each word by itself, so what stands
    between white space is looked up in a memory of bounded size, which the
    library fills word by word. Texts with characters whose normalization isn't
    plain lower-casing go through the library whole.
    """

    REMEMBERED = 1_200_000
    #: Fixed value: the words of the file's pre-tokenizer, for texts that PLAIN matches.
    WORDS = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|\d|[^\s\d{LETTERS}]+")
    #: Letters up to U+024F but the dotted capital I; no fraction or superscript digits, no rare white space.
    PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")

    def build(self):
        from tokenizers import Tokenizer

        self.built = Tokenizer.from_str(self.content), {}

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoded([text])[0], np.uint32)

    def remember(self, unknown: set[str]) -> None:
        """Add the ids of the unknown chunks, from those of their words, which are chunks themselves."""
        library, known = self.built
        words = set(filter(str.isalpha, unknown))
        split = {c: self.WORDS.findall(c) for c in unknown.difference(words)}
        new = list(words.union(*split.values()).difference(known))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            found = library.encode(" ".join(part), add_special_tokens=False)
            ids, cuts = np.array(found.ids, "<u4"), np.flatnonzero(np.diff(found.word_ids)) + 1
            if len(cuts) + 1 != len(part):
                raise ValueError("the file's words are not those of WORDS")
            data, ends = ids.tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
            known.update((w, data[a:b]) for w, a, b in zip(part, ends[:-1], ends[1:], strict=True))
        for chunk, own in split.items():
            if len(own) != 1:
                known[chunk] = b"".join(map(known.__getitem__, own))

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.built is None:
            self.build()
        library, known = self.built
        if len(known) > self.REMEMBERED:
            known.clear()
        plain = [None if "<|" in t or not self.PLAIN.fullmatch(t) else t.lower().split() for t in texts]
        unknown = set().union(*filter(None, plain)).difference(known)
        if unknown:
            self.remember(unknown)
        look, out = known.__getitem__, []
        for text, chunks in zip(texts, plain, strict=True):
            out.append(np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if chunks is None else b"".join(map(look, chunks)))
        return out

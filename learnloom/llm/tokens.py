"""Token ids of whole texts by a tokenizers file, with a bounded cache of words.

The vocabularies used here normalise and split a text at white space before anything else, so a text's ids are those
of its words in turn. A word is encoded once by the library and kept; tests hold the result against encoding the whole
text. A text with a marker such as an end-of-text string is encoded whole, because markers are matched before words.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

#: Words that a Python worker keeps; at this number it starts again, which bounds its memory (about 250 bytes a word).
CACHED_WORDS = 1_200_000


#: White space for Python but not for the libraries' patterns, or the other way round: such texts are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")

_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.markers = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        """Adds words. Case is lost and letters and marks never share a token, so letters that end in marks are put
        together from both; the characters are limited to those whose lower case no library disputes."""
        known, parts = self.known, {}
        for w in words:
            core = w.rstrip(_MARKS)
            if core.isalpha() and max(core) < "\u0100":
                parts[w] = (core.lower(), w[len(core) :])
        wanted = dict.fromkeys(x for w in words for x in parts.get(w, (w,)) if x and x not in known)
        known.update(zip(wanted, self._library(list(wanted))))
        for w, (core, marks) in parts.items():
            known[w] = known[core] + known[marks] if marks else known[core]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if len(self.known) > self.cached:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            text = text or ""
            if any(m in text for m in self.markers) or _ODD_SPACE.search(text):
                out.append(self._library([text])[0])
                continue
            words = text.split()
            if new := [w for w in dict.fromkeys(words) if w not in known]:
                self._learn(new)
            out.append(b"".join([known[w] for w in words]))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that its cache serves all tasks of the worker."""
    return WordEncoder(path)

"""Exact token ids of whole texts by the tokenizers library, with a shortcut for whole tokens.

A text of plain letters, signs and blanks is put in lower case and cut into pre-tokens at once; each is looked up,
and only pre-tokens not seen before are worked out.  Another text is cut at white space, where no pre-token of the
vocabulary's pattern goes on, and its pieces are looked up in the same way:

* Offline, when a worker starts, every vocabulary string that ends a word is encoded alone.  Those that come
  back as their own single id are proven whole tokens; a pre-token that equals one needs no merging.
* Other pre-tokens go to the library, many at once, and are remembered.
* Pieces that the plain rules don't cover (other letters than Latin ones, special strings) go to the library
  as they stand.  Texts with control characters that Python takes for white space go there whole.

Tables of what was seen are bounded in bytes and belong to a task: a full one is emptied, and ``done`` empties
them when the task ends.  What is kept for the life of a worker is the vocabulary and the proof.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: The pre-token pattern of that vocabulary, as a fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for texts that are PLAIN_TEXT, in lower case.
PLAIN_PRETOKEN = re.compile(r"[a-zß-öø-ʯⱥⱦ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~×÷]+")
WORD_END = "</w>"
#: Letters and signs whose lower case and composed form don't depend on their neighbours.
PLAIN = re.compile("[\x21-\x7eÀ-įı-ɏ]+")
#: The same with blanks between them.
PLAIN_TEXT = re.compile("[\x09-\x0d\x20-\x7eÀ-įı-ɏ]*")
TAIL = ".,;:!?"
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
#: Bytes of strings and values that the tables of pieces and of pre-tokens may hold, by a plain estimate.
PIECE_BYTES, WORD_BYTES = 8_000_000, 40_000_000
#: What an entry of a table takes beside its string's and value's own bytes.
ENTRY_BYTES = 160


class Encoder:
    """``count(text)`` and ``ids(text)`` (little-endian unsigned 32-bit ids, as bytes)."""

    def __init__(self, path: str, counts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merger = self._merger()
        self.pretokens = regex.compile(PRETOKEN).findall
        self.counts = counts
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.whole = self._proven(vocabulary)
        self.done()

    def done(self) -> None:
        """Forget what was seen."""
        self.words, self.pieces = dict(self.whole), {}
        self.word_bytes = self.piece_bytes = 0

    def _sizes(self, texts, values) -> int:
        return ENTRY_BYTES * len(texts) + 2 * sum(map(len, texts)) + (0 if self.counts else sum(map(len, values)))

    def _value(self, ids):
        return len(ids) if self.counts else np.asarray(ids, "<u4").tobytes()

    def _merger(self):
        """The library for pre-tokens joined by blanks: their letters are normal and their ends known, so it only merges."""
        import json

        from tokenizers import Tokenizer

        spec = json.loads(self.library.to_str())
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not cuts or cuts[0].get("type") != "Split" or cuts[0]["pattern"].get("Regex") != PRETOKEN:
            return self.library
        spec["normalizer"], cuts[0] = None, {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(spec))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _proven(self, vocabulary: dict[str, int]) -> dict:
        """Words that encode alone as the one token that is named after them."""
        own = {token[: -len(WORD_END)]: k for token, k in vocabulary.items() if token.endswith(WORD_END)}
        own = {word: k for word, k in own.items() if PLAIN.fullmatch(word) and self.pretokens(word) == [word]}
        return {word: self._value(ids) for (word, k), ids in zip(own.items(), self._library(list(own))) if ids == [k]}

    def _merge(self, words: list[str]) -> None:
        """Let the library merge pre-tokens: all in one text, cut again where words end."""
        ids = np.array(self.merger.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            if self.counts:
                self.words.update(zip(words, np.diff(cuts, prepend=0).tolist()))
            else:
                raw, ends = ids.tobytes(), (4 * cuts).tolist()
                self.words.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends))))
        else:
            for word, alone in zip(words, self._library(words)):
                self.words[word] = self._value(alone)

    def learn(self, pieces: set[str]) -> None:
        words, put = self.words, self.pieces
        waiting, other, want = [], [], set()
        for piece in pieces:
            low = piece.lower()
            core = low.rstrip(TAIL)
            if core.isalpha() and (piece.isascii() or PLAIN.fullmatch(piece)):  # a word, and signs behind it
                value = words.get(core)
                tail = low[len(core) :] if len(core) < len(low) else None
                if tail is not None and tail not in words:
                    want.add(tail)
                    value = None
                if value is None:
                    waiting.append((piece, core, tail))
                    if core not in words:
                        want.add(core)
                else:
                    put[piece] = value if tail is None else value + words[tail]
            elif "<|" not in piece and PLAIN.fullmatch(piece):
                pretokens = self.pretokens(low)
                other.append((piece, pretokens))
                want.update(w for w in pretokens if w not in words)
            else:
                other.append((piece, None))
        if want:
            self._know(want, lambda: {w for _, core, tail in waiting for w in (core, tail) if w} | {w for _, ws in other if ws for w in ws})
            words = self.words
        for piece, core, tail in waiting:
            put[piece] = words[core] if tail is None else words[core] + words[tail]
        join = sum if self.counts else b"".join
        for piece, pretokens in other:
            if pretokens is not None:
                put[piece] = join([words[w] for w in pretokens])
        if rest := [piece for piece, pretokens in other if pretokens is None]:
            for piece, ids in zip(rest, self._library(rest)):
                put[piece] = self._value(ids)
        self.piece_bytes += self._sizes(pieces, map(put.__getitem__, pieces))

    def _know(self, missing: set[str], needed) -> None:
        """Add pre-tokens to the table; if it is full, it is emptied first and gets all that are ``needed()``."""
        if self.word_bytes > WORD_BYTES:
            missing = needed().difference(self.whole)
            self.words, self.word_bytes = dict(self.whole), 0
        new = list(missing)
        for k in range(0, len(new), 4096):
            self._merge(new[k : k + 4096])
        self.word_bytes += self._sizes(new, map(self.words.__getitem__, new))

    def texts(self, texts: list[str | None]) -> list:
        """The count or the ids of each text, some 2 MB of texts at a time."""
        out: list = []
        at = 0
        gc.disable()  # nothing here has cycles, and the tables are large
        try:
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 2_000_000):
                    size += len(texts[to] or "")
                    to += 1
                out += self._some(texts[at:to])
                at = to
        finally:
            gc.enable()
        return out

    def _some(self, texts: list[str | None]) -> list:
        plain, other = {}, {}
        for k, text in enumerate(texts):
            if not text or PLAIN_TEXT.fullmatch(text) and "<|" not in text:
                plain[k] = PLAIN_PRETOKEN.findall(text.lower()) if text else []
            else:
                other[k] = text
        seen: set[str] = set().union(*plain.values())
        if missing := seen.difference(self.words):
            self._know(missing, lambda: seen)
        get, join = self.words.__getitem__, sum if self.counts else b"".join
        out = {k: join(map(get, words)) for k, words in plain.items()}
        out |= zip(other, self._mixed(list(other.values())))
        return [out[k] for k in range(len(texts))]

    def _mixed(self, texts: list[str]) -> list:
        split = [None if any(c in text for c in ODD_BLANKS) else text.split() for text in texts]
        seen: set[str] = set().union(*[pieces for pieces in split if pieces])
        if self.piece_bytes > PIECE_BYTES:
            self.pieces, self.piece_bytes = {}, 0
        if missing := seen.difference(self.pieces):
            self.learn(missing)
        get, join = self.pieces.__getitem__, sum if self.counts else b"".join
        return [self._value(self._library([text])[0]) if pieces is None else join(map(get, pieces)) for text, pieces in zip(texts, split)]


@lru_cache(1)
def encoder(path: str, counts: bool) -> Encoder:
    """One for each worker process; ``done`` must be called when a task ends."""
    return Encoder(path, counts)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

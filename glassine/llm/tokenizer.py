"""Byte-level BPE at corpus speed, with the tokenizers library.

The library encodes under 1 MB/s a core, most of it spent on words it has seen before.  A byte-level BPE
splits a text into pieces by a pattern and merges inside each piece only, so a text's ids are its
pieces' ids in a row.  ``Encoder`` therefore asks the library's model for each distinct word of a batch of texts and
lays the answers out by array operations.  Answers for words and pieces are kept from the second time on (most words of
a corpus occur once), in two generations of bounded size: what is in use moves to the new one, the rest is forgotten.
Texts are cut at single spaces and before line breaks first.  A space with white space on both sides, and a line break
beside a space or in a run, can lie inside a piece; texts that have one are cut by the pattern alone.  Texts that hold a
special token's string go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a generation of words and of pieces (mostly asked for through words).
WORDS, PIECES = 240_000, 30_000
#: Bytes of text laid out at once.
CHUNK_BYTES = 4 << 20
#: Flags of what was seen, by hash; all are dropped once a third is set.
FLAGS = 1 << 22
_RISKY = re.compile(r"\s \s|\n\n\n|\n\n\Z|[^\S\n]\n|\n[^\S\n]")
#: Fixed by Unicode: white space, as a class of RE2.
_SPACE = r"[\t-\r\x1C- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A run of these after letters is a piece; the apostrophe isn't among them, as it begins pieces with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept:
    """A bounded memory of answers for strings that come again."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}
        self.flags, self.set = bytearray(FLAGS), 0

    def get(self, key: str) -> bytes | None:
        ids = self.new.get(key)
        return self.old.get(key) if ids is None else ids

    def again(self, key: str) -> bool:
        """Whether key was seen before; it is now."""
        at = hash(key) & (FLAGS - 1)
        if self.flags[at]:
            return True
        self.flags[at] = 1
        self.set += 1
        return False

    def turn(self) -> None:
        """Begin a new generation where the new one is full, and forget what was seen where that is too much."""
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        if self.set > FLAGS // 3:
            self.flags, self.set = bytearray(FLAGS), 0


class Encoder:
    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(pattern).findall
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)).search if added else lambda text: None
        #: Every text that _odd may have to encode has this.
        self.suspect = "|".join([_SPACE + _SPACE, *added])
        self.letters = _byte_alphabet()
        self.four = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size() + 1)]
        self.pieces, self.words = Kept(PIECES), Kept(WORDS)

    def _merge(self, piece: str) -> bytes:
        """The ids of a piece, from the library's model."""
        letters = piece.encode().decode("latin-1").translate(self.letters)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(letters)])

    def _after_space(self, word: str) -> bytes:
        """The ids of letters and the space before them."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(self.letters[32] + letters)])

    def _piece(self, piece: str) -> bytes:
        kept = self.pieces
        ids = kept.get(piece)
        if ids is None:
            ids = self._merge(piece)
            if len(piece) <= 64 and kept.again(piece):
                kept.new[piece] = ids
                kept.turn()
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.split(text)))

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words with the space before it; one that begins with a line break has none."""
        kept, merge, after, line = self.words, self._merge, self._after_space, self._piece("\n")
        fresh: dict[str, bytes] = {}
        new, old, again = kept.new, kept.old, kept.again
        out = list(map(new.get, words))
        for i, ids in enumerate(out):
            if ids is not None:
                continue
            word = words[i]
            ids = old.get(word)
            if ids is None:
                head = word[:1] == "\n"
                if (core := word.rstrip(MARKS)).isalpha():
                    ids = fresh.get(core)
                    if ids is None:
                        ids = fresh[core] = (len(core) < len(word) and kept.get(core)) or after(core)
                    if len(core) < len(word):
                        ids += self._piece(word[len(core) :])
                elif head and core[1:].isalpha():
                    ids = line + merge(core[1:])
                    if len(core) < len(word):
                        ids += self._piece(word[len(core) :])
                else:
                    ids = self._plain(word) if head else self._plain(" " + word)
                if len(word) <= 64 and again(word):
                    new[word] = ids
            else:
                new[word] = ids
            out[i] = ids
        kept.turn()
        return out

    def _odd(self, text: str) -> bytes | None:
        """The ids of a text that can't be cut at its spaces; None for all others."""
        if self.special(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._plain(text) if _RISKY.search(text) else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts as one array of 32-bit integers, the same as the library's, and where each text's begin
        and end; none for null."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        chunk = sizes.cumsum() // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(texts)]
        done = [self._chunk(texts.slice(i, j - i)) for i, j in zip(cuts, cuts[1:]) if j > i]
        if not done:
            return np.zeros(0, "<i4"), np.zeros(1, np.int64)
        return np.concatenate([ids for ids, _ in done]), np.r_[0, np.concatenate([n for _, n in done]).cumsum()]

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has)."""
        # A text is a first word and words with a space before them.  Odd texts, and null, are one first word each.
        plain, first = [], []
        suspect = pc.match_substring_regex(texts, self.suspect).to_pylist()
        for text, look in zip(texts.to_pylist(), suspect):
            odd = b"" if not text else self._odd(text) if look else None
            if odd is None:
                head, gap, rest = text.replace("\n", " \n").partition(" ")
                plain.append(rest if gap else None)
                first.append(self._plain(head))
            else:
                plain.append(None)
                first.append(odd)
        # What has been used is dropped before the next arrays are made: workers are many and their memory is small.
        joined = pa.array(plain, pa.large_string())
        del plain
        lists = pc.split_pattern(joined, " ")
        del joined
        per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        del lists
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        indices = coded.indices.to_numpy(zero_copy_only=False)
        del coded
        out = self._words(words) + first
        pa.default_memory_pool().release_unused()
        # Where in the pool of answers each word's ids begin, in the order of the texts.
        sizes = np.fromiter(map(len, out), np.int64, len(out)) // 4
        pool, begins = np.frombuffer(b"".join(out), "<i4"), np.r_[0, sizes.cumsum()[:-1]]
        del out
        heads = np.r_[0, (per + 1).cumsum()]
        which = np.empty(heads[-1], np.int32)
        at_head = np.zeros(heads[-1], bool)
        at_head[heads[:-1]] = True
        which[at_head] = len(words) + np.arange(len(first))
        which[~at_head] = indices
        n = sizes[which]
        ends = n.cumsum()
        places = np.repeat(begins[which] - (ends - n), n)
        places += np.arange(len(places))
        return pool[places], np.add.reduceat(n, heads[:-1]) if len(first) else n

    def byte_lengths(self) -> np.ndarray:
        """For each id, how many bytes of text it stands for."""
        back = {letter: b for b, letter in self.letters.items()}
        special = self.whole.get_added_tokens_decoder()
        out = np.zeros(max(self.whole.get_vocab().values()) + 1, np.int64)
        for token, i in self.whole.get_vocab().items():
            out[i] = len(token.encode()) if i in special else sum(c in back for c in token)
        return out


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """The encoder of a public vocabulary file, one per worker process."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(name), public_tokenizers.PATTERN)

"""Token ids of a byte-level BPE file at dictionary speed.

The tokenizer's pre-tokens never span the border before a blank that stands alone, so a text whose blanks all stand alone
is encoded word by word: each distinct word goes through the library once and its ids are remembered, up to a bound.
Any other text goes through the library whole.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
import sys
import types

import numpy as np
import regex

from . import common


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed values of byte-level BPE: the pre-token pattern, and the bytes that stand for themselves.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: b for b in SELF} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(SELF))}
ENDS = frozenset(".,!?:;)")
ORDINARY = re.compile("[\x00-\u024f]*")
#: Signs that a text cut at blanks and line ends must not hold: the mark used for cutting, and all other white space.
BLANKS = [c for c in map(chr, range(sys.maxunicode)) if c == "\x01" or c.isspace() and c not in " \n"]


class Words(dict):
    """Word to its ids, little-endian and unsigned, of 2 bytes where all ids of the vocabulary fit, else of 4. Two generations of BOUND words are held: a full one becomes
    the old one, and words that are met again move on."""

    BOUND = 350_000

    def __init__(self, tokenizer, merge=None):
        self.tokenizer, self.old = tokenizer, {}
        self.merge = merge or (lambda piece: [t.id for t in tokenizer.model.tokenize(piece.decode("latin-1").translate(SHOWN))])
        self.width = 2 if max(tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"

    def pack(self, ids: list[int]):
        return array.array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, f"<u{self.width}").tobytes()

    join = staticmethod(b"".join)

    def encode(self, text: str):
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of(self, word: str):
        text = word if word == "\n" else word[1:] if word[:1] == "\x01" else " " + word
        if not text.isascii() and not ORDINARY.fullmatch(text):
            return self.encode(text)
        if word.isalpha():
            return self.pack(self.merge(text.encode()))
        if word[-1] in ENDS and word[:-1].isalpha():
            return self.join([self[word[:-1]], self["\x01" + word[-1]]])
        pieces = PIECES.findall(text)
        if len(pieces) == 1:
            return self.pack(self.merge(text.encode()))
        return self.join([self[p[1:] if p[0] == " " and len(p) > 1 else p if p == "\n" else "\x01" + p] for p in pieces])

    def __missing__(self, word: str):
        ids = self.old.pop(word, None)
        if ids is None:
            if word.isascii() and word.isalpha():  # the most frequent case, without further calls
                ids = self.pack(self.merge(b" " + word.encode()))
            else:
                ids = self.of(word)
        if len(word) <= 48:
            if len(self) >= self.BOUND:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Apart(Words):
    """Words of a tokenizer that drops all white space and cuts at it, and so encodes them apart. A word of signs that are
    their own normal form is cut by the file's pattern; words of plain letters have their own merge."""

    PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, tokenizer, pattern: str, merge=None):
        super().__init__(tokenizer, merge)
        self.pieces, self.letters = regex.compile(pattern), merge

    def of(self, word: str):
        lower = word.lower() if word.isascii() else word
        if self.letters and self.PLAIN.fullmatch(lower):
            return self.pack(self.letters(lower))
        if word.isascii():
            pieces = self.pieces.findall(lower)
            if len(pieces) > 1:
                return self.join([self[p] for p in pieces])
        elif word[-1] in ENDS and word[:-1].isalpha():
            return self.join([self[word[:-1]], self[word[-1]]])
        return self.encode(word)

    def __missing__(self, word: str):
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self.of(word)
        if len(word) <= 48:
            if len(self) >= self.BOUND:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Lengths(Words):
    """Word to the number of its ids."""

    join = staticmethod(sum)

    def pack(self, ids: list[int]) -> int:
        return len(ids)


class ApartLengths(Apart, Lengths):
    """The same for words that are encoded apart."""


#: Signs that Python counts as white space and the tokenizers' patterns don't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def drops_blanks(said: dict) -> bool:
    """Whether a tokenizer file describes words that white space keeps apart: it is dropped, and nothing joins across it."""
    normal, pre = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
    steps, cuts = normal.get("normalizers", [normal] * bool(normal)), pre.get("pretokenizers", [pre])
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" for n in steps)
    first = cuts[0] if cuts else {}
    pattern = first.get("pattern", {}).get("Regex", r"\s")
    # alternatives of letters, signs and classes none of which takes white space
    closed = re.fullmatch(r"(?:'[a-z]+\||\[\\p\{[LN]\}\]\+?\||\[\^\\s\\p\{L\}\\p\{N\}\]\+)+", pattern)
    rest = all(c["type"] == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex", True) for c in cuts[1:])
    return bool(plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and closed and rest)


def merged(symbols: list[str], ranks: dict) -> list[str]:
    """Symbols after all merges, the pair of least rank first: the plain way."""
    while len(symbols) > 1:
        rank, k = min((ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == 1 << 60:
            break
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]
    return symbols


def ended_merge(model: dict, tokenizer):
    """A faster merge of single words of the letters a-z and U+00DF to U+00FF, where the last symbol of a word has a mark.

    A byte that ends a word becomes a byte of its own, so a merge by ranks of byte strings applies. It gives the library's
    ids where ids rise with the merges' ranks and every entry is what merging its own symbols gives; both are checked here,
    by the library for entries that end a word and the plain way for others. None where that isn't so.
    """
    import tiktoken

    mark, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [vocabulary.get("".join(m), -1) for m in merges]
    if not mark or any(a >= b for a, b in zip([-1, *ids], ids, strict=False)) or model.get("dropout") or model.get("ignore_merges"):
        return None
    used = [*range(ord("a"), ord("z") + 1), 0xC3, *range(0x9F, 0xC0)]
    inner = {SHOWN[b]: bytes([k]) for k, b in enumerate(used)}
    final = {SHOWN[b]: bytes([k + 128]) for k, b in enumerate(used)}
    own, ranks, order = {chr(v): k for k, v in SHOWN.items()}, {}, {m: k for k, m in enumerate(merges)}
    for token, k in vocabulary.items():
        ends = token.endswith(mark)
        signs = [ord(c) for c in token.removesuffix(mark)]
        if not signs or any(c not in inner for c in signs):
            continue
        if ends:
            found = [t.id for t in tokenizer.model.tokenize("".join(map(chr, signs)))]
        else:
            found = [vocabulary[t] for t in merged([chr(c) for c in signs], order)]
        if found != [k]:
            return None
        ranks[b"".join(inner[c] for c in signs[:-1]) + (final if ends else inner)[signs[-1]]] = k
    if len(ranks) < 2 * len(used) or any(own[chr(c)] not in used for c in inner):
        return None
    low, high = bytes(inner[SHOWN[b]][0] if b in used else 255 for b in range(256)), {b: final[SHOWN[b]] for b in used}
    # the rule needs a rank for every single byte; those that no word has come last
    ranks |= {bytes([b]): len(vocabulary) + b for b in range(256) if bytes([b]) not in ranks}
    piece = tiktoken.Encoding("file", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def merge(word: str) -> list[int]:
        data = word.encode()
        return piece(data[:-1].translate(low) + high[data[-1]])

    return merge


def ranked_merge(model: dict, tokenizer):
    """A faster merge of single pre-tokens (bytes to ids) with the ranks of the file; None unless it gives the library's ids.

    It holds where ids rise with the merges' ranks and the library encodes every entry of the vocabulary as itself, both of
    which are checked here.
    """
    import tiktoken

    vocabulary, own = model["vocab"], {chr(v): k for k, v in SHOWN.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary.get("".join(m), -1) for m in merges]
    if any(a >= b for a, b in zip([-1, *ids], ids, strict=False)) or model.get("dropout") or model.get("ignore_merges") or not all(c in own for t in vocabulary for c in t):
        return None
    if any(len(found := tokenizer.model.tokenize(t)) != 1 or found[0].id != k for t, k in vocabulary.items()):
        return None
    ranks = {bytes(own[c] for c in t): k for t, k in vocabulary.items()}
    return tiktoken.Encoding("file", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """Ids or their number for whole texts; for a sentencepiece .model the library alone is used."""

    def __init__(self, name: str, where: str | None = None):
        self.file = where or path(name)
        if self.file.endswith(".model"):
            import sentencepiece

            self.pieces, self.words, self.lengths = sentencepiece.SentencePieceProcessor(model_file=self.file), None, None
            return
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.file)
        t.no_padding()
        t.no_truncation()
        self.pieces = None
        self.special = re.compile("|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values()) or r"(?!)")
        said = json.loads(open(self.file, encoding="utf-8").read())
        pre = said.get("pre_tokenizer") or {}
        self.plain = not said.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and said["model"]["type"] == "BPE"
        self.apart = not self.plain and drops_blanks(said)
        merge = ranked_merge(said["model"], t) if self.plain else None
        if self.apart:
            pattern = said["pre_tokenizer"].get("pretokenizers", [said["pre_tokenizer"]])[0]["pattern"]["Regex"]
            merge = ended_merge(said["model"], t)
            self.words, self.lengths = Apart(t, pattern, merge), ApartLengths(t, pattern, merge)
        else:
            self.words, self.lengths = Words(t, merge), Lengths(t, merge)

    def cut(self, text: str) -> list[str] | None:
        """The words of a text whose blanks all stand alone; None where it has to go through the library as one piece."""
        if self.apart:
            return None if self.special.search(text) or SEPARATORS.search(text) else text.split()
        if not self.plain or self.special.search(text) is not None:
            return None
        # printable signs hold no blank but " ", and not the mark
        if not text.replace("\n", "").isprintable() and any(c in text for c in BLANKS):
            return None
        words = ("\x01" + text.replace("\n", " \n \x01")).split(" ")
        return None if "" in words or "\x01" in words else words

    @property
    def width(self) -> int:
        """Bytes of an id in `packed`."""
        return 4 if self.pieces else self.words.width

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        return np.frombuffer(self.packed(text), f"<u{self.width}").astype("<u4").tobytes()

    def packed(self, text: str) -> bytes:
        if self.pieces:
            return np.array(self.pieces.encode(text), "<u4").tobytes()
        if (words := self.cut(text)) is None:
            return self.words.encode(text)
        return b"".join(map(self.words.__getitem__, words))

    def count(self, text: str) -> int:
        if self.pieces:
            return len(self.pieces.encode(text))
        if (words := self.cut(text)) is None:
            return self.lengths.encode(text)
        return sum(map(self.lengths.__getitem__, words))


def encoder(name: str, where: str | None = None) -> Encoder:
    """The encoder of this process: a Python worker keeps its words from task to task, until it runs a task of another kind."""
    kept = sys.modules.setdefault(common.ENCODERS, types.ModuleType(common.ENCODERS)).__dict__
    return kept.get((name, where)) or kept.setdefault((name, where), Encoder(name, where))


def version(name: str, where: str | None = None) -> str:
    """Digest of the tokenizer's file: counts of another version are never reused."""
    return hashlib.sha256(open(where or path(name), "rb").read()).hexdigest()

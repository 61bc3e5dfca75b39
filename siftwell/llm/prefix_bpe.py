"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last of its encoding. The tokens that end at a
place come from an automaton over all tokens (each match is a suffix of the prefix); of these, the one
stands that is compatible with the last token of the prefix before it: encoding the two tokens'
text together must give just these two. Back-pointers then give the ids. Unlike merging, each place
is visited once.

Text is brought to words as the file's settings say: letters are composed and lower-cased, white space runs become
spaces, and words split off by a pattern; the special tokens' strings in a text are tokens of their
own. It has no decoder, so that tokens are joined by spaces. A file of other settings is refused. The
library's parts have Unicode tables of several years; where these differ from Python's, the differences are stated.

Hostile cases: a null text is an empty one, with no tokens; a word of any length takes time in
proportion to it; repeated rows give repeated rows; an empty table gives an empty result; further
columns aren't read. A null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import small_batches

#: Distinct words, and runs without a space, whose ids a worker keeps: twice as many at most.
KNOWN_WORDS = 200_000
#: Longer words are encoded each time.
LONGEST_KNOWN = 64
#: White space as the file's patterns mean it.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

_COUNT, _IDS, _NAMES = itemgetter(0), itemgetter(1), itemgetter(2)

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, ids array<int>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (x for x in range(256) if x not in set(plain))
    letters = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Automaton:
    """All tokens that end at a place of a word, the longest first, in one pass.

    A state is the longest suffix read so far that some token begins with; shorter leads to the next shorter
    suffix that is a token.
    """

    def __init__(self, tokens) -> None:
        self.go: dict[int, int] = {}
        self.token, self.shorter, self.suffix = [-1], [0], [0]
        children: list[list[tuple[int, int]]] = [[]]
        for letters, rank in tokens:
            state = 0
            for x in letters:
                nxt = self.go.get(state << 10 | x)
                if nxt is None:
                    nxt = self.go[state << 10 | x] = len(self.token)
                    children[state].append((x, nxt))
                    children.append([])
                    self.token.append(-1)
                    self.shorter.append(0)
                    self.suffix.append(0)
                state = nxt
            self.token[state] = rank
        level = [s for _, s in children[0]]
        while level:
            below = []
            for state in level:
                for x, s in children[state]:
                    self.suffix[s] = near = self.step(self.suffix[state], x)
                    self.shorter[s] = near if self.token[near] >= 0 else self.shorter[near]
                    below.append(s)
            level = below

    def step(self, state: int, letter: int) -> int:
        go = self.go
        while True:
            nxt = go.get(state << 10 | letter)
            if nxt is not None:
                return nxt
            if not state:
                return 0
            state = self.suffix[state]


class Vocabulary:
    """A BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        for name, value in SETTINGS.items():
            if file[name] != value:
                raise ValueError(f"this {name} isn't supported: {file[name]}")
        if any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain merges are supported")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in file["added_tokens"]):
            raise ValueError("only special tokens that stand as they are are supported")
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in file["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.mark = os.path.commonprefix(list(self.special))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Ranks order tokens as their merges are ordered, after all letters; ids need not.
        self.halves: list[tuple[int, int] | None] = []
        made: dict[str, int] = {}
        self.ids: list[int] = []
        for token in sorted(set(vocab) - {a + b for a, b in merges}, key=vocab.get):
            made[token] = len(self.ids)
            self.ids.append(vocab[token])
            self.halves.append(None)
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in made:  # a second way to the same text never comes first
                self.joined.setdefault((made[a], made[b]), made[a + b])
                continue
            made[a + b] = self.joined[made[a], made[b]] = len(self.ids)
            self.ids.append(vocab[a + b])
            self.halves.append((made[a], made[b]))
        # A word's last letter is another letter than the same one elsewhere.
        letters = [t for t in made if self.halves[made[t]] is None]
        self.letter = {t: k for k, t in enumerate(letters)}
        spelled: list[tuple[int, ...]] = [(self.letter[t],) if self.halves[r] is None else () for t, r in made.items()]
        for r, half in enumerate(self.halves):
            if half:
                spelled[r] = spelled[half[0]] + spelled[half[1]]
        self.size = [len(s) for s in spelled]
        self.pairs: dict[int, bool] = {}
        own = bytearray(b"\1" * len(spelled))
        for r in sorted(range(len(spelled)), key=self.size.__getitem__):
            if self.halves[r]:  # a token that its own text doesn't encode to is never made
                own[r] = self._whole(own, r)
        self.automaton = Automaton((s, r) for r, s in enumerate(spelled) if own[r])
        self.open, self.closed = self._letters("", byte_letters()), self._letters(self.end, byte_letters())
        self.words, self.runs = Kept(), Kept()

    def _letters(self, end: str, letters: list[str]) -> list[int]:
        return [self.letter[x + end] for x in letters]

    def _whole(self, own: bytearray, whole: int) -> bool:
        """If the two halves of a token are what its text is left with before its last merge, and that merge comes."""
        a, b = self.halves[whole]
        return bool(own[a] and own[b] and self.compatible(a, b, whole))

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """If the text of a and b together is encoded as (a, b); with below, up to that merge only.

        A merge across the border could come between the tokens' outer parts at any time of their
        making; the parts are taken back, the later made first, and each such merge is looked up.
        """
        limit = len(self.ids) if below is None else below
        while True:
            crossing = self.joined.get((a, b))
            if crossing is not None and crossing < limit:
                return False
            if a > b or self.halves[b] is None:
                if self.halves[a] is None:
                    return True
                limit, a = min(limit, a), self.halves[a][1]
            else:
                limit, b = min(limit, b + 1), self.halves[b][0]

    def ranks(self, spelled: list[int]) -> list[int]:
        """The ranks of a spelled word's tokens: the last one for each prefix, and then back from the end."""
        last: list[int] = []
        size, pairs, step, longest, shorter = self.size, self.pairs, self.automaton.step, self.automaton.token, self.automaton.shorter
        state = 0
        for end, letter in enumerate(spelled):
            state = step(state, letter)
            at = state if longest[state] >= 0 else shorter[state]
            while True:
                rank = longest[at]
                start = end - size[rank]
                if start < 0:
                    break
                key = last[start] << 20 | rank
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > 4 * KNOWN_WORDS:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(last[start], rank)
                if fits:
                    break
                at = shorter[at]
            last.append(rank)
        out, at = [], len(last) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        data = word.encode("utf-8")
        spelled = [*map(self.open.__getitem__, data[:-1]), self.closed[data[-1]]]
        return [self.ids[r] for r in self.ranks(spelled)]

    def _of(self, word: str) -> tuple[int, str, str]:
        found = self.words.get(word)
        if found is None:
            ids = self.word(word)
            found = self.words.put(word, (len(ids), " ".join(map(str, ids)), " ".join(map(self.names.__getitem__, ids))))
        return found

    def _run(self, run: str) -> tuple[int, str, str]:
        """What a run without a space has: how many tokens, their ids and their names."""
        found = self.runs.get(run)
        if found is None:
            parts = [self._of(w) for w in _parts.findall(run)]
            found = parts[0] if len(parts) == 1 else (sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
            self.runs.put(run, found)
        return found

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        """For each run of a text, how many tokens it has, their ids and their names."""
        out = []
        for piece in _special(tuple(self.special)).split(text) if self.special and self.mark in text else (text,):
            if piece in self.special:
                out.append((1, str(self.special[piece]), piece))
                continue
            runs = runs_of(piece)
            found = list(map(self.runs.young.get, runs))
            if None in found:
                found = [self._run(r) if f is None else f for r, f in zip(runs, found)]
            out += found
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


# Letters and numbers that the library's pattern knows and older tables don't (Unicode 16).
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Capitals (first, last, first small letter) that its lower-casing knows and older tables don't (Unicode 17).
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
# Marks that its composing of letters doesn't know yet, so that they neither move nor join (after Unicode 9).
UNKNOWN_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _category(first: str) -> list[tuple[int, int]]:
    """The ranges of code points whose general category begins with first."""
    runs: list[tuple[int, int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == first:
            runs[-1:] = [(runs[-1][0], c)] if runs and runs[-1][1] == c - 1 else [*runs[-1:], (c, c)]
    return runs


LETTERS, NUMBERS = _class(_category("L") + NEW_LETTERS), _class(_category("N") + NEW_NUMBERS)
PARTS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+"
#: The settings that this reading is of.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
_lower = {c: small + c - first for first, last, small in NEW_CAPITALS for c in range(first, last + 1)}
_unknown = re.compile(f"([{_class(UNKNOWN_MARKS)}])")
_spaces, _parts = re.compile(f"[{SPACE}]+"), re.compile(PARTS)
_splits: dict[tuple[str, ...], re.Pattern] = {}


def _special(tokens: tuple[str, ...]) -> re.Pattern:
    if tokens not in _splits:
        _splits[tokens] = re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")")
    return _splits[tokens]


def runs_of(text: str) -> list[str]:
    """What stands between white space, composed and lower-cased letter by letter."""
    if not text.isascii():
        # Unknown marks part what is composed.
        text = "".join(unicodedata.normalize("NFC", x) for x in _unknown.split(text))
        text = text.translate(_lower).replace("Σ", "σ")  # the lower case of sigma alone depends on its neighbours
    text = text.lower()
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split() alone
        return [r for r in _spaces.split(text) if r]
    return text.split()


class Kept:
    """What was worked out lately: a young and an old table; what is used again stays."""

    def __init__(self) -> None:
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def get(self, key: str) -> tuple[int, str, str] | None:
        found = self.young.get(key)
        if found is None and key in self.old:
            found = self.put(key, self.old[key])
        return found

    def put(self, key: str, value: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(key) <= LONGEST_KNOWN:
            if len(self.young) >= KNOWN_WORDS:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value


_loaded: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for x in batch.column("text"):
                found = vocab.entries(x.as_py() or "")
                counts.append(sum(map(_COUNT, found)))
                ids_hash.append(hashlib.sha256(" ".join(map(_IDS, found)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(" ".join(map(_NAMES, found)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([vocab.encode(x.as_py() or "") for x in batch.column("text")], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the exact ids of each row of docs (doc_id, text)."""
    return _texts(docs).mapInArrow(_ids(path), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of each row of encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([vocab.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())], ["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the text decoded from them."""
    return _texts(docs).mapInArrow(_digests(path), DIGEST)

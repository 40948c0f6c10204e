"""Byte-level BPE of many texts at once, inside Spark tasks: exact splitting by numpy, each distinct word merged once."""

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from prefixlake.llm.spans import Texts, ragged, span_hashes

LETTER, NUMBER, OTHER, SPACE, UNSEEN = 0, 1, 2, 3, 255
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct words that a worker remembers; then it starts anew.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """One vocabulary file of the tokenizers library (byte-level BPE that splits by its own pattern)."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model.items()}
        if any(model[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("ids must follow the order of merges")
        self.one_piece = tiktoken.Encoding("one", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model.values(), *self.added.values()]) + 1
        pieces = [b""] * size
        for piece, i in ranks.items():
            pieces[i] = piece
        for content, i in self.added.items():
            pieces[i] = content.encode()
        self.pieces = pieces
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_lengths = np.fromiter(map(len, pieces), np.int64, size)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.classes = np.full(0x110000, UNSEEN, np.uint8)

    def classify(self, cps: np.ndarray) -> np.ndarray:
        """Classes of code points as the library's own splitting shows them; each is asked once."""
        kinds = self.classes[cps]
        if (kinds == UNSEEN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for c in np.unique(cps[kinds == UNSEEN]).tolist():
                ends = [span[1] for _, span in split("a" + chr(c) + "1")]
                if c == 0x20:
                    kind = SPACE
                elif ends == [2, 3]:
                    kind = LETTER
                elif ends == [1, 3]:
                    kind = NUMBER
                else:
                    kind = OTHER if len(split("!" + chr(c))) == 1 else SPACE
                self.classes[c] = kind
            kinds = self.classes[cps]
        return kinds

    def split(self, t: Texts) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """Starts and ends of the pre-tokens of `t`; ids of those that are added tokens, by start."""
        cps, n = t.cps, len(t.cps)
        kinds = self.classify(cps).copy()
        kinds[t.gaps] = 4
        added: dict[int, int] = {}
        for content, i in self.added.items():
            at = t.text.find(content)
            while at >= 0:
                if not (kinds[at : at + len(content)] == 4).any():
                    kinds[at : at + len(content)] = 4
                    added[at] = i
                at = t.text.find(content, at + len(content))
        head = np.flatnonzero(np.diff(kinds, prepend=np.uint8(9)))
        tail = np.append(head[1:], n)
        kind = kinds[head]
        # A blank right before a run joins it; the rest of the white space is a token of its own unless the text ends there.
        space = kind == SPACE
        follows = np.append(kind[1:], 4) < SPACE
        blank = cps[tail - 1] == 0x20
        joins = space & follows & blank
        parted = space & follows & ~blank & (tail - head > 1)
        starts = head.copy()
        starts[1:] -= joins[:-1] & (kind[1:] < SPACE)
        ends = tail.copy()
        ends[joins | parted] -= 1
        keep = (kind != 4) & (ends > starts)
        # 's and the like, where no blank stands before the mark.
        mark = (kind == OTHER) & (ends - starts == 1) & (cps[head] == 0x27) & (np.append(kind[1:], 4) == LETTER)
        cuts: list[tuple[int, int]] = []
        for i in np.flatnonzero(mark).tolist():
            word = t.text[head[i + 1] : min(tail[i + 1], head[i + 1] + 2)]
            if size := next((len(c) for c in CONTRACTIONS if word.startswith(c)), 0):
                ends[i] += size
                starts[i + 1] += size
                keep[i + 1] = starts[i + 1] < ends[i + 1]
        starts, ends = starts[keep], ends[keep]
        extra = [(tail[i] - 1, tail[i]) for i in np.flatnonzero(parted).tolist()] + [(a, a + len(next(c for c, v in self.added.items() if v == i))) for a, i in added.items()] + cuts
        if extra:
            more = np.array(extra, np.int64)
            starts, ends = np.concatenate((starts, more[:, 0])), np.concatenate((ends, more[:, 1]))
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
        return starts, ends, added

    def distinct(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the pre-tokens of `t`: all starts and the number of each one's distinct word; of the distinct words: hash, start, end, id of an added token or -1."""
        starts, ends, added = self.split(t)
        hashes = span_hashes(t.cps, starts, ends)
        if added:
            at = np.array(sorted(added), np.int64)
            hashes[np.searchsorted(starts, at)] = np.array([added[a] for a in at.tolist()], np.uint64)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        special = np.full(len(keys), -1, np.int64)
        if added:
            special = np.array([added.get(x, -1) for x in starts[first].tolist()], np.int64)
        return starts, which, keys, starts[first], ends[first], special

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        return self.one_piece.encode_ordinary(word)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.piece_lengths[ids]
        return self.piece_bytes[ragged(self.piece_starts[ids], lengths)].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes slices of texts; remembers the ids of words it has met."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """Remember the ids of new words, given by their sorted hashes."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, len(self.flat) + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.keys = np.insert(self.keys, where, keys)
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))))

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of pre-tokens, their numbers of ids, all ids in a row, and bounds: text i has ids bounds[i]:bounds[i + 1]."""
        starts, which, keys, first, last, special = self.vocabulary.distinct(t)
        if len(self.keys) > REMEMBERED:
            self.forget()
        if not len(keys):
            return starts, np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(len(t.gaps) + 1, np.int64)
        where = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        near = where < len(self.keys)
        new[near] = self.keys[where[near]] != keys[near]
        if new.any():
            merge, text = self.vocabulary.merge, t.text
            rows = zip(first[new].tolist(), last[new].tolist(), special[new].tolist(), strict=True)
            self.learn(keys[new], [merge(text[a:b]) if i < 0 else [i] for a, b, i in rows])
            where = np.searchsorted(self.keys, keys)
        size = self.size[where][which]
        ids = self.flat[ragged(self.at[where][which], size)]
        sums = np.concatenate(([0], np.cumsum(size)))
        return starts, size, ids, sums[t.bounds(starts)]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses again for later tasks."""
    return Encoder(path)


def checked_path(path: str | None) -> str:
    """The vocabulary file that is named, or the GPT-2-style one of the public_tokenizers package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path

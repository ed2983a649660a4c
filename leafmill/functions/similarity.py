"""Similarity of short texts, as Arrow-batched functions."""

from __future__ import annotations

import difflib
import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def similarity(a: str | None, b: str | None) -> float:
    """The best of: characters in order; 0.4 of that and 0.6 token Jaccard; 0.7 token containment and 0.3."""
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    seq = ratio(a, b)
    x, y = set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))
    if not x or not y:
        return seq
    both = len(x & y)
    return min(1.0, max(seq, 0.4 * seq + 0.6 * both / len(x | y), 0.7 * both / min(len(x), len(y)) + 0.3 * seq))


def at_least(a: str, b: str, threshold: float) -> bool:
    """``ratio(a, b) >= threshold``; cheap upper bounds of the ratio come first."""
    m = difflib.SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


class Known:
    """Lines by their source, and whether a new line is ``threshold`` similar to one of them.

    ``similarity`` is only taken where upper bounds allow it: a ratio is at most that of the common
    letters, and (as u unmatched letters part the others in u + 1 blocks at most) that of the common
    pairs of letters; common tokens are counted by an inverted index. Letters and pairs are hashed,
    which can only raise a bound."""

    LETTERS, PAIRS, SLACK = 64, 256, 1e-9

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.place: dict[str, int] = {}
        self.lines: list[str | None] = []  # a line that was replaced is null
        self.postings: dict[str, array] = {}
        self.length, self.n_tokens = np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.letters, self.pairs = np.zeros((16, self.LETTERS), np.int32), np.zeros((16, self.PAIRS), np.int32)

    def __contains__(self, source: str) -> bool:
        return source in self.place

    def __getitem__(self, source: str) -> str:
        return self.lines[self.place[source]]

    def _parts(self, line: str):
        text = line.lower().strip()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letters = np.bincount(codes % self.LETTERS, minlength=self.LETTERS)
        pairs = np.bincount((codes[:-1] * 31 + codes[1:]) % self.PAIRS, minlength=self.PAIRS)
        return len(text), letters, pairs, set(re.findall(r"\w+", text))

    def __setitem__(self, source: str, line: str) -> None:
        if source in self.place:
            self.lines[self.place[source]] = None
            self.length[self.place[source]] = -1
        i = self.place[source] = len(self.lines)
        self.lines.append(line)
        if i == len(self.length):
            for c in ("length", "n_tokens", "letters", "pairs"):
                x = getattr(self, c)
                setattr(self, c, np.concatenate([x, np.zeros_like(x)]))
        self.length[i], self.letters[i], self.pairs[i], tokens = self._parts(line)
        self.n_tokens[i] = len(tokens)
        for t in tokens:
            self.postings.setdefault(t, array("q")).append(i)

    def similar(self, line: str) -> bool:
        length, letters, pairs, tokens = self._parts(line)
        t = self.threshold - self.SLACK
        # under this ratio not even equal tokens make a line similar
        least = min(t, (t - 0.6) / 0.4, (t - 0.7) / 0.3)
        other = self.length[: len(self.lines)]
        near = np.flatnonzero((other >= 0) & (2 * np.minimum(length, other) >= least * (length + other)))
        total = np.maximum(length + other[near], 1)
        bound = np.where(length + other[near] == 0, 1.0, 2 * np.minimum(self.letters[near], letters).sum(1) / total)
        met = [np.frombuffer(self.postings[x], np.int64) for x in tokens if x in self.postings]
        both = np.bincount(np.concatenate([np.zeros(0, np.int64), *met]), minlength=len(self.lines))[near]
        either, fewer = len(tokens) + self.n_tokens[near] - both, np.minimum(len(tokens), self.n_tokens[near])
        best = lambda s, own: np.maximum(s, np.where(fewer[own] > 0, np.maximum(0.4 * s + 0.6 * both[own] / np.maximum(either[own], 1), 0.7 * both[own] / np.maximum(fewer[own], 1) + 0.3 * s), 0.0))
        own = np.flatnonzero(best(bound, slice(None)) >= t)
        common = np.minimum(self.pairs[near[own]], pairs).sum(1)
        closer = np.minimum(bound[own], 2 * (common + total[own] + 1) / (3 * total[own]))
        return any(similarity(line, self.lines[i]) >= self.threshold for i in near[own[best(closer, own) >= t]])


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


@pandas_udf(T.DoubleType())
def hybrid_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)])


@pandas_udf(T.BooleanType())
def cross_check_mismatch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Half the sequence ratio and half the token Jaccard stay under 0.45."""
    out = []
    for x, y in zip(a, b):
        x, y = (x or "").lower(), (y or "").lower()
        s, t = set(re.findall(r"\w+", x)), set(re.findall(r"\w+", y))
        out.append(0.5 * ratio(x, y) + 0.5 * len(s & t) / max(1, len(s | t)) < 0.45)
    return pd.Series(out)


@pandas_udf(T.BooleanType())
def meaningful_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    """Differs beyond case and punctuation; long texts also by similarity under 0.94."""
    out = []
    for x, y in zip(a, b):
        x, y = (re.sub(r"[\W_]+", "", t or "").lower() for t in (x, y))
        out.append(x != y and not (len(x) >= 10 and len(y) >= 10 and ratio(x, y) >= 0.94))
    return pd.Series(out)


def fuzzy_unique(texts: list[str], threshold: float = 0.65) -> list[bool]:
    """Which texts are added, in order, if none that was added before is so similar."""
    kept = Known(threshold)
    out = []
    for i, text in enumerate(texts):
        out.append(bool(text and text.strip()) and not kept.similar(text))
        if out[-1]:
            kept[str(i)] = text
    return out


# Short words of speech that are never taken for sounds.
NEVER_SOUNDS = "OH NO GO HUH AH UH UM HA HEH HEY NOW YES WHY STOP WAIT HELP RUN AHKK AHK ARGH URGH AAAH GAHH".split()
_BARE = re.compile(r"[^A-Z]")


_once = lambda w: re.sub(r"(.)\1+", r"\1", w)


def _letters(word: str) -> np.ndarray:
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) - ord("A")
    return np.bincount(codes[(codes >= 0) & (codes < 26)], minlength=26)


class Sounds:
    """Sound effects, made ready for many words: what a word is compared with is looked up, and a
    likeness is only measured where length and common letters allow it."""

    LIKE, LEAST = 0.80, 4

    def __init__(self, sounds: tuple[str, ...], common: frozenset[str]):
        self.sounds, self.common, self.told = sounds, common, {}
        self.names, self.once = set(sounds), {_once(s) for s in sounds}
        long = [s for s in sounds if len(s) >= self.LEAST]
        self.inside = re.compile("|".join(map(re.escape, long))) if long else None
        self.parts = {s[a:b] for s in long for a in range(len(s)) for b in range(a + self.LEAST, len(s) + 1)}
        self.length = np.array([len(s) for s in sounds], np.int64)
        self.letters = np.array([_letters(s) for s in sounds], np.int64).reshape(-1, 26)

    def judged(self, word: str) -> bool:
        bare = _BARE.sub("", word)
        if not bare or bare in NEVER_SOUNDS:
            return False
        if bare in self.names:
            return True
        if bare in self.common or word in self.common:
            return False
        if _once(bare) in self.once or bare in self.parts or self.inside is not None and self.inside.search(bare):
            return True
        return self._close(bare)

    def _close(self, bare: str) -> bool:
        """``difflib.get_close_matches(bare, sounds, n=1, cutoff=LIKE)``; a ratio is at most that of the common letters."""
        both = self.length + len(bare)
        near = np.flatnonzero(2.0 * np.minimum(self.length, len(bare)) >= (self.LIKE - 1e-9) * both)
        if not len(near):
            return False
        near = near[2.0 * np.minimum(self.letters[near], _letters(bare)).sum(1) >= (self.LIKE - 1e-9) * both[near]]
        return bool(len(near)) and bool(difflib.get_close_matches(bare, [self.sounds[i] for i in near], n=1, cutoff=self.LIKE))

    def __call__(self, word: str) -> bool:
        found = self.told.get(word)
        if found is None:
            if len(self.told) > 200_000:
                self.told.clear()
            found = self.told[word] = self.judged(word)
        return found


@lru_cache(maxsize=8)
def known_sounds(sounds: tuple[str, ...], common: frozenset[str]) -> Sounds:
    """One for all tasks of a worker."""
    return Sounds(sounds, common)


def sounds_like(word: str, sounds: list[str], common: frozenset[str]) -> bool:
    """Whether a word in capitals is a sound effect: by name, with letters drawn out, as part of a
    longer one, or by a likeness of 0.8."""
    return known_sounds(tuple(sounds), frozenset(common))(word)


def sounding(sounds: list[str], common: list[str]):
    """For arrays of words in capitals: (all, some) of them sound effects. Words are judged once a worker."""
    names, known = tuple(sounds), frozenset(common)

    @pandas_udf(T.StructType([T.StructField("all", T.BooleanType()), T.StructField("some", T.BooleanType())]))
    def judge(arrays: pd.Series) -> pd.DataFrame:
        told = known_sounds(names, known)
        rows = []
        for words in arrays:
            flags = [told(w) for w in words] if words is not None else []
            rows.append((bool(flags) and all(flags), any(flags) and len(flags) <= 2 and not any(w in known for w in words)))
        return pd.DataFrame(rows, columns=["all", "some"])

    return judge

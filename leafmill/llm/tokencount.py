"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For a byte-pair vocabulary, a token sequence is the encoding of its text exactly when each
adjacent pair of its tokens is the encoding of that pair's text. So for every prefix there is
one possible last token: the vocabulary entry that ends there and stands well beside the last
token of the prefix before it. ``last`` and ``count`` of all prefixes follow in one pass; a
truncation or budget question is then a look-up.

No merge of these models joins a word to the space mark after it, so the table of a text is
the tables of its words (space mark first) one after the other, each made once a worker.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Memo, bounded, gather, slices, text_lengths

SPACE = "▁"
_loaded: dict[str, "PrefixCounter"] = {}


def counter(path: str) -> "PrefixCounter":
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


class PrefixCounter:
    """Prefix tables of a sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: piece -> priority; the larger one is merged first
        self.priority = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.priority))
        if any(SPACE in p.lstrip(SPACE) for p in self.priority):
            raise ValueError("pieces that go on after a space can't be counted word by word")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo = Memo(self.tables)

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: the best pair first, the left one of equals."""
        parts = list(text)
        get = self.priority.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = get(parts[i] + parts[i + 1])
                if p is not None and (best is None or p > best):
                    best, at = p, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand after ``left`` (which may be empty)."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def tables(self, words: list[str]) -> list[np.ndarray]:
        """For each word, the counts at its prefixes of 1, 2, ... characters.

        In sorted order a word goes on from the prefix that it shares with the one before."""
        out: list = [None] * len(words)
        last, count, before = [""], [0], ""
        known, longest, pairs, fits = self.priority, self.longest, self.pairs, self.fits
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            n, i = len(word), 0
            shared = min(n, len(before))
            if word[:shared] == before[:shared]:
                i = shared
            else:
                while word[i] == before[i]:
                    i += 1
            del last[i + 1 :], count[i + 1 :]
            for i in range(i + 1, n + 1):
                for start in range(max(i - longest, 0), i):
                    token = word[start:i]
                    if token in known:
                        ok = pairs.get((last[start], token))
                        if ok or ok is None and fits(last[start], token):
                            last.append(token)
                            count.append(count[start] + 1)
                            break
                else:  # a character outside of the vocabulary is written as its bytes
                    last.append(word[i - 1])
                    count.append(count[i - 1] + len(word[i - 1].encode("utf-8", "surrogatepass")))
            out[at] = np.array(count[1:], np.int32)
            before = word
        return out

    def words(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, the word number of each place, and the texts' borders among places."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        unsure = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE))
        unsure = pc.or_(unsure, pc.starts_with(texts, " "))
        unsure = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
        mask = np.zeros(n, bool)
        mask[unsure] = True
        split = pc.split_pattern(pc.if_else(pa.array(mask), "", texts) if len(unsure) else texts, " ")
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        names, index = [SPACE + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy()
        empty = text_lengths(texts) == 0
        if len(unsure) or empty.any():  # runs of space marks stay with the word after them
            seen = {w: i for i, w in enumerate(names)}
            parts, sizes, done = [], np.diff(borders).astype(np.int64), 0
            for i in np.flatnonzero(empty | mask).tolist():
                text = texts[i].as_py()
                own = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)) if text else []
                parts += [index[borders[done] : borders[i]], np.array([seen.setdefault(w, len(seen)) for w in own], np.int64)]
                sizes[i], done = len(own), i + 1
            parts.append(index[borders[done] :])
            names, index, borders = list(seen), np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return names, index.astype(np.int64), borders

    def count(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: tokens, and characters of the longest prefix within ``budget``.

        Also the tables of all texts, one after the other: entry j of a text is the count at
        its prefix of j characters with the space mark before it counted as one character."""
        names, index, borders = self.words(texts)
        tables = self.memo.many(names) if names else []
        flat = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        sizes = np.fromiter(map(len, tables), np.int64, len(tables))
        ends = np.cumsum(sizes)
        totals = flat[ends - 1].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        running = np.concatenate([[0], np.cumsum(totals[index])])
        tokens = running[borders[1:]] - running[borders[:-1]]
        chars = np.concatenate([[0], np.cumsum(sizes[index])])
        fit = np.maximum(chars[borders[1:]] - chars[borders[:-1]] - 1, 0)
        for i in np.flatnonzero(tokens > budget).tolist():
            counts = self.prefixes(flat, ends, sizes, totals, index[borders[i] : borders[i + 1]])
            fit[i] = max(int(np.flatnonzero(counts <= budget)[-1]) if (counts <= budget).any() else 0, 0)
        return tokens, fit, flat, chars

    @staticmethod
    def prefixes(flat, ends, sizes, totals, index) -> np.ndarray:
        """The counts at all prefixes of a text whose words are ``index``."""
        own = sizes[index]
        before = np.cumsum(totals[index]) - totals[index]
        return flat[gather(ends[index] - own, own)] + np.repeat(before, own)

    def table_of_text(self, text: str) -> np.ndarray:
        """Counts at the prefixes of a text of 0, 1, 2, ... characters."""
        if not text:
            return np.zeros(1, np.int64)
        names, index, _ = self.words(pa.array([text]))
        tables = self.tables(names)
        sizes = np.array([len(x) for x in tables])
        flat = np.concatenate(tables)
        ends = np.cumsum(sizes)
        out = self.prefixes(flat, ends, sizes, flat[ends - 1].astype(np.int64), index)
        out[0] = 0  # without text there is no space mark before it
        return out


def _counted(path: str, budget: int, store: bool):
    def run(batches):
        told = counter(path)
        for batch in batches:
            for part in slices(batch, 1, between=40_000_000):
                texts = part.column(1)
                tokens, fit, _, _ = told.count(texts, budget)
                columns = [part.column(0), pa.array(text_lengths(texts)), pa.array(tokens), pa.array(tokens > budget), pa.array(fit)]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
                if store:
                    columns.append(pa.array([told.table_of_text(x.as_py() or "").astype(np.int32) for x in texts], pa.list_(pa.int32())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_counts(docs: DataFrame, model_path: str, *, budget: int = 4096, store: bool = False) -> DataFrame:
    """Count the tokens of each whole text of ``docs`` (doc_id, text) from its prefix table.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > budget) and fit_chars, the
    characters of the longest prefix of at most ``budget`` tokens. With ``store``,
    ``prefix_tokens`` holds the whole table: entry j is the exact count of the prefix of j
    characters (see ``tokens_of_prefix`` and ``longest_prefix``).

    A null text is an empty one with no tokens. Repeated rows and null ids are counted like any
    row; whole texts count, however long; other columns are left out; no rows give none. One narrow
    pass, without a shuffle."""
    bounded(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * store
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted(model_path, budget, store), schema)


def tokens_of_prefix(chars):
    """Tokens of the prefix of ``chars`` characters, from the stored table."""
    return F.try_element_at("prefix_tokens", F.least(F.lit(chars), F.size("prefix_tokens") - 1) + 1)


def longest_prefix(budget):
    """Characters of the longest prefix of at most ``budget`` tokens, from the stored table."""
    return F.array_max(F.transform("prefix_tokens", lambda x, i: F.when(x <= budget, i).otherwise(0)))

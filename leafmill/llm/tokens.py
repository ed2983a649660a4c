"""Whole-text token ids, equal to those of the tokenizers library.

Where a vocabulary's merges rank its tokens (byte-level ones, and those with word ends), texts go
through the merge loop of tiktoken, which is several times faster than the library's; a word end is
a byte of its own there, which always merges first. Texts with what that loop may read otherwise
(special tokens, very long runs of white space, letters whose small form is no single letter, rare
scripts where letters are made small) go to the library, as do all texts of other vocabularies,
whole or by distinct words, cut only where the tokenizer's own pre-tokenizer always cuts.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafmill.llm.common import Memo, gather

#: White space of the pre-tokenizer's pattern that RE2's \s lacks.
_MORE_SPACE = "\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_S = f"[\\s{_MORE_SPACE}]"

#: The patterns of pre-tokens that these vocabularies name or imply.
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKEN = f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^\\s\\p{{L}}\\p{{N}}{_MORE_SPACE}]+"
#: Stands for the end of a word; texts that hold it are rare.
_END = "\x7f"
#: What is not made small letter by letter, or could be composed, or is the end mark.
_RARE = "[^\\x00-\\x7e\\x{80}-\\x{12f}\\x{131}-\\x{24f}\\x{2000}-\\x{2027}\\x{2030}-\\x{205e}\\x{20ac}]"

_loaded: dict[str, "TextEncoder"] = {}


def encoder(path: str) -> "TextEncoder":
    """One encoder a worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]


class TextEncoder:
    """Ids of many texts as one flat array with borders."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        normal = self.library.normalizer
        self.lowers = normal is not None and normal.normalize_str("ABXYZ") == "abxyz"
        self.memo = Memo(self._words, half=60_000)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind = told["pre_tokenizer"]["type"]
        #: Byte-level tokens carry the space before a word; else white space is dropped.
        self.keeps_space = kind == "ByteLevel"
        self.ranked, self.real = _ranked(told)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, names: list[str]) -> list[bytes]:
        """Ids of words where white space is dropped. A mark behind a letter is a pre-token of its own,
        and where all is made small ASCII capitals read as small letters: many new words are known."""
        out: list = [None] * len(names)
        plain, derived, stems, tails = [], [], [], []
        for i, name in enumerate(names):
            stem, tail = (name.lower() if self.lowers and name.isascii() and "<|" not in name else name), ""
            if len(stem) > 2 and stem[-1] in ",." and stem[-2].lower().isalpha():  # some letters gain marks when made small
                stem, tail = stem[:-1], stem[-1]
            if stem == name:
                plain.append(i)
            else:
                derived.append(i)
                stems.append(stem)
                tails.append(tail)
        for i, value in zip(plain, self._encode([names[i] for i in plain])):
            out[i] = value
        if derived:
            marks = {t: self._encode([t])[0] if t else b"" for t in set(tails)}
            for i, value, tail in zip(derived, self.memo.many(stems), tails):
                out[i] = value + marks[tail]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, borders): the ids of text i are ids[borders[i]:borders[i + 1]]; null is empty."""
        texts = pc.fill_null(texts, "")
        if self.ranked is None:
            return self._whole(texts) if self.keeps_space else self._by_words(texts)
        rare = f"{_S}{{1000}}" if self.keeps_space else f"{_S}{{1000}}|{_RARE}"
        unsure = pc.match_substring_regex(texts, rare)
        for special in self.specials:
            unsure = pc.or_(unsure, pc.match_substring(texts, special))
        unsure = unsure.to_numpy(zero_copy_only=False)
        sure = np.flatnonzero(~unsure)
        read = texts.take(pa.array(sure))
        if not self.keeps_space:
            read = _marked(pc.utf8_lower(read) if self.lowers else read)
        found = [np.array(self.ranked.encode_ordinary(t), np.uint32) for t in read.to_pylist()]
        if self.real is not None:
            found = [self.real[x] for x in found]
        if len(sure) < len(texts):
            ids, borders = (self._whole if self.keeps_space else self._by_words)(texts.filter(pa.array(unsure)))
            own, parts = iter(found), iter([ids[a:b] for a, b in zip(borders[:-1], borders[1:])])
            found = [next(parts) if x else next(own) for x in unsure.tolist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum(sizes)])

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._encode(texts.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        borders = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        values = self.memo.many(names) if names else []
        flat = np.frombuffer(b"".join(values), np.uint32)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        per_word = sizes[index]
        return flat[gather(starts[index], per_word)], np.concatenate([[0], np.cumsum(per_word)])[borders]


def _marked(texts: pa.Array) -> pa.Array:
    """The texts with the end of each pre-token marked.

    Without shortened words, pre-tokens end where a kind of character does; an end is found with
    what stands behind it, which the expression engine does fast. Others are cut by the whole pattern."""
    short = pc.match_substring_regex(texts, "'(s|t|re|ve|m|ll|d)")
    some = pc.any(short).as_py()
    out = pc.if_else(short, "", texts) if some else texts
    out = pc.replace_substring_regex(out, "(\\p{L})([^\\p{L}]|$)", f"\\1{_END}\\2")
    out = pc.replace_substring_regex(out, "(\\p{N})", f"\\1{_END}")
    mark = f"[^\\s\\p{{L}}\\p{{N}}{_MORE_SPACE}\\x7f]"
    out = pc.replace_substring_regex(out, f"({mark})([\\s\\p{{L}}\\p{{N}}{_MORE_SPACE}\\x7f]|$)", f"\\1{_END}\\2")
    return pc.if_else(short, pc.replace_substring_regex(pc.if_else(short, texts, ""), f"({_PRE_TOKEN})", f"\\1{_END}"), out) if some else out


def _byte_of() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as characters: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def _ranked(told: dict):
    """(merge loop, its numbers as ids) of a vocabulary whose merges rank its tokens, else nulls.

    The numbers are null where they are the ids."""
    import tiktoken

    model, parts = told["model"], told["pre_tokenizer"].get("pretokenizers", [])
    vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
    special = {t["content"] for t in told["added_tokens"]}
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout"):
        return None, None
    byte = _byte_of()
    made = ["".join(m if not isinstance(m, str) else m.split(" ", 1)) for m in model["merges"]]
    if end:
        made = [x for x in made if x]
    ids = [vocabulary.get(x) for x in made]
    if None in ids or len(set(made)) < len(made):
        return None, None
    if told["pre_tokenizer"]["type"] == "ByteLevel" and not end and told["normalizer"] is None:
        if told["pre_tokenizer"].get("add_prefix_space") or not told["pre_tokenizer"].get("use_regex", True) or ids != sorted(ids):
            return None, None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        return tiktoken.Encoding("ranked", pat_str=_SPACED, mergeable_ranks=ranks, special_tokens={}), None
    cut = parts[0].get("pattern", {}).get("Regex") if parts else None
    if end != "</w>" or cut != _WORDS or len(parts) != 2 or parts[1]["type"] != "ByteLevel" or parts[1].get("use_regex", True) or parts[1].get("add_prefix_space"):
        return None, None

    def written(token: str) -> bytes:
        inner = token.removesuffix(end)
        return bytes(byte[c] for c in inner) + (_END.encode() if inner != token else b"")

    # a byte with the end of a word comes first, so that no other merge can part the two
    ends = [c + end for c in byte if c + end in vocabulary]
    order = [*ends, *(c for c in byte if c in vocabulary), *(x for x in made if x not in set(ends))]
    if len(ends) < 256 or len(order) < len(ends) + 256:
        return None, None
    ranks, real = {}, np.zeros(len(order) + 1, np.uint32)
    for token in order:
        key = written(token)
        if key not in ranks:
            real[len(ranks)] = vocabulary[token]
            ranks[key] = len(ranks)
    return tiktoken.Encoding("ranked", pat_str=f"[^\\s{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}), real

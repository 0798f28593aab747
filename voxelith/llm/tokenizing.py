"""Whole texts to token ids by the tokenizers library, each distinct word once.

The normaliser and pre-tokenizer of the vocabularies used here treat blanks as
separators only, so the ids of a text are the ids of its blank-separated words
in order, and closing punctuation after a letter is a run of its own.
`splits_at_blanks` proves both for a tokenizer file from its pattern before the
word route is taken; any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import expand, words_of

#: ASCII punctuation that never joins the letters before it, after a letter whose lower case is one letter.
_CLOSING = ".,;:!?%&#$*)"
_STEM_AND_TAIL = "(?s)^(?P<stem>.*[A-Za-zÀ-ÖØ-öø-į])(?P<tail>[" + _CLOSING + "]+)$"
#: What a pattern may be made of, besides literals of an apostrophe and letters: letters, digits and marks never share a
#: match, and no match holds white space.
_LETTERS, _DIGITS, _MARKS = {r"[\p{L}]+", r"\p{L}+"}, {r"[\p{N}]", r"\p{N}", r"[\p{N}]+", r"\p{N}+"}, {r"[^\s\p{L}\p{N}]+"}
_LOADED: dict[str, "WordEncoder"] = {}


def _apart(pattern) -> bool:
    """Whether a pattern is made of letters, digits, marks and literals like 's only, so that its matches end at blanks,
    and between a letter and closing punctuation."""
    parts = pattern.get("Regex", "").split("|") if isinstance(pattern, dict) else []
    known = _LETTERS | _DIGITS | _MARKS
    return all(p in known or re.fullmatch(r"'[a-z]+", p) for p in parts) and all(set(parts) & kind for kind in (_LETTERS, _DIGITS, _MARKS))


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file drops white space and parts words as `_STEM_AND_TAIL` does, so that no token depends on
    both sides of a blank or of the place before closing punctuation. Files of any other make give no."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    norm = spec.get("normalizer") or {}
    parts = norm.get("normalizers", [norm] if norm else [])
    dropping = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and _apart(steps[0].get("pattern"))
    later = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex", True) for s in steps[1:])
    local = all(p.get("type") in ("NFC", "Lowercase") or (p.get("type") == "Replace" and p["pattern"] == {"Regex": "\\s+"} and p["content"] == " ") for p in parts)
    special = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
    plain = spec.get("truncation") is None and spec.get("padding") is None
    return bool(dropping and later and local and special and plain)


class WordEncoder:
    """Encodes Arrow string arrays; keeps the ids of up to `keep` words met twice (about 200 bytes each)."""

    def __init__(self, path: str, keep: int = 300_000, slice_bytes: int = 2 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_at_blanks(spec | {"truncation": None, "padding": None})
        self.lowers = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.keep, self.slice_bytes, self.known, self.seen = keep, slice_bytes, {}, bytearray(1 << 22)
        marks = [(t["content"], t["id"]) for t in spec.get("added_tokens", []) if t["special"] and not t["normalized"]]
        self.mark = marks[-1] if marks else None

    def _fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words not met before, as bytes of unsigned 32-bit integers."""
        if self.mark is None or any("<" in w for w in words):
            return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        text, mark = self.mark  # one call: a special token, which no word here holds, between the words
        (whole,) = self.tokenizer.encode_batch_fast([text.join(words)], add_special_tokens=False)
        ids = np.array(whole.ids, dtype=np.uint32)
        cuts = np.flatnonzero(ids == mark)
        raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]

    def runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct strings, one after another, and the length of each string's run."""
        known, seen, listed = self.known, self.seen, words.to_pylist()
        got = list(map(known.get, listed))
        missing = [i for i, x in enumerate(got) if x is None]
        odd = [i for i in missing if "<" in listed[i]]
        for some in (odd, sorted(set(missing).difference(odd)) if odd else missing):
            if some:
                fresh = [listed[i] for i in some]
                found = self._fresh(fresh)
                for i, x in zip(some, found, strict=True):
                    got[i] = x
                if len(known) < self.keep:  # those met a second time
                    for w, x in zip(fresh, found, strict=True):
                        h = hash(w) & 0x3FFFFF
                        if seen[h]:
                            known[w] = x
                        seen[h] = 1
        return np.frombuffer(b"".join(got), dtype=np.uint32), np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring(texts, "\n", " ")
        if self.lowers:  # but where a special token may be
            texts = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        words, codes, offsets = words_of(texts)
        # Closing punctuation after a Latin letter is a token run of its own, so many rare words share a stem.
        parts = pc.extract_regex(words, _STEM_AND_TAIL)
        stems = pc.coalesce(pc.struct_field(parts, "stem"), words).dictionary_encode()
        tails = pc.coalesce(pc.struct_field(parts, "tail"), pa.scalar("", words.type)).dictionary_encode()
        pools, lengths = zip(self.runs(stems.dictionary), self.runs(tails.dictionary), strict=True)
        stem_of, tail_of = (x.indices.to_numpy(zero_copy_only=False) for x in (stems, tails))
        both = np.empty(2 * len(codes), dtype=np.int32)
        both[0::2], both[1::2] = stem_of[codes], len(lengths[0]) + tail_of[codes]
        n = np.concatenate(lengths)
        return expand(both, 2 * offsets, n, np.cumsum(n) - n, np.concatenate(pools))

    def slices(self, texts: pa.Array):
        """Consecutive parts of the texts of about slice_bytes each: (first row, rows)."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(sizes):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + self.slice_bytes, side="right")))
            yield at, to - at
            at = to

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and each text's offsets in them."""
        if not self.by_word:
            runs = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*runs, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, runs)])
        return self._encode_slice(texts)


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]

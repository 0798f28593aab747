"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

Encoding. An Aho-Corasick automaton of all tokens gives the longest token that
starts at a place (as matches end by end, the longest start is read off a
table). Tokens are laid from the left, longest first; a token may follow
another only where the pair is compatible, which means that merging the two
strings by rank never makes a token across their border. Where no token fits,
the last one is taken back and its next shorter prefix tried; a place that
failed once is never tried again, so the work is linear in the text. The
result equals that of merging by rank.

Compatibility. While merges go on, the symbols that touch the border are a
token of the right spine of the left string and one of the left spine of the
right string. Symbol x stands there from its own merge until its parent's. The
border is crossed if some x, y have a merge whose rank comes before x's
parent's, and not after y's parent's (equal ranks merge leftmost first).

Decoding. The bytes of all tokens lie in one pool; ids select runs of it by a
table of offsets.

Whole texts are encoded word by word: the pre-tokenizer drops white space, so
the ids of a text are those of its words, and each distinct word is encoded
once a batch.

Defined cases: a null or empty text has no ids and decodes to an empty text;
special tokens in a text are found before anything else, as the library does;
a null doc_id stays null; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents, expand, words_of
from .tokenizing import _CLOSING, splits_at_blanks

_LOADED: dict[str, "BacktrackingBPE"] = {}


class BacktrackingBPE:
    """Encoder and decoder of a BPE tokenizer file that splits at white space."""

    def __init__(self, path: str, keep: int = 300_000, slice_bytes: int = 4 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if not splits_at_blanks(spec | {"truncation": None, "padding": None}) or model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError("only BPE files that drop white space and have no unknown token are supported")
        if spec.get("decoder") is not None:
            raise ValueError("a decoder step is not supported: tokens are joined by blanks")
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = sorted(((t["content"], t["id"]) for t in spec["added_tokens"]), key=lambda x: -len(x[0]))
        self.keep, self.slice_bytes, self.known, self.known_pieces = keep, slice_bytes, {}, {}
        vocab = model["vocab"]
        #: The last character of a word and its end mark count as one character.
        self.closed: dict[int, str] = {}
        inner = {self._inner(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # id: left, right, rank
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y], self.merged[x, y] = r, z
            if z in self.parts or any(r <= self.parts[p][2] for p in (x, y) if p in self.parts):
                raise ValueError("merges that make a token twice, or out of order, are not supported")
            self.parts[z] = (x, y, r)
        self.fits: dict[tuple[int, int], bool] = {}
        self.base = {s: i for s, i in inner.items() if len(s) == 1}
        # a token whose own parts do not fit together never comes out of merging
        usable = {i: s for s, i in inner.items() if len(s) == 1 or (i in self.parts and self.compatible(*self.parts[i][:2], own=i))}
        self.text = usable
        self.automaton = ahocorasick.Automaton()
        for i, s in usable.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.ids_of = {s: i for i, s in usable.items()}
        # next shorter token that is a prefix, found from short to long
        self.shorter = {i: next((self.ids_of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids_of), -1) for i, s in usable.items()}
        content = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials}
        size = max(content) + 1
        raw = [(content.get(i, "") + " ").encode() for i in range(size)]
        self.lengths = np.array([len(x) for x in raw], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def _inner(self, token: str) -> str:
        s = self.suffix
        if s and token.endswith(s) and len(token) > len(s):
            return token[: -len(s) - 1] + self._close(token[-len(s) - 1])
        return token

    def _close(self, char: str) -> str:
        """A character of a private plane for a character that ends a word."""
        return chr(0xF0000 + ord(char)) if self.suffix else char

    def compatible(self, left: int, right: int, own: int = -1) -> bool:
        """Whether no merge ever crosses the border of two tokens; own: but for the merge that makes this token."""
        key = (left, right)
        if own < 0 and key in self.fits:
            return self.fits[key]
        never = 1 << 60
        last = self.parts[own][2] if own >= 0 else never
        ok, x, x_until = True, left, last
        while ok:
            y, y_until = right, last
            while True:
                r = self.rank.get((x, y), never)
                if r < x_until and (r <= y_until if y_until != last else r < y_until):
                    ok = False
                    break
                if y not in self.parts:
                    break
                y, _, y_until = self.parts[y]
            if x not in self.parts:
                break
            _, x, x_until = self.parts[x]
        if own < 0:
            self.fits[key] = ok
        return ok

    def piece(self, piece: str) -> list[int]:
        """The ids of one pre-token (in the vocabulary's byte characters)."""
        found = self.known_pieces.get(piece)
        if found is not None:
            return found
        word = piece[:-1] + self._close(piece[-1])
        n = len(word)
        longest = [-1] * n
        for end, i in self.automaton.iter(word):
            start = end + 1 - len(self.text[i])
            if longest[start] < 0 or len(self.text[i]) > len(self.text[longest[start]]):
                longest[start] = i
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while at < n:
            placed = False
            while token >= 0:
                to = at + len(self.text[token])
                if not dead[to] and (not out or self.compatible(out[-1], token)):
                    placed = True
                    break
                token = self.shorter[token]
            if placed:
                out.append(token)
                at = to
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("a character that no token covers")
                token = out.pop()
                at -= len(self.text[token])
                token = self.shorter[token]
        if len(self.known_pieces) < self.keep:
            self.known_pieces[piece] = out
        return out

    def word(self, word: str) -> list[int]:
        """The ids of a text without white space at which a longer text was split."""
        for content, i in self.specials:
            if content in word:
                head, _, rest = word.partition(min((c for c, _ in self.specials if c in word), key=word.index))
                mark = word[len(head) : len(word) - len(rest)]
                return self.word(head) + [dict(self.specials)[mark]] + self.word(rest)
        return [i for p, _ in self.pre_tokenize(self.normalize(word)) for i in self.piece(p)] if word else []

    def _word_bytes(self, w: str) -> bytes:
        got = self.known.get(w)
        if got is None:
            stem = w.rstrip(_CLOSING)
            if stem and len(stem) < len(w) and stem[-1] < "İ" and stem[-1].isalpha():
                got = self._word_bytes(stem) + self._word_bytes(w[len(stem) :])
            else:
                got = np.array(self.word(w), dtype="<u4").tobytes()
            if len(self.known) < self.keep:
                self.known[w] = got
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and each text's offsets in them."""
        words, codes, offsets = words_of(pc.replace_substring(texts, "\n", " "))
        runs = [self._word_bytes(w) for w in words.to_pylist()]
        lengths = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) // 4
        return expand(codes, offsets, lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(runs), dtype="<u4"))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts of the runs of ids that the offsets bound, in UTF-8; ids without a token are left out."""
        if len(ids) and int(ids.max()) >= len(self.lengths):
            keep = ids < len(self.lengths)
            offsets, ids = np.concatenate(([0], np.cumsum(keep)))[offsets], ids[keep]
        data, bounds = expand(ids, offsets, self.lengths, self.starts, self.pool)
        raw, b = data.tobytes(), bounds.tolist()
        return [raw[s : e - 1] if e > s else b"" for s, e in zip(b[:-1], b[1:], strict=True)]


def coder(path: str) -> BacktrackingBPE:
    """One coder a worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = BacktrackingBPE(path)
    return _LOADED[path]


def _each(texts_of, bpe):
    from .tokenizing import WordEncoder

    return WordEncoder.slices(bpe, texts_of)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of every document."""

    def run(batches):
        bpe = coder(tokenizer)
        for batch in batches:
            for first, n in _each(batch.column("text"), bpe):
                ids, offsets = bpe.encode(batch.column("text").slice(first, n))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), lists], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids (array of int; null: no ids)."""

    def run(batches):
        bpe = coder(tokenizer)
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), pa.scalar([], batch.column("ids").type))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            texts = [x.decode("utf-8", "replace") for x in bpe.decode(ids, offsets - offsets[0])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and the sha256 of the ids (little-endian, unsigned, 32 bits) and of the decoded text."""

    def run(batches):
        bpe = coder(tokenizer)
        for batch in batches:
            for first, n in _each(batch.column("text"), bpe):
                ids, offsets = bpe.encode(batch.column("text").slice(first, n))
                raw, b = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
                shas = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(b[:-1], b[1:], strict=True)]
                texts = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids.astype(np.int64), offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.diff(offsets), pa.int64()), pa.array(shas), pa.array(texts)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

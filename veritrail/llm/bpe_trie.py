"""Byte-pair encoding of distinct words by depth-first traversal of a trie."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections import ChainMap

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_END = "</w>"
#: The word pattern that texts of Latin-1 letters may take a quicker way for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which the standard library's classes differ from the pattern's.
_UNLIKE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f²³¹¼½¾Ā-\U0010ffff]").search
_MARKS = "".join(re.escape(c) for c in map(chr, range(256)) if not c.isspace() and not c.isalnum())
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[{_MARKS}]+").findall
_NEVER = 1 << 60
SHORT = 6
#: Characters from which a word goes through without the trie, whose nodes it would fill alone.
LONG = 400
#: What a character is tried in, to see whether the library takes it as this process does: with
#: letters, digits and marks of other orders of composition next to it.
_TRIALS = ("a{}b", "{}1{}", "a\u0301{}b", "a{}\u0316\u0301b", " {} ", "{}{}!")


class _Prefixes:
    """The last token of each prefix of one word, told by its length alone."""

    def __init__(self, text: str):
        self.text, self.lengths = text, array("H", [0])

    def __getitem__(self, depth: int) -> str:
        return self.text[depth - self.lengths[depth] : depth]


def byte_characters() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stands for itself, the other bytes
    take the code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes as the tokenizer of ``path`` does (normaliser: NFC and lower case; words by
    its own pattern; byte-level merges with a word-end suffix), and decodes likewise.

    A prefix of a word has one encoding, and it ends in one token; with that token for
    every shorter prefix, the one for the next prefix is the vocabulary suffix whose
    predecessor may stand before it unmerged. So a trie node keeps only its last token
    and words that share a prefix share its encoding.
    """

    def __init__(self, path: str, keep: int = 800_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.latin = _LATIN if pattern == PATTERN else self.find
        self.alike: set[str] = set()
        self.unlike: set[str] = set()
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.longest = max(len(t.removesuffix(WORD_END)) for t in self.vocab)
        self.characters = byte_characters()
        self.bytes = {c: b for b, c in self.characters.items()}
        self.splits: dict[str, tuple[str, str] | None | bool] = {}
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.keep = keep
        self.ends: dict[tuple[str, str], list] = {}
        #: What the last SHORT characters of longer tokens are.
        self.deep = set()
        for token in self.vocab:
            body = token.removesuffix(WORD_END) or token
            if len(body) > SHORT:
                self.deep.add((body[-SHORT:], token[len(body) :]))

    def symbols(self, token: str) -> list[str]:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[: -len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return [*token]

    def split(self, token: str):
        """The last merge that makes ``token``; None for a symbol; False if merging the
        token's own symbols doesn't give the token."""
        if token not in self.splits:
            parts, last = self.symbols(token), None
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), _NEVER))
                if (parts[best], parts[best + 1]) not in self.rank:
                    break
                last = (parts[best], parts[best + 1])
                parts[best : best + 2] = ["".join(last)]
            self.splits[token] = last if len(parts) == 1 else False
        return self.splits[token]

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces at one edge of ``token``, from its symbol up, each with the rank of the
        merge that takes it up."""
        kept = self.right if side else self.left
        if token not in kept:
            out, piece, until = [], token, _NEVER
            while True:
                out.append((piece, until))
                if not (parts := self.split(piece)):
                    break
                until, piece = self.rank[parts], parts[side]
            kept[token] = out[::-1]
        return kept[token]

    def may_stand(self, first: str, second: str) -> bool:
        """Whether merging the symbols of both leaves the two tokens as they are: while
        two edge pieces stand side by side, no merge of the two comes first."""
        found = self.pairs.get((first, second))
        if found is None:
            a, b, i, j = self.spine(first, 1), self.spine(second, 0), 0, 0
            while True:
                (left, left_until), (right, right_until) = a[i], b[j]
                merged = self.rank.get((left, right), _NEVER)
                if merged < left_until and merged <= right_until and merged < _NEVER:
                    found = False
                    break
                if left_until == right_until == _NEVER:
                    found = True
                    break
                if left_until <= right_until:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > self.keep // 2:
                self.pairs.clear()
            self.pairs[first, second] = found
        return found

    def endings(self, tail: str, end: str) -> list[tuple[int, str]]:
        """The usable tokens that end ``tail``, longest first; kept by the last characters,
        beyond which hardly any token reaches."""
        found = self.ends.get((tail, end))
        if found is None:
            found = []
            for length in range(len(tail), 0, -1):
                token = tail[-length:] + end
                if token in self.vocab and self.split(token) is not False:
                    found.append((length, token))
            if len(self.ends) > self.keep // 2:
                self.ends.clear()
            self.ends[tail, end] = found
        return found

    def last_token(self, tail: str, end: str, depth: int, tokens: list) -> tuple[int, str]:
        pairs = self.pairs
        near = tail[-SHORT:]
        if depth > SHORT and (near, end) in self.deep:
            for length in range(min(depth, self.longest), SHORT, -1):
                token = tail[-length:] + end
                if token in self.vocab and self.split(token) is not False:
                    if length == depth or self.may_stand(tokens[depth - length], token):
                        return length, token
        for length, token in self.endings(near, end):
            if length == depth:
                return length, token
            first = tokens[depth - length]
            fits = pairs.get((first, token))
            if fits or fits is None and self.may_stand(first, token):
                return length, token
        raise ValueError("a symbol isn't in the vocabulary")

    def encode_words(self, words) -> None:
        """Puts the encodings of ``words`` into ``known``."""
        root: dict = {}
        table, most, last_token, known, vocab = self.characters, self.longest, self.last_token, self.known, self.vocab
        for word in words:
            text = word if word.isascii() and word.isprintable() else "".join([table[b] for b in word.encode("utf-8", "surrogatepass")])
            if len(text) > LONG:
                self.long[word] = self.encode_long(text)
                continue
            node = root
            for c in text[:-1]:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            if "" in node:
                node[""].append((text[-1], word))
            else:
                node[""] = [(text[-1], word)]
        lengths, tokens = [0], [""]
        stack = [(root, 0, "")]
        while stack:
            node, depth, tail = stack.pop()
            if depth:
                del lengths[depth:], tokens[depth:]
                length, token = last_token(tail, "", depth, tokens)
                lengths.append(length)
                tokens.append(token)
            for c, below in node.items():
                if c:
                    stack.append((below, depth + 1, tail + c if depth < most else (tail + c)[-most:]))
                    continue
                for end, word in below:
                    length, token = last_token(tail + end if depth < most else (tail + end)[-most:], WORD_END, depth + 1, tokens)
                    at = depth + 1 - length
                    if not at:
                        known[word] = (vocab[token].to_bytes(4, "little"), token)
                        continue
                    out = [token]
                    while at:
                        out.append(tokens[at])
                        at -= lengths[at]
                    out.reverse()
                    known[word] = (array("I", [vocab[t] for t in out]).tobytes(), " ".join(out))

    def encode_long(self, text: str) -> tuple[bytes, str]:
        """One word by the trie's recurrence, as a trie of one branch: two bytes a character."""
        prefixes, most = _Prefixes(text), self.longest
        for depth in range(1, len(text)):
            prefixes.lengths.append(self.last_token(text[max(0, depth - most) : depth], "", depth, prefixes)[0])
        length, token = self.last_token(text[-most:], WORD_END, len(text), prefixes)
        out, at = [token], len(text) - length
        while at:
            out.append(prefixes[at])
            at -= prefixes.lengths[at]
        out.reverse()
        return array("I", [self.vocab[t] for t in out]).tobytes(), " ".join(out)

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """``(word, is it a special token)`` of a text that holds special tokens."""
        out = []
        for k, part in enumerate(self.special_pattern.split(text)):
            out += [(part, True)] if k % 2 else [(w, False) for w in self.words(part)]
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens. Characters beyond Latin-1 are tried once,
        and a text with one that the library classes or composes otherwise (its tables may be
        older or newer than this process's) is cut by the library's own normaliser and pattern."""
        normal = self.normal(text)
        if not _UNLIKE(normal):
            return self.latin(normal)
        new = set(text).difference(self.alike)
        if new:
            for c in new.difference(self.unlike):
                (self.alike if self._same(c) else self.unlike).add(c)
            if not new.isdisjoint(self.unlike):
                return self.library_words(text)
        return self.find(normal)

    def _same(self, c: str) -> bool:
        trials = [t.replace("{}", c) for t in _TRIALS]
        return all(self.find(self.normal(t)) == self.library_words(t) for t in trials)

    def library_words(self, text: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.bytes[c] for c in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str, int]]:
        """Little-endian 32-bit ids, decoded text and number of ids of each text."""
        cut = [None if self.special_pattern is not None and self.special_pattern.search(t) else self.words(t) for t in texts]
        new = set()
        for words, text in zip(cut, texts):
            new.update(words if words is not None else (w for w, special in self.pieces(text) if not special))
        if len(self.known) > self.keep:
            self.known.clear()
        self.long: dict[str, tuple[bytes, str]] = {}
        self.encode_words(new.difference(self.known))
        known = self.known if not self.long else ChainMap(self.long, self.known)
        out = []
        for words, text in zip(cut, texts):
            if words is None:
                got = [known[w] if not s else (array("I", [self.special[w]]).tobytes(), w) for w, s in self.pieces(text)]
            else:
                got = [known[w] for w in words]
            ids, decoded = zip(*got) if got else ((), ())
            joined = b"".join(ids)
            out.append((joined, " ".join(decoded), len(joined) // 4))
        self.long = {}
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row; ``with_ids`` adds
    ``ids`` (array<int>) and ``decoded``.

    ``vocabulary`` is the path of the vocabulary on the executors. A null text counts as
    empty: no ids, the digests of no bytes. Rows are independent, so repeated ids, empty
    tables and other columns change nothing. Rows go through in slices bounded by
    characters; the word cache is bounded too, and a word of LONG characters or more costs
    some bytes a character, not a node, and isn't cached.
    """

    def run(batches):
        trie = encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= 4_000_000):
                    size += len(texts[upto])
                    upto += 1
                got = trie.encode_batch(texts[at:upto])
                columns = [
                    ids.slice(at, upto - at),
                    pa.array([n for _, _, n in got], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b, _, _ in got]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d, _ in got]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([array("I", b).tolist() for b, _, _ in got], pa.list_(pa.int32())), pa.array([d for _, d, _ in got])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = upto

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")

"""BPE encoding and decoding: distinct words share a trie, whose nodes hold the last token of their prefix's encoding.

The encoding of a prefix is the encoding of a shorter prefix and one token. So a node needs only its last token; it is the
suffix token that stands next to the last token of the shorter prefix without merging with it (published for byte-pair
encodings in general: a row of tokens is an encoding if all its neighbours are). Prefixes that words share are encoded once.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.common import claim, table

#: Chunks of text that a Python worker remembers, and as many that it used before.
MEMORY = 300_000
#: Words that it remembers likewise.
WORDS = 300_000
#: Prefixes in the trie, which starts anew beyond.
NODES = 400_000
PAIRS = 1_000_000
#: Tokens of so many symbols or more are looked up by their last ones.
TAIL = 5
SHORT = tuple(range(TAIL - 1, 0, -1))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1 and no space, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TrieBpe:
    """A tokenizer file with end-of-word suffix, lower case and a splitting pattern, read once in each Python worker."""

    _loaded: dict[str, TrieBpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in (self.vocab | self.special).items()}
        self.letters = byte_letters()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.size: dict[str, int] = {}  # symbols of each token that its own symbols give back
        self.parts: dict[str, tuple[str, str]] = {}  # its last merge
        for token in self.vocab:
            symbols = self._symbols(token)
            row = self._merge(symbols)
            if row == [token]:
                self.size[token] = len(symbols)
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        # lengths of the tokens of more than TAIL symbols that end with these TAIL ones, the longest first, and TAIL itself
        ends: dict[str, set[int]] = {}
        for token, n in self.size.items():
            if n >= TAIL:
                ends.setdefault("".join(self._symbols(token)[-TAIL:]), set()).add(n)
        self.ends = {tail: tuple(sorted(ns, reverse=True)) for tail, ns in ends.items()}
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[bytes, tuple[bytes, bytes]] = {}  # (ids as little-endian 32-bit integers, decoding) of chunks
        self.old: dict[bytes, tuple[bytes, bytes]] = {}
        self.trie: list = ["", {}]  # a node: last token of its prefix's encoding, nodes below by letter
        self.nodes = 0
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.old_words: dict[str, tuple[bytes, bytes]] = {}

    @classmethod
    def load(cls, path: str) -> TrieBpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair encoding of a few symbols: the merge of least rank first, leftmost first."""
        row = list(symbols)
        while len(row) > 1:
            best, at = min((self.rank.get((row[i], row[i + 1]), len(self.rank)), i) for i in range(len(row) - 1))
            if best == len(self.rank):
                break
            if len(row) == 2:
                self.parts[row[0] + row[1]] = (row[0], row[1])
            row[at : at + 2] = [row[at] + row[at + 1]]
        return row

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens that stand at one side (0: left, 1: right) while token is built, each with the rank of the merge that ends it."""
        known = self.edges.get((token, side))
        if known is None:
            known, until, part = [], len(self.rank), token
            while True:
                known.append((part, until))
                if part not in self.parts:
                    break
                until, part = self.rank[self.parts[part]], self.parts[part][side]
            self.edges[token, side] = known
        return known

    def _stand_apart(self, left: str, right: str) -> bool:
        """Whether no merge goes across: one does if both of its parts stand at the border at its turn; of equal ranks, the left one is first."""
        if len(self.apart) > PAIRS:
            self.apart.clear()
        rank, never, right_edge = self.rank, len(self.rank), self._edge(right, 0)
        crossed = any((turn := rank.get((a, b), never)) < a_until and turn <= b_until and turn < never for a, a_until in self._edge(left, 1) for b, b_until in right_edge)
        self.apart[left, right] = not crossed
        return not crossed

    def _last(self, prefix: str, depth: int, tokens: list[str], suffix: str) -> str:
        """Last token of prefix, whose last symbol also has the suffix; tokens: last tokens of the shorter prefixes, tokens[0] = ''."""
        size, known = self.size, self.apart
        long = self.ends.get(prefix[depth - TAIL :] + suffix, ()) if depth >= TAIL else ()
        for n in (*long, *SHORT):
            if n <= depth:
                token = prefix[depth - n :] + suffix
                if size.get(token) == n:
                    if n == depth:
                        return token
                    apart = known.get((tokens[depth - n], token))
                    if apart or apart is None and self._stand_apart(tokens[depth - n], token):
                        return token
        raise ValueError(f"the vocabulary has no token for {prefix!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """ids of distinct words, written in byte letters.

        Sorted words go down the trie depth first: what a word shares with the one before is on the stack, what it shares with
        any earlier one is in the trie, and each prefix beyond gets its state once.
        """
        found: dict[str, list[int]] = {}
        vocab, size, end, last = self.vocab, self.size, self.end, self._last
        before, tokens, path = "", [""], [self.trie]
        for word in sorted(words):
            if self.nodes > NODES:
                self.trie, self.nodes = ["", {}], 0
                before, tokens, path = "", [""], [self.trie]
            body, depth = len(word) - 1, 0
            top = min(len(tokens) - 1, body)
            while depth < top and word[depth] == before[depth]:
                depth += 1
            del tokens[depth + 1 :], path[depth + 1 :]
            node = path[depth]
            while depth < body:
                c = word[depth]
                depth += 1
                below = node[1].get(c)
                if below is None:
                    below = node[1][c] = [last(word[:depth], depth, tokens, ""), {}]
                    self.nodes += 1
                node = below
                path.append(node)
                tokens.append(node[0])
            token = last(word, depth + 1, tokens, end)
            row, at = [vocab[token]], depth + 1 - size[token]
            while at:
                row.append(vocab[tokens[at]])
                at -= size[tokens[at]]
            found[word] = row[::-1]
            before = word
        return found

    def _normal(self, part: str) -> str:
        """NFC, then each character in lower case. str.lower() does the same but for a capital sigma, which has a final form."""
        if part.isascii():
            return part.lower()
        part = unicodedata.normalize("NFC", part)
        return part.lower() if "\u03a3" not in part else "".join(c.lower() for c in part)

    def _chunks(self, text: bytes) -> list[bytes]:
        """Runs without ASCII white space, in normal form unless they hold a <, as special tokens do.

        Normal form is not always a fixed point, so it is taken once: here, or in _split for the others.
        """
        if b"<" not in text:
            return (text.lower() if text.isascii() else self._normal(text.decode()).encode()).split()
        return [c if b"<" in c else c.lower() if c.isascii() else self._normal(c.decode()).encode() for c in text.split()]

    def _letters(self, words: list[str]) -> list[str]:
        return [w if w.isascii() and w.isprintable() else "".join([self.letters[b] for b in w.encode()]) for w in words]

    def _split(self, chunk: bytes) -> list[str | int]:
        """Words in byte letters, and ids of special tokens, of a chunk from _chunks."""
        if chunk.isalpha():
            return [chunk.decode()]
        text = chunk.decode()
        if b"<" not in chunk:
            return self._letters(self.pattern.findall(text))
        out: list[str | int] = []
        at = 0
        stops = list(self.stops.finditer(text)) if self.stops else []
        for start, stop, special in [*((m.start(), m.end(), m.group()) for m in stops), (len(text), len(text), None)]:
            out += self._letters(self.pattern.findall(self._normal(text[at:start])))
            if special is not None:
                out.append(self.special[special])
            at = stop
        return out

    def _learn_words(self, words: Iterable[str]) -> None:
        """Make self.words know these words: (ids as little-endian 32-bit integers, decoding)."""
        known, old = self.words, self.old_words
        if len(known) > WORDS:
            self.old_words = old = known
            self.words = known = {}
        new = []
        for w in words:
            if w not in known:
                if (before := old.get(w)) is None:
                    new.append(w)
                else:
                    known[w] = before
        text_of = self.text_of
        for w, row in self.encode_words(new).items():
            known[w] = (array("I", row).tobytes(), (" ".join([text_of[i] for i in row])).encode())

    def learn(self, chunks: set[bytes]) -> None:
        """Make self.known know these chunks (from _chunks)."""
        if len(self.known) > MEMORY:  # what the texts use again comes back from the older half
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = []
        for c in chunks.difference(known):
            if (before := old.get(c)) is None:
                new.append((c, self._split(c)))
            else:
                known[c] = before
        self._learn_words({w for _, row in new for w in row if type(w) is str})
        words = self.words
        for chunk, row in new:
            if len(row) == 1 and type(row[0]) is str:
                known[chunk] = words[row[0]]
            else:
                parts = [words[w] if type(w) is str else (array("I", [w]).tobytes(), self.text_of[w].encode()) for w in row]
                known[chunk] = b"".join([i for i, _ in parts]), b" ".join([d for _, d in parts])

    def encode_all(self, texts: list[bytes | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text (UTF-8; null: empty): its ids as little-endian 32-bit integers, and their decoding."""
        gc.disable()  # many small objects come, none in cycles
        try:
            rows = [self._chunks(t or b"") for t in texts]
            self.learn(set().union(*rows))
        finally:
            gc.freeze()
            gc.enable()
        known = self.known
        for row in rows:
            ids, decoded = zip(*[known[c] for c in row], strict=True) if row else ((), ())
            yield b"".join(ids), b" ".join(filter(None, decoded))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.text_of[i] for i in ids)


def groups(texts: list[bytes | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts of about so many bytes, one text at least: what is split into words at once."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(batches: Iterable[pa.RecordBatch], path: str, column: int = 1) -> Iterator[tuple[pa.RecordBatch, int, list[tuple[bytes, bytes]]]]:
    """For each group of rows: its batch, its first row there, and (ids, decoding) of each row."""
    claim("bpe", TrieBpe._loaded.clear)
    bpe = TrieBpe.load(path)
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for start, stop in groups(texts):
            yield batch, start, list(bpe.encode_all(texts[start:stop]))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row; a null or blank text has no ids. No special tokens are added.

    Repeated rows are encoded each, a text of any length whole; an empty table gives an empty one; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch, start, rows in encoded(batches, path):
            ids = [memoryview(i).cast("I").tolist() for i, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, F.col(text).cast("string").cast("binary")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encodings: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the tokens' strings with a space between two; null for null ids, '' for none. Rows are decoded each on its own."""
    kind = encodings.schema[key].dataType.simpleString()

    def run(batches):
        bpe = TrieBpe.load(path)
        for batch in batches:
            texts = [None if row is None else bpe.decode(row) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "decoded"])

    return encodings.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded string")


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: key, n_tokens, ids_sha256, decoded_sha256 (lower-case hex); a null text counts as empty. No shuffle.

    Repeated rows and keys each come back; an empty table gives an empty one; a text of any length is encoded whole, so a very
    long one takes the memory of its words once; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch, start, rows in encoded(batches, path):
            columns = [
                batch.column(0).slice(start, len(rows)),
                pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for _, d in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, F.col(text).cast("string").cast("binary")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

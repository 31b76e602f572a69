"""Token counts by a linear longest-match automaton.

Word pieces are taken greedily, the longest piece of the vocabulary first. The
automaton is the trie of the vocabulary; each node has a failure link to the
node that is reached after popping the longest pieces off its string, and the
number of pieces popped. A word is read once, symbol by symbol, and only the
numbers are added up: no piece is built.

The vocabulary is one of bytes with word ends. Every byte must be a piece (else
reading it is an error), and where the greedy cut leaves the bare end of a word,
that end costs no token, so every word has a count. The vocabulary's path is a parameter; the
driver reads it and the automaton is broadcast, whose size is that of the
vocabulary. Words repeat, so counts are kept in a cache of bounded size.

Defined results: a null or empty text has 0 words and 0 tokens; a very long text
is counted whole; a null doc_id stays null, repeated rows give repeated rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

#: Fixed pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = 256
CACHE = 300_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Each piece as symbols: bytes, and END where it closes a word."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"] for x in data["added_tokens"]}
    end, of = data["model"]["end_of_word_suffix"], byte_symbols()
    pieces = []
    for piece in data["model"]["vocab"]:
        if piece not in special:
            close = piece.endswith(end) and piece != end
            pieces.append(tuple(of[c] for c in (piece.removesuffix(end) if close else piece)) + ((END,) if close else ()))
    missing = set(range(256)) - {p[0] for p in pieces if len(p) == 1}
    if missing:
        raise ValueError(f"{path}: {len(missing)} bytes are no pieces, so some words can't be cut")
    return pieces


class Automaton:
    """Trie with failure links and popped-piece counts; node 0 is the root."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.child: dict[int, int] = {}
        pieces = [*pieces, (END,)]
        token, edges = {0: False}, {0: []}
        for piece in pieces:
            node = 0
            for s in piece:
                key = node << 9 | s
                if key not in self.child:
                    new = len(token)
                    self.child[key] = new
                    token[new], edges[new] = False, []
                    edges[node].append((s, new))
                node = self.child[key]
            token[node] = True
        n = len(token)
        #: -1 where a string can't be cut into pieces
        self.fail, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:
            deeper = []
            for u in level:
                for s, v in edges[u]:
                    deeper.append(v)
                    if token[v]:
                        self.fail[v], self.popped[v] = 0, int(u > 0 or s != END)
                        continue
                    count, z = self.popped[u], self.fail[u]
                    while z >= 0 and (z << 9 | s) not in self.child:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z << 9 | s], count
            level = deeper

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word with its end; -1 if it can't be cut."""
        child, fail, popped = self.child, self.fail, self.popped
        node, total = 0, 0
        for s in (*word, END):
            while (node << 9 | s) not in child:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = child[node << 9 | s]
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return total


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = self.automaton.count(word.encode())
        return n


def normal_words(text: str) -> list[str]:
    """The vocabulary's words: NFC, lower case, split by its pattern."""
    return regex.findall(PATTERN, unicodedata.normalize("NFC", text).lower())


def count_pieces(docs: DataFrame, vocabulary: str = "/opt/tokenizers/word_bpe_49k.json") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(shared.value)
        get, find, normal = counts.__getitem__, regex.compile(PATTERN).findall, unicodedata.normalize
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                found = find(normal("NFC", text.as_py() or "").lower())
                words.append(len(found))
                tokens.append(sum(map(get, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")

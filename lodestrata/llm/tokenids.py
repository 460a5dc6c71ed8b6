"""Problem 7: the token ids of every text under a public byte-pair vocabulary.

Method: per-prefix dynamic programming. A text is first divided into the vocabulary's
pre-tokens. For every prefix of a pre-token's bytes there is exactly one token that can
end its encoding; it is found among the vocabulary entries that end at this position
(an Aho-Corasick automaton over the vocabulary yields them, longest first) as the first
one that is compatible with the last token of the prefix before it. Two tokens are
compatible when byte-pair merging of their concatenation gives back just these two.
Following the stored last tokens backwards yields the ids, in time linear in the bytes.

Distinct pre-tokens are encoded once a worker; Spark spreads the texts over the tasks.

Defined results: a null, an empty text -> an empty list; strings that look like special
tokens are ordinary text; ``id_col`` is passed through (null too); rows are never merged,
so repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.arrowtools import int_lists, map_batches

DEFAULT_VOCABULARY = os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"

# Fixed value: the pre-token pattern of this public vocabulary.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixEncoder:
    """Encodes pre-tokens by the unique last token of every prefix."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        # only tokens that merging can produce: single bytes and merge results
        self.tokens = {t: i for t, i in vocab.items() if t in made or (len(t) == 1 and t in alphabet)}
        self.length = {i: len(t) for t, i in self.tokens.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts = {i: (i, i) for t, i in self.tokens.items() if len(t) == 1}
        self.rank = {i: -1 for i in self.parts}
        for r, (a, b) in enumerate(merges):
            left, right, whole = self.tokens[a], self.tokens[b], self.tokens[a + b]
            self.pair[left, right] = r  # rank of the merge
            if whole not in self.rank:
                self.parts[whole] = (left, right)
                self.rank[whole] = r
        self.stand_in = {b: c for c, b in alphabet.items()}
        self.checked: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            a, b = self.parts[i]
            if a == i or self._border_holds(a, b, self.rank[i]):  # tokens that merging never leaves whole can't end a prefix
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()

    def _border_holds(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank below ``limit`` crosses the border between the adjacent tokens a and b.

        Both are taken apart from the latest merge to the earliest. The border is crossed exactly when
        two parts that meet there have a merge that comes before the step which swallowed one of them:
        of equal ranks the leftmost goes first, so it loses to a step on its left and wins over one on its right.
        """
        rank, parts, pair = self.rank, self.parts, self.pair
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = parts[a][1]
            elif rank[b] >= 0:
                limit = rank[b] + 1
                b = parts[b][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether byte-pair merging of the bytes of both tokens gives back just these two."""
        key = (left, right)
        ok = self.checked.get(key)
        if ok is None:
            if len(self.checked) > 1_000_000:
                self.checked.clear()
            ok = self.checked[key] = self._border_holds(left, right, 1 << 60)
        return ok

    def encode_pretoken(self, word: str) -> tuple[int, ...]:
        stand_in, length, compatible = self.stand_in, self.length, self.compatible
        data = "".join([stand_in[b] for b in word.encode("utf-8", "replace")])
        last = [-1] * len(data)  # the unique last token of each prefix
        for end, token in self.automaton.iter(data):  # longest first at each end
            if last[end] < 0:
                start = end - length[token]
                if start < 0 or (last[start] >= 0 and compatible(last[start], token)):
                    last[end] = token
        out = []
        at = len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return tuple(out)


class _Cache(dict):
    def __init__(self, encode, size: int):
        super().__init__()
        self.encode, self.size = encode, size

    def __missing__(self, word):
        if len(self) >= self.size:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


class TextEncoder:
    """Pre-tokenises and encodes; keeps what it has encoded for the life of the worker (bounded)."""

    def __init__(self, path: str, cache_size: int = 400_000):
        import regex

        self.split = regex.compile(PRETOKEN_PATTERN).findall
        self.known = _Cache(PrefixEncoder(path).encode_pretoken, cache_size)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.known.__getitem__, self.split(text)))) if text else 0


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = text_encoder(vocabulary)
        values: list[int] = []
        lengths: list[int] = []
        for text in b.column(1).to_pylist():
            ids = enc.encode(text)
            values += ids
            lengths.append(len(ids))
        return pa.RecordBatch.from_arrays([b.column(0), int_lists(values, lengths)], names=[id_col, "ids"])

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (bigint) of every row."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = text_encoder(vocabulary)
        counts = pa.array([enc.count(t) for t in b.column(len(keep)).to_pylist()], type=pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), counts], names=[*keep, "n_tokens"])

    return map_batches(df.select(*keep, text_col), run, f"{fields}, n_tokens bigint")

"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are laid end to end in one numpy array of symbol
ids. Each round finds the lowest-ranked adjacent pair of every sequence and
merges all its occurrences, in all sequences at once; a sequence without a
mergeable pair leaves the array and its surviving symbols are its tokens.
Merging every occurrence of the lowest rank equals one-at-a-time merging,
because a pair that contains a merged symbol always has a later rank.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import map_chunks

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose counts a worker remembers before it starts afresh.
CACHE_TOKENS = 400_000
_NONE = np.iinfo(np.int32).max
#: log2 of the slots of each of the two hash tables over the merge pairs.
_SLOT_BITS = 20


def _slots(keys: np.ndarray, odd: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int32)


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@dataclass
class ByteBpe:
    """Merge table of a byte-level BPE vocabulary; row = rank of the merge."""

    first: np.ndarray  # symbol id of each byte
    keys: np.ndarray  # left * width + right; a last row that no pair equals
    made: np.ndarray  # symbol made by keys[i]
    width: int
    specials: list[str]  # longest first
    tables: list[tuple[int, np.ndarray]]  # multiplier, row by slot; a pair that finds its slot taken is in the next table

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        vocab, merges = doc["model"]["vocab"], doc["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        width = max(vocab.values()) + 1
        key = np.array([vocab[a] * width + vocab[b] for a, b in pairs] + [-1], dtype=np.int64)
        left, tables, odd = np.arange(len(pairs), dtype=np.int32), [], 0x9E3779B97F4A7C15
        while len(left):
            slot = _slots(key[left], odd)
            table = np.full(1 << _SLOT_BITS, len(pairs), dtype=np.int32)
            table[slot] = left
            tables.append((odd, table))
            left, odd = left[table[slot] != left], (odd * 0xD1342543DE82EF95 + 2) % 2**64 | 1
        return cls(
            first=np.array([vocab[s] for s in byte_symbols()], dtype=np.int64),
            keys=key,
            made=np.array([vocab[a + b] for a, b in pairs], dtype=np.int64),
            width=width,
            specials=sorted((t["content"] for t in doc.get("added_tokens", [])), key=len, reverse=True),
            tables=tables,
        )

    def rank(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it never merges."""
        out = np.full(len(key), _NONE, dtype=np.int32)
        for i, (odd, table) in enumerate(self.tables):
            if i:
                at = np.flatnonzero(out == _NONE)
                row = table[_slots(key[at], odd)]
                good = self.keys[row] == key[at]
                out[at[good]] = row[good]
            else:
                row = table[_slots(key, odd)]
                np.copyto(out, row, where=self.keys[row] == key)
        return out

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (all non-empty)."""
        raw = [p.encode("utf-8") for p in pretokens]
        seq = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        sym = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        out = np.zeros(len(raw), dtype=np.int64)
        while len(sym):
            apart = seq[1:] != seq[:-1]
            rank = np.append(self.rank(sym[:-1] * self.width + sym[1:]), np.int32(_NONE))
            rank[:-1][apart] = _NONE
            starts = np.flatnonzero(np.append(True, apart))
            lengths = np.diff(np.append(starts, len(seq)))
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            out[seq[starts[done]]] = lengths[done]
            hit = np.flatnonzero((rank == np.repeat(low, lengths)) & (rank < _NONE))
            # of overlapping occurrences (a a a) the first, third ... merge
            run = np.append(True, hit[1:] != hit[:-1] + 1) if len(hit) else np.zeros(0, bool)
            begin = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))] if len(hit) else hit
            hit = hit[(hit - begin) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.repeat(~done, lengths)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


class TokenCounter:
    """Counts tokens of texts, remembering the counts of pre-tokens it has met."""

    def __init__(self, bpe: ByteBpe):
        import regex

        self.bpe, self.cache = bpe, {}
        self.pieces = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in bpe.specials)).split if bpe.specials else None

    def __call__(self, texts: list[str]) -> list[int]:
        found, extra = [], []
        for t in texts:
            special = 0
            if self.cut and any(s in t for s in self.bpe.specials):
                parts = self.cut(t)
                special, toks = len(parts) - 1, [x for p in parts for x in self.pieces(p)]
            else:
                toks = self.pieces(t)
            found.append(toks)
            extra.append(special)
        new = set().union(*found) if found else set()
        if len(self.cache) + len(new) > CACHE_TOKENS:
            self.cache = {}
        new = list(new.difference(self.cache))
        if new:
            self.cache.update(zip(new, self.bpe.counts(new).tolist(), strict=True))
        of = self.cache.__getitem__
        return [sum(map(of, toks)) + n for toks, n in zip(found, extra, strict=True)]


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids, repeated rows and
    repeated ids are kept as they come; an empty table gives no rows; other
    columns are ignored. Special strings inside a text count one token each.
    """
    bpe = ByteBpe.load(tokenizer_path)
    made: list[TokenCounter] = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(TokenCounter(bpe))
        n = made[0](part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = map_chunks(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's count is its number of initial byte symbols minus the merges that the ranks allow;
no identifier is emitted. Each distinct pre-token is merged once per worker and kept in a bounded cache.

Defined cases: null text counts as empty (0 bytes, 0 tokens, not over the limit); repeated rows, null
ids and tied rows each give their own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, tidy

#: Fixed value: the pre-token pattern of byte-level BPE. White space is spelled as the Unicode property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Pre-tokens whose counts a worker keeps; longer ones than KEPT_CHARS are merged anew each time.
CACHE_WORDS, KEPT_CHARS = 400_000, 48


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, as its published rule builds it."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCounter(dict):
    """word -> number of tokens, filled on demand."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        alphabet = _byte_alphabet()
        ids = model["vocab"]
        self.start = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PRETOKEN)

    def merged(self, word: str) -> int:
        symbols = [self.start[b] for b in word.encode("utf-8", "replace")]
        n = len(symbols)
        if n < 2:
            return n
        merges, left, right = self.merges, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*m, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j], count = new, -1, count - 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(heap, (*m, i, new, symbols[k]))
            if (h := left[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(heap, (*m, h, symbols[h], new))
        return count

    def __missing__(self, word: str) -> int:
        count = self.merged(word)
        if len(word) <= KEPT_CHARS and len(self) < CACHE_WORDS:
            self[word] = count
        return count

    def count(self, text: str) -> int:
        if self.special and (found := self.special.findall(text)):
            return len(found) + sum(self.count_plain(part) for part in self.special.split(text))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pattern.findall(text)))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row. `vocabulary`: path of a byte-level BPE .json; its
    content, of fixed size, is broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    spec = {"model": {k: spec["model"][k] for k in ("vocab", "merges")}, "added_tokens": spec.get("added_tokens", [])}
    shared = docs.sparkSession.sparkContext.broadcast(json.dumps(spec))

    def run(batches):
        counter = BytePairCounter(json.loads(shared.value))
        for batch in slices(batches):
            if len(counter) >= CACHE_WORDS:
                counter.clear()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

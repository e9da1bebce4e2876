"""Token counts by the whole-token shortcut.

Offline, on the driver, once per vocabulary file: every vocabulary string that is a
single pre-token is encoded by the library, and those that come back as that one
token are proven whole. They travel to the workers with the merge ranks in one broadcast, whose size
the vocabulary bounds; executors need neither the file nor the library. Online, texts are cut
into pre-tokens by the tokenizer's own pattern; a pre-token in the proven set counts one, and only
the rest is merged, each distinct string once for as long as a worker's bounded memory holds it.

Merging adjacent symbols by rank is done here; the tests hold the counts
against the library on whole texts.

Edge cases: null and empty texts have 0 tokens; special strings inside texts
count as one token each, the library's default; a vocabulary whose special strings take white space or
word ends with them, that normalises texts, cuts them by another pre-tokenizer or merges by other rules, is refused; repeated rows are counted
alike; null doc_ids are kept; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Distinct merged strings that a worker remembers before it starts afresh.
REMEMBERED = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: The byte-level pre-token pattern, as public byte-level BPE tokenizers fix it.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cutter():
    import regex

    return regex.compile(PRE_TOKENS)


def unlike(spec: dict) -> list[str]:
    """How a tokenizer's file differs from what is built here: byte-level pre-tokens by PRE_TOKENS, merged by rank and nothing else."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    faults = [f"pre_tokenizer.{k} is {cut.get(k)!r}" for k, v in {"type": "ByteLevel", "add_prefix_space": False}.items() if cut.get(k) != v]
    faults += ["pre_tokenizer.use_regex is off"] if not cut.get("use_regex", True) else []
    faults += [f"model.type is {model.get('type')!r}"] if model.get("type", "BPE") != "BPE" else []
    return faults + [f"model.{k} is set" for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]


class Vocabulary:
    """Merge ranks, special strings and the proven whole tokens of one byte-level BPE file; picklable."""

    def __init__(self, path: str):
        if not path.endswith(".json"):
            raise ValueError(f"{path} is no byte-level BPE file in JSON; sentence-piece models are not read")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        faults = unlike(spec)
        if faults:
            raise ValueError(f"{path} is cut or merged in a way that is not built here: {', '.join(faults)}")
        if spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} normalises texts or has special strings that take more than themselves")
        self.byte = {c: bytes([b]) for b, c in byte_alphabet().items()}
        raw = lambda s: b"".join(self.byte[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        # the longest of the special strings that begin at a place is the one found there
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.whole = self._proven(path, spec["model"]["vocab"])

    def _proven(self, path: str, vocab: dict[str, int]) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and that the library encodes as the one token they name."""
        import tokenizers

        cut = cutter()
        known = [(t, k) for s, k in vocab.items() if (t := self.text(s)) is not None and cut.fullmatch(t)]
        encoded = tokenizers.Tokenizer.from_file(path).encode_batch([t for t, _ in known], add_special_tokens=False)
        return frozenset(t for (t, k), e in zip(known, encoded, strict=True) if e.ids == [k])

    def text(self, s: str) -> str | None:
        try:
            return b"".join(self.byte[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            return None

    def merged(self, text: str) -> int:
        """Symbols left after merging the lowest-ranked adjacent pair, leftmost first, until none is ranked."""
        data = text.encode()
        n = len(data)
        if n < 2:
            return n
        if n > 256:
            return self._merged_long(data)
        parts, rank = [data[k : k + 1] for k in range(n)], self.rank
        ranks = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == 1 << 30:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank.get((parts[k], parts[k + 1]), 1 << 30)
            if k:
                ranks[k - 1] = rank.get((parts[k - 1], parts[k]), 1 << 30)
        return len(parts)

    def _merged_long(self, data: bytes) -> int:
        """The same with a heap and linked places: n log n for very long pre-tokens."""
        import heapq

        n, rank = len(data), self.rank
        part: list[bytes | None] = [data[k : k + 1] for k in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := rank.get((part[k], part[k + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if part[k] is not None else -1
            if j < 0 or part[k] is not a or part[j] is not b:
                continue
            part[k], part[j] = a + b, None
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            left -= 1
            for x in (before[k], k):
                if x >= 0 and (y := after[x]) >= 0 and (r := rank.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return left


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Counter:
    """Counts of whole texts; remembers a bounded number of merged pre-tokens."""

    def __init__(self, vocab: Vocabulary):
        import regex

        self.vocab, self.known, self.find = vocab, {}, cutter().findall
        self.split = regex.compile("|".join(map(regex.escape, vocab.special))).split if vocab.special else None

    def count(self, text: str) -> int:
        pieces = self.split(text) if any(s in text for s in self.vocab.special) else [text]
        total, whole, known = len(pieces) - 1, self.vocab.whole, self.known
        for piece in pieces:
            tokens = self.find(piece)
            rest = [t for t in tokens if t not in whole]
            total += len(tokens) - len(rest)
            for t in rest:
                n = known.get(t)
                if n is None:
                    n = self.vocab.merged(t)
                    if len(t) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[t] = n
                total += n
        return total


_counters: dict[str, Counter] = {}


def counter(path: str, shipped=None) -> Counter:
    """One per worker process and file, kept between batches and tasks; `shipped` is the broadcast vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(shipped.value if shipped else vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document. A scan and one Python pass over Arrow batches: no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, shipped)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(own.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

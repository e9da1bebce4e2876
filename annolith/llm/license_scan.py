"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of the text, or a run of words across line ends, blank lines
included, that is 1 / CONTAINMENT times as long as the template: a notice wrapped
over lines, or a paragraph or several of a license's body. A template is a notice or a paragraph of a body; both are sets of words. A block meets
a template if it holds CONTAINMENT of the template's words; n_blocks_met counts the lines.
All words of the templates are ordered by the number of blocks in the whole
corpus that hold them, rarest first. By the prefix filter, a template of n
words of which m are needed must have one of its n - m + 1 first words in the
block; the length filter asks for m distinct words in the block, and the positional
filter stops as soon as the words left cannot reach m. What passes is counted
exactly, so every block at or above the threshold is found and no other. Runs are
looked at only where the whole text passes the same filters as one block.

Where the words of one license hold those of another, as the Affero or Lesser General Public License does those of the
General one, containment alone names both. Such labels have telling words: a block must hold all of them that the template has,
and none of their siblings' own.

Edge cases: null and empty texts have no words, no labels and score 0; blocks
without words meet nothing; of equal scores nothing is chosen, all labels are
returned; repeated rows are judged alike; null doc_ids are kept; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import LICENSE_TEXTS, TELLING

#: Phrases whose plain presence labels a document.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Share of a template's words that a block must hold.
CONTAINMENT = 0.9

#: A label for each license, and the notices and paragraphs that show it.
TEMPLATES = LICENSE_TEXTS

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks_met long"

#: Lower-cases A-Z, keeps digits, a-z and every byte of a non-ASCII character, turns all else into a space; line ends stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x0A if b == 0x0A else 0x20 for b in range(256))


def run_lengths(templates: dict[str, list[str]], containment: float = CONTAINMENT) -> list[int]:
    """Words of the runs that are met with each template, in the order of template_words(): its own, repeats included, over the containment."""
    return [int(len(t.encode().translate(_FOLD).split()) / containment + 1e-9) for notices in templates.values() for t in notices]


def template_words(templates: dict[str, list[str]]) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(t.encode().translate(_FOLD).split())) for label, notices in templates.items() for t in notices]


def telling_words(templates: dict[str, list[str]]) -> list[tuple[frozenset[bytes], frozenset[bytes]]]:
    """The words that must be met and those that must not, in the order of template_words()."""
    coded = lambda words: frozenset(w.encode() for w in words)
    return [(words & coded(TELLING.get(label, ((), ()))[0]), coded(TELLING.get(label, ((), ()))[1])) for label, words in template_words(templates)]


class Index:
    """Templates under the prefix filter: word -> (template, place of the word in the template's order)."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], frequency: dict[bytes, int], containment: float, telling: list[tuple[frozenset[bytes], frozenset[bytes]]] | None = None):
        self.telling = telling or [(frozenset(), frozenset())] * len(templates)
        self.templates, self.needed, self.ordered, self.prefix = templates, [], [], {}
        for k, (_, words) in enumerate(templates):
            ordered = sorted(words, key=lambda w: (frequency.get(w, 0), w))
            needed = max(1, -int(-(len(ordered) * containment - 1e-9) // 1))
            self.ordered.append(ordered)
            self.needed.append(needed)
            for i, w in enumerate(ordered[: len(ordered) - needed + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.keys = frozenset(self.prefix)

    def meet_runs(self, words: list[bytes], longest_runs: list[int]) -> list[tuple[int, float]]:
        """(template, highest containment in a run of words) of all templates that a run meets."""
        found = []
        for k, _ in self._similar(words):
            holds, longest, (asked, barred) = frozenset(self.ordered[k]), longest_runs[k], self.telling[k]
            inside: Counter[bytes] = Counter()
            best = 0
            for i, w in enumerate(words):
                if w in holds or w in barred:
                    inside[w] += 1
                if i >= longest and (gone := words[i - longest]) in inside:
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                if len(inside) > best and barred.isdisjoint(inside) and all(a in inside for a in asked):
                    best = len(inside)
            if best >= self.needed[k]:
                found.append((k, best / len(holds)))
        return found

    def meet(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all that the block meets and tells from its siblings."""
        words = frozenset(block)
        return [(k, c) for k, c in self._similar(block) if self.telling[k][0] <= words and words.isdisjoint(self.telling[k][1])]

    def _similar(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all that the block holds enough of."""
        if self.keys.isdisjoint(block):
            return []
        words = frozenset(block)
        best: dict[int, int] = {}
        for w in self.keys & words:
            for k, i in self.prefix[w]:
                best[k] = min(i, best.get(k, i))
        found = []
        for k, i in best.items():
            ordered, needed = self.ordered[k], self.needed[k]
            if len(words) < needed or len(ordered) - i < needed:  # length, position
                continue
            got, left = 0, len(ordered) - i
            for w in ordered[i:]:
                got += w in words
                left -= 1
                if got + left < needed:
                    break
            if got >= needed:
                found.append((k, got / len(ordered)))
        return found


def _block_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Blocks of the whole corpus that hold each template word; as many rows as the templates have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for line in (text.as_py() or b"").translate(_FOLD).split(b"\n"):
                    counts.update(vocabulary.intersection(line.split()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    summed = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in summed.collect()}


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: places of the base phrases, labels of phrases and of templates met, and the highest containment."""
    listed, longest_runs = template_words(templates or TEMPLATES), run_lengths(templates or TEMPLATES, containment)
    frequency = _block_frequencies(docs, frozenset().union(*(w for _, w in listed)))
    index = Index(listed, frequency, containment, telling_words(templates or TEMPLATES))
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
    last_words = frozenset(p[-1] for p, _ in phrases)

    def base(words: list[bytes]) -> tuple[list[int], set[str]]:
        places, labels = [], set()
        if last_words.isdisjoint(words):
            return places, labels
        for k, w in enumerate(words):
            if w in last_words:
                for p, label in phrases:
                    if w == p[-1] and k + 1 >= len(p) and words[k + 1 - len(p) : k + 1] == p:
                        places.append(k + 1 - len(p))
                        labels.add(label)
        return places, labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                folded = (text.as_py() or b"").translate(_FOLD)
                blocks = [b.split() for b in folded.split(b"\n")]
                words = [w for b in blocks for w in b]
                places, labels = base(words)
                met = [hit for b in blocks for hit in index.meet(b)]
                wrapped = index.meet_runs(words, longest_runs) if len(blocks) > 1 else []
                every = labels | {index.templates[k][0] for k, _ in met + wrapped}
                rows.append((
                    len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(labels)), ",".join(sorted(every)), max((s for _, s in met + wrapped), default=0.0), len(met),
                ))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks_met"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)

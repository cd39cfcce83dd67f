"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items are put into one automaton. Every document streams
its words through it; the automaton keeps the longest suffix read so far that is
a substring of an item. Where that length reaches the window (13 words), the
last 13 words are a window of every item that holds them. A shorter item is one
window as a whole and is noted at the state that its words lead to.

The test items are gathered in groups of at most ``GROUP_WORDS`` words; each
group has its own automaton and its own pass over the texts. The automaton of a
group is built when its pass begins, and the pass is written before the next one,
so one automaton at a time is built, broadcast and held by a worker, whatever the
size of the benchmark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialise, parts, release

WINDOW = 13
#: Share of a document's words that makes it contaminated: 1 in so many.
COVERAGE = 20
GROUP_WORDS = 200_000

#: Signs that end a word: ASCII other than digits and letters.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

MATCH_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<int>"


def words(text: str | None) -> list[bytes]:
    """Words in order, A-Z lower-cased, as UTF-8 bytes."""
    return text.encode().translate(_TO_SPACE).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the windows of each item."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(item, [self.number.setdefault(w, len(self.number)) for w in own]) for item, own in items if own]
        for _, own in texts:
            last = 0
            for c in own:
                last = self._extend(last, c)
        self._note(texts)

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _extend(self, last: int, c: int) -> int:
        """The state of ``last``'s string followed by ``c``, added where it lacks."""
        if c in self.step[last]:
            return self._exact(last, c)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._exact(p, c)
        return state

    def _exact(self, p: int, c: int) -> int:
        """The state whose longest string is p's longest one and ``c``; splits one off if need be."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        split = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = split
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = split
            p = self.link[p]
        return split

    def _note(self, texts: list[tuple[str, list[int]]]) -> None:
        """Items by window state; short items by the state of their whole text."""
        n, w = len(self.step), self.window
        self.window_state = [0] * n  # the suffix of w words of a state's strings
        self.shorter = [0] * n  # nearest state at or above that ends short items
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= w:
                up = self.link[s]
                self.window_state[s] = s if self.length[up] < w else self.window_state[up]
        for item, own in texts:
            s = length = 0
            for c in own:
                s, length = self.step[s][c], length + 1
                # The walk follows one item, so the whole prefix always matches.
                if length >= w:
                    self.items.setdefault(self.window_state[s], set()).add(item)
            if length < w:
                self.short.setdefault(s, []).append((length, item))
        for s in order:
            self.shorter[s] = s if s in self.short else self.shorter[self.link[s]]

    def match(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges (end exclusive) inside windows, and the items that own them."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        step, link, length_of, w = self.step, self.link, self.length, self.window
        window_state, shorter = self.window_state, self.shorter
        state = length = 0
        for i, c in enumerate(map(self.number.get, text_words)):
            if c is None:
                state = length = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                length = length_of[state]
            if c not in step[state]:
                continue
            state = step[state][c]
            length += 1
            hit = 0
            if length >= w:
                hit = w
                found |= self.items[window_state[state]]
            s = shorter[state]
            while s:
                for n, item in self.short[s]:
                    if n <= length:
                        hit = max(hit, n)
                        found.add(item)
                s = shorter[link[s]]
            if hit:
                a = i + 1 - hit
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found


def automata(benchmark: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS) -> Iterator[tuple[SuffixAutomaton, bool]]:
    """Automata of the items, grouped by size, and whether each is the last; items come to the driver one by one.

    A null item_id is kept as an empty string; items without words are left out.
    """
    own, size = [], 0
    for r in benchmark.selectExpr("coalesce(cast(item_id as string), '') item_id", "cast(text as string) text").toLocalIterator():
        item = words(r.text)
        if own and item and size + len(item) > group_words:
            yield SuffixAutomaton(own, window), False
            own, size = [], 0
        if item:
            own.append((r.item_id, item))
            size += len(item)
    yield SuffixAutomaton(own, window), True


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """Contamination of every document by the benchmark's windows.

    Null or wordless texts have no words and no hits. Rows are judged alone, those
    with null or repeated ids too. Repeated items count once (by id). ``spans``
    lists word ranges from, to, from, to, ...
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(array() as array<string>) items", "cast(array() as array<int>) spans")

    def passes(group, last: bool):
        def run(batches):
            release()
            automaton = group.value
            for batch in parts(batches):
                texts = batch.column("text").to_pylist()
                items, spans, sums = [], [], []
                for text, before, flat in zip(texts, batch.column("items").to_pylist(), batch.column("spans").to_pylist()):
                    own = words(text)
                    found, of = automaton.match(own)
                    names = sorted({*before, *of})
                    ranges = merged([*zip(flat[::2], flat[1::2]), *found])
                    items.append(names)
                    spans.append([x for r in ranges for x in r])
                    if last:
                        n_hit = sum(b - a for a, b in ranges)
                        sums.append((len(own), n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), contaminated(n_hit, len(own), coverage)))
                tail = [pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *tail], ["doc_id", "text", "items", "spans"])
                    continue
                types = (pa.int64(),) * 3 + (pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array([s[i] for s in sums], t) for i, t in enumerate(types)), *tail],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
                )

        return run

    return _each(spark, rows, automata(benchmark, window), passes, lambda last: MATCH_SCHEMA if last else rows.schema)


def _each(spark, rows: DataFrame, groups, passes, schema) -> DataFrame:
    """One pass over the rows for each automaton; all passes but the last are written."""
    path = None
    for automaton, last in groups:
        sent = spark.sparkContext.broadcast(automaton)  # bounded by the words of a group
        rows = rows.mapInArrow(passes(sent, last), schema(last))
        if last:
            return rows
        rows, new_path = materialise(rows, "matched")
        sent.unpersist()
        discard(spark, *([path] if path else []))
        path = new_path


def contaminated(n_hit: int, n_words: int, coverage: int = COVERAGE) -> bool:
    return n_hit > 0 and coverage * n_hit >= n_words


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the characters from the first to the last word of each range."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data.lower())]
    out, end = [], 0
    for a, b in spans:
        out.append(data[end : at[a][0]])
        end = at[b - 1][1]
    return (b"".join(out) + data[end:]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, text: str = "text", length: str = "n_chars", group_words: int = GROUP_WORDS) -> DataFrame:
    """All columns of ``docs``, without contaminated documents and without windows.

    A document whose words hit by windows of any item reach the coverage limit goes.
    From any other one every span of at least one window is cut out, again until
    none is left, and ``length`` is set to the new number of characters. Other rows,
    those with null or wordless texts too, stay as they are. Each row is judged
    alone, whatever its id; the result doesn't depend on how items are grouped.
    """
    spark, columns = docs.sparkSession, docs.columns
    has_length = length in columns
    ranges, state = free_name("spans", columns), free_name("state", columns)

    def passes(first: bool, alone: bool):
        def of_group(group, last: bool):
            def run(batches):
                release()
                automaton = group.value
                for batch in parts(batches):
                    names = batch.schema.names
                    texts, flats, states = batch.column(text).to_pylist(), batch.column(ranges).to_pylist(), batch.column(state).to_pylist()
                    lengths = batch.column(length).to_pylist() if has_length else None
                    keep = [True] * len(texts)
                    for i, (t, flat) in enumerate(zip(texts, flats)):
                        if not states[i]:
                            continue
                        own = words(t)
                        spans = merged([*zip(flat[::2], flat[1::2]), *automaton.match(own)[0]])
                        if not last:
                            flats[i] = [x for r in spans for x in r]
                            continue
                        flats[i], states[i] = [], bool(spans)
                        if not spans:
                            continue
                        keep[i] = not (first and contaminated(sum(b - a for a, b in spans), len(own), coverage))
                        while keep[i] and spans:
                            t = without_spans(t, spans)
                            spans = automaton.match(words(t))[0] if alone else []
                        texts[i] = t
                        if has_length:
                            lengths[i] = len(t)
                    new = {text: pa.array(texts, pa.string()), ranges: pa.array(flats, pa.list_(pa.int32())), state: pa.array(states, pa.bool_())}
                    if has_length:
                        new[length] = pa.array(lengths, batch.column(length).type)
                    yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names).filter(pa.array(keep, pa.bool_()))

            return run

        return of_group

    # A row's state tells whether it is still to be matched: at first all are, later those just cut.
    rows = docs.withColumns({ranges: F.array().cast("array<int>"), state: F.lit(True)})
    first, path = True, None
    while True:
        groups = automata(benchmark, window, group_words)
        one = next(groups)
        alone = one[1]
        rows = _each(spark, rows, chain([one], groups), passes(first, alone), lambda last: rows.schema)
        if alone:
            return rows.select(columns)
        rows, new_path = materialise(rows, "cut")
        discard(spark, *([path] if path else []))
        path, first = new_path, False
        if rows.where(state).isEmpty():
            return rows.select(columns)

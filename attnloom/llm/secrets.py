"""Secret scan: base patterns, and formats learned from labelled credentials by grammar inference.

Credentials that the base patterns find are the labelled examples. Per kind, a
bounded sample of their values builds a prefix tree over character classes;
states whose futures do not differ significantly (Hoeffding test) are merged in
red-blue order into a probabilistic automaton. Every other candidate of the
texts is then scored by its likelihood: it is reported when its mean log
likelihood is no lower than that of nearly all examples set aside, and higher
than under a model of ordinary candidates. Spans of base patterns always stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import read_table, slices, sparing, stored

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "format")
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())]))

LEAST_CANDIDATE = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_CANDIDATE},}}")
#: Every so many values of a kind are set aside for its limit; with fewer in all, the limit comes from all of them.
ASIDE = 5
#: Labelled values per kind that an automaton is built from, chosen by hash.
MOST_VALUES = 1500
ALPHA = 0.05
REST = 1e-3
QUANTILE = 0.05
MARGIN = 0.5
_CLASS = {c: "0" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "g" for c in "ghijklmnopqrstuvwxyz"}
_CLASS |= {c: "F" for c in "ABCDEF"} | {c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}
_SHAPE = str.maketrans(_CLASS)
SYMBOLS = len(set(_CLASS.values())) + len("+/_.=-") + 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of the base patterns, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found.append((m.start(), m.end(), 0, m[2]))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    for run in CANDIDATE.finditer(text):  # a hexadecimal run of 16 or more lies inside one candidate
        for m in HEX.finditer(run[0]):
            if m.end() - m.start() >= LEAST_HEX:
                found.append((run.start() + m.start(), run.start() + m.end(), 2, m[0]))
    return sorted(found)


class Automaton:
    """A probabilistic automaton: per state the counts of symbols, ends and targets."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        for word in words:
            state = 0
            for symbol in word:
                self.count[state][symbol] += 1
                target = self.next[state].get(symbol)
                if target is None:
                    target = self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.ends.append(0)
                state = target
            self.ends[state] += 1

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.count[state].values())

    def alike(self, a: int, b: int) -> bool:
        """No end or symbol frequency differs significantly in the states or, below a common symbol, in their targets."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for symbol in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a][symbol] / n - self.count[b][symbol] / m) > bound:
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the prefix tree under `tree` to the automaton at `into`."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.count[a].update(self.count[b])
            for symbol, target in self.next[b].items():
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], target))
                else:
                    self.next[a][symbol] = target

    def merge(self) -> Automaton:
        red = [0]
        blue = deque((0, s) for s in sorted(self.next[0]))
        while blue:
            parent, symbol = blue.popleft()
            state = self.next[parent][symbol]
            if state in red:
                continue
            match = next((r for r in red if self.alike(r, state)), None)
            if match is None:
                red.append(state)
                blue.extend((state, s) for s in sorted(self.next[state]))
            else:
                self.next[parent][symbol] = match
                self.fold(match, state)
                # folding may have given red states targets that are not red yet
                blue.extend((r, s) for r in red for s in sorted(self.next[r]) if self.next[r][s] not in red and (r, s) not in blue)
        return self

    def score(self, word: str) -> float:
        """Mean log likelihood of a symbol, the end included; what was never seen gets a small rest."""
        state, total = 0, 0.0
        for symbol in word:
            if state < 0:
                total += math.log(REST)
                continue
            n = self.total(state)
            seen = self.count[state].get(symbol, 0)
            total += math.log((seen + REST) / (n + REST * SYMBOLS)) if n else math.log(REST)
            state = self.next[state].get(symbol, -1)
        n = self.total(state) if state >= 0 else 0
        return (total + math.log((self.ends[state] + REST) / (n + REST * SYMBOLS) if n else REST)) / (len(word) + 1)


class Formats:
    """Automata with their limits, and the model of ordinary candidates: symbol pairs."""

    def __init__(self, automata: list[tuple[Automaton, float]], pairs: Counter, firsts: Counter) -> None:
        self.automata, self.pairs, self.firsts = automata, pairs, firsts

    def ordinary(self, word: str) -> float:
        total = 0.0
        for a, b in zip("^" + word, word + "$", strict=True):
            total += math.log((self.pairs[a + b] + 1) / (self.firsts[a] + SYMBOLS))
        return total / (len(word) + 1)

    def matches(self, value: str) -> bool:
        word = value.translate(_SHAPE)
        best = [s for automaton, limit in self.automata if (s := automaton.score(word)) >= limit]
        return bool(best) and max(best) >= self.ordinary(word) + MARGIN


_COLUMNS = ["kind", "state", "symbol", "target", "seen", "ends", "score_limit"]


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    """One kind's automaton as rows; every ASIDE-th example is set aside for the limit."""
    words = [v.translate(_SHAPE) for v in sorted(rows["value"])]
    few = len(words) < ASIDE
    automaton = Automaton([w for i, w in enumerate(words) if few or i % ASIDE]).merge()
    scores = sorted(automaton.score(w) for i, w in enumerate(words) if few or i % ASIDE == 0)
    limit = scores[int(QUANTILE * len(scores))]
    out, todo, reached = [], [0], {0}
    while todo:
        state = todo.pop()
        steps = sorted(automaton.next[state].items())
        for symbol, target in steps or [("", -1)]:
            out.append((int(rows["kind"].iloc[0]), state, symbol, target, int(automaton.count[state].get(symbol, 0)), automaton.ends[state], limit))
            if target >= 0 and target not in reached:
                reached.add(target)
                todo.append(target)
    return pd.DataFrame(out, columns=_COLUMNS, dtype=object)


@sparing
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled values (kind, value, pairs null) and, per batch, pair counts of ordinary candidates (value, pairs)."""
    for batch in batches:
        kinds, values, counts = [], [], []
        pairs: Counter = Counter()
        for text in chain.from_iterable(part.column("text").to_pylist() for part in slices(batch, "text")):
            text = text or ""
            spans = base_spans(text)
            for _, _, kind, value in spans:
                kinds.append(kind)
                values.append(value)
                counts.append(None)
            for m in CANDIDATE.finditer(text):
                if not any(s < m.end() and m.start() < e for s, e, _, _ in spans):
                    word = m[0].translate(_SHAPE)
                    pairs.update(a + b for a, b in zip("^" + word, word + "$", strict=True))
        for pair, n in pairs.items():
            kinds.append(-1)
            values.append(pair)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], ["kind", "value", "pairs"])


def learn_formats(docs: DataFrame) -> Formats:
    """Automata from labelled credentials of `docs`, one for each kind that has any."""
    found = stored(docs.select("text").mapInArrow(_examples, "kind int, value string, pairs long").groupBy("kind", "value").agg(F.sum("pairs").alias("pairs")), "credentials")
    sizes = {r[0]: r[1] for r in found.filter("kind >= 0").groupBy("kind").count().collect()}
    share = F.lit(0.0)
    for kind, n in sizes.items():
        share = F.when(F.col("kind") == kind, min(1.0, MOST_VALUES / n)).otherwise(share)
    sample = found.filter("kind >= 0").filter(F.pmod(F.xxhash64("value"), F.lit(1 << 20)) / (1 << 20) < share).select("kind", "value")
    learned = sample.groupBy("kind").applyInPandas(_learn, "kind int, state int, symbol string, target int, seen long, ends long, score_limit double")
    automata = []
    for _, rows in sorted(stored(learned, "automata").toPandas().groupby("kind")):
        automaton = Automaton([])
        names = {s: i for i, s in enumerate(sorted(set(rows["state"])))}
        automaton.next, automaton.count, automaton.ends = [{} for _ in names], [Counter() for _ in names], [0] * len(names)
        for r in rows.itertuples():
            automaton.ends[names[r.state]] = int(r.ends)
            if r.target >= 0:
                automaton.next[names[r.state]][r.symbol] = names[r.target]
                automaton.count[names[r.state]][r.symbol] = int(r.seen)
        automata.append((automaton, float(rows["score_limit"].iloc[0])))
    pairs, firsts = Counter(), Counter()
    for r in found.filter("kind = -1").select("value", "pairs").collect():  # at most SYMBOLS squared rows
        pairs[r[0]] = r[1]
        firsts[r[0][0]] += r[1]
    return Formats(automata, pairs, firsts)


def _rests(start: int, end: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no base span covers; `found` is sorted."""
    out = []
    for s, e, _ in found:
        if s < end and start < e:
            if start < s:
                out.append((start, s))
            start = max(start, e)
    return [*out, (start, end)] if start < end else out


def spans_of(text: str, formats: Formats) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind number) by start, then kind; learned ones never overlap base ones.

    Where base spans cover a run in part, its rests are reported if the whole run
    matches a format, and otherwise each rest that is long enough is scored.
    """
    found = [(s, e, k) for s, e, k, _ in base_spans(text)]
    learned = []
    if formats.automata:
        for m in CANDIDATE.finditer(text):
            rests = _rests(m.start(), m.end(), found)
            if rests and formats.matches(m[0]):
                learned += [(s, e, 3) for s, e in rests]
            elif rests != [m.span()]:
                learned += [(s, e, 3) for s, e in rests if e - s >= LEAST_CANDIDATE and formats.matches(text[s:e])]
    return sorted(found + learned, key=lambda x: (x[0], x[2]))


def with_spans(docs: DataFrame, formats: Formats, column: str) -> DataFrame:
    """`docs` with an array of (start, end, kind) of each whole text; null texts count as empty."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                spans = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans_of(t or "", formats)] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], [*part.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, SPANS)]))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (array of start, end, kind) per row of `docs`, repeated rows included.

    Positions are code points, end exclusive. Null and empty texts have no
    spans; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    return with_spans(docs, learn_formats(docs), "spans")


def without_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with every span of a secret replaced by `[secret]`; all rows and columns stay, n_chars follows the text.

    Null and empty texts, and an empty table, stay as they are; repeated rows are each masked.
    """
    formats = learn_formats(docs)

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, size = (part.schema.get_field_index(c) for c in ("text", "n_chars"))
                texts = part.column(at).to_pylist()
                masked = [t and _masked(t, spans_of(t, formats)) for t in texts]
                columns = list(part.columns)
                columns[at] = pa.array(masked, part.schema.field(at).type)
                if size >= 0:
                    counts = [n if m is t else len(m) for t, m, n in zip(texts, masked, columns[size].to_pylist(), strict=True)]
                    columns[size] = pa.array(counts, part.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read_table(spark, sf_dir, "documents"))
    joined = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("spans", lambda s: s["kind"] != "format"))
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Secrets by grammar inference: automata of credential formats, merged from prefix trees."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable, text_of
from tessella.llm.spans import quoted, spans

KINDS = ["assign", "access", "hex", "format"]  # format: added by the automata

_VALUE = "[A-Za-z0-9+/_.=-]"
PATTERNS = [
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
    "AKIA[A-Z0-9]+",
    "(?<![0-9a-f])[0-9a-f]++",
]
_HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"  # shorter matches fail anyhow, and nothing follows a match within its run
#: Candidates for the automata: runs of token characters with a digit, from 12 characters.
CANDIDATE = f"(?<!{_VALUE})(?=[A-Za-z+/_.=-]*+[0-9]){_VALUE}{{12,}}+"
WORD = "(?<![^ ])[A-Za-z]{5,24}(?![^ ])"
_SECOND = "regexp_extract({}, " + quoted("^" + PATTERNS[0].replace(_VALUE + "+", f"({_VALUE}+)")) + ", 1)"

#: Credentials of a kind at most that automata are inferred from; the least by hash.
SAMPLE = 400
#: Characters of such a credential at most; longer ones are found, but not learnt from.
LONGEST = 256
#: Confidence of the tests for merging (smaller merges more), and bits a character by which a format must beat
#: ordinary tokens.
ALPHA, MARGIN = 0.01, 0.5


def symbol(c: str) -> str:
    """The class of a character."""
    if c in "0123456789":
        return "d"
    if c in "abcdef":
        return "h"
    if "a" <= c <= "z":
        return "l"
    if c in "ABCDEF":
        return "H"
    if "A" <= c <= "Z":
        return "L"
    return c if c in "+/_.=-" else "?"


SYMBOLS = "dhlHL+/_.=-?"
#: Characters that a symbol stands for.
WEIGHT = {"d": 10, "h": 6, "l": 20, "H": 6, "L": 20}


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: log2 odds of each step and of the end."""

    step: list[dict[str, tuple[int, float]]]
    end: list[float]
    least: float  # of a step that was never seen
    shortest: int

    def bits(self, text: str) -> float:
        """log2 likelihood of the format."""
        state, total = 0, 0.0
        for c in text:
            to, p = self.step[state].get(symbol(c), (state, self.least))
            state, total = to, total + p - math.log2(WEIGHT.get(symbol(c), 1))
        return total + self.end[state]


def infer(samples: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """State merging on the prefix tree of the samples' character classes, with a count on every step.

    States are taken in breadth-first order; each is merged into the first settled state whose frequencies of
    ending and of every symbol are compatible, and recursively those of their children, by Hoeffding's bound;
    otherwise it is settled itself. Merging folds the subtrees together and adds the counts of their steps and
    ends, so the automaton stays deterministic and a step's probability is how often it was taken among all
    steps and ends of its state, one added to each.
    """
    edges: list[dict[str, list[int]]] = [{}]  # of each state: symbol to [state, count]
    ends = [0]
    shortest = 0
    for n, text in enumerate(samples):
        state = 0
        shortest = min(shortest, len(text)) if n else len(text)
        for c in text:
            edge = edges[state].setdefault(symbol(c), [len(edges), 0])
            if edge[0] == len(edges):
                edges.append({})
                ends.append(0)
            edge[1] += 1
            state = edge[0]
        ends[state] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def passes(state: int) -> int:
        return ends[state] + sum(n for _, n in edges[state].values())

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        """b: the root of a tree that is not settled, so this ends."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = passes(a), passes(b)
            if differ(ends[a], n, ends[b], m):
                return False
            for s in edges[a].keys() | edges[b].keys():
                (x, i), (y, j) = edges[a].get(s, (None, 0)), edges[b].get(s, (None, 0))
                if differ(i, n, j, m):
                    return False
                if x is not None and y is not None:
                    stack.append((x, y))
        return True

    def fold(a: int, b: int) -> None:
        """b, the root of a tree, into a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            ends[a] += ends[b]
            for s, (y, n) in edges[b].items():
                if s in edges[a]:
                    edges[a][s][1] += n
                    stack.append((edges[a][s][0], y))
                else:
                    edges[a][s] = [y, n]

    settled = {0: None}
    while (step := next(((r, s) for r in settled for s in sorted(edges[r]) if edges[r][s][0] not in settled), None)) is not None:
        parent, s = step
        state = edges[parent][s][0]
        into = next((r for r in settled if compatible(r, state)), None)
        if into is None:
            settled[state] = None
        else:
            edges[parent][s][0] = into
            fold(into, state)
    number = {state: n for n, state in enumerate(settled)}
    step_, end = [], []
    for state in settled:
        total = passes(state) + len(SYMBOLS) + 1
        step_.append({s: (number[x], math.log2((n + 1) / total)) for s, (x, n) in edges[state].items()})
        end.append(math.log2((ends[state] + 1) / total))
    return Automaton(step_, end, -12.0, shortest)


@dataclass
class Ordinary:
    """How likely ordinary tokens are: transitions between character classes."""

    after: dict[tuple[str, str], float]
    least: float

    def bits(self, text: str) -> float:
        last, total = "^", 0.0
        for c in text:
            s = symbol(c)
            total += self.after.get((last, s), self.least) - math.log2(WEIGHT.get(s, 1))
            last = s
        return total + self.after.get((last, "$"), self.least)


_CODES = bytes((SYMBOLS + "\n").index("\n" if c == "\n" else symbol(c)) for c in map(chr, range(256)))


def transitions(tokens: Iterable[str]) -> np.ndarray:
    """How often each symbol follows each in the tokens, with what is between tokens as the last one."""
    codes = np.frombuffer("\n".join(["", *tokens, ""]).encode("latin-1", "replace").translate(_CODES), np.uint8).astype(np.int64)
    n = len(SYMBOLS) + 1
    return np.bincount(codes[:-1] * n + codes[1:], minlength=n * n).reshape(n, n)


def model(counts: np.ndarray) -> Ordinary:
    """With one added to each count; what was never seen has the least."""
    last, then = [*SYMBOLS, "^"], [*SYMBOLS, "$"]
    total = counts.sum(axis=1) + len(SYMBOLS) + 1
    return Ordinary({(last[a], then[b]): math.log2((counts[a, b] + 1) / total[a]) for a, b in zip(*np.nonzero(counts), strict=True)}, -8.0)


def ordinary(tokens: list[str]) -> Ordinary:
    return model(transitions(tokens))


def _counted(values: DataFrame, found: Callable[[str], list[str]]) -> np.ndarray:
    """The transitions in what `found` gives for each of values, a column of strings: one row of numbers from each
    task, of which only the sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SYMBOLS) + 1,) * 2, np.int64)
        for batch in batches:
            total += transitions(t for x in batch.column(0).to_pylist() for t in found(x or ""))
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    out = np.zeros((len(SYMBOLS) + 1) ** 2, np.int64)
    for r in values.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    out[-1] = 0  # between two batches' ends
    return out.reshape(len(SYMBOLS) + 1, -1)


def _base() -> Column:
    """array<struct<kind, start, stop, found>> that counts."""
    enough = [f"length({_SECOND.format('c.found')}) >= 6", "length(c.found) >= 20", "length(c.found) >= 24"]
    return F.expr("concat(" + ", ".join(f"transform(filter(found{k}, c -> {enough[k]}), c -> named_struct('kind', {k}, 'start', c.start, 'stop', c.stop, 'found', c.found))" for k in range(3)) + ")")


def scan(rows: DataFrame) -> DataFrame:
    """(row, text) to row, text, base and tokens: the matches of the definitions, and the candidates outside them."""
    found = {f"found{k}": spans("text", _HEX if k == 2 else p) for k, p in enumerate(PATTERNS)} | {"tokens": spans("text", CANDIDATE)}
    rows = rows.select("row", "text", *(c.alias(k) for k, c in found.items()))
    rows = rows.select("row", "text", _base().alias("base"), F.expr("transform(tokens, c -> named_struct('start', c.start, 'stop', c.stop, 'found', c.found))").alias("tokens"))
    return rows.withColumn("tokens", F.expr("filter(tokens, c -> not exists(base, b -> b.start < c.stop and c.start < b.stop))"))


@dataclass
class Scorer:
    """Automata of the formats, and what ordinary tokens are like."""

    automata: list[Automaton]
    usual: list[Ordinary]
    margin: float

    def secret(self, token: str) -> bool:
        floor = max((u.bits(token) for u in self.usual), default=0.0) + self.margin * len(token)
        return any(len(token) >= a.shortest and a.bits(token) > floor for a in self.automata)


def learn(scanned: DataFrame, texts: DataFrame, sample: int = SAMPLE, margin: float = MARGIN) -> Scorer:
    """From (base, tokens) of all rows, and all texts (text), of which the words are counted.

    Of the distinct values of each kind up to LONGEST characters, those of least hash, `sample` at most, reach the
    driver (by a top-k that is combined before the shuffle), so at most 3 * sample * LONGEST characters."""

    def least(values: DataFrame) -> list[str]:
        return [r[0] for r in values.where(F.length("value") <= LONGEST).distinct().orderBy(F.xxhash64("value"), "value").limit(sample).collect()]

    labelled = scanned.where("size(base) > 0").select(F.inline("base")).select("kind", F.when(F.col("kind") == 0, F.expr(_SECOND.format("found"))).otherwise(F.col("found")).alias("value"))
    automata = [infer(values) for k in range(3) if (values := least(labelled.where(F.col("kind") == k).select("value")))]
    distinct = scanned.where("size(tokens) > 0").select(F.inline("tokens")).select(F.col("found").alias("value")).distinct()
    usual = [model(_counted(distinct, lambda x: [x])), model(_counted(texts, re.compile(WORD).findall))] if automata else []
    return Scorer(automata, usual, margin)


def _scanned(docs: DataFrame, row: Column) -> DataFrame:
    """scan() without the texts, checkpointed."""
    return durable(scan(docs.select(row.alias("row"), text_of().alias("text"))).select("row", "base", "tokens"))


def find_secrets(docs: DataFrame, sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """docs (doc_id, text) to doc_id, base and added, arrays of struct<kind, start, stop> (KINDS by position).

    base: the matches of the definitions, which also label credentials. Of their distinct values, at most
    `sample` of each kind reach the driver (`learn`), and an automaton is inferred for each kind. All candidate
    tokens of all texts are scored; added are those outside base spans whose best format beats ordinary tokens
    by more than `margin` bits a character (a tie adds nothing), and which are no shorter than that format's
    shortest. Candidates do not overlap, so no two added spans do. How likely an ordinary token is say the
    transitions within all distinct candidates and those within all words of all texts, whichever is more.
    Rows with candidates pass through Arrow batches; the scan stays in the JVM, in time near the text's length
    however long, and is checkpointed without the texts, which are read once more to count the words. Null texts
    are empty; without credentials to learn from, and in an empty table, nothing is added; repeated rows stay;
    other columns are not read, so none can clash.
    """
    rows = _scanned(docs, F.col("doc_id")).withColumnRenamed("row", "doc_id")
    scorer = learn(rows, docs.select(text_of()), sample, margin)
    slim = "named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop)"
    kept = rows.select("doc_id", F.expr(f"transform(base, x -> {slim})").alias("base"), "tokens")
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [[{"kind": 3, "start": t["start"], "stop": t["stop"]} for t in tokens.as_py() or () if scorer.secret(t["found"])] for tokens in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, span)], names=["doc_id", "base", "added"])

    shape = "array<struct<kind:int,start:int,stop:int>>"
    return kept.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base {shape}, added {shape}")


def masked(text: str, found: Iterable[tuple[int, int]], mask: str) -> str:
    """The text with every span replaced, overlapping ones as one."""
    out, at = [], 0
    for start, stop in sorted(found):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[secret]", sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """docs with every secret that `find_secrets` finds replaced by the mask, overlapping spans as one; n_chars,
    if there is one, is that of the new text.

    A first pass learns the formats; a second finds the spans of each row's own text again and masks them in the
    same row, without a shuffle: ids are not looked at, so rows without one, and rows that share one, are masked
    like any other. Repeated rows stay and are masked alike; rows without spans stay as they are, null and empty
    texts among them; all columns keep their names, whatever they are. An empty table gives an empty result.
    """
    scorer = learn(_scanned(docs, F.lit(0)), docs.select(text_of()), sample, margin)

    @F.arrow_udf("string")
    def hide(texts: pa.Array, base: pa.Array, tokens: pa.Array) -> pa.Array:
        out = []
        for text, those, some in zip(texts, base, tokens, strict=True):
            if not text.is_valid:
                out.append(None)
                continue
            hits = [(x["start"], x["stop"]) for x in those.as_py()] + [(t["start"], t["stop"]) for t in some.as_py() if scorer.secret(t["found"])]
            out.append(masked(text.as_py(), hits, mask) if hits else None)
        return pa.array(out, pa.string())

    rows = scan(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of().alias("text")))
    rows = rows.select("row", "base", "tokens", F.expr("if(size(base) + size(tokens) > 0, text, null)").alias("text"))
    rows = rows.select("row", hide("text", F.expr("transform(base, x -> named_struct('start', x.start, 'stop', x.stop))"), "tokens").alias("new"))
    new = {"text": F.coalesce(F.col("new"), F.col("row.text").cast("string")), "n_chars": F.coalesce(F.char_length("new").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))

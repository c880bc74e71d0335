"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable, text_of
from tessella.llm.spans import disjoint, listed, spans

KINDS = ["email", "ip", "card", "phone"]

#: Candidate patterns: (kind, base or wider, pattern). The base ones find what the definitions ask for; each begins
#: where a run begins or the last match ended, so that no text costs more than a few passes.
_LOCAL = "[A-Za-z0-9._%+-]"
_WORD = "(?<![A-Za-z0-9._%+-])"
PATTERNS = [
    (0, True, rf"(?:\G|{_WORD}){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (1, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (2, True, r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+"),
    (3, True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    (0, False, rf"{_WORD}{_LOCAL}{{1,64}}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{{1,63}}+){{1,8}}+"),
    (2, False, r"(?<![0-9])[0-9]{14,19}+(?![0-9])"),
    (3, False, r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
]

#: The gazetteers and cues of the labelers.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "co", "us", "int"]
CUES = [
    "e-?mail|mailto|contact|write|reach|courriel|correo",
    "ip|address|host|server|client|login|from|peer",
    "card|visa|master|amex|credit|debit|payment|pay|karte|carte|tarjeta",
    "phone|tel|call|mobile|cell|fax|whatsapp|sms|contact",
]
AGAINST = [
    "example|noreply|placeholder",
    "version|release|build|section|chapter",
    "isbn|order|invoice|serial|tracking|part|sku|id",
    "isbn|order|invoice|serial|tracking|fax ?id",
]
#: Classes that the word before a candidate is hashed to; the first is for none.
WORDS = 16
#: What the classifier sees of a candidate: votes, from -1, and then how long it is, what it is made of, the word before it
#: and what follows; and how many values each has.
FIELDS = ["v1", "v2", "v3", "v4", "size", "shape", "behind", "ahead"]
VALUES = [3, 3, 3, 3, 4, 3, WORDS, 4]
#: Votes of a format's own check at the start; rounds of expectation-maximisation; steps of training.
CHECK, ROUNDS, STEPS = 4, 60, 400


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    d = f"split(reverse({_digits(x)}), '')"
    return f"""aggregate(transform(filter({d}, c -> c <> ''), (c, i) ->
        if(i % 2 = 0, cast(c as int), if(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int)))), 0, (a, c) -> a + c) % 10 = 0"""


def _valid(kind: int, x: str) -> str:
    """Whether a base match counts."""
    n = f"length({_digits(x)})"
    return [
        "true",
        f"forall(split({x}, '\\\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', ltrim('0', p)) as decimal(38, 0)) <= 255)",
        f"{n} between 14 and 19 and {_luhn(x)}",
        f"{n} between 10 and 15",
    ][kind]


def _votes(kind: int, base: bool) -> list[str]:
    """FIELDS of candidate c: four labelers' votes (1 for, -1 against, 0 none), and its other features."""
    f, n = "c.found", f"length({_digits('c.found')})"
    regex = [
        "case when c.found rlike '@[^.]+([.][^.]+)*[.][A-Za-z]{2,24}$' then 1 else -1 end" if base else "0",
        f"if({_valid(1, f)}, 1, -1)",
        f"if({_valid(2, f)}, 1, -1)",
        f"if({_valid(3, f)}, 1, -1)",
    ][kind]
    gazetteer = [
        f"if(lower(regexp_extract(c.found, '[A-Za-z]+$', 0)) in ({', '.join(repr(d) for d in DOMAINS)}), 1, -1)",
        "if(c.found rlike '^(0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]', -1, 1)",
        f"if({_digits(f)} rlike '^(4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65)', 1, -1)",
        f"if({_digits(f)} rlike '^(1[2-9]..[2-9]|[2-9])', 1, -1)",
    ][kind]
    context = f"case when lower(c.before) rlike '(?<![a-z])({AGAINST[kind]})[^a-z]{{0,12}}$' then -1 when lower(c.before) rlike '(?<![a-z])({CUES[kind]})(?![a-z])' then 1 else 0 end"
    edge = "if(c.before rlike '[A-Za-z0-9]$' or c.next rlike '[A-Za-z0-9@]', -1, 1)"
    long = f"case when {n} = 0 then 0 when {n} < 10 then 1 when {n} < 14 then 2 else 3 end"
    shape = "case when c.found rlike '[ ()]' then 2 when c.found rlike '[^A-Za-z0-9]' then 1 else 0 end"
    word = "lower(regexp_extract(c.before, '([\\\\p{L}]+)[^\\\\p{L}]*$', 1))"
    behind = f"if({word} = '', 0, 1 + cast(pmod(xxhash64({word}), {WORDS - 1}) as int))"
    ahead = "case when c.next = '' then 0 when c.next rlike '\\\\s' then 1 when c.next rlike '[\\\\p{L}0-9]' then 2 else 3 end"
    return [regex, gazetteer, context, edge, long, shape, behind, ahead]


def _candidates() -> Column:
    """array<struct<kind, start, stop, base, FIELDS>> of a text."""
    parts = []
    for n, (kind, base, _) in enumerate(PATTERNS):
        votes = _votes(kind, base)
        kept = f"({_valid(kind, 'c.found')})" if base else "false"
        enough = {1: "true", 2: f"length({_digits('c.found')}) >= 12", 3: f"length({_digits('c.found')}) >= 7"}.get(kind, "true")
        fields = ", ".join(f"'{name}', {vote}" for name, vote in zip(FIELDS, votes, strict=True))
        parts.append(f"transform(filter(found{n}, c -> {enough}), c -> named_struct('kind', {kind}, 'start', c.start, 'stop', c.stop, 'base', {kept}, {fields}))")
    return F.expr(f"concat({', '.join(parts)})")


def reliabilities(counts: dict[tuple, int]) -> dict[tuple, float]:
    """Expectation-maximisation over vote patterns.

    counts: rows of each (kind, v1, v2, v3, v4). Each labeler has, for each kind and for true and
    false spans, a chance of voting for; the M-step counts its votes with one added, the E-step gives
    each pattern its posterior, to which a labeler that abstains adds nothing. It starts from majority votes, that of the format's own check counting
    CHECK times.
    """
    posterior = {x: 1 / (1 + math.exp(-sum(x[1:5]) - (CHECK - 1) * x[1])) for x in counts}
    for _ in range(ROUNDS):
        total, vote = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
        for x, n in counts.items():
            for true, p in ((1, posterior[x]), (0, 1 - posterior[x])):
                total[x[0], true] += n * p
                for k in range(4):
                    vote[x[0], k, true, x[1 + k]] += n * p  # of those that abstain, nothing is asked
        moved = 0.0
        for x in counts:
            logs = [math.log(total[x[0], true]) + sum(math.log(vote[x[0], k, true, x[1 + k]] / sum(vote[x[0], k, true, v] for v in (-1, 1))) for k in range(4) if x[1 + k]) for true in (1, 0)]
            now = 1 / (1 + math.exp(max(-50.0, min(50.0, logs[1] - logs[0]))))
            moved = max(moved, abs(now - posterior[x]))
            posterior[x] = now
        if moved < 1e-6:
            break
    return posterior


def train(counts: dict[tuple, int], posterior: dict[tuple, float]) -> dict[tuple, float]:
    """Weights of a logistic span classifier: (kind,) and (kind, field, value) to a number.

    counts: rows of each (kind, *FIELDS); posterior: by (kind, v1, v2, v3, v4), the labelers' word, which the
    classifier learns from all the fields, each pattern counting by the root of its rows, by gradient steps with a
    small penalty. So a candidate's shape and neighbours weigh as they do where labelers are sure.
    """
    if not counts:
        return {}
    patterns = np.array(list(counts))
    width = 1 + sum(VALUES)
    starts = np.cumsum([1, *VALUES[:-1]])
    shifted = patterns[:, 1:] + np.array([1, 1, 1, 1, 0, 0, 0, 0])
    at = np.column_stack([patterns[:, 0] * width, patterns[:, :1] * width + starts + shifted])
    target = np.array([posterior[x[:5]] for x in counts])
    mass = np.sqrt(np.array(list(counts.values()), float))
    mass /= mass.sum()
    weight = np.zeros(width * len(KINDS))
    for _ in range(STEPS):
        error = (target - 1 / (1 + np.exp(-np.clip(weight[at].sum(axis=1), -50, 50)))) * mass
        weight += 4.0 * (np.bincount(at.ravel(), np.repeat(error, at.shape[1]), len(weight)) - 1e-4 * weight)
    out = {}
    for kind in range(len(KINDS)):
        out[kind,] = float(weight[kind * width])
        for n, values in enumerate(VALUES):
            for v in range(values):
                out[kind, n, v - (n < 4)] = float(weight[kind * width + starts[n] + v])
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, base and added, arrays of struct<kind, start, stop> (KINDS by position).

    base: the matches of the definitions. added: further candidates that the classifier, trained on all
    rows' votes, takes for personal data; none overlaps a base span, and none another one: of those that do, the one
    that begins first, then the longest, stays. A first pass finds candidates with their votes and features and
    checkpoints these alone; the counts of their patterns, of which there are some ten thousand at most whatever the
    rows (VALUES), reach the driver, which runs expectation-maximisation and fits the classifier; a second pass over
    the checkpoint applies it as an expression. All row work is Spark SQL. A text costs a few passes, however long it
    is. A null text is empty; a text without candidates gives empty arrays; a score of just zero adds nothing;
    repeated rows stay; other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select("doc_id", *(spans("text", p).alias(f"found{n}") for n, (_, _, p) in enumerate(PATTERNS)))
    rows = durable(rows.select("doc_id", _candidates().alias("found")))
    patterns = rows.where("size(found) > 0").select(F.inline("found")).groupBy("kind", *FIELDS).count()
    counts = {tuple(r[:-1]): r[-1] for r in patterns.collect()}
    votes: dict[tuple, int] = defaultdict(int)
    for x, n in counts.items():
        votes[x[:5]] += n
    weight = train(counts, reliabilities(votes))
    by_kind = []
    for kind in range(len(KINDS)):
        terms = [f"{weight.get((kind,), 0.0):.9f}D"]
        for n, (field, values) in enumerate(zip(FIELDS, VALUES, strict=True)):
            low = -1 if n < 4 else 0
            terms.append(f"element_at(array({', '.join(f'{weight.get((kind, n, low + v), 0.0):.9f}D' for v in range(values))}), c.{field} + {1 - low})")
        by_kind.append(f"when c.kind = {kind} then {' + '.join(terms)}")
    score = f"case {' '.join(by_kind)} end"
    slim = "c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop)"
    apart = "not exists(found, b -> b.base and b.start < c.stop and c.start < b.stop)"
    return rows.select(
        "doc_id",
        F.expr(f"transform(filter(found, c -> c.base), {slim})").alias("base"),
        F.expr(f"transform(filter(found, c -> not c.base and {score} > 0 and {apart}), {slim})").alias("added"),
    ).select("doc_id", "base", disjoint("added").alias("added"))


def digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts and digests of base and added arrays, and how many spans there are in all."""
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, x -> x.kind = {n})) as bigint)").alias(f"n_{k}") for n, k in enumerate(kinds)),
        F.sha2(listed(kinds, "base"), 256).alias("base_sha256"),
        listed(kinds, "array_distinct(concat(base, added))").alias("spans"),
        F.expr("cast(size(array_distinct(concat(base, added))) as bigint)").alias("n_spans"),
    )

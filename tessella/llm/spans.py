"""Regular-expression spans with code-point offsets, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of context before a match that are kept with it.
CONTEXT = 48
#: Matches that are gathered in one array before it is joined with the others.
RUN = 256

_SPAN = "struct<start:int,stop:int,found:string,before:string,next:string>"


def quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern in a text expression, as
    array<struct<start, stop, found, before, next>>.

    pattern: a Java pattern without a match of no characters; for bounded time and stack on long texts,
    it should begin matches only where a run begins and repeat groups possessively. Offsets count code
    points, stop is exclusive; before and next are the characters around the match (up to CONTEXT of
    them, and one). A match's place follows from the lengths of what lies between the matches, so a text
    is searched once, and once more only if something was found.
    """
    p = quoted(pattern)
    none = f"cast(array() as array<{_SPAN}>)"
    # Runs of RUN matches are arrays of their own and joined at the end, as to append copies what there is.
    return F.expr(f"""
        transform(array(regexp_extract_all({text}, {p}, 0)), m ->
            if(size(m) = 0, {none},
               transform(array(split({text}, {p}, -1)), g ->
                   aggregate(sequence(0, (size(m) - 1) div {RUN}),
                       named_struct('at', 0, 'runs', cast(array() as array<array<{_SPAN}>>)),
                       (b, r) -> transform(array(
                           aggregate(sequence(cast(r * {RUN} as int), cast(least(size(m) - 1, r * {RUN} + {RUN - 1}) as int)),
                               named_struct('at', b.at, 'out', {none}),
                               (a, i) -> named_struct(
                                   'at', a.at + char_length(g[i]) + char_length(m[i]),
                                   'out', concat(a.out, array(named_struct(
                                       'start', a.at + char_length(g[i]),
                                       'stop', a.at + char_length(g[i]) + char_length(m[i]),
                                       'found', m[i],
                                       'before', right(g[i], {CONTEXT}),
                                       'next', left(g[i + 1], 1))))))
                           ), x -> named_struct('at', x.at, 'runs', concat(b.runs, array(x.out))))[0],
                       b -> flatten(b.runs)))[0]))[0]""")


def disjoint(array: str) -> Column:
    """Those of array<struct<kind, start, stop>> that begin where all before them, by start and then from long to
    short, have ended."""
    of = f"array_sort(transform({array}, x -> named_struct('start', x.start, 'back', -x.stop, 'kind', x.kind)))"
    none = "cast(array() as array<struct<kind:int,start:int,stop:int>>)"
    return F.expr(f"""if(size({array}) < 2, {array}, transform(array({of}), s ->
        aggregate(sequence(0, (size(s) - 1) div {RUN}), named_struct('at', 0, 'runs', cast(array() as array<array<struct<kind:int,start:int,stop:int>>>)),
            (b, r) -> transform(array(
                aggregate(slice(s, cast(r * {RUN} + 1 as int), {RUN}), named_struct('at', b.at, 'out', {none}),
                    (a, x) -> named_struct('at', greatest(a.at, -x.back), 'out',
                        if(x.start < a.at, a.out, concat(a.out, array(named_struct('kind', x.kind, 'start', x.start, 'stop', -x.back))))))
                ), y -> named_struct('at', y.at, 'runs', concat(b.runs, array(y.out))))[0],
            b -> flatten(b.runs)))[0])""")


def listed(kinds: list[str], array: str) -> Column:
    """'kind:start:stop' of array<struct<kind int, start int, stop int, ...>>, by start, then by the kinds'
    order, then stop, joined by commas; kinds are named by position."""
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return F.expr(f"""array_join(transform(
        array_sort(transform({array}, x -> named_struct('start', x.start, 'kind', x.kind, 'stop', x.stop))),
        x -> concat({names}[x.kind], ':', x.start, ':', x.stop)), ',')""")

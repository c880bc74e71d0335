"""Ranked full-text search: tokens, four modes, BM25."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import EngineError, invalid
from tessella.functions import pointer
from tessella.plans.binding import Documents
from tessella.sources.versions import Versions

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Documents that a search may find at most where a whole answer is asked for.
CANDIDATES = 10_000
#: Bytes of text that are inverted at once, and rows of a batch of what comes of them.
PART, ROWS = 8_000_000, 50_000
#: Documents whose entries give the ends of an index's ranges, and entries that a range holds at least.
SAMPLE, SHARE = 500, 250_000
#: Entries, and positions, of a token from which the next block begins.
BLOCK, PLACES = 4_000, 40_000
SENT = "part int, words binary, word_sizes binary, runs binary, ids binary, id_sizes binary, owners binary, tfs binary, places binary, counts binary"
BLOCKS = "token string, entries int, ids binary, id_sizes binary, tfs binary, positions binary"
MODES = ("all", "any", "phrase", "prefix")
NO_TOKEN = r"[^\p{L}\p{N}]+"


@dataclass
class Search:
    text: str
    fields: tuple[tuple[str, ...], ...]
    mode: str
    candidates: int | None = None


def normalize(request: Any) -> Search:
    if not isinstance(request, dict) or not set(request) <= {"query", "fields", "mode", "max_candidates"}:
        raise invalid("a search has a query, fields and a mode")
    if not isinstance(request.get("query"), str) or request.get("mode", "all") not in MODES:
        raise invalid("a search has a query and a mode")
    fields = tuple(pointer.parse(f) for f in request.get("fields", ()))
    if not fields:
        raise invalid("a search names its fields")
    return Search(request["query"], fields, request.get("mode", "all"), request.get("max_candidates"))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NO_TOKEN), lambda t: t != "")


def query_tokens(spark: SparkSession, text: str) -> list[str]:
    """The query's tokens, by the engine's own rule."""
    row = spark.range(1).select(tokenize(F.lit(text)).alias("t")).first()
    if not row.t:
        raise invalid("the query has no token")
    return list(row.t)


def content(docs: Documents, fields: tuple[tuple[str, ...], ...]) -> Column:
    """The string values of the fields, each on a line; others are skipped."""
    return F.concat_ws("\n", *(docs.at(f).string() for f in fields))


def _test(word: str, prefix: bool) -> Callable[[Column], Column]:
    return (lambda t: t.startswith(word)) if prefix else (lambda t: t == word)


def matching(tokens: Column, words: list[str], mode: str) -> Column:
    """Whether an array of tokens satisfies a mode."""
    if mode == "any":
        return F.arrays_overlap(tokens, F.array(*map(F.lit, dict.fromkeys(words))))
    if mode == "phrase":
        return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")
    if mode == "prefix":
        return reduce(lambda a, b: a & b, (F.exists(tokens, _test(w, True)) for w in dict.fromkeys(words)))
    return reduce(lambda a, b: a & b, (F.array_contains(tokens, w) for w in dict.fromkeys(words)))


def ranked(docs: Documents, s: Search) -> DataFrame:
    """Matching documents with `rank`, minus the BM25 score, smaller is better.

    Without an index: each document's tokens, its length and its counts of the query's words (each word, or for
    prefixes the words that begin so). Document frequencies and the average length are one row, a scalar
    subquery over a scan of its own; nothing is shuffled by term. `SearchIndex.ranked` gives the same from
    stored postings, of which it reads the query's words alone.
    """
    order = query_tokens(docs.df.sparkSession, s.text)
    words = list(dict.fromkeys(order))
    kept = docs.df.withColumn("_tokens", tokenize(content(docs, s.fields)))
    counts = [F.size(F.filter("_tokens", _test(w, s.mode == "prefix"))).cast("double") for w in words]
    kept = kept.withColumn("_tf", F.array(*counts)).withColumn("_length", F.size("_tokens").cast("double"))
    stats = kept.agg(F.struct(F.count("*").alias("n"), F.avg("_length").alias("avg"), *(F.sum((F.col("_tf")[k] > 0).cast("long")).alias(f"df{k}") for k in range(len(words)))).alias("stats"))
    hits = kept.where(matching(F.col("_tokens"), order, s.mode)).withColumn("_s", stats.scalar())
    hits = hits.withColumn("rank", -_bm25([F.col("_tf")[k] for k in range(len(words))], F.col("_length"), F.col("_s"))).drop("_tokens", "_tf", "_length", "_s")
    return _bounded(hits, s.candidates)


def _bm25(counts: list[Column], length: Column, stats: Column) -> Column:
    """The score from a document's counts of each word, its length and stats (n, avg, df0, df1...)."""
    score = F.lit(0.0)
    for k, tf in enumerate(counts):
        idf = F.log(1 + (stats["n"] - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / stats["avg"]))
    return score


def _bounded(hits: DataFrame, most: int | None) -> DataFrame:
    if most is not None and hits.limit(most + 1).count() > most:
        raise EngineError("resource_limit", "too many candidates", limit=most)
    return hits


def postings(docs: Documents, fields: tuple[tuple[str, ...], ...], positions: bool = True) -> DataFrame:
    """An inverted index: token, id, tf and, if they are wanted, positions; write it partitioned or sorted by token to
    reuse it."""
    return _inverted(*_by_id(docs, fields)[:2], positions=positions)


def entries(docs: Documents, fields: tuple[tuple[str, ...], ...]) -> DataFrame:
    """The postings, and one more row of each document: the empty token, whose tf is the document's length."""
    return _inverted(*_by_id(docs, fields)[:2], lengths=True)


def arranged(df: DataFrame) -> DataFrame:
    """Entries in ranges of tokens, and sorted; rows of a frequent token are spread."""
    return df.repartitionByRange(F.col("token"), F.xxhash64("id")).sortWithinPartitions("token", "id")


def arranged_entries(docs: Documents, fields: tuple[tuple[str, ...], ...]) -> DataFrame:
    """The entries, arranged: those of `arranged_blocks`, and sorted by id too."""
    return opened(arranged_blocks(docs, fields)).sortWithinPartitions("token", "id")


def arranged_blocks(docs: Documents, fields: tuple[tuple[str, ...], ...]) -> DataFrame:
    """The entries in ranges of tokens, many of a token's in one row: token, how many, and the bytes of their ids,
    of the sizes of these and 1 (0: null), tfs and positions, the numbers of a column in as few bytes each as all of them
    need. Rows are sorted by token. What a range gets of a part of the documents is sent to it as one row of bytes; a token's
    entries are put together where they arrive, so neither a shuffle nor a sort has a row of each.

    Spark's own ranges would take inverting every document twice, once for its sample of keys; here the ends of ranges
    are of the entries of some SAMPLE documents, and all documents are inverted once."""
    single, shared, count = _by_id(docs, fields)
    every = max(1, count // SAMPLE)
    drawn = single.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    found = _inverted(drawn, None, lengths=True, positions=False).select("token", F.xxhash64("id").alias("h")).toArrow()
    keys = sorted(zip(found["token"].to_pylist(), found["h"].to_pylist(), strict=True))
    most = max(int(docs.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(keys) * every // (8 * SHARE))
    parts = min(most, 1 + len(keys) * every // SHARE)
    ends = [keys[len(keys) * n // parts] for n in range(1, parts)] if keys else []
    runs = _letters(single.sparkSession)
    sent = single.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(lambda batches: _send(batches, runs, ends), SENT)
    out = sent.repartitionById(len(ends) + 1, F.col("part")).mapInArrow(_receive, BLOCKS)
    return out if shared is None else out.unionByName(packed(arranged(_grouped(shared, lengths=True))))


def packed(df: DataFrame) -> DataFrame:
    """Arranged entries as rows of blocks; those of a token that lie together and come in one batch are one."""
    return df.select("token", "id", F.col("tf").cast("int"), "positions").mapInArrow(_pack, BLOCKS)


def opened(df: DataFrame, where: Column | None = None, positions: bool = True) -> DataFrame:
    """Blocks as entries, of the tokens that a filter takes, which reaches their scan; with or without positions. Rows
    that are entries already (of an index written before there were blocks) stay as they are."""
    df = df if where is None else df.where(where)
    if "entries" not in df.columns:
        return df if positions else df.drop("positions")
    schema = "token string, id string, tf bigint" + (", positions array<int>" if positions else "")
    return (df if positions else df.drop("positions")).mapInArrow(_open, schema)


def _by_id(docs: Documents, fields: tuple[tuple[str, ...], ...]) -> tuple[DataFrame, DataFrame | None, int]:
    """(id, lower-cased text) of documents whose id no other has, which need no shuffle to be grouped; of the others, if there
    are any; and how many documents there are. Ids alone are read to tell."""
    rows = docs.df.select(docs.id_column().alias("id"), F.lower(content(docs, fields)).alias("text"))
    ids = docs.df.groupBy(docs.id_column().alias("_id")).agg(F.count("*").alias("n"))
    seen = ids.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if seen.all is None or seen.most == 1:
        return rows, None, seen.all or 0
    repeated, same = ids.where("n > 1").select("_id"), F.col("id").eqNullSafe(F.col("_id"))
    return rows.join(repeated, same, "left_anti"), rows.join(repeated, same, "left_semi"), seen.all


def _inverted(single: DataFrame, shared: DataFrame | None, lengths: bool = False, positions: bool = True) -> DataFrame:
    """token, id, tf, positions of (id, text): documents with an id of their own are inverted where they are read,
    those that share one are exploded and grouped. lengths: as in `entries`. Without positions, what only reads them is
    left out."""
    schema = "token string, id string, tf bigint" + (", positions array<int>" if positions else "")
    runs = _letters(single.sparkSession)
    out = single.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(lambda batches: _invert(batches, runs, lengths, positions), schema)
    return out if shared is None else out.unionByName(_grouped(shared, lengths).select(out.columns))


def _grouped(shared: DataFrame, lengths: bool) -> DataFrame:
    """_inverted, of documents that share an id."""
    places = F.transform("tokens", lambda t, n: F.struct(t.alias("token"), n.alias("at")))
    if lengths:
        places = F.concat(places, F.array(F.struct(F.lit("").alias("token"), F.size("tokens").alias("at"))))
    rows = shared.select("id", tokenize(F.col("text")).alias("tokens")).select("id", F.inline(places))
    rows = rows.groupBy("token", "id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("at")).alias("at"))
    own = F.col("token") == ""
    return rows.select("token", "id", F.when(own, F.col("at")[0].cast("long")).otherwise(F.col("n")).alias("tf"), F.when(own, F.array().cast("array<int>")).otherwise(F.col("at")).alias("positions"))


@lru_cache(maxsize=1)
def _letters(spark: SparkSession) -> np.ndarray:
    """The code points that NO_TOKEN lets stand, by the engine's own rule: where their runs begin and end, in turn."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([("".join(map(chr, every[n : n + 0x4000])),) for n in range(0, len(every), 0x4000)], "s string")
    stand = np.zeros(0x110000 + 1, bool)
    stand[[ord(c) for r in rows.select(F.regexp_replace("s", NO_TOKEN, "").alias("s")).collect() for c in r.s]] = True
    return np.flatnonzero(np.diff(stand, prepend=False)).astype(np.int32)


def _tokens(texts: pa.Array, letter: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-cased texts, as `tokenize` has them, one text's after the other's; and how many each has.
    letter: by code point, whether it stands. Works on the bytes of all texts together."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    keep = np.append(letter[:128], np.zeros(128, bool))[data]
    lead = np.flatnonzero(data >= 0xC0)
    width = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int32) & (0x7F >> width)
    for k in range(1, 4):
        longer = np.flatnonzero(width > k)
        code[longer] = code[longer] << 6 | data[lead[longer] + k] & 0x3F
    stands = letter[code]
    for k in range(4):
        keep[lead[width > k] + k] = stands[width > k]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = keep[first]
    kept, at = data[keep], np.flatnonzero(begins[keep])
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(kept)).astype(np.int32)), pa.py_buffer(kept))
    return words, np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


def _pieces(batches: Iterator[pa.RecordBatch], runs: np.ndarray, by: str) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """Of documents with an id of their own, in parts of some PART bytes (a document is never cut) and in the order of a
    column: ids, tokens, how many each has, and hashes of ids."""
    letter = np.repeat(np.arange(len(runs) + 1) % 2 == 1, np.diff(runs, prepend=0, append=0x110000))
    for batch in batches:
        last = np.cumsum(np.asarray(pc.binary_length(batch.column(1))).astype(np.int64))
        cuts = np.unique([0, *np.searchsorted(last, np.arange(PART, last[-1] if len(last) else 0, PART)).tolist(), len(last)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            ids, texts, h = part.take(pc.sort_indices(part.column(by))).columns
            yield ids.cast(pa.string()), *_tokens(texts, letter), np.asarray(h)


def _by_word(tokens: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words in order; of each entry, by word and then document, the numbers of both; the bounds of the entries'
    positions, and these. (word, place in the part) as one number is sorted."""
    coded = tokens.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    bits = len(tokens).bit_length()
    key = rank[np.asarray(coded.indices)]
    key <<= bits
    key |= np.arange(len(tokens))
    key.sort()
    place = (key & (1 << bits) - 1).astype(np.int32)
    key >>= bits
    document = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[place]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    place -= (np.cumsum(sizes) - sizes).astype(np.int32)[document]
    return words, key[first], document[first], np.append(first, len(key)).astype(np.int32), place


def _invert(batches: Iterator[pa.RecordBatch], runs: np.ndarray, lengths: bool, positions: bool) -> Iterator[pa.RecordBatch]:
    """_inverted, of documents with an id of their own. Documents come, and words are numbered, in the order of an index,
    so rows leave in it: what is alike lies together when it is shuffled, and a sort after that finds long runs."""
    for ids, tokens, sizes, _ in _pieces(batches, runs, "id"):
        words, word, owner, bounds, places = _by_word(tokens, sizes)
        at = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(places))] if positions else []
        yield from _rows([words.take(pa.array(word)), ids.take(pa.array(owner)), pa.array(np.diff(bounds), pa.int64()), *at])
        if lengths:
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(ids) + 1), pa.int32()), pa.array([], pa.int32()))
            yield from _rows([pa.array([""] * len(ids), pa.string()), ids, pa.array(sizes, pa.int64()), *([none] if positions else [])])


def _rows(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    out = pa.RecordBatch.from_arrays(columns, ["token", "id", "tf", "positions"][: len(columns)])
    yield from (out.slice(n, ROWS) for n in range(0, len(out), ROWS))


def _send(batches: Iterator[pa.RecordBatch], runs: np.ndarray, ends: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """One row for each part of the documents and range that has entries of it, the empty token's among them. By bytes:
    the words and their sizes and 1; how many entries each has; the ids of the range and their sizes and 1 (0: null);
    one entry after the other the number of its id, tf and positions."""
    for ids, tokens, sizes, h in _pieces(batches, runs, "h"):
        words, word, owner, bounds, places = _by_word(tokens, sizes)
        words = pa.concat_arrays([pa.array([""], pa.string()), words])
        word, owner = np.append(np.zeros(len(ids), np.int64), word + 1), np.append(np.arange(len(ids)), owner)
        tf, at = np.append(sizes, np.diff(bounds)), np.append(np.zeros(len(ids), np.int64), bounds)
        part = _parts(words, word, h[owner], ends)
        cuts = np.searchsorted(part, np.arange(len(ends) + 2, dtype=part.dtype))
        new = np.ones(len(part), bool)
        new[1:] = (word[1:] != word[:-1]) | (part[1:] != part[:-1])
        run = np.flatnonzero(new)
        held, place = np.zeros((len(ends) + 1) * len(ids), bool), part * len(ids) + owner
        held[place] = True
        first = np.arange(len(ends) + 2) * len(ids)
        of = np.append(0, np.cumsum(held, dtype=np.int32))
        number = (of[:-1] - np.repeat(of[first[:-1]], len(ids)))[place]
        names = ids.take(pa.array(np.flatnonzero(held) % max(len(ids), 1)))
        told, word_cuts = words.take(pa.array(word[run])), np.searchsorted(run, cuts)
        columns = [
            *_texts(told, word_cuts), _bytes(_narrow(np.diff(np.append(run, len(part)))), word_cuts),
            *_texts(names, of[first]), _bytes(_narrow(number), cuts), _bytes(_narrow(tf), cuts), _bytes(_narrow(places), at[cuts]),
            _bytes(np.column_stack([np.diff(word_cuts), np.diff(cuts), np.diff(of[first])]).astype(np.int32).ravel(), np.arange(len(ends) + 2) * 3),
        ]
        out = pa.RecordBatch.from_arrays([pa.array(np.arange(len(ends) + 1), pa.int32()), *columns], SENT.replace(" int", "").replace(" binary", "").split(", "))
        yield out.take(pa.array(np.flatnonzero(np.diff(cuts))))


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers, none below 0, in as few bytes each as the largest needs."""
    return a.astype(np.min_scalar_type(a.max(initial=0)))


def _bytes(a: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of a between each two cuts."""
    offsets = pa.array(cuts * a.itemsize, pa.int64())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())


def _texts(strings: pa.Array, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The bytes of strings (as `take` gives them) between each two cuts, and their sizes and 1 (0: null)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(strings), -1)).astype(np.int32)
    at = np.append(0, np.cumsum(np.maximum(sizes, 0), dtype=np.int64))
    return _bytes(np.frombuffer(strings.buffers()[2] or b"", np.uint8), at[cuts]), _bytes(_narrow(sizes + 1), cuts)


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of what `_send` sent to a range. Only runs, all entries of a word in a row, are sorted."""
    rows = [[np.frombuffer(c[k].as_buffer(), np.uint8) for c in batch.columns[1:]] for batch in batches for k in range(len(batch))]
    if not rows:
        return
    got: list[list[np.ndarray]] = [[] for _ in range(8)]
    known = 0
    for words, word_sizes, runs, ids, id_sizes, owners, tfs, places, counts in rows:
        spans, entries, names = counts.view(np.int32).tolist()
        word_sizes, runs, id_sizes = _wide(word_sizes, spans) - 1, _wide(runs, spans), _wide(id_sizes, names) - 1
        owners, tfs = _wide(owners, entries) + known, _wide(tfs, entries)
        known += names
        places = _wide(places, int(tfs[int(runs[word_sizes == 0].sum()) :].sum()))
        for column, a in zip(got, (words, word_sizes, runs, ids, id_sizes, owners, tfs, places), strict=True):
            column.append(a)
    rows.clear()
    words, word_sizes, runs, ids, id_sizes, owners, tfs, places = (np.concatenate(got.pop(0)) for _ in range(8))
    coded = _strings(words, word_sizes).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    tokens, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    word = rank[np.asarray(coded.indices)]
    counts = np.where(np.repeat(word_sizes == 0, runs), 0, tfs)
    held = np.diff(np.append(0, np.cumsum(counts, dtype=np.int64))[np.append(0, np.cumsum(runs))])
    order = np.argsort(word, kind="stable")
    places = places[_spans(held, order)]
    entry = _spans(runs, order)
    owners, tfs, at, word = owners[entry], tfs[entry], np.append(0, np.cumsum(counts[entry], dtype=np.int64)), np.repeat(word[order], runs[order])
    yield from _in_blocks(tokens, word, _strings(ids, id_sizes), owners, tfs, at, places)


def _in_blocks(tokens: pa.Array, word: np.ndarray, ids: pa.Array, owners: np.ndarray, tfs: np.ndarray, at: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries in the order of words, as blocks of up to some BLOCK entries and PLACES positions (an entry is never cut)."""
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    start = np.repeat(first, np.diff(np.append(first, len(word))))
    nth, place = (np.arange(len(word)) - start) // BLOCK, (at[:-1] - at[start]) // PLACES
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (nth[1:] != nth[:-1]) | (place[1:] != place[:-1])))
    bounds = np.append(first, len(word))
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(first // ROWS + at[first] // (ROWS * 10)) != 0)), len(first))
    for m, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = bounds[m], bounds[n]
        own = bounds[m : n + 1] - a
        names = _texts(ids.take(pa.array(owners[a:b])), own)
        columns = [pa.array(np.diff(own), pa.int32()), *names, _bytes(_narrow(tfs[a:b]), own), _bytes(_narrow(places[at[a] : at[b]]), at[bounds[m : n + 1]] - at[a])]
        yield pa.RecordBatch.from_arrays([tokens.take(pa.array(word[first[m:n]])).cast(pa.string()), *columns], ["token", "entries", "ids", "id_sizes", "tfs", "positions"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            token, id, tf, positions = batch.columns
            coded = token.cast(pa.large_string()).dictionary_encode()
            at = np.append(0, np.cumsum(np.asarray(pc.list_value_length(positions)), dtype=np.int64))
            yield from _in_blocks(coded.dictionary, np.asarray(coded.indices), id, np.arange(len(batch)), np.asarray(tf), at, np.asarray(positions.flatten()))


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of blocks; of some ROWS of them at once."""
    for batch in batches:
        last = np.cumsum(np.asarray(batch.column("entries")), dtype=np.int64)
        cuts = np.unique([0, *(1 + np.flatnonzero(np.diff(last // ROWS))).tolist(), len(last)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            token, held = part.column("token").cast(pa.large_string()), np.asarray(part.column("entries"))
            tf, of = _numbers(part.column("tfs"), held), np.repeat(np.arange(len(part)), held)
            ids = _strings(_joined(part.column("ids"))[0], _numbers(part.column("id_sizes"), held) - 1)
            columns = [token.take(pa.array(of)).cast(pa.string()), ids.cast(pa.string()), pa.array(tf, pa.int64())]
            if "positions" in part.schema.names:
                counts = np.append(0, np.cumsum(np.where(np.asarray(pc.binary_length(token))[of] == 0, 0, tf)))
                last_of = np.append(0, np.cumsum(held))
                places = _numbers(part.column("positions"), np.diff(counts[last_of]))
                columns.append(pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(places, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["token", "id", "tf", "positions"][: len(columns)])


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a column of bytes, and how many each has."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset :][: len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _numbers(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The numbers in values that hold so many each, of a width of their own each."""
    data, sizes = _joined(column)
    width = np.repeat(sizes // np.maximum(counts, 1), counts)
    at = np.cumsum(width, dtype=np.int64) - width
    out = data[at].astype(np.int32)
    for k in range(1, 4):
        longer = np.flatnonzero(width > k)
        out[longer] |= data[at[longer] + k].astype(np.int32) << 8 * k
    return out


def _wide(data: np.ndarray, count: int) -> np.ndarray:
    """What `_narrow` made so many numbers to."""
    return data.view(f"u{len(data) // count}").astype(np.int32) if count else np.zeros(0, np.int32)


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings from their bytes and sizes (-1: null)."""
    offsets = pa.array(np.append(0, np.cumsum(np.maximum(sizes, 0), dtype=np.int64)), pa.int64())
    valid = pa.py_buffer(np.packbits(sizes >= 0, bitorder="little")) if (sizes < 0).any() else None
    return pa.LargeStringArray.from_buffers(len(sizes), offsets.buffers()[1], pa.py_buffer(data), valid)


def _spans(sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of things in a row, in spans of these sizes: their numbers when the spans are put in an order."""
    first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    last = np.cumsum(size)
    kind = np.int32 if len(last) and last[-1] < 2**31 else np.int64
    return np.arange(size.sum(), dtype=kind) + np.repeat((first - (last - size)).astype(kind), size)


def _parts(words: pa.Array, word: np.ndarray, h: np.ndarray, ends: list[tuple[str, int]]) -> np.ndarray:
    """The range of each (words[word], h), which are in the order of words: how many ends are less. By words, which are
    in order, and by h for those that are ends."""
    tokens, hashes = [t for t, _ in ends], np.array([x for _, x in ends], np.int64)
    after = [bisect_right(range(len(words)), t, key=lambda n: words[n].as_py()) for t in tokens]
    out = np.searchsorted(after, np.arange(len(words)), "right")[word]
    for n in {n - 1 for n, t in zip(after, tokens, strict=True) if n and words[n - 1].as_py() == t}:
        mine, t = slice(*np.searchsorted(word, [n, n + 1])), words[n].as_py()
        out[mine] += np.searchsorted(hashes[bisect_left(tokens, t) : bisect_right(tokens, t)], h[mine])
    return out


def search_postings(index: DataFrame, words: list[str], mode: str = "all") -> DataFrame:
    """Ids that an inverted index gives for a mode (all, any, prefix); pushes the tokens down to its scan."""
    if mode == "prefix":
        parts = [index.where(F.col("token").startswith(w)).select("id").distinct() for w in words]
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), parts)
    found = index.where(F.col("token").isin(*words)).groupBy("id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= (1 if mode == "any" else len(set(words)))).select("id")


def _of(words: list[str], mode: str) -> Column:
    """The tokens that a search for words reads."""
    return reduce(lambda a, b: a | b, (F.col("token").startswith(w) for w in words)) if mode == "prefix" else F.col("token").isin(*words)


def _places(words: list[str]) -> list[Column]:
    """Of the rows of a document: the positions of each word, at0, at1..."""
    return [F.max(F.when(F.col("token") == w, F.col("positions"))).alias(f"at{k}") for k, w in enumerate(words)]


def _follow(words: list[str], order: list[str]) -> Column:
    """Whether a document with `_places` has the words of a phrase, one after the other."""
    at = {w: F.col(f"at{k}") for k, w in enumerate(words)}
    start = lambda w, n: F.transform(at[w], lambda p: p - n)
    both = reduce(F.array_intersect, (start(w, n) for n, w in enumerate(order)))
    return reduce(lambda a, b: a & b, (x.isNotNull() for x in at.values())) & (F.size(both) > 0)


class SearchIndex:
    """Postings kept as a table in versions, in blocks sorted by token, so a query's words are found by the scan's
    statistics. A refresh writes the entries of changed documents as a layer over the others; readers see whole
    versions only."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str]):
        self.fields = tuple(pointer.parse(f) for f in fields)
        self.versions = Versions(spark, path, "postings")
        self.versions.opened, self.versions.arranged, self.versions.count = opened, lambda df: packed(arranged(df)), F.sum("entries")

    def rebuild(self, docs: Documents, sequence: int = 0) -> None:
        self.versions.write(arranged_blocks(docs, self.fields), sequence=sequence)

    def refresh(self, changed: Documents, sequence: int, deleted: str | None = None) -> None:
        """changed: the documents that changed up to `sequence`, as they are now; those deleted are marked."""
        if sequence <= self.versions.state().get("sequence", -1):
            return
        ids = changed.df.select(changed.id_column().alias("id")).distinct()
        live = Documents(changed.df.where(~F.col(deleted)) if deleted else changed.df, changed.id, changed.body, json=changed.json)
        self.versions.append(arranged_blocks(live, self.fields), ids, sequence=sequence)

    def read(self, where: Column | None = None, positions: bool = True, state: dict[str, Any] | None = None) -> DataFrame:
        """The entries of the tokens that a filter takes, which is pushed down to the scan."""
        index = self.versions.read(state, where=where, positions=positions)
        if index is None:
            raise EngineError("index_not_found", "the index has not been built")
        return index

    def search(self, text: str, mode: str = "all") -> DataFrame:
        """Ids for a mode: all, any, prefix, or phrase by positions."""
        order = query_tokens(self.versions.spark, text)
        words = list(dict.fromkeys(order))
        if mode != "phrase":
            return search_postings(self.read(_of(words, mode), positions=False), words, mode)
        rows = self.read(_of(words, mode)).where("id IS NOT NULL")
        return rows.groupBy("id").agg(*_places(words)).where(_follow(words, order)).select("id")

    def ranked(self, s: Search) -> DataFrame:
        """id and rank of matching documents, as the function `ranked` has them: from the rows of the query's words,
        grouped by document, and the lengths of the documents that have any. Words are pushed down to the scan."""
        state = self.versions.state()
        order = query_tokens(self.versions.spark, s.text)
        words = list(dict.fromkeys(order))
        of = [_test(w, s.mode == "prefix")(F.col("token")) for w in words]
        rows = self.read(_of(words, s.mode), s.mode == "phrase", state)
        counts = [F.sum(F.when(test, F.col("tf")).otherwise(0)).cast("double").alias(f"tf{k}") for k, test in enumerate(of)]
        hits = rows.groupBy("id").agg(*counts, *(_places(words) if s.mode == "phrase" else []))
        lengths = self.read(F.col("token") == "", False, state).select("id", F.col("tf").cast("double").alias("length"))
        every = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg"))
        found = hits.agg(*(F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(words))))
        has = [F.col(f"tf{k}") > 0 for k in range(len(words))]
        if s.mode == "phrase":
            hits = hits.where(_follow(words, order))
        elif s.mode != "any":
            hits = hits.where(reduce(lambda a, b: a & b, has))
        stats = F.struct(F.col("every.n").alias("n"), F.col("every.avg").alias("avg"), *(F.col(f"found.df{k}").alias(f"df{k}") for k in range(len(words))))
        hits = hits.join(lengths, "id").withColumn("every", every.select(F.struct("n", "avg")).scalar()).withColumn("found", found.select(F.struct(*(f"df{k}" for k in range(len(words))))).scalar())
        hits = hits.withColumn("s", stats)
        return _bounded(hits.select("id", (-_bm25([F.col(f"tf{k}") for k in range(len(words))], F.col("length"), F.col("s"))).alias("rank")), s.candidates)

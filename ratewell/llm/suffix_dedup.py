"""Suffix-array dedup with sparse suffix arrays: passages of many words that repeat across documents.

Only suffixes that start at minimiser positions are kept: in any WINDOW + RUN - 1 words there is one, and equal passages
have equal ones. A passage of LEAST words that repeats holds a minimiser with SURE words of the passage after it, so a
suffix whose first SURE words stand nowhere else is dropped at once. The others are sorted by the words that follow
(range partitions over the whole corpus, so that no group of equal suffixes meets in one task), each is compared with
its neighbours, and a match is extended to the left and to the right. A key that range partitions divide is settled by
hashes of the stretches around its suffixes. Minimisers follow one another closely enough for
the matches around them to cover a passage of any length, so a suffix carries a bounded context only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import fresh, key_of, settle, text_of
from ratewell.llm.wordhash import mix, runs, word_hashes

#: Words of a minimiser; positions it is the least of; words of a repeated passage; words that follow each minimiser in one.
RUN, WINDOW, LEAST = 8, 26, 50
SURE = LEAST - WINDOW + 1
#: Words of context on each side, beyond which the next minimiser's context begins.
AROUND = 25
FLUSH = 1 << 19
#: Suffixes of one range, which a task may hold at once where they share a key.
RANGE = 1 << 18


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of minimisers and hashes of the SURE words from each on."""
    if len(h) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = runs(h, RUN)
    low = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    at = np.unique(low.argmin(1) + np.arange(len(low)))
    at = at[at + SURE <= len(h)]
    out = np.full(len(at), SURE, np.uint64)
    for k in [*range(0, SURE - RUN, RUN), SURE - RUN]:  # runs that cover the SURE words
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + g[at + k])
    return at, out


def _first_pass(blocks: int):
    """Anchors by block of the hash. One that a task has met twice is known to repeat and passes on a mark only."""

    def flush(rows: list[np.ndarray], places: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, row, place = key[order], np.concatenate(rows)[order], np.concatenate(places)[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        twice = np.bincount(group)[group] > 1
        block = (((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(block, np.arange(blocks + 1))
        some = [b for b in range(blocks) if ends[b] < ends[b + 1]]
        cut = lambda x, mask: [x[ends[b] : ends[b + 1]][mask[ends[b] : ends[b + 1]]].tobytes() for b in some]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(some, pa.int32()), "rows": cut(row, ~twice), "places": cut(place, ~twice), "keys": cut(key, ~twice),
            "marks": cut(key, twice & new), "known_rows": cut(row, twice), "known_places": cut(place, twice), "known_keys": cut(key, twice),
        }, pa.schema([("block", pa.int32()), *[(n, pa.binary()) for n in _BLOBS]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, places, keys, held = [], [], [], 0
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), batch["text"], strict=True):
                at, key = anchors(word_hashes(text.as_py(), lower=False))
                if len(at):
                    rows.append(np.full(len(at), row, np.int64))
                    places.append(at.astype(np.int32))
                    keys.append(key)
                    held += len(at)
                if held >= FLUSH:
                    yield from flush(rows, places, keys)
                    rows, places, keys, held = [], [], [], 0
        if rows:
            yield from flush(rows, places, keys)

    return run


_BLOBS = ("rows", "places", "keys", "marks", "known_rows", "known_places", "known_keys")


def _repeating(table: pa.Table) -> pa.Table:
    """Of one block: the anchors that stand in two places or more."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
    row, place, key = joined("rows", np.int64), joined("places", np.int32), joined("keys", np.uint64)
    every = np.concatenate([key, joined("marks", np.uint64)])
    _, group, count = np.unique(every, return_inverse=True, return_counts=True)
    again = count[group[: len(key)]] > 1
    out = [np.concatenate([x[again], known]) for x, known in ((row, joined("known_rows", np.int64)), (place, joined("known_places", np.int32)), (key.view(np.int64), joined("known_keys", np.int64)))]
    return pa.table({"row": out[0], "place": out[1], "key": out[2]})


_SUFFIX = "row long, place int, key long, after binary, before binary, start int, stop int"
_SUFFIX_PA = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("key", pa.int64()), ("after", pa.binary()), ("before", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes with their contexts, 32 bits a word, 0 beyond the text.

    Of suffixes of one batch that agree in all of their contexts, across documents, those of two documents go on to be
    sorted; the match is complete, and so its bounds (start, stop) come with it.
    """
    for batch in batches:
        texts, ids, found = batch["text"], batch["row"].to_pylist(), batch["anchors"]
        for begin in range(0, batch.num_rows, 1024):
            rows, places, keys, after, before = [], [], [], [], []
            for k in range(begin, min(begin + 1024, batch.num_rows)):
                h = word_hashes(texts[k].as_py(), lower=False)
                short = np.zeros(len(h) + 2 * AROUND + SURE, np.uint32)
                short[AROUND : AROUND + len(h)] = (mix(h) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                at = np.array([x["place"] for x in found[k].as_py()], np.int64)
                rows.append(np.full(len(at), ids[k], np.int64))
                places.append(at)
                keys.append(np.array([x["key"] for x in found[k].as_py()], np.int64))
                after.append(short[at[:, None] + AROUND + SURE + np.arange(AROUND)])
                before.append(short[at[:, None] + AROUND - 1 - np.arange(AROUND)])
            row, place, key = np.concatenate(rows), np.concatenate(places), np.concatenate(keys)
            after, before = np.concatenate(after), np.concatenate(before)
            whole = np.concatenate([key[:, None].view(np.uint32).reshape(len(key), 2), after, before], 1)
            _, group = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1] * 4}").ravel(), return_inverse=True)
            order = np.lexsort((row, group))
            ends = np.flatnonzero(np.diff(group[order])) if len(group) else order
            least, most = order[np.concatenate([[0], ends + 1])] if len(group) else order, order[np.append(ends, len(group) - 1)] if len(group) else order
            across = (row[least] != row[most])[group]
            left, right = (before != 0).cumprod(1).sum(1), (after != 0).cumprod(1).sum(1)
            done = across & (left + SURE + right >= LEAST)
            goes = ~done | np.isin(np.arange(len(group)), np.concatenate([least, most]))
            pick = lambda x, m: pa.array([v.tobytes() if g else None for v, g in zip(x, m, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(row), pa.array(place.astype(np.int32)), pa.array(key), pick(after.astype(">u4"), goes), pick(before.astype(">u4"), goes),
                pa.array((place - left).astype(np.int32), mask=~done), pa.array((place + SURE + right).astype(np.int32), mask=~done),
            ], schema=_SUFFIX_PA)


_MATCH = "row long, start int, stop int, window long"
_MATCH_PA = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("window", pa.int64())])


def _windows(key: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of the LEAST words that begin a words before each suffix, for a from 0 to AROUND; 0 where the text has fewer."""
    n = len(key)
    out = np.zeros((n, AROUND + 1), np.uint64)
    ahead = np.empty((AROUND + 1, n), np.uint64)
    behind = ahead.copy()
    ahead[0] = behind[0] = mix(key.view(np.uint64))
    for k in range(AROUND):
        ahead[k + 1] = mix(ahead[k] * np.uint64(31) + after[:, k])
        behind[k + 1] = mix(behind[k] * np.uint64(37) + before[:, k])
    left, right = (before != 0).cumprod(1).sum(1), (after != 0).cumprod(1).sum(1)
    for a in range(AROUND + 1):
        whole = mix(behind[a] * np.uint64(41) + ahead[LEAST - SURE - a] + np.uint64(a)) | np.uint64(1)
        out[:, a] = np.where((left >= a) & (right >= LEAST - SURE - a), whole, 0)
    return out


def _matches(row: np.ndarray, place: np.ndarray, key: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bounds (row, start, stop) of matches across rows, in whole groups of equal keys, sorted by what follows.

    A neighbour has the longest match to the right. Where the best match lies further left, another suffix of the group
    may be the partner; so in groups with suffixes that are not matched in all of their contexts, those with an equal
    stretch of LEAST words around them are matched as well.
    """
    n = len(row)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
    at = np.flatnonzero(new)
    run_of = np.cumsum(new) - 1
    shared = lambda x, y: ((x == y) & (x != 0)).cumprod(1).sum(1)
    room_left, room_right = (before != 0).cumprod(1).sum(1), (after != 0).cumprod(1).sum(1)
    whole = np.zeros(n, bool)
    found = []
    for other in (at[run_of] - 1, np.append(at[1:], n)[run_of]):  # the last suffix of the row before, the first of the one after
        i = np.flatnonzero((other >= 0) & (other < n))
        i = i[(key[i] == key[other[i]]) & (row[i] != row[other[i]])]
        j = other[i]
        left, right = shared(before[i], before[j]), shared(after[i], after[j])
        good = left + SURE + right >= LEAST
        i, j, left, right = i[good], j[good], left[good], right[good]
        whole[i] |= (left == room_left[i]) & (right == room_right[i])
        found += [np.stack([row[k], place[k] - left, place[k] + SURE + right], 1) for k in (i, j)]
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    some = np.flatnonzero((np.bincount(group, ~whole) > 0)[group] & (np.bincount(group) > 1)[group])
    if len(some):
        windows = _windows(key[some], before[some], after[some])
        match = np.zeros((len(some), AROUND + 2), bool)
        for a in range(AROUND + 1):
            order = np.flatnonzero(windows[:, a])
            if not len(order):
                continue
            order = order[np.argsort(windows[order, a], kind="stable")]
            w, r = windows[order, a], row[some[order]]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            across = np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)
            match[order, a] = np.repeat(across, np.diff(np.append(first, len(w))))
        begins = match & ~np.concatenate([np.zeros((len(some), 1), bool), match[:, :-1]], 1)
        ends = match[:, :-1] & ~match[:, 1:]
        who, least = np.nonzero(begins)
        most = np.nonzero(ends)[1]
        found.append(np.stack([row[some[who]], place[some[who]] - most, place[some[who]] - least + LEAST], 1))
    return np.unique(np.concatenate(found), axis=0)


def _to_tell(windows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which stretches other tasks must know of: all where one row has them, else one of the least and of the greatest row."""
    some = np.flatnonzero(windows)
    some = some[np.lexsort((rows[some], windows[some]))]
    if not len(some):
        return some
    new = windows[some[1:]] != windows[some[:-1]]
    first, last = np.append(True, new), np.append(new, True)
    one = (rows[some[first]] == rows[some[last]])[np.cumsum(first) - 1]
    return some[one | first | last]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes in; bounds of their matches out.

    The suffixes of the first and the last key may have more of their group in other tasks: the hashes of the stretches
    around them (window) go out too, to be counted across tasks.
    """

    def arrays(t: pa.Table) -> list[np.ndarray]:
        wide = lambda c: np.frombuffer(b"".join(t[c].to_pylist()), ">u4").astype(np.uint32).reshape(t.num_rows, AROUND)
        return [*(t[c].to_numpy() for c in ("row", "place", "key")), wide("before"), wide("after")]

    def told(table: pa.Table, edges: tuple[int | None, ...]) -> Iterator[pa.RecordBatch]:
        row, place, key, before, after = arrays(table)
        bounds = _matches(row, place.astype(np.int64), key, before, after)
        yield pa.RecordBatch.from_arrays([pa.array(bounds[:, 0]), pa.array(bounds[:, 1].astype(np.int32)), pa.array(bounds[:, 2].astype(np.int32)), pa.nulls(len(bounds), pa.int64())], schema=_MATCH_PA)
        for k in {e for e in edges if e is not None}:
            at = np.flatnonzero(key == k)
            if not len(at):
                continue
            windows = _windows(key[at], before[at], after[at])
            # no suffix has more words after it in common with any other than with its neighbour in the order
            near = ((after[at[1:]] == after[at[:-1]]) & (after[at[1:]] != 0)).cumprod(1).sum(1)
            reach = np.maximum(np.append(near, AROUND), np.append(AROUND, near))
            windows[(LEAST - SURE - np.arange(AROUND + 1))[None, :] > reach[:, None]] = 0
            # of a stretch that rows share here, whose matches are told above, the least and the greatest row go on for
            # the other tasks; one of a single row has all of its places yet to be told
            who, a = np.divmod(_to_tell(windows.ravel(), np.repeat(row[at], AROUND + 1)), AROUND + 1)
            yield pa.RecordBatch.from_arrays([pa.array(row[at[who]]), pa.array((place[at[who]] - a).astype(np.int32)), pa.array((place[at[who]] - a + LEAST).astype(np.int32)), pa.array(windows[who, a].view(np.int64))], schema=_MATCH_PA)

    held, first = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch["key"].to_numpy()
        first = int(key[0]) if first is None else first
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        open_key = int(held[-1]["key"][-1].as_py()) if held else None
        if held and open_key != int(key[0]):
            yield from told(pa.Table.from_batches(held), (first,))
            held = []
        if cut:
            yield from told(pa.Table.from_batches([*held, batch.slice(0, cut)]), (first,))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from told(pa.Table.from_batches(held), (first, int(held[-1]["key"][-1].as_py())))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row, the union of its bounds as stretches that neither overlap nor touch."""
    for batch in batches:
        rows, starts, stops = [], [], []
        for row, bounds in zip(batch["row"].to_pylist(), batch["bounds"].to_pylist(), strict=True):
            a = np.array([(b["start"], b["stop"]) for b in bounds], np.int64)
            a = a[np.lexsort((a[:, 1], a[:, 0]))]
            reach = np.maximum.accumulate(a[:, 1])
            new = np.concatenate([[True], a[1:, 0] > reach[:-1]])
            at = np.flatnonzero(new)
            starts += a[at, 0].tolist()
            stops += reach[np.append(at[1:] - 1, len(a) - 1)].tolist()
            rows += [row] * len(at)
        yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "start_word": pa.array(starts, pa.int64()), "end_word": pa.array(stops, pa.int64())})


def repeats(docs: DataFrame) -> DataFrame:
    """Passages of 50 words or more that another row of docs has too: doc_id, start_word, end_word (exclusive), n_words.

    Words count from 0; they are compared as written. A document's passages
    neither overlap nor touch. Repeats within one text alone are not
    reported. Shorter, empty and null texts have no passages. Rows with equal doc_id are different documents, and so are
    equal texts; a null doc_id is kept. An empty table gives no rows. Other columns of docs are not read.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, round(chars / 120 / FLUSH))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of("doc_id").alias("doc_key"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return _found(texts, blocks)


def _found(texts: DataFrame, blocks: int) -> DataFrame:
    rows = texts.select("doc_id", "doc_key", "text_hash", F.monotonically_increasing_id().alias("row"), "text")
    first = settle(rows.select("row", "doc_id", "doc_key", "text_hash", "text").mapInArrow(_with_ids(_first_pass(blocks)), "row long, doc_id long, doc_key string, text_hash long, block int, " + ", ".join(f"{n} binary" for n in _BLOBS)), "anchors")
    ids = first.where("row IS NOT NULL").select("row", "doc_id", "doc_key", "text_hash")
    again = settle(first.where("block IS NOT NULL").select("block", *_BLOBS).groupBy("block").applyInArrow(_repeating, "row long, place int, key long"), "repeating")
    per_row = again.groupBy("row").agg(F.collect_list(F.struct("place", "key")).alias("anchors")).join(ids.select("row", "doc_key", "text_hash"), "row")
    # one text for rows that are equal in id and text; a merge join at every size: neither side has a bound that would allow a broadcast
    with_text = texts.groupBy("doc_key", "text_hash").agg(F.first("text").alias("text")).join(per_row.hint("merge"), ["doc_key", "text_hash"]).select("row", "text", "anchors")
    suffixes = settle(with_text.mapInArrow(_suffixes, _SUFFIX), "suffixes")
    goes = suffixes.where("after IS NOT NULL").select("row", "place", "key", "after", "before")
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), goes.count() // RANGE)
    order = ["key", "after", "before", "row", "place"]
    sorted_ = goes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    matched = settle(sorted_.mapInArrow(_neighbours, _MATCH), "matches")
    edges = matched.where("window IS NOT NULL")
    across = edges.groupBy("window").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least <> most")
    bounds = (
        suffixes.where("start IS NOT NULL").select("row", "start", "stop")
        .union(matched.where("window IS NULL").select("row", "start", "stop"))
        .union(edges.join(across.select("window"), "window").select("row", "start", "stop"))
    )
    merged = bounds.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("bounds")).mapInArrow(_merged, "row long, start_word long, end_word long")
    return merged.join(ids.select("row", "doc_id"), "row").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def _with_ids(inner):
    """The inner pass, with the ids of the rows beside it, so that texts are read once."""
    names = ["row", "doc_id", "doc_key", "text_hash", "block", *_BLOBS]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * len(_BLOBS)]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waiting.append(batch)
                yield batch

        def ids() -> Iterator[pa.RecordBatch]:
            while waiting:
                b = waiting.pop()
                yield pa.RecordBatch.from_arrays([*[b[n] for n in names[:4]], *[pa.nulls(b.num_rows, k) for k in kinds[4:]]], schema=schema)

        for out in inner(seen()):
            yield from ids()
            yield pa.RecordBatch.from_arrays([*[pa.nulls(out.num_rows, k) for k in kinds[:4]], *out.columns], schema=schema)
        yield from ids()

    return run


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the words of the spans (doc_id, start_word, end_word) taken out of their texts; other columns stay.

    Texts with a span are left with single spaces between words; all others are as they were. Null ids and null texts
    have no spans; rows with equal doc_id lose the same words. Columns of any name keep their values.
    """
    key, found = fresh(docs, "span_id"), fresh(docs, "spans")
    per_doc = spans.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(found))
    words = F.array_remove(F.split(text_of(), r"[\x20\x09-\x0D]+"), "")
    kept = F.filter(words, lambda _, i: ~F.exists(found, lambda s: (i >= s["start_word"]) & (i < s["end_word"])))
    joined = docs.join(per_doc, docs["doc_id"] == F.col(key), "left")
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(kept, " "))
    return joined.select(*[text.alias(n) if n.lower() == "text" else F.col(f"`{n}`") for n in docs.columns])

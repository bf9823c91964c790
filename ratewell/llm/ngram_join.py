"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct n-gram sets, columns the n-grams. Columns are dealt to blocks by their hash; a block
counts how many rows each column has, and a column of one row is discarded, as it adds to no overlap. A row of size n has
overlaps of percent of n or more with its partners, so a row with fewer columns left than that has no partners and is
discarded whole. Columns of the rows that remain are ordered by how many rows they have. Linked rows share one of the
first columns in this order, as the columns after these are too few for the bound; rows that share one form clusters.
In a cluster the product is accumulated over column blocks, exactly, and pairs fall out as soon as the columns left
cannot lift them over the bound that their sizes give.

No pairs are emitted: a column gives a star around one of its rows. A column that many rows of one chunk have is hot: it
is told to its block once a chunk, counts as one of many rows everywhere, and its entries go straight to their rows.
Clusters larger than a product block are cut into row blocks: first each block against itself and one other. Rows that
share a first column with a row that they are still apart from are then compared, column by column, by parity sketches,
which lose no link; those that come close form new clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import fresh, key_of, settle, text_of
from ratewell.llm.components import components
from ratewell.llm.wordhash import mix, shingle_set

#: Rows of a product block, its n-grams, and its columns at a time: they bound a task's memory.
BLOCK_ROWS, BLOCK_GRAMS, BLOCK_COLUMNS = 2048, 1 << 21, 4096
#: A column with this many rows of a product block or more is multiplied as a dense one.
DENSE_ROWS = 128
#: N-grams that a task gathers before it passes them on, about those of a column block, and the rows of one chunk that make a column hot.
CHUNK_GRAMS, COLUMN_BLOCK_GRAMS, HOT_ROWS = 1 << 19, 1 << 21, 8
#: Keys of sets that a task remembers, so that copies are passed on once.
SEEN = 1 << 18
#: The class of hot columns, the last in the order.
HOT = 255

_DOCS = [("row", pa.int64()), ("doc_id", pa.int64()), ("doc_key", pa.string()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64())]
_ENTRIES = pa.schema([("block", pa.int32()), *_DOCS, *[(n, pa.binary()) for n in ("ids", "sizes", "counts", "grams", "hot")]])
_SHARED = pa.schema([("block", pa.int32()), *_DOCS, *[(n, pa.binary()) for n in ("ids", "sizes", "counts", "columns", "classes")]])
_ROWS = pa.schema([*_DOCS, ("size", pa.int64()), ("alone", pa.int64()), ("prefix", pa.list_(pa.int64())), ("columns", pa.binary())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _filled(schema: pa.Schema, columns: dict, n: int) -> list[pa.Array]:
    """Arrays for all fields of a schema, null where columns has none."""
    return [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for each hash, by its upper bits."""
    return (((x.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _column(gram: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The name of a column: 48 bits of its hash and those of its block."""
    return gram & np.uint64((1 << 48) - 1) | block.astype(np.uint64) << np.uint64(48)


def _six(gram: np.ndarray) -> bytes:
    return np.ascontiguousarray(gram).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def set_id(grams: np.ndarray) -> int:
    """A 64-bit name for a set of hashes."""
    key = np.array([len(grams), grams.sum(dtype=np.uint64), mix(grams).sum(dtype=np.uint64)], np.uint64)
    return int(mix(mix(mix(key[:1]) + key[1:2]) + key[2:]).view(np.int64)[0])


def _cells(ids: list[int], sets: list[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    """A chunk of sets as entries by column block, and those of its hot columns, with the sets' sizes, by set."""
    ids, size = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64)
    gram, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    block = _part(gram, blocks)
    order = np.argsort(gram, kind="stable")
    times = _lengths(_starts(gram[order]), len(gram))
    hot = np.empty(len(gram), bool)
    hot[order] = np.repeat(times >= HOT_ROWS, times)

    told = np.unique(gram[hot])
    plain = np.flatnonzero(~hot)
    plain = plain[np.argsort(block[plain].astype(np.uint16) if blocks <= 1 << 16 else block[plain], kind="stable")]
    run = _starts(block[plain], own[plain])
    cell_block, cell_ids, cell_counts = block[plain][run], ids[own[plain][run]], _lengths(run, len(plain)).astype(np.int32)
    bound = np.arange(blocks + 1)
    cell_at, gram_at, told_at = np.searchsorted(cell_block, bound), np.searchsorted(block[plain], bound), np.searchsorted(_part(told, blocks), bound)
    gram_of = gram[plain]
    some = [b for b in range(blocks) if cell_at[b] < cell_at[b + 1] or told_at[b] < told_at[b + 1]]
    cut = lambda x, at, b: x[at[b] : at[b + 1]]
    entries = {
        "block": some, "ids": [cut(cell_ids, cell_at, b).tobytes() for b in some], "counts": [cut(cell_counts, cell_at, b).tobytes() for b in some],
        "grams": [_six(cut(gram_of, gram_at, b)) for b in some], "hot": [_six(cut(told, told_at, b)) for b in some],
    }
    yield pa.RecordBatch.from_arrays(_filled(_ENTRIES, entries, len(some)), schema=_ENTRIES)

    to = _part(ids, blocks)
    by = np.argsort(to, kind="stable")
    counts = np.bincount(own[hot], minlength=len(sets)).astype(np.int32)
    set_at = np.searchsorted(to[by], bound)
    some = [b for b in range(blocks) if set_at[b] < set_at[b + 1]]
    of_set = np.append(0, np.cumsum(counts))
    columns = _column(gram[hot], block[hot])
    own_columns = lambda b: np.concatenate([columns[of_set[k] : of_set[k + 1]] for k in cut(by, set_at, b)])
    direct = {
        "block": some, "ids": [ids[cut(by, set_at, b)].tobytes() for b in some], "sizes": [size[cut(by, set_at, b)].tobytes() for b in some],
        "counts": [counts[cut(by, set_at, b)].tobytes() for b in some], "grams": [own_columns(b).tobytes() for b in some],
    }
    yield pa.RecordBatch.from_arrays(_filled(_ENTRIES, direct, len(some)), schema=_ENTRIES)


def _first_pass(words: int, blocks: int):
    """Per document its set's size and name, and the entries of sets that the task has not passed on before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held, seen = [], [], 0, set()
        for batch in batches:
            size, names = [], []
            for text in batch["text"]:
                grams = shingle_set(text.as_py(), words)
                size.append(len(grams))
                names.append(set_id(grams))
                if len(grams) and names[-1] not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(names[-1])
                    ids.append(names[-1])
                    sets.append(grams)
                    held += len(grams)
                    if held >= CHUNK_GRAMS:
                        yield from _cells(ids, sets, blocks)
                        ids, sets, held = [], [], 0
            docs = {n: batch[n] for n in ("row", "doc_id", "doc_key", "text_hash")} | {"n_shingles": size, "set_id": names, "block": batch["row"].to_numpy() % blocks}
            yield pa.RecordBatch.from_arrays(_filled(_ENTRIES, docs, batch.num_rows), schema=_ENTRIES)
        if ids:
            yield from _cells(ids, sets, blocks)

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()] or [np.zeros(0, kind)])


def _count_columns(blocks: int):
    """Of one column block the entries of columns that two rows or more have, by set; what is no such entry as it came."""

    def run(table: pa.Table) -> pa.Table:
        is_cell = pc.and_(pc.is_null(table["row"]), pc.is_null(table["sizes"]))
        rest, cells = table.filter(pc.invert(is_cell)), table.filter(is_cell)
        passed = pa.Table.from_arrays([rest[n] if n in rest.column_names else rest["grams"] if n == "columns" else pa.nulls(len(rest), pa.binary()) for n in _SHARED.names], schema=_SHARED)
        gram = _from_six(_joined(cells, "grams", np.uint8))
        if not len(gram):
            return passed
        own = np.repeat(_joined(cells, "ids", np.int64), _joined(cells, "counts", np.int32))
        hot = np.unique(_from_six(_joined(cells, "hot", np.uint8)))
        order = np.argsort(gram, kind="stable")
        gram, own = gram[order], own[order]
        at = _starts(gram)
        times = _lengths(at, len(gram))
        often = np.isin(gram[at], hot)
        some = np.repeat((times > 1) | often, times)
        gram, own = gram[some], own[some]
        order = np.lexsort((own, gram))
        gram, own = gram[order], own[order]
        once = _starts(gram, own)
        gram, own = gram[once], own[once]
        at = _starts(gram)
        times = _lengths(at, len(gram))
        often = np.isin(gram[at], hot)
        kind = np.where(often, HOT, np.minimum(4 * np.log2(np.maximum(times, 1)), HOT - 1)).astype(np.uint8)
        some = np.repeat((times > 1) | often, times)
        kind, gram, own = np.repeat(kind, times)[some], gram[some], own[some]
        if not len(gram):
            return passed
        columns = _column(gram, np.full(len(gram), cells["block"][0].as_py()))
        to = _part(own, blocks)
        order = np.lexsort((own, to))
        columns, kind, own, to = columns[order], kind[order], own[order], to[order]
        run_at = _starts(to, own)
        counts = _lengths(run_at, len(own)).astype(np.int32)
        bound = np.arange(blocks + 1)
        cell_at, entry_at = np.searchsorted(to[run_at], bound), np.searchsorted(to, bound)
        full = [b for b in range(blocks) if cell_at[b] < cell_at[b + 1]]
        cut = lambda x, where: [x[where[b] : where[b + 1]].tobytes() for b in full]
        shared = {"block": full, "ids": cut(own[run_at], cell_at), "counts": cut(counts, cell_at), "columns": cut(columns, entry_at), "classes": cut(kind, entry_at)}
        return pa.concat_tables([passed, pa.Table.from_arrays(_filled(_SHARED, shared, len(full)), schema=_SHARED)])

    return run


def _assemble(percent: int):
    """Of one part of the sets: its documents, and the rows that have columns enough left for a partner."""

    def run(table: pa.Table) -> pa.Table:
        documents, entries = table.filter(pc.is_valid(table["row"])), table.filter(pc.is_null(table["row"]))
        told = pa.Table.from_arrays([documents[n] if n in documents.column_names and n != "columns" else pa.nulls(len(documents), t) for n, t in zip(_ROWS.names, _ROWS.types, strict=True)], schema=_ROWS)
        direct = entries.filter(pc.is_valid(entries["sizes"]))
        if not len(direct):
            return told
        names, first = np.unique(_joined(direct, "ids", np.int64), return_index=True)
        size = _joined(direct, "sizes", np.int64)[first]
        parts = pa.concat_tables([direct, entries.filter(pc.is_null(entries["sizes"]))])
        column = _joined(parts, "columns", np.uint64)
        own = np.repeat(_joined(parts, "ids", np.int64), _joined(parts, "counts", np.int32))
        kind = np.full(len(own), HOT, np.uint8)
        plain = _joined(parts.slice(len(direct)), "classes", np.uint8)
        kind[len(own) - len(plain) :] = plain
        order = np.lexsort((column, kind, own))
        column, kind, own = column[order], kind[order], own[order]
        once = _starts(own, kind, column)
        column, own = column[once], own[once]
        at = np.searchsorted(own, names)
        shared = np.searchsorted(own, names, "right") - at
        least = -(-percent * size // 100)
        rows = np.flatnonzero(shared >= least)
        named = column.view(np.int64)
        found = {
            "set_id": names[rows], "size": size[rows], "alone": (size - shared)[rows], "prefix": [named[at[k] : at[k] + shared[k] - least[k] + 1] for k in rows],
            "columns": [np.sort(column[at[k] : at[k] + shared[k]]).tobytes() for k in rows],
        }
        return pa.concat_tables([told, pa.Table.from_arrays(_filled(_ROWS, found, len(rows)), schema=_ROWS)])

    return run


def linked_groups(sets: list[np.ndarray], size: np.ndarray, percent: int) -> np.ndarray:
    """For each set the place of the first set that links lead to, by the product over blocks of columns.

    sets: the columns of each row, without those that no other row has; size: how many it has with those.
    """
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if 100 * both >= percent * (int(size.sum()) - both) else 1])
    # 100 * both >= percent * (x + y - both)
    least = -(-percent * (size[:, None] + size[None, :]) // (100 + percent)).astype(np.int32)
    gram, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    times = _lengths(_starts(gram), len(gram))
    owner, times = owner[np.repeat(times > 1, times)], times[times > 1]
    # columns of few rows first, so that what is left for a pair shrinks fast
    rank = np.argsort(times, kind="stable")
    at = np.append(0, np.cumsum(times))
    both = np.zeros((m, m), np.int32)
    left = np.bincount(owner, minlength=m)
    k = 0
    while k < len(rank):
        n = int(times[rank[k]])
        upto = min(np.searchsorted(times[rank], n, "right") if n < DENSE_ROWS else len(rank), k + max(1, min(BLOCK_COLUMNS, (1 << 22) // (n * n) if n < DENSE_ROWS else BLOCK_COLUMNS)))
        chosen = rank[k:upto]
        k = upto
        if n < DENSE_ROWS:
            own = owner[at[chosen][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            both += np.bincount((np.minimum(own[:, i], own[:, j]) * m + np.maximum(own[:, i], own[:, j])).ravel(), minlength=m * m).reshape(m, m)
            left = left - np.bincount(own.ravel(), minlength=m)
            continue
        sofar = both + both.T
        hope = sofar + np.minimum(left[:, None], left[None, :]) >= least
        np.fill_diagonal(hope, False)
        open_ = hope.any(1)
        own = owner[np.concatenate([np.arange(at[c], at[c + 1]) for c in chosen])]
        column = np.repeat(np.arange(len(chosen)), times[chosen])
        left = left - np.bincount(own, minlength=m)
        place = np.cumsum(open_) - 1
        own, column = place[own[open_[own]]], column[open_[own]]
        if len(own):
            dense = np.zeros((int(open_.sum()), len(chosen)), np.float32)
            dense[own, column] = 1
            both[np.ix_(open_, open_)] += np.triu(dense @ dense.T, 1).astype(np.int32)
    links = both + both.T >= least
    np.fill_diagonal(links, False)
    group = np.full(m, -1)
    for i in range(m):
        if group[i] < 0:
            group[i], front = i, [i]
            while front:
                reached = links[front].any(0) & (group < 0)
                group[reached] = i
                front = np.flatnonzero(reached).tolist()
    return group


def _products(percent: int):
    """Rows sorted by task in, for each task the pairs (row, first row of its group) out."""

    def close(rows: list[int], sets: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        row = np.array(rows, np.int64)
        root = row[linked_groups(sets, np.array(sizes, np.int64), percent)] if len(rows) > 1 else row
        return row[root != row], root[root != row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, sets, sizes = None, [], [], []
        for batch in batches:
            a, b = [], []
            for now, row, size, columns in zip(*(batch[c].to_pylist() for c in ("task", "row", "size")), batch["columns"], strict=True):
                if now != task:
                    for out, x in zip((a, b), close(rows, sets, sizes), strict=True):
                        out.append(x)
                    task, rows, sets, sizes = now, [], [], []
                if not rows or rows[-1] != row:
                    rows.append(row)
                    sets.append(np.frombuffer(columns.as_buffer(), np.uint64))
                    sizes.append(size)
            yield pa.RecordBatch.from_pydict({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})
        x, y = close(rows, sets, sizes)
        yield pa.RecordBatch.from_pydict({"a": x, "b": y})

    return run


def _compared(rows: DataFrame, tasks: DataFrame, percent: int) -> DataFrame:
    """Links found by the product of each task's rows. tasks: row and tasks, the names of its tasks."""
    parts = max(1, int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = rows.join(tasks.hint("merge"), "row").select(F.explode("tasks").alias("task"), "row", "size", "columns")
    dealt = each.repartition(parts, "task").sortWithinPartitions("task", "row")
    return settle(dealt.mapInArrow(_products(percent), "a long, b long"), "links")


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (distinct runs of words) and component_id.

    Two rows link when their sets share percent of 100 of their union or more; component_id is the least doc_id that
    links lead to. A-Z count as a-z. A text of fewer words is one shingle; a null or empty text has none and links with
    nothing. Rows with equal doc_id stay rows of their own; a null doc_id counts only where nothing else is in reach.
    An empty table gives no rows. Other columns of docs are not read. Words, shingles and sets are compared by 64-bit
    hashes, a shingle's column by 48 bits besides those of its block.
    """
    placed, roots = _placed(docs, words, percent)
    sets = placed.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    rooted = sets.join(roots.hint("merge"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).where("n > 1")
    found = settle(rooted.select("set_id", "root").join(groups.hint("merge"), "root").select("set_id", "component_id", F.lit(True).alias("_in")), "groups")
    return placed.join(found.hint("merge"), "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _placed(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per row of docs: row, doc_id, doc_key, text_hash, n_shingles, set_id; and of each set that is linked to one of a smaller name set_id and root."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, round(chars / 6 / COLUMN_BLOCK_GRAMS))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key_of("doc_id").alias("doc_key"),
        F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"),
    )
    entries = rows.mapInArrow(_first_pass(words, blocks), _ddl(_ENTRIES))
    shared = entries.groupBy("block").applyInArrow(_count_columns(blocks), _ddl(_SHARED))
    assembled = settle(shared.groupBy("block").applyInArrow(_assemble(percent), _ddl(_ROWS)), "rows")
    placed = assembled.where("row IS NOT NULL").select(*[n for n, _ in _DOCS])
    sparse = assembled.where("row IS NULL").select(F.col("set_id").alias("row"), "size", "alone", "prefix", "columns")

    # a column's star stands around the row with the fewest columns of its own
    first = sparse.select("row", "alone", F.explode("prefix").alias("column"))
    centre = first.groupBy("column").agg(F.min(F.struct("alone", "row")).alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = settle(first.join(centre, "column").where("row <> centre.row").select(F.col("row").alias("a"), F.col("centre.row").alias("b")).distinct(), "near")
    clusters = _clusters(components(near))

    members = settle(sparse.select("row", "size").join(clusters.hint("merge"), "row"), "members")
    sums = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    cut = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    cuts = members.join(sums.select("cluster", cut.alias("cuts")), "cluster")
    blocked = settle(cuts.select("row", "cluster", "cuts", F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int").alias("block")), "blocked")
    # each block with itself and with block 0, which goes to all
    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("block"))
    stored = sparse.select("row", "size", "columns")
    links = _compared(stored, blocked.select("row", F.transform(to, lambda b: F.concat_ws(":", "cluster", b)).alias("tasks")), percent)
    roots = components(links)

    cutting = blocked.where("cuts > 1")
    if cutting.limit(1).count() and (rest := _rest(cutting, roots, first, stored, percent)).limit(1).count():
        roots = components(links.union(_compared(stored, rest, percent)))
    return placed, roots.select(F.col("node").alias("set_id"), "root")


def _clusters(found: DataFrame) -> DataFrame:
    """row and cluster of every row that is held together with another."""
    return found.union(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("row"), F.col("root").alias("cluster"))


#: Bits of a parity sketch at least and at most, twice a set's size between, and how many are multiplied at a time.
SKETCH_LEAST, SKETCH_MOST, SKETCH_AT_ONCE = 256, 1 << 16, 4096


def sketch(columns: np.ndarray) -> bytes:
    """For each of a power of two of cells whether an odd number of the columns fall into it.

    Two sketches differ in no more cells than their sets in columns, which bounds the overlap from above. One is halved
    by taking its halves' differences.
    """
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << (2 * max(1, len(columns)) - 1).bit_length()))
    odd = np.bincount((mix(columns) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _signed(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches of `bits` cells, or so many times 2, 4 and on, as rows of 1 and -1."""
    out = np.empty((len(sketches), bits), np.float32)
    for k, raw in enumerate(sketches):
        odd = np.unpackbits(np.frombuffer(raw, np.uint8))
        if len(odd) > bits:
            odd = odd.reshape(-1, bits).sum(0) & 1
        out[k] = 1 - 2.0 * odd
    return out


def candidate_groups(sketches: list[bytes], held: np.ndarray, size: np.ndarray, part: np.ndarray, percent: int) -> np.ndarray:
    """For each row the place of the first row that candidates lead to: of different parts, and close enough by their sketches."""
    m = len(sketches)
    least = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
    close = np.zeros((m, m), bool)
    bits = np.array([len(s) * 8 for s in sketches])
    for b in np.unique(bits):
        # the larger of two linked sets has at most 100 / percent times the columns, and a sketch under twice that
        own, near = np.flatnonzero(bits == b), np.flatnonzero((bits >= b) & ((bits == b) | (bits * percent < 200 * b)))
        x, y = _signed([sketches[k] for k in own], b), _signed([sketches[k] for k in near], b)
        same = sum(x[:, at : at + SKETCH_AT_ONCE] @ y[:, at : at + SKETCH_AT_ONCE].T for at in range(0, b, SKETCH_AT_ONCE))
        apart = (b - same) / 2
        most = (held[own][:, None] + held[near][None, :] - apart) / 2
        close[np.ix_(own, near)] = most >= least[np.ix_(own, near)]
    close |= close.T
    close &= part[:, None] != part[None, :]
    group = np.full(m, -1)
    for i in range(m):
        if group[i] < 0:
            group[i], front = i, [i]
            while front:
                reached = close[front].any(0) & (group < 0)
                group[reached] = i
                front = np.flatnonzero(reached).tolist()
    return group


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["columns"]]
        yield pa.RecordBatch.from_pydict({"row": batch["row"], "part": batch["part"], "size": batch["size"], "held": np.array([len(c) for c in columns], np.int64), "sketch": pa.array([sketch(c) for c in columns], pa.binary())})


def _candidate_edges(percent: int):
    """Rows with sketches sorted by task in, for each task the pairs (row, first row of its candidates) out."""

    def close(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        row = np.array([r[0] for r in rows], np.int64)
        if len(rows) < 2:
            return row[:0], row[:0]
        part, size, held = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        root = row[candidate_groups([r[4] for r in rows], held, size, part, percent)]
        return row[root != row], root[root != row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            out = []
            for now, *own in zip(*(batch[c].to_pylist() for c in ("task", "row", "part", "size", "held", "sketch")), strict=True):
                if now != task:
                    out.append(close(rows))
                    task, rows = now, []
                if not rows or rows[-1][0] != own[0]:
                    rows.append(tuple(own))
            yield pa.RecordBatch.from_pydict({k: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i, k in enumerate(("a", "b"))})
        x, y = close(rows)
        yield pa.RecordBatch.from_pydict({"a": x, "b": y})

    return run


def _candidates(parted: DataFrame, of_column: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that hold together rows of different parts that share a column and may be linked by their sketches.

    A task is a column; of columns with the same rows one is taken, and one of many rows is cut into pairs of blocks. Only
    sketches travel, to each column of a row.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "row"), 20)).alias("s")).alias("mark")
    marks = of_column.groupBy("column").agg(mark).groupBy("mark").agg(F.min("column").alias("column"))
    marks = settle(marks.select("column", F.ceil(F.col("mark.n") / BLOCK_ROWS).cast("int").alias("blocks")), "columns")
    sketches = settle(parted.join(stored.hint("merge"), "row").select("row", "part", "size", "columns").mapInArrow(_sketched, "row long, part long, size long, held long, sketch binary"), "sketches")
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(":", "column", F.least(own, j), F.greatest(own, j)))
    each = of_column.join(marks.hint("merge"), "column").select("row", F.explode(tasks).alias("task")).join(sketches.hint("merge"), "row")
    parts = max(1, int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = each.repartition(parts, "task").sortWithinPartitions("task", "row")
    return settle(dealt.mapInArrow(_candidate_edges(percent), "a long, b long").distinct(), "candidates")


def _rest(cutting: DataFrame, roots: DataFrame, first: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Tasks for the rows of large clusters that may be linked with a row from which the first round left them apart.

    Rows that share a first column, are in different parts and are close by their sketches form new clusters. Of such a
    cluster the largest part need not be compared with itself: its blocks meet those of all other rows, which also meet
    each other.
    """
    part = roots.select(F.col("node").alias("row"), F.col("root").alias("part"))
    placed = settle(cutting.select("row").join(part.hint("merge"), "row", "left").withColumn("part", F.coalesce("part", "row")), "parts")
    of_column = settle(first.select("row", "column").join(placed.hint("merge"), "row"), "of_column")
    mixed = of_column.groupBy("column").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("column")
    of_column = settle(of_column.join(mixed.hint("merge"), "column").select("row", "column"), "mixed")
    candidates = _candidates(placed.join(of_column.select("row").distinct().hint("merge"), "row"), of_column, stored, percent)
    clusters = _clusters(components(candidates.select("a", "b")))
    placed = settle(placed.join(clusters.hint("merge"), "row").join(stored.select("row", "size").hint("merge"), "row"), "close")
    parts = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    # both kinds of blocks hold half of what a product block may
    blocks = lambda n, grams: F.greatest(F.lit(1), F.ceil(n * 2 / BLOCK_ROWS), F.ceil(grams * 2 / BLOCK_GRAMS)).cast("int")
    shape = parts.groupBy("cluster").agg(F.max(F.struct("n", "part", "grams")).alias("top"), F.sum("n").alias("all"), F.sum("grams").alias("grams"))
    top = F.col("top")
    shape = shape.select("cluster", top["part"].alias("top"), blocks(top["n"], top["grams"]).alias("tops"), blocks(F.col("all") - top["n"], F.col("grams") - top["grams"]).alias("others"))
    side = placed.join(shape, "cluster").withColumn("is_top", F.col("part") == F.col("top"))
    own = F.pmod(F.xxhash64("row", F.lit(7)), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
    name = lambda kind, i, j: F.concat_ws(":", "cluster", F.lit(kind), i, j)
    each = lambda n, body: F.transform(F.sequence(F.lit(0), F.col(n) - 1), body)
    with_tops = F.when(F.col("is_top"), each("others", lambda j: name("t", F.col("own"), j))).otherwise(each("tops", lambda i: name("t", i, F.col("own"))))
    among = F.when(F.col("is_top") | (F.col("others") * F.col("tops") == 1), F.array().cast("array<string>")).otherwise(each("others", lambda j: name("o", F.least(j, F.col("own")), F.greatest(j, F.col("own")))))
    return settle(side.withColumn("own", own).select("row", F.concat(with_tops, among).alias("tasks")), "rest")


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of docs that links hold together one row, with all its columns.

    That is the row with the least doc_id, null last, and of these the least text hash; of rows equal in both the first
    by their other columns. Rows without words are in no group and stay. An empty table gives no rows.
    """
    keys = ["doc_key", "text_hash"]
    found, roots = _placed(docs, words, percent)
    placed = settle(found.where("n_shingles > 0").join(roots.hint("merge"), "set_id", "left").select(F.coalesce("root", "set_id").alias("root"), "doc_id", *keys), "placed")
    first = settle(placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *keys)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    stays = (F.col("doc_key") == F.col("first.doc_key")) & (F.col("text_hash") == F.col("first.text_hash"))
    fates = settle(placed.join(first.hint("merge"), "root").groupBy(*keys).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1"), "fates")
    on = [fresh(docs, "key"), fresh(docs, "hash")]
    named = lambda rows: rows.select(F.col("doc_key").alias(on[0]), F.col("text_hash").alias(on[1])).hint("merge")
    # a merge join at every size: the table of fates grows with docs
    keyed = docs.withColumns({on[0]: key_of("doc_id"), on[1]: F.xxhash64(text_of())})
    every = [F.col(f"`{c}`") for c in docs.columns]
    rest = keyed.join(named(fates), on, "left_anti").select(*every)
    if not fates.where("stays").limit(1).count():
        return rest
    # rows that are equal in id and text, of which the first by the other columns stays
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")], F.lit(0)))
    once = keyed.join(named(fates.where("stays")), on).groupBy(*on).agg(F.min_by(F.struct(*every), others).alias("first"))
    return rest.union(once.select("first.*"))

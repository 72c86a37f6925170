"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

1. Every text gets its set of distinct word shingles and a signature of COORDINATES minima.
   Texts with equal sets (128-bit hash and size) are one class; only classes are compared.
2. Classes are posted under each (coordinate, value) and values counted.  Two signatures that
   agree in MATCHES coordinates or more must meet in the rarest COORDINATES - MATCHES + 1 of
   either, so only these prefixes are kept.  A value that occurs once meets nobody: it takes
   its place in the prefix without being posted.
3. Skip merging: under each value the classes are first compared with two pivots, not with
   each other.  Confirmed links make components; after that only pairs of different
   components that share a value are left, and values whose classes are all in one component
   are skipped.  So a group of n near copies costs about n comparisons, not n * n / 2.
4. A pair is a candidate when the signatures agree in MATCHES coordinates or more, and a link
   when the full sets are similar enough: 100 * intersection >= percent * union.

With 48 coordinates and 24 matches a pair of similarity 0.8 is missed with probability
under 1e-6, and a component only if all its paths are.  No list of values, partners or
candidates is cut.  Signatures of the posted classes and sets of the classes that are in a
candidate lie in the shared folder and are memory-mapped by the tasks that compare them, so
what merely shares a value with others has no set written.

Words are runs of bytes other than space and 0x09-0x0D with A-Z lowered.  A text of fewer
words than a shingle is one shingle; null texts and texts without words have no shingle and
are linked with nothing.  Repeated rows are equal texts.  An empty table gives an empty
result.  Other columns are not read, or carried along where rows are dropped.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import checked_broadcast, load_array, new_folder, save_array, settled, unused
from .words import U64, hashed_words, mixed, ngrams, sliced

WIDTH = 5
PERCENT = 80
COORDINATES = 48
MATCHES = 24
PREFIX = COORDINATES - MATCHES + 1
STORE = 1 << 20
SLICE = 1 << 20  # bytes of text whose words and shingles a task holds at a time
CHUNK = 512
CELL = 4096
HEADS = 256
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**62, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, and where each text's begin."""
    words = hashed_words(texts, lower=True)
    hashes, at = ngrams(words, width)
    text = words.text_of_word()[at] if len(at) else np.empty(0, np.int64)
    counts = words.counts()
    for n in range(1, width):  # shorter texts are one shingle
        few = np.flatnonzero(counts == n)
        if len(few):
            whole = mixed(sum(mixed(words.hashes[words.first[few] + k] + U64(k)) for k in range(n)) + U64(n))
            hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, few])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def _set_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((2, len(first) - 1), np.int64)
    for k, values in enumerate((hashes, mixed(hashes ^ U64(0x8BB84B93962EACC9)))):
        if len(full):
            out[k, full] = mixed(np.add.reduceat(values, first[full])).view(np.int64)
    return out[0], out[1]


def _signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COORDINATES minima (upper 32 bits) per text; zeros where it has no shingle."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, COORDINATES), np.uint32)
    if len(full):
        starts = first[full]
        for k, factor in enumerate(_FACTORS):
            out[full, k] = (np.minimum.reduceat(hashes * factor, starts) >> U64(32)).astype(np.uint32)
    return out


def signed(df: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """Per row: id, n_shingles, two hashes of the set, signature."""
    schema = T.StructType([
        T.StructField(id, df.schema[id].dataType), T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("signature", T.BinaryType()),
    ])

    def sign(batches):
        for batch in sliced(batches, SLICE):
            hashes, first = shingles(batch.column(1), width)
            a, b = _set_hashes(hashes, first)
            signatures = _signatures(hashes, first)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(first)), pa.array(a), pa.array(b),
                pa.array([x.tobytes() for x in signatures], pa.binary()),
            ], names=schema.fieldNames())

    return df.select(id, text).mapInArrow(sign, schema)


def _postings(classes: DataFrame) -> DataFrame:
    """Rows (key, node): the upper half of a key is the coordinate, the lower its value."""

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                keys = values.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)
                node = np.repeat(batch.column(0).to_numpy(), COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(post, "key long, node long")


def _prefixes(classes: DataFrame) -> DataFrame:
    """The postings of each class's rarest values, without values that occur once."""
    posted = _postings(classes)
    common = settled(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "values")
    met = posted.join(common, "key")
    of_node = Window.partitionBy("node")
    ranked = met.withColumn("place", F.row_number().over(of_node.orderBy("n", "key"))).withColumn("posted", F.count("*").over(of_node))
    kept = ranked.where(F.col("place") + (COORDINATES - F.col("posted")) <= PREFIX).select("key", "node")
    return settled(kept, "prefixes")


def _pivot_pairs(posted: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with the two pivots of each value."""
    order = F.struct(F.xxhash64("node").alias("h"), "node")
    pivots = posted.groupBy("key").agg(F.min(order).alias("p"), F.max(order).alias("q"), F.count("*").alias("n")).where("n > 1")
    pivots = settled(pivots.select("key", F.array("p.node", "q.node").alias("pivots")), "pivots")
    met = posted.join(pivots, "key").select("node", F.explode("pivots").alias("pivot")).where("node <> pivot")
    return met.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()


def _stored_signatures(classes: DataFrame, folder: str) -> DataFrame:
    """Write the signatures of classes (node, n_shingles, signature); gives (node, file, start, size).  Size is that of the set."""

    def store(batches):
        held: list[pa.RecordBatch] = []

        def out():
            name = uuid.uuid4().int >> 66
            save_array(folder, str(name), np.frombuffer(b"".join(x for batch in held for x in batch.column(2).to_pylist()), np.uint32))
            n = sum(batch.num_rows for batch in held)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column(0) for batch in held]), pa.array(np.full(n, name, np.int64)),
                pa.array(np.arange(n, dtype=np.int64) * COORDINATES), pa.concat_arrays([batch.column(1) for batch in held]),
            ], names=["node", "file", "start", "size"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) * COORDINATES >= STORE:
                yield out()
                held = []
        if held:
            yield out()

    found = classes.select("node", "n_shingles", "signature").mapInArrow(store, "node long, file long, start long, size long")
    return settled(found, "signatures")


def _stored_sets(df: DataFrame, wanted: DataFrame, id: str, text: str, width: int, folder: str) -> DataFrame:
    """Write the sets of the wanted classes (id, node, set_a, set_b); gives (node, set_file, set_start)."""
    rows = checked_broadcast(settled(wanted.select(F.col(id).alias("__wanted_id"), "node", "set_a", "set_b"), "wanted"))
    met = df.select(id, text).join(rows, F.col(id).eqNullSafe(F.col("__wanted_id"))).select(text, "node", "set_a", "set_b")

    def store(batches):
        held, size, name = [], 0, uuid.uuid4().int >> 66
        where: list[tuple[int, int]] = []

        def out():
            save_array(folder, str(name), np.concatenate(held))
            node, start = (np.array(c, np.int64) for c in zip(*where))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(node), name, np.int64)), pa.array(start)], names=["node", "set_file", "set_start"])

        for batch in sliced(batches, SLICE):
            hashes, first = shingles(batch.column(0), width)
            a, b = _set_hashes(hashes, first)
            right = (a == batch.column(2).to_numpy()) & (b == batch.column(3).to_numpy())
            node = batch.column(1).to_numpy()
            for i in np.flatnonzero(right):
                held.append(hashes[first[i] : first[i + 1]].copy())
                where.append((int(node[i]), size))
                size += len(held[-1])
                if size >= STORE:
                    yield out()
                    held, where, size, name = [], [], 0, uuid.uuid4().int >> 66
        if held:
            yield out()

    found = met.mapInArrow(store, "node long, set_file long, set_start long")
    return settled(settled(found, "stored").groupBy("node").agg(F.min(F.struct("set_file", "set_start")).alias("at")).select("node", "at.*"), "sets")


def _stored_signature(folder: str, file: int, start: int) -> np.ndarray:
    return load_array(folder, str(file), np.uint32)[start : start + COORDINATES]


def _stored_set(folder: str, file: int, start: int, size: int) -> np.ndarray:
    return load_array(folder, str(file), np.uint64)[start : start + size]


def _similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _kept_pairs(pairs: DataFrame, about: DataFrame, keep, name: str) -> DataFrame:
    """The pairs (a, b) for which keep(columns of a, columns of b) holds, columns being those of `about` but node."""
    columns = [c for c in about.columns if c != "node"]
    side = lambda n: checked_broadcast(about.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in columns]))

    def check(batches):
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns[2:]]
            kept = [keep(x[: len(columns)], x[len(columns) :]) for x in zip(*values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{n}_{c}" for n in "ab" for c in columns])
    return settled(met.mapInArrow(check, "a long, b long"), name)


def _candidates(pairs: DataFrame, signatures: DataFrame, folder: str, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in MATCHES coordinates or more, of sets that are not too unlike in size."""

    def keep(a, b):
        (fa, sa, na), (fb, sb, nb) = a, b
        return 100 * min(na, nb) >= percent * max(na, nb) and int((_stored_signature(folder, fa, sa) == _stored_signature(folder, fb, sb)).sum()) >= MATCHES

    return _kept_pairs(pairs, signatures.select("node", "file", "start", "size"), keep, "candidates")


def _links(candidates: DataFrame, sets: DataFrame, folder: str, percent: int) -> DataFrame:
    """The candidates (a, b) whose full sets (node, set_file, set_start, size) are similar enough."""
    keep = lambda a, b: _similar(_stored_set(folder, *a), _stored_set(folder, *b), percent)
    return _kept_pairs(candidates, sets.select("node", "set_file", "set_start", "size"), keep, "links")


def _head_pairs(heads: DataFrame) -> DataFrame:
    """All unordered pairs (key, x, y) of the heads (key, tag, cut, heads: their number) of a key, but none within one component.

    A join on key and salt: a key of many heads deals the left ones over one salt per HEADS of
    them and copies the right ones to each, so a task pairs about HEADS of a key with all others.
    """
    salts = F.ceil(F.col("heads") / HEADS).cast("int")
    left = heads.select("key", F.struct("tag", "cut").alias("x"), F.pmod(F.xxhash64("tag", "cut"), salts).cast("int").alias("salt"))
    right = heads.select("key", F.struct("tag", "cut").alias("y"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    once = (F.col("x.tag") < F.col("y.tag")) | ((F.col("x.tag") == F.col("y.tag")) & (F.col("x.tag") < 0) & (F.col("x.cut") <= F.col("y.cut")))
    return settled(left.join(right, ["key", "salt"]).where(once).select("key", "x", "y"), "cell_pairs")


def _cells(rows: DataFrame) -> DataFrame:
    """rows (key, node, component, ...) dealt into cells that hold at most about 2 * CHUNK of them.

    A value's large components are cut into chunks by hash, its small ones share chunks.  A
    cell is a pair of chunks of one value (side 1 against side 2, or side 0 with itself);
    no cell is made of two chunks of one component.  Values of one chunk share cells.
    """
    counts = settled(rows.groupBy("key", "component").agg(F.count("*").alias("n")), "counts")
    few = counts.where(F.col("n") < CHUNK).groupBy("key").agg(F.sum("n").alias("few"))
    chunks = counts.join(few, "key", "left").select(
        "key", "component", (F.col("n") >= CHUNK).alias("large"),
        F.ceil(F.when(F.col("n") >= CHUNK, F.col("n")).otherwise(F.col("few")) / CHUNK).alias("cuts"),
    )
    large = F.col("large")
    rows = rows.join(settled(chunks, "chunks"), ["key", "component"]).withColumn("tag", F.when(large, F.col("component")).otherwise(-1))
    rows = rows.withColumn("cut", F.pmod(F.xxhash64(F.when(large, F.col("node")).otherwise(F.col("component"))), "cuts")).drop("large", "cuts")
    rows = settled(rows, "cut")
    heads = settled(rows.select("key", "tag", "cut").distinct(), "heads")  # a row per CHUNK classes
    sizes = settled(heads.groupBy("key").agg(F.count("*").alias("heads")), "head_counts")
    shared = rows.join(sizes.where("heads = 1").select("key"), "key", "left_semi")
    buckets = max(1, -(-shared.count() // CELL))
    shared = shared.withColumns({"side": F.lit(0), "cell": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string")})
    pairs = _head_pairs(heads.join(sizes.where("heads > 1"), "key"))
    cell = F.concat_ws(":", "key", "x.tag", "x.cut", "y.tag", "y.cut").alias("cell")
    one = F.col("x") == F.col("y")
    sides = pairs.select("key", F.col("x.tag").alias("tag"), F.col("x.cut").alias("cut"), cell, F.when(one, 0).otherwise(1).alias("side")).unionAll(
        pairs.where(~one).select("key", F.col("y.tag").alias("tag"), F.col("y.cut").alias("cut"), cell, F.lit(2).alias("side"))
    )
    crossed = rows.join(sides, ["key", "tag", "cut"])
    columns = [c for c in rows.columns if c not in ("tag", "cut")]
    return shared.select("cell", "side", *columns).unionAll(crossed.select("cell", "side", *columns))


def _cell_candidates(group: pa.Table, folder: str, percent: int):
    """Gives (i, others): rows of a cell that are candidates and of different components, under the first value both have posted."""
    side, key, component, mask, file, start, size = (
        group[c].combine_chunks().to_numpy() for c in ("side", "key", "component", "mask", "file", "start", "size")
    )
    place = key >> 32
    values = np.stack([_stored_signature(folder, f, s) for f, s in zip(file.tolist(), start.tolist())])
    bits = (mask[:, None] >> np.arange(COORDINATES)) & 1 == 1
    order = np.argsort(key, kind="stable")
    edge = np.append(np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])), len(order))
    for lo, hi in zip(edge, edge[1:]):
        mine = order[lo:hi]
        left, right = (mine, mine) if side[mine[0]] == 0 else (mine[side[mine] == 1], mine[side[mine] == 2])
        for n, i in enumerate(left):
            other = right[n + 1 :] if side[i] == 0 else right
            other = other[(component[other] != component[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))]
            if not len(other):
                continue
            same = values[other] == values[i]
            good = same.sum(1) >= MATCHES
            other, same = other[good], same[good]
            other = other[(same & bits[other] & bits[i]).argmax(1) == place[i]] if len(other) else other
            if len(other):
                yield i, other


def _cross_cells(posted: DataFrame, found: DataFrame, signatures: DataFrame, folder: str, percent: int) -> DataFrame:
    """Rows of cells, only those that are in a candidate of two classes of different components that share a posted value.

    A pair is looked at under the first value only that both have posted.
    """
    grouped = posted.join(checked_broadcast(found), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    grouped = settled(grouped, "grouped")
    open_keys = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = settled(grouped.join(settled(open_keys.select("key"), "open"), "key", "left_semi"), "open_rows")
    masks = posted.groupBy("node").agg(F.expr("bit_or(shiftleft(1L, CAST(shiftright(key, 32) AS INT)))").alias("mask"))
    about = settled(masks.join(signatures, "node").join(rows.select("node").distinct(), "node", "left_semi"), "about")
    cells = _cells(rows).join(checked_broadcast(about), "node").select("cell", "side", "key", "component", "node", "mask", "file", "start", "size")

    def involved(group: pa.Table) -> pa.Table:
        seen = np.zeros(group.num_rows, bool)
        for i, others in _cell_candidates(group, folder, percent):
            seen[i] = True
            seen[others] = True
        return group.filter(pa.array(seen))

    return settled(cells.groupBy("cell").applyInArrow(involved, cells.schema), "cell_candidates")


def _cross_links(cells: DataFrame, sets: DataFrame, folder: str, percent: int) -> DataFrame:
    """Links (a, b) within cells.  Pairs are made, counted and confirmed within a cell and never leave it unless they are links."""

    def compare(group: pa.Table) -> pa.Table:
        node, size, file, start = (group[c].combine_chunks().to_numpy() for c in ("node", "size", "set_file", "set_start"))
        a, b = [], []
        for i, others in _cell_candidates(group, folder, percent):
            own = _stored_set(folder, file[i], start[i], size[i])
            for j in others.tolist():
                if _similar(own, _stored_set(folder, file[j], start[j], size[j]), percent):
                    a.append(max(node[i], node[j]))
                    b.append(min(node[i], node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = cells.join(checked_broadcast(sets.select("node", "set_file", "set_start")), "node")
    return settled(met.groupBy("cell").applyInArrow(compare, "a long, b long"), "cross_links")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (least id of its component), __row, first_row.

    __row numbers the rows; first_row is that of the row with the least id (and number) of the component.
    """
    rows = settled(signed(df, id, text, width).withColumn("__row", F.monotonically_increasing_id()), "signed")
    key = ["set_a", "set_b", "n_shingles"]
    nodes = rows.where("n_shingles > 0").groupBy(*key).agg(F.min("__row").alias("node"))
    nodes = settled(nodes, "nodes")
    classes = settled(rows.join(checked_broadcast(nodes.select("node")), F.col("__row") == F.col("node")).select(id, "node", "n_shingles", "set_a", "set_b", "signature"), "classes")
    posted = _prefixes(classes)
    folder = new_folder(df.sparkSession, "sets")
    wanted = checked_broadcast(settled(posted.select("node").distinct(), "posted"))
    signatures = _stored_signatures(classes.join(wanted, "node", "left_semi"), folder)

    def sets_of(nodes: DataFrame) -> DataFrame:
        chosen = classes.join(checked_broadcast(settled(nodes.distinct(), "compared")), "node", "left_semi")
        return _stored_sets(df, chosen, id, text, width, folder).join(signatures.select("node", "size"), "node")

    pairs = _candidates(_pivot_pairs(posted), signatures, folder, percent)
    sets = settled(sets_of(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))), "pair_sets")
    links = _links(pairs, sets, folder, percent)
    found = settled(components(links), "components")
    cells = _cross_cells(posted, found, signatures, folder, percent)
    late = cells.select("node").join(sets, "node", "left_anti")
    sets = settled(sets.unionAll(sets_of(late)), "all_sets")
    more = _cross_links(cells, sets, folder, percent)
    if not more.isEmpty():  # the components so far are stars; only what joins them is new
        found = settled(components(found.toDF("a", "b").unionAll(more)), "components")
    return _labelled(rows, nodes, found, id, key)


def _labelled(rows: DataFrame, nodes: DataFrame, found: DataFrame, id: str, key: list[str]) -> DataFrame:
    group = nodes.join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("group"))
    group = settled(group, "groups")
    labelled = settled(rows.drop("signature").join(group, key, "left").withColumn("group", F.coalesce("group", "__row")), "labelled")
    first = labelled.groupBy("group").agg(F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("least"), "__row")).alias("first"))
    first = settled(first.select("group", F.col("first.least").alias("component_id"), F.col("first.__row").alias("first_row")), "first")
    return labelled.join(first, "group").select(id, "n_shingles", "component_id", "__row", "first_row")


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """df with the row of the least id of each component, all columns unchanged.

    Texts without words stay.  The rows are numbered in a copy, so that equal rows are told apart.
    """
    number = unused(df, "__number")
    rows = settled(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    named = rows.select(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col(number).alias("number")).alias("__id"), text)
    done = near_duplicates(named, "__id", text, width, percent)
    gone = checked_broadcast(settled(done.where("__row <> first_row").select(F.col("__id.number").alias(number)), "gone"))
    return rows.join(gone, number, "left_anti").select(*df.columns)

"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, and exact confirmation on whole sets.

1. A document is the set of its distinct word shingles (64-bit hashes). Documents of equal sets form a class with a number
   of its own, and only its smallest member goes on; rows are told apart by key and text.
2. A class has a signature of ``symbols`` symbols of 16 bits, 64 by default: the lowest bits of as many minimum hashes. The
   distance of two signatures is the number of symbols that differ. The join takes pairs that differ in less than half of
   them. A pair of similarity 0.8 differs in a fifth of them on average, and in half or more with a probability of 2e-4 of
   32 symbols, 2e-8 of 64, 3e-10 of 80 and 4e-12 of 96.
3. The signature is split into chunks of 4 symbols. By pigeonhole, a pair with fewer differing symbols than two a chunk has
   a chunk with at most one, so each chunk is a key four times, each time without one of its symbols: a pair within the
   distance always shares a key. Keys that one class alone has are dropped before any signature moves.
4. Within a key, the classes that hang together by pairs within the distance are found by a search that compares each
   class with those not yet reached, so that a large group of near copies costs little more than its size. Keys with more
   members than a block are dealt out in blocks; then one of each component found meets those of other blocks; and at
   last what is still outside of a key's largest component meets all of the key. So a pair within the distance is always
   compared or connected already, no task holds more than two blocks, and copies of one text never meet all pairs.
5. Candidate components that are too large to meet at once (chains of texts that share boilerplate) fall apart by the same
   join over signatures of 160 symbols of 8 bits: pairs of similarity 0.8 differ in 32 of them on average and in more than
   72 with a probability of 1e-12, so what a component's size decides is the work alone.
6. The classes of a candidate component meet with their whole sets, and a search of the same kind over exact similarities,
   in blocks as above, gives links whose components are the answer. These blocks are bounded by the shingles in them too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, hash_runs, mix, runs, text_slices, utf8
from .components import components, join_hot

#: Symbols of a signature, and of a chunk of it.
SYMBOLS, CHUNK = 64, 4
#: The longer signatures and the distance that they are compared by.
LONG, LONG_DISTANCE = 160, 72
#: Shingles in a block of sets.
BLOCK_SHINGLES = 8_000_000


def hashes(symbols: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of as many hash functions."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**63, symbols, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 2**63, symbols, dtype=np.uint64)


#: Separators of words; A-Z are lower-cased, and nothing else.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets of the texts in them)."""
    n = len(offs) - 1
    lowered = _LOWER[data]
    text, a, b = runs(~_SPACE[data], offs)
    h = hash_runs(lowered, a, b)
    total = np.bincount(text, minlength=n)
    full = np.zeros(len(h), dtype=np.uint64)
    size = max(0, len(h) - words + 1)
    if size:
        for k in range(words):
            full[:size] = full[:size] * np.uint64(0xD6E8FEB86659FD93) + h[k : k + size]
        full[:size] = mix(full[:size])
    first = np.cumsum(total) - total
    at = np.arange(len(h)) - first[text] if len(h) else np.zeros(0, dtype=np.int64)
    keep = at + words <= total[text]
    # fewer words than a shingle: the whole sequence is one, told apart by its length
    short = np.flatnonzero((total > 0) & (total < words))
    own = np.zeros(len(short), dtype=np.uint64)
    for k in range(words - 1):
        has = total[short] > k
        own[has] = own[has] * np.uint64(0xA0761D6478BD642F) + h[first[short[has]] + k]
    own = mix(own + total[short].astype(np.uint64))
    of, value = np.concatenate([text[keep], short]), np.concatenate([full[keep], own])
    order = np.argsort(value)
    order = order[np.argsort(of[order], kind="stable")]
    of, value = of[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    of, value = of[new], value[new]
    return value, np.searchsorted(of, np.arange(n + 1))


def minima(value: np.ndarray, offs: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """[text, symbol]: the lowest 16 bits of each text's minimum hashes; zeros for a text without shingles."""
    some = np.flatnonzero(np.diff(offs))
    out = np.zeros((len(offs) - 1, len(mul)), dtype="<u2")
    if len(some):
        for k in range(len(mul)):
            out[some, k] = mix(np.minimum.reduceat(value * mul[k] + add[k], offs[:-1][some])).astype(np.uint16)
    return out


def sketches(docs: DataFrame, words: int, symbols: int = SYMBOLS) -> DataFrame:
    """(key, copy, n_shingles, p, q, signature) of every row (key, copy, text): p and q tell sets apart; empty sets have nulls."""
    mul, add = hashes(symbols, 20240229)

    def run(batches):
        for batch in text_slices(batches, "text"):
            value, offs = shingles(*utf8(batch.column("text")), words)
            size = np.diff(offs)
            some = np.flatnonzero(size)
            p, q = np.zeros(len(size), dtype=np.uint64), np.zeros(len(size), dtype=np.uint64)
            found = minima(value, offs, mul, add)
            if len(some):
                begin = offs[:-1][some]
                p[some] = np.add.reduceat(mix(value + np.uint64(1)), begin)
                q[some] = np.add.reduceat(mix(value ^ np.uint64(0x5DEECE66D1234567)), begin)
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("copy"),
                    pa.array(size, pa.int64()),
                    pa.array(p.view(np.int64), mask=none),
                    pa.array(q.view(np.int64), mask=none),
                    pa.array([None if e else s.tobytes() for s, e in zip(found, none)], pa.binary()),
                ],
                names=["key", "copy", "n_shingles", "p", "q", "signature"],
            )

    schema = docs.select("key", "copy").schema.add("n_shingles", "long").add("p", "long").add("q", "long").add("signature", "binary")
    return docs.select("key", "copy", "text").mapInArrow(run, schema)


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(bucket, id): as many keys a class as symbols, each of a chunk, the symbol left out of it, and the three that stay."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<u2").reshape(n, -1, CHUNK).astype(np.uint64)
            chunks = sig.shape[1]
            keys = []
            for out in range(CHUNK):
                code = np.zeros((n, chunks), dtype=np.uint64)
                for k in range(CHUNK):
                    if k != out:
                        code = (code << np.uint64(16)) | sig[:, :, k]
                keys.append(code | (np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(out)) << np.uint64(48))
            keys = np.stack(keys, axis=2).reshape(n, -1)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(n), keys.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), ids], names=["bucket", "id"])

    return classes.select("id", "signature").mapInArrow(run, "bucket long, id long")


def grouped(batches, *by: str):
    """Tables of the rows of one group after the other, from batches that are sorted by the group."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(c)) for c in by]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in by):
            yield pa.Table.from_batches(held)
            held = []
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def signature_links(ids: np.ndarray, sig: np.ndarray, distance: int) -> tuple[list, list]:
    """Links that connect whatever pairs within the distance connect: one for each row reached from another."""
    left = np.arange(len(ids))
    a, b = [], []
    queue: list[int] = []
    rest = sig
    while len(left):
        if queue:
            here = queue.pop()
        else:
            here, left, rest = int(left[0]), left[1:], rest[1:]
        near = (rest != sig[here]).sum(axis=1) <= distance
        if near.any():
            found = left[near]
            a += [ids[here]] * len(found)
            b += ids[found].tolist()
            queue += found.tolist()
            left, rest = left[~near], rest[~near]
    return a, b


def dealt_links(rows: DataFrame, top: int, payload, search, by: str, split: bool) -> DataFrame:
    """(a, b): links that connect, in each group of ``by``, whatever the pairs that ``search`` finds would connect.

    rows: (by, id, n, share), n the group's size, ``top`` the largest, share what part of a block a row of the group takes;
    split: whether any group is more than a block; payload(rows) adds what search(table) compares the rows of one task's
    table by.
    """

    def run(batches):
        seen: set = set()
        a, b = [], []
        for group in grouped(batches, by, "pair"):
            for pair in zip(*search(group)):
                pair = (int(min(pair)), int(max(pair)))
                if pair[0] != pair[1] and pair not in seen:  # many keys tell of the same pair
                    seen.add(pair)
                    a.append(pair[0])
                    b.append(pair[1])
            if len(a) > 50000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
            if len(seen) > 500000:
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def meet(dealt):
        full = payload(dealt.select(by, "pair", "id"))
        return cut(full.repartition(by, "pair").sortWithinPartitions(by, "pair").mapInArrow(run, "a long, b long").distinct())

    def parts_of(size):
        return F.greatest(F.ceil(F.col(size) * F.col("share")), F.lit(1))

    def block_of(size):
        return F.pmod(F.xxhash64("id"), parts_of(size))

    def placed(links):
        near = components(links).select(F.col("node").alias("id"), "root")
        return cut(large.join(near, "id", "left").select(by, "id", "n", "share", F.coalesce("root", "id").alias("own")))

    links = meet(rows.withColumn("pair", block_of("n")))
    if not split:
        return links
    large = rows.filter(F.col("n") * F.col("share") > 1)
    # one of each component that a block has found stands for it
    heads = placed(links).groupBy(by, "own").agg(F.min("id").alias("id"), F.max("share").alias("share"))
    number = heads.groupBy(by).agg(F.count("*").alias("m")).filter("m > 1")
    links = links.unionByName(meet(join_hot(heads, number, [by], ["id"], heads.count(), top, "m").withColumn("pair", block_of("m"))))
    # what is outside of a group's largest component meets the whole group
    now = placed(links)
    parts = now.groupBy(by, "own").agg(F.count("*").alias("c"))
    main = parts.groupBy(by).agg(F.max(F.struct("c", "own")).alias("top"), F.sum("c").alias("all"))
    main = main.select(by, F.col("top.own").alias("main"), "all", (F.col("all") - F.col("top.c")).alias("strays")).filter("strays > 0")
    rest = cut(join_hot(now, main, [by], ["id"], now.count(), top, "all"))  # with each group's share
    if rest.isEmpty():
        return links
    of, strays = parts_of("all"), parts_of("strays")
    every = rest.select(by, "id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), strays - 1), lambda j: F.pmod(F.xxhash64("id"), of) * strays + j)).alias("pair"))
    out = rest.filter("own <> main")
    out = out.select(by, "id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), of - 1), lambda i: i * strays + F.pmod(F.xxhash64("id"), strays))).alias("pair"))
    return links.unionByName(meet(every.unionByName(out).distinct()))


def by_signature(distance: int, column: str = "signature", symbol: str = "<u2"):
    def search(group: pa.Table):
        raw = group.column(column).to_pylist()
        return signature_links(np.asarray(group.column("id")), np.frombuffer(b"".join(raw), dtype=symbol).reshape(len(raw), -1), distance)

    return search


def shared_keys(classes: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, id, n): the keys that several classes have, and the largest n; classes: (id, signature)."""
    keys = chunk_keys(classes)
    counts = cut(keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    total, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return cut(join_hot(keys, counts, ["bucket"], ["id"], total, top)), top


def candidate_components(classes: DataFrame, docs: DataFrame, words: int, symbols: int, key_block: int, set_block: int) -> tuple[DataFrame, int, bool]:
    """(component, id, n, share): classes that may be linked, n the size of the component; the largest n, and whether any component is more than a block."""
    distance = symbols // CHUNK * 2 - 1  # with more, every chunk could have two
    keys, most = shared_keys(classes)
    keys = keys.withColumn("share", F.lit(1 / key_block))
    links = dealt_links(keys, most, lambda r: r.join(classes.select("id", "signature"), "id"), by_signature(distance), "bucket", most > key_block)
    found, top, split = sized(components(links), classes, set_block)
    if not split:
        return found, top, split
    mul, add = hashes(LONG, 20240301)

    def sketch(batches):
        for batch in text_slices(batches, "text", 1 << 18):
            sig = minima(*shingles(*utf8(batch.column("text")), words), mul, add)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.astype(np.uint8).tobytes() for x in sig], pa.binary())], names=["id", "long"])

    large = cut(found.filter(F.col("n") * F.col("share") > 1).select("id"))
    sharp = cut(texts_of(docs, classes.join(large, "id")).mapInArrow(sketch, "id long, long binary"))
    again = components(dealt_links(keys.join(large, "id"), most, lambda r: r.join(sharp, "id"), by_signature(LONG_DISTANCE, "long", "u1"), "bucket", most > key_block))
    return sized(found.join(large, "id", "left_anti").select(F.col("id").alias("node"), F.col("component").alias("root")).unionByName(again), classes, set_block)


def sized(nodes: DataFrame, classes: DataFrame, block: int) -> tuple[DataFrame, int, bool]:
    """(component, id, n, share) of (node, root), the largest n, and whether any component is more than a block, of so many rows or BLOCK_SHINGLES."""
    rows = nodes.select(F.col("root").alias("component"), F.col("node").alias("id"))
    sizes = rows.join(classes.select("id", "n_shingles"), "id").groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("_s"))
    sizes = cut(sizes.select("component", "n", F.greatest(F.lit(1 / block), F.col("_s") / F.col("n") / BLOCK_SHINGLES).alias("share")))
    total, top, fill = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.max(F.col("n") * F.col("share"))).first()
    return cut(join_hot(rows, sizes, ["component"], ["id"], total, top)), top, (fill or 0) > 1


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but for their key and copy, with the text of each; docs: (key, copy, text), where a text may stand several times."""
    found = docs.join(rows.select(F.col("key").alias("_k"), F.col("copy").alias("_c"), *[c for c in rows.columns if c not in ("key", "copy")]), F.col("key").eqNullSafe(F.col("_k")) & (F.col("copy") == F.col("_c")))
    return found.drop("key", "copy", "_k", "_c")


def exact_links(ids: np.ndarray, value: np.ndarray, offs: np.ndarray, percent: int) -> tuple[list, list]:
    """As signature_links, over similarities of whole sets: 100 * intersection >= percent * union."""
    _, code = np.unique(value, return_inverse=True)
    sizes = np.diff(offs)
    left = np.arange(len(ids))
    rest, at = code, offs[:-1]
    mark = np.zeros(int(code.max()) + 1 if len(code) else 1, dtype=bool)
    a, b, queue = [], [], []
    while len(left):
        if queue:
            here = queue.pop()
        else:
            here, left = int(left[0]), left[1:]
            rest, at = rest[sizes[here] :], at[1:] - sizes[here]
            if not len(left):
                break
        own = code[offs[here] : offs[here + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[rest].astype(np.int64), at)
        mark[own] = False
        near = 100 * both >= percent * (sizes[here] + sizes[left] - both)
        if near.any():
            found = left[near]
            a += [ids[here]] * len(found)
            b += ids[found].tolist()
            queue += found.tolist()
            rest = rest[np.repeat(~near, sizes[left])]
            left = left[~near]
            at = np.cumsum(sizes[left]) - sizes[left]
    return a, b


def confirmed_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, top: int, split: bool, words: int, percent: int) -> DataFrame:
    """(a, b): links on whole sets among the classes of each candidate component (component, id, n, share)."""

    def sets(batches):
        for batch in text_slices(batches, "text"):
            value, offs = shingles(*utf8(batch.column("text")), words)
            raw = [value[x:y].tobytes() for x, y in zip(offs, offs[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("component"), batch.column("pair"), pa.array(raw, pa.binary())], names=["id", "component", "pair", "shingles"])

    def payload(rows):
        named = rows.join(classes.select("id", "key", "copy"), "id").select("id", "component", "pair", "key", "copy")
        return texts_of(docs, named).select("id", "component", "pair", "text").mapInArrow(sets, "id long, component long, pair long, shingles binary")

    def search(group: pa.Table):
        ids, at = np.unique(np.asarray(group.column("id")), return_index=True)  # a text that stands there several times is one class
        raw = group.column("shingles").take(pa.array(at)).to_pylist()
        offs = np.concatenate([[0], np.cumsum([len(r) // 8 for r in raw])])
        return exact_links(ids, np.frombuffer(b"".join(raw), dtype=np.uint64), offs, percent)

    return dealt_links(candidates, top, payload, search, "component", split)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", symbols: int = SYMBOLS, key_block: int = 20000, set_block: int = 4000
) -> DataFrame:
    """(key, copy, n_shingles, component_id, kept, first): one row a document.

    Documents of a component are linked by similarities of ``percent`` or more, directly or through others. component_id
    is its smallest key (null where all are null) and kept says whether a document has that key. ``copy`` is xxhash64 of
    the text: rows are told apart by key and text, so rows with one key and different texts are different documents, and
    rows that repeat both are one document and give as many rows. ``first`` is true for one key and text of a component:
    the smallest key that is not null, then the smallest copy. Null, empty and wordless texts have empty sets and are linked
    with nothing: their component is their own key, and kept and first are true. Keys are integers; null ones are
    compared like others. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text"))
    rows = cut(sketches(docs, words, symbols))
    known = rows.filter(F.col("p").isNotNull())
    same = ["n_shingles", "p", "q"]
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "copy"))  # null keys last
    classes = known.groupBy(*same).agg(least.alias("_m"), F.first("signature").alias("signature"), F.count("*").alias("n"))
    # a number of its own for each class: keys may repeat with different texts
    classes = cut(classes.select(*same, "signature", "n", F.col("_m.key").alias("key"), F.col("_m.copy").alias("copy"), F.monotonically_increasing_id().alias("id")))
    candidates, top, split = candidate_components(classes, docs, words, symbols, key_block, set_block)
    links = components(confirmed_links(docs, classes, candidates, top, split, words, percent))
    # each component's smallest member; most classes are alone
    linked = links.join(classes.select(F.col("id").alias("node"), "key", "copy"), "node")
    heads = linked.groupBy("root").agg(least.alias("_m"), F.count("*").alias("n"))
    total, top = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    heads = heads.select("root", "n", F.col("_m.key").alias("_key"), F.col("_m.copy").alias("_copy"))
    merged = join_hot(links, heads, ["root"], ["node"], total, top).select(F.col("node").alias("id"), "_key", "_copy", F.lit(True).alias("_in"))
    final = classes.join(merged, "id", "left").select(*same, "n", F.when(F.col("_in"), F.col("_key")).otherwise(F.col("key")).alias("component_id"), F.when(F.col("_in"), F.col("_copy")).otherwise(F.col("copy")).alias("_copy"))
    total, copies = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    found = join_hot(known.select("key", "copy", *same), final, same, ["key", "copy"], total, copies)
    own = F.col("key").eqNullSafe(F.col("component_id"))
    found = found.select("key", "copy", "n_shingles", "component_id", own.alias("kept"), (own & (F.col("copy") == F.col("_copy"))).alias("first"))
    alone = rows.filter(F.col("p").isNull()).select("key", "copy", "n_shingles", F.col("key").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first"))
    return found.unionByName(alone).withColumnRenamed("key", key)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shingles of four words; see ``near_duplicates`` for nulls, repeated rows and keys."""
    return near_duplicates(documents(spark, sf_dir), words=4).select("doc_id", "n_shingles", "component_id", "kept")

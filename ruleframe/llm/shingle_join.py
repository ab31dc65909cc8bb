"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct word n-grams, held as 64-bit numbers in one global order: frequent n-grams last, the
rest by number. Two sets with the wanted Jaccard similarity share a number within a prefix of each. Documents that share a
prefix number meet in the bucket of the smallest of them. There, parity sketches (a bit for every few numbers) show which
sets cannot be similar: sketches differ in no more bits than the sets in numbers. Those that may be similar are stored in a
trie, and every set runs down the trie once: sets with a common beginning share the partial overlap, and a subtree is left as
soon as the numbers that remain cannot reach the overlap it needs, or when all its sets are in the component of the running
set already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ruleframe.llm.common import Scratch, checked_broadcast, components, in_slices, text_slices, tidy

#: Frequent n-grams that are moved to the end of the global order; a list of this length at most goes to every task.
FREQUENT = 100_000
FLIP = np.uint64(1 << 63)


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of words, and the 64-bit numbers of all words one after another. Words end at x20 and x09-x0D."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    known = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in flat.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(flat.dictionary))
    numbers = known[flat.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.uint64)
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    if blank.any():  # an empty text is split into one empty word
        numbers = np.delete(numbers, (np.cumsum(counts) - counts)[blank & (counts > 0)])
        counts = np.where(blank, 0, counts)
    return counts, numbers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(numbers: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(numbers) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + numbers[k : len(numbers) - n + 1 + k])
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct n-gram numbers; with fewer words than ``n``, the whole sequence is one n-gram."""
    for lo, hi in text_slices(texts, 4_000_000):
        counts, numbers = word_numbers(texts.slice(lo, hi - lo))
        grams = rolled(numbers, n) if len(numbers) >= n else numbers[:0]
        at = 0
        for count in counts.tolist():
            yield numbers[:0] if not count else np.unique(grams[at : at + count - n + 1]) if count >= n else rolled(numbers[at : at + count], count)
            at += count


def prefix_length(size: int, share: tuple[int, int]) -> int:
    """Two sets with Jaccard of at least share[0] / share[1] meet in their first ``prefix_length`` numbers."""
    return size - -(-size * share[0] // share[1]) + 1


def in_order(numbers: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent) or not len(numbers):
        return numbers
    late = frequent[np.minimum(np.searchsorted(frequent, numbers), len(frequent) - 1)] == numbers
    return np.concatenate([numbers[~late], numbers[late]])


def ordered(numbers: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Numbers whose own order is the global one: the highest bit tells the frequent."""
    early, late = np.split(in_order(numbers, frequent), [len(numbers) - int(np.isin(numbers, frequent).sum())])
    return np.concatenate([early >> np.uint64(1), (late >> np.uint64(1)) | FLIP])


def name_of(numbers: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(numbers.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(numbers: np.ndarray) -> bytes:
    """A bit for each remainder of the numbers, on if an odd number of them has it; as many bits as numbers, rounded up to a power of two."""
    bits = max(64, 1 << (max(len(numbers), 1) - 1).bit_length())
    odd = np.bincount((numbers & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, size, a, b, sketch)``: the set's size, 128-bit name and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out = [(len(s), *name_of(s), sketch(s)) for s in shingle_sets(batch.column(1), n)]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "size", "a", "b", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, size long, a long, b long, sketch binary")


def prefixes(docs: DataFrame, n: int, share: tuple[int, int], frequent) -> DataFrame:
    """``(gram, a)``: the prefix numbers of every document's set, with the first half of the set's name. A set that a task has
    met just before is not repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, met = frequent.value if frequent is not None else np.zeros(0, dtype=np.uint64), set()
        for batch in in_slices(batches):
            out, names = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            if len(met) > 100_000:
                met.clear()
            for s in shingle_sets(batch.column(0), n):
                if not len(s) or (name := name_of(s))[0] in met:
                    continue
                met.add(name[0])
                out.append(in_order(s, late)[: prefix_length(len(s), share)])
                names.append(np.full(len(out[-1]), name[0], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(names))], names=["gram", "a"])

    return docs.select("text").mapInArrow(tidy(run), "gram long, a long")


def frequent_numbers(docs: DataFrame, scratch: Scratch, n: int, share: tuple[int, int]) -> np.ndarray:
    """Prefix n-grams by falling frequency, ``FREQUENT`` of them at most. They only set the global order: any order gives the same result."""
    counts = prefixes(docs, n, share, None).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n >= 16")
    counts = scratch.keep(counts, "counts")
    least, total = 16, 0
    for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("level")).count().orderBy(F.desc("level")).collect():  # under 300 rows
        if (total := total + r["count"]) > FREQUENT:
            break
        least = r["level"]
    kept = counts.filter(F.floor(F.log2("n") * 4) >= least).select("gram").limit(FREQUENT).toPandas()["gram"].to_numpy(dtype=np.int64)
    return np.sort(kept.view(np.uint64))


class Trie:
    """Sets in one global order, as a path-compressed tree: a node has a stretch of numbers, children by first number, the ids
    that end in it, and bounds on the sizes below."""

    __slots__ = ("stretch", "children", "ids", "least", "most", "group")

    def __init__(self, stretch: np.ndarray):
        self.stretch, self.children, self.ids, self.least, self.most, self.group = stretch, {}, [], 1 << 62, 0, -1

    def add(self, key: np.ndarray, member: int, find) -> None:
        node, at, size = self, 0, len(key)
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            node.group = member if node.group == -1 else node.group if node.group is not None and find(node.group) == find(member) else None
            if at == size:
                node.ids.append(member)
                return
            if (child := node.children.get(int(key[at]))) is None:
                child = node.children[int(key[at])] = Trie(key[at:])
                child.least = child.most = size
                child.group = member
                child.ids.append(member)
                return
            m = min(len(child.stretch), size - at)
            same = child.stretch[:m] == key[at : at + m]
            common = m if same.all() else int(np.argmin(same))
            if common < len(child.stretch):
                upper = Trie(child.stretch[:common])
                upper.least, upper.most, upper.group = child.least, child.most, child.group
                child.stretch = child.stretch[common:]
                upper.children[int(child.stretch[0])] = child
                node.children[int(key[at])] = child = upper
            node, at = child, at + common


def trie_links(sets: list[np.ndarray], sides: np.ndarray | None, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join the components of the sets: pairs (i, j) with similarity >= share. The sets are sorted by global order.
    ``sides``: pairs within one side are the task of another block."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, num, den = [], *share
    roots = [Trie(np.zeros(0, dtype=np.uint64)) for _ in range(1 if sides is None else 2)]
    for i in sorted(range(len(sets)), key=lambda k: (len(sets[k]), k)):
        own, size = sets[i], len(sets[i])
        root = roots[0 if sides is None else 1 - int(sides[i])]
        todo = [(root, 0, 0)]  # node, numbers above it, of these in the running set
        while todo:
            node, depth, shared = todo.pop()
            if node.group is not None and node.group != -1 and find(node.group) == find(i):
                continue
            past = 0  # numbers of the running set that stand before or at the end of this stretch
            if len(node.stretch):
                at = np.searchsorted(own, node.stretch)
                past = int(at[-1]) + int(own[min(int(at[-1]), size - 1)] == node.stretch[-1])
                shared += int((own[np.minimum(at, size - 1)] == node.stretch).sum())
                depth += len(node.stretch)
            if not node.most or node.most * den < size * num:
                continue
            # overlap needed with a set of t numbers: num * (size + t) / (num + den); at most shared + what remains of either
            least = max(node.least, -(-size * num // den))
            if shared + min(size - past, node.most - depth) < -(-num * (size + least) // (num + den)):
                continue
            for j in node.ids:
                if den * shared >= num * (size + len(sets[j]) - shared) and find(i) != find(j):
                    out.append((i, j))
                    parent[find(j)] = find(i)
            todo += [(child, depth, shared) for child in node.children.values()]
        roots[0 if sides is None else int(sides[i])].add(own, i, find)
    return out


class Groups:
    """Components of 0..n-1 under links."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits from one of more."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def possible_pairs(sizes: np.ndarray, sketches: list[bytes], sides: np.ndarray | None, share: tuple[int, int]) -> tuple[Groups, np.ndarray]:
    """The components of the sets that sketches leave as possibly similar, and each set's number of such partners; the sets are
    sorted by size. With ``sides``, pairs within one side are the task of another block."""
    n, (num, den) = len(sizes), share
    groups, partners, tables = Groups(n), np.zeros(n, dtype=np.int64), {}
    bits = [np.frombuffer(x, dtype=np.uint64) for x in sketches]
    ends = np.searchsorted(sizes, sizes * den // num, side="right")
    for i in range(n - 1):
        if ends[i] <= i + 1:
            continue
        words = len(bits[i])
        if words not in tables:
            tables.clear()  # sizes rise, and so do the sketches' lengths
            tables[words] = (i, np.stack([folded(x, words) for x in bits[i : ends[n - 1]]]))
        first, table = tables[words]
        differ = np.bitwise_count(table[i + 1 - first : ends[i] - first] ^ table[i - first]).sum(1)
        both = sizes[i] + sizes[i + 1 : ends[i]]
        may = differ <= both - 2 * -(-num * both // (num + den))
        if sides is not None:
            may &= sides[i + 1 : ends[i]] != sides[i]
        found = np.flatnonzero(may) + i + 1
        partners[i] += len(found)
        partners[found] += 1
        for j in found.tolist():
            groups.link(i, j)
    return groups, partners


def by_group(rows: DataFrame, keys: list[str], schema: str, work: Callable[[tuple, pa.Table], pa.Table]) -> DataFrame:
    """Runs ``work`` on every group of ``keys`` (longs without nulls), in tasks that read their sorted rows one group after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
            cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(columns[:, lo].tolist())
                if held and now != key:
                    yield from work(key, pa.Table.from_batches(held).combine_chunks()).to_batches()
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from work(key, pa.Table.from_batches(held).combine_chunks()).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def with_grams(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``rows(id, ...)`` with the n-gram numbers of each id's text as bytes, column ``grams``."""
    names = [x for x in rows.columns if x != "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            grams = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ["id", *names]), grams], names=["id", *names, "grams"])

    kinds = dict(rows.dtypes)
    chosen = docs.select(F.col("doc_id").alias("id"), "text").join(checked_broadcast(rows, rows.count()), "id").select("id", *names, "text")
    return chosen.mapInArrow(tidy(run), "id long, " + ", ".join(f"{x} {kinds[x]}" for x in names) + ", grams binary")


def dealt_by_pairs(rows: DataFrame, scratch: Scratch, block_rows: int) -> DataFrame:
    """``rows(bucket, id, ...)`` with ``half, side``: buckets of up to ``block_rows`` rows are one block (-1); of larger ones every
    row goes to all pairs of its own block with another. Only the larger ones' names and sizes meet the rows, so that no task gets
    a whole bucket; there is one for every ``block_rows`` rows at most."""
    large = scratch.keep(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows), "large-buckets")
    large = checked_broadcast(large, large.count())
    small = rows.join(large.select("bucket"), "bucket", "left_anti").withColumns({"half": F.lit(-1).cast("long"), "side": F.lit(0).cast("long")})
    blocks = F.ceil(F.col("n") / block_rows).cast("long")
    out = rows.join(large, "bucket").withColumns({"blocks": blocks, "side": F.pmod(F.xxhash64("id"), blocks).cast("long")}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    half = F.least("side", "other") * F.col("blocks") + F.greatest("side", "other")
    return small.unionByName(out.withColumn("half", half).select(small.columns))


def may_be_similar(members: DataFrame, scratch: Scratch, share: tuple[int, int], block_rows: int) -> DataFrame:
    """``members(bucket, id, size, sketch)`` -> ``(kind, grp, id, partners)``: groups of sets that may be similar. A bucket in one
    block falls into its components (kind 0, named by the smallest id); a larger one stays one group (kind 1)."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["id"].to_numpy(), rows["size"].to_numpy()))
        rows = rows.take(pa.array(order))
        ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
        groups, partners = possible_pairs(rows["size"].to_numpy(), rows["sketch"].to_pylist(), (side == side.max()) if side.min() != side.max() else None, share)
        names, roots = {}, [groups.find(i) for i in range(len(ids))]
        for i, r in zip(ids.tolist(), roots, strict=True):
            names[r] = min(i, names.get(r, i))
        kept = partners > 0
        grp = np.array([names[r] for r in roots], dtype=np.int64) if key[1] == -1 else np.full(len(ids), key[0])
        return pa.table({"kind": pa.array(np.full(int(kept.sum()), int(key[1] != -1), dtype=np.int64)), "grp": grp[kept], "id": ids[kept], "partners": partners[kept]})

    dealt = dealt_by_pairs(members, scratch, block_rows).select("bucket", "half", "side", "id", "size", "sketch")
    found = by_group(dealt, ["bucket", "half"], "kind long, grp long, id long, partners long", work)
    return found.groupBy("kind", "grp", "id").agg(F.sum("partners").alias("partners"))


def links_by_tries(rows: DataFrame, share: tuple[int, int], frequent) -> DataFrame:
    """``rows(kind, grp, half, side, pivot, id, grams)`` -> links ``(kind, grp, src, dst)``, and a row without ``dst`` for each set
    that is not joined to its block's pivot. Each (kind, grp, half) is one trie of bounded size."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["id"].to_numpy(), kind="stable")))
        ids, side, pivot = (rows[x].to_numpy() for x in ("id", "side", "pivot"))
        sets = [ordered(np.frombuffer(g, dtype=np.uint64), frequent.value) for g in rows["grams"].to_pylist()]
        found = trie_links(sets, (side == side.max()).astype(int) if side.min() != side.max() else None, share)
        src, dst = [int(ids[a]) for a, _ in found], [int(ids[b]) for _, b in found]
        if pivot.any():
            groups = Groups(len(ids))
            for a, b in found:
                groups.link(a, b)
            at = groups.find(int(pivot.argmax()))
            apart = [int(i) for k, i in enumerate(ids) if groups.find(k) != at]
            src, dst = src + apart, dst + [None] * len(apart)
        names = [pa.array(np.full(len(src), x, dtype=np.int64)) for x in key[:2]]
        return pa.table({"kind": names[0], "grp": names[1], "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return by_group(rows, ["kind", "grp", "half"], "kind long, grp long, src long, dst long", work)


def near_documents(docs: DataFrame, scratch: Scratch, n: int = 5, share: tuple[int, int] = (80, 100), block_rows: int = 400) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Words are runs of characters other than space and x09-x0D, with A-Z in lower case; a document with fewer than ``n`` words
    has its whole sequence as one n-gram; one without words or text has an empty set, links with nothing and is its own
    component. Documents link when share[1] * intersection >= share[0] * union, and the component is the smallest doc_id
    reachable. Rows that repeat doc_id and text are one document; a row that repeats a doc_id with another text has that text's
    component. A null doc_id links with nothing. No rows give no rows; columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    sets = scratch.keep(document_sets(docs, n), "sets")
    # equal sets have one name, so a group of copies is one member of each list
    named = sets.filter("size > 0 and doc_id is not null")
    ids = scratch.keep(named.groupBy("a", "b").agg(F.min("doc_id").alias("id")), "classes")
    frequent = spark.sparkContext.broadcast(frequent_numbers(docs, scratch, n, share))
    lists = prefixes(docs.filter("doc_id is not null"), n, share, frequent).repartition("gram").dropDuplicates(["gram", "a"])
    same = W.partitionBy("gram")  # no join of the lists with their own groups, as both sides would cut every text
    members = lists.select("a", F.min("a").over(same).alias("bucket"), F.count(F.lit(1)).over(same).alias("n")).filter("n > 1").select("bucket", "a").distinct()
    reps = named.select("doc_id", "a", "b", "size", "sketch").join(ids.select("a", "b", F.col("id").alias("doc_id")), ["a", "b", "doc_id"]).dropDuplicates(["a", "b"])
    members = scratch.keep(members.join(reps.select("a", F.col("doc_id").alias("id"), "size", "sketch"), "a").drop("a"), "members")
    chosen = scratch.keep(may_be_similar(members, scratch, share, block_rows), "chosen")
    sized = chosen.join(chosen.groupBy("kind", "grp").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("partners", -F.col("id"))).alias("top")), ["kind", "grp"])
    # a group beyond a block: in the first round every block holds the set with most possible partners too; what that round does
    # not join to it meets all others in a second round, block by block
    parts = F.when(F.col("n") > block_rows, F.ceil(F.col("n") / block_rows)).otherwise(1).cast("long")
    sized = sized.withColumn("parts", parts).filter("n > 1")
    own = sized.filter("parts = 1 or id <> top").select("kind", "grp", F.pmod(F.xxhash64("id"), F.col("parts")).alias("half"), F.lit(False).alias("pivot"), "id")
    tops = sized.filter("parts > 1 and id = top").select("kind", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("half"), F.lit(True).alias("pivot"), "id")
    rows = own.unionByName(tops).withColumn("side", F.lit(0).cast("long"))
    tried = scratch.keep(links_by_tries(with_grams(docs, rows, n), share, frequent), "tried-1")
    links = tried.filter("dst is not null").select("src", "dst")
    apart = tried.filter("dst is null").select("kind", "grp", F.col("src").alias("id"))
    if not apart.isEmpty():
        flagged = sized.filter("parts > 1").join(apart.withColumn("apart", F.lit(True)), ["kind", "grp", "id"], "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
        counts = flagged.groupBy("kind", "grp").agg(F.count_if("apart").alias("apart_n"), F.count_if(~F.col("apart")).alias("joined_n")).filter("apart_n > 0")
        blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("long")
        placed = flagged.select("kind", "grp", "id", "apart").join(counts, ["kind", "grp"]).withColumn("few", blocks("apart_n")).withColumn("all", F.col("few") + blocks("joined_n"))
        spot = F.when(F.col("apart"), F.pmod(F.xxhash64("id"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("id"), F.greatest(F.col("all") - F.col("few"), F.lit(1))))
        # blocks 0..few-1 hold what stands apart; they meet one another, themselves and every block of what is joined
        meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("apart"), F.col("all")).otherwise(F.col("few")) - 1)
        placed = placed.withColumn("side", spot).withColumn("other", F.explode(meets))
        half = F.least("side", "other") * F.col("all") + F.greatest("side", "other")
        placed = scratch.keep(placed.select("kind", "grp", half.alias("half"), "side", F.lit(False).alias("pivot"), "id"), "placed")
        more = scratch.keep(links_by_tries(with_grams(docs, placed, n), share, frequent), "tried-2")
        links = links.unionAll(more.select("src", "dst"))
    groups = components(links, scratch, "components").withColumnRenamed("id", "rep")
    out = sets.join(ids.withColumnRenamed("id", "rep"), ["a", "b"], "left").join(groups, "rep", "left")
    joined = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(joined, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_documents(docs, Scratch(spark, "op9"), 4, (85, 100))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates: five-word n-grams, similarity of 0.8 or more."""
    groups = near_documents(docs, Scratch(spark, "near-stage"))
    go = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    go = Scratch(spark, "near-stage").keep(go, "go")
    return docs.join(checked_broadcast(go, go.count()), "doc_id", "left_anti")

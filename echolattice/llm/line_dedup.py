"""Line dedup: segment-partition edit join.

Two lines link if they are within one edit for each PER characters of the shorter one, EDITS at most: the one law for lines of
any length, by which lines under PER characters link with equal ones alone. A line of e edits is cut into e + 1 segments; of two
linked lines, the longer has one of the shorter one's segments whole, at a place that its index and the difference of the
lengths bound. Segments and the substrings at those places are keys, with the length and the segment's number. Lines that a
key joins, directly or over others, are a part; in a part, pairs that a probe hits are verified by a banded bit-parallel edit
distance. Linked lines, directly or over others, are a class; its first occurrence stays (by doc_id, then line number), the
others go. Lines under LEAST characters, such as brackets and page numbers, are no passages: they stay and count for nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.llm.common import Forest, Rolling, Scratch, candidates, connected_components, fresh, keyed, mix64, quoted, runs, ship, small, text_slices

EDITS, PER, LEAST = 2, 20, 12
#: Characters of a block, about.
BLOCK = 2_000_000
#: Columns of a line's character counts, for the bound on edits.
BAG = 64


def allowed(size, edits: int = EDITS, per: int = PER):
    """Edits within which a line of so many characters, the shorter of two, links."""
    return np.minimum(np.asarray(size) // per, edits)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most edits: what is alike at either end is passed over, the rest is run in a band.

    The band's 2 * edits + 1 diagonals are the bits of one small number; bit k stands for row i = column + k - edits.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    n, m = 0, len(a)
    while n < m and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    while a and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a:
        return len(b) <= edits
    m, n, w = len(a), len(b), 2 * edits + 1
    ones = (1 << w) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + edits + 1)
    # down: rows whose cell is one more, or one less, than the cell above, in the column before. In column 0 all rows from 1
    # are one more. Rows that don't exist (0 and above) are alike and grow with the column, as row 0 does.
    full = (1 << (w + 1)) - 1
    down_plus, down_minus = ones << (edits + 1) & full, 0
    row = min(edits, m)  # of the cell whose value is score: the band's lowest, then the last row's
    score, level = row, n - max(0, m - edits)
    for j, c in enumerate(b, 1):
        # vectors move down a row with the column: bit k is now row j + k - edits
        match = where.get(c, 0) >> j & ones
        plus, minus = down_plus >> 1, down_minus >> 1
        diag_zero = ((((match & plus) + plus) ^ plus) | match | minus) & ones
        right_plus = minus | ~(diag_zero | plus) & ones
        right_minus = diag_zero & plus
        if row < m:
            score += not diag_zero >> (w - 1) & 1
            row += 1
        else:
            k = m - j + edits
            score += (right_plus >> k & 1) - (right_minus >> k & 1)
        if score > edits + min(level, n - j):  # it falls by one a column at most, and only along the last row
            return False
        down_plus = (right_minus << 1 | ~(diag_zero | right_plus << 1)) & full
        down_minus = diag_zero & right_plus << 1
    return score <= edits


# ---- lines and their keys -------------------------------------------------------------------------------------


def _codes(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, and each text's first."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return codes, leads[off]


def line_bounds(off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all lines of texts that start at off[:-1] and end at off[1:]."""
    breaks = np.flatnonzero(codes == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([off[1:], breaks]))
    return starts, ends


def segment_keys(hashes: Rolling, start: np.ndarray, size: np.ndarray, edits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines of these starts and sizes, and whose they are: segments of lines as long, and of up to `edits` characters less.

    Segment i (from 1) of a line of length L and e edits starts at p; a line of length L + d can only have it at a place from
    max(p - (i - 1), p + d - (e + 1 - i)) to min(p + (i - 1), p + d + (e + 1 - i)), else more edits would be needed on one
    side of it than are left when the sides are weighed together. For d = 0 the line's own segments are among them.
    """
    keys, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(edits + 1):
        least = allowed(size - d, edits, per)
        for e in range(max(d, 1), edits + 1):
            own = np.flatnonzero(least == e)
            if not len(own):
                continue
            at, whole, parts = start[own], size[own], e + 1
            length = whole - d
            base, longer = length // parts, length % parts
            for i in range(1, parts + 1):
                p = (i - 1) * base + np.maximum(0, i - 1 - (parts - longer))
                seg = base + (i > parts - longer)
                for q in range(max(-(i - 1), d - (parts - i)), min(i - 1, d + parts - i) + 1):
                    x = at + np.clip(p + q, 0, whole - seg)
                    keys.append(mix64(hashes(x, x + seg) ^ (length.astype(np.uint64) << np.uint64(8)) + np.uint64(i)).view(np.int64))
                    rows.append(own)
    return np.concatenate(keys), np.concatenate(rows)


def line_id(line: str) -> int:
    """A line's 64-bit name among candidates: Spark's xxhash64 of its text."""
    import xxhash

    x = xxhash.xxh64_intdigest(line.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def line_names(line: Column) -> dict[str, Column]:
    """A line's 128-bit name, in two columns; the first is line_id's."""
    return {"line": F.xxhash64(line), "line2": F.xxhash64(F.lit("line"), line)}


def _ids(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = codes.astype("<u4").tobytes()
    return np.array([line_id(raw[4 * a : 4 * b].decode("utf-32-le")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def _hashes(codes: np.ndarray) -> Rolling:
    return Rolling(mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _line_keys(edits: int, per: int):
    def run(batches):
        def items():
            seen: set[int] = set()  # lines of this partition: copies in it are keyed once
            for b in batches:
                for _, off, data in text_slices(b.column(0)):
                    codes, at = _codes(off, data)
                    starts, ends = line_bounds(at, codes)
                    long = np.flatnonzero(ends - starts >= per)
                    if not len(long):
                        continue
                    ids = _ids(codes, starts[long], ends[long])
                    new = []
                    for k, x in enumerate(ids.tolist()):
                        if x not in seen:
                            seen.add(x)
                            new.append(k)
                    long, ids = long[new], ids[new]
                    keys, rows = segment_keys(_hashes(codes), starts[long], (ends - starts)[long], edits, per)
                    yield keys, ids[rows], np.ones(len(keys), np.int64)

        yield from keyed(items())

    return run


def probe_hits(lines: list[str], edits: int, per: int):
    """(i, others): for each line the later ones, by length, that share a key with it. The lines' order by length comes first."""
    size = np.array([len(x) for x in lines], np.int64)
    order = np.argsort(size, kind="stable")
    codes = np.frombuffer("".join(lines[k] for k in order).encode("utf-32-le"), "<u4")
    sizes = size[order]
    keys, rows = segment_keys(_hashes(codes), np.cumsum(sizes) - sizes, sizes, edits, per)
    place = np.lexsort((rows, keys))
    keys, rows = keys[place], rows[place]
    once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, rows = keys[once], rows[once]
    end = np.searchsorted(keys, keys, "right")
    yield order
    more = np.flatnonzero(end - np.arange(len(keys)) > 1)  # members of a key that have later ones
    more = more[np.argsort(rows[more], kind="stable")]
    cuts = np.flatnonzero(np.diff(rows[more], prepend=-1, append=-1))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = more[x:y]
        yield int(rows[own[0]]), np.unique(np.concatenate([rows[k + 1 : end[k]] for k in own.tolist()]))


def linked_lines(lines: list[str], edits: int, per: int = PER, side: np.ndarray | None = None, count: list[int] | None = None):
    """A forest (i, j) of the lines that link; of the pairs that share a key, those whose ends are joined, or whose character counts differ too much, aren't verified.

    side: only pairs across. count[0] grows with the pairs verified.
    """
    if not lines:
        return
    bags = np.zeros((len(lines), BAG), np.int32)
    for k, x in enumerate(lines):
        bags[k] = np.bincount(np.frombuffer(x.encode("utf-32-le"), "<u4") % BAG, minlength=BAG)
    hits = probe_hits(lines, edits, per)
    order = next(hits)
    forest = Forest(len(lines))
    for a, others in hits:
        i, near = order[a], order[others]
        most = int(allowed(len(lines[i]), edits, per))
        near = near[forest.label[near] != forest.label[i]]
        if side is not None:
            near = near[side[near] != side[i]]
        if len(near):
            near = near[np.abs(bags[near] - bags[i]).sum(axis=1) <= 2 * most]
        for j in near:
            if forest.label[i] != forest.label[j]:
                if count is not None:
                    count[0] += 1
                if within(lines[i], lines[j], most):
                    forest.join(i, j)
                    yield int(i), int(j)


def line_classes(docs: DataFrame, scratch: Scratch, edits: int = EDITS, per: int = PER) -> DataFrame:
    """(line, line2, class) for the lines of docs(text) that link with a different one; lines by their names, classes by numbers."""
    ship(docs.sparkSession)
    parts, shared = candidates(docs.select("text"), _line_keys(edits, per), scratch)
    members = scratch.write(parts.select(F.col("node").alias("line"), F.col("component").alias("part")))
    texts = docs.select(F.explode(F.split("text", "\n")).alias("text")).where(F.length("text") >= per).withColumns(line_names(F.col("text")))
    texts = texts.join(small(members), "line").dropDuplicates(["line", "line2"])
    texts = scratch.write(texts.select("part", "line", "line2", "text", F.length("text").alias("chars"), F.monotonically_increasing_id().alias("node")))
    # A part of at most BLOCK characters is one block. In a larger one, lines meet by their keys: keys of few characters share
    # blocks by hash, and a key of more is cut by the hash of the line, where each pair of cuts is a task.
    large = texts.groupBy("part").agg(F.sum("chars").alias("all")).where(F.col("all") > BLOCK).select("part")
    large = small(scratch.write(large))
    whole = texts.join(large, "part", "left_anti").select(F.xxhash64(F.lit("part"), "part").alias("group"), F.lit(1).alias("cuts"), "node", "text")
    split = texts.join(large, "part", "left_semi")
    met = scratch.write(split.join(shared.select("key", F.col("id").alias("line")).distinct(), "line").select("key", "node", "chars"))
    heavy = scratch.write(met.groupBy("key").agg(F.ceil(F.sum("chars") / BLOCK).cast("int").alias("cuts")).where("cuts > 1"))
    light = met.join(small(heavy), "key", "left_anti")
    buckets = max(1, -(-(light.agg(F.sum("chars")).first()[0] or 0) // BLOCK))
    few = light.select(F.xxhash64(F.lit("keys"), F.pmod(F.xxhash64("key"), F.lit(buckets))).alias("group"), F.lit(1).alias("cuts"), "node").distinct()
    many = met.join(small(heavy), "key").select(F.xxhash64(F.lit("key"), "key").alias("group"), "cuts", "node")
    blocks = whole.unionByName(few.unionByName(many).join(split.select("node", "text"), "node"))
    cut = blocks.withColumn("cut", F.pmod(F.xxhash64("node"), "cuts").cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumns({"a": F.least("cut", "other"), "b": F.greatest("cut", "other")})
    side = F.when(F.col("a") == F.col("b"), 0).when(F.col("cut") == F.col("a"), 1).otherwise(2)
    points = pairs.select(F.xxhash64("group", "a", "b").alias("task"), side.alias("side"), "node", "text").repartition("task").sortWithinPartitions("task", "node")

    def verify(batches):
        for t in runs(batches):
            if t.num_rows > 1:
                ids, side = t.column("node").to_numpy(), t.column("side").to_numpy()
                found = list(linked_lines(t.column("text").to_pylist(), edits, per, side if side.any() else None))
                yield pa.RecordBatch.from_arrays([pa.array(ids[[x[k] for x in found]] if found else [], pa.int64()) for k in (0, 1)], names=["a", "b"])

    links = scratch.write(points.mapInArrow(verify, "a long, b long"))
    found = connected_components(links, scratch).select("node", F.col("component").alias("class"))
    return texts.select("node", "line", "line2").join(found, "node").select("line", "line2", "class")


def dedup_lines(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = LEAST, per: int = PER) -> DataFrame:
    """docs without the lines whose class has an earlier occurrence; then two columns, the numbers of lines before and gone.

    Earlier is by doc_id (nulls last), then the text's hash, then the line number. Null and empty texts have no lines and stay
    as they are. Rows equal in doc_id and text are one document and keep the same lines. Lines under `least` characters, and
    lines without a word, stay. Other columns are passed through, whatever their names. The two columns are called _lines and
    _removed, with more underscores ahead where docs has such a column.
    """
    names = docs.columns
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("t"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = scratch.write(line_classes(source.where("text is not null").select("text"), scratch, edits, per))
    # The key below the lines, or it would be worked out for each of them.
    each = source.where("text is not null").select(key.alias("doc"), "text").select("doc.d", "doc.t", F.posexplode(F.split("text", "\n")).alias("at", "one"))
    each = each.where(F.length("one") >= least).where(F.col("one").rlike(r"[^\x20\x09-\x0D]")).withColumns(line_names(F.col("one")))
    held = scratch.write(each.select("d", "t", "at", "line", "line2"))
    # A class is its number, or the name of the one line that it is.
    linked = F.col("class").isNotNull()
    class_ = [F.coalesce("class", "line").alias("c1"), F.when(~linked, F.col("line2")).alias("c2")]
    named = scratch.write(held.join(small(classes), ["line", "line2"], "left").select("d", "t", "at", *class_))
    scratch.drop(held)
    place = F.struct("d", "t", "at")
    # Written, so that the join with a class that very many lines have is one that adaptive execution can split.
    firsts = scratch.write(named.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("c1", F.coalesce("c2", F.lit(0)).alias("c2"), F.col("c2").isNull().alias("c0"), "first"))
    flat = named.select("d", "t", "at", "c1", F.coalesce("c2", F.lit(0)).alias("c2"), F.col("c2").isNull().alias("c0"))
    gone = flat.join(small(firsts, 50_000), ["c1", "c2", "c0"]).where(place != F.col("first")).groupBy("d", "t").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    gone = scratch.write(gone)
    keyed_docs = docs.select(F.struct(*quoted(names)).alias("row"), key.alias("key")).select("row", "key.d", "key.t")
    out = keyed_docs.join(small(gone, 20_000), ["d", "t"], "left").select("row", "gone")
    # The places that stay, by a hash set of those that go: linear in the lines, which are split once.
    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.struct(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).alias("lines"))

    text = F.get(F.transform(F.array(F.split("row.text", "\n")), left), F.lit(0))
    n, removed = fresh(names, "_lines", "_removed")
    plain = F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0))
    done = out.select("row", F.coalesce(F.size("gone"), F.lit(0)).alias("removed"), F.when(F.col("gone").isNull(), F.struct(F.col("row.text").alias("text"), plain.alias("lines"))).otherwise(text).alias("new"))
    kept = [F.col("new.text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return done.select(*kept, F.col("new.lines").alias(n), F.col("removed").alias(removed))


def op10_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the text that remains, and their numbers of lines and of removed lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, Scratch(spark, "lines"))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), "text")


ORACLE = rf"""
WITH RECURSIVE
l AS (
  SELECT rid, doc_id, i, line FROM (
    SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i
    FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
named AS (SELECT * FROM l WHERE length(line) >= {LEAST} AND regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT DISTINCT line, length(line) AS n FROM named WHERE length(line) >= {PER}),
near AS (
  SELECT a.line AS x, b.line AS y FROM d a JOIN d b
    ON b.n BETWEEN a.n AND a.n + {EDITS} AND a.line <> b.line
   AND (substr(a.line, 1, a.n // 3) = substr(b.line, 1, a.n // 3) OR right(a.line, a.n // 3) = right(b.line, a.n // 3)
        OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n // 3)))
  WHERE b.n <= a.n + least({EDITS}, a.n // {PER}) AND levenshtein(a.line, b.line) <= least({EDITS}, a.n // {PER})),
edges AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
reach AS (SELECT DISTINCT x AS line, x AS other FROM edges UNION SELECT r.line, e.y FROM reach r JOIN edges e ON r.other = e.x),
cls AS (SELECT line, min(other) AS c FROM reach GROUP BY line),
occ AS (SELECT rid, doc_id, i, coalesce(c, named.line) AS c FROM named LEFT JOIN cls USING (line)),
gone AS (SELECT rid, i FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, rid, i) AS k FROM occ) WHERE k > 1),
left_over AS (
  SELECT l.rid, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.rid IS NULL) AS text, count(*) AS n, count(gone.rid) AS k
  FROM l LEFT JOIN gone ON l.rid = gone.rid AND l.i = gone.i GROUP BY l.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_removed,
       CASE WHEN n IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN left_over o USING (rid)
"""

"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' rows of a tree: domain, language, source. A budget of tokens (words) is divided from the root down in
proportion to the weights. No node gets more than it holds, which is its documents' tokens times the epochs allowed; what a
node can't take goes to its siblings, and only what all siblings can't take is missing at their parent, which was itself
never given more than they hold. A leaf then takes the prefix of its tokens in the seeded order of its epochs: whole epochs,
then the documents of the next whose running total stays within the budget. Documents aren't cut: a leaf's budget that its next
document would overshoot is left unspent, less than one document a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolattice.llm.common import Scratch, fresh, quoted

LEVELS = ("domain", "lang", "source")
#: Weights by level and name among siblings; a name that isn't listed has weight 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
#: Budget in hundredths of all tokens; times that a document may be taken; documents of a bucket, about.
SHARE, EPOCHS, BUCKET = 60, 2, 2_000
#: The plan is made on the driver: weights are a list that people write, and its leaves are at most so many.
MOST_LEAVES = 100_000


def split_budget(budget: int, weights: list[int], room: list[int]) -> list[int]:
    """Whole tokens for each sibling: in proportion to the weights, none above its room, all of the budget if the rooms hold it.

    Siblings whose share is above their room are filled and leave; the others divide what remains anew, until all shares
    fit. Tokens that rounding leaves go to the largest remainders, then the first siblings with room.
    """
    out, left = [0] * len(weights), [i for i, r in enumerate(room) if r > 0]
    budget = min(budget, sum(room))
    while left:
        total = sum(weights[i] for i in left)
        if total <= 0:
            weights, total = [1] * len(weights), len(left)  # what is wanted by weight is full: the rest is shared alike
        full = [i for i in left if budget * weights[i] >= room[i] * total]
        if not full:
            for i in left:
                out[i] = budget * weights[i] // total
            rest = budget - sum(out[i] for i in left)
            for i in sorted(left, key=lambda i: (-(budget * weights[i] % total), i))[:rest]:
                out[i] += 1
            return out
        for i in full:
            out[i] = room[i]
            budget -= room[i]
        left = [i for i in left if i not in set(full)]
        if budget <= 0:
            break
    return out


def leaf_budgets(leaves: dict[tuple[str, ...], int], budget: int, epochs: int, weights: dict[str, dict[str, int]]) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf (a path of names) that holds so many."""
    out: dict[tuple[str, ...], int] = {}

    def give(path: tuple[str, ...], own: list[tuple[str, ...]], tokens: int) -> None:
        if len(path) == len(LEVELS):
            out[path] = tokens
            return
        names = sorted({x[len(path)] for x in own})
        groups = [[x for x in own if x[len(path)] == n] for n in names]
        w = [weights.get(LEVELS[len(path)], {}).get(n, 1) for n in names]
        for n, g, t in zip(names, groups, split_budget(tokens, w, [epochs * sum(leaves[x] for x in g) for g in groups]), strict=True):
            give((*path, n), g, t)

    if leaves:
        give((), list(leaves), budget)
    return out


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Four domains, by the number at the end of a source's name; domain0 without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), F.when(number == "", F.lit(0)).otherwise(number.try_cast("int") % 4))


def place_key(seed: int, epoch: Column, doc: Column, text: Column) -> Column:
    """A document's place in an epoch, 31 bits of an MD5 that any engine has; text: the text's own MD5."""
    parts = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null")), text)
    return F.shiftright(F.conv(F.substring(F.md5(parts.cast("binary")), 1, 8), 16, 10).cast("long"), 1)


def mix(docs: DataFrame, scratch: Scratch, domain: Column, share: int = SHARE, epochs: int = EPOCHS, weights: dict = WEIGHTS, seed: int = 23) -> DataFrame:
    """The rows of docs that are taken, with _epoch (from 0), _tokens and the names _domain, _lang and _source as last columns.

    Where docs has a column of such a name, the added one has more underscores ahead. A row appears once for each epoch it is taken in. Null names are one node, "(none)"; null and empty texts hold no tokens
    and cost nothing, so that they are taken where a prefix passes them. Rows that repeat an id and a text have the same
    place and are taken one by one in no particular order. Other columns are passed through.
    """
    names = docs.columns
    named = {"_domain": domain, "_lang": F.col("lang"), "_source": F.col("source")}
    held = docs.select(F.struct(*quoted(names)).alias("_row"), "doc_id", "text", *(F.coalesce(c, F.lit("(none)")).alias(k) for k, c in named.items()))
    path = ["_domain", "_lang", "_source"]
    order = lambda text: place_key(seed, F.col("_whole"), F.col("doc_id"), text)
    print_ = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    slim = scratch.write(held.select(*path, "doc_id", print_.alias("_text"), words(F.col("text")).alias("_tokens")))
    stats = slim.groupBy(*path).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")).limit(MOST_LEAVES + 1).collect()
    if len(stats) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves: give sources coarser names")
    sizes = {tuple(r[p] for p in path): r["tokens"] for r in stats}
    budgets = leaf_budgets(sizes, sum(sizes.values()) * share // 100, epochs, weights)
    rows = []
    for r in stats:
        leaf = tuple(r[p] for p in path)
        whole, rest = divmod(budgets[leaf], sizes[leaf]) if sizes[leaf] else (1, 0)
        rows.append((*leaf, int(whole), int(rest), int(-(-r["docs"] // BUCKET))))
    leaves = docs.sparkSession.createDataFrame(rows, "_domain string, _lang string, _source string, _whole int, _rest long, _buckets int")
    bucket = lambda place: F.shiftright(place * F.col("_buckets").cast("long"), 31).cast("int")
    # The bucket in which a leaf's last, partial epoch ends, and the tokens before it.
    filled = slim.join(F.broadcast(leaves), path).withColumn("_bucket", bucket(order(F.col("_text"))))
    filled = filled.groupBy(*path, "_bucket").agg(F.sum("_tokens").alias("n"), F.first("_rest").alias("_rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*path).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = filled.withColumn("before", before).where("before + n > _rest").groupBy(*path).agg(F.min(F.struct("_bucket", "before")).alias("e"))
    ends = scratch.write(ends.select(*path, F.col("e._bucket").alias("_end"), F.col("e.before").alias("_before")))
    plan = scratch.write(leaves.join(ends, path, "left"))  # a row for each leaf
    placed = held.join(F.broadcast(plan), path).withColumn("_place", order(print_)).withColumn("_bucket", bucket(F.col("_place")))
    sure = F.col("_end").isNull() | (F.col("_bucket") < F.col("_end"))
    times = F.col("_whole") + F.when(sure & (F.col("_rest") > 0), 1).otherwise(0)
    most = placed.where(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    last = placed.where((F.col("_rest") > 0) & (F.col("_bucket") == F.col("_end"))).withColumn("_n", words(F.col("text")))
    run = F.sum("_n").over(Window.partitionBy(*path).orderBy("_place", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("_run", run).where("_before + _run <= _rest").withColumn("_epoch", F.col("_whole"))
    own = [F.col("_row").getField(n).alias(n) for n in names]
    added = fresh(names, "_epoch", "_tokens", *path)
    out = most.select("_row", "text", "_epoch", *path).unionByName(last.select("_row", "text", "_epoch", *path))
    cost = [F.col("_epoch").cast("int"), words(F.col("text")), *map(F.col, path)]
    return out.select(*own, *(c.alias(n) for c, n in zip(cost, added, strict=True)))


def op8_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken, with the epoch, their tokens and their leaf."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = mix(docs, Scratch(spark, "mixing"), domain_of(F.col("source")))
    return out.select("doc_id", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("tokens"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"))


def _level(name: str, nodes: str, parents: str) -> str:
    """SQL: table `name` (parent, name, budget) from nodes(parent, name, w, room) and parents(parent, budget).

    In ascending order of room for weight, a node is full if its share of what is left is its room or more; the rest is
    divided by weight, and what rounding leaves goes to the largest remainders.
    """
    return f"""
{name}_n AS (SELECT n.*, least(budget, sum(room) OVER (PARTITION BY n.parent)) AS b FROM ({nodes}) n JOIN ({parents}) p ON n.parent = p.parent),
{name}_o AS (
  SELECT *, coalesce(sum(room) OVER (PARTITION BY parent ORDER BY room / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (PARTITION BY parent ORDER BY room / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM {name}_n),
{name}_f AS (SELECT *, (b - used) * w >= room * left_w AS filled FROM {name}_o),
{name}_r AS (
  SELECT *, b - coalesce(sum(room) FILTER (WHERE filled) OVER (PARTITION BY parent), 0) AS rem, sum(w) FILTER (WHERE NOT filled) OVER (PARTITION BY parent) AS tot FROM {name}_f),
{name}_q AS (SELECT *, CASE WHEN filled THEN room ELSE rem * w // tot END AS base, CASE WHEN filled THEN -1 ELSE rem * w % tot END AS part FROM {name}_r),
{name} AS (
  SELECT parent, name, (base + CASE WHEN NOT filled AND row_number() OVER (PARTITION BY parent ORDER BY part DESC, name) <= rem - sum(base) FILTER (WHERE NOT filled) OVER (PARTITION BY parent) THEN 1 ELSE 0 END)::BIGINT AS budget
  FROM {name}_q)"""


def oracle() -> str:
    weight = lambda level: "CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"
    room = f"({EPOCHS} * sum(tokens))::BIGINT"
    place = "('0x' || substr(md5('23:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT >> 1"
    return rf"""
WITH t AS (
  SELECT doc_id, text, 'domain' || (coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 4) AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
{_level("l1", f"SELECT *, {weight('domain')} AS w FROM (SELECT '' AS parent, domain AS name, {room} AS room FROM leaf GROUP BY ALL)", f"SELECT '' AS parent, sum(tokens)::BIGINT * {SHARE} // 100 AS budget FROM leaf")},
{_level("l2", f"SELECT *, {weight('lang')} AS w FROM (SELECT domain AS parent, lang AS name, {room} AS room FROM leaf GROUP BY ALL)", "SELECT name AS parent, budget FROM l1")},
{_level("l3", f"SELECT domain || '/' || lang AS parent, source AS name, {room} AS room, 1 AS w FROM leaf GROUP BY ALL", "SELECT parent || '/' || name AS parent, budget FROM l2")},
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM leaf JOIN l3 ON l3.parent = domain || '/' || lang AND l3.name = source),
placed AS (SELECT t.*, whole, rest, {place} AS place FROM t JOIN plan USING (domain, lang, source)),
last AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run
  FROM placed WHERE rest > 0)
SELECT doc_id, e::INTEGER AS epoch, tokens, domain, lang, source FROM placed, range({EPOCHS}) r(e) WHERE e < whole
UNION ALL SELECT doc_id, whole::INTEGER, tokens, domain, lang, source FROM last WHERE run <= rest
"""

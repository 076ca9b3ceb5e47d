"""Parts of the queries' SQL for DuckDB. A part is the body of a WITH clause; chain() puts some in a row."""

from __future__ import annotations


def chain(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


E_PAIRS = """
vecs AS (SELECT vec_id AS item_idx, label, embedding::DOUBLE[] AS e FROM embeddings),
unit AS (SELECT item_idx, label, list_transform(e, lambda x: x / n) AS e FROM (SELECT *, greatest(sqrt(list_dot_product(e, e)), 1e-9) AS n FROM vecs)),
pairs AS (
  SELECT a.item_idx AS query_idx, b.item_idx, a.label AS query_label, b.label AS item_label, round(1 - list_dot_product(a.e, b.e), 6) AS distance
  FROM unit a JOIN unit b ON a.item_idx <> b.item_idx)"""

#: Queries without another item of their label are left out.
ANSWERABLE = "query_idx IN (SELECT query_idx FROM pairs WHERE query_label = item_label AND query_idx <> item_idx)"
_WINDOWS = """
  SELECT *, row_number() OVER w AS rank, (query_label = item_label)::INTEGER AS rel, lag(distance) OVER w AS before
  FROM (SELECT *, CASE WHEN isfinite(distance) THEN distance ELSE 'inf'::DOUBLE END AS dkey FROM pairs WHERE query_idx <> item_idx)
  WINDOW w AS (PARTITION BY {by} ORDER BY dkey, item_idx)"""
RANKED_ANSWERABLE = f"ranked AS ({_WINDOWS.format(by='query_idx').replace('WHERE ', f'WHERE {ANSWERABLE} AND ')})"
RANKED = f"ranked AS ({_WINDOWS.format(by='query_idx')})"
RANKED_BY_MATRIX = f"ranked AS ({_WINDOWS.format(by='matrix, query_idx')})"

_PER_QUERY = """
per_query AS (
  SELECT {by}, sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0 END) / sum(rel) AS ap, min(CASE WHEN rel = 1 THEN rank END) AS r1,
         sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / least(10, count(*)) AS p_at_k, sum(rel)::BIGINT AS n_relevant,
         sum(CASE WHEN isfinite(distance) AND isfinite(before) AND distance = before THEN 1 ELSE 0 END) AS ties,
         sum(CASE WHEN isfinite(distance) AND isfinite(before) THEN 1 ELSE 0 END) AS valid_pairs
  FROM (SELECT *, sum(rel) OVER (PARTITION BY {by} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM ranked)
  GROUP BY {by})"""
PER_QUERY, PER_QUERY_BY_MATRIX = _PER_QUERY.format(by="query_idx"), _PER_QUERY.format(by="matrix, query_idx")
SUMMARY = """SELECT round(avg(ap), 6) AS map, round(avg(r1), 6) AS mr1, round(avg(p_at_k), 6) AS p_at_k, count(*) AS n_queries,
  round(CASE WHEN sum(valid_pairs) > 0 THEN sum(ties) / sum(valid_pairs) ELSE 0 END, 6) AS tie_fraction FROM per_query"""
def _matrix(name: str, rows: list[list[float]], labels: str, queries: list[int] | None = None) -> str:
    queries = list(range(len(rows))) if queries is None else queries
    return ", ".join(f"('{name}', {q}, {j}, '{labels[q]}', '{labels[j]}', {float(d)!r})" for q, row in zip(queries, rows, strict=True) for j, d in enumerate(row))


#: Matrices whose scores are known by hand.
KNOWN_ROWS = ", ".join(
    [
        _matrix("perfect", [[0, 1, 5, 6], [1, 0, 5, 6], [5, 5, 0, 1], [6, 6, 1, 0]], "AABB"),
        _matrix("mixed", [[0, 1, 2, 3], [1, 0, 2, 3], [2, 2, 0, 5], [3, 3, 5, 0]], "AABB"),
        _matrix("two", [[0, 2, 4, 1, 3, 5]], "AAABBB"),
        _matrix("rect", [[0, 1, 5, 6], [5, 5, 0, 1]], "AABB", [0, 2]),
        _matrix("self", [[99, 1, 2, 3], [1, 99, 2, 3], [2, 3, 99, 1], [3, 2, 1, 99]], "AABB"),
    ]
)
KNOWN = f"pairs AS (SELECT matrix, query_idx, item_idx, query_label, item_label, distance::DOUBLE AS distance FROM (VALUES {KNOWN_ROWS}) t(matrix, query_idx, item_idx, query_label, item_label, distance))"
_CELLS = [["0", "nan", "1", "inf"], ["nan", "0", "1", "1"], ["1", "1", "0", "-inf"], ["inf", "1", "1", "0"]]
NONFINITE_ROWS = ", ".join(f"({q}, {j}, 'A', 'A', '{d}')" for q, row in enumerate(_CELLS) for j, d in enumerate(row))
NONFINITE = f"pairs AS (SELECT query_idx, item_idx, query_label, item_label, distance::DOUBLE AS distance FROM (VALUES {NONFINITE_ROWS}) t(query_idx, item_idx, query_label, item_label, distance))"

_DRAW = "CAST('0x' || substr(md5('0:' || {0}), 1, 8) AS BIGINT)"
CELLS_BODY = """
cells AS (
  SELECT l_suppkey AS perf_id, floor(date_diff('day', DATE '1995-01-02', l_shipdate::DATE) / 7)::INTEGER AS frame, (l_partkey % 12)::INTEGER AS pitch, sum(l_quantity) AS x
  FROM lineitem GROUP BY ALL)"""
CELLS = f"WITH {CELLS_BODY} "
CATALOG_BODY = f"{CELLS_BODY}, catalog AS (SELECT s_suppkey AS perf_id, s_nationkey AS clique_id, n_frames FROM supplier LEFT JOIN (SELECT perf_id, count(DISTINCT frame) AS n_frames FROM cells GROUP BY 1) w ON w.perf_id = s_suppkey)"
CATALOG = f"WITH {CATALOG_BODY} "
DRAWN = f""",
sized AS (SELECT *, count(clique_id) OVER (PARTITION BY clique_id) AS n FROM catalog),
drawn AS (
  SELECT clique_id, row_number() OVER (ORDER BY {_DRAW.format('clique_id')}, clique_id) AS place, count(*) OVER () AS total
  FROM (SELECT DISTINCT clique_id FROM sized WHERE n > 1)) """
SPLIT = DRAWN + """,
split AS (
  SELECT clique_id, CASE WHEN place <= round_even(0.7 * total, 0) THEN 'train' WHEN place <= round_even(0.7 * total, 0) + round_even(0.1 * total, 0) THEN 'val' ELSE 'test' END AS split
  FROM drawn) """
RANDOM_PAIRS = f"""
halves AS (
  SELECT a.vec_id AS q, b.vec_id AS i, a.label AS ql, b.label AS il, {_DRAW.format("a.vec_id || ':' || b.vec_id")} / 4294967296.0::DOUBLE AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
pairs AS (
  SELECT q AS query_idx, i AS item_idx, ql AS query_label, il AS item_label, distance FROM halves
  UNION ALL SELECT i, q, il, ql, distance FROM halves)"""
DURATION_PAIRS = """
pairs AS (
  SELECT a.perf_id AS query_idx, b.perf_id AS item_idx, a.clique_id AS query_label, b.clique_id AS item_label, abs(a.n_frames - b.n_frames)::DOUBLE AS distance
  FROM catalog a JOIN catalog b ON a.perf_id <> b.perf_id)"""

DENSE = f"""{CELLS_BODY},
axis AS (SELECT max(frame) + 1 AS n FROM cells),
grid AS (SELECT perf_id, f::INTEGER AS frame, p::INTEGER AS pitch FROM (SELECT DISTINCT perf_id FROM cells), range((SELECT n FROM axis)) tf(f), range(12) tp(p)),
dense AS (SELECT perf_id, frame, pitch, coalesce(x, 0) AS x FROM grid LEFT JOIN cells USING (perf_id, frame, pitch))"""
PROFILE = """
means AS (SELECT perf_id, pitch, avg(x) AS x FROM dense GROUP BY ALL),
profile AS (
  SELECT perf_id, pitch, CASE WHEN n > 1e-9 THEN x / n ELSE x END AS x
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY perf_id)) AS n FROM means))"""
OTI = """
listed AS (SELECT perf_id, list(x ORDER BY pitch) AS v FROM profile GROUP BY 1),
turned AS (SELECT perf_id, s::INTEGER AS s, list_transform(range(12), lambda i: v[(i - s + 12) % 12 + 1]) AS v FROM listed, range(12) t(s)),
oti AS (
  SELECT a, b, arg_max(s, struct_pack(x := x, k := -s)) AS steps
  FROM (SELECT l.perf_id AS a, t.perf_id AS b, s, round(list_dot_product(l.v, t.v), 9) AS x FROM listed l JOIN turned t ON l.perf_id <> t.perf_id)
  GROUP BY a, b)"""
PATCHES = """
patches AS (
  SELECT perf_id, k::INTEGER AS patch, frame - 16 * k AS t, pitch, x
  FROM dense JOIN range((SELECT (n - 32) // 16 + 1 FROM axis)) p(k) ON frame >= 16 * k AND frame < 16 * k + 32)"""


def ftm2d(drop_dc: bool = False, length: int = 32, hop: int = 16, coefficients: int = 8) -> str:
    """Descriptors of dense: greatest value, square root, patches, the discrete Fourier transform by pitch, then by time, medians."""
    angle = f"2 * pi() * t * u / {length}"
    return f"""
scaled AS (SELECT perf_id, frame, pitch, CASE WHEN n > 1e-9 THEN sqrt(x / n) ELSE 0 END AS x FROM (SELECT *, max(x) OVER (PARTITION BY perf_id, frame) AS n FROM dense)),
by_pitch AS (
  SELECT perf_id, frame, v, sum(x * cos(2 * pi() * pitch * v / 12)) AS re, -sum(x * sin(2 * pi() * pitch * v / 12)) AS im
  FROM scaled, range(7) t(v) GROUP BY ALL),
windows AS (
  SELECT perf_id, k, frame - {hop} * k AS t, v, re, im
  FROM by_pitch JOIN range((SELECT (n - {length}) // {hop} + 1 FROM axis)) p(k) ON frame >= {hop} * k AND frame < {hop} * k + {length}),
spectra AS (
  SELECT perf_id, k, u, v, sqrt(pow(sum(re * cos({angle}) + im * sin({angle})), 2) + pow(sum(im * cos({angle}) - re * sin({angle})), 2)) AS m
  FROM windows, range({coefficients}) r(u) GROUP BY ALL),
middles AS (SELECT perf_id, (u * 7 + v)::INTEGER AS bin, {"CASE WHEN u * 7 + v = 0 THEN 0 ELSE median(m) END" if drop_dc else "median(m)"} AS x FROM spectra GROUP BY perf_id, u, v),
descriptor AS (SELECT perf_id, bin, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY perf_id)), 1e-9) AS x FROM middles)"""


#: Frames over their greatest value.
NORMAL = """
normal AS (SELECT perf_id, frame, pitch, CASE WHEN n > 1e-9 THEN x / n ELSE 0 END AS x FROM (SELECT *, max(x) OVER (PARTITION BY perf_id, frame) AS n FROM dense))"""


DESCRIPTOR_PAIRS = """
vecs AS (SELECT perf_id, s_nationkey AS label, list(x ORDER BY bin) AS e FROM descriptor JOIN supplier ON s_suppkey = perf_id GROUP BY ALL),
pairs AS (
  SELECT a.perf_id AS query_idx, b.perf_id AS item_idx, a.label AS query_label, b.label AS item_label, round(1 - list_dot_product(a.e, b.e), 6) AS distance
  FROM vecs a JOIN vecs b ON a.perf_id <> b.perf_id)"""


def states(factor: int, m: int) -> str:
    """coarse: means of blocks of frames; states: m normalised ones in a row."""
    return f"""
coarse AS (SELECT perf_id, frame // {factor} AS frame, pitch, avg(x) AS x FROM dense WHERE frame // {factor} < (SELECT n FROM axis) // {factor} GROUP BY ALL),
coarse_frames AS (
  SELECT perf_id, frame, list(CASE WHEN n > 1e-9 THEN x / n ELSE 0 END ORDER BY pitch) AS v
  FROM (SELECT *, max(x) OVER (PARTITION BY perf_id, frame) AS n FROM coarse) GROUP BY ALL),
coarse_rows AS (SELECT perf_id, list(v ORDER BY frame) AS rows FROM coarse_frames GROUP BY 1),
states AS (SELECT perf_id, i::INTEGER AS i, flatten(rows[i + 1:i + {m}]) AS s FROM (SELECT perf_id, rows, unnest(range(len(rows) - {m} + 1)) AS i FROM coarse_rows))"""


def qmax(kappa: float = 0.095, gap: float = 0.5) -> str:
    """pairs: distances of all ordered pairs from states and oti, by a walk over the rows of each plot."""
    return f"""
rolled AS (SELECT perf_id, r::INTEGER AS r, i, list_transform(range(len(s)), lambda k: s[(k // 12) * 12 + (k % 12 - r + 12) % 12 + 1]) AS s FROM states, range(12) t(r)),
apart AS (
  SELECT a, b, x.i, y.i AS j, list_distance(x.s, y.s) AS d
  FROM oti JOIN states x ON x.perf_id = a JOIN rolled y ON y.perf_id = b AND y.r = steps),
near_row AS (SELECT a, b, i, quantile_cont(d, {kappa}) AS q FROM apart GROUP BY ALL),
near_col AS (SELECT a, b, j, quantile_cont(d, {kappa}) AS q FROM apart GROUP BY ALL),
plots AS (
  SELECT a, b, i, list(d <= r.q AND d <= c.q ORDER BY j) AS hits
  FROM apart JOIN near_row r USING (a, b, i) JOIN near_col c USING (a, b, j) GROUP BY ALL),
walk AS (
  SELECT a, b, -1 AS i, list_transform(hits, lambda h: 0.0::DOUBLE) AS q1, list_transform(hits, lambda h: 0.0::DOUBLE) AS q2, 0.0::DOUBLE AS best
  FROM plots WHERE i = 0
  UNION ALL
  SELECT a, b, i, q, q1, greatest(best, list_max(q)) FROM (
    SELECT w.a, w.b, p.i, w.q1, w.best, list_transform(range(1, len(hits) + 1), lambda j:
      CASE WHEN hits[j] THEN greatest(CASE WHEN j > 1 THEN w.q1[j - 1] ELSE 0 END, CASE WHEN j > 1 THEN w.q2[j - 1] ELSE 0 END, CASE WHEN j > 2 THEN w.q1[j - 2] ELSE 0 END) + 1
           ELSE greatest(0, greatest(CASE WHEN j > 1 THEN w.q1[j - 1] ELSE 0 END, CASE WHEN j > 1 THEN w.q2[j - 1] ELSE 0 END, CASE WHEN j > 2 THEN w.q1[j - 2] ELSE 0 END) - {gap}) END) AS q
    FROM walk w JOIN plots p ON p.a = w.a AND p.b = w.b AND p.i = w.i + 1)),
scores AS (SELECT a, b, max(best) AS score FROM walk GROUP BY a, b),
one_way AS (SELECT a, b, CASE WHEN score > 0 THEN sqrt(n) / score ELSE 'inf'::DOUBLE END AS d FROM scores JOIN (SELECT perf_id, count(*) AS n FROM states GROUP BY 1) ON perf_id = b),
pairs AS (
  SELECT f.a AS query_idx, f.b AS item_idx, p.s_nationkey AS query_label, q.s_nationkey AS item_label, round(least(f.d, r.d), 6) AS distance
  FROM one_way f JOIN one_way r ON f.a = r.b AND f.b = r.a JOIN supplier p ON p.s_suppkey = f.a JOIN supplier q ON q.s_suppkey = f.b)"""


def recurrence(pairs: str, kappa: float = 0.095) -> str:
    """cells: (a, b, i, j, hit) of the plots of pairs (a, b), without transposition."""
    return f"""
chosen AS ({pairs}),
apart AS (SELECT a, b, x.i, y.i AS j, list_distance(x.s, y.s) AS d FROM chosen JOIN states x ON x.perf_id = a JOIN states y ON y.perf_id = b),
near_row AS (SELECT a, b, i, quantile_cont(d, {kappa}) AS q FROM apart GROUP BY ALL),
near_col AS (SELECT a, b, j, quantile_cont(d, {kappa}) AS q FROM apart GROUP BY ALL),
cells_hit AS (SELECT a, b, i, j, d <= r.q AND d <= c.q AS hit FROM apart JOIN near_row r USING (a, b, i) JOIN near_col c USING (a, b, j))"""


def _plot(name: str, n: int, cells) -> str:
    return f"('{name}', '{'/'.join(''.join('1' if (i, j) in cells else '0' for j in range(n)) for i in range(n))}')"


#: Plots whose scores are known by hand: 6, 0, 3, 4, and one whose gap tells the penalties apart.
PLOT_ROWS = ", ".join(
    [
        _plot("diagonal", 6, {(i, i) for i in range(6)}),
        _plot("empty", 6, set()),
        _plot("partial", 6, {(1, 1), (2, 2), (3, 3)}),
        _plot("two for one", 8, {(1, 1), (2, 3), (3, 5), (4, 7)}),
        _plot("gaps", 11, {(0, 0), (1, 1), (2, 2), (3, 3), (8, 8), (9, 9), (10, 10)}),
    ]
)


def _fold(gap_open: float, gap_extend: float) -> str:
    cell = "greatest(CASE WHEN j > 1 THEN {0}q1[j - 1] - {1} ELSE -{2} END, CASE WHEN j > 1 THEN {0}q2[j - 1] - {3} ELSE -{2} END, CASE WHEN j > 2 THEN {0}q1[j - 2] - {4} ELSE -{2} END)"
    pay = lambda row, k: f"(CASE WHEN w.{row}[j - {k}] THEN {gap_open} ELSE {gap_extend} END)"
    return f"CASE WHEN hits[j] THEN {cell.format('w.', 0, 0, 0, 0)} + 1 ELSE greatest(0, {cell.format('w.', pay('h1', 1), gap_extend, pay('h2', 1), pay('h1', 2))}) END"


def _known(name: str, gap_open: float, gap_extend: float) -> str:
    return f"""
{name} AS (
  SELECT plot, -1 AS i, list_transform(hits, lambda h: 0.0::DOUBLE) AS q1, list_transform(hits, lambda h: 0.0::DOUBLE) AS q2,
         list_transform(hits, lambda h: false) AS h1, list_transform(hits, lambda h: false) AS h2, 0.0::DOUBLE AS best
  FROM plots WHERE i = 0
  UNION ALL
  SELECT plot, i, q, q1, hits, h1, greatest(best, list_max(q)) FROM (
    SELECT w.plot, p.i, w.q1, w.h1, w.best, hits, list_transform(range(1, len(hits) + 1), lambda j: ({_fold(gap_open, gap_extend)})::DOUBLE) AS q
    FROM {name} w JOIN plots p ON p.plot = w.plot AND p.i = w.i + 1))"""


QMAX_KNOWN = f"""
WITH RECURSIVE
plots AS (
  SELECT plot, i - 1 AS i, list_transform(string_split(row, ''), lambda c: c = '1') AS hits
  FROM (SELECT plot, unnest(string_split(cells, '/')) AS row, unnest(range(1, len(string_split(cells, '/')) + 1)) AS i FROM (VALUES {PLOT_ROWS}) t(plot, cells))),
{_known("even", 0.5, 0.5)}, {_known("uneven", 0.5, 0.7)}
SELECT plot, max(e.best) AS score, max(u.best) AS unequal FROM even e JOIN uneven u USING (plot, i) GROUP BY plot
"""

TYPICAL = """
, relevant AS (SELECT * FROM ranked WHERE rel = 1), mid AS (SELECT floor(median(rank))::BIGINT AS m FROM relevant)
SELECT query_idx, item_idx, rank, m AS median_rank, distance FROM relevant, mid ORDER BY abs(rank - m), query_idx, item_idx LIMIT 1"""
#: Of relevant pairs that differ by a transposition, the one nearest the median rank of all.
TYPICAL_TRANSPOSED = """
, relevant AS (SELECT * FROM ranked WHERE rel = 1), mid AS (SELECT floor(median(rank))::BIGINT AS m FROM relevant),
typical AS (
  SELECT query_idx, item_idx, rank, m AS median_rank, distance, (SELECT count(*) - 1 FROM vecs) AS n_neighbours
  FROM relevant JOIN oti ON a = query_idx AND b = item_idx AND steps <> 0, mid ORDER BY abs(rank - m), query_idx, item_idx LIMIT 1)
SELECT * FROM typical"""
#: The relevant pair nearest the median rank, and for its query the middle one of the strangers.
EXAMPLE = """
, relevant AS (SELECT * FROM ranked WHERE rel = 1), mid AS (SELECT floor(median(rank))::BIGINT AS m FROM relevant),
typical AS (SELECT query_idx, item_idx AS cover_idx, distance AS cover_distance, rank AS cover_rank, m AS median_rank FROM relevant, mid ORDER BY abs(rank - m), query_idx, item_idx LIMIT 1),
strangers AS (
  SELECT p.item_idx, p.distance, row_number() OVER (ORDER BY p.distance, p.item_idx) AS k, count(*) OVER () AS n
  FROM pairs p JOIN typical t ON p.query_idx = t.query_idx WHERE query_label <> item_label AND isfinite(p.distance))
SELECT t.*, s.item_idx AS stranger_idx, s.distance AS stranger_distance FROM typical t, strangers s WHERE k = n // 2 + 1"""
STRANGER = """
, strangers AS (
  SELECT query_idx, item_idx, distance, row_number() OVER (PARTITION BY query_idx ORDER BY distance, item_idx) AS k, count(*) OVER (PARTITION BY query_idx) AS n
  FROM pairs WHERE query_label <> item_label AND isfinite(distance))
SELECT query_idx, item_idx, distance FROM strangers WHERE k = n // 2 + 1"""

#: The first clique's first two performances and the first of another clique, singletons first; frames that are nearly alike.
EXPORT = """
, first AS (
  SELECT s_suppkey AS p, s_nationkey AS c, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, count(*) OVER (PARTITION BY s_nationkey) > 1 AS several
  FROM supplier WHERE s_suppkey IN (SELECT perf_id FROM cells)),
me AS (SELECT p, c FROM first WHERE place = 1 ORDER BY several DESC, c LIMIT 1),
shown AS (
  (SELECT 'mate' AS kind, me.p AS a, f.p AS b FROM first f, me WHERE f.c = me.c AND f.p <> me.p ORDER BY place LIMIT 1)
  UNION ALL (SELECT 'stranger', me.p, f.p FROM first f, me WHERE f.c <> me.c ORDER BY several, f.c, place LIMIT 1)),
units AS (SELECT perf_id, frame, list_transform(v, lambda x: CASE WHEN n > 1e-9 THEN x / n ELSE x END) AS u FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM coarse_frames)),
alike AS (SELECT kind, a, b, x.frame::INTEGER AS i, y.frame::INTEGER AS j, round(list_dot_product(x.u, y.u), 2) AS similarity FROM shown JOIN units x ON x.perf_id = a JOIN units y ON y.perf_id = b)
SELECT * FROM alike WHERE similarity >= 0.95"""

#: Runs of two collections, one of them no better than chance.
REPORT_ROWS = ", ".join(
    [
        "('random_full', 'random', 'full', 15000, 13000, 0.0014, 1183.9, 0.0008, 0.0005)",
        "('duration_full', 'duration', 'full', 15000, 13000, 0.0024, 1043.7, 0.0017, 0.489)",
        "('ftm2d_full', 'ftm2d', 'full', 15000, 13000, 0.0368, 342.6, 0.051, 0.0028)",
        "('random_sub50', 'random', 'subsample', 650, 650, 0.0294, 46.6, 0.0237, 0.0)",
        "('broken_sub50', 'ftm2d', 'subsample', 650, 650, 0.0294, 46.0, 0.02, 0.0)",
        "('qmax_sub50', 'qmax', 'subsample', 650, 650, 0.5585, 4.1, 0.598, 0.3489)",
    ]
)
REPORT = f"""
WITH t AS (SELECT * FROM (VALUES {REPORT_ROWS}) t(run_name, method, kind, n_items, n_queries, map, mr1, p_at_k, tie_fraction)),
g AS (SELECT *, format('{{}} ({{:,}} items, {{:,}} queries)', kind, n_items, n_queries) AS collection FROM t),
f AS (SELECT collection, arg_min(map, run_name) AS floor FROM g WHERE method = 'random' GROUP BY 1)
SELECT collection, run_name, method, regexp_replace(run_name, '(_full|_sub50|_test)$', '') AS label, map::DOUBLE AS map, mr1::DOUBLE AS mr1, p_at_k::DOUBLE AS p_at_k,
       tie_fraction::DOUBLE AS tie_fraction, floor::DOUBLE AS floor, coalesce(method <> 'random' AND map <= floor, false) AS at_floor
FROM g LEFT JOIN f USING (collection)"""

#: Runs of a report by the fixed order of collections, bars from the lowest score up, with the floor of each.
BARS = f"""
WITH t AS (SELECT * FROM (VALUES {REPORT_ROWS}) t(run_name, method, kind, n_items, n_queries, map, mr1, p_at_k, tie_fraction)),
f AS (SELECT kind, arg_min(map, run_name) AS floor FROM t WHERE method = 'random' GROUP BY 1)
SELECT list_position(['full', 'split', 'subsample'], kind)::INTEGER AS panel, kind, row_number() OVER (PARTITION BY kind ORDER BY map, run_name)::INTEGER AS bar,
       regexp_replace(run_name, '(_full|_sub50|_test)$', '') AS label, map::DOUBLE AS map, floor::DOUBLE AS floor
FROM t LEFT JOIN f USING (kind)"""

METADATA = '{"W_1": {"P_1": {"work_title": "One", "perf_artist": "A", "work_id": "W_1", "perf_id": "P_1"}, "P_2": {"work_title": "One", "work_id": "W_1", "perf_id": "P_2"}}, "W_9": {"P_9": {"perf_artist": "C"}}}'
FILES = ["/raw/hpcp/W_1_hpcp/P_1_hpcp.h5", "/raw/hpcp/W_1_hpcp/P_2_hpcp.h5", "/raw/hpcp/W_9_hpcp/P_9_hpcp.h5"]
MANIFEST = f"""
WITH m AS (
  SELECT c AS clique_id, p AS perf_id, coalesce(j->c->p->>'work_title', '') AS work_title, coalesce(j->c->p->>'perf_artist', '') AS perf_artist
  FROM (SELECT j, c, unnest(json_keys(j->c)) AS p FROM (SELECT j, unnest(json_keys(j)) AS c FROM (SELECT '{METADATA}'::JSON AS j)))),
f AS (SELECT path, regexp_extract(path, '([^/]+)_hpcp/([^/]+)_hpcp\\.h5$', 1) AS clique_id, regexp_extract(path, '([^/]+)_hpcp/([^/]+)_hpcp\\.h5$', 2) AS perf_id FROM (SELECT unnest({FILES!r}) AS path))
SELECT perf_id, clique_id, path, work_title, perf_artist FROM f JOIN m USING (clique_id, perf_id)"""

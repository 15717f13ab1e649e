"""DuckDB SQL that gives the rows of each query in `queries`, from common table expressions."""

from __future__ import annotations

from sessionloom.config import CO_EVENTS, TYPES, Config

C = Config()
EACH = ("", *(f"_{t}" for t in TYPES))
KINDS = tuple(CO_EVENTS)


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(map(str, values))})"


def _kind(name: str) -> str:
    k = CO_EVENTS[name]
    return f"(type = {k.first} AND {_in('type_next', k.second)} AND abs(time_to_next) <= {k.within})"


def _first_n() -> str:
    return "CASE kind " + " ".join(f"WHEN '{n}' THEN {k.first_n}" for n, k in CO_EVENTS.items()) + " END"


def _trunc(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


def _pairs_of(source: str) -> str:
    return f"""SELECT a.session, a.aid, a.ts, a.type, b.aid AS aid_next, b.ts AS ts_next, b.type AS type_next, b.ts - a.ts AS time_to_next
FROM (SELECT DISTINCT * FROM {source}) a JOIN (SELECT DISTINCT * FROM {source}) b ON a.session = b.session
WHERE NOT (a.aid = b.aid AND a.ts = b.ts AND a.type = b.type) AND b.ts - a.ts BETWEEN -86400 AND 86400"""


def _long(pairs: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS kind, aid, aid_next, count(*) AS count FROM {pairs} WHERE {_kind(n)} GROUP BY aid, aid_next" for n in KINDS
    )


def _knn(items: str) -> str:
    return f"""SELECT aid, aid_next, dist, row_number() OVER (PARTITION BY aid ORDER BY dist, aid_next) AS rank FROM (
SELECT a.aid, b.aid AS aid_next, list_sum([(a.vector[i] - b.vector[i]) ** 2 FOR i IN range(1, len(a.vector) + 1)]) AS dist
FROM {items} a, {items} b) QUALIFY rank <= {C.knn}"""


def _popularity(name: str, cluster: str, keep: bool) -> str:
    counts = {}
    for i, t in enumerate(TYPES):
        counts[f"rank_{t}_{name}"] = f"type = {i}"
        counts[f"rank_{t}_7d_{name}"] = f"type = {i} AND ts > (SELECT max(ts) - {C.popular_days * 86400} FROM ev)"
    counted = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in counts.items())
    ranked = ", ".join(
        f"least(row_number() OVER (PARTITION BY cl ORDER BY {n} DESC, aid), {C.popular_clip}) AS {n}" for n in counts
    )
    sql = f"SELECT cl, aid, {ranked} FROM (SELECT {cluster} AS cl, aid, {counted} FROM ev GROUP BY 1, 2)"
    return f"SELECT * FROM ({sql}) WHERE least({', '.join(counts)}) <= {C.popular_keep}" if keep else sql


def _items() -> str:
    typed = []
    for i, t in enumerate(TYPES):
        typed += [
            f"CAST(coalesce(sum(n) FILTER (type = {i}), 0) AS BIGINT) AS n_aid_{t}",
            f"max(last) FILTER (type = {i}) AS max_ts_aid_{t}",
            f"min(ord) FILTER (type = {i}) AS ts_order_aid_{t}",
        ]
    return f"""SELECT session, aid, CAST(sum(n) AS BIGINT) AS n_aid, max(last) AS max_ts_aid, {', '.join(typed)} FROM (
SELECT session, aid, type, count(*) AS n, max(ts) AS last, row_number() OVER (PARTITION BY session, type ORDER BY max(ts) DESC, aid) AS ord
FROM ev GROUP BY session, aid, type) GROUP BY session, aid"""


def _ranks() -> str:
    def ranked(c: str) -> str:
        return f"row_number() OVER (PARTITION BY session ORDER BY {c} DESC, aid)"

    lasts = "max(max_ts_aid) OVER (PARTITION BY session)", "min(max_ts_aid) OVER (PARTITION BY session)"
    return f"""SELECT *, CAST(round(100.0::DOUBLE * ts_order_aid / max(ts_order_aid) OVER (PARTITION BY session)) AS BIGINT) AS ts_order_aid_rel,
CAST(round((hi - max_ts_aid) * 100.0::DOUBLE / greatest(hi - lo, 3600)) AS BIGINT) AS ts_aid_rel_pos_in_session,
coalesce(CAST((n_aid_carts > 0 AND n_aid_orders = 0) OR max_ts_aid_carts > max_ts_aid_orders AS INTEGER), 0) AS left_in_cart FROM (
SELECT *, {ranked('max_ts_aid')} AS ts_order_aid, {ranked('n_aid')} AS rank_by_n_aid, {ranked('n_aid_carts')} AS rank_by_n_aid_carts,
{ranked('n_aid_orders')} AS rank_by_n_aid_orders, {lasts[0]} AS hi, {lasts[1]} AS lo FROM items)"""


def _truncated(last: int, frequent: int) -> str:
    tests = [f"ts_order_aid_{t} <= {last}" for t in TYPES] + [f"rank_by_n_aid{x} <= {frequent}" for x in ("", "_carts", "_orders")]
    return " OR ".join(f"coalesce({t}, false)" for t in tests)


ITEM_COLUMNS = [
    "n_aid", "max_ts_aid", *(f"{p}_{t}" for t in TYPES for p in ("n_aid", "max_ts_aid", "ts_order_aid")), "ts_order_aid",
    "rank_by_n_aid", "rank_by_n_aid_carts", "rank_by_n_aid_orders", "ts_order_aid_rel", "ts_aid_rel_pos_in_session", "left_in_cart",
]
PAIR_COLUMNS = [f"{k}_{f}" for k in KINDS for f in ("count", "count_pop", "perc_pop", "rank", "count_rel")]
KNN_COLUMNS = [f"{p}_w2vec_{s}" for s in ("all", "1_2") for p in ("dist", "rank")]


def _trim() -> str:
    orders = ", ".join(["rank_by_n_aid", "ts_order_aid", *(f"ts_order_aid_{t}" for t in TYPES)])
    step = f"({C.trim_first - C.trim_least}::DOUBLE / {C.trim_at_order - 1})"
    allowed = f"greatest({C.trim_first}::DOUBLE - {step} * (least({orders}) - 1), {C.trim_least}::DOUBLE)"
    co = ", ".join(f"{k}_rank" for k in KINDS)
    return f"""SELECT * FROM expanded WHERE aid = aid_next OR coalesce(least({co}) <= {allowed}, false)
OR coalesce(least(rank_w2vec_all, rank_w2vec_1_2) <= {allowed}, false)"""


def _collapsed() -> dict[str, dict[str, str]]:
    own = lambda c: f"CASE WHEN aid = aid_next THEN {c} WHEN {c} IS NOT NULL THEN 0 END"
    big = lambda x: f"CAST({x} AS BIGINT)"
    self_, events, co, knn = {"aid_next_is_aid": "count(*) FILTER (aid = aid_next)"}, {"n_uniq_aid": "count(*)"}, {}, {}
    for n, c in {"slf_n": "n_aid", **{f"slf_n_{t}": f"n_aid_{t}" for t in TYPES}, "slf_left_in_cart": "left_in_cart"}.items():
        self_[n] = big(f"coalesce(sum({c}) FILTER (aid = aid_next), 0)")
    for x in EACH:
        self_[f"slf_max_ts{x}"] = f"max({own(f'max_ts_aid{x}')})"
        self_[f"slf_ts_order{x}"] = f"min({own(f'ts_order_aid{x}')})"
        events[f"n_aid{x}"] = big(f"sum(n_aid{x})")
        events[f"max_ts_aid{x}"] = f"max(max_ts_aid{x})"
        events[f"ts_order_aid{x}"] = f"min(ts_order_aid{x})"
    for x in ("", "_carts", "_orders"):
        self_[f"slf_rank_by_n{x}"] = f"min({own(f'rank_by_n_aid{x}')})"
    self_["slf_ts_rel_pos_in_session"] = f"min({own('ts_aid_rel_pos_in_session')})"
    self_["slf_ts_order_rel"] = f"min({own('ts_order_aid_rel')})"
    for t in TYPES:
        events[f"n_uniq_aid_{t}"] = f"count(*) FILTER (n_aid_{t} > 0)"
    for x in ("", "_orders"):
        events[f"mean_max_ts_aid{x}"] = _trunc(f"avg(max_ts_aid{x})")
    for c in ("ts_order_aid_rel", "rank_by_n_aid"):
        events[c] = f"min({c})"
    events["ts_aid_rel_pos_in_session"] = _trunc("avg(ts_aid_rel_pos_in_session)")
    for k in KINDS:
        co[f"{k}_count"] = big(f"sum({k}_count)")
        for f in ("count_pop", "perc_pop", "rank", "count_rel"):
            co[f"{k}_{f}"] = _trunc(f"sum({k}_{f} * {k}_count)::DOUBLE / sum({k}_count)::DOUBLE")
    for s in ("all", "1_2"):
        knn[f"n_w2vec_{s}"] = f"count(*) FILTER (rank_w2vec_{s} > 0)"
        knn[f"dist_w2vec_{s}"] = _trunc(f"avg(dist_w2vec_{s})")
        knn[f"rank_w2vec_{s}"] = _trunc(f"avg(rank_w2vec_{s})")
        knn[f"best_rank_w2vec_{s}"] = f"min(rank_w2vec_{s})"
    return {"self": self_, "events": events, "co": co, "knn": knn}


COLLAPSED = _collapsed()


def _group(*parts: str) -> str:
    columns = ", ".join(f"{sql} AS {n}" for p in parts for n, sql in COLLAPSED[p].items())
    return f"SELECT session, aid_next, {columns} FROM trimmed GROUP BY session, aid_next"


RAW = [f"{p}max_ts{m}{x}" for p, m in (("", "_aid"), ("slf_", "")) for x in EACH] + [
    "mean_max_ts_aid", "mean_max_ts_aid_orders", "min_ts_session", "max_ts_session"
]


def _recency() -> dict[str, str]:
    start, end = "min_ts_session", "max_ts_session"
    out = {f"since_ts_aid{x}": f"{end} - max_ts_aid{x}" for x in EACH}
    out |= {f"slf_since_ts{x}": f"{end} - slf_max_ts{x}" for x in EACH}
    out |= {f"since_session_start_ts_aid{x}": f"max_ts_aid{x} - {start}" for x in ("", "_orders")}
    for c in ("max_ts_aid", "mean_max_ts_aid", "mean_max_ts_aid_orders"):
        out[f"rel_pos_{c}_in_session"] = _trunc(f"({c} - {start})::DOUBLE / ({end} - {start} + 1)::DOUBLE * 100")
    return out


def _sources() -> dict[str, str]:
    out = {"src_any": "1", "src_self": "CAST(aid_next_is_aid > 0 AS INTEGER)"}
    for n, k in CO_EVENTS.items():
        out[f"src_{n}"] = f"CAST(n_aid_{TYPES[k.first]} * {n}_count > 0 AS INTEGER)"
    return out | {f"src_w2vec_{s}": f"CAST(n_w2vec_{s} > 0 AS INTEGER)" for s in ("all", "1_2")}


RANKS_50 = [f"rank_{t}{d}_cl50" for t in TYPES for d in ("", "_7d")]
STATS = ["n_events_session", "n_aids_session", *(f"n_{t}_session" for t in TYPES), "duration_session", "only_orders_session"]
FEATURES = (
    [c for p in COLLAPSED.values() for c in p if c not in RAW and c != "aid_next_is_aid"]
    + STATS + list(_recency()) + list(_sources()) + [*RANKS_50, "src_pop_cl50", *(f"rank_{t}_cl1" for t in TYPES)]
)


def _filled(c: str) -> str:
    if c == "src_any":
        return "1 AS src_any"
    return f"coalesce({c}, {0 if c.startswith('src_') else C.no_order if c == 'ts_order_aid' else -1}) AS {c}"


def _dot(a: str, b: str) -> str:
    return f"list_sum([{a}[i] * {b}[i] FOR i IN range(1, len({a}) + 1)])"


def _hash(*keys: str) -> str:
    out = str(C.seed)
    for k in (*keys, "0"):
        out = f"(({out} * 1103515245::BIGINT + {k} + 12345) % 2147483647)"
    return out


WEIGHT = "CASE type " + " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(C.type_weights)) + " END"
NAME = "CASE type " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
SOURCES = [*_sources()]
SOURCE_CASES = [(c, f"{c} = 1") for c in SOURCES] + [
    (f"{c} & not self_src", f"{c} = 1 AND src_self = 0") for c in SOURCES if c not in ("src_any", "src_self")
]

# In the order in which they build on each other.
TABLES = {
    "ev": """SELECT user_id AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS aid, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS type
FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
    "train": "SELECT * FROM ev WHERE ts <= (SELECT max(ts) - 604800 FROM ev)",
    "test": "SELECT * FROM ev WHERE ts > (SELECT max(ts) - 604800 FROM ev)",
    "pairs": _pairs_of("ev"),
    "counts": _long("pairs"),
    "ranked": """SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, aid, aid_next) AS row,
row_number() OVER (PARTITION BY kind, aid ORDER BY count DESC, aid_next) AS rank, max(count) OVER (PARTITION BY kind, aid) AS most FROM counts""",
    "about": f"SELECT kind, min(count) AS low, quantile_disc(count, {C.top_quantile}) AS high, count(*) AS n FROM counts GROUP BY kind",
    "pair_feats": f"""SELECT r.kind, aid, aid_next, count,
CASE WHEN high > low THEN {_trunc('least((count - low)::DOUBLE / (high - low)::DOUBLE, 1.0::DOUBLE) * 10000')} END AS count_pop,
{_trunc('row::DOUBLE / n::DOUBLE * 10000')} AS perc_pop, rank, {_trunc('count::DOUBLE / most::DOUBLE * 100')} AS count_rel
FROM ranked r JOIN about a ON r.kind = a.kind WHERE rank <= {_first_n().replace('CASE kind', 'CASE r.kind')}""",
    "wide": "SELECT aid, aid_next, " + ", ".join(
        f"max({f}) FILTER (kind = '{k}') AS {k}_{f}" for k in KINDS for f in ("count", "count_pop", "perc_pop", "rank", "count_rel")
    ) + " FROM pair_feats GROUP BY aid, aid_next",
    "stats": "SELECT session, count(aid) AS n_events_session, count(DISTINCT aid) AS n_aids_session, " + ", ".join(
        f"count(*) FILTER (type = {i}) AS n_{t}_session" for i, t in enumerate(TYPES)
    ) + """, min(ts) AS min_ts_session, max(ts) AS max_ts_session, max(ts) - min(ts) AS duration_session,
CAST(count(*) FILTER (type = 2) > 0 AND count(*) FILTER (type IN (0, 1)) = 0 AS INTEGER) AS only_orders_session FROM ev GROUP BY session""",
    "items": _items(),
    "item_ranks": f"SELECT session, aid, {', '.join(ITEM_COLUMNS)} FROM ({_ranks()})",
    "kept_items": f"SELECT * FROM item_ranks WHERE {_truncated(C.last_events, C.most_frequent)}",
    "vecs": "SELECT vec_id AS aid, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings",
    "seen": "SELECT * FROM vecs WHERE aid IN (SELECT aid FROM ev)",
    "seen_buys": "SELECT * FROM vecs WHERE aid IN (SELECT aid FROM ev WHERE type IN (1, 2))",
    "seen_often": "SELECT * FROM vecs WHERE aid IN (SELECT aid FROM ev GROUP BY aid ORDER BY count(*) DESC, aid LIMIT 40)",
    "knn_all": _knn("seen"),
    "knn_buys": _knn("seen_buys"),
    "knn_often": _knn("seen_often"),
    "cand": """SELECT aid, aid AS aid_next FROM kept_items UNION SELECT aid, aid_next FROM pair_feats WHERE aid IN (SELECT aid FROM kept_items)
UNION SELECT aid, aid_next FROM knn_all UNION SELECT aid, aid_next FROM knn_buys""",
    "expanded": f"""SELECT i.*, c.aid_next, {', '.join(f'w.{c}' for c in PAIR_COLUMNS)}, {_trunc('a.dist')} AS dist_w2vec_all,
least(a.rank, 127) AS rank_w2vec_all, {_trunc('e.dist')} AS dist_w2vec_1_2, least(e.rank, 127) AS rank_w2vec_1_2
FROM kept_items i LEFT JOIN cand c ON i.aid = c.aid LEFT JOIN wide w ON c.aid = w.aid AND c.aid_next = w.aid_next
LEFT JOIN knn_all a ON c.aid = a.aid AND c.aid_next = a.aid_next LEFT JOIN knn_buys e ON c.aid = e.aid AND c.aid_next = e.aid_next""".replace(
        "least(a.rank, 127)", "CASE WHEN a.rank IS NOT NULL THEN least(a.rank, 127) END"
    ).replace("least(e.rank, 127)", "CASE WHEN e.rank IS NOT NULL THEN least(e.rank, 127) END"),
    "trimmed": _trim(),
    "collapsed": _group("self", "events", "co", "knn"),
    "recent": "SELECT c.*, s.* EXCLUDE (session), " + ", ".join(f"{sql} AS {n}" for n, sql in _recency().items())
    + " FROM collapsed c LEFT JOIN stats s ON c.session = s.session",
    "sourced": f"SELECT * EXCLUDE ({', '.join(RAW)}, aid_next_is_aid), " + ", ".join(f"{sql} AS {n}" for n, sql in _sources().items())
    + " FROM recent",
    "pop50": _popularity("cl50", "session % 10", True),
    "pop1": _popularity("cl1", "0", False),
    "extra": "SELECT s.session, p.aid AS aid_next, p.* EXCLUDE (cl, aid), 1 AS src_pop_cl50 "
    "FROM (SELECT DISTINCT session FROM sourced) s JOIN pop50 p ON s.session % 10 = p.cl",
    "popular": "SELECT f.*, " + ", ".join(f"g.rank_{t}_cl1" for t in TYPES)
    + " FROM (SELECT * FROM sourced FULL JOIN extra USING (session, aid_next)) f LEFT JOIN pop1 g ON f.aid_next = g.aid",
    "filled": f"SELECT session, aid_next, {', '.join(map(_filled, FEATURES))} FROM popular",
    "weights": f"""SELECT session, aid, greatest(1 - (max(ts) OVER (PARTITION BY session) - ts)::DOUBLE / {C.weight_days * 86400},
{C.weight_floor}::DOUBLE) * {WEIGHT} AS w FROM ev""",
    "session_cells": """SELECT session, dim, round(s / total, 6) AS x FROM (SELECT session, dim, sum(w * x) AS s FROM (
SELECT e.session, e.w, generate_subscripts(v.vector, 1) - 1 AS dim, unnest(v.vector) AS x FROM weights e JOIN vecs v USING (aid))
GROUP BY session, dim) JOIN (SELECT session, sum(w) AS total FROM weights GROUP BY session) USING (session)""",
    "session_vecs": "SELECT session, list(x ORDER BY dim) AS vector FROM session_cells GROUP BY session",
    "placed": "SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, aid, type) AS place, count(*) OVER (PARTITION BY session) AS n FROM ev",
    "truth": """SELECT DISTINCT session, type, aid FROM (SELECT *, row_number() OVER (PARTITION BY session, type ORDER BY place) AS nth
FROM placed WHERE 2 * place > n + 1) WHERE type <> 0 OR nth = 1""",
    "truth_wide": "SELECT session, aid AS aid_next, " + ", ".join(
        f"max(CAST(type = {i} AS INTEGER)) AS target_{t}" for i, t in enumerate(TYPES)
    ) + " FROM truth GROUP BY session, aid",
    "labelled": f"SELECT s.session, s.aid_next, n_aid, ts_order_aid, {', '.join(SOURCES)}, "
    + ", ".join(f"coalesce(target_{t}, 0) AS target_{t}" for t in TYPES)
    + " FROM sourced s LEFT JOIN truth_wide t ON s.session = t.session AND s.aid_next = t.aid_next",
    "scored": "SELECT session, aid AS aid_next, round(n_aid::DOUBLE / (1 + aid % 7), 6) AS pred_score FROM items",
    "best": "SELECT *, row_number() OVER (PARTITION BY session ORDER BY pred_score DESC, aid_next) AS pred_rank FROM scored QUALIFY pred_rank <= 20",
    "said": "SELECT session, type, aid_next AS aid FROM best, (SELECT unnest([0, 1, 2]) AS type)",
    "recalls": f"""SELECT type, sum(hits)::DOUBLE / sum(truth)::DOUBLE AS recall FROM (SELECT session, type,
least(count(*) FILTER (t AND s), {C.truth_cap}) AS hits, least(count(*) FILTER (t), {C.truth_cap}) AS truth
FROM (SELECT *, true AS t FROM truth) FULL JOIN (SELECT *, true AS s FROM said) USING (session, type, aid) GROUP BY session, type) GROUP BY type""",
    "by_source": " UNION ALL ".join(
        f"SELECT '{n}' AS source, session, aid_next, ts_order_aid FROM labelled WHERE {c}" for n, c in SOURCE_CASES
    ),
    "hits": """SELECT source, session, type, place FROM (SELECT *, row_number() OVER (PARTITION BY source, session
ORDER BY ts_order_aid, aid_next) AS place FROM by_source) p JOIN truth t ON p.session = t.session AND p.aid_next = t.aid""".replace(
        "SELECT source, session, type", "SELECT source, p.session, type"
    ),
    "ceilings": f"""SELECT source, type, {', '.join(f'coalesce(h{n}, 0)::DOUBLE / truth AS recall_{n}' for n in ('20', '100', '200', 'all'))}
FROM (SELECT type, sum(n)::DOUBLE AS truth FROM (SELECT session, type, least(count(*), 20) AS n FROM truth GROUP BY 1, 2) GROUP BY type)
CROSS JOIN (SELECT unnest([{', '.join(f"'{n}'" for n, _ in SOURCE_CASES)}]) AS source)
LEFT JOIN (SELECT source, type, sum(a) AS h20, sum(b) AS h100, sum(c) AS h200, sum(d) AS hall FROM (SELECT source, session, type,
least(count(*) FILTER (place <= 20), 20) AS a, least(count(*) FILTER (place <= 100), 20) AS b, least(count(*) FILTER (place <= 200), 20) AS c,
least(count(*), 20) AS d FROM hits GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (source, type)""",
}


LEAST = " ".join(f"WHEN '{n}' THEN {k.min_count}" for n, k in CO_EVENTS.items())
TABLES["counts_often"] = f"SELECT * FROM counts WHERE count >= CASE kind {LEAST} END"
TABLES["ranked_often"] = TABLES["ranked"].replace("FROM counts", "FROM counts_often")
TABLES["about_often"] = TABLES["about"].replace("FROM counts", "FROM counts_often")
TABLES["feats_often"] = TABLES["pair_feats"].replace("ranked r JOIN about a", "ranked_often r JOIN about_often a")


def _needs(sql: str, upto: list[str]) -> list[str]:
    import re

    used = [n for n in upto if re.search(rf"\b{n}\b", sql)]
    out: list[str] = []
    for n in used:
        before = _needs(TABLES[n], upto[: upto.index(n)])
        out += [x for x in [*before, n] if x not in out]
    return sorted(out, key=upto.index)


def sql(final: str) -> str:
    names = _needs(final, list(TABLES))
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names) + f"\n{final}" if names else final


def _rounded(columns, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _total(table: str, keys: str, measures, digits: int = 6) -> str:
    both = ", ".join(f"round(sum({m} * w), {digits}) AS {m}" for m in measures)
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}x AS type, {both} FROM (SELECT *, {NAME} AS x, 1.0::DOUBLE AS w FROM {table}
UNION ALL SELECT *, 'total', {WEIGHT} FROM {table}) GROUP BY {lead}x"""


def _top(pairs: str) -> str:
    return f"""SELECT aid, aid_next, count, row_number() OVER (PARTITION BY aid ORDER BY count DESC, aid_next) AS rank
FROM (SELECT aid, aid_next, count(*) AS count FROM {pairs} GROUP BY aid, aid_next) QUALIFY rank <= 20"""


def _per_split() -> str:
    part = lambda t: f"SELECT * FROM ({_long(f'({_pairs_of(t)})')}) WHERE count >= 2"
    return f"""SELECT kind, aid, aid_next, CAST(sum(count) AS BIGINT) AS count FROM ({part('train')} UNION ALL {part('test')})
GROUP BY kind, aid, aid_next HAVING sum(count) >= 2"""


def _describe() -> str:
    points = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    named = ", ".join(f"round(quantile_cont(x, {p}), 4) AS p{round(100 * p)}" for p in points)
    long = " UNION ALL ".join(f'SELECT \'{c}\' AS "column", sum({c})::DOUBLE AS x FROM labelled GROUP BY session' for c in SOURCES)
    return f"""SELECT "column", count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, {named},
max(x) AS max, count(*) FILTER (x IS NULL) AS count_nan, round(count(*) FILTER (x IS NULL) / count(*), 4) AS share_nan
FROM ({long}) GROUP BY "column" """


REC = list(_recency())
SIMILAR = f"""coalesce({_dot('s.vector', 'v.vector')} / (sqrt({_dot('s.vector', 's.vector')}) * sqrt({_dot('v.vector', 'v.vector')})), 0)"""
EUCLID = "coalesce(sqrt(list_sum([(s.vector[i] - v.vector[i]) ** 2 FOR i IN range(1, len(s.vector) + 1)])), -1)"
SIMILARITY = f"round({SIMILAR}, 4) AS cos_sim_ses_aid, round({EUCLID}, 4) AS eucl_dist_ses_aid"
VECTORS = "LEFT JOIN session_vecs s ON x.session = s.session LEFT JOIN vecs v ON x.aid_next = v.aid"

FINAL = {
    "co_visit_topn": _top("pairs"),
    "self_merge_pairs": "SELECT * FROM pairs",
    "co_counts_typed": "SELECT aid, aid_next, " + ", ".join(f"count(*) FILTER {_kind(k)} AS {k}" for k in KINDS) + " FROM pairs GROUP BY aid, aid_next",
    "co_counts_per_split": _per_split(),
    "train_test_split": "SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' FROM test",
    "pair_features": "SELECT * FROM pair_feats",
    "pair_features_wide": "SELECT * FROM wide",
    "session_stats": "SELECT * FROM stats",
    "session_item_counts": "SELECT * FROM items",
    "session_item_ranks": "SELECT * FROM item_ranks",
    "session_item_left_in_cart": "SELECT session, aid, left_in_cart FROM item_ranks WHERE left_in_cart = 1",
    "session_item_truncated": f"SELECT session, aid FROM item_ranks WHERE {_truncated(3, 2)}",
    "sentences": "SELECT session, count(*) AS n_aid, string_agg(aid::VARCHAR, ' ' ORDER BY ts, aid, type) AS sentence FROM ev GROUP BY session",
    "knn_exact": "SELECT aid, aid_next, round(dist, 6) AS dist, rank FROM knn_all",
    "frequent_item_neighbours": "SELECT aid, aid_next, round(dist, 6) AS dist, rank FROM knn_often",
    "pair_features_frequent": "SELECT * FROM feats_often",
    "candidate_pairs_union": "SELECT * FROM cand",
    "candidates_expanded": "SELECT * FROM expanded",
    "candidates_trimmed": "SELECT session, aid, aid_next FROM trimmed",
    "session_next_self_feats": _group("self"),
    "session_next_event_feats": _group("events"),
    "session_next_co_feats": _group("co"),
    "session_next_knn_feats": _group("knn"),
    "recency_feats": f"SELECT session, aid_next, {', '.join(REC)} FROM recent",
    "source_flags": f"SELECT session, aid_next, {', '.join(SOURCES)} FROM sourced",
    "cluster_popularity": "SELECT * FROM pop50",
    "general_popularity": "SELECT * EXCLUDE (cl) FROM pop1",
    "popularity_candidates_outer": "SELECT session, aid_next, n_aid, " + ", ".join([*RANKS_50, "src_pop_cl50", *(f"rank_{t}_cl1" for t in TYPES)]) + " FROM popular",
    "session_embedding": "SELECT session, dim, x FROM session_cells",
    "session_item_similarity": f"SELECT x.session, x.aid_next, {SIMILARITY} FROM (SELECT DISTINCT session, aid AS aid_next FROM ev) x {VECTORS}",
    "labels_join": "SELECT x.session, x.aid_next, " + ", ".join(f"coalesce(target_{t}, 0) AS target_{t}" for t in TYPES)
    + " FROM (SELECT DISTINCT session, aid AS aid_next FROM ev) x LEFT JOIN truth_wide t ON x.session = t.session AND x.aid_next = t.aid_next",
    "null_policy": "SELECT * FROM filled",
    "features_full": f"SELECT x.*, {SIMILARITY}, " + ", ".join(f"coalesce(target_{t}, 0) AS target_{t}" for t in TYPES)
    + f" FROM filled x {VECTORS} LEFT JOIN truth_wide t ON x.session = t.session AND x.aid_next = t.aid_next",
    "downsample_negatives": f"""SELECT session, aid_next, target_carts FROM (SELECT *, sum(target_carts) OVER (PARTITION BY session) AS pos,
row_number() OVER (PARTITION BY session ORDER BY target_carts, {_hash('session', 'aid_next')}, aid_next) AS place FROM labelled)
WHERE pos > 0 AND (target_carts = 1 OR place <= least(2 * pos, 15))""",
    "group_sizes": "SELECT session, count(*) AS n FROM labelled GROUP BY session",
    "rank_topk": "SELECT * FROM best",
    "submission_strings": f"""SELECT session::VARCHAR || '_' || {NAME} AS session_type,
string_agg(aid_next::VARCHAR, ' ' ORDER BY pred_score DESC, aid_next) AS labels
FROM best, (SELECT unnest([0, 1, 2]) AS type) GROUP BY session, type""",
    "submission_parse": "SELECT * FROM said",
    "recall_weighted": _total("recalls", "", ["recall"]),
    "recall_ceiling_by_source": _total("ceilings", "source", [f"recall_{n}" for n in ("20", "100", "200", "all")]),
    "candidate_count_describe": _describe(),
    "basket_co_visit": _top("""(SELECT a.l_partkey AS aid, b.l_partkey AS aid_next FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"""),
    "etl_sessions": "SELECT * FROM ev",
    "etl_labels": "SELECT * FROM truth",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(final) for name, final in FINAL.items()}

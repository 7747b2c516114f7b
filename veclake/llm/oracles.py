"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .quality import OCTAVE, PRIOR, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"w AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"


def windows(n: int) -> str:
    """(doc_id, i, s): every window of n words and its place from 1."""
    return (
        f"l AS (SELECT doc_id, list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) AS ss FROM w WHERE len(ws) >= {n}), "
        "win AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM l)"
    )


EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

#: Levels of substring deduplication that the SQL spells out: windows of up to 13 * 2**12 words.
LEVELS = 13


def _levels() -> str:
    out = ["lv0 AS (SELECT doc_id, i, md5(s) AS h FROM win)"]
    for k in range(LEVELS):
        if k:
            out.append(f"lv{k} AS (SELECT a.doc_id, a.i, md5(a.h || b.h) AS h FROM r{k - 1} a JOIN r{k - 1} b ON a.doc_id = b.doc_id AND b.i = a.i + {13 << (k - 1)})")
        out.append(f"r{k} AS (SELECT doc_id, i, h FROM lv{k} JOIN (SELECT h FROM lv{k} GROUP BY h HAVING count(DISTINCT doc_id) > 1) USING (h))")
    every = " UNION ALL ".join(f"SELECT doc_id, {13 << k} AS n FROM r{k}" for k in range(LEVELS))
    return ", ".join(out) + f", longest AS (SELECT doc_id, max(n) AS longest_repeat FROM ({every}) GROUP BY doc_id)"


SUBSTRING_DEDUP = f"""
WITH {WORDS}, {windows(13)}, {_levels()},
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN f USING (s) WHERE m < doc_id),
r AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: js IS NULL OR NOT list_contains(js, i)), ' ')) AS kept_sha256, coalesce(longest_repeat, 0)::BIGINT AS longest_repeat
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


def _poured(name: str, source: str, parents: str, child: str, budget: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    order = f"{by} ORDER BY ratio, {child}"
    return f"""
{name}_r AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 0.0 END AS ratio FROM {source}),
{name}_a AS (SELECT *, ({budget} - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / nullif(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM {name}_r),
{name}_b AS (SELECT *, min(CASE WHEN cap > level * weight THEN struct_pack(r := ratio, c := {child}, l := level) END) OVER ({by}) AS final FROM {name}_a),
{name} AS (SELECT * EXCLUDE (ratio, level, final), (CASE WHEN final IS NULL THEN cap ELSE least(cap, floor(greatest(final.l, 0.0) * weight)) END)::BIGINT AS budget FROM {name}_b)"""


def _named(column: str, values: dict, other: float) -> str:
    cases = " ".join(f"WHEN {column} = '{k}' THEN {float(v)}" for k, v in values.items() if k is not None)
    return f"(CASE {cases} ELSE {other} END)::DOUBLE" if cases else f"{other}::DOUBLE"


def mixing(weights: dict, share: float, epochs: int, seed: int, rates: dict) -> str:
    of = {c: _named(c, weights.get(c, {}), 1.0) for c in ("domain", "lang", "source")}
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce('d' || (try_cast(right(nullif(regexp_extract(source, '([0-9]+)$', 1), ''), 9) AS BIGINT) % 3)::VARCHAR, 'other') AS domain,
                  ceil(coalesce(strlen(text), 0) / {_named('lang', rates, rates[None])})::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {of['source']} AS weight, (({of['source']} > 0)::INT * sum(n_tokens) * {epochs})::BIGINT AS cap FROM d GROUP BY domain, lang, source),
lng AS (SELECT domain, lang, sum(tokens)::BIGINT AS tokens, {of['lang']} AS weight, (({of['lang']} > 0)::INT * sum(cap))::BIGINT AS cap FROM leaf GROUP BY domain, lang),
dom AS (SELECT domain, sum(tokens)::BIGINT AS tokens, {of['domain']} AS weight, (({of['domain']} > 0)::INT * sum(cap))::BIGINT AS cap FROM lng GROUP BY domain),
dom2 AS (SELECT *, floor(sum(tokens) OVER ()::BIGINT * {share}::DOUBLE)::BIGINT AS total FROM dom),
{_poured('domains', 'dom2', '', 'domain', 'total')},
lng2 AS (SELECT lng.*, domains.budget AS up FROM lng JOIN domains ON lng.domain IS NOT DISTINCT FROM domains.domain),
{_poured('langs', 'lng2', 'domain', 'lang', 'up')},
src AS (SELECT leaf.*, langs.budget AS up FROM leaf JOIN langs ON leaf.domain IS NOT DISTINCT FROM langs.domain AND leaf.lang IS NOT DISTINCT FROM langs.lang),
{_poured('sources', 'src', 'domain, lang', 'source', 'up')},
p AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM sources),
o AS (SELECT d.*, p.epochs, p.budget - p.epochs * p.tokens AS rest, md5('{seed}:' || p.epochs || ':' || coalesce(d.doc_id::VARCHAR, '')) AS place
      FROM d JOIN p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + (rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest)::INT)::BIGINT AS copies FROM o
"""


def _bin(value: str) -> str:
    drop = f"greatest(length(bin({value})) - {OCTAVE.bit_length()}, 0)"
    return f"({drop} * {OCTAVE} + ({value} >> {drop}))"


def _fences() -> tuple[str, str]:
    bounds, tests = [], []
    for name, (down, up, least) in RULES.items():
        for side, bound in (("low", down and f"q1 - {down} * greatest(q3 - q1, {least})"), ("high", f"q3 + {up} * greatest(q3 - q1, {least})")):
            if bound:
                bounds.append(f"max(CASE WHEN metric = '{name}' THEN {bound} END) AS {name}_{side}")
                tests.append(f"coalesce({_bin(name)} {'<=' if side == 'high' else '>='} {name}_{side}, true)")
    return ", ".join(bounds), " AND ".join(tests)


def _quartiles(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""
{name}_n AS (SELECT {by}metric, bin, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL),
{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bin)::BIGINT AS upto, sum(n) OVER (PARTITION BY {by}metric)::BIGINT AS total FROM {name}_n),
{name} AS (SELECT {by}metric, min(bin) FILTER (WHERE 4 * upto >= total) AS q1, min(bin) FILTER (WHERE 4 * upto >= 3 * total) AS q3, max(total)::BIGINT AS total FROM {name}_u GROUP BY ALL)"""


def quality() -> str:
    bounds, tests = _fences()
    names = list(RULES)
    pick = ", ".join(f"(a.total * a.{q} + {PRIOR} * ((b.total * b.{q} + {PRIOR} * c.{q}) // (b.total + {PRIOR}))) // (a.total + {PRIOR}) AS {q}" for q in ("q1", "q3"))
    return rf"""
WITH {WORDS}, {windows(3)},
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             (n_symbols + 1) * 1000000 // (word_chars + 1) AS symbols, (n_dup_lines + 1) * 1000000 // (n_lines + 1) AS dup_lines,
             (n_repeat_words + 1) * 1000000 // (n_words + 1) AS repeat_words, coalesce(100 * word_chars // nullif(n_words, 0), 0) AS word_len FROM m),
x AS (SELECT lang, source, unnest({names}) AS metric, unnest([{', '.join(names)}]) AS value FROM v WHERE NOT base_failed),
sketch AS (SELECT lang, source, metric, {_bin('value')} AS bin, count(*) AS n FROM x GROUP BY ALL),
{_quartiles('leaf', 'lang, source')},{_quartiles('lng', 'lang')},{_quartiles('every', '')},
t AS (SELECT a.lang, a.source, a.metric, {pick} FROM leaf a JOIN lng b ON a.lang IS NOT DISTINCT FROM b.lang AND a.metric = b.metric JOIN every c ON a.metric = c.metric),
bounds AS (SELECT lang, source, {bounds} FROM t GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept, v.lang, v.source, n_lines
FROM v LEFT JOIN bounds ON v.lang IS NOT DISTINCT FROM bounds.lang AND v.source IS NOT DISTINCT FROM bounds.source
"""

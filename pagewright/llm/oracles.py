"""SQL that the queries of this subpackage are checked against, where SQL can express them."""

from __future__ import annotations

from pagewright.llm import credentials

#: The white space of the line and word rules, as a list of characters.
_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A table with one row, the list ``crc`` of the checksum's 256 steps, and the unsigned CRC-32 of a text beside it.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i))"


def _crc(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


_LINES = f"""SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_WS})")} AS key
 FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""

OP4 = f"""WITH lines AS ({_LINES}),
 frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
 FROM (SELECT *, key IN (SELECT key FROM frequent) AS gone FROM lines) GROUP BY doc_id"""

# ---- secrets -----------------------------------------------------------------------------------


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _places(name: str, pattern: str) -> str:
    """Tables name(doc_id, i, m, s, e): the matches of a pattern with their places, from the pieces between them."""
    return f"""{name}_r AS (SELECT doc_id, regexp_extract_all(t, {_text(pattern)}) AS ms, regexp_split_to_array(t, {_text(pattern)}) AS ps FROM d),
 {name}_u AS (SELECT doc_id, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i FROM {name}_r),
 {name}_s AS (SELECT *, CAST(sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS s FROM {name}_u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 {name} AS (SELECT *, s + length(m) AS e FROM {name}_s)"""


#: The base kinds as they are asked for: pattern, group and least length of that group.
_BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


def _secret_sql() -> str:
    base = ", ".join(_places(kind, pattern) for kind, pattern, _, _ in _BASE)
    kept = " UNION ALL ".join(
        f"SELECT doc_id, s, {rank} AS rank, e, '{kind}' AS kind FROM {kind} WHERE length(regexp_extract(m, {_text(pattern)}, {group})) >= {least}"
        for rank, (kind, pattern, group, least) in enumerate(_BASE)
    )
    starts = lambda name: f"regexp_matches(m, {_text('^(?i:' + credentials.PARTS[name] + ')')})"
    kinds = " ".join(f"WHEN {starts(k)} THEN '{k}'" for k in ("secret", "access", "ident", "endpoint"))
    named = _text(r"^(?i:pwd|passphrase|credential|private_?key|auth_?key)[^:=]*[:=]")
    links = " OR ".join(f"(p.kind = '{k}' AND q.kind IN ({', '.join(map(_text, v))}))" for k, v in credentials.LINKS.items())
    ranks = " ".join(f"WHEN '{k}' THEN {credentials.RANK[k]}" for k in credentials.LINKS)
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {base}, base AS ({kept}),
 {_places("part", credentials.COMBINED)},
 parts AS (SELECT *, CASE WHEN starts_with(m, chr(10)) THEN NULL {kinds} WHEN regexp_matches(m, {named}) OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')) THEN 'key' END AS kind,
   count(*) FILTER (WHERE starts_with(m, chr(10))) OVER (PARTITION BY doc_id ORDER BY i) AS scope FROM part),
 linked AS (SELECT doc_id, s, CASE kind {ranks} END AS rank, e, kind FROM parts AS p WHERE EXISTS (SELECT 1 FROM parts AS q WHERE q.doc_id = p.doc_id AND q.scope = p.scope AND q.s - p.e <= {credentials.NEAR} AND p.s - q.e <= {credentials.NEAR} AND ({links}))),
 b AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, {joined} AS base FROM base GROUP BY doc_id),
 a AS (SELECT doc_id, {joined} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


# ---- near duplicates ---------------------------------------------------------------------------

#: All pairs that share a shingle, and the closure of their links; for small tables.
OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
   ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS xs FROM w),
 n AS (SELECT doc_id, CAST(len(xs) AS BIGINT) AS n FROM sets), s AS (SELECT doc_id, unnest(xs) AS x FROM sets),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM pairs JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
 SELECT doc_id, any_value(n) AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = doc_id GROUP BY doc_id"""

# ---- shards ------------------------------------------------------------------------------------


def _shard_sql(shards: int = 24, bits: int = 5) -> str:
    """Checksums byte by byte, equally filled cells per value, and the curve's index by turning each level's cell.

    Names are grouped by value here, where the operator groups them by 4,096 hash bins; the same while no two names share one.
    """
    table, crc = _CRC_TABLE, _crc("t")
    dims = {"a": "lang", "b": "source", "c": "step"}
    codes = ", ".join(
        f"{k}_n AS (SELECT {v}, count(*) AS n FROM d GROUP BY {v}), {k}_c AS (SELECT {v}, CAST(floor((sum(n) OVER (ORDER BY {v}) - n) * {1 << bits} / sum(n) OVER ()) AS BIGINT) AS {k} FROM {k}_n)"
        for k, v in dims.items()
    )
    steps, last = [], "k0"
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for axis in "abc":
            if axis == "a":
                cols = f"CASE WHEN a & {q} <> 0 THEN xor(a, {p}) ELSE a END AS a, b, c"
            else:
                keep = {x: x for x in "bc"} | {axis: f"CASE WHEN {axis} & {q} <> 0 THEN {axis} ELSE xor({axis}, xor(a, {axis}) & {p}) END"}
                cols = f"CASE WHEN {axis} & {q} <> 0 THEN xor(a, {p}) ELSE xor(a, xor(a, {axis}) & {p}) END AS a, " + ", ".join(f"{e} AS {x}" for x, e in keep.items())
            steps.append(f"k{len(steps) + 1} AS (SELECT id, size, sum32, {cols} FROM {last})")
            last = f"k{len(steps)}"
    turn = "0"
    for level in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN c & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    index = " | ".join(f"((({x} >> {n}) & 1) << {n * 3 + 2 - i})" for n in range(bits) for i, x in enumerate("abc"))
    return f"""WITH d AS (SELECT doc_id AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size,
   CAST(floor(log2(CAST(strlen(coalesce(text, '')) + 8 AS DOUBLE)) * 8 + 1e-9) AS BIGINT) AS step FROM documents),
 {codes}, k0 AS (SELECT id, size, CAST({crc} AS BIGINT) AS sum32, a, b, c FROM d JOIN a_c USING (lang) JOIN b_c USING (source) JOIN c_c USING (step), {table} AS crc_table),
 {", ".join(steps)}, g AS (SELECT id, size, sum32, a, xor(b, a) AS b, xor(c, xor(b, a)) AS c FROM {last}), h AS (SELECT *, {turn} AS f FROM g),
 x AS (SELECT id, size, sum32, xor(a, f) AS a, xor(b, f) AS b, xor(c, f) AS c FROM h), r AS (SELECT *, row_number() OVER (ORDER BY {index}, id NULLS FIRST, size, sum32) - 1 AS rank, count(*) OVER () AS total FROM x)
 SELECT id AS doc_id, size, sum32 AS text_crc32, 'rows' AS law, CAST(rank * {shards} // total AS INT) AS shard, rank - (rank * {shards} // total * total + {shards - 1}) // {shards} AS slot, CAST(NULL AS INT) AS grown_shard FROM r"""


OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# ---- quality -----------------------------------------------------------------------------------

#: For six features: the chi-square quantile at one in a million, and what the innermost three quarters' covariance falls short by.
_LIMIT, _SHORT = 38.25833637773817, 1.36159030918112


def _quality_sql(steps: int = 8) -> str:
    """Statistics and features of every text, then the concentration steps one after the other on sums per group and start.

    A step that takes the rows of the step before changes nothing, so all steps may be done. Sums keep their order.
    """
    p, unit = 6, 4096
    floors = [(x * unit) ** 2 for x in (0.5, 0.25, 0.05, 0.1, 0.1, 0.1)]
    low = [(i, j) for i in range(p) for j in range(i + 1)]
    plus = lambda terms: "(" + " + ".join(["0.0::DOUBLE", *terms]) + ")"
    share = lambda c: f"asin(sqrt(least({c}, 1.0::DOUBLE)))"
    each, most = "CAST(greatest(n_words, 1) AS DOUBLE)", "CAST(greatest(word_chars, 1) AS DOUBLE)"
    raw = [f"ln({each})", f"ln({most} / {each})", share(f"n_symbols / {most}"), share(f"n_upper / {most}"), share(f"n_dup_lines / {each}"), share(f"n_repeat_words / {each}")]
    values = ", ".join(f"CAST(round({v} * {unit}) AS BIGINT) AS f{i}" for i, v in enumerate(raw))
    sums = "count(*) AS n, " + ", ".join(f"CAST(sum(f{i}) AS DOUBLE) AS s{i}" for i in range(p)) + ", " + ", ".join(f"CAST(sum(CAST(f{i} AS HUGEINT) * f{j}) AS DOUBLE) AS s{i}_{j}" for i, j in low)

    def estimate(source: str, factor: float) -> str:
        q = f"SELECT *, {', '.join(f's{i} / n AS m{i}' for i in range(p))} FROM {source}"
        wider = lambda cols: f"SELECT *, {', '.join(cols)} FROM ({q})"
        q = wider(f"(s{i}_{j} / n - m{i} * m{j}) * {factor!r}::DOUBLE + {floors[i] if i == j else 0.0!r}::DOUBLE AS c{i}_{j}" for i, j in low)
        for j in range(p):
            q = wider([f"sqrt(greatest(c{j}_{j} - {plus(f'l{j}_{k} * l{j}_{k}' for k in range(j))}, {floors[j] / 2!r}::DOUBLE)) AS l{j}_{j}"])
            if j + 1 < p:
                q = wider(f"(c{i}_{j} - {plus(f'l{i}_{k} * l{j}_{k}' for k in range(j))}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, p))
        for i in range(p):
            q = wider([f"1.0::DOUBLE / l{i}_{i} AS w{i}_{i}"])
            if i:
                q = wider(f"-{plus(f'l{i}_{k} * w{k}_{j}' for k in range(j, i))} / l{i}_{i} AS w{i}_{j}" for j in range(i))
        kept = [*(f"m{i}" for i in range(p)), *(f"w{i}_{j}" for i, j in low)]
        return f"SELECT g, start, {', '.join(kept)}, {plus(f'ln(l{i}_{i}) * 2' for i in range(p))} AS det FROM ({q})"

    z = [plus(f"w{i}_{j} * (CAST(f{j} AS DOUBLE) - m{j})" for j in range(i + 1)) for i in range(p)]
    distance = plus(f"{x} * {x}" for x in z)
    flat = ", ".join([f"s{i}" for i in range(p)] + [f"s{i}_{j}" if i == j else f"s{i} * s{j} / n AS s{i}_{j}" for i, j in low])
    out = [
        f"""d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 w AS MATERIALIZED (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') AS ls FROM d),
 v AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
 rep AS (SELECT rid, CAST(sum(least(coalesce(later - i, 8), 8)) AS BIGINT) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS later FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS c FROM v) WHERE c > 1) GROUP BY rid),
 st AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, length(translate(t, {_WS}, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
   length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
 base AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {values} FROM st),
 sound AS MATERIALIZED (SELECT *, CASE WHEN c2 >= 50 THEN 2 WHEN c1 >= 50 THEN 1 ELSE 0 END AS cut, coalesce('=' || lang, '') AS la, coalesce('=' || source, '') AS so
   FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS c2, count(*) OVER (PARTITION BY lang) AS c1 FROM base WHERE NOT base_failed)),
 own AS (SELECT *, CASE cut WHEN 2 THEN '2' || la || '|' || so WHEN 1 THEN '1' || la ELSE '0' END AS g FROM sound),
 mem AS MATERIALIZED (SELECT g, f0, f1, f2, f3, f4, f5 FROM own WHERE cut = 2 UNION ALL SELECT '1' || la, f0, f1, f2, f3, f4, f5 FROM sound WHERE la IN (SELECT la FROM sound WHERE cut = 1)
   UNION ALL SELECT '0', f0, f1, f2, f3, f4, f5 FROM sound WHERE (SELECT min(cut) FROM sound) = 0),
 sums AS MATERIALIZED (SELECT g, {sums} FROM mem GROUP BY g),
 first AS (SELECT g, 0 AS start, n, {', '.join([f's{i}' for i in range(p)] + [f's{i}_{j}' for i, j in low])} FROM sums UNION ALL SELECT g, 1, n, {flat} FROM sums),
 e0 AS MATERIALIZED ({estimate("first", 1.0)})"""
    ]
    for k in range(steps):
        out.append(
            f"""b{k} AS MATERIALIZED (SELECT g, start, f0, f1, f2, f3, f4, f5, least(CAST(floor(log2(1e-6::DOUBLE + {distance}) * 64) AS BIGINT) + 1280, 4095) AS bin FROM mem JOIN e{k} USING (g)),
 t{k} AS (SELECT g, start, max(bin) AS last FROM (SELECT g, start, bin, sum(n) OVER (PARTITION BY g, start ORDER BY bin) - n < ceil(sum(n) OVER (PARTITION BY g, start) * 0.75::DOUBLE) AS taken FROM (SELECT g, start, bin, count(*) AS n FROM b{k} GROUP BY ALL)) WHERE taken GROUP BY g, start),
 u{k} AS MATERIALIZED (SELECT g, start, {sums} FROM b{k} JOIN t{k} USING (g, start) WHERE bin <= last GROUP BY g, start), e{k + 1} AS MATERIALIZED ({estimate(f"u{k}", _SHORT)})"""
        )
    return f"""WITH {", ".join(out)}, best AS (SELECT * FROM e{steps} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start) = 1),
 near AS (SELECT rid, {distance} <= {_LIMIT!r}::DOUBLE AS near FROM own JOIN best USING (g))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(near, false) AS kept FROM base LEFT JOIN near USING (rid)"""


# ---- chats -------------------------------------------------------------------------------------


def _chat_sql() -> str:
    """Costs by state carried forward turn by turn, then the cheapest path walked back. States: 0 nothing yet, 1 system,
    2 user, 3 assistant; equal costs prefer the lower state before."""

    def costs(known: str | None) -> list[int]:
        other = [0 if known == r else 3 if known else 1 for r in ("system", "user", "assistant")]
        out = [1 << 40] * 16
        for before, after, cost in (
            (0, 1, other[0]), (0, 2, other[1]), (1, 2, other[1]), (2, 3, other[2]), (3, 2, other[1]),  # a message begins
            (1, 1, 1 + other[0]), (2, 2, 1 + other[1]), (3, 3, 1 + other[2]),  # the message before goes on
            (0, 3, 2 + other[2]), (1, 3, 2 + other[2]),  # an empty user message first
        ):
            out[4 * before + after] = cost
        return out

    matrix = "CASE role " + " ".join(f"WHEN '{r}' THEN {costs(r)}" for r in ("system", "user", "assistant")) + f" ELSE {costs(None)} END"
    ways = "list_transform([0, 1, 2, 3], lambda a: f.best[a + 1] + t.m[4 * a + z + 1])"
    start, end = "'<|im_start|>'", "'<|im_end|>' || chr(10)"
    empty = lambda r: f"{start} || '{r}' || chr(10) || {end}"
    close = f"CASE WHEN a > 0 THEN {end} ELSE '' END"
    return f"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, {matrix} AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, ''))) AS n,
   count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations),
 f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, [0, {1 << 40}, {1 << 40}, {1 << 40}] AS best, CAST([] AS BIGINT[]) AS origin FROM t
  UNION ALL SELECT t.conv_id, t.n, list_transform([0, 1, 2, 3], lambda z: least({1 << 40}, list_min({ways}))), list_transform([0, 1, 2, 3], lambda z: CAST(list_position({ways}, list_min({ways})) - 1 AS BIGINT))
  FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.n = f.n + 1),
 ends AS (SELECT f.conv_id, f.n, [best[1], best[2] + 4, best[3] + 2, best[4]] AS e FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.n = f.n AND t.n = t.turns),
 walk AS (SELECT conv_id, n, CAST(list_position(e, list_min(e)) - 1 AS BIGINT) AS z FROM ends
  UNION ALL SELECT w.conv_id, w.n - 1, f.origin[w.z + 1] FROM walk AS w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n WHERE w.n > 0),
 p AS (SELECT t.*, w.z, v.z AS a, t.m[4 * v.z + w.z + 1] AS c, CASE WHEN v.z = w.z THEN 'merge' WHEN w.z = 3 AND v.z < 2 THEN 'insert' ELSE 'place' END AS action
  FROM t JOIN walk AS w ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.n = t.n JOIN walk AS v ON v.conv_id IS NOT DISTINCT FROM t.conv_id AND v.n = t.n - 1)
 SELECT conv_id, turn, role, action, ['system', 'user', 'assistant'][z] AS new_role, CAST(c + CASE WHEN n < turns THEN 0 WHEN z = 1 THEN 4 WHEN z = 2 THEN 2 ELSE 0 END AS INT) AS cost,
  CASE action WHEN 'merge' THEN chr(10) WHEN 'insert' THEN {close} || {empty("user")} || {start} || 'assistant' || chr(10) ELSE {close} || {start} || ['system', 'user', 'assistant'][z] || chr(10) END || text
   || CASE WHEN n < turns THEN '' WHEN z = 1 THEN {end} || {empty("user")} || {empty("assistant")} WHEN z = 2 THEN {end} || {empty("assistant")} ELSE {end} END AS rendered FROM p"""


# ---- resampling --------------------------------------------------------------------------------


def _features(table: str, key: str) -> str:
    return f"""SELECT {key} AS id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS x
   FROM (SELECT {key}, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM {table})"""


OP11 = f"""WITH f AS ({_features("documents", "doc_id")}), g AS ({_features("benchmark", "item_id")}),
 b AS (SELECT x, CAST({_crc("x")} AS BIGINT) % 10000 AS b FROM (SELECT x FROM f UNION SELECT x FROM g), {_CRC_TABLE} AS crc_table),
 fb AS (SELECT id, b FROM f JOIN b USING (x)), s AS (SELECT b, count(*) AS s FROM fb GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN b USING (x) GROUP BY b),
 gains AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM g) + 10000)))) AS gain FROM s LEFT JOIN t USING (b)),
 w AS (SELECT id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM fb JOIN gains USING (b) GROUP BY id),
 d AS (SELECT doc_id, len(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN w ON id = doc_id),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM d WHERE able)
 SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM r) * 25 // 100 THEN r END AS rank FROM d LEFT JOIN r USING (doc_id)"""


# ---- spelling variants -------------------------------------------------------------------------

#: Words beside each of their code points left out: equal rests at one place are a replacement, a rest that is a word a deletion.
OP12 = f"""WITH RECURSIVE runs AS (SELECT doc_id, {_LOWER.format("x")} AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS x FROM documents) GROUP BY ALL),
 h AS (SELECT run, n, CAST({_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS BIGINT) AS h FROM runs, {_CRC_TABLE} AS crc_table),
 words AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
 cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
 dels AS (SELECT c.word AS a, w.word AS b FROM cut AS c JOIN words AS w ON w.word = c.rest),
 near AS (SELECT a, b FROM dels UNION SELECT b, a FROM dels UNION SELECT x.word, y.word FROM cut AS x JOIN cut AS y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
 best AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(m := -n, near := b)) AS best FROM near JOIN words ON word = b GROUP BY a),
 forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.near END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n FROM words LEFT JOIN best USING (word)),
 way AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms AS f ON f.word = way.next)
 SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM way WHERE next IS NULL) USING (word)"""


# ---- archives ----------------------------------------------------------------------------------

_SIGNS = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '')"
OP13 = f"""SELECT page_id, payload_bytes, {_SIGNS} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
 FROM (SELECT page_id, strlen(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last FROM (SELECT page_id, coalesce(html, '') AS b FROM pages))"""


ORACLES = {
    "op2_secret_scan": _secret_sql(), "op3_hilbert_shards": _shard_sql(), "op4_line_dedup": OP4, "op5_shingle_join": OP5, "op6_quality_outliers": _quality_sql(),
    "op9_top_products": OP9,
    "op10_chat_repair": _chat_sql(), "op11_importance_resampling": OP11, "op12_spelling_variants": OP12, "op13_segment_reassembly": OP13,
}
